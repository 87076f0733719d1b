"""Queries of the store's index, of leads and of call state, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import calls, graph, index, leads
from .catalogue import query, table


@query("SELECT 'kb_' || doc_id AS record_id, len(quality_flags) AS flags, len(embedding) AS dimensions, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM (SELECT doc_id, CASE WHEN length(text) > 2000 THEN ['long', 'whole'] ELSE ['whole'] END AS quality_flags FROM documents WHERE length(text) >= 200) JOIN embeddings ON doc_id = vec_id")
def vector_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records, short ones not retrievable, written with JSON lists; their index built, opened, aligned."""
    name = F.concat(F.lit("kb_"), F.col("doc_id").cast("string"))
    flags = F.when(F.length("text") > 2000, F.array(F.lit("long"), F.lit("whole"))).otherwise(F.array(F.lit("whole")))
    store = graph.folder(spark, "store")
    table(spark, sf_dir, "documents").select(name.alias("record_id"), (F.length("text") >= 200).alias("retrievable"), F.to_json(flags).alias("quality_flags")).write.parquet(store)
    records = index.load_records(spark, store)
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("kb_"), F.col("vec_id").cast("string")).alias("record_id"), "embedding")
    built = index.build_index(records, vectors, graph.folder(spark, "index"), "given-vectors:1")
    rows = index.open_index(records, built, "given-vectors:1")
    total = F.aggregate("embedding", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double"))
    return rows.select("record_id", F.size("quality_flags").cast("long").alias("flags"), F.size("embedding").cast("long").alias("dimensions"), F.round(total, 4).alias("total"))


@query(r"""
WITH c AS (SELECT doc_id, nullif(regexp_extract(text, '\b(?:my name is|this is|it''?s|i am|i''m)\s+([A-Z][a-z'']+(?:\s+[A-Z][a-z'']+){0,2})\b', 1), '') AS full_name,
                  regexp_extract(text, '(\+?\d[\d\s\-]{8,15}\d)', 1) AS number FROM documents)
SELECT doc_id, full_name, CASE WHEN length(regexp_replace(number, '\D', '', 'g')) BETWEEN 9 AND 15 THEN number END AS contact_number FROM c
""")
def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", leads.contact_name(text).alias("full_name"), leads.contact_number(text).alias("contact_number"))


@query("""
WITH c AS (SELECT o_orderkey AS call_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'underwriting' ELSE '' END AS e, o_orderstatus <> 'P' AS d, o_totalprice > 100000 AS q,
                  CASE WHEN o_orderpriority = '5-LOW' THEN '' ELSE 'age, ' || lower(o_orderstatus) END AS m, CASE WHEN o_orderpriority = '2-HIGH' THEN 'medical exam, proof of income' ELSE '' END AS r FROM orders),
a AS (SELECT *, CASE WHEN e <> '' THEN 'escalated' WHEN NOT d THEN 'incomplete' WHEN q THEN 'qualified' ELSE 'declined' END AS outcome FROM c)
SELECT 'LD-20240101-' || substr(sha256(call_id::VARCHAR), 1, 16) AS lead_id, call_id, outcome, CASE outcome WHEN 'escalated' THEN 'Handed to a person during the call. No callback needed.'
  WHEN 'incomplete' THEN 'Call back to complete qualification. Still needed: ' || CASE WHEN m = '' THEN 'the remaining questions' ELSE m END || '.'
  WHEN 'declined' THEN 'Do not quote. Send the declined-applicant letter and offer the alternatives.'
  ELSE CASE WHEN r = '' THEN 'Quote from the rate table and call back within one working day.' ELSE 'Quote from the rate table, then arrange: ' || r || '.' END END AS next_action FROM a
""")
def lead_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls, so that every outcome occurs."""
    priority, none = F.col("o_orderpriority"), F.array().cast("array<string>")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("conv_id"), F.when(priority == "1-URGENT", F.lit("underwriting")).otherwise(F.lit("")).alias("escalated_to"), (F.col("o_orderstatus") != "P").alias("decided"), (F.col("o_totalprice") > 100000).alias("eligible"),
        F.when(priority == "5-LOW", none).otherwise(F.array(F.lit("age"), F.lower("o_orderstatus"))).alias("missing"), F.when(priority == "2-HIGH", F.array(F.lit("medical_exam"), F.lit("proof_of_income"))).otherwise(none).alias("requirements"))
    return leads.create_leads(rows, "20240101").select("lead_id", F.col("conv_id").alias("call_id"), "outcome", "next_action")


@query("""
WITH u AS (SELECT user_id, count(*) AS turns FROM events GROUP BY user_id),
l AS (SELECT user_id, event_type, max_by(round(value)::BIGINT, event_id) AS v FROM events GROUP BY ALL),
s AS (SELECT user_id, string_agg(event_type || '=' || v, ',' ORDER BY event_type) AS collected, list(event_type) AS filled FROM l GROUP BY user_id)
SELECT user_id AS call_id, turns, collected, list_filter(['view', 'signup', 'click', 'purchase', 'refund'], lambda x: x <> 'click' AND NOT list_contains(filled, x))[1] AS still_needed FROM u JOIN s USING (user_id)
""")
def call_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers to slots; what is needed next, when clicks are given up on."""
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), F.lit("").alias("caller"), F.col("event_type").alias("slot"), F.round("value").cast("long").cast("string").alias("value"))
    out = leads.call_summaries(rows.select("conv_id", "turn", "caller"), rows.select("conv_id", "turn", "slot", "value"))
    required = F.array(*[F.lit(s) for s in ("view", "signup", "click", "purchase", "refund")])
    pairs = F.array_join(F.transform(F.map_entries("collected"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.select(F.col("conv_id").alias("call_id"), "turns", pairs.alias("collected"), calls.next_slot(required, F.map_keys("collected"), F.array(F.lit("click"))).alias("still_needed"))


@query("""
WITH r AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'purchase' THEN value * 100000 END AS spoken, CASE WHEN event_type <> 'purchase' THEN (value * 1000)::BIGINT END AS n, epoch_us(ts) / 1000000.0 AS t FROM events),
w AS (SELECT *, sum((spoken IS NOT NULL)::INT) OVER o AS reply FROM r WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, max(t + (spoken / 1000 + 0.4)) OVER p AS until, max(floor((spoken / 1000 + 0.4) * 16000 * 2)) OVER p AS budget,
             coalesce(sum(n) OVER (PARTITION BY user_id, reply ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS heard FROM w WINDOW p AS (PARTITION BY user_id, reply))
SELECT event_id, coalesce(n IS NOT NULL AND heard < budget AND t < until, false) AS echo FROM b
""")
def echo_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user is a call, a purchase a reply, another event a chunk of audio."""
    reply = F.col("event_type") == "purchase"
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("call_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1000000.0).alias("at"), F.col("event_id").alias("seq"),
        F.when(reply, F.col("value") * 100000).alias("spoken_ms"), F.when(~reply, F.round(F.col("value") * 1000).cast("long")).alias("n_bytes"))
    return calls.echoes(rows).select(F.col("seq").alias("event_id"), "echo")


TRANSIENT_SQL = " OR ".join(f"contains(lower(text), '{p}')" for p in calls.TRANSIENT)


@query(f"SELECT doc_id, {TRANSIENT_SQL} AS transient, round(octet_length(encode(text)) / 32000.0 * 1000, 6) AS pcm_ms, round(octet_length(encode(text)) / 6000.0 * 1000, 6) AS mp3_ms FROM documents")
def errors_and_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("text")
    return table(spark, sf_dir, "documents").select("doc_id", calls.is_transient(F.col("text")).alias("transient"), F.round(calls.duration_ms(n), 6).alias("pcm_ms"), F.round(calls.mp3_ms(n), 6).alias("mp3_ms"))
