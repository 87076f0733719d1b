"""Batched hybrid retrieval: BM25 and cosine ranks, reciprocal rank fusion, authority weights, the confidence gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab


def table_description(title: Column, content: Column) -> Column:
    """A sentence on what a table is about; empty for anything else."""
    lines = F.filter(F.split(content, "\n"), lambda s: F.contains(s, F.lit("|")))

    def cells(line: Column) -> Column:
        return F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")

    columns = cells(F.try_element_at(lines, F.lit(1)))
    rows = F.filter(F.transform(F.slice(lines, 2, 5), lambda s: F.trim(F.element_at(F.split(s, r"\|"), 1))), lambda c: c != "")
    said = F.concat(title, F.lit(". A table of "), F.array_join(columns, ", "), F.lit("."), F.when(F.size(rows) > 0, F.concat(F.lit(" Covering "), F.array_join(rows, ", "), F.lit("."))).otherwise(F.lit("")))
    return F.when((F.size(lines) >= 2) & (F.size(columns) > 0), said).otherwise(F.lit(""))


def indexable_text(title: Column, content: Column, variants: Column) -> Column:
    described = table_description(title, content)
    return F.concat_ws("\n", title, F.when(described != "", described), content, F.when(F.size(variants) > 0, F.array_join(variants, " ")))


def bm25(docs: DataFrame, queries: DataFrame, id_col: str, text: str, query_id: str, query: str) -> DataFrame:
    """(query_id, id, score) of all documents that share a term with a query: Okapi weights, with a term's negative idf
    replaced by a quarter of the mean idf. A term that a query repeats counts as often.

    Document frequencies are partial counts over each text's distinct terms; term frequencies are only made for terms
    that some query has, before anything is shuffled by document.
    """
    words = docs.select(F.col(id_col).alias("id"), X.tokens(F.col(text)).alias("t"))
    stats = words.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    df = words.select(F.explode(F.array_distinct("t")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(stats)).withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(X.tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    idf = raw.join(asked.select("term").distinct(), "term", "left_semi").crossJoin(F.broadcast(mean)).select(
        "term", "avgdl", F.when(F.col("raw") < 0, vocab.BM25_EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
    tf = words.select("id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(asked.select("term").distinct(), "term", "left_semi").groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    k1, b = vocab.BM25_K1, vocab.BM25_B
    weight = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighed = tf.join(idf, "term").select("id", "term", weight.alias("w"))
    return weighed.join(asked, "term").groupBy("query_id", "id").agg(F.sum(F.col("qtf") * F.col("w")).alias("score"))


def ranked(scores: DataFrame, k: int | None = None, positive: bool = False, by: str = "score") -> DataFrame:
    """scores with a 0-based rank within each query, by score and then id; only the first k, which tasks cut before
    they shuffle."""
    rows = scores.where(F.col(by) > 0) if positive else scores
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "id")))
    return (rows.where(F.col("rank") <= k) if k else rows).withColumn("rank", F.col("rank") - 1)


def cosine(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, query_id: str, query_vector: str) -> DataFrame:
    """(query_id, id, score): every query against every vector, in double precision. Queries are a stated set: they are
    sent to the vectors' tasks in blocks, as arrays, and each vector is read once a block."""
    rows = vectors.select(F.col(id_col).alias("id"), X.unit_vector(F.col(vector)).alias("v"))
    asked = queries.select(F.col(query_id).alias("query_id"), X.unit_vector(F.col(query_vector)).alias("q"))
    return rows.join(asked, F.size("v") == F.size("q")).select("query_id", "id", X.dot(F.col("v"), F.col("q")).alias("score"))


def fuse(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    """(query_id, id, base, similarity, keyword_rank, vector_rank): reciprocal ranks added over both rankings."""
    kw = keyword.select("query_id", "id", (1.0 / (vocab.RRF_K + F.col("rank") + 1)).alias("r"), F.lit(None).cast("double").alias("sim"), F.col("rank").alias("kr"), F.lit(None).cast("int").alias("vr"))
    vec = vector.select("query_id", "id", (1.0 / (vocab.RRF_K + F.col("rank") + 1)).alias("r"), F.col("score").alias("sim"), F.lit(None).cast("int").alias("kr"), F.col("rank").alias("vr"))
    return kw.unionByName(vec).groupBy("query_id", "id").agg(F.sum("r").alias("base"), F.coalesce(F.max("sim"), F.lit(0.0)).alias("similarity"), F.max("kr").alias("keyword_rank"), F.max("vr").alias("vector_rank"))


def weight(authority: Column, flags: Column) -> Column:
    out = F.lit(vocab.UNKNOWN_WEIGHT)
    for name, w in vocab.AUTHORITY_WEIGHT.items():
        out = F.when(authority == name, F.lit(w)).otherwise(out)
    return out * F.when(F.exists(flags, lambda f: F.startswith(f, F.lit("contradicts_"))), F.lit(vocab.CONTRADICTION_PENALTY)).otherwise(F.lit(1.0))


def headroom(similarity: Column) -> Column:
    return vocab.SIMILARITY_WEIGHT * F.greatest(F.lit(0.0), similarity - vocab.SIMILARITY_FLOOR) / (1 - vocab.SIMILARITY_FLOOR)


def results(fused: DataFrame, records: DataFrame, queries: DataFrame, k: int = vocab.TOP_K) -> DataFrame:
    """The k best records of each query. The unit filter (query_id, business_unit; null: all) comes after ranking, as
    ranks are those among all records; records of the group unit are for everyone; unknown ids drop out."""
    rows = fused.join(records, F.col("id") == F.col("record_id")).join(queries.select("query_id", F.col("business_unit").alias("_unit")), "query_id")
    rows = rows.where(F.col("_unit").isNull() | (F.col("business_unit") == F.col("_unit")) | (F.col("business_unit") == "group")).drop("_unit")
    rows = rows.withColumn("score", (F.col("base") + headroom(F.col("similarity"))) * weight(F.col("authority"), F.col("quality_flags")))
    return ranked(rows, k)


def outcomes(top: DataFrame, queries: DataFrame, floor: float = vocab.MIN_SCORE) -> DataFrame:
    """(query_id, confident, best_similarity, reason, results) of each query: whether the best similarity among its
    results reaches the floor, and why not."""
    found = top.groupBy("query_id").agg(F.max("similarity").alias("best"), F.sort_array(F.collect_list(F.struct("rank", "record_id", "score"))).alias("results"))
    rows = queries.select("query_id").join(found, "query_id", "left")
    best = F.coalesce("best", F.lit(0.0))
    none = F.col("results").isNull()
    reason = F.when(none, F.lit("nothing matched")).when(best < floor, F.format_string("best match scored %.2f, below the floor of %.2f", best, F.lit(floor))).otherwise(F.lit(""))
    return rows.select("query_id", (~none & (best >= floor)).alias("confident"), best.alias("best_similarity"), reason.alias("reason"), "results")


def verdicts(top: DataFrame, outcome: DataFrame, expected: DataFrame) -> DataFrame:
    """correct, partially correct or incorrect for each (query_id, expect, decline): the expected reference or title first among
    the results is correct and further down partially correct; a query to decline is correct if it isn't confident."""
    hit = F.contains(F.lower("source_ref"), F.lower("expect")) | F.contains(F.lower("title"), F.lower("expect"))
    place = top.join(expected.select("query_id", "expect"), "query_id").where(hit).groupBy("query_id").agg(F.min("rank").alias("position"))
    rows = expected.join(outcome.select("query_id", "confident", "best_similarity"), "query_id", "left").join(place, "query_id", "left")
    confident = F.coalesce("confident", F.lit(False))
    verdict = F.when(F.col("decline"), F.when(confident, F.lit("incorrect")).otherwise(F.lit("correct"))).when(F.col("position").isNull() | ~confident, F.lit("incorrect")).when(F.col("position") == 0, F.lit("correct")).otherwise(F.lit("partially correct"))
    return rows.withColumn("verdict", verdict)


def check_signature(stored: str, wanted: str) -> None:
    """Raise if vectors were made by another embedder than the one that is to be searched with; none stored is fine."""
    if stored and stored != wanted:
        raise ValueError(f"vectors were made by {stored!r}, not {wanted!r}: build the index anew")
