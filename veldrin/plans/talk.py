"""Queries of conversations as wholes, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import turns
from ..sources.packs import Pack, Slot
from .catalogue import query, table

PACK = Pack(
    "sample", "u1",
    slots=(Slot("age", "And how old are you?", True, expects=("how old",)), Slot("residency", "Do you live here now?", True, expects=("living in",)), Slot("currently_admitted", "Are you in hospital at the moment?", True),
           Slot("plan_interest", "Which plan level would you like to have?", maps_to="plan")),
    detect={"ESC-REQUEST": ("real person",)}, variants={"standard": {}, "sunda": {"markers": ["punten"]}, "jawa": {"markers": ["nggih"]}})
CALLER = [
    "punten, I am 35", "do you cover physiotherapy", "yes I am", "actually I meant 53", "nggih I earn sixty thousand a month", "is physiotherapy covered then", "my name is Ana Cruz", "the Plus or Max one", "no",
    "call me on 0917 555 0101", "what is the waiting period", "I want a real person", "how long is the waiting time"]
AGENT = ["I do not have that detail.", "Are you living in the city?", "So, are you in hospital at the moment", "Thanks, how old?", "ok", "Which plan level would you like to have?"]
RULES = [
    {"unit": "u1", "kind": "hard", "ord": 0, "id": "A", "field": "age", "test": "18 <= age <= 50", "on_fail": "decline", "reason": "Too old."},
    {"unit": "u1", "kind": "soft", "ord": 0, "id": "B", "field": "plan", "test": "plan == Max", "on_pass": "require_medical_exam", "reason": "Max."}]


def _listed(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def talk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns of their user's conversation, so that every reading occurs; their texts follow from their ids."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), _listed(CALLER, (F.col("event_id") * 7 + F.col("user_id")) % len(CALLER)).alias("caller"),
        _listed(AGENT, (F.col("event_id") * 5 + F.length("event_type")) % len(AGENT)).alias("agent"), (F.col("event_id") % 3 == 0).alias("grounded"), (F.col("event_id") % 2 == 0).alias("sought"))


#: The readings are stated by hand, the fold is a recursion over turns.
FOLD_SQL = """
WITH RECURSIVE caller(k, q, stems, said_age, yes, income, plan, name, number, correcting, region, trig) AS (VALUES
  (0, 'punten, I am 35', ['punten'], '35', NULL::BOOLEAN, NULL, NULL, NULL, NULL, false, 'sunda', ''),
  (1, 'do you cover physiotherapy', ['cover', 'physiotherapy'], NULL, NULL, NULL, NULL, NULL, NULL, false, 'standard', ''),
  (2, 'yes I am', ['yes'], NULL, true, NULL, NULL, NULL, NULL, false, 'standard', ''),
  (3, 'actually I meant 53', ['actually', 'meant'], '53', NULL, NULL, NULL, NULL, NULL, true, 'standard', ''),
  (4, 'nggih I earn sixty thousand a month', ['nggih', 'earn', 'sixty', 'thousand', 'month'], '60', NULL, '60000', NULL, NULL, NULL, false, 'jawa', ''),
  (5, 'is physiotherapy covered then', ['physiotherapy', 'cover'], NULL, NULL, NULL, NULL, NULL, NULL, false, 'standard', ''),
  (6, 'my name is Ana Cruz', ['name', 'ana', 'cruz'], NULL, NULL, NULL, NULL, 'Ana Cruz', NULL, false, 'standard', ''),
  (7, 'the Plus or Max one', ['plus', 'max', 'one'], NULL, NULL, NULL, 'Max', NULL, NULL, false, 'standard', ''),
  (8, 'no', []::VARCHAR[], NULL, false, NULL, NULL, NULL, NULL, false, 'standard', ''),
  (9, 'call me on 0917 555 0101', ['call'], NULL, NULL, NULL, NULL, NULL, '0917 555 0101', false, 'standard', ''),
  (10, 'what is the waiting period', ['wait', 'period'], NULL, NULL, NULL, NULL, NULL, NULL, false, 'standard', ''),
  (11, 'I want a real person', ['want', 'real', 'person'], NULL, NULL, NULL, NULL, NULL, NULL, false, 'standard', 'ESC-REQUEST'),
  (12, 'how long is the waiting time', ['long', 'wait', 'time'], NULL, NULL, NULL, NULL, NULL, NULL, false, 'standard', '')),
agent(m, asks) AS (VALUES (0, ''), (1, 'residency'), (2, 'currently_admitted'), (3, 'age'), (4, ''), (5, 'plan_interest')),
t AS (
  SELECT user_id AS conv_id, event_id AS turn, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, caller.*, asks, m = 0 AND event_id % 3 <> 0 AND event_id % 2 = 0 AS refused
  FROM events JOIN caller ON k = (event_id * 7 + user_id) % 13 JOIN agent ON m = (event_id * 5 + length(event_type)) % 6),
s AS (
  SELECT DISTINCT user_id AS conv_id, 0::BIGINT AS n, 0::BIGINT AS turn, NULL::VARCHAR AS age, NULL::VARCHAR AS residency, NULL::VARCHAR AS admitted, NULL::VARCHAR AS income, NULL::VARCHAR AS plan, NULL::VARCHAR AS name,
         NULL::VARCHAR AS number, 'standard' AS region, '' AS last, []::VARCHAR[] AS asked, []::VARCHAR[] AS given_up, []::VARCHAR[][] AS open_stems, []::VARCHAR[] AS unanswered, []::VARCHAR[] AS corrections, '' AS trig,
         false AS was_assessed, NULL::VARCHAR AS seen_age, NULL::VARCHAR AS seen_plan
  FROM events
  UNION ALL
  SELECT conv_id, n, turn, age, residency, admitted, income, plan, name, number, region, asks,
         CASE WHEN trig = '' AND asks <> '' THEN list_append(asked, asks) ELSE asked END,
         CASE WHEN trig = '' AND asks <> '' AND len(list_filter(asked, lambda x: x = asks)) + 1 >= 2 AND NOT list_contains(given_up, asks)
                   AND CASE asks WHEN 'age' THEN age WHEN 'residency' THEN residency WHEN 'currently_admitted' THEN admitted ELSE plan END IS NULL THEN list_append(given_up, asks) ELSE given_up END,
         CASE WHEN trig = '' AND refused THEN list_append(open_stems, stems) ELSE open_stems END, CASE WHEN trig = '' AND refused THEN list_append(unanswered, q) ELSE unanswered END,
         corrections, trig, was_assessed OR trig = '', CASE WHEN trig = '' THEN age ELSE seen_age END, CASE WHEN trig = '' THEN plan ELSE seen_plan END
  FROM (
    SELECT s.conv_id, t.n, t.turn, t.asks, t.refused, t.stems, t.q, s.asked, s.given_up, s.open_stems, s.unanswered, s.was_assessed, s.seen_age, s.seen_plan,
           CASE WHEN (s.age IS NULL OR t.correcting) THEN coalesce(t.said_age, s.age) ELSE s.age END AS age,
           CASE WHEN s.age <> t.said_age AND t.correcting THEN list_append(s.corrections, 'age: ' || s.age || ' -> ' || t.said_age) ELSE s.corrections END AS corrections,
           CASE WHEN s.residency IS NULL AND s.last = 'residency' AND t.yes IS NOT NULL THEN 'PH' ELSE s.residency END AS residency,
           CASE WHEN s.admitted IS NULL AND s.last = 'currently_admitted' THEN t.yes::VARCHAR ELSE s.admitted END AS admitted,
           coalesce(s.income, t.income) AS income, coalesce(s.plan, t.plan) AS plan, coalesce(s.name, t.name) AS name, coalesce(s.number, t.number) AS number,
           CASE WHEN t.region = 'standard' THEN s.region ELSE t.region END AS region,
           CASE WHEN t.trig <> '' THEN t.trig
                WHEN len(list_filter(s.open_stems, lambda u: len(u) > 0 AND len(t.stems) > 0 AND 2 * len(list_intersect(u, t.stems)) >= least(len(u), len(t.stems)))) > 0 THEN 'ESC-UNKNOWN-REPEAT' ELSE '' END AS trig
    FROM s JOIN t ON t.conv_id = s.conv_id AND t.n = s.n + 1))
SELECT conv_id, turn, trig AS "trigger", region, concat_ws(',', 'age=' || age, 'contact_number=' || number, 'currently_admitted=' || admitted, 'full_name=' || name, 'monthly_income=' || income, 'plan_interest=' || plan, 'residency=' || residency) AS slots,
       array_to_string(corrections, ';') AS corrections, len(asked)::BIGINT AS asked, array_to_string(given_up, ',') AS given_up, array_to_string(unanswered, ';') AS unanswered,
       list_filter([CASE WHEN age IS NULL THEN 'age' END, CASE WHEN residency IS NULL THEN 'residency' END, CASE WHEN admitted IS NULL THEN 'currently_admitted' END], lambda x: x IS NOT NULL AND NOT list_contains(given_up, x))[1] AS next_slot,
       CASE WHEN was_assessed THEN seen_age IS NULL OR seen_age::INT <= 50 END AS eligible, CASE WHEN was_assessed THEN seen_age IS NOT NULL END AS decided,
       CASE WHEN was_assessed THEN CASE WHEN seen_plan = 'Max' THEN 'require_medical_exam' ELSE '' END END AS requirements
FROM s WHERE n > 0
"""


@query(FOLD_SQL)
def turn_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns.assessed(turns.fold(talk(spark, sf_dir), PACK), PACK, RULES)
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("slots")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return rows.select(
        "conv_id", "turn", "trigger", "region", pairs.alias("slots"), F.array_join("corrections", ";").alias("corrections"), F.aggregate(F.map_values("asked"), F.lit(0).cast("long"), lambda a, x: a + x).alias("asked"),
        F.array_join("given_up", ",").alias("given_up"), F.array_join("unanswered", ";").alias("unanswered"), "next_slot", "eligible", "decided", F.array_join("requirements", ",").alias("requirements"))
