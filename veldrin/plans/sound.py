"""Queries of call audio, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import frames, recognition
from .catalogue import query, table

#: The machine as a recursion over frames; loudness from the frames that an utterance keeps.
UTTERANCES_SQL = """
WITH RECURSIVE e AS (SELECT user_id AS call_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS place FROM events),
f AS MATERIALIZED (SELECT call_id, place * 12 + j AS n, event_id * 7919 % 5 < 2 AS voiced, 60 + event_id % 300 + j AS rms FROM e, range(12) r(j)),
s AS (
  SELECT DISTINCT user_id AS call_id, -1::BIGINT AS n, false AS sp, 0 AS run, 0 AS sil, 0 AS voi, 0::BIGINT AS start, 0 AS since, NULL::VARCHAR AS ended, 0::BIGINT AS a, 0::BIGINT AS len, 0 AS said FROM events
  UNION ALL
  SELECT call_id, n, sp AND ended IS NULL, CASE WHEN ended IS NULL THEN run ELSE 0 END, sil, voi, start, CASE WHEN ended IS NULL THEN since ELSE 0 END, ended, start, len, voi FROM (
    SELECT *, CASE WHEN NOT was THEN NULL WHEN sil >= 35 THEN 'silence' WHEN len >= 1250 THEN 'length' END AS ended FROM (
      SELECT *, n - start + 1 AS len FROM (
        SELECT s.call_id, f.n, s.sp AS was, s.sp OR (f.voiced AND s.run + 1 >= 3) AS sp, CASE WHEN f.voiced THEN s.run + 1 ELSE 0 END AS run, CASE WHEN NOT s.sp OR f.voiced THEN 0 ELSE s.sil + 1 END AS sil,
               CASE WHEN NOT s.sp THEN s.run + 1 ELSE s.voi + f.voiced::INT END AS voi, CASE WHEN s.sp THEN s.start ELSE f.n - least(4, s.since + 1) + 1 END AS start, s.since + 1 AS since
        FROM s JOIN f ON f.call_id = s.call_id AND f.n = s.n + 1)))),
done AS (
  SELECT call_id, ended, a, len, said FROM s WHERE ended IS NOT NULL
  UNION ALL
  SELECT call_id, 'close', start, n - start + 1, voi FROM s WHERE sp QUALIFY n = max(n) OVER (PARTITION BY call_id) AND n = (SELECT max(f.n) FROM f WHERE f.call_id = s.call_id)),
kept AS (SELECT *, CASE WHEN ended = 'silence' AND len - 32 > 1 THEN len - 32 ELSE len END AS k FROM done),
loud AS (SELECT kept.call_id, kept.a, any_value(ended) AS ended, any_value(len) AS len, any_value(said) AS said, any_value(k) AS k, sqrt(avg(rms * rms)) AS loudness FROM kept JOIN f ON f.call_id = kept.call_id AND f.n BETWEEN kept.a AND kept.a + k - 1 GROUP BY ALL)
SELECT call_id, a AS first_frame, a + k - 1 AS last_frame, k * 20.0::DOUBLE AS duration_ms, ended AS ended_by, round(loudness, 4) AS rms,
       CASE WHEN said < 5 OR said::DOUBLE / len < 0.2 THEN 'too little voice' WHEN k * 20 < 250 THEN 'too short' WHEN loudness < 100 THEN 'too quiet' ELSE '' END AS reason
FROM loud
"""


@query(UTTERANCES_SQL)
def call_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as twelve frames each of their user's call, voiced or not as their ids say."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), "event_id", place.alias("place")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(11))))
    made = rows.select("call_id", (F.col("place") * 12 + F.col("j")).alias("frame_no"), (F.col("event_id") * 7919 % 5 < 2).alias("voiced"), (60 + F.col("event_id") % 300 + F.col("j")).alias("rms"))
    return frames.utterances(made).withColumn("rms", F.round("rms", 4))

SAID = ["pay sixty thousand by friday", "punten abdi mayar", "dua juta tiga ratus ribu", "my policy has lapsed", "bayad po ang premium due date", "call 4 7 please"]
HEARD = ["pay 60000 by friday", "punten abdi bayar", "", "Rp2.300.000", "my polcy has lapse", "the premium due date", "call 4 please"]
PAIRS = [(0, 0), (0, 2), (1, 1), (2, 3), (3, 4), (4, 5), (5, 6)]

#: What each pair comes to is stated by hand.
SCORES_SQL = """
WITH pair(k, said, accuracy, lost, failures) AS (VALUES
  (0, 'pay sixty thousand by friday', 1.0::DOUBLE, '', ''),
  (1, 'pay sixty thousand by friday', 0.0::DOUBLE, 'pay,60000,by,friday', 'pay=whole utterance lost;60000=whole utterance lost;by=whole utterance lost;friday=whole utterance lost'),
  (2, 'punten abdi mayar', 2 / 3::DOUBLE, 'mayar', 'mayar=regional word, heard as bayar'),
  (3, 'dua juta tiga ratus ribu', 1.0::DOUBLE, '', ''),
  (4, 'my policy has lapsed', 0.5::DOUBLE, 'policy,lapsed', 'policy=heard as polcy;lapsed=heard as lapse'),
  (5, 'bayad po ang premium due date', 0.5::DOUBLE, 'bayad,po,ang', 'bayad=one language dropped;po=one language dropped;ang=one language dropped'),
  (6, 'call 4 7 please', 0.75::DOUBLE, '7', '7=number')),
rows AS (SELECT event_type AS provider, value AS ms, pair.* FROM events JOIN pair ON k = event_id % 7)
SELECT provider, said, lost, failures, count(*) AS n, round(avg(accuracy), 6) AS accuracy, round(median(ms), 6) AS median_ms FROM rows GROUP BY ALL
"""


@query(SCORES_SQL)
def recognition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of recognisers: what was said and heard follows from their ids, the provider is their type."""
    at = F.element_at(F.array(*[F.struct(F.lit(SAID[s]).alias("said"), F.lit(HEARD[h]).alias("heard"), F.lit("sundanese" if s == 1 else "").alias("accent")) for s, h in PAIRS]), (F.col("event_id") % len(PAIRS) + 1).cast("int"))
    rows = recognition.scored(table(spark, sf_dir, "events").select(F.col("event_type").alias("provider"), F.col("value").alias("ms"), at.alias("p")).select("provider", "ms", "p.*"))
    told = F.array_join(F.transform("failures", lambda f: F.concat(f["word"], F.lit("="), f["failure"])), ";")
    by = rows.groupBy("provider", "said", F.array_join("missed", ",").alias("lost"), told.alias("failures"))
    return by.agg(F.count("*").alias("n"), F.round(F.avg("accuracy"), 6).alias("accuracy"), F.round(F.median("ms"), 6).alias("median_ms"))
