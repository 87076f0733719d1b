"""Latency and quality measures. The percentile variants differ on purpose and keep their names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _at(values: DataFrame, key: list[str], value: str, places: dict[str, Column]) -> DataFrame:
    """For each key, the elements at the 0-based places (columns over n) of its sorted values. Values are counted
    first, so what is ranked are distinct values, and no task gathers a key's rows in an array."""
    hist = values.groupBy(*key, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*key)
    upto = hist.withColumn("k", F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("c").over(w))
    return upto.groupBy(*key).agg(F.max("n").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"), *[F.min(F.when(F.col("k") > p, F.col("v"))).alias(name) for name, p in places.items()])


def stage_latency(spans: DataFrame, key: str = "stage", value: str = "milliseconds") -> DataFrame:
    """count, p50 (interpolated median), p95 (the element at int(0.95 n); with under 20 values the largest), min, max."""
    n = F.col("n")
    p95 = F.when(n >= 20, F.least(F.floor(n * F.lit("0.95").cast("decimal(3,2)")), n - 1)).otherwise(n - 1)
    out = _at(spans, [key], value, {"p95": p95, "lo": F.floor((n - 1) / 2), "hi": F.floor(n / 2)})
    return out.select(key, F.col("n").alias("count"), ((F.col("lo") + F.col("hi")) / 2).alias("p50"), "p95", "min", "max")


def live_report(latencies: DataFrame, key: str, value: str) -> DataFrame:
    """p50 the element at n // 2, p95 the one at min(n - 1, int(0.95 n))."""
    n = F.col("n")
    return _at(latencies, [key], value, {"p50": F.floor(n / 2), "p95": F.least(n - 1, F.floor(n * F.lit("0.95").cast("decimal(3,2)")))}).select(key, F.col("n").alias("count"), "p50", "p95")


def nearest_rank(values: DataFrame, key: str, value: str, percent: int) -> DataFrame:
    """The element at round(p n / 100) - 1, at least 0, halves to even."""
    n = F.col("n")
    place = F.greatest(F.lit(0), F.least(n - 1, F.bround(n * percent / F.lit(100)).cast("long") - 1))
    return _at(values, [key], value, {"p": place}).select(key, F.col("n").alias("count"), F.col("p").alias(f"p{percent}"))


def end_to_end(spans: DataFrame) -> DataFrame:
    """Milliseconds from a trace's first start to its last end; spans have trace, started_at (seconds), milliseconds."""
    ends = F.max(F.col("started_at") + F.col("milliseconds") / 1000) - F.min("started_at")
    return spans.where("trace is not null and trace <> ''").groupBy("trace").agg((ends * 1000).alias("total_ms"), F.count("*").alias("spans"))


def stopwatch(marks: DataFrame) -> DataFrame:
    """Spans as differences of successive marks (trace, name, at in ms since the start)."""
    order = Window.partitionBy("trace").orderBy("at", "name")
    return marks.select("trace", F.col("name").alias("stage"), (F.col("at") - F.coalesce(F.lag("at").over(order), F.lit(0.0))).alias("milliseconds"))


def kind_scores(expected: DataFrame, found: DataFrame) -> DataFrame:
    """tp, fp, fn, precision and recall by kind (0 where nothing was found or expected) of (turn, kind) rows."""
    e, f = expected.distinct().withColumn("e", F.lit(1)), found.distinct().withColumn("f", F.lit(1))
    both = e.join(f, ["turn", "kind"], "full_outer")
    counts = both.groupBy("kind").agg(F.count(F.when(F.col("e").isNotNull() & F.col("f").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("e").isNull(), 1)).alias("fp"), F.count(F.when(F.col("f").isNull(), 1)).alias("fn"))
    return with_rates(counts)


def with_rates(counts: DataFrame) -> DataFrame:
    def rate(other: str) -> Column:
        return F.when(F.col("tp") + F.col(other) > 0, F.col("tp") / (F.col("tp") + F.col(other))).otherwise(F.lit(0.0))

    return counts.withColumn("precision", rate("fp")).withColumn("recall", rate("fn"))


def separation(scores: DataFrame, similarity: str = "similarity", match: str = "is_match") -> DataFrame:
    """The weakest match less the strongest control."""
    return scores.agg((F.min(F.when(F.col(match), F.col(similarity))) - F.max(F.when(~F.col(match), F.col(similarity)))).alias("separation"))


def stripped_share(pages: DataFrame, raw: str = "raw_chars", kept: str = "kept_chars") -> DataFrame:
    total = pages.agg(F.sum(raw).alias("raw"), F.sum(kept).alias("kept"))
    return total.withColumn("stripped", F.when(F.coalesce("raw", F.lit(0)) > 0, 1 - F.col("kept") / F.col("raw")).otherwise(F.lit(0.0)))


def real_time_factor(ms: Column, audio_ms: Column) -> Column:
    return F.when(audio_ms > 0, ms / audio_ms).otherwise(F.lit(0.0))


def word_accuracy(said: Column, heard: Column) -> Column:
    """The share of the words said that were heard, with multiplicity."""
    def words(t: Column) -> Column:
        return F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}']+"), F.lit(0))

    s, h = words(said), words(heard)

    def count(a: Column, x: Column) -> Column:
        return F.size(F.filter(a, lambda y: y == x))

    got = F.aggregate(F.transform(F.array_distinct(s), lambda x: F.least(count(s, x), count(h, x))), F.lit(0), lambda a, x: a + x)
    return F.when(F.size(s) > 0, got / F.size(s)).otherwise(F.lit(0.0))
