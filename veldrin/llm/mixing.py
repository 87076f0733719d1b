"""Mixing sources to target weights under a time-varying curriculum.

Each source has a weight and a schedule, a piecewise linear multiplier of that weight over training time 0 to 1. Over
the whole of training a source is to give `target` words: its share of the words asked for by weight, at most `passes`
times its own size, with what is over shared anew by weight until none is above. A source's documents form a stream in
the order of a hash of the id, gone through again for a second pass. A document at word c of its stream is trained on
at the time at which the integral of the source's schedule reaches c / target, and documents are range-sorted by it.

Defined results: null text has size 0; the null source is one source, the last; sources with no words have target 0;
an empty table gives no rows; null ids are hashed as the empty text. A document is taken in a pass if its middle lies within the target, so a source's words
miss its target by half a document at most. Rows that repeat are documents of their own. Extra columns pass through
whatever their names, but those that bear the names of added columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cleared, packed, quoted, unpacked

ADDED = ["size", "source_size", "target", "taken", "positions"]
WEIGHTS = (3, 1, 2)
#: (time, multiplier) knots for the sources in turn: fading, steady, growing.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))
BUCKETS = 1 << 14


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def time_of(share: Column, schedule: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the normalised integral of the schedule reaches share, in closed form on each segment."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(schedule, schedule[1:], strict=False)]
    whole, before, out = sum(area), 0.0, None
    for (t0, m0), (t1, m1), part in zip(schedule, schedule[1:], area, strict=False):
        rest = F.greatest(F.lit(0.0), share * whole - before)
        slope = (m1 - m0) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(0.0), m0 * m0 + 2 * slope * rest))
        here = F.least(F.lit(t1), F.when(m0 + root > 0, t0 + 2 * rest / (m0 + root)).otherwise(t0))
        before += part
        out = here if out is None else F.when(share * whole < before - part, out).otherwise(here)
    return out


def targets(sizes: DataFrame, total_share: float = 1.5, passes: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """_key, source_size, target and place of every source, from (_key, source_size).

    The level at which each source gets weight times level words, or all its passes where that is less, follows from
    sorting sources by passes * size / weight: the first level that its source's own limit admits, which is the highest such.
    """
    place = Window.orderBy("_key")
    ranked = sizes.withColumn("place", F.row_number().over(place) - 1)
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int")).cast("double"))
    up = Window.orderBy("_limit", "_key")
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    asked = F.sum("source_size").over(Window.partitionBy()) * float(total_share)
    ranked = ranked.withColumn("_most", passes * F.col("source_size").cast("double")).withColumn("_limit", F.col("_most") / F.col("_w"))
    ranked = ranked.withColumn("_level", (asked - F.coalesce(F.sum("_most").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    ranked = ranked.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_limit"), F.col("_level"))).over(Window.partitionBy()))
    return ranked.select("_key", "source_size", "place", F.least("_most", F.coalesce(F.col("_level") * F.col("_w"), F.col("_most"))).alias("target"))


def plan_mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", total_share: float = 1.5, passes: int = 2, weights: tuple[int, ...] = WEIGHTS, schedules=SCHEDULES, size: str | None = None) -> DataFrame:
    """docs with size, source_size, target, taken and positions, the training times of each copy in order.

    Sums are taken per source and bucket of the hash first, so the running sum of a source, however large, is a short
    one over its buckets and then one within each bucket; no task gathers a source. Targets and starts read the sums
    from one exchange, so nothing is written on the way.
    """
    docs = cleared(docs, ADDED if size is None else [c for c in ADDED if c != size.lower()])
    hashed = F.conv(F.substring(F.md5(F.coalesce(quoted(id_col).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
    rows = packed(
        docs, (quoted(size).cast("long") if size else word_count(text)).alias("size"), hashed.alias("h"), quoted(id_col).alias("id"),
        F.concat(F.when(quoted(source).isNull(), F.lit("1")).otherwise(F.lit("0")), F.coalesce(quoted(source).cast("string"), F.lit(""))).alias("key"),
    ).withColumn("bucket", F.shiftright("h", 60 - (BUCKETS.bit_length() - 1)))
    sums = rows.groupBy("key", "bucket").agg(F.sum("size").alias("n"))
    goal = targets(sums.groupBy(F.col("key").alias("_key")).agg(F.sum("n").alias("source_size")), total_share, passes, weights)
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(goal, F.col("key") == F.col("_key")).select(
        F.col("key").alias("_k"), F.col("bucket").alias("_b"), "start", "source_size", "target", "place")
    inside = Window.partitionBy("key", "bucket").orderBy("h", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(starts, (F.col("key") == F.col("_k")) & (F.col("bucket") == F.col("_b"))).withColumn("at", F.col("start") + F.col("at"))

    def at(j: int) -> Column:
        c = F.col("at") + j * F.col("source_size")
        share = F.when(F.col("target") > 0, F.least(F.lit(1.0), c / F.col("target"))).otherwise(F.lit(0.0))
        when = None
        for i, s in enumerate(schedules):
            t = time_of(share, s)
            when = F.when(F.col("place") % len(schedules) == i, t) if when is None else when.when(F.col("place") % len(schedules) == i, t)
        return F.when(2 * c + F.col("size") <= 2 * F.col("target"), when)

    rows = rows.withColumn("positions", F.array_compact(F.array(*[at(j) for j in range(passes)])))
    keep = [c for c in docs.columns if c.lower() not in ADDED]
    return rows.select(*unpacked(keep), "size", "source_size", "target", (F.col("size") * F.size("positions")).cast("long").alias("taken"), "positions")


def by_position(rows: DataFrame, position: str, id_col: str, partitions: int | None = None) -> DataFrame:
    """rows range-sorted by a position, those without one at the end."""
    by = [F.col(position).asc_nulls_last(), quoted(id_col).asc()]
    rows = rows.repartitionByRange(partitions, *by) if partitions else rows.repartitionByRange(*by)
    return rows.sortWithinPartitions(*by)


def mix(docs: DataFrame, id_col: str = "doc_id", partitions: int | None = None, **options) -> DataFrame:
    """The training stream: a row for each time that a document is taken, with its position, range-sorted by it."""
    rows = plan_mix(cleared(docs, ["position"]), id_col, **options)
    keep = [c for c in rows.columns if c not in ADDED]
    return by_position(rows.select(*[quoted(c) for c in keep], F.explode("positions").alias("position")), "position", id_col, partitions)


def curriculum(docs: DataFrame, id_col: str = "doc_id", partitions: int | None = None, **options) -> DataFrame:
    """plan_mix with first_position and last_position, range-sorted by the first; documents that aren't taken come last."""
    rows = plan_mix(cleared(docs, ["first_position", "last_position"]), id_col, **options)
    rows = rows.withColumns({"first_position": F.array_min("positions"), "last_position": F.array_max("positions")})
    return by_position(rows, "first_position", id_col, partitions)
