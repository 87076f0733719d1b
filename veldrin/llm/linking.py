"""From buckets of candidates to components, without a pair for every two members of a bucket.

Rows (key, id) say that ids under one key may be alike; a function confirms pairs on the full data. Components of the
confirmed links are wanted, and every pair that shares a key must be confirmed unless its ends are already together:

1. Greedy rounds: each id is tried with PARTNERS others, drawn by a hash from the leaders of its buckets that aren't
   in its component; a bucket's leader is drawn by a hash too, anew in each round. Groups of near copies, however
   large, mostly end here, at a few pairs an id and round.
2. An exact round: a bucket whose members lie in several components is open. Each member outside the bucket's largest
   component meets all members of other components in a join whose condition holds their sketches against each other,
   so pairs that a sketch proves to be no links are never rows. A pair is taken under the smallest key that both ends
   have, once. Then no pair with a common key is untried, so the links missed are those that no key shows.

Sketches also spare pairs of the greedy rounds the full data. Leaders and counts are partial aggregates joined back, so
a hot bucket is spread over tasks. Everything between rounds is a written table; the driver sees counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, discard, stage

PARTNERS = 4
Possible = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def shared_buckets(rows: DataFrame) -> DataFrame:
    """The rows (key, id), each once, whose key has several ids."""
    several = rows.groupBy("key").count().where("count > 1").select(F.col("key").alias("_k"))
    return rows.join(several, F.col("key") == F.col("_k"), "left_semi")


def link(members: DataFrame, confirm: Callable[[DataFrame], DataFrame], sketches: DataFrame, possible: Possible, greedy: int = 2) -> DataFrame | None:
    """(id, component) of the ids with confirmed links, by all links between ids that share a key. None if there are none.

    members: a staged table of (key, id) of shared buckets. confirm takes (a, b) rows and keeps those that are links.
    sketches: a staged table of id, its members' `keys` and further columns. possible(x, y), given functions from such a
    column's name to it on either side, must hold for every link.
    """
    comps: DataFrame | None = None
    words = [c for c in sketches.columns if c != "id"]
    data = [c for c in words if c != "keys"]

    def add(pairs: DataFrame) -> bool:
        nonlocal comps
        new = stage(confirm(pairs), "links")
        if new.isEmpty():
            return False
        # links found before are in the components already: each id's to its component stands for them
        edges = new.select("a", "b") if comps is None else new.select("a", "b").union(comps.select(F.col("id").alias("a"), F.col("component").alias("b")))
        old, found = comps, connected_components(edges)
        comps = stage(found, "components")
        for t in (found, old, new):
            discard(t)
        return True

    def labelled() -> DataFrame:
        if comps is None:
            return members.withColumn("comp", F.col("id"))
        at = comps.select(F.col("id").alias("_id"), "component")
        return stage(members.join(at, F.col("id") == F.col("_id"), "left").select("key", "id", F.coalesce("component", "id").alias("comp")), "members")

    def side(name: str) -> DataFrame:
        return sketches.select(F.col("id").alias(f"_{name}"), *[F.col(c).alias(f"_{name}_{c}") for c in data])

    for r in range(greedy):
        rows = labelled()
        lead = rows.groupBy("key").agg(F.min_by(F.struct("id", "comp"), F.xxhash64("id", F.lit(r))).alias("l"), F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo <> _hi")
        apart = rows.join(lead.select(F.col("key").alias("_k"), F.col("l.id").alias("a"), F.col("l.comp").alias("_c")), F.col("key") == F.col("_k")).where("comp <> _c")
        drawn = F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64("a", "id", F.lit(r)).alias("h"), "a"))), 1, PARTNERS)  # a set of the id's own keys at most
        tried = apart.groupBy(F.col("id").alias("b")).agg(drawn.alias("d")).select("b", F.explode("d.a").alias("a"))
        tried = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        tried = tried.join(side("x"), F.col("a") == F.col("_x")).join(side("y"), F.col("b") == F.col("_y"))
        found = add(tried.where(possible(lambda c: F.col(f"_x_{c}"), lambda c: F.col(f"_y_{c}"))).select("a", "b"))
        discard(rows)
        if not found:
            break
    rows = labelled()
    by_comp = rows.groupBy("key", "comp").agg(F.count("*").alias("n"))
    largest = by_comp.groupBy("key").agg(F.max(F.struct("n", "comp")).alias("_top"), F.count("*").alias("_n")).where("_n > 1").select(F.col("key").alias("_k"), F.col("_top.comp").alias("_most"))
    still = stage(rows.join(largest, F.col("key") == F.col("_k")).select("key", "id", "comp", (F.col("comp") == F.col("_most")).alias("most")), "members")
    if not still.isEmpty():
        one = still.join(sketches.withColumnRenamed("id", "_s"), F.col("id") == F.col("_s")).drop("_s")
        x = one.where("not most").select(F.col("key").alias("_k"), F.col("id").alias("x"), F.col("comp").alias("_c"), *[F.col(c).alias(f"_x_{c}") for c in words])
        meet = (F.col("key") == F.col("_k")) & (F.col("comp") != F.col("_c")) & (F.col("most") | (F.col("id") > F.col("x")))
        first = F.array_min(F.array_intersect("keys", "_x_keys")) == F.col("key")
        pairs = one.join(x, meet & possible(F.col, lambda c: F.col(f"_x_{c}")) & first)
        add(pairs.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")))
    for t in (still, rows):
        discard(t)
    return comps
