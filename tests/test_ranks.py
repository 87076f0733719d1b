import random

from pyspark.sql import functions as F

from veldrin.operators import ranks


def test_ranks_are_one_to_n(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(300)]), i, "x") for i in range(1000)]
    df = spark.createDataFrame(rows, "a int, b int, `rank.x` string").repartition(7)
    got = ranks.ranked(df, F.col("a").desc_nulls_last(), "b", ranges=5).collect()
    want = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert sorted(r.rank for r in got) == list(range(1, 1001)) and [(r.a, r.b) for r in sorted(got, key=lambda r: r.rank)] == [r[:2] for r in want]
    assert got[0].asDict().keys() == {"a", "b", "rank.x", "rank"}


def test_one_key_and_none(spark):
    df = spark.createDataFrame([(1, "old")] * 50, "a int, rank string")
    assert sorted(r.rank for r in ranks.ranked(df, "a").collect()) == list(range(1, 51))
    assert ranks.ranked(df.limit(0), "a").count() == 0
