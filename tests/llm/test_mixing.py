"""Mixing against brute force: targets, words taken, training times."""

import random

import pytest

from veldrin.llm import mixing


def fill(sizes, total, weights=(3, 1, 2)):
    """Targets by the plain rule: share by weight, cap at twice the size, share the excess anew."""
    names = sorted(k for k in sizes if k is not None) + [k for k in sizes if k is None]
    w = {k: weights[i % 3] for i, k in enumerate(names)}
    capped = {}
    while True:
        free = [k for k in names if k not in capped]
        if not free:
            return capped
        level = (total - sum(capped.values())) / sum(w[k] for k in free)
        above = [k for k in free if level * w[k] > 2 * sizes[k]]
        if not above:
            return capped | {k: level * w[k] for k in free}
        capped |= {k: 2.0 * sizes[k] for k in above}


def corpus(seed, n=400):
    rng = random.Random(seed)
    names = ["src", "é", "Z", None, "a", "empty"][: rng.randrange(1, 7)]
    return [(i, None if rng.random() < 0.05 else " \x0b".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 60) if s != "empty" else 0)), s, "x")
            for i in range(n) for s in [names[int(len(names) * rng.random() ** 2)]]]


@pytest.mark.parametrize("seed", range(6))
def test_targets_and_words(spark, seed):
    docs = corpus(seed)
    plan = mixing.plan_mix(spark.createDataFrame(docs, "doc_id long, text string, source string, target string").repartition(3))
    got = {r.doc_id: r for r in plan.collect()}
    size = {i: len((t or "").split()) for i, t, _, _ in docs}
    sizes, longest = {}, {}
    for i, _, s, _ in docs:
        sizes[s] = sizes.get(s, 0) + size[i]
        longest[s] = max(longest.get(s, 0), size[i])
    goal = fill(sizes, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    for i, _, s, _ in docs:
        r = got[i]
        assert (r.size, r.source_size) == (size[i], sizes[s]) and r.target == pytest.approx(goal[s])
        assert r.taken <= 2 * r.size and r.taken == r.size * len(r.positions) and r.positions == sorted(r.positions)
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= longest[s] / 2 + 1e-6
    again = mixing.plan_mix(spark.createDataFrame(docs[::-1], "doc_id long, text string, source string, target string").repartition(5))
    assert {r.doc_id: r.positions for r in again.collect()} == {i: r.positions for i, r in got.items()}


def test_times_invert_the_schedules(spark):
    from pyspark.sql import functions as F

    rows = spark.range(101).select((F.col("id") / 100).alias("share"))
    for s in (*mixing.SCHEDULES, ((0.0, 0.0), (0.3, 2.0), (1.0, 0.0))):
        whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(s, s[1:]))
        for r in rows.select("share", mixing.time_of(F.col("share"), s).alias("t")).collect():
            area = 0.0
            for (t0, m0), (t1, m1) in zip(s, s[1:]):
                x = min(max(r.t, t0), t1) - t0
                area += x * m0 + (m1 - m0) / (t1 - t0) * x * x / 2
            assert area / whole == pytest.approx(r.share, abs=1e-9)


def test_stream_is_sorted_and_faithful_to_time(spark):
    docs = [(i, "w " * 10, "abc"[i % 3], i) for i in range(900)]
    stream = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string, position int"), partitions=4)
    assert stream.columns == ["doc_id", "text", "source", "position"]
    rows = stream.rdd.glom().collect()
    flat = [r.position for part in rows for r in part]
    assert flat == sorted(flat) and len(flat) == pytest.approx(1350, abs=3)
    early = [r.source for part in rows for r in part][:300]
    late = [r.source for part in rows for r in part][-300:]
    assert early.count("a") > late.count("a") and early.count("c") < late.count("c")


def test_clashing_names_nulls_and_repeats(spark):
    docs = [(1, "a b", "s"), (1, "a b", "s"), (None, "c", None), (3, None, "s"), (4, "d " * 50_000, "t")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    clashes = ["place", "_k", "_b", "h", "id", "key", "bucket", "n", "start", "at", "row", "_mix_b", "_key", "Target", "position"]
    wide = df.selectExpr("*", *[f"'v' as {c}" for c in clashes])
    got = mixing.plan_mix(wide)
    assert got.columns == [*(c for c in wide.columns if c != "Target"), *mixing.ADDED] and got.count() == 5
    rows = sorted(got.collect(), key=lambda r: str(r))
    plain = sorted(mixing.plan_mix(df).collect(), key=lambda r: str(r))
    assert sorted((str(r.doc_id), r.taken, str(r.positions)) for r in rows) == sorted((str(r.doc_id), r.taken, str(r.positions)) for r in plain)
    assert all(r.place == "v" for r in rows) and set(mixing.mix(wide).columns) == set(wide.columns) - {"Target"}


def test_schedules_decide_the_order(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "abc"[i % 3]) for i in range(300)], "doc_id long, text string, source string")
    flat = tuple(((0.0, 1.0), (1.0, 1.0)) for _ in range(3))
    a, b = mixing.curriculum(docs), mixing.curriculum(docs, schedules=flat)
    x, y = ({r.doc_id: (r.taken, r.first_position) for r in d.collect()} for d in (a, b))
    assert all(x[i][0] == y[i][0] for i in x) and sum(x[i][1] != y[i][1] for i in x) > 100
    got = [r.first_position for part in a.rdd.glom().collect() for r in part]
    known = [p for p in got if p is not None]
    assert known == sorted(known) and all(p is None for p in got[len(known):])


def test_query_matches_its_sql(spark):
    import duckdb

    from veldrin.llm import queries

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{at}/documents.parquet'")
    want = con.execute(queries.OP9_SQL).fetchall()
    got = queries.op9_mixing(spark, at)
    assert got.columns == [d[0] for d in con.description]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_plan_writes_no_table_and_reads_sums_once(spark):
    from pathlib import Path

    from veldrin.llm.common import shared_dir

    written = Path(shared_dir(spark).removeprefix("file:"), "veldrin")
    before = set(written.glob("mix-*"))
    docs = [(i, "w " * (i % 7), "abc"[i % 3]) for i in range(300)]
    plan = mixing.plan_mix(spark.createDataFrame(docs, "doc_id long, text string, source string"))
    assert len(plan.collect()) == 300 and set(written.glob("mix-*")) == before
    ran = plan._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
    assert ran.count("ReusedExchange") == 1 and ran.count("functions=[partial_sum(size") == 1


def test_empty(spark):
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
