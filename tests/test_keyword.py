"""BM25 in blocks: against SQL, over slices and packs, without pairs in shuffles."""

import random

import duckdb
import pytest

import __spark_entry__ as entry
from shuffles import written
from veldrin.operators import keyword


def tables(spark, path, docs, items):
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").repartition(2).write.parquet(f"{path}/benchmark.parquet")
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.execute(f"create view {t} as select * from '{path}/{t}.parquet/*.parquet'")
    return sorted(db.execute(entry.oracle_sql()["bm25_topk"]).fetchall(), key=repr)


@pytest.mark.parametrize("limits", [{}, {"QUERIES": 7, "DOCS": 11, "DENSE": 3, "PRODUCTS": 5}, {"POSTINGS": 60, "TOKENS": 90, "DENSE": 0}])
def test_against_sql(spark, monkeypatch, tmp_path, limits):
    for name, value in limits.items():
        monkeypatch.setattr(keyword, name, value)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(rng.choices(words, [1 / (1 + i) for i in range(40)], k=n))
    docs = [(i, text(rng.randrange(1, 60)) + f" only{i}") for i in range(150)]
    docs += [(1000 + i, docs[i][1]) for i in range(20)] + [(2000, None), (2001, ""), (2002, "!?"), (3, "w0 w1 w2"), (3, "w0 w1 w7"), (4, docs[4][1]), (5, "w30 w31")]
    items = [(i, text(12)) for i in range(30)] + [(50, None), (51, ""), (52, "nothing of this"), (2, "w5 w5 w6")]
    want = tables(spark, tmp_path, docs, items)
    got = entry.queries()["bm25_topk"](spark, str(tmp_path)).select("query_id", "id", "score", "rank")
    assert sorted(map(tuple, got.collect()), key=repr) == want and len(want) == 150


def test_pairs_are_not_shuffled(spark, tmp_path):
    rng = random.Random(6)
    docs = [(i, " ".join(["all", *rng.choices("abcdefghijklmnop", k=30)])) for i in range(900)]
    want = tables(spark, tmp_path, docs, docs[:60])
    before = written(spark)
    got = entry.queries()["bm25_topk"](spark, str(tmp_path)).select("query_id", "id", "score", "rank").collect()
    assert sorted(map(tuple, got), key=repr) == want
    assert written(spark) - before < 900 * 60 / 4
