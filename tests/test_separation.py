import random

import duckdb
import pytest

import __spark_entry__ as entry
from veldrin.operators import nearest


@pytest.mark.parametrize("limits", [{}, {"PACK": 9, "BLOCK": 4, "QUERIES": 2}, {"SENT": 0}])
@pytest.mark.parametrize("labels", ["abc", "a", "abcdefghijklmnopqrstuvwxyz"])
def test_against_sql_without_rows_for_pairs(spark, monkeypatch, tmp_path, limits, labels):
    for name, value in limits.items():
        monkeypatch.setattr(nearest, name, value)
    rng = random.Random(11)
    rows = [(i, [rng.gauss(0, 1) + ord(x) % 3 for _ in range(6)], x if i % 17 else None) for i in range(950) for x in rng.choice(labels)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    want = duckdb.connect().execute(entry.oracle_sql()["embedding_separation"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'").replace("JOIN embeddings", f"JOIN '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    got = entry.queries()["embedding_separation"](spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == want and len(want) == 1
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan.lower()
