import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
CHECKED = ["bm25_topk", "cosine_topk", "content_hash_dups", "snapshot_versions", "rules_assess", "stage_latency", "slot_evolution", "label_scoring", "turn_exchanges"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["query_id", "id", "score", "rank"]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in "customer events documents embeddings benchmark labels conversations".split():
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert len(got) > 0 and got == sorted(map(repr, want.fetchall()))
