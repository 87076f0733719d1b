import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veldrin.operators import calls, index, leads

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["vector_index", "contacts", "lead_actions", "call_summary", "echo_window", "errors_and_lengths"])
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in "orders events documents embeddings".split():
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    df = entry.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))
    assert len(got) > 0 and got == sorted(map(repr, want.fetchall()))


def test_contacts(spark):
    said = ["my name is Ana Maria Cruz", "hello, this is nobody", "call +63 917-123-4567 please", "it was 12345", None, "9" * 17]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    got = rows.orderBy("i").select(leads.contact_name(F.col("s")), leads.contact_number(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("Ana Maria Cruz", None), (None, None), (None, "+63 917-123-4567"), (None, None), (None, None), (None, None)]


def test_summaries_keep_the_last_value(spark):
    turns = spark.createDataFrame([(1, 1, "my name is Ana"), (1, 2, "i am Bea"), (1, 3, None), (2, 1, "hi")], "conv_id long, turn long, caller string")
    answers = spark.createDataFrame([(1, 1, "age", "30"), (1, 2, "age", "31"), (1, 2, None, "x"), (1, 3, "home", None)], "conv_id long, turn long, slot string, value string")
    got = {r.conv_id: r for r in leads.call_summaries(turns, answers).collect()}
    assert (got[1].turns, got[1].full_name, got[1].collected) == (3, "Bea", {"age": "31"})
    assert (got[2].turns, got[2].full_name, got[2].collected) == (1, None, {})


def test_an_index_of_another_model_is_refused(spark, tmp_path):
    records = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "record_id string, n int")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0]), ("gone", [3.0])], "record_id string, embedding array<double>")
    built = index.build_index(records, vectors, f"file://{tmp_path}/index", "m:1")
    assert sorted(map(tuple, index.open_index(records, built, "m:1").select("record_id", "n", "embedding").collect())) == [("a", 2, [1.0]), ("b", 1, [2.0])]
    with pytest.raises(ValueError):
        index.open_index(records, built, "m:2")


def test_call_state(spark):
    row = spark.range(1).select(
        calls.next_slot(F.array(F.lit("age"), F.lit("home")), F.array(F.lit("age")), F.lit(None).cast("array<string>")).alias("slot"),
        calls.asked_in_vain(F.array(F.lit("how much does the waiver premium cost")), F.lit("what does the waiver premium cost")).alias("again"),
        calls.asked_in_vain(F.array(F.lit("how much does the waiver premium cost")), F.lit("where is your office")).alias("new"),
        calls.to_facts(F.create_map(F.lit("age"), F.lit("3"), F.lit("x"), F.lit("y")), {"age": "applicant_age"}).alias("facts"),
        calls.suggested_wait(F.lit("429 {'retryDelay': '7.5s'}")).alias("wait"), calls.is_transient(F.lit("Deadline exceeded")).alias("transient"),
        leads.note_language(F.lit("fil")).alias("lang"), leads.note_language(F.lit(None).cast("string")).alias("other")).first()
    assert tuple(row) == ("home", True, False, {"applicant_age": "3", "x": "y"}, 7.5, True, "Filipino", "English")


def test_echo_ends_by_bytes_or_by_clock(spark):
    # A reply of 600 ms is 1 s of deafness with the tail: 32,000 bytes.
    rows = [("a", 0.0, 0, 600.0, None), ("a", 0.1, 1, None, 20000), ("a", 0.2, 2, None, 20000), ("a", 0.3, 3, None, 100),
            ("b", 0.0, 0, 600.0, None), ("b", 0.5, 1, None, 10), ("b", 1.0, 2, None, 10), ("c", 0.0, 0, None, 10)]
    df = spark.createDataFrame(rows, "call_id string, at double, seq int, spoken_ms double, n_bytes long")
    got = {(r.call_id, r.seq): r.echo for r in calls.echoes(df).collect()}
    assert [k for k, v in sorted(got.items()) if v] == [("a", 1), ("a", 2), ("b", 1)]
