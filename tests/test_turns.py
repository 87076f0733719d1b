"""The conversation fold: by hand, against the stream, against a restart and an initial state."""

import uuid

from pyspark.sql import functions as F

from veldrin.operators import turns as T
from veldrin.sources.packs import Pack, Slot
from veldrin.streaming import turns as S

PACK = Pack(
    "p", "u1", slots=(Slot("age", "And how old are you?", True, expects=("how old",)), Slot("residency", "Do you live here now?", True, expects=("living in",)), Slot("currently_admitted", "Are you in hospital at the moment?", True), Slot("plan_interest", "Which plan level would you like to have?", maps_to="plan")),
    detect={"ESC-REQUEST": ("real person",), "ESC-LEGAL": ("lawyer",)}, variants={"standard": {}, "sunda": {"markers": ["punten"]}, "jawa": {"markers": ["nggih", "matur"]}})
SCHEMA = "conv_id long, turn long, caller string, agent string, grounded boolean, sought boolean"
NO = "I do not have that detail."
TALK = [
    (1, 1, "punten, do you cover physiotherapy", NO, False, True),
    (1, 2, "I am 35", "Are you living in the city?", False, False),
    (1, 3, "yes I am", "So, are you in hospital at the moment", False, False),
    (1, 4, "hmm well", "are you in hospital at the moment?", False, False),
    (1, 5, "actually I meant 53, and nggih the Plus or Max one", "Thanks, how old?", False, False),
    (1, 6, "I earn sixty thousand a month, my name is Ana Cruz", "ok", True, True),
    (1, 7, "is physiotherapy covered then", "Let me pass you on. how old?", False, False),
    (1, 8, "no", "bye", False, False),
    (2, 1, "my lawyer says 20", "ok", False, False),
    (2, 2, None, None, None, None),
    (3, 5, "62", "How old are you?", False, False), (3, 2, "hello", "And how old are you?", False, False), (3, 7, "I live in Lyon, 41", "fine", False, False)]


def rows(df):
    return sorted((tuple(sorted(v.items()) if isinstance(v, dict) else v for v in r) for r in df.select(T.OUT_NAMES).collect()), key=lambda r: r[:2])


def test_by_hand(spark):
    got = {(r.conv_id, r.turn): r for r in T.fold(spark.createDataFrame(TALK, SCHEMA).repartition(3), PACK).collect()}
    assert len(got) == len(TALK)
    a = [got[1, k] for k in range(1, 9)]
    assert [r.trigger for r in a] == ["", "", "", "", "", "", "ESC-UNKNOWN-REPEAT", ""]
    assert [r.region for r in a] == ["sunda"] * 4 + ["jawa"] * 4
    assert a[1].filled == {"age": "35"} and a[2].filled == {"residency": "PH"} and a[3].filled == {}
    assert a[4].filled == {"age": "53", "plan_interest": "Max"} and a[4].corrections == ["age: 35 -> 53"]
    assert a[5].filled == {"monthly_income": "60000", "full_name": "Ana Cruz"} and a[3].given_up == ["currently_admitted"]
    assert a[7].slots == {"age": "53", "residency": "PH", "plan_interest": "Max", "monthly_income": "60000", "full_name": "Ana Cruz"}
    assert a[7].unanswered == ["punten, do you cover physiotherapy"] and a[6].asked == {"residency": 1, "currently_admitted": 2, "age": 1}
    assert a[6].last_asked == "age" and a[6].assessed == a[5].slots
    assert got[2, 1].trigger == "ESC-LEGAL" and got[2, 1].assessed is None and got[2, 2].assessed == got[2, 2].slots
    assert [got[3, t].filled for t in (2, 5, 7)] == [{}, {"age": "62"}, {}] and got[3, 5].asked == {"age": 2} and got[3, 5].given_up == []


def test_assessments_take_names_from_the_pack(spark):
    rule_list = [{"unit": "u1", "kind": "hard", "ord": 0, "id": "A", "field": "age", "test": "18 <= age <= 50", "on_fail": "decline", "reason": "Too old."},
                 {"unit": "u1", "kind": "soft", "ord": 0, "id": "B", "field": "plan", "test": "plan == Max", "on_pass": "require_medical_exam", "reason": "Max."}]
    got = {(r.conv_id, r.turn): r for r in T.assessed(T.fold(spark.createDataFrame(TALK, SCHEMA), PACK), PACK, rule_list).collect()}
    assert len(got) == len(TALK) and got[1, 1].missing == ["age"] and not got[1, 1].decided and got[1, 2].eligible and got[1, 2].decided
    assert not got[1, 5].eligible and got[1, 5].declined_by == "A" and got[1, 5].requirements == ["require_medical_exam"] and got[2, 1].eligible is None
    assert [got[1, k].next_slot for k in (1, 2, 3, 4)] == ["age", "residency", "currently_admitted", None]


def stream(spark, tmp_path, parts, **more):
    """The parts of TALK as micro-batches, the query stopped and started again after each."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src, out, name = tmp_path / "in", tmp_path / "out", uuid.uuid4().hex
    for k, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        df = S.stream_turns(spark.readStream.schema(SCHEMA).parquet(str(src)), PACK, **more)
        q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(tmp_path / f"cp{name}")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert q.exception() is None, k
    return spark.read.schema(T.OUT).parquet(str(out))


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    batch = rows(T.fold(spark.createDataFrame(TALK, SCHEMA), PACK))
    parts = [[r for r in TALK if r[1] <= 3], [r for r in TALK if 3 < r[1] <= 5], [r for r in TALK if r[1] > 5]]
    assert rows(stream(spark, tmp_path, parts)) == batch


def test_stream_goes_on_from_a_batch(spark, tmp_path):
    whole = rows(T.fold(spark.createDataFrame(TALK, SCHEMA), PACK))
    before, after = [r for r in TALK if r[1] <= 4], [r for r in TALK if r[1] > 4]
    start = S.snapshot(T.fold(spark.createDataFrame(before, SCHEMA), PACK))
    start.write.parquet(str(tmp_path / "start"))
    got = rows(stream(spark, tmp_path, [after], initial=spark.read.parquet(str(tmp_path / "start"))))
    assert got == [r for r in whole if r[1] > 4]


def test_empty(spark):
    assert T.fold(spark.createDataFrame([], SCHEMA), PACK).count() == 0
    bare = T.fold(spark.createDataFrame(TALK, SCHEMA).where(F.col("conv_id") == 2), Pack("q"))
    assert {r.trigger for r in bare.collect()} == {""}
