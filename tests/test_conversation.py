import pytest
from pyspark.sql import functions as F

from veldrin.operators import conversation as C
from veldrin.operators import metrics, nudges, privacy, rules, signals
from veldrin.plans import catalogue
from veldrin.streaming import endpoint
from veldrin.streaming import nudges as streaming


def values(spark, texts, column):
    return [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column.alias("c")).collect()]


def test_answers(spark):
    said = ["I am 35", "thirty five", "42 years old", "65.", "I have 2 children", "age is 200", "eighteen or so", ""]
    assert values(spark, said, C.read_age(F.col("t"))) == [35, 35, 42, 65, None, None, 18, None]
    assert values(spark, ["we have 3 kids and I turn 47 soon", "5"], C.read_age(F.col("t"), True)) == [47, None]
    money = ["60k", "1,200,000", "sixty thousand a month", "two hundred fifty thousand", "2.5 juta", "nothing", "12"]
    assert values(spark, money, C.read_money(F.col("t"))) == [60000, 1200000, 60000, 250000, 2500000, None, None]
    assert values(spark, ["yes", "no", "yes and no", "maybe", "hindi po"], C.read_yes_no(F.col("t"))) == [True, False, None, None, False]
    asks = ["what does it cover?", "yes thanks", "ok", "I am 35 years old", "this sounds more expensive than I expected"]
    assert values(spark, asks, C.needs_knowledge(F.col("t"))) == [True, False, False, False, True]
    assert values(spark, ["Sorry, I meant 65.", "hello"], C.is_correction(F.col("t"))) == [True, False]
    assert values(spark, ["do you cover physiotherapy", "something else entirely"], C.same_question(F.col("t"), F.lit("is physiotherapy covered or not"))) == [True, False]
    assert values(spark, ["get me a person", "hi"], C.escalation(F.col("t"), {"ESC": ["a person"], "Z": ["person"]})) == ["ESC", ""]


def test_citations_are_what_the_reply_used(spark):
    kind = "array<struct<source_ref:string,title:string,content:string>>"
    records = [("a", "Rates", "essential premium monthly dependants 1180 schedule"), ("b", "Wait", "premium monthly waiting maternity twelve"), ("c", "Other", "premium monthly claims hospital")]
    df = spark.createDataFrame([("maternity waiting is twelve months with monthly premium", records), ("monthly premium", records), ("essential schedule", records[:1])], f"reply string, r {kind}")
    got = [[x.source_ref for x in r.c] for r in df.select(C.records_behind(F.col("reply"), F.col("r")).alias("c")).collect()]
    assert got == [["b"], [], ["a"]]


TURNS = [
    ("I can't afford this, no money", "You are approved", None), ("my wife drives it too", "Understood. What is your annual income?", None), ("my wife drives it too", "Shall I add her as a driver?", None),
    ("maybe", "You qualify, subject to underwriting", None), ("magkano po ba ang premium ko every month", "", ["magkano po ang premium ko kada buwan"]), ("hello", "ok", None)]


def test_signals(spark):
    rows = [(i, c, a, e, 4200.0 if i == 5 else 0.0) for i, (c, a, e) in enumerate(TURNS)]
    df = signals.lexical(spark.createDataFrame(rows, "turn int, caller string, agent string, asked_before array<string>, silence_ms double"))
    got = {r.turn: {(s.kind, round(s.confidence, 2)) for s in r.signals} for r in df.collect()}
    assert got == {
        0: {("hardship", 0.88), ("missing_disclosure", 0.85)}, 1: {("missed_opportunity", 0.74)}, 2: set(), 3: {("hesitation", 0.72)},
        4: {("buying_signal", 0.72), ("repeated_question", 0.8)}, 5: {("dead_air", 1.0)}}
    assert [r.d for r in df.orderBy("turn").select(signals.needs_deliberation(F.col("caller"), F.col("signals")).alias("d")).collect()] == [True, False, False, False, True, False]
    assert [s.kind for s in spark.range(1).select(signals.deliberated(F.lit("neutral | asks price | YES")).alias("s")).first().s] == ["sentiment", "intent", "churn_risk"]


SIGNALS = [(1, t, o, k, c, "e") for t, o, k, c in [
    (0, 0, "hesitation", 0.72), (0, 1, "hardship", 0.88), (0, 2, "sentiment", 0.9), (1, 0, "hardship", 0.9), (2, 0, "confusion", 0.5), (3, 0, "escalation", 1.0), (4, 0, "escalation", 1.0), (5, 0, "hardship", 0.9), (6, 0, "agent_threat", 0.9)]]


def test_nudges_batch_equals_stream(spark, tmp_path):
    schema = "conv_id long, turn long, ord int, kind string, confidence double, evidence string"
    settings = nudges.NudgeSettings(max_per_call=4)
    batch = [(r.turn, r.kind, r.fired, r.reason) for r in nudges.nudges(spark.createDataFrame(SIGNALS, schema), settings).collect()]
    assert batch == [
        (0, "hardship", True, ""), (0, "hesitation", False, "another nudge this turn"), (1, "hardship", False, "cooldown"), (2, "confusion", False, "below confidence floor"),
        (3, "escalation", True, ""), (4, "escalation", True, ""), (5, "hardship", True, ""), (6, "agent_threat", False, "call budget spent")]
    muted = nudges.nudges(spark.createDataFrame(SIGNALS, schema), nudges.NudgeSettings(muted=frozenset(["hardship"]), max_per_turn=2)).collect()
    assert {r.reason for r in muted if r.kind == "hardship"} == {"muted"} and [r.fired for r in muted if r.kind == "hesitation"] == [True]
    assert nudges.nudges(spark.createDataFrame(SIGNALS, schema), nudges.NudgeSettings(enabled=False)).count() == 0
    for k, part in enumerate((SIGNALS[:4], SIGNALS[4:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = streaming.stream_nudges(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), settings).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
        assert q.awaitTermination(90), k
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted((r.turn, r.kind, r.fired, r.reason) for r in out) == sorted(batch)


def test_endpointing(spark):
    def frames(*runs):
        out = []
        for voiced, n in runs:
            out += [(voiced, 500.0 if voiced else 5.0)] * n
        return [(7, i, v, r) for i, (v, r) in enumerate(out)]

    calls = frames((False, 10), (True, 40), (False, 40), (True, 3), (False, 60), (True, 30))
    df = spark.createDataFrame(calls, "call_id long, frame_no long, voiced boolean, rms double")
    got = [(r.first_frame, r.ended_by, r.reason, r.duration_ms) for r in endpoint.utterances(df).collect()]
    assert got[0][:3] == (9, "silence", "") and got[0][3] == (41 + 35 - 32) * 20
    assert [g[2] for g in got] == ["", "too little voice", ""] and got[2][1] == "close"
    chunks, rest = endpoint.reframe(b"", b"a" * 1000)
    assert [len(c) for c in chunks] == [640] and len(rest) == 360 and len(endpoint.reframe(rest, b"b" * 280)[0]) == 1
    speaking = df.withColumn("agent_speaking", F.lit(True))
    assert [r.frame_no for r in endpoint.interruptions(speaking).collect()][:1] == [21]


def test_rules_are_three_valued(spark):
    callers = [("x", "a", {"age": "65"}), ("y", "a", {}), ("z", "a", {"age": "55", "residency": "PH"}), ("p", "b", {"income": "10", "product_interest": "BUILDING"}), ("q", "b", {"income": "10"})]
    got = {r.caller_id: r for r in rules.assess(spark.createDataFrame(callers, "caller_id string, unit string, facts map<string,string>"), catalogue.RULES).collect()}
    assert not got["x"].eligible and got["x"].decided and got["x"].decline_reason == "Age." and got["x"].missing == ["residency"]
    assert got["y"].eligible and not got["y"].decided and got["y"].missing == ["age", "residency"]
    assert got["z"].eligible and got["z"].decided and got["z"].requirements == ["require_medical_exam"]
    assert not got["p"].eligible and got["q"].eligible
    lost = rules.assess(spark.createDataFrame([("n", "nowhere", {"age": "65"})], "caller_id string, unit string, facts map<string,string>"), catalogue.RULES)
    row = lost.withColumn("said", rules.wording(lost, {})).first()
    assert row.eligible is None and row.decided is None and row.said == row.decline_reason == "no rules for this unit"
    tests = [("age >= 51", True), ("age < 10", False), ("name == 'x'", True), ("age == 'x'", False), ("flag == true", True), ("none > 1", None), ("name > 3", None), ("a b c", None), ("age == '60.0'", True), ("age != 6e1", False), ("flag != TRUE", False), ("flag > true", None), ("name != \"y\"", True)]
    row = spark.createDataFrame([({"age": "60", "name": "x", "flag": "true"},)], "f map<string,string>").select(*[rules.compile_test(t, F.col("f")).alias(f"c{i}") for i, (t, _) in enumerate(tests)]).first()
    assert [row[i] for i in range(len(tests))] == [w for _, w in tests]


@pytest.mark.parametrize("text,kinds", [
    ("Mail a.b@c.example now", ["EMAIL"]), ("TIN 123-456-789", ["GOV_ID_PH"]), ("KTP: 1234567890123456", ["GOV_ID_ID"]), ("+63 917 123 4567 or HS-2024-12345", ["PHONE_PH", "ACCOUNT"]),
    ("born 1/2/1990, due 1/2/2026", ["DOB"]), ("at 12 Mabini Street, Quezon City", ["ADDRESS"]), ("Juan Dela Cruz from Quezon City", ["NAME"]), ("nothing", [])])
def test_privacy(text, kinds):
    assert [f[0] for f in privacy.find(text, True)] == kinds
    assert all(text[s:e] == t for _, t, s, e, _ in privacy.find(text, True))


def test_redaction(spark):
    texts = ["é mail a@b.co and a@b.co", "plain", None]
    df = privacy.protect(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string"))
    got = {r.i: r for r in df.collect()}
    want = next(iter(privacy.redact_files([texts[0]])))
    assert got[0].content == want and got[0].pii and got[0].pii_types == ["EMAIL"] and not got[1].pii and got[1].content == "plain" and got[2].content is None


def test_measures(spark):
    xs = spark.createDataFrame([("a", float(i)) for i in range(1, 31)] + [("b", 2.0), ("b", 1.0)], "stage string, milliseconds double")
    got = {r.stage: (r["count"], r.p50, r.p95) for r in metrics.stage_latency(xs).collect()}
    assert got == {"a": (30, 15.5, 29.0), "b": (2, 1.5, 2.0)}
    e = spark.createDataFrame([(1, "x"), (2, "x"), (2, "y")], "turn int, kind string")
    f = spark.createDataFrame([(1, "x"), (3, "x"), (4, "z")], "turn int, kind string")
    got = {r.kind: (r.tp, r.fp, r.fn, r.precision, r.recall) for r in metrics.kind_scores(e, f).collect()}
    assert got == {"x": (1, 1, 1, 0.5, 0.5), "y": (0, 0, 1, 0.0, 0.0), "z": (0, 1, 0, 0.0, 0.0)}
    assert spark.range(1).select(metrics.word_accuracy(F.lit("one two two"), F.lit("two one one"))).first()[0] == pytest.approx(2 / 3)
