from pyspark.sql import functions as F

from veldrin.operators import lookups as L
from veldrin.operators import speech


def test_defaults_stand_in(spark, monkeypatch):
    rows = spark.createDataFrame([(1, "life_ph"), (2, "other"), (3, None), (4, "multifinance_id")], "id int, business_unit string")
    for most in (10, 0):
        monkeypatch.setattr(L, "SENT", most)
        got = {r.id: r for r in L.hints(rows).collect()}
        assert got[1].language_hint is None and got[1].expects_code_switching and got[1].known
        assert got[2].language_hint == got[3].language_hint == "en" and not got[2].known and not got[3].known and got[2].business_unit == "other"
        assert got[4].regional_varieties == ["javanese", "sundanese"]
    got = {r.language: (r.voice, r.known) for r in L.voices(spark.createDataFrame([("en",), ("fil",), ("xx",)], "language string"), {"en": "en-A", "fil": "fil-PH-B"}).collect()}
    assert got == {"en": ("en-A", True), "fil": ("fil-PH-B", True), "xx": ("en-A", False)}
    assert L.looked_up(rows, "business_unit", L.markets(spark).limit(0), "unit", "x").where("label is null and not known").count() == 4


def test_words_for_findings(spark):
    texts = ["the policy is due and you will pay", "magkano po ang premium ng policy", "xyz"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(L.described(speech.code_switch(F.col("t")))).collect()]
    assert got[0] == "english throughout" and got[1].startswith("switched between tagalog 67%, english 33%") and got[2] == "nothing recognisable"
    strings = lambda words: F.array(*[F.lit(w) for w in words]).cast("array<string>")

    def one(mixed, drift, formal, informal):
        return spark.range(1).select(L.explained(F.struct(F.lit(mixed).alias("mixed"), strings(drift).alias("drift")), strings(formal), strings(informal))).first()[0]

    assert one(False, [], [], []) == "consistent"
    assert one(True, ["the", "is", "the"], ["po", "po"], ["ka"]) == "mixes formal ['po'] with informal ['ka']; drifts into English: ['is', 'the']"
