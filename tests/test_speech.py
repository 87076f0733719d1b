import pytest
from pyspark.sql import functions as F

from veldrin.operators import speech as S


@pytest.fixture
def each(spark):
    def run(texts, column):
        return [r.c for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(column.alias("c")).collect()]

    return run


def test_switches(each):
    got = each(["Magkano po ang premium ko kung monthly ang bayad", "what is the plan", "hmm", "saya tidak tahu"], S.code_switch(F.col("t")))
    assert [g.languages for g in got] == [["tagalog", "english"], ["english"], [], ["indonesian"]] and [g.switched for g in got] == [True, False, False, False]
    got = each(["Kayo po ba ito? Salamat.", "Ikaw po ba ito."], S.register(F.col("t")))
    assert [g.mixed for g in got] == [False, True]
    assert each(["Mohon tunggu, please."], S.register(F.col("t"), "id"))[0].drift == ["please"]
    assert each(["nggih punten", "halo"], S.region(F.col("t"), {"jv": ["nggih"], "su": ["punten", "nggih"]})) == ["su", "standard"]


def test_recogniser_artefacts(each):
    assert each(["", "Thank you.", "and...", "?!", "opo", "no"], S.is_silence(F.col("t"))) == [True, True, True, True, False, False]
    assert each(["and the plus, max", "the Plus plan, please", "grace period"], S.is_prompt_echo(F.col("t"), F.lit("Essential, Plus, Max"))) == [True, False, False]
    assert each(["your premium is due", "yes please do that"], S.is_own_voice(F.col("t"), F.lit("Your premium is due on Friday"))) == [True, False]


def test_pieces(each):
    long = "a" * 100 + ", " + "b" * 150 + ", " + "c" * 20 + "."
    got = each(["Got it. We will call you back tomorrow morning.", long, "", "x" * 300], S.pieces(F.col("t")))
    assert got == [["Got it. We will call you back tomorrow morning."], ["a" * 100 + ",", "b" * 150 + ", " + "c" * 20 + "."], [], ["x" * 300]]
