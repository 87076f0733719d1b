"""The pipeline's stages, each on its own input, against what they should keep."""

import random

from veldrin.llm.common import stage

import corpus_pipeline as cp


def test_stages(spark):
    rng = random.Random(5)
    words = {"en": ["the", "of", "and", "there", "which", "house", "would", "thing"], "de": ["der", "und", "nicht", "schön", "über", "straße", "gehen", "wir"]}

    def text(lang, n):
        return " ".join(rng.choice(words[lang]) + rng.choice(["", str(rng.randrange(1000))]) for _ in range(n))

    rows = [(i, text(lang, 60) + "\n" + text(lang, 40), lang, f"s{i % 3}") for i in range(120) for lang in [("en", "de")[i % 2]]]
    shared = text("en", 70)
    rows += [(200 + i, shared + "\n" + text("en", 60), "en", "s0") for i in range(5)]
    rows += [(300, rows[3][1], "de", "s1"), (301, rows[4][1].replace(" the", " then", 1), "en", "s1"), (400, "12 34 !!", "en", "s1"), (401, None, None, None), (402, "", "en", "s0")]
    docs = spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(cp.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "minhash", "mixing", "packing"]
    one = stage(stages["language_id"](spark, docs, ""), "t")
    clean = {r[0] for r in rows} - {400, 401, 402}
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == clean
    two = stage(stages["line_dedup"](spark, one, ""), "t")
    kept = {r.doc_id: r for r in two.collect()}
    assert two.columns == docs.columns and set(kept) == clean - {300, 301} and all(r.n_chars == len(r.text) for r in kept.values())
    assert shared in kept[200].text and all(shared not in kept[200 + i].text for i in range(1, 5))
    three = stage(stages["minhash"](spark, one, ""), "t")
    ids = {r.doc_id for r in three.collect()}
    assert three.columns == docs.columns and 300 not in ids and 301 not in ids and set(range(120)) <= ids
    four = stage(stages["mixing"](spark, three, ""), "t")
    assert four.columns == docs.columns and set(r.doc_id for r in four.collect()) <= ids and abs(four.count() - 1.5 * len(ids)) < 12
    five = stages["packing"](spark, four, "").collect()
    assert max(r.offset + r.length for r in five) <= 2048 and {r.doc_id for r in five} == {r.doc_id for r in four.collect()}


def test_columns_of_any_name_come_through(spark):
    rng = random.Random(2)
    words = {"en": ["the", "of", "and", "there", "which", "house"], "de": ["der", "und", "nicht", "schön", "über", "gehen"]}
    names = ["target", "size", "taken", "source_size", "positions", "position", "score", "accepted", "lang_pred", "n_lines", "n_dropped", "gone", "_gone", "row", "key", "kept", "a.b", "id", "h"]
    rows = [(i if i % 9 else None, "\n".join(" ".join(rng.choice(words[lang]) + str(rng.randrange(99)) for _ in range(25)) for _ in range(2)), lang, f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(60) for lang in [("en", "de")[i % 2]]]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema).repartition(3)
    want = {r[4]: r for r in rows}
    for name, step in cp.STAGES[:-1]:
        docs = stage(step(spark, docs, ""), name)
        assert docs.columns == [c.split()[0].strip("`") for c in schema.split(", ")]
        got = docs.collect()
        assert len(got) >= 50
        for r in got:
            assert tuple(r)[4:] == want[r.target][4:] and r.doc_id == want[r.target][0] and r.text == want[r.target][1]
    assert cp.STAGES[-1][1](spark, docs, "").count() >= 50


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars int")
    for name, step in cp.STAGES:
        docs = step(spark, docs, "")
        assert docs.count() == 0
