"""Language identification: held-out accuracy, calibration, defined cases."""

import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from veldrin.llm import language_id


def test_held_out_accuracy_and_defined_cases(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = language_id.train(docs.where(~held), per_language=120)
    got = language_id.predict(docs.where(held).withColumn("Score", F.lit("mine")), model)
    assert got.columns == [*docs.columns, "lang_pred", "score", "accepted"]
    rows = got.collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.95 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.accepted for r in rows) >= 0.99 * len(rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !! %%"), (4, "漢字"), (5, "the of and " * 300_000)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 and not got[i].accepted for i in (1, 2, 3))
    assert got[4].lang_pred in model.languages and got[5].lang_pred == "en"
    again = language_id.train(docs.where(~held), per_language=120)
    assert (again.table == model.table).all() and again.temperature == model.temperature


def test_without_labels(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert language_id.predict(docs, language_id.train(docs)).first().lang_pred == "und"
    empty = docs.limit(0)
    assert language_id.predict(empty, language_id.train(empty)).count() == 0


FOREIGN = [
    "Это русский текст о погоде и природе", "Ελληνικά κείμενα για δοκιμή", "این یک متن فارسی است", "See on eestikeelne tekst ilmast ja loodusest", "zxqj vbnw kkpl qqwz xxrt", "日本語の文章です、とても長い",
    "Tämä on suomenkielinen lause säästä", "Dit is een nederlandse zin over het weer", "To jest polskie zdanie o pogodzie", "Toto je veta o počasí v slovenčine", "Bu cümle hava durumu hakkında yazılmıştır", "Ово је српски текст",
]


def fitted():
    import duckdb

    rows = duckdb.connect().execute("select doc_id, text, lang from '/root/testdata/sf0.01/documents.parquet' where text is not null and lang is not null").fetchall()
    held = [(t.encode(), lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    learn = [(t.encode(), lang) for i, t, lang in rows if zlib.crc32(str(i).encode()) % 5 and len(t) < 20_000]
    return language_id.fit([t for t, _ in learn], [lang for _, lang in learn]), held


def test_rejection_is_calibrated():
    model, held = fitted()
    one = lambda t: language_id._one(model, t)
    assert sum(one(t.encode())[2] for t in FOREIGN) <= 1
    assert sum(one(t)[2] for t, _ in held) >= 0.99 * len(held)
    # on cuts so short that predictions err, the score says how often they are right
    rng = np.random.default_rng(1)
    cuts = [(t[at : at + n], lang) for t, lang in held for n in (8, 12, 20) if len(t) > 50 for at in [int(rng.integers(len(t) - 30))]]
    said = [one(t)[:2] for t, _ in cuts]
    right = [lang == p for (_, lang), (p, _) in zip(cuts, said, strict=True)]
    score = [s for _, s in said]
    assert abs(np.mean(right) - np.mean(score)) < 0.1
    low = [r for r, s in zip(right, score, strict=True) if s < np.quantile(score, 0.25)]
    assert np.mean(low) < np.mean(right)


def test_logits_are_the_mean_of_the_grams_scores():
    """The packed model against plain Python: one row of scores for each n-gram of the folded text."""
    rng = np.random.default_rng(3)
    model = language_id.LanguageModel(["a", "b"], rng.normal(size=(language_id.BUCKETS, 2)), np.array([0.1, -0.2]), 0.7)
    for text in ("Hello, W\u00f6rld!  42 times", "x", "", "ab" * 300_000):
        folded = b" "
        for byte in text.encode() + b"    ":
            c = byte | 32 if 65 <= byte <= 90 or 97 <= byte <= 122 else byte if byte >= 128 else 32
            if c != 32 or folded[-1] != 32:
                folded += bytes([c])
        folded += b"   "
        total, n = [0.0, 0.0], 0
        seen: dict = {}
        for k in range(len(folded) - 3):
            seen[folded[k : k + 4]] = seen.get(folded[k : k + 4], 0) + 1
        for gram, times in seen.items():
            for size, mult, odd in ((2, 0x9E3779B1, 0), (3, 0x85EBCA6B, 0x5BD1E995), (4, 0xC2B2AE35, 0x27D4EB2F)):
                row = ((int.from_bytes(gram[:size], "little") ^ odd) * mult & 0xFFFFFFFF) >> 16
                total = [t + times * s for t, s in zip(total, model.table[row], strict=True)]
                n += times
        want = [t / n + b for t, b in zip(total, model.bias, strict=True)]
        assert np.allclose(model.logits(text.encode()), want)
        e = [math.exp(z / 0.7) for z in want]
        assert np.allclose(model.probabilities(text.encode()), [x / sum(e) for x in e])
