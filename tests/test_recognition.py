"""Scoring of recognisers: numbers, lost words and what became of them, against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veldrin.operators import recognition as R


def numbers(words):
    """By hand-written loops: tens with their unit, then runs with a scale."""
    out = []
    for w in words:
        if out and out[-1] in R.TENS and re.fullmatch("[0-9]", w) and not joined:
            out[-1] = str(int(out[-1]) + int(w))
            joined = True
        else:
            out.append(w)
            joined = False
    runs, at = [], 0
    value = lambda w: R.UNITS.get(w, R.UNITS.get(w[:-2]) if w.endswith("ng") else None)
    is_number = lambda w: value(w) is not None or re.fullmatch("[0-9]{1,15}", w) or w in R.SCALES
    while at < len(out):
        end = at
        while end < len(out) and is_number(out[end]):
            end += 1
        run = out[at:end]
        if len(run) >= 2 and any(w in R.SCALES for w in run):
            groups, part = 0, 0
            for w in run:
                if w not in R.SCALES:
                    part += value(w) if value(w) is not None else int(w)
                elif R.SCALES[w] == 100:
                    part = max(part, 1) * 100
                else:
                    groups, part = groups + max(part, 1) * R.SCALES[w], 0
            runs.append(str(groups + part))
        else:
            runs += run
        if end < len(out):
            runs.append(out[end])
        at = end + 1
    return runs


def test_numbers(spark):
    cases = {
        "sixty thousand a month": ["60000", "a", "month"], "I am thirty five": ["i", "am", "35"], "dua juta tiga ratus ribu": ["2300000"], "Rp2.300.000 please": ["2300000", "please"], "isang libo": ["1000"], "one two three": ["1", "2", "3"],
        "twenty thirty five 5": ["20", "35", "5"], "two hundred fifty thousand": ["250000"], "thousand": ["thousand"], "seribu ya": ["seribu", "ya"], "dalawang daan at lima": ["200", "at", "lima"], "1,234,567.5": ["1234567", "5"], "": []}
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", R.normalised(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == cases
    assert spark.range(1).select(R.normalised(F.lit("nineteen hundred forty two"), fold=False)).first()[0] == ["19", "100", "42"]
    rng = random.Random(3)
    words = ["20", "30", "5", "7", "12", "x", "dua", "tiga", "isang", "ratus", "ribu", "juta", "libo", "hundred", "y", "0", "1234567890123456"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(9))) for _ in range(400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", R.normalised(F.col("t")).alias("n")).collect()
    for r in rows:
        assert r.n == numbers(r.t.split()), r.t


def like(word, heard):
    best, top = "", 0.0
    for o in heard:
        if abs(len(o) - len(word)) <= max(3, len(word) // 2):
            same = sum(a == b for a, b in zip(word, o, strict=False))
            if len(word) >= 4:
                same = max(same, sum(min(word.count(c), o.count(c)) for c in set(word)))
            if same / max(len(word), len(o)) > top:
                best, top = o, same / max(len(word), len(o))
    return best if top >= 0.6 else ""


def test_lost_words(spark):
    rng = random.Random(5)
    pool = ["policy", "polcy", "pol", "icy", "premium", "premiums", "malaps", "ma", "lapse", "mayar", "a", "ab", "abc", "12", "teh"]
    rows = [(rng.choice(pool), [rng.choice(pool) for _ in range(rng.randrange(5))]) for _ in range(300)]
    got = spark.createDataFrame(rows, "w string, h array<string>").select("w", "h", R.similar(F.col("w"), F.col("h")).alias("s")).collect()
    assert all(r.s == like(r.w, r.h) for r in got) and sum(r.s != "" for r in got) > 50


def test_scores_and_failures(spark):
    rows = [
        ("a", "pay the premium of sixty thousand", "pay the premum of 60000", None, 100.0), ("a", "punten abdi mayar", "punten abdi bayar", "sundanese", 300.0), ("b", "kulo nggih", "", "javanese", 50.0), ("b", "", "x", None, 10.0),
        ("b", "niki sampun wingi", "sampon", "javanese", 20.0), ("a", "bayad po ang premium due date", "the premium due date", None, 200.0), ("b", "number 4 7", "number 5", None, None), ("b", "hello there", "helo dear friend", None, 30.0), ("b", None, None, None, 5.0)]
    df = R.scored(spark.createDataFrame(rows, "provider string, said string, heard string, accent string, milliseconds double"))
    got = {(r.said, r.heard): r for r in df.collect()}
    told = lambda s, h: [(f.word, f.failure) for f in got[s, h].failures]
    assert told(*rows[0][1:3]) == [("premium", "heard as premum")] and got[rows[0][1:3]].accuracy == pytest.approx(4 / 5)
    assert told(*rows[1][1:3]) == [("mayar", "regional word, heard as bayar")]
    assert told(*rows[2][1:3]) == [("kulo", "whole utterance lost"), ("nggih", "whole utterance lost")] and got[rows[2][1:3]].accuracy == 0
    assert told(*rows[4][1:3]) == [("niki", "regional word, dropped"), ("sampun", "regional word, heard as sampon"), ("wingi", "regional word, dropped")]
    assert told(*rows[5][1:3]) == [("bayad", "one language dropped"), ("po", "one language dropped"), ("ang", "one language dropped")]
    assert told(*rows[6][1:3]) == [("4", "number"), ("7", "number")] and told(*rows[7][1:3]) == [("hello", "heard as helo"), ("there", "dropped")]
    assert got["", "x"].accuracy == got[None, None].accuracy == 0 and told(None, None) == []
    by = {r.provider: r for r in R.report(df, "provider").collect()}
    assert by["a"].n == 3 and by["a"].median_ms == 200 and by["a"].failures == {"heard": 1, "one language dropped": 3, "regional word, heard": 1}
    assert by["b"].failures == {"dropped": 1, "heard": 1, "number": 2, "regional word, dropped": 2, "regional word, heard": 1, "whole utterance lost": 2}
