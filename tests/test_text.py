import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veldrin.functions import text as X
from veldrin.operators import clean, store


def one(spark, value, *columns, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


@pytest.mark.parametrize("text,want,n", [
    ("Due 01/03/2026.", "Due 2026-03-01.", 1), ("On March 1, 2026 and 1 Mar 26", "On 2026-03-01 and 2026-03-01", 2),
    ("Version 3 Abc 26, Smarch 4, 2026", "Version 3 Abc 26, Smarch 4, 2026", 0), ("99/88/2020 x", "2020-88-99 x", 1), ("", "", 0)])
def test_dates(spark, text, want, n):
    r = one(spark, text, X.normalise_dates(F.col("t"))).c0
    assert (r.text, r.changed) == (want, n)


def test_hashes_ids_and_shingles(spark):
    text = "The Cat, the cat sat. On the mat"
    r = one(spark, text, X.content_hash(F.col("t")), X.stable_id(F.col("t"), F.lit(3)), X.shingles(F.col("t")), X.shingles(F.lit("two words")), X.shingles(F.lit("!")), X.token_of("EMAIL", F.lit(" A@b.C ")))
    words = re.findall("[a-z0-9]+", text.lower())
    assert r.c0 == hashlib.sha256(" ".join(words).encode()).hexdigest()[:16]
    assert r.c1 == "kb_" + hashlib.sha256(text.encode()).hexdigest()[:10] + "_03"
    assert set(r.c2) == {" ".join(words[i:i + 5]) for i in range(len(words) - 4)} and r.c3 == ["two words"] and r.c4 == []
    assert r.c5 == "[EMAIL_" + hashlib.sha256(b"a@b.c").hexdigest()[:6] + "]"


def test_terms_durations_speech(spark):
    r = one(spark, "My hulog. A grace period of thirty (30) days applies. Grace period: 2 months! Other 9 years.", X.terminology(F.col("t")), X.claimed_durations(F.col("t"), r"(?i)grace period"))
    assert r.c0.concepts == ["premium", "grace_period"] and "monthly due" in r.c0.variants and r.c0.variants == sorted(set(r.c0.variants))
    assert [(c.days, c.quote) for c in r.c1] == [(30, "A grace period of thirty (30) days applies."), (60, "Grace period: 2 months!")]
    said = one(spark, "# Title\n- **bold** and *it*, `code` [link](http://x)\n\n\n2 * 3", X.for_speech(F.col("t"))).c0
    assert said == "Title\nbold and it, code link\n2 * 3"


def plain_chunks(text, most=1400, overlap=180, least=120):
    if len(text) <= most:
        return [text]
    table = "|" in text and "\n" in text
    sep = "\n" if table else " "
    pieces = [p for p in (text.split("\n") if table else re.split(r"(?<=[.!?])\s+", text)) if p.strip()]
    out, i, carried = [], 0, []
    while i < len(pieces):
        run, size = list(carried), sum(len(p) + 1 for p in carried)
        while i < len(pieces) and (not run or size + len(pieces[i]) + 1 <= most):
            run.append(pieces[i])
            size += len(pieces[i]) + 1
            i += 1
        carried, n = [], 0
        for p in reversed(run):
            if n + len(p) > overlap:
                break
            carried, n = [p, *carried], n + len(p) + 1
        if i < len(pieces) and carried == run:
            carried = []
        out.append(run)
    texts = [sep.join(r).strip() for r in out]
    if len(texts) > 1 and len(texts[-1]) < least:
        texts[-2:] = [f"{texts[-2]}{sep}{texts[-1]}".strip()]
    return [t for t in texts if t.strip()]


@pytest.mark.parametrize("table", [False, True])
def test_chunks(spark, table):
    rng = random.Random(4)
    texts = []
    for _ in range(25):
        n = rng.randrange(1, 60)
        texts.append("\n".join(f"r{i} | {'x' * rng.randrange(5, 90)}" for i in range(n)) if table else " ".join("w" * rng.randrange(1, 140) + rng.choice(".!?") for _ in range(n)))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", store.chunk(F.col("t")).alias("c")).collect():
        assert r.c == plain_chunks(texts[r.i])
        if table:
            assert all(line in texts[r.i].split("\n") for c in r.c for line in c.split("\n"))


def test_classification(spark):
    rows = [("pdf_policy", "docs/health-shield.pdf", "a#x", "Waiting period", "b"), ("web_page", "web/campaign", "a#life_ph.rules", "Hello", "premium due"), ("odd", "x", "y", "About Solara", "z")]
    df = spark.createDataFrame(rows, "k string, o string, r string, t string, c string")
    got = df.select(clean.unit(F.col("r"), F.col("o")), clean.authority(F.col("k"), F.col("o")), clean.category(F.col("t"), F.col("c"))).collect()
    assert [tuple(g) for g in got] == [("health_ph_en", "binding", "policy_rule"), ("life_ph", "promotional", "pricing"), ("group", "published", "corporate")]


def test_conflicts_and_keepers(spark):
    rows = [
        ("r1", 1, "u", "published", "", "The grace period is 30 days."), ("r2", 2, "u", "binding", "", "Grace period: 45 days apply."), ("r3", 3, "u", "binding", "", "A grace period of 46 days."),
        ("r4", 4, "v", "binding", "", "The grace period is 90 days."), ("r5", 5, "u", "binding", "r1", "The grace period is 900 days.")]
    df = spark.createDataFrame(rows, "record_id string, ord int, business_unit string, authority string, duplicate_of string, content string").withColumn("quality_flags", F.array().cast("array<string>"))
    found = clean.conflicts(df)
    got = {tuple(r.records): r for r in found.collect()}
    assert set(got) == {("r1", "r2"), ("r1", "r3")}
    assert got["r1", "r2"].authoritative == "r2" and got["r1", "r2"].superseded == "r1" and got["r1", "r2"].resolved_by == "authority" and got["r1", "r2"].claims == ["30 days (published)", "45 days (binding)"]
    out = {r.record_id: r for r in clean.apply_conflicts(df, found).collect()}
    assert out["r1"].conflicts_with == ["r2", "r3"] and out["r1"].quality_flags == ["contradicts_binding_source"] and out["r4"].conflicts_with == []


def test_snapshot_keeps_versions(spark, tmp_path):
    def rows(**h):
        return spark.createDataFrame([(k, v, "g") for k, v in h.items()], "record_id string, content_hash string, business_unit string")

    first = store.replace_table(store.snapshot(rows(a="1", b="1", c="1"), None, "t1"), str(tmp_path / "kb"))
    second = store.replace_table(store.snapshot(rows(a="1", b="2", d="1"), first, "t2"), str(tmp_path / "kb"))
    got = {r.record_id: (r.version, r.first_seen, r.last_updated, r.change) for r in second.collect()}
    assert got == {"a": (1, "t1", "t1", "unchanged"), "b": (2, "t1", "t2", "changed"), "d": (1, "t2", "t2", "new")}
    meta = store.upsert(spark.createDataFrame([("k", "1"), ("m", "1")], "key string, value string"), spark.createDataFrame([("k", "2")], "key string, value string"))
    assert store.lookup(meta, "k") == "2" and store.lookup(meta, "none") == ""


def test_expand_has_unique_ids_and_no_dangling_references(spark):
    rows = [("k1", 1, "p#A", "x", ["k2"], ""), ("k2", 2, "p#A", "y", ["k1", "gone"], ""), ("k3", 3, "p#ESC-1", "z", [], "k1")]
    df = spark.createDataFrame(rows, "record_id string, ord int, source_ref string, content string, conflicts_with array<string>, duplicate_of string")
    got = {r.content: r for r in store.expand(df).collect()}
    ids = {r.record_id for r in got.values()}
    assert len(ids) == 3 and got["x"].conflicts_with == [got["y"].record_id] and set(got["y"].conflicts_with) == {got["x"].record_id, "gone"}
    assert got["z"].duplicate_of == got["x"].record_id and not got["z"].retrievable and got["x"].retrievable
    assert got["x"].record_id == "kb_" + hashlib.sha256(b"p#A").hexdigest()[:10] + "_00"
