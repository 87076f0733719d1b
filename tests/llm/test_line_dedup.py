"""Edit join and line dedup against brute force."""

import random
import string

import pytest
from pyspark.sql import functions as F

from veldrin.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edit(rng, s, n, letters=string.ascii_lowercase):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice(letters) + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i + 1 :]])
    return s


@pytest.mark.parametrize("errors", [1, 2, 3, 5])
def test_banded_distance(errors):
    rng = random.Random(errors)
    a, b = [], []
    for _ in range(800):
        s = "".join(rng.choice("abé") for _ in range(rng.randrange(0, 25)))
        a.append(s)
        b.append(edit(rng, s, rng.randrange(0, errors + 4), "abé"))
    want = [distance(x, y) <= errors for x, y in zip(a, b, strict=True)]
    assert ld.within(a, b, errors).tolist() == want
    trimmed = [ld._trim(x, y) for x, y in zip(a, b, strict=True)]
    assert ld.within([t[0] for t in trimmed], [t[1] for t in trimmed], errors).tolist() == want
    assert 100 < sum(want) < 790


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = ["".join(rng.choice(string.ascii_lowercase + "é ") for _ in range(rng.randrange(20, 70))).strip() for _ in range(15)]
    docs = []
    for i in range(n):
        lines = [rng.choice(["short", "", "  "]) if rng.random() < 0.3 else " " * rng.randrange(2) + edit(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 4])) for _ in range(rng.randrange(0, 7))]
        docs.append((i, "\n".join(lines) if rng.random() < 0.95 else None, "x"))
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_matches_brute_force(spark, seed):
    docs = corpus(seed)
    places = [(i, n, s.strip(" ")) for i, t, _ in docs if t is not None for n, s in enumerate(t.split("\n")) if s.strip(" ")]
    texts = sorted({p[2] for p in places})
    up = {t: t for t in texts}

    def top(t):
        while up[t] != t:
            t = up[t]
        return t

    for k, x in enumerate(texts):
        for y in texts[k + 1 :]:
            if distance(x, y) <= ld.ERRORS:
                up[top(y)] = top(x)
    first, drop = {}, {}
    for i, n, t in sorted(places):
        if top(t) in first:
            drop.setdefault(i, set()).add(n)
        else:
            first[top(t)] = (i, n)
    got = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, n_lines string").repartition(3)).collect()
    assert len(got) == len(docs) and sum(map(len, drop.values())) > 30
    for r in got:
        t = docs[r.doc_id][1]
        want = None if t is None else "\n".join(s for n, s in enumerate(t.split("\n")) if n not in drop.get(r.doc_id, ()))
        assert r.text == want and r.n_dropped == len(drop.get(r.doc_id, ()))


def test_keys_meet_within_errors():
    rng = random.Random(8)
    for _ in range(400):
        x = "".join(rng.choice("abcdé") for _ in range(rng.randrange(24, 60)))
        y = edit(rng, x, rng.randrange(0, 3), "abcdé")
        for errors in (2, 3):
            assert distance(x, y) > errors or ld.keys(x.encode(), errors) & ld.keys(y.encode(), errors)


def test_hot_line_nulls_and_empty(spark):
    same = "this very common line is in every single document"
    docs = [(None, same, 1), (5, same, 2), (5, same, 2), (3, None, 3), (4, "", 4)] + [(i, f"{same}\nunique line number {i} {'abc'[i % 3] * 30}{i * 7919}", i) for i in range(10, 300)]
    got = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string, key int"))
    rows = got.collect()
    assert got.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"] and len(rows) == len(docs)
    kept = [r.doc_id for r in rows if r.text and same in r.text]
    assert kept == [5, 5] and all(r.text == "" for r in rows if r.doc_id is None)
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_lines_match_brute_force(spark):
    rng = random.Random(3)
    docs = [(i, "\n".join("".join(rng.choice(string.ascii_letters + "éß漢") for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 8, 9, 11, 14, 23]))) for _ in range(rng.randrange(3)))) for i in range(60)]
    docs += [(100 + i, edit(rng, t, rng.randrange(3)).replace("\n", " ") if i % 2 else t) for i, t in docs]
    docs += [(300, "\t\n\r\n\t"), (301, "\r"), (302, "All rights reserved.\n\t"), (303, " All rights reserved."), (304, "All right reserved")]
    places = [(i, n, s.strip(" ")) for i, t in docs for n, s in enumerate(t.split("\n")) if s.strip()]
    texts = sorted({p[2] for p in places})
    comp = {t: {t} for t in texts}
    for k, x in enumerate(texts):
        for y in texts[k + 1 :]:
            if comp[x] is not comp[y] and distance(x, y) <= 2:
                comp[x] |= comp[y]
                comp.update(dict.fromkeys(comp[y], comp[x]))
    seen, drop = set(), {}
    for i, n, t in sorted(places):
        if id(comp[t]) in seen:
            drop.setdefault(i, set()).add(n)
        seen.add(id(comp[t]))
    got = ld.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    by_id = dict(docs)
    assert len(got) == len(docs) and len({id(c) for c in comp.values()}) > 15
    for r in got:
        assert r.text == "\n".join(s for n, s in enumerate(by_id[r.doc_id].split("\n")) if n not in drop.get(r.doc_id, ()))
    assert {303, 304} <= set(drop) and not {300, 301} & set(drop)


def test_keys_meet_at_every_length():
    rng = random.Random(9)
    for _ in range(3000):
        x = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 24)))
        y = edit(rng, x, rng.randrange(0, 4), "abcd")
        for errors in (1, 2, 3):
            assert not y or distance(x, y) > errors or ld.keys(x.encode(), errors) & ld.keys(y.encode(), errors)


def test_counts_of_characters_never_rule_out_a_link(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(500):
        x = "".join(rng.choice(string.ascii_lowercase + "é漢") for _ in range(rng.randrange(1, 40)))
        rows.append((x, edit(rng, x, rng.randrange(0, 6), "abcdé")))
    flat = spark.createDataFrame([(s.encode(), k, c) for k, r in enumerate(rows) for c, s in zip("xy", r)], "_line binary, k int, side string").select(F.lit(b"").alias("_d"), F.array(F.col("k").cast("long")).alias("keys"), "_line", F.col("side"))
    got = []
    for side in "xy":
        done = flat.where(F.col("side") == side).drop("side").mapInArrow(ld._sketch, "_d binary, keys array<long>, _line binary, _len int, counts array<int>")
        got.append(done.select(F.get("keys", F.lit(0)).alias(side), F.col("_len").alias(f"{side}len"), *[F.get("counts", F.lit(i)).alias(f"{side}c{i}") for i in range(ld.CLASSES)]))
    both = got[0].join(got[1], F.col("x") == F.col("y")).select("x", ld._possible(lambda c: F.col("x" + c), lambda c: F.col("y" + c), 2).alias("ok")).collect()
    assert len(both) == 500 and all(r.ok for r in both if distance(*rows[r.x]) <= 2) and sum(not r.ok for r in both) > 50


def test_white_space_clashing_names_and_ties(spark):
    line = "the same line stands between all kinds of white space"
    docs = [(1, line, "a", 1, 1), (2, f"\t{line}\t\r\n{line}\x0b", "b", 2, 2), (3, f"{line}\u00a0\u00a0\u00a0", "c", 3, 3), (4, "x" * 100_000 + "\ny", None, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, _drop string, _i int, `row.key` int")
    df = df.withColumns({c: F.lit(7) for c in ("_h", "_di", "_dh", "_n", "_d", "_line", "row", "key", "keys", "_text", "_lines", "_k", "N_Lines")})
    got = {r.doc_id: r for r in ld.dedup_lines(df).collect()}
    assert ld.dedup_lines(df).columns == [*df.columns[:-1], "n_lines", "n_dropped"]
    assert got[1].text == line and got[2].text == "" and got[2].n_dropped == 2 and got[2]["row.key"] == 2 and got[2]._drop == "b"
    assert got[3].text == docs[2][1] and got[4].text == docs[3][1] and got[4].n_lines == 2


def test_large_family_of_far_variants(spark):
    """Many lines share segments, few are within two edits: all links are found, and only those."""
    rng = random.Random(6)
    base = " ".join("".join(rng.choice("etaoinshr") for _ in range(5)) for _ in range(40))
    lines = []
    for _ in range(300):
        at = rng.randrange(len(base))
        lines.append(base[:at] + "".join(rng.choice(string.ascii_lowercase) for _ in range(4)) + base[at:])
    lines += [edit(rng, s, 2) for s in lines[:20]]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    got = {r.doc_id for r in ld.dedup_lines(df).where("n_dropped = 1").collect()}
    pairs = [(i, j) for i, x in enumerate(lines) for j in range(i) if abs(len(x) - len(lines[j])) <= 2]
    near = ld.within(*([t[k] for t in (ld._trim(lines[i], lines[j]) for i, j in pairs)] for k in (0, 1)), 2)
    up = list(range(len(lines)))
    for (i, j), ok in zip(pairs, near, strict=True):
        if ok and up[i] != up[j]:
            a, b = up[i], up[j]
            up = [min(a, b) if u in (a, b) else u for u in up]
    assert got == {i for i in range(len(lines)) if up[i] != i} and len(got) >= 20
