"""Line dedup by a segment-partition edit join: of lines within `errors` edits of each other, the first stays.

Lines (between line feeds, without white space around them) that aren't blank take part, however short. Equal lines are
one node, under a 128-bit digest. Of two lines within `errors` edits, cut the shorter into errors + 1 segments: one of
them occurs in the other unchanged, at a place that differs by no more than the length difference and the segment's
number allow. So every line is indexed under its segments, and probes, for each length down to its own less `errors`,
the substrings at those places: (length, segment number, substring) is the bucket key. If the shorter line is so short
that segments are none or of a character or two, the key is what up to `errors` deletions leave of a line: two lines
within `errors` edits have one such rest in common. Keys and digests are made in Arrow batches and written once; only
lines that share a key with another line have their texts fetched. Buckets are linked as in linking.py: counts of a
line's characters bound the distance from below while pairs are joined, and what is left is verified by a banded
bit-parallel edit distance over batches of pairs. Of each component the line that comes first, by id and place, stays;
all others go from the texts, with their line feeds. So lines of at most `errors` characters are all one component.

Defined results: null and empty texts stay as they are; a text of which every line that isn't blank goes becomes empty,
and `n_dropped` counts lines. White space is what separates words: space and \\x09-\\x0D. Ids should be unique: rows
that repeat id and text count as one place and get one result. Null ids come last. Empty tables give empty results.
Other columns pass through whatever their names, save n_lines and n_dropped, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cleared, discard, packed, quoted, stage, text_slices, unpacked
from .linking import link

ERRORS = 2
#: Classes of characters that are counted to bound distances.
CLASSES = 32


@lru_cache(1 << 13)
def places(length: int, errors: int) -> tuple[tuple[int, int, int], ...]:
    """(seed, start, end) of the index and probe substrings of a line. The seed tells segment number and indexed length.

    A line of n characters has errors + 1 segments of n // (errors + 1), the last ones longer by one. Pairs whose
    shorter line has under 3 characters a segment meet under `rests` instead.
    """
    k, out = errors + 1, []
    for d in range(errors + 1):
        shorter = length - d
        if shorter < 3 * k:
            break
        base, short_ones = shorter // k, k - shorter % k
        for i in range(k):
            start, size = i * base + max(0, i - short_ones), base + (i >= short_ones)
            for s in range(max(-i, d - (k - 1 - i)), min(i, d + (k - 1 - i)) + 1):
                if 0 <= start + s and start + s + size <= length:
                    out.append((shorter * k + i + 1, start + s, start + s + size))
    return tuple(out)


def rests(line: str, errors: int) -> set[str]:
    """What is left of a line after up to `errors` deletions, itself included."""
    out = {line}
    for _ in range(errors):
        out |= {s[:i] + s[i + 1 :] for s in out for i in range(len(s))}
    return out


def keys(line: bytes, errors: int) -> set[int]:
    """The line's index keys and its probe keys, by hashes of 64 bits."""
    if line.isascii():
        n = len(line)
        out = {xxhash.xxh64_intdigest(line[a:b], seed) for seed, a, b in places(n, errors)}
        short = line.decode() if n < 3 * (errors + 1) + errors else None
    else:
        text = line.decode("utf-8", "surrogateescape")
        n = len(text)
        out = {xxhash.xxh64_intdigest(text[a:b].encode("utf-8", "surrogateescape"), seed) for seed, a, b in places(n, errors)}
        short = text if n < 3 * (errors + 1) + errors else None
    if short is not None:
        out |= {xxhash.xxh64_intdigest(r.encode("utf-8", "surrogateescape")) for r in rests(short, errors)}
    return out


def _lines(text: bytes) -> Iterator[tuple[int, bytes]]:
    for n, line in enumerate(text.split(b"\n")):
        line = line.strip()  # of bytes: space and \x09-\x0D
        if line:
            yield n, line


def _index(batches: Iterator[pa.RecordBatch], errors: int) -> Iterator[pa.RecordBatch]:
    """(_i, _h, _n, _d, keys) of (_i, _h, text): a row for each line that isn't blank."""
    for batch, texts in text_slices(batches, 2):
        rows, numbers, digests, sizes, flat = [], [], [], [], []
        for row, text in enumerate(texts):
            for n, line in _lines(text):
                found = keys(line, errors)
                rows.append(row)
                numbers.append(n)
                digests.append(xxhash.xxh3_128_digest(line))
                sizes.append(len(found))
                flat.extend(found)
        at = pa.array(rows, pa.int64())
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        every = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.array(flat, np.uint64).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(numbers, pa.int32()), pa.array(digests, pa.binary()), every], names=["_i", "_h", "_n", "_d", "keys"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_d, _line) of (text): a text's distinct lines that aren't blank."""
    for _, texts in text_slices(batches, 0):
        found = {xxhash.xxh3_128_digest(line): line for text in texts for _, line in _lines(text)}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.binary())], names=["_d", "_line"])


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_d, keys, _line, _len, counts) of (_d, keys, _line): the line's length and its characters counted by class."""
    for batch in batches:
        points = [np.frombuffer(x.decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4") for x in batch.column(2).to_pylist()]
        counts = [np.bincount(p % CLASSES, minlength=CLASSES).astype(np.int32) for p in points]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(p) for p in points], pa.int32()), pa.array(counts, pa.list_(pa.int32()))], names=["_d", "keys", "_line", "_len", "counts"])


def _possible(x, y, errors: int) -> Column:
    """An edit changes the length by one at most, and the counts of two characters by one each at most."""
    apart = sum((F.abs(x(f"c{i}") - y(f"c{i}")) for i in range(1, CLASSES)), F.abs(x("c0") - y("c0")))
    return (F.abs(x("len") - y("len")) <= errors) & (apart <= 2 * errors)


def within(a: list[str], b: list[str], errors: int) -> np.ndarray:
    """Whether each pair's edit distance is at most `errors`: bit-parallel over a band around the diagonal.

    A word a pair holds the vertical differences of the band's cells in one column; the band's lowest cell, `errors`
    below the diagonal, has its value kept. The band moves down a row with each character of the longer string, and
    all pairs advance together.
    """
    if not a:
        return np.zeros(0, bool)
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    short, long = (np.array([len(p[s]) for p in pairs]) for s in (0, 1))
    bits = 2 * errors + 2
    width = int(long.max()) + bits

    def codes(s: int, pad: int, shift: int) -> np.ndarray:
        out = np.full((len(pairs), width), pad, np.int32)
        for row, p in enumerate(pairs):
            out[row, shift : shift + len(p[s])] = np.frombuffer(p[s].encode("utf-32-le", "surrogatepass"), "<i4")
        return out

    down, across = codes(0, -1, bits - 1 - errors), codes(1, -2, 0)
    one, top, full = np.uint64(1), np.uint64(bits - 1), np.uint64((1 << bits) - 1)
    # In column j, bit r stands for row j + errors - (bits - 1) + r. Column 0 rises by one a row from row 0 on.
    vp = np.full(len(pairs), ((1 << (errors + 1)) - 1) << (bits - errors - 1), np.uint64)
    vn = np.zeros(len(pairs), np.uint64)
    lowest = np.full(len(pairs), errors, np.int64)
    final = np.where(long == 0, 0, errors + 1)
    for j in range(1, int(long.max()) + 1):
        c = across[:, j - 1]
        same = np.zeros(len(pairs), np.uint64)
        for r in range(bits):
            same |= (down[:, j - 1 + r] == c).astype(np.uint64) << np.uint64(r)
        d0 = ((((same & vp) + vp) & full) ^ vp) | same | vn
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        lowest += 1 - (d0 >> top).astype(np.int64)
        moved = d0 >> one
        vp, vn = (hn | ~(moved | hp)) & full, moved & hp
        done = long == j
        if done.any():  # up from the lowest cell, in row j + errors, to the row of the short string's end
            at = lowest.copy()
            for k in range(2 * errors):
                bit = np.uint64(bits - 2 - k)
                rise = ((vp >> bit) & one).astype(np.int64) - ((vn >> bit) & one).astype(np.int64)
                at -= np.where(j + errors - k > short, rise, 0)
            final = np.where(done, at, final)
    return (long - short <= errors) & (final <= errors)


def _verify(batches: Iterator[pa.RecordBatch], errors: int) -> Iterator[pa.RecordBatch]:
    """(a, b) of (a, b, x, y) whose lines x and y are close; pairs of like length advance together."""
    for batch in batches:
        x, y = ([s.decode("utf-8", "surrogateescape") for s in batch.column(k).to_pylist()] for k in (2, 3))
        order = sorted(range(len(x)), key=lambda i: len(x[i]))
        ok = np.zeros(len(x), bool)
        lo = 0
        while lo < len(order):
            hi, most = lo, 0
            while hi < len(order) and (hi == lo or (hi + 1 - lo) * len(x[order[hi]]) < 1_000_000):
                hi += 1
            part = order[lo:hi]
            trimmed = [_trim(x[i], y[i]) for i in part]
            ok[part] = within([t[0] for t in trimmed], [t[1] for t in trimmed], errors)
            lo = hi
        yield batch.filter(pa.array(ok)).select([0, 1])


def _trim(x: str, y: str) -> tuple[str, str]:
    """Without the common beginning and end, which edits needn't touch."""
    lo, most = 0, min(len(x), len(y))
    step = most
    while step:  # by halving steps: compares slices, not characters
        if x[lo : lo + step] == y[lo : lo + step]:
            lo += step
        step = min(step // 2, most - lo) if step > 1 else 0
    x, y = x[lo:], y[lo:]
    hi, most = 0, min(len(x), len(y))
    step = most
    while step:
        if x[len(x) - hi - step : len(x) - hi] == y[len(y) - hi - step : len(y) - hi]:
            hi += step
        step = min(step // 2, most - hi) if step > 1 else 0
    return x[: len(x) - hi], y[: len(y) - hi]


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", errors: int = ERRORS) -> tuple[DataFrame, DataFrame]:
    """(_i, _h, _drop: the numbers of the lines to drop) for each document with any, and (digest, class digest) of lines
    in classes of several."""
    place = ["_i", "_h", "_n"]
    body = docs.select(F.coalesce(quoted(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_i"), F.xxhash64(quoted(text)).alias("_h"), quoted(text).cast("binary").alias("_text")).where("_text is not null")
    lines = stage(body.mapInArrow(lambda it: _index(it, errors), "_i long, _h long, _n int, _d binary, keys array<long>"), "lines")
    # A key counts if two lines have it: then the smallest and the largest of their hashes differ.
    by_key = lines.select(F.explode("keys").alias("key"), F.xxhash64("_d").alias("_g"))
    hit = stage(by_key.groupBy("key").agg(F.min("_g").alias("_lo"), F.max("_g").alias("_hi")).where("_lo <> _hi").select(F.col("key").alias("_k")), "keys")
    # The keys hit and the lines wanted grow with the corpus, so these two joins merge at every size.
    found = by_key.join(hit.hint("merge"), F.col("key") == F.col("_k"), "left_semi")
    wanted = stage(found.groupBy("_g").agg(F.collect_set("key").alias("keys")), "wanted")  # a set of the line's own keys
    texts = body.select("_text").mapInArrow(_texts, "_d binary, _line binary").withColumn("_e", F.xxhash64("_d"))
    near = texts.join(wanted.hint("merge"), F.col("_g") == F.col("_e")).groupBy("_d").agg(F.any_value("keys").alias("keys"), F.any_value("_line").alias("_line"))
    # numbers are given as the table is written, so they are settled for all that reads it
    near = stage(near.mapInArrow(_sketch, "_d binary, keys array<long>, _line binary, _len int, counts array<int>").withColumn("_no", F.monotonically_increasing_id()), "near")
    members = stage(near.select(F.explode("keys").alias("key"), F.col("_no").alias("id")), "buckets")
    sketches = near.select(F.col("_no").alias("id"), "keys", F.col("_len").alias("len"), *[F.get("counts", F.lit(i)).alias(f"c{i}") for i in range(CLASSES)])

    def confirm(pairs: DataFrame) -> DataFrame:
        x, y = (near.select(F.col("_no").alias(f"_{c}"), F.col("_line").alias(c)) for c in "xy")
        both = pairs.join(y, F.col("b") == F.col("_y")).join(x, F.col("a") == F.col("_x"))
        return both.select("a", "b", "x", "y").mapInArrow(lambda it: _verify(it, errors), "a long, b long")

    comps = link(members, confirm, sketches, lambda x, y: _possible(x, y, errors))
    if comps is None:
        classes = docs.sparkSession.createDataFrame([], "digest binary, class binary")
        named = lines.select(*place, F.col("_d").alias("_c"))
    else:
        digests = near.select("_no", "_d")
        classes = comps.join(digests, F.col("id") == F.col("_no")).select(F.col("_d").alias("digest"), "component").join(digests, F.col("component") == F.col("_no")).select("digest", F.col("_d").alias("class"))
        classes = stage(classes, "classes")
        discard(comps)
        named = lines.join(classes, F.col("_d") == F.col("digest"), "left").select(*place, F.coalesce("class", "_d").alias("_c"))
    firsts = named.groupBy("_c").agg(F.min(F.struct(*place)).alias("_f"), F.max(F.struct(*place)).alias("_l")).where("_f <> _l")
    firsts = stage(firsts.select(F.col("_c").alias("_k"), "_f"), "firsts")
    drops = named.join(firsts, F.col("_c") == F.col("_k")).where(F.struct(*place) != F.col("_f"))
    drops = stage(drops.groupBy(F.col("_i").alias("_di"), F.col("_h").alias("_dh")).agg(F.collect_set("_n").alias("_drop")), "drops")
    for t in (lines, hit, wanted, members, near, firsts):
        discard(t)
    return drops, classes


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", errors: int = ERRORS) -> DataFrame:
    """docs with their texts without dropped lines, and n_lines and n_dropped."""
    docs = cleared(docs, ["n_lines", "n_dropped"])
    drops, _ = duplicate_lines(docs, id_col, text, errors)
    rows = packed(docs, F.coalesce(quoted(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("_i"), F.xxhash64(quoted(text)).alias("_h"), quoted(text).alias("_text"))
    rows = rows.join(drops, (F.col("_i") == F.col("_di")) & (F.col("_h") == F.col("_dh")), "left").withColumn("_lines", F.split("_text", "\n", -1))
    left = F.filter("_lines", lambda line, n: ~F.array_contains("_drop", n))
    rest = F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(F.array_join(left, "\n"))
    rows = rows.select("row", rest.alias("_rest"), F.coalesce(F.size("_lines"), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("_drop"), F.lit(0)).cast("long").alias("n_dropped"))
    out = [F.col("_rest").alias(c) if c == text else v for c, v in zip(docs.columns, unpacked(docs.columns), strict=True)]
    return rows.select(*out, "n_lines", "n_dropped")
