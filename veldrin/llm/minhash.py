"""Near-duplicate documents: min-max hashing over word shingles, banded, with links confirmed on full sets.

A document's set holds its distinct shingles of `words` words (a shorter document's whole sequence is its only
shingle). Each of PERMUTATIONS hash functions is evaluated once per shingle and gives two signature values, the minimum
and the maximum, each of which agrees for two sets with probability equal to their Jaccard similarity. Bands of
three functions (six values) are bucket keys: at similarity 0.8 a pair shares none of the BANDS keys with probability
(1 - 0.8**6)**BANDS, below 1e-6, if its sets are large; a
minimum and a maximum over few shingles aren't independent, and of 4 shared among 5 it is about 3e-6. Documents with equal sets are one class; the classes' smallest ids are linked as in
linking.py, and every link is confirmed exactly: 100 * intersection >= 80 * union of the full sets.

Defined results: a document without text or words has an empty set and is linked with nothing. Words are runs of
anything but space and \\x09-\\x0D with A-Z in lower case. Rows that repeat an id are one document if their texts are
equal too; ids should be unique otherwise. Null ids take no part (component null, kept). Empty tables give empty
results. Texts are read whole; memory in a Python worker is that of its longest text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, discard, stage, text_slices
from .linking import link, shared_buckets

BANDS = 52
ROWS = 3  # functions in a band, each with a minimum and a maximum
PERMUTATIONS = BANDS * ROWS
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 64, PERMUTATIONS, np.uint64)
_MUL = _rng.integers(0, 1 << 64, PERMUTATIONS, np.uint64) | np.uint64(1)
CHUNK = 1 << 14
#: Ranges of the hash space whose occupation bounds intersections.
PLACES = 2048


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    found = text.lower().split() if text else []
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i])
    out.sort()
    return out[np.concatenate([[True], out[1:] != out[:-1]])]


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(2 * PERMUTATIONS, sets): minima and maxima of each function; sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = np.concatenate(sets)
    out = np.empty((2 * PERMUTATIONS, len(sets)), np.uint64)
    buffer = np.empty_like(x)
    for p in range(PERMUTATIONS):
        np.bitwise_xor(x, _XOR[p], out=buffer)
        np.multiply(buffer, _MUL[p], out=buffer)
        out[2 * p] = np.minimum.reduceat(buffer, starts)
        out[2 * p + 1] = np.maximum.reduceat(buffer, starts)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(sets, BANDS) bucket keys."""
    out = np.empty((sig.shape[1], BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(sig.shape[1], b + 1, np.uint64)
        for row in sig[2 * ROWS * b : 2 * ROWS * (b + 1)]:
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + row)
        out[:, b] = key
    return out


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def _sign(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """(id, n, digest, keys) of (id, text)."""
    for batch, texts in text_slices(batches, 1, 1 << 18):
        sets = [shingle_set(t, words) for t in texts]
        full = [i for i, s in enumerate(sets) if len(s)]
        keys: list = [None] * len(sets)
        lo = 0
        while lo < len(full):
            hi, total = lo, 0
            while hi < len(full) and (hi == lo or total + len(sets[full[hi]]) <= CHUNK):
                total += len(sets[full[hi]])
                hi += 1
            for i, row in zip(full[lo:hi], band_keys(signatures([sets[i] for i in full[lo:hi]])).view(np.int64), strict=True):
                keys[i] = row
            lo = hi
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            names=["id", "n", "digest", "keys"])


def near_duplicates(docs: DataFrame, words: int = 5, id_col: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row. percent: least Jaccard similarity; bands are made for 80 and more."""
    spark = docs.sparkSession
    if percent < 80:
        raise ValueError("bands are dimensioned for a similarity of 0.8 or more")
    texts = docs.select(F.col(id_col).cast("long").alias("id"), as_utf8(text).alias("text"))
    signed = stage(texts.mapInArrow(lambda it: _sign(it, words), "id long, n long, digest binary, keys array<long>"), "signed")
    classes = stage(signed.where("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = signed.join(classes.select("rep"), F.col("id") == F.col("rep"), "left_semi").where("digest is not null").dropDuplicates(["id"])
    members = stage(shared_buckets(reps.select(F.explode("keys").alias("key"), "id")), "buckets")
    wanted = members.groupBy(F.col("id").alias("_w")).agg(F.collect_set("key").alias("keys"))  # BANDS keys at most
    sets = stage(
        texts.join(wanted, F.col("id") == F.col("_w")).dropDuplicates(["id"]).select("id", "text", "keys")
        .mapInArrow(lambda it: _sets(it, words), "id long, keys array<long>, n long, items array<long>, bits array<long>"), "sets")

    def confirm(pairs: DataFrame) -> DataFrame:
        left = sets.select(F.col("id").alias("_i"), F.col("n").alias("na"), F.col("items").alias("sa"))
        right = sets.select(F.col("id").alias("_j"), F.col("n").alias("nb"), F.col("items").alias("sb"))
        both = pairs.join(right, F.col("b") == F.col("_j")).join(left, F.col("a") == F.col("_i"))
        both = both.withColumn("k", F.size(F.array_intersect("sa", "sb")))
        return both.where(100 * F.col("k") >= percent * (F.col("na") + F.col("nb") - F.col("k"))).select("a", "b")

    words_of = [F.get("bits", F.lit(i)).alias(f"w{i}") for i in range(PLACES // 64)]
    sketches = sets.select("id", "keys", "n", F.aggregate("bits", F.lit(0), lambda s, w: s + F.bit_count(w)).alias("places"), *words_of)
    found = link(members, confirm, sketches, lambda x, y: _possible(x, y, percent))
    if found is None:
        comps = classes.select(F.col("digest").alias("_d"), F.col("rep").alias("comp"))
    else:
        comps = classes.join(found.withColumnRenamed("id", "_i"), F.col("rep") == F.col("_i"), "left").select(F.col("digest").alias("_d"), F.coalesce("component", "rep").alias("comp"))
    out = signed.join(comps, F.col("digest") == F.col("_d"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("comp", "id"))
    done = out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
    for t in (members, sets):
        discard(t)
    return done.withColumnRenamed("id", id_col)


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in text_slices(batches, 1):
        sets = [shingle_set(t, words) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), pa.array([occupied(s) for s in sets], pa.list_(pa.int64()))],
            names=["id", "keys", "n", "items", "bits"])


def occupied(s: np.ndarray) -> np.ndarray:
    """A bit for each of PLACES ranges of the hashes that holds an item of the set."""
    bits = np.zeros(PLACES, np.uint8)
    bits[(s >> np.uint64(64 - PLACES.bit_length() + 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.int64)


def _possible(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """Whether two sets can be similar enough: each range occupied in one set only hides an item that the other lacks,
    which bounds their intersection from above. No link is ruled out."""
    either = reduce(add, [F.bit_count(x(f"w{i}").bitwiseOR(y(f"w{i}"))) for i in range(PLACES // 64)])
    k = F.least(x("n") - (either - y("places")), y("n") - (either - x("places")))
    sizes = 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))
    return sizes & (100 * k >= percent * (x("n") + y("n") - k))
