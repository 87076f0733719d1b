"""Hard negatives: integer inner products of a stated set of anchors with all rows, by bit planes of the rows.

Components are floor(256 * x). A row's component in two's complement is a sum of bit planes; a plane times the anchors'
integers is one matrix product. Planes are taken most significant first. After each, what the missing planes can still
add lies between the sums of an anchor's negative and of its positive components times 2**left - 1, so every pair has an
interval that its score lies in; pairs whose interval can't qualify are dropped. When few are left, the remaining planes
are multiplied for these alone. Scores are exact integers, and every row is held against every anchor.

Rows are packed in Arrow batches where they are read, anchors in blocks of about ANCHORS by a hash. A row block meets
each anchor block in a join on the anchor block's number, whose anchors' side is broadcast up to SENT bytes (they are
counted first) and shuffled beyond. A task keeps an anchor's best rows while its blocks pass, so thresholds tighten from
block to block and a task emits a few rows an anchor; a window over these gives the result.

1. An anchor's positives are its best rows of the same label, by score, then smaller id.
2. A positive opens a score window. A negative has another label and a score in it; the best of each window are kept.

Defined results: rows with a null id, a null label, a null vector, or null or non-finite components take no part. Rows
with vectors of different lengths are not compared; empty vectors score 0 with each other. Rows that share an id are
never each other's positives or negatives and count once each; an anchor that is repeated exactly is one anchor. Equal
scores come by smaller id. Components whose 256-fold is finite are exact, others are not finite; a score beyond the range of long is given as the
nearest long, after ranking. Windows of positives with a negative score are empty. Extra columns are dropped. Empty
tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, quoted, stage

ANCHORS = 2048
ROWS = 4096
#: Bytes of packed anchors up to which they are broadcast.
SENT = 16 << 20
#: Anchor blocks whose best rows a task holds at once; beyond, it emits and forgets them.
HELD = 16
POSITIVES, NEGATIVES = 5, 3
#: A negative's score in hundredths of its positive's, least and most.
LEAST, MOST = 50, 95
LONG = 2**63 - 1
#: More than any score: added to one, it gives digits that sort as the score does.
_BEYOND = 10**640
_BLOCK = "anchors: binary, labels: binary, n: int, dim: int, vectors: binary"


def relabelled(vec_id: Column, label: Column) -> Column:
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def usable(df: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """(id, label, v) of the rows that take part; v holds floor(256 * x) in double precision, where whole numbers of that size are exact."""
    rows = df.select(quoted(vec_id).cast("long").alias("id"), label.cast("long").alias("label"), quoted(vector).cast("array<double>").alias("v"))
    fit = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256) < float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fit)


def _whole(values: np.ndarray) -> np.ndarray:
    """floor(256 * x): int64, or Python's integers where a square could leave that range."""
    out = np.floor(values * 256.0)
    return out.astype(np.int64) if not out.size or np.abs(out).max() < 2**26 else np.array([int(f) for f in out], object)


def _pack(most: int):
    """Arrow batches of (id, label, v) to rows of at most `most` vectors of one length, label by label."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, vectors = (batch.column(c) for c in range(3))
            ids, labels = ids.to_numpy(zero_copy_only=False), labels.to_numpy(zero_copy_only=False)
            sizes = pa.compute.list_value_length(vectors).to_numpy(zero_copy_only=False)
            flat, ends = vectors.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes, dtype=np.int64)
            rows = []
            for dim in np.unique(sizes):
                own = np.flatnonzero(sizes == dim)
                own = own[np.lexsort((ids[own], labels[own]))]
                for lo in range(0, len(own), most):
                    at = own[lo : lo + most]
                    wide = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                    rows.append((ids[at].tobytes(), labels[at].tobytes(), len(at), int(dim), wide.tobytes()))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["anchors", "labels", "n", "dim", "vectors"])

    return packed


def surviving(rows: np.ndarray, anchors: np.ndarray, allowed: np.ndarray, least: np.ndarray, most: np.ndarray | None = None, best: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, score) of the allowed pairs whose score is at least the anchor's `least` and at most its `most`.

    rows: (r, d), anchors: (a, d) integers; allowed: (r, a). best: pairs that surely aren't among an anchor's so many
    best are dropped too; then ties of the last one's score stay.
    """
    dim, wide = anchors.shape[1], object in (rows.dtype, anchors.dtype)
    if not dim or not len(rows):
        r, a = np.nonzero(allowed & (least <= 0) & (True if most is None else most >= 0))
        return r, a, np.zeros(len(r), np.int64)
    bits = max(int(max(rows.max(), -rows.min() - 1)).bit_length(), 0) + 1
    top = int(max(anchors.max(), -anchors.min()))
    whole = object if wide or dim * top * 2**bits >= 2**53 else np.float32 if dim * top * 2**bits < 2**24 else np.float64
    up, down = np.maximum(anchors, 0).sum(1).astype(whole), np.minimum(anchors, 0).sum(1).astype(whole)
    other, low, high = anchors.T.astype(whole), least.astype(whole), None if most is None else most.astype(whole)

    def plane(values: np.ndarray, left: int) -> np.ndarray:
        """The plane's bits times its weight; the first plane's is negative."""
        return ((values >> left) & 1).astype(whole) * whole(-(2**left) if left == bits - 1 else 2**left) if whole is not object else ((values >> left) & 1) * (-(2**left) if left == bits - 1 else 2**left)

    sums, alive = np.zeros(allowed.shape, whole), allowed.copy()
    left = bits
    while left and np.count_nonzero(alive) * 8 > alive.size:
        left -= 1
        sums += plane(rows, left) @ other
        rest = 2**left - 1
        alive &= sums + up * rest >= low
        if high is not None:
            alive &= sums + down * rest <= high
        if best and len(rows) > best:
            sure = np.where(alive, sums + down * rest, -np.inf if whole is not object else -_BEYOND)
            low = np.maximum(low, np.partition(sure, len(rows) - best, axis=0)[len(rows) - best])
            alive &= sums + up * rest >= low
    r, a = np.nonzero(alive)
    score = sums[r, a]
    while left and len(r):
        left -= 1
        score = score + np.concatenate([(plane(rows[r[i : i + 65536]], left) * anchors[a[i : i + 65536]].astype(whole)).sum(1) for i in range(0, len(r), 65536)])
        rest = 2**left - 1
        keep = score + up[a] * rest >= low[a]
        if high is not None:
            keep &= score + down[a] * rest <= high[a]
        r, a, score = r[keep], a[keep], score[keep]
    return r, a, score.astype(np.int64) if whole is not object else score


def _best(group: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Positions of each group's first rows by score, then smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[rank < most]


def _long(x) -> int:
    return max(-LONG - 1, min(LONG, int(x)))


class _Kept:
    """An anchor block and the best rows of each of its slots so far: an anchor's, or those of one of its windows."""

    def __init__(self, row: dict, windows: int):
        self.ids = np.frombuffer(row["a_anchors"], np.int64)
        self.labels = np.frombuffer(row["a_labels"], np.int64)
        self.vectors = _whole(np.frombuffer(row["a_vectors"], np.float64)).reshape(len(self.ids), row["a_dim"])
        n = len(self.ids)
        if windows:
            self.low = np.array([int(x) for x in row["a_low"]], object).reshape(n, windows)
            self.high = np.array([int(x) for x in row["a_high"]], object).reshape(n, windows)
        self.slot, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray, most: int) -> None:
        slot, score, ids = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.id, ids]
        at = _best(slot, score, ids, most)
        self.slot, self.score, self.id = slot[at], score[at], ids[at]

    def threshold(self, slots: int, most: int) -> np.ndarray:
        """A slot's last kept score if it is full; where it isn't, less than any score."""
        out = np.full(slots, -_BEYOND, object)
        full = np.flatnonzero(np.bincount(self.slot, minlength=slots) == most)
        if len(full):
            ends = np.searchsorted(self.slot, full, side="right") - 1  # add() leaves slots in order
            out[full] = self.score[ends]
        return out


def _narrow(x: np.ndarray) -> np.ndarray:
    """int64 where it holds the values: bounds beyond any score of such a block are cut to its range."""
    return np.clip(x, -(2**62), 2**62).astype(np.int64)


def _positives(kept: _Kept, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
    n = len(kept.ids)
    least = kept.threshold(n, POSITIVES)
    if object not in (vectors.dtype, kept.vectors.dtype):
        least = _narrow(least)
    found = []
    for label in np.intersect1d(labels, kept.labels):
        lo, hi = np.searchsorted(labels, [label, label + 1])  # rows lie label by label
        own = np.flatnonzero(kept.labels == label)
        r, a, s = surviving(vectors[lo:hi], kept.vectors[own], ids[lo:hi, None] != kept.ids[None, own], least[own], best=POSITIVES)
        found.append((own[a], s, ids[lo:hi][r]))
    if found:
        kept.add(*(np.concatenate(c) for c in zip(*found, strict=True)), POSITIVES)


def _negatives(kept: _Kept, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
    n, windows = kept.low.shape
    low = np.maximum(kept.low, kept.threshold(n * windows, NEGATIVES).reshape(n, windows))
    high = kept.high
    if object not in (vectors.dtype, kept.vectors.dtype):
        low, high = _narrow(low), _narrow(high)
    open_ = low <= high
    some = np.flatnonzero(open_.any(1))
    if not len(some):
        return
    over = 2**62 if low.dtype == np.int64 else _BEYOND
    least, most = np.where(open_, low, over)[some].min(1), np.where(open_, high, -over)[some].max(1)
    r, a, s = surviving(vectors, kept.vectors[some], (labels[:, None] != kept.labels[None, some]) & (ids[:, None] != kept.ids[None, some]), least, most)
    a = some[a]
    fits = (s[:, None] >= low[a]) & (s[:, None] <= high[a])
    pair, w = np.nonzero(fits)
    kept.add(a[pair] * windows + w, s[pair], ids[r[pair]], NEGATIVES)


def _mined(windows: int):
    """Joined blocks to (block, place, slot, score, id) rows: the best that this task's rows give."""

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, _Kept] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for block, k in held.items():
                at = k.slot // windows if windows else k.slot
                beyond = [f"{_BEYOND + int(x):0642d}" if abs(int(x)) > LONG else None for x in k.score] if k.score.dtype == object else [None] * len(at)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(at), block), pa.int64()), pa.array(at, pa.int32()), pa.array(k.slot % windows if windows else np.zeros(len(at)), pa.int32()),
                    pa.array([_long(x) for x in k.score], pa.int64()), pa.array(beyond, pa.string()), pa.array(k.id, pa.int64())], names=["block", "place", "slot", "score", "beyond", "id"])
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: v[0] for k, v in batch.slice(i, 1).to_pydict().items()}
                block = row["block"]
                if block not in held:
                    if len(held) >= HELD:
                        yield from emit()
                    held[block] = _Kept(row, windows)
                ids, labels = np.frombuffer(row["anchors"], np.int64), np.frombuffer(row["labels"], np.int64)
                vectors = _whole(np.frombuffer(row["vectors"], np.float64)).reshape(row["n"], row["dim"])
                (_negatives if windows else _positives)(held[block], ids, labels, vectors)
        yield from emit()

    return mine


def _ranked(found: DataFrame, slot: list[str], most: int) -> DataFrame:
    """Each slot's best rows over all tasks. `beyond` is null but for scores out of the range of long, and sorts as they do."""
    key = [F.col("score").desc(), F.col("beyond").desc(), F.col("id").asc()]
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*slot).orderBy(*key))).where(F.col("rank") <= most)


def mine(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label", anchor: Column | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors: ids divisible by 50 unless given, on columns id, label, v."""
    rows = usable(df, vec_id, vector, quoted(label) if isinstance(label, str) else label)
    anchors = stage(rows.where(F.col("id") % 50 == 0 if anchor is None else anchor).distinct(), "anchors")
    size = anchors.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // ANCHORS))
    sent = F.broadcast if 8 * size[1] + 100 * size[0] <= SENT else lambda d: d
    # a block holds anchors of one vector length: places are their order in it
    packed = anchors.withColumn("block", F.pmod(F.xxhash64("id", "label", "v"), F.lit(blocks))).groupBy("block", F.size("v").alias("dim")).agg(F.sort_array(F.collect_list(F.struct("id", "label", "v"))).alias("own"))
    packed = stage(packed.select((F.col("block") + F.col("dim").cast("long") * blocks).alias("block"), "dim", "own"), "anchor-blocks")
    discard(anchors)

    def as_binary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block, dim, own, low, high = (batch.column(c)[i] for c in range(5))
                own = own.values
                flat = own.field(2).flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([
                    pa.array([block.as_py()], pa.int64()), pa.array([dim.as_py()], pa.int32()), *[pa.array([own.field(c).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()) for c in (0, 1)],
                    pa.array([flat.astype(np.float64).tobytes()], pa.binary()), pa.array([low.as_py()], pa.list_(pa.string())), pa.array([high.as_py()], pa.list_(pa.string()))],
                    names=["a_block", "a_dim", "a_anchors", "a_labels", "a_vectors", "a_low", "a_high"])

    schema = "a_block long, a_dim int, a_anchors binary, a_labels binary, a_vectors binary, a_low array<string>, a_high array<string>"
    row_blocks = rows.mapInArrow(_pack(ROWS), _BLOCK)
    numbers = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b.cast("long") + F.col("dim").cast("long") * blocks))

    def met(bounds: DataFrame, windows: int) -> DataFrame:
        side = sent(bounds.mapInArrow(as_binary, schema))
        joined = row_blocks.withColumn("block", numbers).join(side, F.col("block") == F.col("a_block")).drop("a_block")
        return joined.mapInArrow(_mined(windows), "block long, place int, slot int, score long, beyond string, id long")

    none = F.lit(None).cast("array<string>")
    pos = _ranked(met(packed.select("block", "dim", "own", none.alias("low"), none.alias("high")), 0), ["block", "place"], POSITIVES)
    pos = stage(pos.select("block", "place", (F.col("rank") - 1).alias("slot"), "score", "beyond", "id"), "positives")

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An anchor block's windows, POSITIVES a place; one that isn't there is empty."""
        for batch in batches:
            for i in range(batch.num_rows):
                block, dim, own, places = (batch.column(c)[i] for c in range(4))
                n = len(own.values)
                low, high = ["1"] * (n * POSITIVES), ["0"] * (n * POSITIVES)
                for p in places.as_py():
                    score, at = p["score"] if p["beyond"] is None else int(p["beyond"]) - _BEYOND, p["place"] * POSITIVES + p["slot"]
                    low[at], high[at] = str(-(-LEAST * score // 100)), str(MOST * score // 100)
                yield pa.RecordBatch.from_arrays([pa.array([block.as_py()], pa.int64()), pa.array([dim.as_py()], pa.int32()), batch.column(2).slice(i, 1), pa.array([low]), pa.array([high])], names=["block", "dim", "own", "low", "high"])

    windows = packed.join(pos.groupBy(F.col("block").alias("_b")).agg(F.collect_list(F.struct("place", "slot", "score", "beyond")).alias("places")), F.col("block") == F.col("_b")).select("block", "dim", "own", "places")
    windows = windows.mapInArrow(bounds, f"block long, dim int, own {packed.schema['own'].dataType.simpleString()}, low array<string>, high array<string>")
    neg = _ranked(met(windows, POSITIVES), ["block", "place", "slot"], NEGATIVES)
    names = packed.select("block", F.posexplode("own").alias("place", "a")).select(F.col("block").alias("_b"), F.col("place").alias("_p"), F.col("a.id").alias("anchor_id"))
    with_pos = pos.join(names, (F.col("block") == F.col("_b")) & (F.col("place") == F.col("_p"))).select(F.col("block").alias("_b"), F.col("place").alias("_p"), F.col("slot").alias("_s"), "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = neg.join(with_pos, (F.col("block") == F.col("_b")) & (F.col("place") == F.col("_p")) & (F.col("slot") == F.col("_s")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
