"""Packing by Karmarkar-Karp multiway differencing: windows of near-equal fill, none above the capacity.

Documents are cut losslessly into pieces: whole windows, each a sequence of its own (of a negative number), and what is left into pieces of at
most `piece` tokens of near-equal length. Pieces are dealt by a hash over shards of about `windows` windows each, whose
number follows from the tokens. Within a shard every piece starts as a partial partition of one filled slot among m;
the two partials with the largest spread are merged, the fullest slot of one with the emptiest of the other, until one
is left. If a slot exceeds the capacity, m rises and the shard is packed anew; if it rose by several, m goes back by
bisection to the least number that holds. So each task holds one shard, and what
is padded is about half a window in a shard.

Null text is the empty text, whose only id is the end mark. Repeated rows are packed as often as they come. An empty
table gives no rows. Of extra columns none is returned.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, quoted, stage, text_slices
from .tokens import default_vocabulary, encode

CAPACITY = 2048
PIECE = 512
WINDOWS = 192
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, capacity: int, piece: int) -> list[int]:
    """Where a document of n tokens is cut: 0, ..., n."""
    full = list(range(0, n - n % capacity + 1, capacity))
    rest = n - full[-1]
    k = -(-rest // piece)
    return full + [full[-1] + rest * (i + 1) // k for i in range(k)]


def differencing(sizes: list[int], m: int) -> list[int]:
    """The slot, 0 to m - 1, of each size under multiway differencing."""
    n = len(sizes)
    left, right = [-1] * n, [-1] * n  # node of a filled slot: an item, or two nodes
    heap = []
    for i, s in enumerate(sizes):
        heap.append((-s, i, np.array([s], np.int64), np.array([i], np.int64)))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        over = len(a) + len(b) - m  # slots filled in both: the emptiest of each side meet the fullest of the other
        if over <= 0:
            sums, nodes = np.concatenate([a, b]), np.concatenate([na, nb])
        else:  # a and b are sorted, fullest first; the last `over` of a meet the last of b, reversed
            keep_a, keep_b = len(a) - over, len(b) - over
            made = np.arange(len(left), len(left) + over)
            left.extend(na[keep_a:].tolist())
            right.extend(nb[keep_b:][::-1].tolist())
            sums = np.concatenate([a[:keep_a], b[:keep_b], a[keep_a:] + b[keep_b:][::-1]])
            nodes = np.concatenate([na[:keep_a], nb[:keep_b], made])
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == m else 0)
        heapq.heappush(heap, (-spread, serial, sums, nodes))
        serial += 1
    slots = [0] * n
    for slot, top in enumerate(heap[0][3].tolist() if heap else []):
        todo = [top]
        while todo:
            x = todo.pop()
            if x < n:
                slots[x] = slot
            else:
                todo += (left[x], right[x])
    return slots


def pack_sizes(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Slots of the sizes, none filled above the capacity, and their number."""
    def tried(m: int) -> tuple[list[int], int]:
        slots = differencing(sizes, m)
        return slots, int(np.bincount(slots, sizes).max()) - capacity if sizes else 0

    low, m = 0, max(1, -(-sum(sizes) // capacity))
    slots, over = tried(m)
    while over > 0:
        low, m = m, m + max(1, over * m // capacity)  # what is over, dealt out, lowers the mean fill by a window's share each
        slots, over = tried(m)
    while low and m - low > 1:  # the jump may go too far: back to the least number that holds
        mid = (low + m) // 2
        found, over = tried(mid)
        if over > 0:
            low = mid
        else:
            slots, m = found, mid
    return slots, m


def _pieces(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, piece: int, special: bool) -> Iterator[pa.RecordBatch]:
    path = path or default_vocabulary()
    for batch, texts in text_slices(batches, 1):
        ids, at = encode([t.decode() for t in texts], path, special)
        out: list[list[int]] = [[], [], [], [], []]
        for row, doc in enumerate(batch.column(0).to_pylist()):
            lo, n = int(at[row]), int(at[row + 1] - at[row])
            where = cuts(n, capacity, piece)
            for a, b in zip(where, where[1:], strict=False):
                for column, v in zip(out, (doc, a, b - a, zlib.crc32(ids[lo + a : lo + b].tobytes()), n), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])


def pack(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS, special: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. special: strings of special
    tokens in a text are these tokens, as the vocabulary's tokenizer has them by default."""
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), as_utf8(quoted(text)).alias("text"))
    pieces = stage(rows.mapInArrow(lambda it: _pieces(it, vocabulary, capacity, piece, special), SCHEMA), "pieces")
    tokens = pieces.where(F.col("length") < capacity).agg(F.sum("length")).first()[0] or 0
    shards = max(1, round(tokens / (capacity * windows)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        sizes = pdf["length"].to_numpy()
        slots, _ = pack_sizes(sizes.tolist(), capacity)
        slot = np.array(slots, np.int64)
        order = np.argsort(slot, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.concatenate([[True], slot[order][1:] != slot[order][:-1]])
        begins = ends - sizes[order]
        offset = np.empty(len(sizes), np.int64)
        offset[order] = begins - np.maximum.accumulate(np.where(first, begins, 0))
        return pdf.assign(sequence_id=(pdf["shard"].to_numpy().astype(np.int64) << 32) + slot, offset=offset)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    rest = pieces.where(F.col("length") < capacity)
    dealt = rest.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    packed = dealt.groupBy("shard").applyInPandas(solve, SCHEMA + ", sequence_id long, offset long")
    # a whole window is a sequence by itself and meets no other; the rows of written files number it
    whole = pieces.where(F.col("length") == capacity)
    return packed.unionByName(whole.select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
