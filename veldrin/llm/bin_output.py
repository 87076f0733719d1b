"""Token-id output: best-fit-decreasing packing into fixed windows, as id matrices with segment starts and positions.

Only documents longer than a window are cut, losslessly, at multiples of it; whole windows are sequences of their own,
and the other pieces go, longest first, each to the window with the least room that still takes it. A segment tree over
the room that is left, 0 to the capacity, finds it: leaves hold the open windows with that room, and a descent finds
the first leaf at or above a length. Each partition is packed in shards of bounded size, as its documents come: nothing
is shuffled, a task holds a shard, and a partition adds at most one window that little fills. Ids of sequences are those
of partitions, so they follow from how the input is cut into partitions and are the same when a task is run again.

A sequence's row has its ids (little-endian unsigned 16 or 32 bit, padded with 0), cu_seqlens (0, the segments' ends)
and positions, which begin anew in each segment (and over the padding). Null text is the empty text, whose only id is
the end mark; repeated rows are packed as often as they come; an empty table gives no rows. Extra columns are dropped.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_utf8, stage, text_slices
from .tokens import default_vocabulary, encode

CAPACITY = 2048
WINDOWS = 512
SEQUENCES = "sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, ids binary, positions binary"


class RoomTree:
    """Open windows by the room left in them; the least room of at least n is found in log2(capacity) steps."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _change(self, room: int, by: int) -> None:
        node = room + self.leaves
        while node:
            self.counts[node] += by
            node >>= 1

    def add(self, room: int, window: int) -> None:
        self.windows[room].append(window)
        self._change(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, window) of a window with the least room that is at least `least`."""
        node = least + self.leaves
        if not self.counts[node]:
            while node > 1 and (node & 1 or not self.counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.counts[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._change(room, -1)
        return room, self.windows[room].pop()


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The window of each size; sizes come longest first."""
    tree, out, n = RoomTree(capacity), [], 0
    for size in sizes:
        found = tree.take(size)
        if found is None:
            found, n = (capacity, n), n + 1
        room, window = found
        out.append(window)
        if room > size:
            tree.add(room - size, window)
    return out


def _cut(batches: Iterator[pa.RecordBatch], path: str | None, capacity: int, wide: bool) -> Iterator[pa.RecordBatch]:
    path = path or default_vocabulary()
    for batch, texts in text_slices(batches, 1):
        ids, at = encode([t.decode() for t in texts], path)
        if not wide and len(ids) and int(ids.max()) > 0xFFFF:
            raise ValueError("the vocabulary has ids above 65535: pass wide=True")
        raw = ids.astype("<u4" if wide else "<u2")
        docs, starts, sizes, parts = [], [], [], []
        for row, doc in enumerate(batch.column(0).to_pylist()):
            lo, hi = int(at[row]), int(at[row + 1])
            for a in range(lo, hi, capacity):
                docs.append(doc)
                starts.append(a - lo)
                parts.append(raw[a : min(hi, a + capacity)].tobytes())
                sizes.append(min(hi, a + capacity) - a)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int32()), pa.array(parts, pa.binary())], names=["doc_id", "start", "length", "ids"])


def _shards(pieces: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.Table]:
    """Pieces in the order in which they come, in tables of at least that many tokens, but for the last."""
    held, tokens = [], 0
    for batch in pieces:
        held.append(batch)
        tokens += pa.compute.sum(batch.column("length")).as_py() or 0
        if tokens >= least:
            yield pa.Table.from_batches(held)
            held, tokens = [], 0
    if tokens:
        yield pa.Table.from_batches(held)


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: str | None, capacity: int, windows: int, wide: bool) -> Iterator[list[tuple]]:
    """The sequences of a partition's texts, shard by shard, values as in SEQUENCES."""
    first = TaskContext.get().partitionId() << 32
    for shard in _shards(_cut(batches, vocabulary, capacity, wide), capacity * windows):
        found = list(_solved(shard, capacity, wide, first))
        first += len(found)
        yield found


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), as_utf8(text).alias("text"))


def _solved(pieces: pa.Table, capacity: int, wide: bool, first: int) -> Iterator[tuple]:
    """The sequences of a shard's pieces, numbered from `first`, values as in SEQUENCES."""
    width, kind = (4, "<u4") if wide else (2, "<u2")
    docs, starts, lengths, ids = (pieces.column(c).to_pylist() for c in ("doc_id", "start", "length", "ids"))
    order = sorted(range(len(ids)), key=lambda i: (-lengths[i], docs[i] is None, docs[i] or 0, starts[i], zlib.crc32(ids[i])))
    members: dict[int, list[int]] = {}
    for i, w in zip(order, best_fit_decreasing([lengths[i] for i in order], capacity), strict=True):
        members.setdefault(w, []).append(i)
    where = np.arange(capacity, dtype=np.uint32)
    for w in sorted(members):
        rows = members[w]
        ends = np.cumsum([0, *(lengths[i] for i in rows)], dtype=np.int32)
        begins = np.append(ends[:-1], ends[-1:] if ends[-1] < capacity else ends[:0])
        positions = where - np.repeat(begins, np.diff(np.append(begins, capacity))).astype(np.uint32)
        yield first + w, int(ends[-1]), [docs[i] for i in rows], [starts[i] for i in rows], ends.tolist(), b"".join(ids[i] for i in rows).ljust(capacity * width, b"\0"), positions.astype(kind).tobytes()


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def sequences(docs: DataFrame, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, windows: int = WINDOWS, wide: bool = False) -> DataFrame:
    """One row per sequence, columns as in SEQUENCES. windows: least number of windows' tokens in a shard. wide: 32-bit
    ids, for vocabularies of more than 65,536."""
    names = ["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "positions"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        for shard in _packed(batches, vocabulary, capacity, windows, wide):
            yield _batch(shard, names, kinds)

    return _texts(docs, id_col, text).mapInArrow(solve, SEQUENCES)


def write_matrices(packed: DataFrame, uri: str, capacity: int = CAPACITY, wide: bool = False) -> DataFrame:
    """Write, for each partition, ids and positions as raw row-major matrices and the cu_seqlens one after the other
    as 32-bit numbers; returns (part, rows, cu_length), of the files that count. A retried task writes under a new name."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        fs, at = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(at)
        part, rows, ends = uuid.uuid4().hex, 0, 0
        with fs.open_output_stream(f"{at}/{part}.ids") as ids, fs.open_output_stream(f"{at}/{part}.positions") as pos, fs.open_output_stream(f"{at}/{part}.cu_seqlens") as cu:
            for b in batches:
                for i, p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    ids.write(i)
                    pos.write(p)
                    cu.write(np.array(c, "<u4").tobytes())
                    rows, ends = rows + 1, ends + len(c)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([rows], pa.int64()), pa.array([ends], pa.int64())], names=["part", "rows", "cu_length"])

    return packed.select("ids", "positions", "cu_seqlens").mapInArrow(write, "part string, rows long, cu_length long")


INDEX = "part string, row long, cu_at long, cu_length long, sequence_id long, n_tokens int, doc_ids array<long>, starts array<long>"


def write_indexed(docs: DataFrame, uri: str, id_col: str = "doc_id", text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY, windows: int = WINDOWS, wide: bool = False) -> DataFrame:
    """Pack docs as `sequences` does and write the files of write_matrices, a set for each partition; returns, for each
    sequence, its part, row and place in the cu_seqlens, and the columns that aren't in the files. As a part counts when
    its index rows do, they are staged."""
    names = ["part", "row", "cu_at", "cu_length", "sequence_id", "n_tokens", "doc_ids", "starts"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        shards = _packed(batches, vocabulary, capacity, windows, wide)
        first = next(shards, None)
        if first is None:
            return
        fs, at = pyarrow.fs.FileSystem.from_uri(uri)
        fs.create_dir(at)
        part, row, end = uuid.uuid4().hex, 0, 0
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        with fs.open_output_stream(f"{at}/{part}.ids") as ids, fs.open_output_stream(f"{at}/{part}.positions") as pos, fs.open_output_stream(f"{at}/{part}.cu_seqlens") as cu:
            for shard in itertools.chain([first], shards):
                out = []
                for sequence, n, doc_ids, starts, ends, i, p in shard:
                    ids.write(i)
                    pos.write(p)
                    cu.write(np.array(ends, "<u4").tobytes())
                    out.append((part, row, end, len(ends), sequence, n, doc_ids, starts))
                    row, end = row + 1, end + len(ends)
                yield _batch(out, names, kinds)

    return stage(_texts(docs, id_col, text).mapInArrow(write, INDEX), "index")


def read_matrices(index: DataFrame, uri: str, capacity: int = CAPACITY, wide: bool = False, rows_at_once: int = 256) -> DataFrame:
    """The sequences (columns as in SEQUENCES) of an index by write_indexed, from the files."""
    size = capacity * (4 if wide else 2)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = pyarrow.fs.FileSystem.from_uri(uri)
        name, files = None, []
        try:
            for whole in batches:
                for lo in range(0, whole.num_rows, rows_at_once):
                    b = whole.slice(lo, rows_at_once)
                    out: list[list] = [[], [], []]
                    for part, row, a, n in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                        if part != name:
                            for f in files:
                                f.close()
                            name, files = part, [fs.open_input_file(f"{at}/{part}.{end}") for end in ("cu_seqlens", "ids", "positions")]
                        for values, f, where, length in zip(out, files, (4 * a, size * row, size * row), (4 * n, size, size), strict=True):
                            values.append(f.read_at(length, where))
                    cu = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in out[0]], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays(
                        [*[b.column(k) for k in range(4, 8)], cu, pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())],
                        names=["sequence_id", "n_tokens", "doc_ids", "starts", "cu_seqlens", "ids", "positions"])
        finally:
            for f in files:
                f.close()

    return index.mapInArrow(read, SEQUENCES)
