"""Near-duplicate vectors: random-hyperplane sign hashing in several tables, links confirmed by exact cosine.

Vectors of one label and one length are compared. Equal unit vectors are one class with a weight, so thousands of copies
cost one. A table's code is the signs of some random projections: about as many as the classes of the largest label have
bits, so that a code's chance company doesn't grow with the input, and as many tables as make a pair at the least cosine
share none with probability below MISSED. Classes that share a code with no other are set aside before vectors move. A
bucket larger than BLOCK is cut into blocks by a hash, and each pair of blocks is a run of its own among the sorted rows
of a partition, so no bucket is one task's. Runs are compared in Arrow batches, all small runs of a size at once, in
double precision; only weights and spanning links leave the worker, never the pairs. A pair that meets in several tables
is counted in the first of them alone, which the codes that travel with a vector tell.

Defined results: null, empty or zero vectors, ones with null or non-finite components, and null labels link with
nothing. Equal vectors link with each other. Null ids take no part in links. Empty tables give no rows; extra columns
are dropped. Rows that repeat an id are counted as vectors of their own, under one component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import pandas_udf

from .common import connected_components, discard, quoted, stage

#: Greatest probability that a pair at the least cosine shares no code.
MISSED = 4e-5
BLOCK = 1024
#: Runs of up to this many rows are compared many at once.
SMALL = 24
COSINE = 0.93


def plan(classes: int, least: float = COSINE) -> tuple[int, int]:
    """Bits of a code and tables, for so many classes under the largest label."""
    bits = min(30, max(12, classes.bit_length() + 1))
    shared = (1 - math.acos(min(least, 1.0)) / math.pi) ** bits
    return bits, 1 if shared == 1 else math.ceil(math.log(MISSED) / math.log(1 - shared))


def codes(vectors: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """(rows, tables) codes."""
    planes = np.random.default_rng(vectors.shape[1] * 1000 + 11).normal(size=(vectors.shape[1], bits * tables))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return (signs @ (1 << np.arange(bits, dtype=np.int64))).astype(np.int32)


@pandas_udf(T.BinaryType())
def _units(vector: pd.Series) -> pd.Series:
    """Unit vectors as the bytes of their components in double precision."""
    def one(v):
        if v is None or not len(v):
            return None
        x = np.array([np.nan if c is None else c for c in v], np.float64) if getattr(v, "dtype", None) == object else np.asarray(v, np.float64)
        big = np.abs(x).max()
        if not np.isfinite(big) or big == 0:
            return None
        x = x / big
        return (x / np.sqrt(x @ x) + 0.0).tobytes()

    return vector.map(one, na_action=None)


def _matrix(units: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1)


def _coded(batches: Iterator[pa.RecordBatch], bits: int, tables: int) -> Iterator[pa.RecordBatch]:
    """The batches (no, label, unit, n, rep) with codes."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 512):
            batch = whole.slice(lo, 512)
            units = batch.column(2).to_pylist()
            out: list = [None] * len(units)
            for size in {len(u) for u in units}:
                at = [i for i, u in enumerate(units) if len(u) == size]
                for i, row in zip(at, codes(_matrix([units[i] for i in at]), bits, tables), strict=True):
                    out[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=["no", "label", "unit", "n", "rep", "codes"])


class _Found:
    """Weights and spanning links of a batch of runs."""

    def __init__(self, no: np.ndarray, weight: np.ndarray, coded: np.ndarray, table: np.ndarray):
        self.no, self.weight, self.coded, self.table = no, weight, coded, table
        self.sums = np.zeros(len(no), np.int64)
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        while self.up.setdefault(x, x) != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Pairs that link; those that met in an earlier table are known."""
        for lo in range(0, len(i), 1 << 14):
            p, q = i[lo : lo + (1 << 14)], j[lo : lo + (1 << 14)]
            earlier = np.arange(self.coded.shape[1]) < self.table[p][:, None]
            new = ~((self.coded[p] == self.coded[q]) & earlier).any(axis=1)
            p, q = p[new], q[new]
            np.add.at(self.sums, p, self.weight[q])
            np.add.at(self.sums, q, self.weight[p])
            for x, y in zip(self.no[p].tolist(), self.no[q].tolist(), strict=True):
                x, y = self.top(x), self.top(y)
                if x != y:
                    self.up[max(x, y)] = min(x, y)

    def batch(self) -> pa.RecordBatch:
        at = np.flatnonzero(self.sums)
        to = [self.top(x) for x in self.no[at].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(self.no[at]), pa.array(self.sums[at]), pa.array(to, pa.int64())], names=["no", "n", "to"])


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a run (key, lo, hi: the first columns) does."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in range(3))

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        last, at = key(b, b.num_rows - 1), b.num_rows
        if key(b, 0) == last:
            at = 0
        else:
            starts = _starts(b)
            at = int(starts[-1])
        if held and (at or key(held[-1], held[-1].num_rows - 1) != key(b, 0)):
            if at:
                held.append(b.slice(0, at))
            yield joined()
            held = []
        elif at:
            yield b.slice(0, at)
        if at < b.num_rows:
            held.append(b.slice(at))
    if held:
        yield joined()


def _starts(b: pa.RecordBatch) -> np.ndarray:
    new = np.zeros(b.num_rows, bool)
    new[0] = True
    for k in range(3):
        c = b.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _compare(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """(no, n, to) of sorted (key, lo, hi, side, table, no, label, unit, n, codes)."""
    for b in _whole_runs(batches):
        no, weight, side, table = (b.column(k).to_numpy() for k in (5, 8, 3, 4))
        label, unit = b.column(6).to_pylist(), b.column(7).to_pylist()
        coded = b.column(9).values.slice(b.column(9).offsets[0].as_py(), b.column(9).offsets[-1].as_py() - b.column(9).offsets[0].as_py()).to_numpy().reshape(len(no), -1)
        starts = np.append(_starts(b), len(no))
        cross = b.column(1).to_numpy() != b.column(2).to_numpy()
        found, small = _Found(no, weight, coded, table), {}
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            kinds = {(label[i], len(unit[i])) for i in range(lo, hi)}
            for kind in kinds:  # but for a clash of hashed keys, one
                at = np.arange(lo, hi) if len(kinds) == 1 else np.array([i for i in range(lo, hi) if (label[i], len(unit[i])) == kind])
                if len(at) <= SMALL and not cross[lo]:
                    small.setdefault((len(at), kind[1]), []).append(at)
                    continue
                a = at[side[at] == side[at].min()] if cross[lo] else at
                c = at[side[at] != side[at].min()] if cross[lo] else at
                if not len(a) or not len(c):
                    continue
                xa, xc = _matrix([unit[i] for i in a]), _matrix([unit[i] for i in c])
                for part in range(0, len(a), 256):
                    i, j = np.nonzero(xa[part : part + 256] @ xc.T >= least)
                    i += part
                    if not cross[lo]:
                        i, j = i[i < j], j[i < j]
                    found.add(a[i], c[j])
        for (size, _), runs in small.items():
            i, j = np.triu_indices(size, 1)
            step = max(1, (1 << 13) // max(1, len(i)))
            for lo in range(0, len(runs) if len(i) else 0, step):
                at = np.stack(runs[lo : lo + step])
                x = _matrix([unit[k] for k in at.ravel().tolist()]).reshape(*at.shape, -1)
                p, q = at[:, i].ravel(), at[:, j].ravel()
                close = np.einsum("rpd,rpd->rp", x[:, i], x[:, j]).ravel() >= least
                found.add(p[close], q[close])
        yield found.batch()


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = COSINE) -> DataFrame:
    """(id, n_links, component_id, kept) of every row."""
    rows = stage(vectors.select(quoted(id_col).cast("long").alias("id"), _units(quoted(vector)).alias("unit"), quoted(label).cast("string").alias("label")), "vectors")
    fit = rows.where("id is not null and label is not null and unit is not null")
    classes = stage(fit.groupBy("label", "unit").agg(F.count("*").alias("n"), F.min("id").alias("rep")).select(F.monotonically_increasing_id().alias("no"), "label", "unit", "n", "rep"), "classes")
    most = classes.groupBy("label", F.length("unit")).count().agg(F.max("count")).first()[0] or 0
    bits, tables = plan(most, least)
    coded = stage(classes.mapInArrow(lambda it: _coded(it, bits, tables), "no long, label string, unit binary, n long, rep long, codes array<int>"), "coded")
    light = coded.select("no", F.hash("label", F.length("unit")).alias("kind"), F.posexplode("codes").alias("table", "code")).select("no", "table", F.xxhash64("kind", "table", "code").alias("key"))
    shared = stage(light.groupBy("key").count().where("count > 1").select(F.col("key").alias("_k"), F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "codes")
    here = light.join(shared, F.col("key") == F.col("_k")).select(F.col("no").alias("_n"), "key", "table", "blocks")
    moved = here.join(coded, F.col("_n") == F.col("no")).withColumn("side", F.pmod(F.xxhash64("no", "table"), F.col("blocks")).cast("int"))
    moved = moved.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    moved = moved.select("key", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "table", "no", "label", "unit", "n", "codes")
    runs = moved.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    counted = stage(runs.mapInArrow(lambda it: _compare(it, least), "no long, n long, to long"), "counted")
    total = counted.groupBy(F.col("no").alias("_n")).agg(F.sum("n").alias("more"))
    names = coded.select(F.col("no").alias("_n"), F.col("rep").alias("_rep"))
    links = counted.where("no <> to").select("no", "to").distinct()
    links = links.join(names, F.col("no") == F.col("_n")).select(F.col("_rep").alias("a"), "to").join(names, F.col("to") == F.col("_n")).select("a", F.col("_rep").alias("b"))
    known = coded.join(total, F.col("no") == F.col("_n"), "left").select(F.col("label").alias("_l"), F.col("unit").alias("_u"), (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "rep")
    out = stage(rows.join(known, (F.col("label") == F.col("_l")) & (F.col("unit") == F.col("_u")) & F.col("id").isNotNull(), "left").select("id", "n_links", "rep"), "linked")
    copies = out.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    comps = connected_components(links.union(copies)).select(F.col("id").alias("_c"), "component")
    for t in (rows, classes, coded, shared, counted):
        discard(t)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.join(comps, F.col("id") == F.col("_c"), "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
