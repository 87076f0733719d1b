"""The k most similar vectors of each query of a stated set, by cosine, in blocks.

Vectors are packed where they are read, queries in blocks of about QUERIES by a hash; a pack of vectors meets a block of
queries in a join on the block's number and the vectors' length, one matrix product each. A task keeps k rows a query
while packs pass and emits them at its end, so what is shuffled is k rows a query and task, never the pairs. Queries are
counted: up to SENT bytes of them are broadcast, beyond they are shuffled.

Zero vectors have cosine 0 with all; null ones, and ones with null components, are left out. Scores are rounded to DIGITS,
as sums may differ in their last bits, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .retrieval import ranked

QUERIES, PACK, SENT, DIGITS = 1024, 8192, 32 << 20, 9
#: Query blocks whose best rows a task holds at once.
HELD = 32
#: Vectors of a pack whose cosines are held at once.
BLOCK = 2048


def _units(values: np.ndarray, dim: int) -> np.ndarray:
    m = values.reshape(-1, dim)
    norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return m / np.where(norm == 0, 1, norm)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, v), or (id, v, label), to rows of ids and unit vectors of one length, and labels."""
    for batch in batches:
        sizes = pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False)
        flat, ends = batch.column(1).flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes, dtype=np.int64)
        for dim in np.unique(sizes):
            own = np.flatnonzero(sizes == dim)
            for lo in range(0, len(own), PACK):
                at = own[lo : lo + PACK]
                wide = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                ids, *labels = (pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), batch.column(c).take(pa.array(at))) for c in (0, *range(2, batch.num_columns)))
                yield pa.RecordBatch.from_arrays([ids, pa.array([int(dim)], pa.int32()), pa.array([_units(wide.ravel(), int(dim)).tobytes()], pa.binary()), *labels], names=["ids", "dim", "m", "labels"][: batch.num_columns + 1])


def _best(k: int):
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}

        def emit() -> Iterator[pa.RecordBatch]:
            for queries, _, slot, score, ids in held.values():
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(slot)), ids, pa.array(score)], names=["query_id", "id", "score"])
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                ids, dim, m, block, asked = (batch.column(c)[i] for c in range(5))
                key = block.as_py(), dim.as_py()
                if key not in held:
                    if len(held) >= HELD:
                        yield from emit()
                    q = asked.values
                    held[key] = [q.field(0), _units(q.field(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), key[1]), np.zeros(0, np.int64), np.zeros(0), ids.values.slice(0, 0)]
                queries, wanted, slot, score, kept = held[key]
                found = np.round(np.frombuffer(m.as_py(), np.float64).reshape(-1, key[1]) @ wanted.T, DIGITS)
                least = np.partition(found, len(found) - k, axis=0)[len(found) - k] if len(found) > k else np.full(len(queries), -np.inf)
                full = np.flatnonzero(np.bincount(slot, minlength=len(queries)) == k)
                if len(full):
                    least[full] = np.maximum(least[full], score[np.searchsorted(slot, full, side="right") - 1])
                r, q = np.nonzero(found >= least)
                slot, score = np.r_[slot, q], np.r_[score, found[r, q]]
                kept = pa.concat_arrays([kept, ids.values.take(pa.array(r))])
                place = np.empty(len(kept), np.int64)
                place[pc.sort_indices(kept).to_numpy()] = np.arange(len(kept))
                order = np.lexsort((place, -score, slot))
                s = slot[order]
                first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.zeros(0, np.int64)
                order = order[np.arange(len(s)) - np.repeat(first, np.diff(np.r_[first, len(s)])) < k]
                held[key][2:] = [slot[order], score[order], kept.take(pa.array(order))]
        yield from emit()

    return best


def cosine_topk(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, query_id: str, query_vector: str, k: int) -> DataFrame:
    """(query_id, id, score, rank) of each query's k most similar vectors, rank from 0."""
    def whole(df: DataFrame, key: str, column: str) -> DataFrame:
        v = F.col(column).cast("array<double>")
        return df.select(F.col(key).alias("id"), v.alias("v")).where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull()) & F.col(key).isNotNull())

    rows, asked = whole(vectors, id_col, vector), whole(queries, query_id, query_vector)
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // QUERIES))
    sent = F.broadcast if 8 * size <= SENT else lambda d: d
    one = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("b", F.size("v").alias("d")).agg(F.collect_list(F.struct("id", "v")).alias("asked"))
    kind, asked_kind = rows.schema["id"].dataType.simpleString(), asked.schema["id"].dataType.simpleString()
    packs = rows.mapInArrow(_packs, f"ids array<{kind}>, dim int, m binary").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = packs.join(sent(one), (F.col("block") == F.col("b")) & (F.col("dim") == F.col("d"))).select("ids", "dim", "m", F.col("block").cast("long").alias("block"), "asked")
    return ranked(met.mapInArrow(_best(k), f"query_id {asked_kind}, id {kind}, score double"), k)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (ids, dim, m, labels, asked): the least cosine between different ids of one label, and the largest between labels."""
    least, most = np.inf, -np.inf
    for batch in batches:
        for i in range(batch.num_rows):
            ids, dim, m, labels, asked = (batch.column(c)[i] for c in range(5))
            q = asked.values
            of, dim = pc.unique(pc.drop_null(q.field(2))), dim.as_py()
            # label by label: rows and queries in the order of their labels; -1 is a label that no query has
            wanted = pc.fill_null(pc.index_in(q.field(2), value_set=of), -1).to_numpy(zero_copy_only=False)
            own = pc.fill_null(pc.index_in(labels.values, value_set=of), -1).to_numpy(zero_copy_only=False)
            columns, rows = np.argsort(wanted, kind="stable"), np.argsort(own, kind="stable")
            columns, rows = columns[wanted[columns] >= 0], rows[pc.is_valid(labels.values).to_numpy(zero_copy_only=False)[rows]]
            units = _units(q.field(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64), dim)[columns]
            values, wanted, own = np.frombuffer(m.as_py(), np.float64).reshape(-1, dim), wanted[columns], own[rows]
            names = q.field(0).take(pa.array(columns))
            same = pc.fill_null(pc.index_in(ids.values.take(pa.array(rows)), value_set=names), -1).to_numpy(zero_copy_only=False)
            for lo in range(0, len(rows) if len(columns) else 0, BLOCK):
                found = values[rows[lo : lo + BLOCK]] @ units.T
                mine, self_at = own[lo : lo + BLOCK], np.flatnonzero(same[lo : lo + BLOCK] >= 0)
                cuts = [0, *(np.flatnonzero(np.diff(mine)) + 1).tolist(), len(mine)]
                groups = [(a, b, *np.searchsorted(wanted, [mine[a], mine[a] + 1])) for a, b in zip(cuts, cuts[1:], strict=False)]
                found[self_at, same[lo + self_at]] = np.inf
                least = min([least, *(found[a:b, c:d].min() for a, b, c, d in groups if c < d)])
                found[self_at, same[lo + self_at]] = -np.inf
                most = max([most, *(part.max() for a, b, c, d in groups for part in (found[a:b, :c], found[a:b, d:]) if part.size)])
    yield pa.RecordBatch.from_arrays([pa.array([None if least == np.inf else least], pa.float64()), pa.array([None if most == -np.inf else most], pa.float64())], names=["least", "most"])


def separation(vectors: DataFrame, queries: DataFrame, id_col: str, vector: str, label: str) -> DataFrame:
    """(separation): the least cosine of a query with another id of its label, less the largest with one of another label.
    queries are rows like those of vectors; ids shouldn't repeat. A row a task is what comes of the pairs."""
    def whole(df: DataFrame) -> DataFrame:
        v = F.col(vector).cast("array<double>")
        return df.select(F.col(id_col).alias("id"), v.alias("v"), F.col(label).alias("label")).where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull()) & (F.size(v) > 0) & F.col(id_col).isNotNull())

    rows, asked = whole(vectors), whole(queries)
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.size("v")), F.lit(0))).first()
    blocks = max(1, -(-n // QUERIES))
    sent = F.broadcast if 8 * size <= SENT else lambda d: d
    one = asked.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks))).groupBy("b", F.size("v").alias("d")).agg(F.collect_list(F.struct("id", "v", "label")).alias("asked"))
    kind, label_kind = (rows.schema[c].dataType.simpleString() for c in ("id", "label"))
    packs = rows.mapInArrow(_packs, f"ids array<{kind}>, dim int, m binary, labels array<{label_kind}>").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = packs.join(sent(one), (F.col("block") == F.col("b")) & (F.col("dim") == F.col("d"))).select("ids", "dim", "m", "labels", "asked")
    return met.mapInArrow(_ends, "least double, most double").agg((F.min("least") - F.max("most")).alias("separation"))
