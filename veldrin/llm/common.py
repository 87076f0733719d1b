"""Shared plumbing: staged tables in the shared folder, batch readers, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator here: a run of anything but space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"
#: Edges up to which connected components broadcast their nodes' minima: 2**17 rows of two numbers, some megabytes.
BROADCAST_EDGES = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all runs on one
    machine, one of our own. A cluster without the setting is an error, as no folder of the driver's is the executors'."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="veldrin-")
        spark.conf.set("spark.checkpoint.dir", at)
    where = spark._jvm.org.apache.hadoop.fs.Path(at)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veldrin/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, and a lost executor costs a re-read only."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._veldrin_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Remove a staged table that no later plan reads."""
    path = getattr(df, "_veldrin_path", None)
    if path:
        spark = df.sparkSession
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def text_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Cut Arrow batches so that the texts of a slice hold about `most` bytes, a longer one alone; texts are never cut."""
    for batch in batches:
        values, lo, total = batch.column(column), 0, 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(values), 0).to_pylist()
        for i, n in enumerate(sizes):
            if i > lo and total + n > most:
                yield batch.slice(lo, i - lo), values.slice(lo, i - lo).to_pylist()
                lo, total = i, 0
            total += n
        if lo < len(sizes):
            yield batch.slice(lo), values.slice(lo).to_pylist()


def cleared(df: DataFrame, names: list[str]) -> DataFrame:
    """df without columns that would clash with those an operator adds."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def quoted(name: str) -> Column:
    """The column of just this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, *more: Column) -> DataFrame:
    """All of df's columns as one, `row`, beside others: names of these can't clash with df's."""
    return df.select(F.struct(*[quoted(c) for c in df.columns]).alias("row"), *more)


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("row").getField(c).alias(c) for c in names]


def _as_is(df: DataFrame) -> DataFrame:
    return df


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(id, component) of every node with an edge to another; component is the smallest id that is reachable.

    Alternating large-star and small-star steps: a node's neighbours are tied to its smallest one, first the larger,
    then the smaller. Minima are partial aggregates and edges meet them in a join whose skewed keys Spark splits, so a
    node with very many edges is no single task's. Edges stay in Spark; the driver sees their number and a checksum.
    While there are at most BROADCAST_EDGES edges, minima, of at most two nodes an edge, are broadcast instead.
    Null ends and loops are dropped; no edges give no rows.
    """
    e = stage(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("_a"), F.col(b).alias("_b"))
        .where("_a is not null and _b is not null and _a <> _b").select("u", "v").distinct(), "cc")
    was = _signature(e)
    for _ in range(rounds):
        if not was[0]:
            break
        sent = F.broadcast if was[0] <= BROADCAST_EDGES else _as_is
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(sent(low), F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        # the row of the minimum itself ties the node to it, the others their ends
        small = large.join(sent(low), F.col("u") == F.col("w")).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        old, e = e, stage(small, "cc")
        discard(old)
        was, before = _signature(e), was
        if was == before:
            break
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
    out._veldrin_path = e._veldrin_path  # discard(out) removes what it reads
    return out


def as_utf8(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")
