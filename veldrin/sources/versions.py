"""Tables in versions: each write is a folder of its own, and a pointer file, replaced in one rename, says which one counts.

Readers see the version before or the one after, never neither; a write that fails leaves the pointer where it was. The
table that a write reads from stays, as it is an older version. Folders before the last `keep` go after the pointer has
moved.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

_POINTER = "_current"


def _hadoop(spark: SparkSession, path: str):
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make, make(path).getFileSystem(spark._jsc.hadoopConfiguration())


def pointer(spark: SparkSession, path: str) -> dict | None:
    """The current version's name and what was noted with it; None before the first."""
    make, fs = _hadoop(spark, path)
    at = make(f"{path}/{_POINTER}")
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(df: DataFrame, path: str, partition_by: str | None = None, keep: int = 2, **notes: str) -> DataFrame:
    """df as the table's next version, and the table as it is then."""
    spark = df.sparkSession
    make, fs = _hadoop(spark, path)
    name = f"v-{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/{name}")
    temporary = make(f"{path}/{_POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(temporary, False)
    stream.write(json.dumps({"version": name, **notes}).encode())
    stream.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(temporary), fs.makeQualified(make(f"{path}/{_POINTER}")), how)
    old = sorted(f.getPath().getName() for f in fs.listStatus(make(path)) if f.getPath().getName().startswith("v-"))
    for gone in [v for v in old if v < name][: -(keep - 1) or None]:
        fs.delete(make(f"{path}/{gone}"), True)
    return spark.read.parquet(f"{path}/{name}")


def current(spark: SparkSession, path: str) -> DataFrame | None:
    found = pointer(spark, path)
    return None if found is None else spark.read.parquet(f"{path}/{found['version']}")
