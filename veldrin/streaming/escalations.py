"""Escalations handed on: to a target that may fail, and to files when it does, each once however often a batch is tried.

A call's escalation is one record, named by the call and its lead. What the target said to a batch is written in one
commit to `attempts/batch=N` before it is looked at; keys that any attempt holds are sent no more. A batch that is
tried again so finds its own attempts and sends what isn't among them. The target sees a payload twice only if a task
or the job died between its answer and that commit, which is why payloads carry a key that is the same each time. What
was delivered and what wasn't (the copy on disk that replaces a handover that failed) are rewritten from the attempts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import privacy
from ..sources import files

Target = Callable[[str, str], bool]  # (key, payload as JSON) to whether it was taken; may raise
RESULT = "key string, call_id long, payload string, delivered boolean, error string"


def payloads(leads: DataFrame, at: str) -> DataFrame:
    """(key, call_id, payload) of leads (call_id, lead_id, escalated_to, business_unit, collected, unanswered, summary,
    next_action) that were escalated; contact fields and personal data in texts are replaced."""
    rows = privacy.protect(leads.where(F.coalesce("escalated_to", F.lit("")) != ""), "summary", names=True)
    body = F.struct(
        F.lit("escalation").alias("event"), "lead_id", F.lit(at).alias("at"), F.col("escalated_to").alias("trigger"), "business_unit", files.without_contacts(F.col("collected")).alias("collected"), "unanswered", "summary", "next_action")
    return rows.select(F.concat_ws("-", F.col("call_id").cast("string"), "lead_id").alias("key"), F.col("call_id").cast("long").alias("call_id"), F.to_json(body).alias("payload"))


def sink(path: str, target: Target | None = None) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch over (key, call_id, payload) rows. target: None writes to files alone. Under path:
    `attempts/batch=N`, and from it `delivered/batch=N` and `undelivered/batch=N`, JSON rows of RESULT."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            took, why = [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                try:
                    took.append(bool(target(key, body)) if target else False)
                    why.append(None if took[-1] else "refused" if target else "no target")
                except Exception as e:  # a target's fault is a row, not the stream's end
                    took.append(False)
                    why.append(f"{type(e).__name__}: {str(e)[:160]}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(took, pa.bool_()), pa.array(why, pa.string())], names=[c.split()[0] for c in RESULT.split(", ")])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.select("key", "call_id", "payload").dropDuplicates(["key"])
        before = attempts(spark, path)
        if before is not None:
            rows = rows.join(before.select("key").distinct(), "key", "left_anti").select("key", "call_id", "payload")
        own = f"{path}/attempts/batch={batch_id}"
        rows.mapInArrow(send, RESULT).write.mode("append").parquet(own)
        said = spark.read.schema(RESULT).parquet(own)
        for kind, taken in (("delivered", True), ("undelivered", False)):
            said.where(F.col("delivered") == taken).write.mode("overwrite").json(f"{path}/{kind}/batch={batch_id}")

    return write


def attempts(spark: SparkSession, path: str) -> DataFrame | None:
    """RESULT rows with their batch, of all that was sent; None if nothing was."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/attempts")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(RESULT + ", batch long").parquet(f"{path}/attempts")
