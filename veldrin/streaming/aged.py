"""Turns that came too late to be worth analysing: kept or skipped by how far their call has moved on, and counted.

A turn is skipped if its call's newest turn, of this micro-batch or any before, is more than `most` ahead of it in event
time; what an adviser is told then is about the turn that is being spoken. The newest time of a call is keyed state. How
many were kept and skipped is an observation of the pass that decides, in each batch's progress, not a second query.
Turns beyond the watermark are dropped by Spark and in its own counter, numRowsDroppedByWatermark.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OBSERVED = "aged_turns"


class _Newest(StatefulProcessor):
    """A call's newest time; forgotten by a timer once the watermark is `forget` past it."""

    def __init__(self, most_ms: int, forget_ms: int):
        self.most_ms, self.forget_ms = most_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = self.newest.get()[0] if self.newest.exists() else None
        own = [r.asDict() for r in rows]
        now = max([r["_at"] for r in own] + ([was] if was is not None else []))
        if now != was:
            if was is not None:
                self.handle.deleteTimer(was + self.forget_ms)
            self.handle.registerTimer(now + self.forget_ms)
            self.newest.update((now,))
        for r in own:
            at = r.pop("_at")
            yield Row(**r, skipped=now - at > self.most_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.newest.exists() and self.newest.get()[0] + self.forget_ms == expiredTimerInfo.getExpiryTimeInMs():
            self.newest.clear()
        yield from ()


def flagged(turns: DataFrame, at: str = "ts", most: str = "30 seconds", late: str = "10 minutes", key: str = "conv_id") -> DataFrame:
    """A stream of turns with `skipped`; both kinds stay, so a sink can tell them apart. Counts are observed as
    `aged_turns`: kept and skipped. A turn without a time is dropped, as no age can be told."""
    spark = turns.sparkSession
    most_ms, late_ms = (spark.sql(f"select unix_millis(timestamp'1970-01-01 00:00:00Z' + interval {t}) as ms").first().ms for t in (most, late))
    rows = turns.where(F.col(at).isNotNull()).withWatermark(at, late).withColumn("_at", F.unix_millis(at))
    schema = T.StructType([*turns.schema.fields, T.StructField("skipped", T.BooleanType())])
    out = rows.groupBy(key).transformWithState(_Newest(most_ms, max(late_ms, most_ms)), schema, "Append", "EventTime")
    return out.observe(OBSERVED, F.count_if(~F.col("skipped")).alias("kept"), F.count_if("skipped").alias("skipped"))


def counted(query) -> dict[str, int]:
    """kept and skipped over all batches that a query still remembers."""
    found = [p["observedMetrics"][OBSERVED] for p in query.recentProgress if OBSERVED in (p["observedMetrics"] or {})]
    return {k: sum((m.asDict() if hasattr(m, "asDict") else m)[k] for m in found) for k in ("kept", "skipped")}
