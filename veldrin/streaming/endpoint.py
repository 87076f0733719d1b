"""Endpointing over a stream of frames: the batch machine with its state in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.frames import FRAME_BYTES, UTTERANCE, UTTERANCE_NAMES, Listener, energy, reframe, utterances  # noqa: F401  (part of this module's interface)


class _Endpointing(StatefulProcessor):
    """A call's listener; a call that has been idle for idle_ms is flushed by a timer and forgotten."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("listener", "speaking boolean, run int, silence int, voiced int, first long, energies array<double>, timer long")

    def _load(self) -> tuple[Listener, int]:
        if not self.state.exists():
            return Listener(), 0
        *s, energies, timer = self.state.get()
        return Listener(*s, list(energies)), timer

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        listener, timer = self._load()
        closed = False
        for r in sorted(rows, key=lambda r: (r.frame_no, r.closed)):
            found = listener.flush() if r.closed else listener.feed(r.frame_no, r.voiced, r.rms * r.rms)
            closed = r.closed
            if found:
                yield Row(**dict(zip(UTTERANCE_NAMES, (key[0], *found), strict=True)))
        if timer:
            self.handle.deleteTimer(timer)
        if closed:
            self.state.clear()
            return
        timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms if self.idle_ms else 0
        if timer:
            self.handle.registerTimer(timer)
        self.state.update((listener.speaking, listener.run, listener.silence, listener.voiced, listener.first, listener.energies, timer))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        listener, timer = self._load()
        if timer == expiredTimerInfo.getExpiryTimeInMs():  # else a timer of before the call's last frames
            if found := listener.flush():
                yield Row(**dict(zip(UTTERANCE_NAMES, (key[0], *found), strict=True)))
            self.state.clear()


def stream_utterances(frames: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """The same over a stream of frames, in order within a call; a row whose `closed` is true ends its call, and so does
    idle_ms without a frame. A query that runs for ever should set it; one that takes what is available shouldn't, as it
    would wait for the timers for ever."""
    rows = frames.select(
        F.col("call_id").cast("long").alias("call_id"), F.col("frame_no").cast("long").alias("frame_no"), F.coalesce("voiced", F.lit(False)).alias("voiced"), F.coalesce(F.col("rms").cast("double"), F.lit(0.0)).alias("rms"),
        F.coalesce("closed", F.lit(False)).alias("closed"))
    return rows.groupBy("call_id").transformWithState(_Endpointing(idle_ms), UTTERANCE, "Append", "ProcessingTime" if idle_ms else "None")


def interruptions(frames: DataFrame, run: int = 12) -> DataFrame:
    """(call_id, frame_no): where voiced frames while the agent speaks reach a run of `run`; frames have agent_speaking."""
    order = Window.partitionBy("call_id").orderBy("frame_no")
    hit = F.col("voiced") & F.col("agent_speaking")
    rows = frames.withColumn("_h", hit).withColumn("_g", F.sum((~hit).cast("int")).over(order))
    runs = rows.where("_h").withColumn("_n", F.row_number().over(Window.partitionBy("call_id", "_g").orderBy("frame_no")))
    return runs.where(F.col("_n") == run).select("call_id", "frame_no")
