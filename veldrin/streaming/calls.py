"""Calls over a stream of events: the state machine of operators.callstate, its deadlines event-time timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.callstate import NAMES, OUT, OUT_NAMES, Session, Voiced, in_order, loud
from ..operators.frames import Listener

_SCALARS = ("state", "frame", "run", "turn", "spoken", "spoken_ms", "escalated", "deaf_bytes", "deaf_until", "deadline")
_LISTENER = ("speaking", "run", "silence", "voiced", "first")


class _Calls(StatefulProcessor):
    """A call's session: scalars, the bytes that make no whole frame, and the endpointer, in three values."""

    def __init__(self, interruptible: bool, voiced: Voiced):
        self.interruptible, self.voiced = interruptible, voiced

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rest = handle.getValueState("rest", "state string, frame long, run int, turn int, spoken string, spoken_ms double, escalated boolean, deaf_bytes long, deaf_until long, deadline long")
        self.pending = handle.getValueState("pending", "bytes binary")
        self.listener = handle.getValueState("listener", "speaking boolean, run int, silence int, voiced int, first long, energies array<double>")

    def _load(self, call_id: int) -> Session:
        s = Session(call_id, self.interruptible, self.voiced)
        if self.rest.exists():
            for name, value in zip(_SCALARS, self.rest.get(), strict=True):
                setattr(s, name, value)
            s.pending = bytes(self.pending.get()[0])
            *scalars, energies = self.listener.get()
            s.listener = Listener(*scalars, list(energies))
        return s

    def _save(self, s: Session, was: int | None) -> None:
        """An ended call keeps the word that it is over, and no more; its late events change nothing."""
        if was is not None and was != s.deadline:
            self.handle.deleteTimer(was)
        if s.deadline is not None and s.deadline != was:
            self.handle.registerTimer(s.deadline)
        if s.state == "ended":
            s = Session(s.call_id, state="ended")
        self.rest.update(tuple(getattr(s, n) for n in _SCALARS))
        self.pending.update((s.pending,))
        self.listener.update((*(getattr(s.listener, n) for n in _LISTENER), s.listener.energies))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        s = self._load(key[0])
        was = s.deadline
        for e in in_order([r.asDict() for r in rows]):
            for out in s.on(e):
                yield Row(**dict(zip(OUT_NAMES, out, strict=True)))
        self._save(s, was)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        s = self._load(key[0])
        at = expiredTimerInfo.getExpiryTimeInMs()
        if s.deadline != at:  # set before the call's last event, which let it pass or put it off
            return
        for out in s.pass_time(at):
            yield Row(**dict(zip(OUT_NAMES, out, strict=True)))
        self._save(s, None)


def stream_sessions(events: DataFrame, late: str = "5 seconds", interruptible: bool = False, voiced: Voiced = loud) -> DataFrame:
    """callstate.OUT from a stream of EVENTS with `ts`, a timestamp, in place of `at`; events of a call come in order.
    Events more than `late` behind the newest ones are dropped by the watermark; deadlines pass as it moves."""
    rows = events.withWatermark("ts", late).select("ts", F.unix_millis("ts").alias("at"), *[n for n in NAMES if n != "at"])
    return rows.groupBy("call_id").transformWithState(_Calls(interruptible, voiced), OUT, "Append", "EventTime")
