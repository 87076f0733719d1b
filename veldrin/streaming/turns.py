"""The conversation fold over a stream of turns: the batch fold's `Call`, with its parts in keyed state."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.turns import OUT, OUT_NAMES, READ_NAMES, Call, readings
from ..sources.packs import Pack

#: What a call starts with if it doesn't start empty: a snapshot of the fold, as `snapshot` gives it.
SNAPSHOT = "conv_id long, slots map<string,string>, asked map<string,int>, given_up array<string>, corrections array<string>, unanswered array<string>, region string, last_asked string, assessed map<string,string>"


class Fold(StatefulProcessor):
    """Slots and counts in map state, unanswered questions and corrections in list state, the rest in one value. Turns
    of a call are taken in order within a micro-batch; a call that has been silent for idle_ms is forgotten."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "name string", "value string")
        self.asked = handle.getMapState("asked", "name string", "n int")
        self.unanswered = handle.getListState("unanswered", "question string, stems array<string>")
        self.corrections = handle.getListState("corrections", "text string")
        self.rest = handle.getValueState("rest", "region string, last_asked string, given_up array<string>, assessed string, timer long")

    def _load(self) -> tuple[Call, int]:
        if not self.rest.exists():
            return Call(), 0
        region, last, given_up, assessed, timer = self.rest.get()
        return Call(
            {k[0]: v[0] for k, v in self.slots.iterator()}, {k[0]: v[0] for k, v in self.asked.iterator()}, list(given_up), [r[0] for r in self.corrections.get()],
            [(r[0], list(r[1])) for r in self.unanswered.get()], region, last, json.loads(assessed) if assessed else None), timer

    def _save(self, call: Call, was: Call, timer: int) -> None:
        """Only what changed is written: state grows by what a turn adds."""
        for state, now, old in ((self.slots, call.slots, was.slots), (self.asked, call.asked, was.asked)):
            for k, v in now.items():
                if old.get(k) != v:
                    state.updateValue((k,), (v,))
        if added := call.unanswered[len(was.unanswered):]:
            self.unanswered.appendList([(q, s) for q, s in added])
        if more := call.corrections[len(was.corrections):]:
            self.corrections.appendList([(c,) for c in more])
        self.rest.update((call.region, call.last_asked, call.given_up, None if call.assessed is None else json.dumps(call.assessed), timer))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        call, timer = self._load()
        was = Call(dict(call.slots), dict(call.asked), corrections=list(call.corrections), unanswered=list(call.unanswered))
        for r in sorted((r.asDict() for r in rows), key=lambda r: (r["turn"], r["caller"], r["asks"], r["refused"])):
            yield Row(**dict(zip(OUT_NAMES, (key[0], r["turn"], *call.turn(r)), strict=True)))
        if self.idle_ms:
            if timer:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self._save(call, was, timer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.rest.exists() and self.rest.get()[4] == expiredTimerInfo.getExpiryTimeInMs():
            for state in (self.slots, self.asked, self.unanswered, self.corrections, self.rest):
                state.clear()
        yield from ()

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        s = initialState.asDict()
        call = Call(dict(s["slots"] or {}), dict(s["asked"] or {}), list(s["given_up"] or ()), list(s["corrections"] or ()), [(q, list(w)) for q, w in zip(s["unanswered"] or (), s["stems"] or (), strict=True)], s["region"] or "standard", s["last_asked"] or "", s["assessed"])
        self._save(call, Call(), 0)


def snapshot(folded: DataFrame) -> DataFrame:
    """The last state of each conversation of a fold, to start a stream with."""
    last = folded.groupBy("conv_id").agg(F.max_by(F.struct(*[c for c in OUT_NAMES if c != "conv_id"]), "turn").alias("s"))
    return last.select("conv_id", *[F.col(f"s.{c.split()[0]}") for c in SNAPSHOT.split(", ")[1:]])


def stream_turns(turns: DataFrame, pack: Pack, initial: DataFrame | None = None, idle_ms: int | None = None) -> DataFrame:
    """The rows of operators.turns.fold from a stream of turns. initial: a batch of SNAPSHOT rows, one a conversation;
    its questions' stems are made here. A query that runs for ever should set idle_ms."""
    from ..operators import conversation

    start = None
    if initial is not None:
        stems = F.transform("unanswered", conversation.stems)
        start = initial.withColumn("stems", stems).groupBy("conv_id")
    rows = readings(turns, pack).select(READ_NAMES)
    return rows.groupBy("conv_id").transformWithState(Fold(idle_ms), OUT, "Append", "ProcessingTime" if idle_ms else "None", initialState=start)
