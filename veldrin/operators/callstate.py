"""Calls as state machines: idle, listening, thinking, speaking, ended; audio in chunks of any size, deadlines, interruptions.

A call is a sequence of events in order of (at, seq): `start`; `audio`, a chunk of 16-bit samples; `transcript`, the
recogniser's answer (text, or an error); `reply`, that the agent begins to speak (text, escalated); `piece`, the size of
a piece of MP3 handed over; `spoken`, that all of it is; `close`. `Session` is the machine. It is used by a fold over
sorted partitions (`sessions`) and by keyed state (streaming.calls); timers are its `deadline`, which both let pass in
the same way: what is due at or before an event's time happens before the event.

- listening: frames go to the endpointer; an utterance that counts makes the call think. Audio that comes while a reply
  is still in the room (as many bytes as it lasts and until it is over, whichever is less) is thrown away, unless the
  caller may interrupt.
- thinking: audio is thrown away. A transcript that is silence or the agent's own voice goes back to listening; none at
  all is a failure that is spoken about. Without an answer for HOLD_MS, the call listens again.
- speaking: audio is thrown away, or, where the caller may interrupt, INTERRUPTS voiced frames in a row end the reply.
  Without `spoken` for HOLD_MS after the last piece, it counts as spoken.
- in every other state, SILENT_MS without an event ends the call, with what was being said as a last utterance.

Events of a state that they don't belong to, and all after the end, change nothing. Null chunks and sizes are empty. Equal
(at, seq) events come by their kinds.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calls import MP3_BYTES_PER_SECOND, SAMPLE_BYTES, SAMPLE_RATE, SETTLE_SECONDS
from .frames import LEAST_RMS, Listener, energy, reframe

# Voiced frames that interrupt a reply, and the share of heard words that make them the agent's own.
INTERRUPTS = 12
OWN_LEAST, OWN_MOST, OWN_SHARE = 3, 6, 0.8
#: How long a call waits for the recogniser or the speaker, and for anything at all.
HOLD_MS, SILENT_MS = 30_000, 120_000
EVENTS = "call_id long, at long, seq long, kind string, audio binary, n_bytes long, text string, error string, escalated boolean"
NAMES = [c.split()[0] for c in EVENTS.split(", ")]
OUT = "call_id long, at long, seq long, n int, kind string, state string, text string, duration_ms double, ended_by string, rms double"
OUT_NAMES = [c.split()[0] for c in OUT.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.string(), pa.float64()]
Voiced = Callable[[bytes], bool]


def loud(frame: bytes) -> bool:
    """A stand-in for a voice detector: frames as loud as the quietest speech."""
    return energy(frame) >= LEAST_RMS**2


def own_voice(heard: str, spoken: str) -> bool:
    words = re.findall("[a-z']+", heard.lower())
    said = set(re.findall("[a-z']+", spoken.lower()))
    return OWN_LEAST <= len(words) <= OWN_MOST and sum(w in said for w in words) >= OWN_SHARE * len(words)


@dataclass
class Session:
    """Where a call is. pending holds less than a frame; listener at most one turn of frames' energies."""

    call_id: int
    interruptible: bool = False
    voiced: Voiced = loud
    state: str = "idle"
    pending: bytes = b""
    listener: Listener = field(default_factory=Listener)
    frame: int = 0
    run: int = 0
    turn: int = 0
    spoken: str = ""
    spoken_ms: float = 0.0
    escalated: bool = False
    deaf_bytes: int = 0
    deaf_until: int = 0
    deadline: int | None = None

    def _reset(self) -> None:
        self.pending, self.listener, self.run = b"", Listener(), 0

    def _to(self, state: str) -> Iterator[tuple]:
        self.state = state
        yield "state", "", None, None, None

    def _finished(self, found: tuple | None) -> Iterator[tuple]:
        """What the endpointer closed: an utterance to be recognised, or a recording that isn't one, and why."""
        if found is None:
            return
        _, _, ms, by, rms, why = found
        yield ("ignored", why, ms, by, rms) if why else ("utterance", f"{self.call_id}-t{self.turn + 1}", ms, by, rms)
        if not why:
            self.turn += 1
            if self.state == "listening":
                yield from self._to("thinking")

    def _spoken(self, at: int) -> Iterator[tuple]:
        if self.escalated:
            yield from self._to("ended")
            yield "ended", "escalated", None, None, None
            return
        if not self.interruptible:
            seconds = self.spoken_ms / 1000 + SETTLE_SECONDS
            self.deaf_bytes, self.deaf_until = int(seconds * SAMPLE_RATE * SAMPLE_BYTES), at + round(seconds * 1000)
            self._reset()
        yield from self._to("listening")

    def _heard(self, at: int, audio: bytes) -> Iterator[tuple]:
        if self.state == "speaking" and self.interruptible:
            frames, self.pending = reframe(self.pending, audio)
            for f in frames:
                self.run = self.run + 1 if self.voiced(f) else 0
                if self.run >= INTERRUPTS:
                    self._reset()
                    self.state = "listening"
                    yield "barge_in", "", None, None, None
                    yield "state", "", None, None, None
                    return
        if self.state != "listening":
            return
        if self.deaf_bytes > 0:
            self.deaf_bytes -= len(audio)
            if at < self.deaf_until:
                return
            self.deaf_bytes = 0
        open_before = self.listener.speaking
        frames, self.pending = reframe(self.pending, audio)
        for f in frames:
            self.frame += 1
            yield from self._finished(self.listener.feed(self.frame, self.voiced(f), energy(f)))
            if self.state != "listening":  # the rest of the chunk comes while the call thinks
                self.pending = b""
                return
        if self.interruptible and self.listener.speaking and not open_before:
            yield "barge_in", "", None, None, None

    def _event(self, e: dict) -> Iterator[tuple]:
        kind, at, text = e["kind"], e["at"], (e["text"] or "").strip()
        if kind == "start" and self.state == "idle":
            yield from self._to("listening")
        elif kind == "audio":
            yield from self._heard(at, e["audio"] or b"")
        elif kind == "transcript" and self.state == "thinking":
            if text and not self.interruptible and self.spoken and own_voice(text, self.spoken):
                yield "echo", text, None, None, None
                yield from self._to("listening")
            elif e["error"] == "silence":
                yield from self._to("listening")
            elif not text:
                yield "failed", e["error"] or "", None, None, None
            else:
                yield "transcript", text, None, None, None
        elif kind == "reply" and self.state in ("listening", "thinking"):
            self.spoken, self.spoken_ms, self.escalated = text, 0.0, bool(e["escalated"])
            self._reset()
            if not text:
                yield "trouble", "", None, None, None
            yield from self._to("speaking")
        elif kind == "piece" and self.state == "speaking":
            self.spoken_ms += (e["n_bytes"] or 0) / MP3_BYTES_PER_SECOND * 1000
        elif kind == "spoken" and self.state == "speaking":
            yield from self._spoken(at)
        elif kind == "close":
            yield from self._over("closed")

    def _over(self, why: str) -> Iterator[tuple]:
        found, self.state = self.listener.flush(), "ended"  # what was being said is an utterance that nothing waits for
        yield from self._finished(found)
        yield from self._to("ended")
        yield "ended", why, None, None, None

    def _due(self) -> Iterator[tuple]:
        if self.state == "thinking":
            yield "timeout", "", None, None, None
            yield from self._to("listening")
        elif self.state == "speaking":
            yield from self._spoken(self.deadline)
        else:
            yield from self._over("silent")

    def pass_time(self, until: int) -> Iterator[tuple]:
        """Rows of OUT for the deadlines up to a time."""
        while self.deadline is not None and self.deadline <= until:
            at, n = self.deadline, 0
            for n, row in enumerate(self._due()):
                yield self.call_id, at, -1, n, row[0], self.state, *row[1:]
            self._wait(at)

    def _wait(self, at: int) -> None:
        self.deadline = None if self.state == "ended" else at + (HOLD_MS if self.state in ("thinking", "speaking") else SILENT_MS)

    def on(self, e: dict) -> Iterator[tuple]:
        """Rows of OUT for an event of EVENTS and for what was due before it."""
        yield from self.pass_time(e["at"])
        if self.state == "ended":
            return
        for n, row in enumerate(self._event(e)):
            yield self.call_id, e["at"], e["seq"], n, row[0], self.state, *row[1:]
        self._wait(e["at"])


def in_order(events: list[dict]) -> list[dict]:
    return sorted(events, key=lambda e: (e["at"], e["seq"], e["kind"] or ""))


def sessions(events: DataFrame, interruptible: bool = False, voiced: Voiced = loud) -> DataFrame:
    """OUT of whole calls from EVENTS rows, deadlines after the last event included; a task holds one call at a time."""
    rows = events.select([F.col(n) for n in NAMES]).repartition("call_id").sortWithinPartitions("call_id", "at", "seq", F.coalesce("kind", F.lit("")))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call: Session | None = None

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(_TYPES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=OUT_NAMES)

        for batch in batches:
            out: list[tuple] = []
            for lo in range(0, batch.num_rows, 256):
                for e in batch.slice(lo, 256).to_pylist():
                    if call is None or call.call_id != e["call_id"]:
                        if call is not None:
                            out += call.pass_time(1 << 62)
                        call = Session(e["call_id"], interruptible, voiced)
                    out += call.on(e)
            yield made(out)
        if call is not None:
            yield made(list(call.pass_time(1 << 62)))

    return rows.mapInArrow(fold, OUT)
