"""Frames of call audio to utterances: one state machine, used by batch and by streams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Audio format and limits.
RATE, WIDTH, FRAME_MS = 16_000, 2, 20
FRAME_BYTES = RATE * WIDTH * FRAME_MS // 1000
START_FRAMES, END_FRAMES, KEPT_SILENCE, MAX_FRAMES = 3, 35, 3, 25_000 // FRAME_MS
LEAST_VOICED, LEAST_SHARE, LEAST_MS, LEAST_RMS = 5, 0.20, 250, 100
UTTERANCE = "call_id long, first_frame long, last_frame long, duration_ms double, ended_by string, rms double, reason string"
UTTERANCE_NAMES = [c.split()[0] for c in UTTERANCE.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string(), pa.float64(), pa.string()]


@dataclass
class Listener:
    """Where a call is: frames that may belong to a turn, runs, counts. It holds at most one turn of frames' energies."""

    speaking: bool = False
    run: int = 0
    silence: int = 0
    voiced: int = 0
    first: int = 0
    energies: list[float] = field(default_factory=list)

    def feed(self, frame: int, voiced: bool, energy: float) -> tuple | None:
        """energy: the mean square of the frame's samples. Returns (first, last, ms, ended by, rms, reason) when a turn
        ends; the reason is empty if it counts as an utterance."""
        self.energies.append(energy)
        if not self.speaking:
            del self.energies[: -(START_FRAMES + 1)]
            self.run = self.run + 1 if voiced else 0
            if self.run >= START_FRAMES:
                self.speaking, self.first, self.silence, self.voiced = True, frame - len(self.energies) + 1, 0, self.run
            return None
        self.silence = 0 if voiced else self.silence + 1
        self.voiced += voiced
        if self.silence >= END_FRAMES:
            return self.end("silence")
        return self.end("length") if len(self.energies) >= MAX_FRAMES else None

    def end(self, by: str) -> tuple:
        frames, first, voiced = self.energies, self.first, self.voiced
        self.speaking, self.run, self.silence, self.voiced, self.energies = False, 0, 0, 0, []
        kept = len(frames) - (END_FRAMES - KEPT_SILENCE) if by == "silence" and len(frames) - (END_FRAMES - KEPT_SILENCE) > 1 else len(frames)
        loud = float(np.sqrt(np.mean(frames[:kept])))
        ms = float(kept * FRAME_MS)
        if voiced < LEAST_VOICED or voiced / max(1, len(frames)) < LEAST_SHARE:
            why = "too little voice"
        else:
            why = "too short" if ms < LEAST_MS else "too quiet" if loud < LEAST_RMS else ""
        return first, first + kept - 1, ms, by, loud, why

    def flush(self) -> tuple | None:
        return self.end("close") if self.speaking else None


def reframe(pending: bytes, chunk: bytes) -> tuple[list[bytes], bytes]:
    """Whole frames of what was left over and a chunk of any size, and what is left over now."""
    data = pending + chunk
    n = len(data) // FRAME_BYTES
    return [data[i * FRAME_BYTES : (i + 1) * FRAME_BYTES] for i in range(n)], data[n * FRAME_BYTES :]


def energy(frame: bytes) -> float:
    x = np.frombuffer(frame[: len(frame) // 2 * 2], "<i2").astype(np.float64)
    return float(np.mean(x * x)) if len(x) else 0.0


def utterances(frames: DataFrame) -> DataFrame:
    """Utterances of whole calls from (call_id, frame_no, voiced, rms) rows; calls end with their last frame. One pass
    over sorted partitions, which holds the state of one call at a time. Null voices and energies are none."""
    rows = frames.select(
        F.col("call_id").cast("long").alias("call_id"), F.col("frame_no").cast("long").alias("frame_no"), F.coalesce("voiced", F.lit(False)).alias("voiced"), F.coalesce(F.col("rms").cast("double"), F.lit(0.0)).alias("rms"),
    ).repartition("call_id").sortWithinPartitions("call_id", "frame_no", "voiced", "rms")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call, listener = None, Listener()

        def made(out: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(_TYPES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=UTTERANCE_NAMES)

        for batch in batches:
            out: list[tuple] = []
            for c, n, v, r in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c != call:
                    if last := listener.flush():
                        out.append((call, *last))
                    call, listener = c, Listener()
                if found := listener.feed(n, v, r * r):
                    out.append((c, *found))
            yield made(out)
        if last := listener.flush():
            yield made([(call, *last)])

    return rows.mapInArrow(fold, UTTERANCE)
