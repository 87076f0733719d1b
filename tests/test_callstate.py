"""Calls: transitions by hand, chunks of any size, timers, batch against stream over restarts."""

import datetime
import itertools
import random
import uuid

import numpy as np

from veldrin.operators import callstate as C
from veldrin.operators import frames
from veldrin.streaming import calls as SC
from veldrin.streaming import endpoint

FRAME = frames.FRAME_BYTES


def tone(n, level=2000):
    return np.full(n * FRAME // 2, level, "<i2").tobytes()


def quiet(n):
    return bytes(n * FRAME)


def event(call, at, kind, audio=None, n_bytes=None, text=None, error=None, escalated=None, count=itertools.count()):
    return {"call_id": call, "at": at, "seq": next(count), "kind": kind, "audio": audio, "n_bytes": n_bytes, "text": text, "error": error, "escalated": escalated}


def said(call, at, n=30, chunk=1234):
    """A spoken answer and the silence that ends it, in chunks of a size that is no frame's."""
    data = quiet(3) + tone(n) + quiet(36)
    return [event(call, at + 20 * (lo // FRAME), "audio", data[lo : lo + chunk]) for lo in range(0, len(data), chunk)]


def run(events, **more):
    s = C.Session(events[0]["call_id"], **more)
    return [row for e in events for row in s.on(e)] + list(s.pass_time(1 << 62))


def kinds(rows):
    return [r[4] if r[4] != "state" else r[5] for r in rows]


TALK = [
    event(1, 0, "start"), *said(1, 100), event(1, 2000, "transcript", text="do you cover teeth"), event(1, 2500, "reply", text="The plan covers teeth and eyes."), event(1, 2600, "piece", n_bytes=6000),
    *said(1, 2700), event(1, 4200, "spoken"), *said(1, 4300, 20), *said(1, 5700), event(1, 7600, "transcript", text="the plan covers eyes"), *said(1, 8000), event(1, 9700, "transcript", error="silence"),
    *said(1, 10_000), event(1, 11_700, "transcript", error="no answer"), event(1, 11_800, "reply", text="Sorry?"), event(1, 11_900, "spoken"), *said(1, 12_500), event(1, 14_000, "transcript", text="a person please"),
    event(1, 14_100, "reply", text="One moment.", escalated=True), event(1, 14_500, "spoken"), *said(1, 16_000)]


def test_transitions():
    got = run(TALK)
    assert kinds(got) == [
        "listening", "utterance", "thinking", "transcript", "speaking", "listening", "utterance", "thinking", "echo", "listening", "utterance", "thinking", "listening", "utterance", "thinking", "failed", "speaking", "listening",
        "utterance", "thinking", "transcript", "speaking", "ended", "ended"]
    assert [r[6] for r in got if r[4] == "utterance"] == [f"1-t{k}" for k in range(1, 6)] and got[-1][6] == "escalated"
    # one frame before the voice, and three of the silence after it
    assert [(r[7], r[8]) for r in got if r[4] == "utterance"] == [(20.0 * (1 + n + 3), "silence") for n in (30, 30, 30, 30, 30)]


def test_a_reply_in_the_room_is_not_heard():
    """Deaf for as many bytes as the reply lasts, or until it is over."""
    def heard(first, step):
        events = [event(1, 0, "start"), event(1, 10, "reply", text="Hello there."), event(1, 20, "piece", n_bytes=6000), event(1, 30, "spoken")]
        data = tone(20) + quiet(40)
        return "utterance" in kinds(run(events + [event(1, first + 20 * k // step, "audio", data[k * FRAME : (k + 1) * FRAME]) for k in range(60)] + [event(1, first + 3000, "close")]))

    assert not heard(40, 1) and heard(1431, 1)
    assert not heard(40, 100)  # all bytes at once are still within the time


def test_interruptions_reset_the_listener():
    events = [event(1, 0, "start"), event(1, 10, "reply", text="A long reply."), *[event(1, 20 + k, "audio", tone(1)[:500]) for k in range(30)], event(1, 100, "audio", tone(30) + quiet(36)), event(1, 200, "transcript", text="wait"), event(1, 300, "spoken")]
    got = kinds(run(events, interruptible=True))
    assert got[:3] == ["listening", "speaking", "barge_in"] and got[3] == "listening" and "utterance" in got and got.index("utterance") > 3
    assert "barge_in" not in kinds(run(events))


def test_deadlines():
    got = run([event(1, 0, "start"), *said(1, 100)])
    assert kinds(got) == ["listening", "utterance", "thinking", "timeout", "listening", "ended", "ended"] and got[-1][6] == "silent"
    last = max(e["at"] for e in said(1, 100) if e["kind"] == "audio")
    assert got[3][1] == last + C.HOLD_MS and got[-1][1] == last + C.HOLD_MS + C.SILENT_MS
    got = run([event(1, 0, "start"), event(1, 5, "reply", text="x y"), event(1, 9, "piece", n_bytes=60), event(1, 40_000, "audio", tone(30)), event(1, 40_100, "close"), event(1, 41_000, "start")])
    assert kinds(got) == ["listening", "speaking", "listening", "utterance", "ended", "ended"] and got[2][1] == 9 + C.HOLD_MS and got[3][8] == "close"
    assert kinds(run([event(1, 0, "audio", tone(30)), event(1, 1, "transcript", text="x"), event(1, 2, "close")])) == ["ended", "ended"]


def test_chunks_of_any_size_give_what_whole_frames_give():
    rng = random.Random(2)
    data = b"".join(rng.choice([tone(rng.randint(1, 60)), quiet(rng.randint(1, 60)), tone(rng.randint(1, 20), 60)]) for _ in range(60))
    listener, want = frames.Listener(), []
    for k in range(len(data) // FRAME):
        f = data[k * FRAME : (k + 1) * FRAME]
        want.append(listener.feed(k + 1, C.loud(f), frames.energy(f)))
    want = [w[2:5] for w in [*want, listener.flush()] if w]
    assert len(want) > 5
    for size in (100, 333, 640, 641, 5000, len(data)):
        listener, pending, got, n = frames.Listener(), b"", [], 0
        for lo in range(0, len(data), size):
            whole, pending = frames.reframe(pending, data[lo : lo + size])
            for f in whole:
                n += 1
                got.append(listener.feed(n, C.loud(f), frames.energy(f)))
        assert [g[2:5] for g in [*got, listener.flush()] if g] == want
    spoken = {tuple(r[7:] for r in run([event(1, 0, "start"), *said(1, 10, 25, size)]) if r[4] == "utterance") for size in (100, 333, 640, 641, 5000, 100_000)}
    assert len(spoken) == 1 and len(next(iter(spoken))) == 1


def made(events):
    return [tuple(e[n] for n in C.NAMES) for e in events]


def test_batch_equals_stream_over_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    base = 1_700_000_000_000
    talk = [e | {"at": base + e["at"]} for e in TALK]
    other = [e | {"call_id": 2, "at": e["at"] + 300} for e in talk[: len(TALK) // 2]]
    late = [event(3, base + 400_000, "start"), event(3, base + 400_100, "close")]  # moves the watermark past all deadlines
    events = talk + other + late
    schema = C.EVENTS
    want = sorted(tuple(r) for r in C.sessions(spark.createDataFrame(made(events), schema).repartition(3)).collect())
    assert sorted(run(talk) + run(other) + run(late)) == want
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", f"cp{uuid.uuid4().hex}"))
    cuts = sorted(e["at"] for e in events)
    cuts = [-1, cuts[len(cuts) // 3], cuts[2 * len(cuts) // 3], base + 300_000, 1 << 60]
    for lo, hi in itertools.pairwise(cuts):
        part = [(*r[:1], *r[2:], datetime.datetime.fromtimestamp(r[1] / 1000, datetime.UTC)) for r in made(events) if lo < r[1] <= hi]
        names = ", ".join(c for c in schema.split(", ") if not c.startswith("at ")) + ", ts timestamp"
        if part:
            spark.createDataFrame(part, names).coalesce(1).write.mode("append").parquet(src)
        q = SC.stream_sessions(spark.readStream.schema(names).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted(tuple(r) for r in spark.read.schema(C.OUT).parquet(out).collect())
    assert got == want


def test_streamed_frames(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(4)
    rows = []
    for call in (1, 2):
        n = 0
        for _ in range(40):
            voiced = rng.random() < 0.5
            for _ in range(rng.randint(2, 50)):
                rows.append((call, n, voiced, 400.0 if voiced else 5.0, False))
                n += 1
    schema = "call_id long, frame_no long, voiced boolean, rms double, closed boolean"
    batch = sorted(tuple(r) for r in frames.utterances(spark.createDataFrame(rows, schema)).collect())
    rows += [(c, 10_000, None, None, True) for c in (1, 2)]
    src, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    for part in ([r for r in rows if r[1] < 400], [r for r in rows if r[1] >= 400]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        q = endpoint.stream_utterances(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", out).option("checkpointLocation", cp).trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted(tuple(r) for r in spark.read.schema(frames.UTTERANCE).parquet(out).collect()) == batch and len(batch) > 5
