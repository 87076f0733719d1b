"""Call audio as it comes, over stops and starts; escalations, over batches that are tried again."""

import json

import numpy as np
from pyspark.sql import functions as F

from veldrin.operators import callstate
from veldrin.sources import chunks
from veldrin.streaming import calls, escalations


def run(df, out, cp):
    q = df.writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(cp)).trigger(availableNow=True).start()
    q.awaitTermination()
    assert q.exception() is None


def test_a_restart_neither_loses_nor_repeats_a_chunk(spark, tmp_path):
    spool, out, cp = tmp_path / "spool", tmp_path / "out", tmp_path / "cp"
    spool.mkdir()
    rng = np.random.default_rng(1)
    sent = {1: rng.bytes(100_001), 22: rng.bytes(64_000), 3: b""}
    lines = [json.dumps({"kind": k, "at": n * 10, "text": "é" * n}, ensure_ascii=False) for n, k in enumerate(["start", "reply", "close"])] + ["not json", "[1]"]
    said = "".join(f"{x}\n" for x in lines).encode() + b'{"kind": "half'
    (spool / "notes.pcm").write_bytes(b"12")
    steps = 5
    for step in range(1, steps + 1):
        for call, data in sent.items():
            with open(spool / f"{call}.pcm", "ab") as f:
                f.write(data[len(data) * (step - 1) // steps : len(data) * step // steps])
        with open(spool / "1.jsonl", "ab") as f:
            f.write(said[len(said) * (step - 1) // steps : len(said) * step // steps])
        run(chunks.read_chunks(spark, str(spool), chunkBytes=1000, maxBytes=7000), out, cp)  # a query of its own each time
    for _ in range(3):  # what was more than a batch's share
        run(chunks.read_chunks(spark, str(spool), chunkBytes=1000, maxBytes=70_000), out, cp)
    rows = spark.read.schema(chunks.SCHEMA).parquet(str(out)).collect()
    assert len({(r.call_id, r.position, r.kind == "audio") for r in rows}) == len(rows)
    for call, data in sent.items():
        own = sorted((r.position, bytes(r.audio)) for r in rows if r.call_id == call and r.kind == "audio")
        assert b"".join(a for _, a in own) == data[: len(data) // 2 * 2] and all(len(a) <= 1000 for _, a in own)
    assert [(r.kind, r.text) for r in sorted((r for r in rows if r.kind != "audio"), key=lambda r: r.position)] == list(zip(["start", "reply", "close", "unreadable", "unknown"], lines, strict=True))


def test_from_spool_to_call_states(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    (tmp_path / "spool").mkdir()
    tone = np.full(16_000 // 2, 2000, "<i2").tobytes() + bytes(40_000)
    (tmp_path / "spool" / "5.pcm").write_bytes(tone)
    (tmp_path / "spool" / "5.jsonl").write_text('{"kind": "start", "at": 1}\n{"kind": "transcript", "at": 2000, "text": "hello there"}\n{"kind": "close", "at": 3000}\n')
    events = chunks.as_events(chunks.read_chunks(spark, str(tmp_path / "spool"), chunkBytes=3000))
    run(calls.stream_sessions(events), tmp_path / "out", tmp_path / "cp")
    kinds = [r.kind if r.kind != "state" else r.state for r in spark.read.schema(callstate.OUT).parquet(str(tmp_path / "out")).orderBy("at", "seq", "n").collect()]
    assert kinds == ["listening", "utterance", "thinking", "transcript", "ended", "ended"]


LEAD = "call_id long, lead_id string, escalated_to string, business_unit string, collected map<string,string>, unanswered array<string>, summary string, next_action string"


def test_escalations_are_sent_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def target(key, body):
        with open(log / key, "a") as f:
            f.write(body + "\n")
        if key.startswith("3-"):
            raise OSError("line down")
        return not key.startswith("2-")

    leads = [(k, f"L{k}", "ESC-REQUEST" if k else None, "u", {"age": "4", "full_name": "Ann Lee"}, ["why"], "mail me at ann@example.com", "call") for k in range(5)]
    df = escalations.payloads(spark.createDataFrame([*leads, leads[1]], LEAD), "now").repartition(2).cache()
    write = escalations.sink(str(tmp_path / "sink"), target)
    write(df.where("call_id < 4"), 0)
    first = {p.name: p.read_text() for p in log.iterdir()}
    assert first.keys() == {"1-L1", "2-L2", "3-L3"} and all(t.count("\n") == 1 for t in first.values()) and "ann@" not in first["1-L1"] and "Ann Lee" not in first["1-L1"]
    write(df.where("call_id < 4"), 0)  # the same batch again
    write(df, 1)  # and its calls in a later one
    assert {p.name: p.read_text().count("\n") for p in log.iterdir()} == {"1-L1": 1, "2-L2": 1, "3-L3": 1, "4-L4": 1}
    rows = {kind: {(r.key, r.error) for r in spark.read.json(str(tmp_path / "sink" / kind)).withColumn("error", F.col("error") if kind == "undelivered" else F.lit(None)).collect()} for kind in ("delivered", "undelivered")}
    assert rows == {"delivered": {("1-L1", None), ("4-L4", None)}, "undelivered": {("2-L2", "refused"), ("3-L3", "OSError: line down")}}
    assert escalations.attempts(spark, str(tmp_path / "sink")).count() == 4
    escalations.sink(str(tmp_path / "files"))(df, 7)
    assert spark.read.json(str(tmp_path / "files" / "undelivered")).count() == 4
