"""WAV files: round trips, rates, pieces, faults as rows."""

import io
import struct
import wave

import numpy as np
from pyspark.sql import functions as F

from veldrin.sources import audio as A


def wav(samples, rate=16_000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.asarray(samples, "<i2").tobytes())
    return out.getvalue()


def whole(samples, rate, channels, target):
    """The whole recording at once."""
    x = np.asarray(samples, np.int16)
    if channels > 1:
        x = x[: len(x) // channels * channels].reshape(-1, channels).mean(axis=1).astype(np.int16)
    if rate == target:
        return x
    if rate % target == 0:
        k = rate // target
        return x[: len(x) // k * k].reshape(-1, k).mean(axis=1).astype(np.int16)
    n = int(len(x) * target / rate)
    return np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x).astype(np.int16)


def joined(df):
    out = {}
    for r in df.orderBy("path", "start").collect():
        name = r.path.rsplit("/", 1)[-1]
        assert r.pcm is None or r.start == len(out.get(name, b"")) // 2
        out[name] = out.get(name, b"") + bytes(r.pcm or b"")
    return {k: np.frombuffer(v, "<i2") for k, v in out.items()}


def test_rates_channels_and_pieces(spark, tmp_path):
    rng = np.random.default_rng(1)
    made = {}
    for rate, channels, n in ((16_000, 1, 40_000), (48_000, 1, 100_001), (32_000, 2, 90_000), (44_100, 1, 131_071), (44_100, 2, 77_777), (8_000, 1, 9_999), (16_000, 1, 0), (22_050, 1, 1)):
        name = f"f{rate}-{channels}-{n}.wav"
        made[name] = (rng.integers(-32768, 32768, n), rate, channels)
        (tmp_path / name).write_bytes(wav(*made[name]))
    for more in ({}, {"seconds": 0.7}, {"seconds": 0.5, "partitionBytes": 50_000}):
        df = A.read_wav(spark, str(tmp_path), **more)
        got = joined(df)
        assert got.keys() == made.keys()
        for name, (x, rate, channels) in made.items():
            want = whole(x, rate, channels, 16_000)
            assert len(got[name]) == len(want) and np.abs(got[name].astype(int) - want).max(initial=0) <= (1 if rate % 16_000 else 0), name
        if "partitionBytes" in more:
            assert df.rdd.getNumPartitions() > 10
    own = joined(A.read_wav(spark, str(tmp_path), rate=0, seconds=0.3))
    assert all(np.array_equal(own[n], whole(x, r, c, r)) for n, (x, r, c) in made.items())
    one = joined(A.read_wav(spark, f"file://{tmp_path}/f48000-1-100001.wav"))
    assert list(one) == ["f48000-1-100001.wav"]


def test_faults_are_rows(spark, tmp_path):
    x = np.arange(1000, dtype=np.int16)
    good = wav(x)
    extra = good[:12] + b"LIST" + struct.pack("<I", 5) + b"notes\0" + good[12:]
    files = {"cut": good[:-501], "extra": extra, "junk": b"hello", "empty": b"", "float": good[:20] + struct.pack("<H", 3) + good[22:], "nodata": good[:36], "endless": good[:40] + b"\xff" * 4 + good[44:]}
    for name, data in files.items():
        (tmp_path / f"{name}.wav").write_bytes(data)
    got = {r.path.rsplit("/", 1)[-1][:-4]: r for r in A.reports(A.read_wav(spark, str(tmp_path), seconds=0.01)).collect()}
    assert got.keys() == files.keys()
    assert got["cut"].error.startswith("truncated: 2000 bytes declared, 1499 there") and got["cut"].samples == 749
    assert got["extra"].error is None and got["extra"].samples == got["endless"].samples == 1000 and got["extra"].pieces == 7 and got["extra"].duration_ms == 62.5
    assert all(got[n].samples == 0 and got[n].error for n in ("junk", "empty", "float", "nodata"))


def test_writes_read_back(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(f"n{i}", rng.integers(-9, 9, 100 * i).astype("<i2").tobytes(), 16_000) for i in range(6)]
    df = spark.createDataFrame(rows, "name string, pcm binary, rate int").repartition(3)
    A.write_wav(df, str(tmp_path / "out"))
    assert {k[:-4]: v.tobytes() for k, v in joined(A.read_wav(spark, str(tmp_path / "out"))).items()} == {n: p for n, p, _ in rows}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(f"{n}.wav" for n, _, _ in rows)
    made = df.select("name", "pcm", A.as_wav(F.col("pcm")).alias("wav")).collect()
    assert all(bytes(r.wav) == wav(np.frombuffer(r.pcm, "<i2")) for r in made)
    assert bytes(spark.range(1).select(A.silence(F.lit(20)).alias("s")).first().s) == bytes(640)
