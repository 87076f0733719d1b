"""WAV files as a Spark data source: `spark.read.format("wav")`, and the bytes of WAV files as columns.

Partitions are byte ranges of files, planned from names and sizes alone; small files share one. A task reads a file's
RIFF chunks up to the samples, and then only the samples that its rows need, a piece at a time, so neither a long
recording nor a folder of many is held whole. Channels are averaged to one; where the rate divides by the one asked for,
samples are averaged in groups, else positions are interpolated, over the whole recording whatever the pieces.

Options: `path`, a folder or file; `rate`, to resample to (16000; 0 keeps a file's own); `seconds`, of a piece (10);
`partitionBytes` (64 MB). Rows: path, piece, start (in samples given), rate, pcm (16-bit mono, little-endian), error. A
file that is no 16-bit PCM in RIFF gives one row with its error and no samples; one that ends before its declared end
gives what it has, and the error on its last row. A file without samples gives a row of none.

Writing takes rows (name, pcm, rate) to name.wav each; files appear under their names only when all are written.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RATE, WIDTH = 16_000, 2
SCHEMA = "path string, piece int, start long, rate int, pcm binary, error string"
_PCM, _EXTENSIBLE, _UNKNOWN = 1, 0xFFFE, 0xFFFFFFFF


def mono(samples: np.ndarray, channels: int) -> np.ndarray:
    """Interleaved samples averaged to one channel."""
    if channels == 1:
        return samples
    return samples[: len(samples) // channels * channels].reshape(-1, channels).mean(axis=1).astype(np.int16)


def count_at(n: int, source: int, target: int) -> int:
    """Samples that n become at another rate."""
    return n if source == target else n // (source // target) if source % target == 0 else int(n * target / source)


def span(lo: int, hi: int, n: int, source: int, target: int) -> tuple[int, int]:
    """The source samples [a, b) that resampled ones [lo, hi) of n are made of."""
    if source == target:
        return lo, hi
    if source % target == 0:
        return lo * (source // target), hi * (source // target)
    step = (n - 1) / max(1, count_at(n, source, target) - 1)
    return int(lo * step), min(n, int((hi - 1) * step) + 2)


def resampled(samples: np.ndarray, first: int, lo: int, hi: int, n: int, source: int, target: int) -> np.ndarray:
    """Resampled samples [lo, hi) of n; samples are those of span(), of which `first` is the first one's place."""
    if source == target:
        return samples
    if source % target == 0:
        return samples.reshape(-1, source // target).mean(axis=1).astype(np.int16)
    at = np.linspace(0, n - 1, count_at(n, source, target))[lo:hi] if n < 1 << 20 else np.arange(lo, hi) * ((n - 1) / max(1, count_at(n, source, target) - 1))
    return np.interp(at, np.arange(first, first + len(samples)), samples).astype(np.int16)


@dataclass
class Header:
    data: int  # where samples begin
    declared: int
    rate: int
    channels: int


def header(read, size: int) -> Header:
    """From read(offset, n): the format and the place of the samples. Raises ValueError for what isn't 16-bit PCM."""
    if len(start := read(0, 12)) < 12 or start[:4] != b"RIFF" or start[8:] != b"WAVE":
        raise ValueError("no RIFF file of waves")
    at, found = 12, None
    while len(head := read(at, 8)) == 8:
        name, length = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            body = read(at + 8, min(length, 40))
            if len(body) < 16:
                break
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", body[:16])
            if kind == _EXTENSIBLE and len(body) >= 26:
                kind = struct.unpack("<H", body[24:26])[0]
            if kind != _PCM or bits != 8 * WIDTH or not channels or not rate:
                raise ValueError(f"no 16-bit PCM: format {kind}, {bits} bits")
            found = channels, rate
        elif name == b"data":
            if found is None:
                raise ValueError("samples before their format")
            return Header(at + 8, size - at - 8 if length == _UNKNOWN else length, found[1], found[0])
        at += 8 + length + length % 2
    raise ValueError("no samples" if found else "no format")


@dataclass
class _Files(InputPartition):
    ranges: list[tuple[str, int, int, int]]  # name, its size, first and last byte of the range


def _filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.rate, self.seconds = int(options.get("rate", RATE)), float(options.get("seconds", 10))
        self.bytes = int(options.get("partitionbytes", 64 << 20))

    def partitions(self) -> list[InputPartition]:
        system, path = _filesystem(self.path)
        one = system.get_file_info(path)
        found = [one] if one.type == fs.FileType.File else sorted((f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and f.path.lower().endswith(".wav")), key=lambda f: f.path)
        out, small, room = [], [], self.bytes
        for f in found:
            if f.size > self.bytes:
                out += [_Files([(f.path, f.size, lo, min(f.size, lo + self.bytes))]) for lo in range(0, f.size, self.bytes)]
                continue
            if f.size > room and small:
                out.append(_Files(small))
                small, room = [], self.bytes
            small.append((f.path, f.size, 0, f.size))
            room -= f.size
        return [*out, _Files(small)] if small or not out else out

    def read(self, partition: _Files) -> Iterator[tuple]:
        system, _ = _filesystem(self.path)
        for name, size, lo, hi in partition.ranges:
            with system.open_input_file(name) as f:
                def read(at: int, n: int, f=f, size=size) -> bytes:
                    if at >= size:
                        return b""
                    f.seek(at)
                    return f.read(min(n, size - at))

                try:
                    h = header(read, size)
                except ValueError as e:
                    if lo == 0:
                        yield name, 0, 0, None, None, str(e)
                    continue
                yield from self._pieces(name, h, read, size, lo, hi)

    def _pieces(self, name: str, h: Header, read, size: int, lo: int, hi: int) -> Iterator[tuple]:
        """The pieces whose first source byte lies in the range."""
        width = WIDTH * h.channels
        n = min(h.declared, size - h.data) // width
        target = self.rate or h.rate
        total, step = count_at(n, h.rate, target), max(1, int(self.seconds * target))
        short = f"truncated: {h.declared} bytes declared, {size - h.data} there" if size - h.data < h.declared else None
        for piece, start in enumerate(range(0, max(total, 1), step)):
            end = min(total, start + step)
            a, b = span(start, end, n, h.rate, target) if end > start else (0, 0)
            if not lo <= (h.data + a * width if piece else 0) < hi:
                continue
            samples = mono(np.frombuffer(read(h.data + a * width, (b - a) * width), "<i2"), h.channels)
            pcm = resampled(samples, a, start, end, n, h.rate, target) if end > start else samples[:0]
            yield name, piece, start, target, pcm.astype("<i2").tobytes(), short if end >= total else None


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]

    def write(self, iterator) -> _Written:
        system, path = _filesystem(self.path)
        system.create_dir(path, recursive=True)
        files = []
        for row in iterator:
            name, pcm, rate = row[0], bytes(row[1] or b""), row[2] or RATE
            if os.path.basename(name) != name:
                raise ValueError(f"no file name: {name}")
            temporary = f"{path}/_{uuid.uuid4().hex}.part"
            with system.open_output_stream(temporary) as f:
                f.write(b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, _PCM, 1, rate, rate * WIDTH, WIDTH, 8 * WIDTH) + b"data" + struct.pack("<I", len(pcm)))
                f.write(pcm)
            files.append((temporary, f"{path}/{name}.wav"))
        return _Written(files)

    def commit(self, messages) -> None:
        system, _ = _filesystem(self.path)
        for m in messages:
            for temporary, name in m.files if m else ():
                system.move(temporary, name)

    def abort(self, messages) -> None:
        system, _ = _filesystem(self.path)
        for m in messages:
            for temporary, _ in m.files if m else ():
                system.delete_file(temporary)


class WavSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def read_wav(spark: SparkSession, path: str, rate: int = RATE, **options: object) -> DataFrame:
    spark.dataSource.register(WavSource)
    return spark.read.format("wav").options(rate=rate, **options).load(path)


def write_wav(rows: DataFrame, path: str) -> None:
    """rows: (name, pcm, rate)."""
    rows.sparkSession.dataSource.register(WavSource)
    rows.select("name", "pcm", F.col("rate").cast("int")).write.format("wav").mode("append").save(path)


def reports(pieces: DataFrame) -> DataFrame:
    """(path, pieces, samples, duration_ms, error) of each file read."""
    n = F.coalesce(F.length("pcm"), F.lit(0)) / WIDTH
    return pieces.groupBy("path").agg(F.count("pcm").alias("pieces"), F.sum(n).cast("long").alias("samples"), (F.sum(n) * 1000 / F.max("rate")).alias("duration_ms"), F.max("error").alias("error"))


def _little(value: Column, n: int) -> Column:
    digits = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))]))


def as_wav(pcm: Column, rate: int = RATE) -> Column:
    """Samples with a WAV header before them, as bytes."""
    size = F.length(pcm)
    fixed = struct.pack("<IHHIIHH", 16, _PCM, 1, rate, rate * WIDTH, WIDTH, 8 * WIDTH)
    return F.concat(F.lit(b"RIFF"), _little(size + 36, 4), F.lit(b"WAVEfmt " + fixed + b"data"), _little(size, 4), pcm)


def silence(ms: Column, rate: int = RATE) -> Column:
    """Samples of nothing for so many milliseconds."""
    return F.unhex(F.repeat(F.lit("00"), F.floor(ms * rate * WIDTH / 1000).cast("int")))
