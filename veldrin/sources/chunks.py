"""Live call audio as a streaming source: `spark.readStream.format("call_chunks")` over a spool folder.

Whoever holds the connections appends what they send to files of the folder: `<call>.pcm`, raw 16-bit samples, and
`<call>.jsonl`, commands, one JSON object a line. An offset is how far each file has been read, so a query that is
stopped and started again goes on at the byte where its last committed batch ended: nothing is lost, nothing comes
twice, and a batch that is tried again reads the same bytes. Files that grow are read up to the length seen when the
batch was planned, samples to a whole sample, commands to a whole line.

Options: `path`; `chunkBytes`, the most bytes of a row (32000, a second); `maxBytes`, the most bytes of a file in one
batch (4 MB), so one call that fell behind doesn't make a batch without bound. Rows: call_id, position (a file's byte
that the row begins at), kind (`audio`, or a command's), audio, text (a command's line).

A file that shrinks was replaced: it is read from its beginning. Names that are no number are no calls.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from .audio import RATE, WIDTH, _filesystem

SCHEMA = "call_id long, position long, kind string, audio binary, text string"


@dataclass
class _Part(InputPartition):
    name: str
    start: int
    end: int


class _Chunks(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.chunk = max(WIDTH, int(options.get("chunkbytes", 2 * RATE)) // WIDTH * WIDTH)
        self.most = max(self.chunk, int(options.get("maxbytes", 4 << 20)))
        self.at: dict[str, int] = {}

    def _sizes(self) -> dict[str, int]:
        system, path = _filesystem(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        return {f.base_name: f.size for f in found if f.type == fs.FileType.File and f.extension in ("pcm", "jsonl") and f.base_name.split(".")[0].lstrip("-").isdigit()}

    def _read(self, name: str, start: int, end: int) -> bytes:
        system, path = _filesystem(self.path)
        with system.open_input_file(f"{path}/{name}") as f:
            f.seek(start)
            return f.read(end - start)

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = dict(self.at)
        for name, size in self._sizes().items():
            start = self.at.get(name, 0)
            start = 0 if size < start else start
            if name.endswith(".pcm"):
                end = start + min(self.most, size - start) // WIDTH * WIDTH
            else:
                read = min(self.most, size - start)
                end = start + self._read(name, start, start + read).rfind(b"\n") + 1
                while end == start and start + read < size:  # a line longer than a batch's share goes whole
                    read = min(2 * read, size - start)
                    end = start + self._read(name, start, start + read).rfind(b"\n") + 1
            out[name] = end
        self.at = out
        return out

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.at = dict(end)
        return [_Part(n, 0 if e < start.get(n, 0) else start.get(n, 0), e) for n, e in sorted(end.items()) if e != start.get(n, 0)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        call, kind = partition.name.split(".")
        if kind == "pcm":
            for at in range(partition.start, partition.end, self.chunk):
                yield int(call), at, "audio", self._read(partition.name, at, min(partition.end, at + self.chunk)), None
            return
        at = partition.start
        for line in self._read(partition.name, partition.start, partition.end).split(b"\n")[:-1]:
            if line.strip():
                text = line.decode("utf-8", "replace")
                try:
                    said = json.loads(text)
                    command = str(said.get("kind") or "unknown") if isinstance(said, dict) else "unknown"
                except ValueError:
                    command = "unreadable"
                yield int(call), at, command, None, text
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        """Spool files stay: whoever wrote them knows when a call is over."""


class ChunkSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "call_chunks"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Chunks(self.options)


def read_chunks(spark: SparkSession, path: str, **options: object) -> DataFrame:
    spark.dataSource.register(ChunkSource)
    return spark.readStream.format("call_chunks").options(**options).load(path)


def as_events(chunks: DataFrame) -> DataFrame:
    """Events for streaming.calls: a chunk's time is its place in the call's audio, a command's its `at`, in milliseconds."""
    command = lambda name, kind: F.get_json_object("text", f"$.{name}").cast(kind)
    audio = F.col("kind") == "audio"
    at = F.when(audio, F.floor(F.col("position") / (RATE * WIDTH / 1000))).otherwise(command("at", "long"))
    return chunks.select(
        "call_id", F.timestamp_millis(at).alias("ts"), F.col("position").alias("seq"), "kind", "audio", command("n_bytes", "long").alias("n_bytes"), command("text", "string").alias("text"), command("error", "string").alias("error"),
        command("escalated", "boolean").alias("escalated"))
