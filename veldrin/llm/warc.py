"""Legacy archive converter: ARC files, version 1 and 2, to WARC files, and readers and writers of both.

An ARC file begins with a version block (`filedesc://`), whose second line names the version and whose third the fields
of the header lines that follow: five in version 1 (URL, IP address, date, type, length), ten in version 2 (result
code, checksum, location, offset and file name too). A record is its header line and as many bytes as it declares.
Each becomes a WARC/1.1 record: id (a name-based UUID of the archive and the record's place in it), date (14 digits to ISO
8601), type, payload digest (base32 SHA-1 of the payload, the HTTP body where there is one) and length are made from
it. Records of equal payloads of at least `least_revisit` bytes become revisits of the one with the largest X-Page-Id
(of the first by archive and place, where there is none), which stays a response.

Files are gzip, a member a record, written to the shared folder under names of their own by each task attempt; a table
of the files that count is written by Spark, so a retried task leaves at most a file that nobody reads. Payloads aren't
shuffled: digests, sizes and keys are, and each ARC file is then read again beside its records' decisions.

Defined results: null html is empty, and its payload has 0 bytes; a header line that isn't valid, or a declared length
beyond the file's end, raises ValueError; an empty table gives archives without records and no rows. Null page ids are
written as `-` and read back as null; such records are neither responses for others nor revisits. Rows that repeat a
page id are records of their own; among equal payloads of one id the first by archive and place is the response.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_utf8, new_path, stage, text_slices

#: Bytes of records after which an archive is closed and another begun.
ARCHIVE = 32 << 20
SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
# The ARC header fields of each version.
ARC_FIELDS = {
    1: ("URL", "IP-address", "Archive-date", "Content-type", "Archive-length"),
    2: ("URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"),
}


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def member(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(place, content) of the gzip members of a file; it is fed by small parts, as what is left over is copied."""
    at = 0
    while at < len(raw):
        d, parts, pos = zlib.decompressobj(31), [], at
        while not d.eof:
            chunk = raw[pos : pos + 16384]
            if not chunk:
                raise ValueError(f"gzip member at {at} is cut short")
            parts.append(d.decompress(chunk))
            pos += len(chunk)
        yield at, b"".join(parts)
        at = pos - len(d.unused_data)


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    mime: str
    body: bytes
    place: int = 0
    fields: dict[str, str] = field(default_factory=dict)


def arc_header(version: int, name: str) -> bytes:
    """The version block, with its own declared length."""
    text = f"{version} 0 veldrin\n{' '.join(ARC_FIELDS[version])}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 19960101000000 text/plain"
    head += f" 200 - - 0 {name} {len(text)}" if version == 2 else f" {len(text)}"
    return head.encode() + b"\n" + text + b"\n"


def arc_record(r: ArcRecord, version: int, name: str, place: int) -> bytes:
    line = [r.url, r.ip, r.date, r.mime] + (["200", "-", "-", str(place), name] if version == 2 else []) + [str(len(r.body))]
    return " ".join(line).encode() + b"\n" + r.body + b"\n"


def _header_line(data: bytes, names: tuple[str, ...]) -> tuple[dict[str, str], int]:
    """The fields of a header line, and where the content begins. URLs may hold spaces: fields are told from the right."""
    end = data.find(b"\n")
    parts = data[: end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r").rsplit(" ", len(names) - 1)
    if end < 0 or len(parts) != len(names) or not parts[-1].isdigit():
        raise ValueError(f"not an ARC header line of {len(names)} fields: {data[:80]!r}")
    return dict(zip(names, parts, strict=True)), end + 1


def read_arc(raw: bytes) -> Iterator[ArcRecord]:
    """The records of an ARC file, gzip by member or plain, after its version block."""
    packed = raw[:2] == b"\x1f\x8b"
    names = None
    for place, data in members(raw) if packed else [(0, raw)]:
        at = 0
        while at < len(data):
            if data[at : at + 1] in b"\r\n":
                at += 1
                continue
            rest = data[at:] if at else data
            if names is None:
                first = rest[: rest.find(b"\n")].split(b" ")
                start = len(rest.split(b"\n", 1)[0]) + 1
                version = int(rest[start : start + 1])
                if not first[0].startswith(b"filedesc://") or version not in ARC_FIELDS or not first[-1].strip().isdigit():
                    raise ValueError(f"not an ARC version block: {rest[:80]!r}")
                names = ARC_FIELDS[version]
                at += start + int(first[-1])
                continue
            fields, start = _header_line(rest, names)
            size = int(fields["Archive-length"])
            if start + size > len(rest):
                raise ValueError(f"a record of {size} bytes goes beyond the file's end")
            yield ArcRecord(fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], rest[start : start + size], place if packed else at, fields)
            at += start + size


def http_parts(body: bytes) -> tuple[bytes, dict[str, str], bytes]:
    """Head (with the blank line), header fields and payload of an HTTP response; of anything else, all is payload."""
    if not body.startswith(b"HTTP/"):
        return b"", {}, body
    cut = body.find(b"\r\n\r\n")
    head = body if cut < 0 else body[: cut + 4]
    fields = {}
    for line in head.decode("latin-1").split("\r\n")[1:]:
        k, sep, v = line.partition(":")
        if sep:
            fields[k.strip().lower()] = v.strip()
    return head, fields, body[len(head) :]


def iso_date(date: str) -> str:
    """14 digits (or fewer) to ISO 8601, in UTC."""
    d = date[:14] + "00000101000000"[len(date[:14]) :] if date.isdigit() else "19700101000000"
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(archive: str, place: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{archive} {place}')}>"


def warc_record(kind: str, rid: str, date: str, body: bytes, mime: str, more: dict[str, str]) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", f"WARC-Date: {date}", f"Content-Type: {mime}"]
    lines += [f"{k}: {v}" for k, v in more.items()] + [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def read_warc(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, content block) of a WARC file's records."""
    for _, data in members(raw) if raw[:2] == b"\x1f\x8b" else [(0, raw)]:
        at = 0
        while at < len(data):
            end = data.find(b"\r\n\r\n", at)
            if end < 0 or not data.startswith(b"WARC/1.", at):
                raise ValueError(f"not a WARC record: {data[at : at + 40]!r}")
            fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in data[at:end].decode().split("\r\n")[1:])}
            start, size = end + 4, int(fields["content-length"])
            if data[start + size : start + size + 4] != b"\r\n\r\n":
                raise ValueError("a WARC record doesn't end where it says")
            yield fields, data[start : start + size]
            at = start + size + 4


def _open(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(uri)


def _write(uri: str, data: bytes) -> None:
    fs, at = _open(uri)
    with fs.open_output_stream(at, compression=None) as out:
        out.write(data)


def _read(uri: str) -> bytes:
    fs, at = _open(uri)
    with fs.open_input_stream(at, compression=None) as f:
        return f.read()


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder for archives, made by way of Spark's file system."""
    path = new_path(spark, name)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file:///") else path


def write_arcs(pages: DataFrame, id_col: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(archive): the ARC files that hold the pages, as HTTP responses, in version 1 and version 2 by turns."""
    folder = _folder(pages.sparkSession, "arc")
    rows = pages.select(F.col(id_col).cast("string").alias("key"), F.coalesce(F.col(url), F.lit("urn:none")).alias("url"), as_utf8(html).alias("html"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, version, done = io.BytesIO(), "", 2, []

        def close() -> str:
            _write(f"{folder}/{name}", out.getvalue())
            return name

        plain = 0
        for batch, texts in text_slices(batches, 2):
            for key, link, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                if not name or plain > ARCHIVE:
                    if name:
                        done.append(close())
                    name, version, plain, out = f"{uuid.uuid4().hex}.arc.gz", 3 - version, 0, io.BytesIO()
                    out.write(member(arc_header(version, name)))
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\nX-Page-Id: {'-' if key is None else key}\r\n\r\n".encode()
                record = arc_record(ArcRecord("".join(link.split()) or "urn:none", "0.0.0.0", "20240101000000", "text/html", head + body), version, name, out.tell())
                out.write(member(record))
                plain += len(record)
        if name:
            done.append(close())
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in done], pa.string())], names=["archive"])

    return stage(rows.mapInArrow(write, "archive string"), "arcs")


SCAN = "archive string, place long, key string, digest string, bytes long"


def scan_arcs(arcs: DataFrame) -> DataFrame:
    """A light row for each record of the archives: where it is, its key and its payload's digest and size."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                found = []
                for r in read_arc(_read(archive)):
                    _, fields, payload = http_parts(r.body)
                    found.append((archive, r.place, fields.get("x-page-id", f"{archive} {r.place:020d}"), sha1_32(payload), len(payload)))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["archive", "place", "key", "digest", "bytes"])

    return arcs.mapInArrow(scan, SCAN)


def decide(records: DataFrame, least_revisit: int = 0) -> DataFrame:
    """records with `to_archive` and `to_place` of the response that a revisit refers to (null for responses)."""
    number = F.expr("try_cast(key as long)")
    able = (F.col("bytes") >= least_revisit) & (F.col("key") != "-")
    best = F.min(F.struct(number.isNull().alias("x"), (-number.cast("decimal(20,0)")).alias("v"), "archive", "place")).alias("_first")
    first = records.where(able).groupBy(F.col("digest").alias("_d"), F.col("bytes").alias("_b")).agg(best)
    both = records.join(first, (F.col("digest") == F.col("_d")) & (F.col("bytes") == F.col("_b")) & able, "left")
    other = (F.col("_first.archive") != F.col("archive")) | (F.col("_first.place") != F.col("place"))
    return both.select("archive", "place", "digest", "bytes", F.when(other, F.col("_first.archive")).alias("to_archive"), F.when(other, F.col("_first.place")).alias("to_place"))


def convert(arcs: DataFrame, least_revisit: int = 0) -> DataFrame:
    """(archive): the WARC files made of the ARC files, one of each."""
    folder = _folder(arcs.sparkSession, "warc")
    plan = decide(stage(scan_arcs(arcs), "arc-records"), least_revisit)

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        archive = pdf["archive"].iloc[0]
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        why = {p: (d, a, q) for p, d, a, q in zip(pdf["place"], pdf["digest"], pdf["to_archive"], pdf["to_place"], strict=True)}
        out = io.BytesIO()
        info = f"software: veldrin\r\nformat: WARC File Format 1.1\r\nconverted-from: {archive.rsplit('/', 1)[-1]}\r\n".encode()
        out.write(member(warc_record("warcinfo", record_id(archive, -1), "2024-01-01T00:00:00Z", info, "application/warc-fields", {"WARC-Filename": name.rsplit("/", 1)[-1]})))
        for r in read_arc(_read(archive)):
            digest, to, place = why[r.place]
            head, _, payload = http_parts(r.body)
            more = {"WARC-Target-URI": r.url, "WARC-IP-Address": r.ip, "WARC-Payload-Digest": f"sha1:{digest}"}
            mime = "application/http; msgtype=response" if head else r.mime
            kind, block = ("response" if head else "resource"), r.body
            if isinstance(to, str):
                kind, block = "revisit", head
                more |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(to, int(place)), "WARC-Truncated": "length"}
            more["WARC-Block-Digest"] = f"sha1:{sha1_32(block)}"
            out.write(member(warc_record(kind, record_id(archive, r.place), iso_date(r.date), block, mime, more)))
        _write(name, out.getvalue())
        return pd.DataFrame({"archive": [name]})

    return stage(plan.groupBy("archive").applyInPandas(write, "archive string"), "warcs")


def scan_warcs(warcs: DataFrame) -> DataFrame:
    """(record_id, record_type, key, payload_digest, payload_bytes, refers_to_id) of the archives' records. A response's
    digest and size are those of its content; its digest must be the one its header names."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0).to_pylist():
                found = []
                for fields, block in read_warc(_read(archive)):
                    if fields["warc-type"] == "warcinfo":
                        continue
                    _, http, payload = http_parts(block)
                    said, revisit = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"] == "revisit"
                    if not revisit and said != sha1_32(payload):
                        raise ValueError(f"payload of {fields['warc-record-id']} doesn't match its digest")
                    found.append((fields["warc-record-id"], "revisit" if revisit else "response", http.get("x-page-id"), said, None if revisit else len(payload), fields.get("warc-refers-to")))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["record_id", "record_type", "key", "payload_digest", "payload_bytes", "refers_to_id"])

    return warcs.mapInArrow(scan, "record_id string, record_type string, key string, payload_digest string, payload_bytes long, refers_to_id string")


def resolved(records: DataFrame) -> DataFrame:
    """The records of scan_warcs, revisits with the size and the key of the response that they refer to."""
    records = stage(records, "warc-records")
    answer = records.where("record_type = 'response'").select(F.col("record_id").alias("_id"), F.col("key").alias("refers_to"), F.col("payload_bytes").alias("_n"))
    both = records.join(answer, F.col("refers_to_id") == F.col("_id"), "left")
    return both.select("record_id", "record_type", "key", "payload_digest", F.coalesce("payload_bytes", "_n").alias("payload_bytes"), "refers_to")
