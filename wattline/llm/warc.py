"""WARC archives as a Spark data source, and archives of pages in which equal payloads are revisits.

Records are written as gzip members of their own that carry their length (the "sl" extra field of the WARC annex), so a
reader can start anywhere in a file, inflate the head of a record alone, and step over the payloads it
does not want. Filters on the record type and on header columns are pushed down to that first look.
Other archives, plain ones (.warc) and gzip files without those lengths, are read too, each by one task from its
start on: payloads that are not wanted are stepped over in plain files, and inflated but not kept in the others.
"""

from __future__ import annotations

import base64
import hashlib
import io
import re
import struct
import sys
import uuid
import zlib

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    StringStartsWith,
    WriterCommitMessage,
)

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, payload_digest string, payload_length long, refers_to string, payload binary"
)
#: Column of each header field.
FIELDS = {
    "warc-record-id": "record_id",
    "warc-type": "record_type",
    "warc-target-uri": "target_uri",
    "warc-date": "date",
    "warc-payload-digest": "payload_digest",
    "x-payload-length": "payload_length",
    "warc-refers-to": "refers_to",
}
NAMES = [*FIELDS.values(), "payload"]
#: The first bytes of each gzip member: magic, extra field, no time, and an "sl" subfield of eight bytes.
MAGIC = b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff\x0c\x00sl\x08\x00"
SPLIT = 32 << 20
ROLL = 256 << 20


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9+.-]+:/", path) else (fs.LocalFileSystem(), path)


def member(block: bytes) -> bytes:
    """One record as a gzip member that holds its own length."""
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(block) + deflate.flush()
    size = len(MAGIC) + 8 + len(body) + 8
    return MAGIC + struct.pack("<II", size, len(block) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(block), len(block) & 0xFFFFFFFF)


def _clean(value) -> str:
    """A header value: control characters, which would end the line, are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", str(value))


def _plain(value: str) -> str:
    return re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), value)


def record(row: dict) -> bytes:
    """The bytes of a record; a response holds its payload behind an HTTP head, a revisit holds the head alone."""
    payload = row["payload"] or b""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    kept_payload = b"" if row["record_type"] == "revisit" else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", row["record_id"]), ("WARC-Target-URI", row["target_uri"]), ("WARC-Date", row["date"])]
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", len(payload)), ("WARC-Refers-To", row["refers_to"])]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(http) + len(kept_payload))]
    lines = "".join(f"{k}: {_clean(v)}\r\n" for k, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + http + kept_payload + b"\r\n\r\n"


def parse_head(block: bytes) -> dict:
    row = dict.fromkeys(NAMES)
    for line in re.split(rb"\r?\n\r?\n", block, maxsplit=1)[0].decode("utf-8", "replace").splitlines()[1:]:
        key, _, value = line.partition(":")
        if name := FIELDS.get(key.strip().lower()):
            row[name] = _plain(value.strip())
    row["payload_length"] = int(row["payload_length"]) if row["payload_length"] else None
    row["payload_digest"] = (row["payload_digest"] or "").removeprefix("sha1:") or None
    return row


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.split = int(options.get("splitbytes", SPLIT))
        self.tests = []

    def pushFilters(self, filters):
        """Takes the filters on header columns; Spark keeps the rest."""
        for f in filters:
            name = f.attribute[0] if len(f.attribute) == 1 else None
            if name in FIELDS.values() and isinstance(f, (EqualTo, In, StringStartsWith, IsNotNull, IsNull)):
                self.tests.append(f)
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for f in self.tests:
            have = row[f.attribute[0]]
            ok = (
                have is None if isinstance(f, IsNull)
                else have is not None and (
                    isinstance(f, IsNotNull)
                    or (isinstance(f, EqualTo) and have == f.value)
                    or (isinstance(f, In) and have in f.value)
                    or (isinstance(f, StringStartsWith) and have.startswith(f.value))
                )
            )
            if not ok:
                return False
        return True

    def partitions(self):
        from pyarrow import fs as pafs

        fs, path = _filesystem(self.path)
        found = []
        for info in fs.get_file_info(pafs.FileSelector(path, recursive=False)):
            if info.is_file and info.base_name.endswith(".warc") and not info.base_name.startswith(("_", ".")):
                found.append(Range(info.path, 0, info.size))
            elif info.is_file and info.base_name.endswith(".warc.gz") and not info.base_name.startswith(("_", ".")):
                found += [Range(info.path, at, min(at + self.split, info.size)) for at in range(0, info.size, self.split)]
        return found or [Range("", 0, 0)]

    def read(self, part: Range):
        if part.stop <= part.start:
            return
        fs, _ = _filesystem(self.path)
        rows, held = [], 0
        with fs.open_input_file(part.path) as raw:
            f = io.BufferedReader(raw, 1 << 20)  # reads ahead; steps inside what is read cost nothing
            own = f.read(len(MAGIC)) == MAGIC
            if not own and part.start:
                return  # the task of the file's start reads it all
            for row in self._members(f, part) if own else self._others(f, part.path):
                rows.append(row)
                held += len(row["payload"] or b"")
                if len(rows) >= 1000 or held > 8 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _members(self, f, part: Range):
        """The wanted records that start in the range, of a file whose members carry their lengths."""
        at = self._first(f, part)
        while at is not None and at < part.stop:
            f.seek(at)
            data = f.read(len(MAGIC) + 8)
            if not data:
                return
            if not data.startswith(MAGIC):
                raise ValueError(f"{part.path}: no record with its length at byte {at}")
            length, _ = struct.unpack("<II", data[len(MAGIC) :])
            left = length - len(data)
            inflate, block = zlib.decompressobj(-15), b""
            while b"\r\n\r\n" not in block and not inflate.eof:
                piece = inflate.unconsumed_tail or f.read(min(4096, left))
                left -= 0 if inflate.unconsumed_tail else len(piece)
                if not piece:
                    raise ValueError(f"{part.path}: the record at byte {at} ends in its head")
                block += inflate.decompress(piece, 1 << 14)
            row = parse_head(block)
            if self._wanted(row):
                if self.payload and row["record_type"] != "revisit":
                    f.seek(at + len(MAGIC) + 8)
                    whole = zlib.decompress(f.read(length - len(MAGIC) - 16), -15)
                    row["payload"] = whole.split(b"\r\n\r\n", 2)[2].removesuffix(b"\r\n\r\n")
                yield row
            at += length

    def _others(self, f, path: str):
        """The wanted records of a plain file, or of one of ordinary gzip members, one after the other."""
        f.seek(0)
        zipped = f.read(2) == b"\x1f\x8b"
        f.seek(0)
        source = _Inflated(f) if zipped else f
        while True:
            line = source.readline()
            while line in (b"\r\n", b"\n"):  # what ends the record before
                line = source.readline()
            if not line:
                return
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: no WARC record begins with {line[:40]!r}")
            head = [line]
            while line not in (b"\r\n", b"\n", b""):
                line = source.readline()
                head.append(line)
            row = parse_head(b"".join(head))
            size = re.search(rb"(?im)^content-length:\s*(\d+)", b"".join(head))
            if not size:
                raise ValueError(f"{path}: a record without Content-Length")
            size = int(size[1])
            http = row["record_type"] in ("response", "revisit") and re.search(rb"(?im)^content-type:\s*application/http", b"".join(head)) is not None
            if not self._wanted(row):
                source.seek(size, io.SEEK_CUR)
                continue
            front, line = 0, b"-" if http and size else b""
            while line not in (b"\r\n", b"\n", b"") and front < size:  # the HTTP head
                line = source.readline(size - front)
                front += len(line)
            if row["payload_length"] is None:
                row["payload_length"] = size - front
            if self.payload and row["record_type"] != "revisit":
                row["payload"] = source.read(size - front)
                if len(row["payload"]) < size - front:
                    raise ValueError(f"{path}: the last record ends early")
            else:
                source.seek(size - front, io.SEEK_CUR)
            yield row

    @staticmethod
    def _first(f, part: Range):
        """The first record that starts in the range."""
        at, tail = part.start, b""
        f.seek(at)
        while at < part.stop + len(MAGIC):
            data = f.read(1 << 20)
            if not data:
                return None
            i = (tail + data).find(MAGIC)
            if i >= 0:
                return at - len(tail) + i
            at += len(data)
            tail = data[-len(MAGIC) + 1 :]
        return None


class _Inflated:
    """The content of a file of gzip members one after the other, with the few ways of reading that are used here."""

    def __init__(self, f):
        self.f, self.inflate, self.buffer, self.at = f, zlib.decompressobj(31), b"", 0

    def _more(self) -> bool:
        if self.inflate.eof:
            rest = self.inflate.unused_data
            self.inflate = zlib.decompressobj(31)
        else:
            rest = self.inflate.unconsumed_tail
        data = rest or self.f.read(1 << 18)
        if not data:
            return False
        self.buffer, self.at = self.buffer[self.at :] + self.inflate.decompress(data, 1 << 20), 0
        return True

    def read(self, n: int) -> bytes:
        while len(self.buffer) - self.at < n and self._more():
            pass
        out = self.buffer[self.at : self.at + n]
        self.at += len(out)
        return out

    def readline(self, most: int = 1 << 20) -> bytes:
        while (end := self.buffer.find(b"\n", self.at) + 1) == 0 and len(self.buffer) - self.at < most and self._more():
            pass
        return self.read(min(most, end - self.at if end else most))

    def seek(self, n: int, whence: int) -> None:
        while n > 0 and (step := len(self.read(min(n, 1 << 20)))):
            n -= step


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = dict.fromkeys(NAMES, pa.string()) | {"payload_length": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[n]) for n in NAMES], NAMES)


class Written(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


class WarcWriter(DataSourceWriter):
    """Each task writes hidden files; the driver gives those of the tasks that count their names when the job ends."""

    def __init__(self, options):
        self.path = options["path"]

    def write(self, iterator):
        fs, path = _filesystem(self.path)
        fs.create_dir(path, recursive=True)
        files, out = [], None
        try:
            for row in iterator:
                if out is None:
                    files.append(f"{path}/_part-{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(files[-1], compression=None)
                out.write(member(record(row.asDict())))
                if out.tell() > ROLL:
                    out.close()
                    out = None
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages):
        fs, _ = _filesystem(self.path)
        for m in messages:
            for name in m.files if m else ():
                head, _, base = name.rpartition("/")
                fs.move(name, f"{head}/{base[1:]}")

    def abort(self, messages):
        fs, _ = _filesystem(self.path)
        for m in messages:
            for name in m.files if m else ():
                fs.delete_file(name)


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    """Makes format("warc") known, with filters pushed down (a setting of the session, which frames read when they run)."""
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def records(spark: SparkSession, pages: DataFrame, *, id_col="page_id", url_col="url", html_col="html", least: int = 0) -> DataFrame:
    """The records to write: of pages with equal payloads of ``least`` bytes or more the largest id is response, others revisit it.

    Null html is an empty payload; null urls have no header; rows without id, and rows that repeat the id of a
    response with its payload, are responses. Extra columns are ignored. Equal payloads meet by their digest
    alone; payloads are not shuffled unless very many rows are revisits.
    """
    from .text import hot_keys, kept, salted, sized, spread

    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"), F.sha1(payload).alias("sha"))
    ids = kept(spark, rows.where((F.length("payload") >= least) & F.col("id").isNotNull()).select("id", "sha"), "payload_ids")
    lead = ids.groupBy("sha").agg(F.max("id").alias("lead"), F.count("*").alias("n")).where("n > 1")
    lead = kept(spark, lead, "payload_leads")
    common = hot_keys(spark, lead, "sha")
    again = salted(ids, "sha", common, ["id"]).join(spread(lead.select("sha", "lead"), "sha", common), ["sha", "_salt"])
    again = kept(spark, again.where("id <> lead").select("id", "sha", "lead").distinct(), "revisits")
    full = rows.join(sized(again, 200_000), ["id", "sha"], "left")
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    return full.select(
        F.coalesce(name(F.col("id")), F.lit("<urn:page:>")).alias("record_id"),
        F.when(F.col("lead").isNull(), "response").otherwise("revisit").alias("record_type"),
        "target_uri",
        F.lit("2000-01-01T00:00:00Z").alias("date"),
        F.lit(None).cast("string").alias("payload_digest"),
        F.length("payload").cast("long").alias("payload_length"),
        name(F.col("lead")).alias("refers_to"),
        "payload",
    )


def write_archives(spark: SparkSession, rows: DataFrame, path: str) -> str:
    """Writes records as .warc.gz files under path, a folder that all executors reach."""
    register(spark)
    rows.write.format("warc").mode("append").save(path)
    return path


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
