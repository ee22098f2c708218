"""WARC archives as a Spark data source, ``format("warc")``.

Writing. Rows have ``record_type`` (response or revisit), ``record_id``, ``target_uri``, ``payload``,
``payload_bytes``, ``payload_digest`` and ``refers_to``. Each task writes gzip members, one per record, to files
of its own, which count only once the commit has listed them in ``_records.json``; so tasks that fail or run
twice leave no records behind. A revisit holds headers alone.

Reading. The driver lists files and sizes and plans partitions of about ``splitBytes``. A compressed file is cut
anywhere: a partition reads the records that begin in its range, and finds the first by looking for a
member that unpacks to a WARC version line. Plain files are one partition each. Filters on
``record_type``, ``record_id``, ``target_uri``, ``payload_digest`` and ``refers_to`` are pushed down: a record's headers
are parsed first, and its payload is only read out and decoded if the headers pass and the payload is
asked for (option ``payload``, ``true`` by default). Paths may be of any file system pyarrow knows.

A payload that is not there is null for a revisit and empty for an empty response. A record whose payload
doesn't match its digest, or that is cut off, fails the read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from .scratch import materialise, scratch_path

__all__ = ["Warc", "WarcError", "base32_sha1", "mark_revisits", "op3_warc", "read_warc", "records", "register_warc", "write_warc"]

SCHEMA = "record_type string, record_id bigint, target_uri string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary"
_ARROW = pa.schema([("record_type", pa.string()), ("record_id", pa.int64()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MEMBER = b"\x1f\x8b\x08"
_FILE_BYTES, _SPLIT_BYTES, _BATCH_BYTES, _CHUNK, _HEAD = 128 << 20, 32 << 20, 8 << 20, 1 << 20, 1 << 10
_INDEX = "_records.json"


class WarcError(ValueError):
    """An archive breaks the format."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(kind: str, key: int | None) -> str:
    return f"urn:x-{kind}:{'' if key is None else key}"


def _key(urn: str | None) -> int | None:
    tail = (urn or "").strip("<>").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def record_bytes(row: dict) -> bytes:
    """One record with its headers and block, not yet compressed."""
    revisit = row["record_type"] == "revisit"
    block = _HTTP if revisit else _HTTP + (row["payload"] or b"")
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{_urn('record', row['record_id'])}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (row["target_uri"] or "").replace("\r", "%0D").replace("\n", "%0A"), "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_urn('record', row['refers_to'])}>"]
    if row["target_uri"] is None:
        head.append("X-Target-URI: absent")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member_bytes(record: bytes) -> bytes:
    """A record as a gzip member whose extra field ``sl`` tells the lengths to skip, packed and unpacked."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(record) + packer.flush()
    size = 24 + len(body) + 8
    return struct.pack("<4sIBBH2sHII", b"\x1f\x8b\x08\x04", 0, 0, 255, 12, b"sl", 8, size, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        files, out, size = [], None, 0
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        try:
            for batch in batches:
                for part in batch.to_pylist() if batch.num_rows < 64 else (r for k in range(0, batch.num_rows, 64) for r in batch.slice(k, 64).to_pylist()):
                    if out is None or size >= _FILE_BYTES:
                        if out is not None:
                            out.close()
                        files.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, size = store.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                    data = member_bytes(record_bytes(part))
                    out.write(data)
                    size += len(data)
        finally:
            if out is not None:
                out.close()
        return _Written(files)

    def commit(self, messages: list[_Written | None]) -> None:
        store, base = _open(self.path)
        store.create_dir(base, recursive=True)
        names = sorted(f for m in messages if m is not None for f in m.files)
        if not self.overwrite and store.get_file_info(f"{base}/{_INDEX}").type == fs.FileType.File:
            with store.open_input_stream(f"{base}/{_INDEX}") as f:
                names = sorted({*names, *json.loads(f.read())})
        with store.open_output_stream(f"{base}/{_INDEX}") as f:
            f.write(json.dumps(names).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        store, base = _open(self.path)
        for m in messages:
            for name in m.files if m is not None else ():
                store.delete_file(f"{base}/{name}")


@dataclass
class _Range(InputPartition):
    path: str
    start: int
    end: int
    size: int


class _Input:
    """A file from an offset on, refilled as it is used up."""

    def __init__(self, file: pa.NativeFile, at: int) -> None:
        file.seek(at)
        self.file, self.at, self.held = file, at, b""

    def more(self) -> bool:
        data = self.file.read(_CHUNK)
        self.held += data
        return bool(data)

    def drop(self, n: int) -> None:
        self.held = self.held[n:]
        self.at += n

    def go(self, at: int) -> None:
        """Forward to an offset, without reading what lies between."""
        if at - self.at <= len(self.held):
            self.drop(at - self.at)
        else:
            self.__init__(self.file, at)

    def unpack(self, unpacker, limit: int = 0) -> bytes:
        """The next bytes of a member, ``limit`` at most."""
        if not self.held:
            self.more()
        used = self.held
        piece = unpacker.decompress(used, limit)
        self.held = unpacker.unused_data if unpacker.eof else unpacker.unconsumed_tail
        self.at += len(used) - len(self.held)
        if not used and not piece and not unpacker.eof:
            raise WarcError("a member is cut off")
        return piece


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError("no version line where a record must begin")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _find_member(src: _Input) -> bool:
    """Go to the next gzip member that holds a record; false at the end of the file."""
    while True:
        k = src.held.find(_MEMBER)
        if k < 0:
            src.drop(max(0, len(src.held) - 2))
            if not src.more():
                return False
            continue
        src.drop(k)
        if len(src.held) < 4096:
            src.more()
        try:
            if zlib.decompressobj(31).decompress(src.held[:4096], 5).startswith(b"WARC/"):
                return True
        except zlib.error:
            pass
        src.drop(1)


def _told_length(src: _Input) -> int:
    """Length of the member that begins here by its extra field, 0 if it has none."""
    while len(src.held) < 12 and src.more():
        pass
    if len(src.held) < 12 or not src.held[3] & 4:
        return 0
    size = 12 + int.from_bytes(src.held[10:12], "little")
    while len(src.held) < size and src.more():
        pass
    extra = src.held[12:size]
    while len(extra) >= 4:
        n = int.from_bytes(extra[2:4], "little")
        if extra[:2] == b"sl" and n >= 4:
            return int.from_bytes(extra[4:8], "little")
        extra = extra[4 + n :]
    return 0


def records(file: pa.NativeFile, start: int, end: int, packed: bool, wanted=lambda h: True, payload: bool = True) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the records that begin in a range and whose headers are wanted; no block where none is asked for.

    Headers are unpacked first; a member that isn't wanted is skipped by the length it tells, unread, or else unpacked to its end.
    """
    src = _Input(file, start)
    if packed and start and not _find_member(src):
        return
    while src.at < end:
        if not src.held and not src.more():
            return
        if packed:
            start, told = src.at, _told_length(src)
            unpacker, raw = zlib.decompressobj(31), b""
            while (k := raw.find(b"\r\n\r\n")) < 0:
                if unpacker.eof:
                    raise WarcError("a record has no end of headers")
                raw += src.unpack(unpacker, _HEAD)
            head, kept = _headers(raw[:k]), [raw[k + 4 :]]
            take = wanted(head) and payload
            if not take and told:
                src.go(start + told)
            else:
                while not unpacker.eof:
                    piece = src.unpack(unpacker)
                    if take:
                        kept.append(piece)
            block = b"".join(kept) if take else None
        else:
            while (k := src.held.find(b"\r\n\r\n")) < 0:
                if not src.more():
                    if src.held.strip():
                        raise WarcError("a record is cut off")
                    return
            head = _headers(src.held[:k].lstrip(b"\r\n"))
            src.drop(k + 4)
            size = int(head["content-length"])
            if wanted(head) and payload:
                while len(src.held) < size:
                    if not src.more():
                        raise WarcError("a record is cut off")
                block = src.held[:size]
                src.drop(min(size + 4, len(src.held)))
            else:
                block = None
                src.go(src.at + size + 4)
        if not wanted(head):
            continue
        if block is not None:
            size = int(head["content-length"])
            if len(block) < size:
                raise WarcError("a record is cut off")
            block = block[:size]
        yield head, block


def _row(head: dict[str, str], block: bytes | None) -> tuple:
    kind = head.get("warc-type")
    digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
    n = int(head["x-payload-length"]) if head.get("x-payload-length", "").isdigit() else None
    payload = None
    if block is not None and kind != "revisit":
        payload = block.partition(b"\r\n\r\n")[2] if head.get("content-type", "").startswith("application/http") else block
        if digest is not None and base32_sha1(payload) != digest:
            raise WarcError(f"the payload of {head.get('warc-record-id')} doesn't match its digest")
        n = len(payload)
    uri = None if head.get("x-target-uri") == "absent" else head.get("warc-target-uri")
    return kind, _key(head.get("warc-record-id")), uri, n, digest, _key(head.get("warc-refers-to")), payload


def _passes(filters: list[Filter], row: tuple) -> bool:
    at = {n: v for n, v in zip(_ARROW.names, row, strict=True)}
    for f in filters:
        v = at[f.attribute[0]]
        if isinstance(f, EqualTo) and v != f.value or isinstance(f, In) and v not in f.value or isinstance(f, StringStartsWith) and not (v or "").startswith(f.value):
            return False
    return True


class _Reader(DataSourceReader):
    def __init__(self, path: str, options: dict) -> None:
        self.path, self.filters = path, []
        self.split = int(options.get("splitBytes", _SPLIT_BYTES))
        self.payload = str(options.get("payload", "true")).lower() == "true"

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith) and len(f.attribute) == 1 and f.attribute[0] in ("record_type", "record_id", "target_uri", "payload_digest", "refers_to"):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[_Range]:
        store, base = _open(self.path)
        info = store.get_file_info(base)
        if info.type == fs.FileType.File:
            files = [info]
        else:
            files = [x for x in store.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]
            if store.get_file_info(f"{base}/{_INDEX}").type == fs.FileType.File:
                with store.open_input_stream(f"{base}/{_INDEX}") as f:
                    names = set(json.loads(f.read()))
                files = [x for x in files if x.base_name in names]
        out = []
        for x in sorted(files, key=lambda x: x.path):
            step = self.split if x.path.endswith(".gz") else max(1, x.size)
            out += [_Range(x.path, at, min(x.size, at + step), x.size) for at in range(0, x.size, step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.size:
            return
        store, _ = _open(self.path)
        rows, size = [], 0
        with store.open_input_file(part.path) as f:
            for head, block in records(f, part.start, part.end, part.path.endswith(".gz"), lambda h: _passes(self.filters, _row(h, None)), self.payload):
                rows.append(_row(head, block))
                size += len(rows[-1][-1] or b"") + 100
                if size >= _BATCH_BYTES:
                    yield self._batch(rows)
                    rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class Warc(DataSource):
    """``format("warc")``; see the module."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def register_warc(spark: SparkSession) -> None:
    """Make the format known to a session and let filters reach it."""
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_warc(rows: DataFrame, path: str, mode: str = "append") -> None:
    register_warc(rows.sparkSession)
    rows.select("record_type", "record_id", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload").write.format("warc").mode(mode).save(path)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    register_warc(spark)
    return spark.read.format("warc").options(**options).load(path)


def digest_column(payload: Column) -> Column:
    """Bare base32 SHA-1, eight groups of 20 bits at a time."""
    h = F.sha1(payload)
    group = lambda k: F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0")
    return F.translate(F.concat(*[group(k) for k in range(8)]), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(rows: DataFrame, least: int = 0) -> DataFrame:
    """``rows`` (record_id, target_uri, payload) with digest, size, type and refers_to.

    Of equal payloads of ``least`` bytes or more, the record with the smallest id is the response. Only ids
    and digests are grouped; a payload that a third of all rows share is one group of partial minima. The
    join that brings the smallest id back is a plain equi-join, which Spark splits where it is skewed.
    """
    known = rows.withColumns({"payload_digest": digest_column(F.col("payload")), "payload_bytes": F.octet_length("payload").cast("long")})
    first = known.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("record_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    first = materialise(first, "firsts")
    again = (F.col("_first") != F.col("record_id")) & (F.col("payload_bytes") >= least)
    return known.join(first, "payload_digest", "left").select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), "record_id", "target_uri", "payload_bytes", "payload_digest",
        F.when(again, F.col("_first")).alias("refers_to"), F.when(~F.coalesce(again, F.lit(False)), F.col("payload")).alias("payload"),
    )


def op3_warc(pages: DataFrame) -> DataFrame:
    """Each page as a WARC record, written to the shared folder and read back. Null html is an empty payload; a null or repeated id is a record like any."""
    rows = pages.select(F.col("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    path = scratch_path(pages.sparkSession, "warc")
    write_warc(mark_revisits(rows), path)
    back = read_warc(pages.sparkSession, path)
    return back.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.col("target_uri").alias("url"))


