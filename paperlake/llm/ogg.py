"""Media columns: texts or bytes held in Ogg containers, and what the containers hold.

A container has two logical streams, multiplexed page by page: one with 8-bit samples in packets
of 576, whose granule position is the number of samples up to the end of a page, and one whose
last packet holds the number of bytes before padding. The reader trusts nothing that it can check:
it verifies every page's checksum, sorts pages by serial number, checks their sequence, joins
packets over pages from the lacing values and takes times from granule positions.

Nulls and empty texts are stored as one packet of padding. A container that fails a check gives
a row whose ``error`` says what failed, and nulls.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["OggError", "demux", "encode_ogg", "encode_payload", "ogg_crc", "op10_media", "probe_ogg"]

PACKET, PAD, RATE = 576, b"\xff", 48_000
CONTINUED, FIRST, LAST = 1, 2, 4
_HEADER = struct.Struct("<4sBBqIIIB")
_SAMPLES, _NOTES = b"8bitpcm\x00", b"length\x00\x00"
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_LACED = 255 // (PACKET // 255 + 1)  # packets of samples that fit the 255 lacing values of a page


class OggError(ValueError):
    """A container breaks the format."""


def ogg_crc(page: bytes) -> int:
    """Ogg's checksum: the polynomial 0x04C11DB7, most significant bit first, no inversion.

    zlib has the same polynomial with bits mirrored, so bytes are mirrored before and the sum after.
    """
    crc = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRROR), "big")


def _page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    tail = bytes((len(lacing),)) + lacing + body
    head = _HEADER.pack(b"OggS", 0, kind, granule, serial, number, 0, len(lacing))[:-1]
    crc = ogg_crc(head + tail)
    return head[:22] + struct.pack("<I", crc) + tail


def encode_payload(raw: bytes) -> bytes:
    """One container for one value."""
    size = max(1, -(-len(raw) // PACKET)) * PACKET
    payload = raw + PAD * (size - len(raw))
    samples = zlib.crc32(raw)
    notes = samples ^ 0x80000000
    start = _SAMPLES + struct.pack("<II", RATE, PACKET)
    out = [_page(FIRST, 0, samples, 0, bytes((len(start),)), start), _page(FIRST, 0, notes, 0, bytes((len(_NOTES),)), _NOTES)]
    lacing = b"\xff" * (PACKET // 255) + bytes((PACKET % 255,))
    step = _LACED * PACKET
    for number, at in enumerate(range(0, size, step), 1):
        body = payload[at : at + step]
        out.append(_page(LAST if at + step >= size else 0, at + len(body), samples, number, lacing * (len(body) // PACKET), body))
    out.append(_page(LAST, size, notes, 1, b"\x08", struct.pack("<Q", len(raw))))
    return b"".join(out)


@dataclass
class Stream:
    """Packets of one logical stream, and (granule position, packets ended so far) of each page that ends one."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    marks: list[tuple[int, int]] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    _open: list[bytes] = field(default_factory=list)


def demux(data: bytes) -> list[Stream]:
    """Logical streams in order of their first page."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if at + 27 > len(data):
            raise OggError("a page is cut off")
        magic, version, kind, granule, serial, number, crc, segments = _HEADER.unpack_from(data, at)
        if magic != b"OggS" or version:
            raise OggError("no page where one must start")
        body = at + 27 + segments
        lacing = data[at + 27 : body]
        end = body + sum(lacing)
        if len(lacing) < segments or end > len(data):
            raise OggError("a page is cut off")
        page = data[at:end]
        if ogg_crc(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise OggError("a page's checksum is wrong")
        if kind & FIRST:
            if serial in streams:
                raise OggError("a stream begins twice")
            streams[serial] = Stream(serial)
        s = streams.get(serial)
        if s is None or s.ended or number != s.pages:
            raise OggError("a page is out of sequence")
        if bool(kind & CONTINUED) != bool(s._open):
            raise OggError("a packet isn't continued")
        s.pages += 1
        before, begun = len(s.packets), body
        ends = np.frombuffer(lacing, dtype=np.uint8)
        for stop in (body + np.cumsum(ends, dtype=np.int64)[ends < 255]).tolist():
            piece = data[begun:stop]
            s.packets.append(b"".join([*s._open, piece]) if s._open else piece)
            s._open.clear()
            begun = stop
        if segments and lacing[-1] == 255:
            s._open.append(data[begun:end])
        if len(s.packets) > before:
            s.marks.append((granule, len(s.packets)))
        s.ended = bool(kind & LAST)
        at = end
    if any(not s.ended or s._open for s in streams.values()):
        raise OggError("a stream doesn't end")
    return list(streams.values())


_PROBE = pa.struct(
    [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_streams", pa.int32()), ("n_pages", pa.int32()), ("n_packets", pa.int64()), ("seconds", pa.float64()), ("error", pa.string())]
)
_PROBE_DDL = "struct<n_bytes:bigint,payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string,feature:string,n_streams:int,n_pages:int,n_packets:bigint,seconds:double,error:string>"


def probe_payload(data: bytes) -> dict:
    """What a container made here holds, as a row."""
    try:
        streams = demux(data)
        kinds = {s.packets[0][:8]: s for s in streams if s.packets}
        sound, notes = kinds.get(_SAMPLES), kinds.get(_NOTES)
        if sound is None or notes is None:
            raise OggError("a stream is missing")
        rate, _ = struct.unpack_from("<II", sound.packets[0], 8)
        (n_bytes,) = struct.unpack("<Q", notes.packets[-1])
        payload = b"".join(sound.packets[1:])
        if sound.marks[-1][0] != len(payload) or not 0 <= n_bytes <= len(payload):
            raise OggError("the granule position isn't the number of samples")
    except (OggError, struct.error, IndexError, ZeroDivisionError) as e:
        return {"error": str(e), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest()}
    x = np.frombuffer(payload, dtype=np.uint8)
    level = np.bincount(x, minlength=256)
    centred = np.arange(256, dtype=np.int64) - 128
    energy, total = int((level * centred**2).sum()), int((level * centred).sum())
    crossings = int(np.count_nonzero(np.diff(x >= 128)))
    times = ",".join(f"{g / rate:.6f}" for g, _ in sound.marks[1:][:: max(1, len(sound.marks[1:]) // 4)])
    feature = f"seconds={len(payload) / rate:.6f};mean={total / len(x):.4f};rms={(energy / len(x)) ** 0.5:.4f};peak={int(np.abs(centred[level > 0]).max())};crossings={crossings};times={times}"
    return {
        "n_bytes": n_bytes, "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]),
        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(), "feature": feature, "n_streams": len(streams), "n_pages": sum(s.pages for s in streams),
        "n_packets": sum(len(s.packets) for s in streams), "seconds": len(payload) / rate, "error": None,
    }


def _encode(values: pa.Array) -> pa.Array:
    raw = values.cast(pa.large_binary())
    return pa.array([encode_payload(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in raw], pa.binary())


def _probe(media: pa.Array) -> pa.Array:
    return pa.array([probe_payload(x.as_buffer().to_pybytes()) if x.is_valid else {"error": "null"} for x in media], _PROBE)


def encode_ogg(value: Column) -> Column:
    """The Ogg container of a string or binary column, as binary."""
    return F.arrow_udf(_encode, "binary")(value)


def probe_ogg(media: Column) -> Column:
    """Struct of what a container holds; see ``probe_payload``."""
    return F.arrow_udf(_probe, _PROBE_DDL)(media)


def op10_media(documents: DataFrame) -> DataFrame:
    """Each document's text as an Ogg container, read back: sizes, digests and features.

    Rows are independent: one scan without a shuffle. A batch holds one slice of texts and its containers.
    """
    stored = documents.select("doc_id", encode_ogg(F.col("text")).alias("media"))
    return stored.select("doc_id", probe_ogg(F.col("media")).alias("p")).select("doc_id", "p.*")
