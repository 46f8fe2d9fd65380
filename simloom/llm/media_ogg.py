"""Media columns in Ogg containers.

Writing lays packets out in pages of lacing segments with page checksums.
Reading verifies each page's checksum, demultiplexes the logical streams by
serial number, reassembles packets from lacing values (also across pages) and
derives timestamps from granule positions.

A text is stored as two logical streams: an index stream whose only packet
names the sample rate, frame size and unpadded length, and a sample stream of
unsigned 8-bit samples, one packet a frame of 576 samples.  The granule
position of a sample page is the number of samples completed by its end.

Defined cases: a null text is an empty one; an empty text gives one frame of
padding; the whole text is stored whatever its length; repeated rows give
repeated results; an empty table gives an empty result; other columns of the
input are ignored, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.llm.shared import slices

FRAME = 576
RATE = 8000
INDEX_SERIAL, SAMPLE_SERIAL = 1, 2
CONTINUED, FIRST, LAST = 1, 2, 4
_HEAD, _INDEX = "<4sBBqIIIB", "<8sIIQ"
_MARK = b"pcm-u8\x00\x01"
_FLIP = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, most significant bit first, start 0.

    zlib has the bit-mirrored register, so bytes and result are mirrored.
    """
    raw = zlib.crc32(page.translate(_FLIP), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{raw:032b}"[::-1], 2)


@dataclass
class Page:
    serial: int
    sequence: int
    flags: int
    granule: int
    lacing: bytes
    body: bytes


@dataclass
class Packet:
    data: bytes
    #: Samples completed by the end of this packet; -1 if the stream doesn't say.
    granule: int = -1


@dataclass
class Stream:
    serial: int
    packets: list[Packet] = field(default_factory=list)
    #: Packets lost to damaged or missing pages.
    lost: int = 0
    pages: int = 0
    ended: bool = False


def _page(serial: int, sequence: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    blank = struct.pack(_HEAD, b"OggS", 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing + body
    return blank[:22] + struct.pack("<I", page_checksum(blank)) + blank[26:]


def write_stream(serial: int, packets: Iterable[Packet], own_first: bool = False) -> list[tuple[int, bytes]]:
    """Pages of one logical stream, each with its granule position.

    A page holds up to 255 lacing segments; a packet that doesn't fit goes on
    in the next page.  With ``own_first`` the first packet gets a page alone.
    """
    pages: list[tuple[int, int, bytes, bytes]] = []
    lacing, body, granule, flags = bytearray(), bytearray(), -1, 0

    def flush(goes_on: bool) -> None:
        nonlocal granule, flags
        pages.append((flags, granule, bytes(lacing), bytes(body)))
        lacing.clear()
        body.clear()
        granule, flags = -1, CONTINUED if goes_on else 0

    for k, packet in enumerate(packets):
        left, data = [255] * (len(packet.data) // 255) + [len(packet.data) % 255], packet.data
        at = 0
        while left:
            if len(lacing) == 255:
                flush(at > 0)
            room = left[: 255 - len(lacing)]
            size = sum(room)
            lacing += bytes(room)
            body += data[at : at + size]
            at += size
            left = left[len(room) :]
        granule = packet.granule
        if own_first and k == 0:
            flush(False)
    if lacing or not pages:
        flush(False)
    out = []
    for k, (f, g, segments, content) in enumerate(pages):
        f |= FIRST if k == 0 else 0
        f |= LAST if k == len(pages) - 1 else 0
        out.append((g, _page(serial, k, f, g, segments, content)))
    return out


def multiplex(streams: list[list[tuple[int, bytes]]]) -> bytes:
    """All first pages, then the rest in order of granule position."""
    rest = [(g, k, i, page) for k, s in enumerate(streams) for i, (g, page) in enumerate(s[1:])]
    for k, s in enumerate(streams):  # a page without a position keeps its place in its stream
        last = -1
        for j, (g, kk, i, page) in enumerate(rest):
            if kk == k:
                last = max(last, g)
                rest[j] = (last, kk, i, page)
    rest.sort(key=lambda x: x[:3])
    return b"".join([s[0][1] for s in streams] + [x[3] for x in rest])


def read_pages(data: bytes) -> Iterator[Page | None]:
    """Pages whose checksum holds; None for each damaged stretch."""
    at = 0
    while at < len(data):
        start = data.find(b"OggS", at)
        if start != at:
            yield None
        if start < 0:
            return
        page = None
        if start + 27 <= len(data):
            _, version, flags, granule, serial, sequence, crc, n = struct.unpack_from(_HEAD, data, start)
            lacing = data[start + 27 : start + 27 + n]
            end = start + 27 + n + sum(lacing)
            if version == 0 and len(lacing) == n and end <= len(data):
                blank = data[start : start + 22] + b"\0\0\0\0" + data[start + 26 : end]
                if page_checksum(blank) == crc:
                    page = Page(serial, sequence, flags, granule, lacing, data[start + 27 + n : end])
        yield page
        at = end if page else start + 4


def demultiplex(data: bytes, samples_of=len) -> dict[int, Stream]:
    """Logical streams by serial number, their packets whole and timed.

    ``samples_of`` gives a packet's length in granule units; the position of a
    page belongs to the last packet that ends in it, and those before it are
    counted back from there.
    """
    streams: dict[int, Stream] = {}
    partial: dict[int, bytearray | None] = {}
    expected: dict[int, int] = {}
    for page in read_pages(data):
        if page is None:
            continue
        stream = streams.setdefault(page.serial, Stream(page.serial))
        gap = expected.get(page.serial, page.sequence) != page.sequence
        expected[page.serial] = page.sequence + 1
        stream.pages += 1
        held = partial.pop(page.serial, None)
        if held is not None and (gap or not page.flags & CONTINUED):
            stream.lost += 1
            held = None
        elif gap:  # whole pages are missing, at least a packet each
            stream.lost += 1
        skip = bool(page.flags & CONTINUED) and held is None
        stream.lost += skip
        at, done = 0, []
        current = held if held is not None else bytearray()
        for size in page.lacing:
            current += page.body[at : at + size]
            at += size
            if size < 255:
                if not skip:
                    done.append(Packet(bytes(current)))
                skip, current = False, bytearray()
        if page.lacing and page.lacing[-1] == 255 and not skip:
            partial[page.serial] = current
        if page.granule >= 0:
            position = page.granule
            for packet in reversed(done):
                packet.granule = position
                position -= samples_of(packet.data)
        stream.packets += done
        stream.ended |= bool(page.flags & LAST)
    for serial in partial:
        streams[serial].lost += 1
    return streams


def pad(raw: bytes, frame: int = FRAME) -> bytes:
    """Append bytes 255 up to a positive multiple of ``frame``."""
    return raw + b"\xff" * (max(frame, -(-len(raw) // frame) * frame) - len(raw))


def store(raw: bytes, frame: int = FRAME, rate: int = RATE) -> bytes:
    """The text's bytes, padded, as an Ogg file."""
    payload = pad(raw, frame)
    frames = [Packet(payload[i : i + frame], i + frame) for i in range(0, len(payload), frame)]
    index = [Packet(struct.pack(_INDEX, _MARK, rate, frame, len(raw)), 0)]
    head = [Packet(_MARK + struct.pack("<II", rate, frame), 0)]
    return multiplex([write_stream(INDEX_SERIAL, index), write_stream(SAMPLE_SERIAL, head + frames, own_first=True)])


@dataclass
class Media:
    payload: bytes
    n_bytes: int
    rate: int
    frame: int
    #: Start of each frame in seconds.
    starts: list[float]
    pages: int
    packets: int
    lost: int


def load(media: bytes) -> Media:
    """Read an Ogg file made by ``store``; ValueError if it isn't whole."""
    streams = demultiplex(media)
    if INDEX_SERIAL not in streams or SAMPLE_SERIAL not in streams:
        raise ValueError("a logical stream is missing")
    index, samples = streams[INDEX_SERIAL], streams[SAMPLE_SERIAL]
    if not index.packets or not index.packets[0].data.startswith(_MARK):
        raise ValueError("the index packet is missing")
    _, rate, frame, n_bytes = struct.unpack(_INDEX, index.packets[0].data)
    frames = sorted(samples.packets[1:], key=lambda p: p.granule)
    payload = b"".join(p.data for p in frames)
    whole = samples.ended and not samples.lost and frames and frames[-1].granule == len(payload)
    if not whole:
        raise ValueError("sample pages are damaged or missing")
    return Media(payload, n_bytes, rate, frame, [(p.granule - len(p.data)) / rate for p in frames], index.pages + samples.pages, len(index.packets) + len(samples.packets), index.lost + samples.lost)


def features(media: Media) -> str:
    """Duration, level, power and sign changes of the samples read back."""
    x = np.frombuffer(media.payload, np.uint8).astype(np.int64)
    n = len(x)
    total, squares = int(x.sum()), int((x * x).sum())
    above = x >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    loudest = int(x.reshape(-1, media.frame).sum(axis=1).argmax())
    return f"streams=2;pages={media.pages};packets={media.packets};seconds={n / media.rate:.6f};mean={total / n:.6f};power={squares / n:.6f};crossings={crossings};loudest_at={media.starts[loudest]:.6f}"


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def stored_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the Ogg file of each row's text, column ``media``."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            media = [store((t or "").encode()) for t in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(media, pa.binary())], names=[key, "media"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, media binary")


def media_digest(df: DataFrame) -> DataFrame:
    """Store each text, read the stored bytes back and describe both."""

    def describe(doc_id, text) -> tuple:
        raw = (text or "").encode()
        media = store(raw)
        back = load(media)
        return (doc_id, back.n_bytes, len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(back))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [c.split()[0] for c in DIGEST.split(", ")]
        for b in slices(batches):
            rows = [describe(i, t) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)
