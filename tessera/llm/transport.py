"""Operator 7: media columns in MPEG transport streams.

``mux`` stores bytes as one private elementary stream: program tables (PAT, PMT)
with their CRCs, then elementary packets of at most UNIT bytes with a timestamp
each; every KEY-th is a random-access point and carries the clock.  ``demux`` finds
the stream through the tables, checks continuity counters, reassembles the packets
and lists timestamps and random-access points.

Null text counts as empty and gives a payload of 192 spaces.  Equal texts give
equal bytes.  Texts of any length are stored whole, one stream a document.  Repeated
rows are kept; other columns are ignored; an empty table gives an empty result.  Bytes
that aren't a whole stream raise ValueError in ``demux``; lost packets are counted, not
hidden.  Tables may span packets.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, text_slices

# Fixed values of ISO/IEC 13818-1.
PACKET, SYNC = 188, 0x47
PMT_PID, STREAM_PID, PRIVATE_PES, PRIVATE_STREAM = 0x1000, 0x0100, 0x06, 0xBD

#: Payload is padded to a multiple of FRAME; bytes of an elementary packet; units between random-access points; ticks of 90 kHz a unit.
FRAME, UNIT, KEY, TICKS = 192, 170 * 192, 8, 3600


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        r = byte << 24
        for _ in range(8):
            r = ((r << 1) ^ 0x04C11DB7 if r & 0x80000000 else r << 1) & 0xFFFFFFFF
        table.append(r)
    return table


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    """The tables' checksum: polynomial 04C11DB7, not reflected; 0 over a section with its own."""
    r = 0xFFFFFFFF
    for byte in data:
        r = ((r << 8) & 0xFFFFFFFF) ^ _CRC[(r >> 24) ^ byte]
    return r


def _section(table: int, extension: int, body: bytes) -> bytes:
    head = struct.pack(">BHHBBB", table, 0xB000 | (len(body) + 9), extension, 0xC1, 0, 0) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def _table_packet(pid: int, section: bytes) -> bytes:
    return (struct.pack(">BHBB", SYNC, 0x4000 | pid, 0x10, 0) + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, _section(0, 1, struct.pack(">HH", 1, 0xE000 | PMT_PID))) + _table_packet(PMT_PID, _section(2, 1, struct.pack(">HHBHH", 0xE000 | STREAM_PID, 0xF000, PRIVATE_PES, 0xE000 | STREAM_PID, 0xF000)))


def _stamp(pts: int) -> bytes:
    """A 33-bit timestamp in its five bytes with marker bits."""
    return struct.pack(">BHH", 0x21 | (pts >> 29) & 0x0E, (pts >> 14) & 0xFFFE | 1, (pts << 1) & 0xFFFE | 1)


def _clock(pts: int) -> bytes:
    """A program clock reference without extension: 33 bits, 6 reserved, 9 zero."""
    return struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    return indexed_mux(payload)[0]


def indexed_mux(payload: bytes) -> tuple[bytes, list[int], list[int], list[int]]:
    """The payload as a transport stream; its units' timestamps, its random-access units, and the bytes at which their packets begin."""
    out, counter, stamps, access, places, size = [_TABLES], 0, [], [], [], len(_TABLES)
    for k, at in enumerate(range(0, len(payload), UNIT)):
        data, pts = payload[at : at + UNIT], k * TICKS & (1 << 33) - 1
        stamps.append(pts)
        if k % KEY == 0:
            access.append(k)
            places.append(size)
        unit = struct.pack(">HBBHBBB", 0, 1, PRIVATE_STREAM, len(data) + 8, 0x84, 0x80, 5) + _stamp(pts) + data
        adapt = b"\x50" + _clock(pts) if k % KEY == 0 else b""
        first = min(len(unit), PACKET - 4 - (len(adapt) + 1 if adapt else 0))
        middle, last = divmod(len(unit) - first, PACKET - 4)
        n = 1 + middle + (last > 0)
        packets = np.empty((n, PACKET), np.uint8)
        packets[:, 0], packets[:, 1], packets[:, 2] = SYNC, STREAM_PID >> 8, STREAM_PID & 255
        packets[0, 1] |= 0x40
        packets[:, 3] = 0x10 | (counter + np.arange(n)) & 15
        counter = (counter + n) & 15
        body = np.frombuffer(unit, np.uint8)
        packets[1 : 1 + middle, 4:] = body[first : first + middle * (PACKET - 4)].reshape(middle, PACKET - 4)
        for row, piece, field in ((0, body[:first], adapt), *(((n - 1, body[len(unit) - last :], b""),) if last else ())):
            space = PACKET - 4 - len(piece)
            if space:  # an adaptation field fills what the piece leaves: length, flags, then stuffing
                fill = bytes([space - 1]) + (field or (b"\x00" if space > 1 else b""))
                packets[row, 3] |= 0x20
                packets[row, 4 : 4 + space] = np.frombuffer(fill.ljust(space, b"\xff"), np.uint8)
            packets[row, 4 + space :] = piece
        out.append(packets.tobytes())
        size += n * PACKET
    return b"".join(out), stamps, access, places


@dataclass
class Demuxed:
    """What a stream holds: its payload, timestamps, random-access units and lost-packet count."""

    payload: bytes
    pts: list[int]
    random_access: list[int]
    continuity_errors: int
    packets: int
    program: int
    pid: int
    stream_type: int
    units: list[bytes]


def _read_section(packets: np.ndarray, pids: np.ndarray, pid: int, table: int) -> bytes:
    """The first section that a PID starts, over as many packets as it takes."""
    own = packets[(pids == pid) & (packets[:, 3] & 0x10 != 0)]
    starts = np.flatnonzero(own[:, 1] & 0x40)
    if not len(starts):
        raise ValueError(f"no table in PID {pid}")
    section, need = b"", 3
    for k, row in enumerate(own[starts[0] :]):
        raw = row.tobytes()
        body = raw[4 + (1 + raw[4] if raw[3] & 0x20 else 0) :]
        if raw[1] & 0x40:  # a pointer tells where the next section begins; what stands before it ends this one
            body = body[1 + body[0] :] if k == 0 else body[1 : 1 + body[0]]
        section += body
        need = 3 + (struct.unpack_from(">H", section, 1)[0] & 0xFFF) if len(section) >= 3 else need
        if len(section) >= need or (k and raw[1] & 0x40):
            break
    section = section[:need]
    if len(section) < need or section[0] != table or crc32_mpeg(section):
        raise ValueError(f"a damaged table in PID {pid}")
    return section


def demux(stream: bytes) -> Demuxed:
    """Parse a single-program stream."""
    if not stream or len(stream) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != SYNC).any():
        raise ValueError("a packet without its sync byte")
    pids = (packets[:, 1] & 0x1F).astype(np.int32) << 8 | packets[:, 2]
    pat = _read_section(packets, pids, 0, 0)
    program, pmt_pid = struct.unpack_from(">HH", pat, 8)
    pmt = _read_section(packets, pids, pmt_pid & 0x1FFF, 2)
    info = 12 + (struct.unpack_from(">H", pmt, 10)[0] & 0xFFF)
    stream_type, pid = struct.unpack_from(">BH", pmt, info)
    own = packets[(pids == (pid & 0x1FFF)) & (packets[:, 3] & 0x10 != 0)]
    counters = own[:, 3] & 15
    lost = int((((counters[1:].astype(np.int16) - counters[:-1]) & 15) != 1).sum())
    adapted = own[:, 3] & 0x20 != 0
    begins = np.where(adapted, 5 + own[:, 4].astype(np.int32), 4)
    key = adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 != 0)
    body = own[np.arange(PACKET)[None, :] >= begins[:, None]].tobytes()
    ends = np.cumsum(PACKET - begins)
    firsts = np.flatnonzero(own[:, 1] & 0x40)
    parts, pts = [], []
    for a in (ends[firsts] - (PACKET - begins[firsts])).tolist():
        if body[a : a + 3] != b"\x00\x00\x01":
            raise ValueError("an elementary packet without its start code")
        length, flags, head = struct.unpack_from(">HxBB", body, a + 4)
        if flags & 0x80:
            x, y, z = struct.unpack_from(">BHH", body, a + 9)
            pts.append((x >> 1 & 7) << 30 | y >> 1 << 15 | z >> 1)
        parts.append(body[a + 9 + head : a + 6 + length])
    return Demuxed(b"".join(parts), pts, np.flatnonzero(key[firsts]).tolist(), lost, len(packets), program, pid & 0x1FFF, stream_type, parts)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """UTF-8 bytes, and those filled with spaces to a positive multiple of FRAME."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b" ")


#: Columns that let a reader seek: timestamps of units, random-access units, and the bytes at which their packets begin.
INDEX = ["pts", "random_access", "access_bytes"]


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in text_slices(b, "text", 1 << 23)):
        made = [payload_of(t) for t in batch.column("text").to_pylist()]
        streams = [indexed_mux(p) for _, p in made]
        lists = (pa.array([s[i] for s in streams], pa.list_(pa.int64())) for i in (1, 2, 3))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), *lists, pa.array([s[0] for s in streams], pa.binary())], ["doc_id", "n_bytes", *INDEX, "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, the columns of INDEX and the media column."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_store, f"doc_id {kind}, n_bytes bigint, {', '.join(f'{c} array<bigint>' for c in INDEX)}, media binary")


def _features(media: bytes) -> tuple:
    d = demux(media)
    feature = f"mpegts program={d.program} pid={d.pid} type={d.stream_type} packets={d.packets} units={len(d.pts)} pts={d.pts[0]}-{d.pts[-1]} access={len(d.random_access)} lost={d.continuity_errors}"
    return len(d.payload), hashlib.sha256(d.payload).hexdigest(), zlib.crc32(d.payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature, d.pts, d.random_access


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pts", "random_access"]
    for batch in batches:
        rows = [_features(m.as_buffer().to_pybytes()) for m in batch.column("media")]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", *names])


def read_media(media: DataFrame) -> DataFrame:
    """Checksums, features, timestamps and random-access points of a media column."""
    kind = media.schema["doc_id"].dataType.simpleString()
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read_back, f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pts array<bigint>, random_access array<bigint>")


def read_range(media: DataFrame, begin: int, end: int) -> DataFrame:
    """Of each stream the units with begin <= timestamp < end: doc_id, the first one's timestamp, how many, and their bytes.

    The stored index tells which bytes those are: from the last random-access point that
    isn't behind the first unit to the first one behind the last.  Only they and the tables
    are cut out, in the JVM, and parsed.  A stream without such units gives no row.
    """
    kind = media.schema["doc_id"].dataType.simpleString()
    wanted = F.filter("pts", lambda p: (p >= begin) & (p < end))
    first, last = F.array_min(wanted), F.array_max(wanted)
    # Timestamps ascend (33 bits last 26 hours); a random-access point's is that of its unit.
    points = F.transform(F.arrays_zip("random_access", "access_bytes"), lambda a: F.struct(F.get("pts", a["random_access"].cast("int")).alias("pts"), a["access_bytes"].alias("at")))
    low = F.array_max(F.transform(F.filter(points, lambda a: a["pts"] <= first), lambda a: a["at"]))
    high = F.coalesce(F.array_min(F.transform(F.filter(points, lambda a: a["pts"] > last), lambda a: a["at"])), F.octet_length("media"))
    tables = F.get("access_bytes", F.lit(0))
    found = media.where(F.size(wanted) > 0)
    piece = lambda at, n: F.substring("media", (at + 1).cast("int"), n.cast("int"))
    cut = found.select("doc_id", F.concat(piece(F.lit(0), tables), piece(low, high - low)).alias("media"))

    def units(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for cell in batch.column("media"):
                d = demux(cell.as_buffer().to_pybytes())
                inside = [k for k, p in enumerate(d.pts) if begin <= p < end]
                rows.append((d.pts[inside[0]], len(inside), b"".join(d.units[k] for k in inside)))
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "first_pts", "n_units", "data"])

    return cut.mapInArrow(units, f"doc_id {kind}, first_pts bigint, n_units bigint, data binary")


def media_digest(docs: DataFrame) -> DataFrame:
    """Store all texts as a media table in the shared folder and read it back."""
    return read_media(materialize(store_media(docs), "media", **{"parquet.block.size": str(32 << 20)}))
