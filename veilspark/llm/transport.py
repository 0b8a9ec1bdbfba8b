"""MPEG transport streams as a media column: a writer, a demultiplexer, and their table form.

``mux`` stores a payload losslessly as 8-bit samples: access units of ``UNIT`` bytes, each a PES
packet with a presentation timestamp, cut into 188-byte transport packets with continuity
counters; program tables and a random-access point with a clock reference come every ``GOP``
units.  ``demux`` takes any such stream: it parses PAT and PMT (checking their CRC), follows the
elementary stream they name, checks continuity counters, reassembles the PES packets and reports
timestamps and random-access points with their byte offsets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, map_batches

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID = 0, 0x100, 0x101
UNIT, GOP = 1536, 8
#: 90 kHz ticks of one unit: 1,536 samples at 48 kHz
TICKS = UNIT * 90_000 // 48_000
PRIVATE_STREAM = 0xBD
BLOCK = 192


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    whole = b"\x00" + head + crc32_mpeg(head).to_bytes(4, "big")
    return whole + b"\xff" * (PACKET - 4 - len(whole))


_PAT = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
_PMT = _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + b"\x06" + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def padded(data: bytes) -> bytes:
    """The bytes with blanks up to a positive multiple of 192."""
    return data + b" " * (max(-(-len(data) // BLOCK), 1) * BLOCK - len(data))


_HEAD = [[bytes([SYNC, DATA_PID >> 8 | start << 6, DATA_PID & 255, 0x10 | cc]) for cc in range(16)] for start in (0, 1)]
_HEAD_AF = [[bytes([SYNC, DATA_PID >> 8 | start << 6, DATA_PID & 255, 0x30 | cc]) for cc in range(16)] for start in (0, 1)]


def mux(payload: bytes) -> bytes:
    """A transport stream that carries the payload."""
    out, cc, tables = [], 0, 0
    for number, at in enumerate(range(0, len(payload), UNIT)):
        data, field_ = payload[at : at + UNIT], b""
        pts = number * TICKS & 0x1FFFFFFFF
        if number % GOP == 0:
            for pid, section in ((PAT_PID, _PAT), (PMT_PID, _PMT)):
                out += (bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10 | tables & 15]), section)
            tables += 1
            field_ = b"\x50" + (pts << 15 | 0x7E00).to_bytes(6, "big")
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(data) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts) + data
        done, start = 0, 1
        while done < len(pes):
            room = PACKET - 4 - (len(field_) + 1 if field_ else 0)
            left = len(pes) - done
            if left >= room:
                out += (_HEAD_AF[start][cc], bytes([len(field_)]), field_, pes[done : done + room]) if field_ else (_HEAD[start][cc], pes[done : done + room])
                done += room
            else:
                size = PACKET - 5 - left
                body = (field_ or (b"\x00" if size else b"")).ljust(size, b"\xff")
                out += (_HEAD_AF[start][cc], bytes([size]), body, pes[done:])
                done = len(pes)
            cc, start, field_ = cc + 1 & 15, 0, b""
    return b"".join(out)


@dataclass
class Stream:
    """What a demultiplexed stream holds."""

    payload: bytes = b""
    packets: int = 0
    programs: dict = field(default_factory=dict)
    stream_type: int = -1
    gaps: int = 0
    damaged: int = 0
    pts: list = field(default_factory=list)
    random_access: list = field(default_factory=list)


def _table(body: bytes) -> bytes | None:
    """The section at the start of a packet body if its CRC holds."""
    at = 1 + body[0]
    size = 3 + ((body[at + 1] & 0x0F) << 8 | body[at + 2]) if at + 3 <= len(body) else 0
    section = body[at : at + size]
    return section if 12 <= size == len(section) and crc32_mpeg(section) == 0 else None


def demux(media: bytes) -> Stream:
    """Parses a transport stream; damage is counted, never raised."""
    s, out = Stream(), []
    pmt_pids, data_pid = set(), None
    good: dict[tuple[int, bytes], bytes | None] = {}
    last: dict[int, int] = {}
    unit: list[bytes] = []

    def finish():
        pes = b"".join(unit)
        unit.clear()
        if not pes:
            return
        if pes[:3] != b"\x00\x00\x01" or len(pes) < 9 or len(pes) < 9 + pes[8]:
            s.damaged += 1
            return
        size = int.from_bytes(pes[4:6], "big")
        if size and len(pes) != size + 6:
            s.damaged += 1
        if pes[7] & 0x80 and pes[8] >= 5:
            p = pes[9:14]
            s.pts.append((p[0] & 0x0E) << 29 | p[1] << 22 | (p[2] & 0xFE) << 14 | p[3] << 7 | p[4] >> 1)
        out.append(pes[9 + pes[8] : size + 6 if size else None])

    for at in range(0, len(media) - PACKET + 1, PACKET):
        b0, b1, b2, b3 = media[at : at + 4]
        s.packets += 1
        if b0 != SYNC:
            s.damaged += 1
            continue
        pid, body = (b1 & 0x1F) << 8 | b2, at + 4
        access = False
        if b3 & 0x20:
            size = media[body]
            access = size > 0 and bool(media[body + 1] & 0x40)
            body += 1 + size
        if not b3 & 0x10 or body >= at + PACKET:
            continue
        cc = b3 & 15
        before = last.get(pid)
        if before is not None and cc != before + 1 & 15:
            if cc == before:
                continue  # a repeated packet
            s.gaps += 1
        last[pid] = cc
        if pid == data_pid:
            if b1 & 0x40:
                finish()
            if access:
                s.random_access.append(at)
            unit.append(media[body : at + PACKET])
        elif (pid == PAT_PID or pid in pmt_pids) and b1 & 0x40:
            raw = media[body : at + PACKET]
            if (pid, raw) not in good:
                good[pid, raw] = _table(raw)
                section = good[pid, raw]
                if section is None:
                    s.damaged += 1
                elif pid == PAT_PID:
                    for k in range(8, len(section) - 4, 4):
                        program, target = int.from_bytes(section[k : k + 2], "big"), int.from_bytes(section[k + 2 : k + 4], "big") & 0x1FFF
                        if program:
                            s.programs[program] = target
                            pmt_pids.add(target)
                elif data_pid is None:
                    k = 12 + (int.from_bytes(section[10:12], "big") & 0x0FFF)
                    if k + 5 <= len(section) - 4:
                        s.stream_type, data_pid = section[k], int.from_bytes(section[k + 1 : k + 3], "big") & 0x1FFF
    finish()
    s.damaged += len(media) % PACKET > 0
    s.payload = b"".join(out)
    return s


SCHEMA = "n_bytes long, media binary, payload binary, packets long, programs int, stream_type int, gaps long, damaged long, pts array<long>, random_access array<long>"


def to_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the stored stream and everything read back from its bytes.

    Null texts are empty; an empty text is stored as one block of blanks.  Equal texts give equal
    streams whatever their ids or other columns, which are not read.  No text is cut.
    """
    docs = keyed_text(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, at = batch.column(1).cast(pa.binary()), 0
        while at < len(texts):
            rows, size, first = [], 0, at
            while at < len(texts) and size < 8 << 20:
                data = texts[at].as_py() or b""
                media = mux(padded(data))
                s = demux(media)
                rows.append((len(data), media, s.payload, s.packets, len(s.programs), s.stream_type, s.gaps, s.damaged, s.pts, s.random_access))
                size += len(media)
                at += 1
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), *columns], ["doc_id", *(c.split()[0] for c in SCHEMA.split(", "))])

    return map_batches(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")


def digest(streams: DataFrame) -> DataFrame:
    """Digest columns of ``to_streams``; payload values come from the bytes read back."""
    feature = F.concat_ws(
        ";",
        F.concat(F.lit("packets="), F.col("packets")),
        F.concat(F.lit("units="), F.size("pts")),
        F.concat(F.lit("last_pts="), F.coalesce(F.element_at("pts", -1), F.lit(-1))),
        F.concat(F.lit("random_access="), F.size("random_access")),
        F.concat(F.lit("gaps="), F.col("gaps")),
        F.concat(F.lit("damaged="), F.col("damaged")),
    )
    return streams.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, greatest(octet_length(payload) - 15, 1), 16)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        feature.alias("feature"),
    )
