"""Media columns: MPEG transport streams written, parsed and indexed.

A stream is a row of 188-byte packets: a program association table, a program map table, and the
packetised elementary stream of one program. The writer stores 8-bit samples in frames of 576 (12
ms at 48 kHz), eight frames to an elementary packet with a timestamp, each a random-access point
with the tables before it, so that a stream can be entered there. The parser takes any stream of
whole packets: it reads the tables, checks continuity counters, reassembles every listed elementary
stream and lists the first one's timestamps and random-access points.
Every row is independent; batches are bounded by Spark's Arrow limits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the transport stream format.
PACKET, SYNC, STUFFING = 188, 0x47, 0xFF
PAT_PID, NULL_PID = 0x0000, 0x1FFF
PRIVATE_STREAM, PRIVATE_DATA = 0xBD, 0x06

#: A section has 4,096 bytes at most.
MOST_SECTION_PACKETS = 24

MAP_PID, DATA_PID, PROGRAM = 0x100, 0x101, 1
#: Samples of a frame, frames of an elementary packet, and 90 kHz ticks of a frame.
FRAME, FRAMES, TICKS = 576, 8, 1080

INDEX = (
    "packets int, programs string, continuity_errors int, elementary_packets int, "
    "timestamps array<bigint>, random_access array<int>, payload binary, "
    "others array<struct<program:int,kind:int,pid:int,elementary_packets:int,timestamps:array<bigint>,payload:binary>>"
)


def crc_mpeg(data: bytes) -> int:
    """CRC-32 of table sections: polynomial 04C11DB7, most significant bit first, all ones at the start."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


def _section(table: int, number: int, body: bytes) -> bytes:
    size = 5 + len(body) + 4
    head = bytes([table, 0xB0 | size >> 8, size & 0xFF]) + number.to_bytes(2) + bytes([0xC1, 0, 0])
    return head + body + crc_mpeg(head + body).to_bytes(4)


def _table_packet(pid: int, section: bytes) -> bytes:
    packet = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section
    return packet + bytes([STUFFING]) * (PACKET - len(packet))


@lru_cache
def _tables() -> bytes:
    programs = PROGRAM.to_bytes(2) + (0xE000 | MAP_PID).to_bytes(2)
    streams = (0xE000 | DATA_PID).to_bytes(2) + bytes([0xF0, 0]) + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2) + bytes([0xF0, 0])
    return _table_packet(PAT_PID, _section(0, 1, programs)) + _table_packet(MAP_PID, _section(2, PROGRAM, streams))


@lru_cache
def _layout(size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, places): the packets of one elementary packet of ``size`` bytes without its bytes, and where these go."""
    rows, places, left = [], [], size
    while left:
        first = not rows
        room = 176 if first else 184
        taken = min(left, room)
        spare = room - taken
        row = np.full(PACKET, STUFFING, dtype=np.uint8)
        row[:4] = SYNC, (0x40 if first else 0) | DATA_PID >> 8, DATA_PID & 0xFF, 0x30 if first or spare else 0x10
        if first:
            row[4:12] = 7 + spare, 0x50, 0, 0, 0, 0, 0x7E, 0  # random access and a program clock
        elif spare:
            row[4] = spare - 1
            if spare > 1:
                row[5] = 0
        places.append(len(rows) * PACKET + PACKET - taken + np.arange(taken))
        rows.append(row)
        left -= taken
    return np.concatenate(rows), np.concatenate(places)


def _elementary(data: np.ndarray, first_frame: int) -> np.ndarray:
    """The packets of equally long elementary packets, one per row of ``data``, each after the tables; counters are still zero."""
    count, size = data.shape
    blank, places = _layout(14 + size)
    out = np.tile(blank, (count, 1))
    clock = (first_frame + np.arange(count, dtype=np.int64) * FRAMES) * TICKS % (1 << 33)
    head = np.zeros((count, 14), dtype=np.uint8)
    head[:, :9] = 0, 0, 1, PRIVATE_STREAM, (8 + size) >> 8, (8 + size) & 0xFF, 0x84, 0x80, 5
    head[:, 9] = 0x21 | (clock >> 30 & 7) << 1
    head[:, 10], head[:, 11] = clock >> 22 & 0xFF, clock >> 14 & 0xFE | 1
    head[:, 12], head[:, 13] = clock >> 7 & 0xFF, clock << 1 & 0xFE | 1
    out[:, places[:14]], out[:, places[14:]] = head, data
    for n, shift in enumerate((25, 17, 9, 1)):
        out[:, 6 + n] = clock >> shift & 0xFF
    out[:, 10] = (clock & 1) << 7 | 0x7E
    tables = np.frombuffer(_tables(), dtype=np.uint8)
    return np.concatenate([np.tile(tables, (count, 1)), out], axis=1).reshape(-1)


def write_stream(payload: bytes) -> bytes:
    """The transport stream that stores ``payload``, whose length is a multiple of FRAME."""
    data = np.frombuffer(payload, dtype=np.uint8)
    whole = len(data) // (FRAME * FRAMES)
    parts = []
    if whole:
        parts.append(_elementary(data[: whole * FRAME * FRAMES].reshape(whole, -1), 0))
    if len(data) > whole * FRAME * FRAMES:
        parts.append(_elementary(data[whole * FRAME * FRAMES :].reshape(1, -1), whole * FRAMES))
    if not parts:
        return _tables()
    stream = np.concatenate(parts).reshape(-1, PACKET)
    pid = (stream[:, 1].astype(np.int32) & 0x1F) << 8 | stream[:, 2]
    for one in (PAT_PID, MAP_PID, DATA_PID):
        rows = np.flatnonzero(pid == one)
        stream[rows, 3] |= (np.arange(len(rows)) % 16).astype(np.uint8)
    return stream.tobytes()


def _sections(packets: np.ndarray, starts: np.ndarray, unit: np.ndarray) -> bytes:
    """The first whole section that a table's packets carry; empty if there is none or its checksum is wrong."""
    first = np.flatnonzero(unit)
    if not len(first):
        return b""
    data = b"".join(packets[i, starts[i] :].tobytes() for i in range(first[0], min(len(packets), first[0] + MOST_SECTION_PACKETS)))
    data = data[1 + data[0] :] if data else b""
    size = 3 + (int.from_bytes(data[1:3]) & 0x0FFF) if len(data) >= 3 else 0
    return data[:size] if 12 <= size <= len(data) and crc_mpeg(data[:size]) == 0 else b""


@lru_cache(maxsize=64)
def _programs(section: bytes) -> dict[int, int]:
    """Program number to the PID of its map."""
    rows = [section[i : i + 4] for i in range(8, len(section) - 7, 4)]
    return {int.from_bytes(r[:2]): int.from_bytes(r[2:]) & 0x1FFF for r in rows if r[:2] != b"\0\0"}


@lru_cache(maxsize=64)
def _streams(section: bytes) -> list[tuple[int, int]]:
    """(stream type, PID) of a program map."""
    at, found = 12 + (int.from_bytes(section[10:12]) & 0x0FFF), []
    while at + 5 <= len(section) - 4:
        found.append((section[at], int.from_bytes(section[at + 1 : at + 3]) & 0x1FFF))
        at += 5 + (int.from_bytes(section[at + 3 : at + 5]) & 0x0FFF)
    return found


def parse_stream(media: bytes | None) -> dict:
    """The index of one stream, by the names of INDEX. Bytes beyond the last whole packet and packets out of sync are left out."""
    data = np.frombuffer(media or b"", dtype=np.uint8)
    packets = data[: len(data) // PACKET * PACKET].reshape(-1, PACKET)
    if len(packets) and not (packets[:, 0] == SYNC).all():
        packets = packets[packets[:, 0] == SYNC]
    pid = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    unit = (packets[:, 1] & 0x40) > 0
    has_field, has_data = (packets[:, 3] & 0x20) > 0, (packets[:, 3] & 0x10) > 0
    field = np.where(has_field, packets[:, 4].astype(np.int32), -1)
    starts = np.minimum(4 + 1 + field, PACKET)
    flags = np.where(field > 0, packets[:, 5], 0)
    counter = packets[:, 3] & 0x0F

    of = lambda wanted: np.flatnonzero((pid == wanted) & has_data)
    table = of(PAT_PID)
    programs = _programs(_sections(packets[table], starts[table], unit[table]))
    streams: list[tuple[int, int, int]] = []
    for number, map_pid in sorted(programs.items()):
        table = of(map_pid)
        section = _sections(packets[table], starts[table], unit[table])
        streams += [(number, kind, p) for kind, p in (_streams(section) if section else [])]

    errors, access, found = 0, [], []
    for n, (number, kind, stream_pid) in enumerate(streams):
        rows = of(stream_pid)
        step = (counter[rows][1:].astype(np.int32) - counter[rows][:-1]) % 16
        again = np.zeros(len(rows), dtype=bool)
        stays = np.flatnonzero(step == 0) + 1
        again[stays] = (packets[rows[stays]] == packets[rows[stays - 1]]).all(axis=1) if len(stays) else False
        excused = again[1:] | ((flags[rows][1:] & 0x80) > 0)
        errors += int(((step != 1) & ~excused).sum())
        rows = rows[~again]
        if not n:
            access = rows[(flags[rows] & 0x40) > 0].tolist()
        found.append((number, kind, stream_pid, *_elementary_packets(packets[rows], starts[rows], unit[rows])))
    _, _, _, count, clocks, payload = found[0] if found else (0, 0, 0, 0, [], b"")
    others = [dict(zip(("program", "kind", "pid", "elementary_packets", "timestamps", "payload"), x, strict=True)) for x in found[1:]]
    names = ",".join(f"{number}:{kind:02x}@{p}" for number, kind, p in streams)
    values = (len(packets), names, errors, count, clocks, access, payload, others)
    return dict(zip(("packets", "programs", "continuity_errors", "elementary_packets", "timestamps", "random_access", "payload", "others"), values, strict=True))


def _elementary_packets(packets: np.ndarray, starts: np.ndarray, unit: np.ndarray) -> tuple[int, list[int], bytes]:
    """(elementary packets, timestamps, payload) that one stream's transport packets carry."""
    begins = np.cumsum(PACKET - starts) - (PACKET - starts)
    joined = packets[np.arange(PACKET) >= starts[:, None]].tobytes()
    edges = [*begins[unit].tolist(), len(joined)]
    count, clocks, parts = 0, [], []
    for at, end in zip(edges, edges[1:], strict=False):
        head = joined[at : at + 14]
        if len(head) < 9 or head[:3] != b"\0\0\1":
            continue
        size = int.from_bytes(head[4:6])
        count += 1
        if head[7] & 0x80 and len(head) == 14:
            b = head[9:14]
            clocks.append((b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1)
        parts.append(joined[at + 9 + head[8] : min(end, at + 6 + size) if size else end])
    return count, clocks, b"".join(parts)


def _write_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, streams = [], []
        for text in batch.column(1):
            data = (text.as_py() or "").encode()
            sizes.append(len(data))
            streams.append(write_stream(data + bytes([0xFF]) * ((-len(data)) % FRAME if data else FRAME)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(streams, pa.binary())], names=["doc_id", "n_bytes", "media"])


def store_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a transport stream.

    The payload is the text's UTF-8, filled with bytes 255 to a positive multiple of FRAME; null
    and empty texts are one frame of filling. Equal texts give equal streams; repeated rows stay;
    a null doc_id stays null; an empty table gives no rows; further columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_write_batches, "doc_id long, n_bytes long, media binary")


def _index_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    other = {"program": pa.int32(), "kind": pa.int32(), "pid": pa.int32(), "elementary_packets": pa.int32(), "timestamps": pa.list_(pa.int64()), "payload": pa.binary()}
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.struct(other))]
    for batch in batches:
        rows = [parse_stream(media.as_py()) for media in batch["media"]]
        names = list(rows[0]) if rows else []
        columns = [pa.array([row[name] for row in rows], kind) for name, kind in zip(names, kinds, strict=False)]
        if rows:
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])


def index_media(stored: DataFrame) -> DataFrame:
    """The columns of store_media with the index of each stream read back from its bytes (see INDEX).

    timestamps are 90 kHz ticks in stream order, random_access numbers of packets; payload is that of
    the first listed stream, ``others`` holds the further streams of all programs. A null or
    empty stream has no packets and an empty payload; damaged tables leave the payload empty;
    counter jumps that no discontinuity mark excuses count as continuity_errors.
    """
    narrow = stored.select("doc_id", "n_bytes", "media")
    return narrow.mapInArrow(_index_batches, f"doc_id long, n_bytes long, media binary, {INDEX}")
