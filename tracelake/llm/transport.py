"""Media columns in MPEG transport streams.

`mux` stores bytes in a single-program stream: a program association table, a program map table and one private
elementary stream whose access units hold UNIT bytes each, with a presentation timestamp and a clock reference on every
unit, and the random-access flag on each unit that doesn't begin within a character, where a reader can start. `demux`
reads any such stream back: it checks sync bytes and table checksums, follows the tables to the elementary stream,
checks continuity counters, reassembles packets and units, and lists the timestamps of all units, the clock references,
and the packet and timestamp of each random-access point. Fixed values are those of the public transport stream format.

Null text counts as empty; a payload is the UTF-8 bytes with zeros up to a positive multiple of 64. A stream that can't
be read gives null fields and the reason in `error`; a null stream gives null.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import sliced, table

#: Fixed values of the format.
PACKET, SYNC, PMT_PID, DATA_PID, PRIVATE_TYPE, PRIVATE_ID, CLOCK = 188, 0x47, 0x1000, 0x0100, 0x06, 0xBD, 90_000
#: Bytes in an access unit, and units in a second.
UNIT, RATE = 32_768, 30
ALIGN = 64


def payload(data: bytes) -> bytes:
    return data + bytes(-len(data) % ALIGN or (0 if data else ALIGN))


@lru_cache(maxsize=None)
def _crc_table() -> tuple[int, ...]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)
        out.append(c & 0xFFFFFFFF)
    return tuple(out)


@lru_cache(maxsize=256)
def crc_mpeg(data: bytes) -> int:
    crc, t = 0xFFFFFFFF, _crc_table()
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ t[(crc >> 24) ^ b]
    return crc


@lru_cache(maxsize=None)
def _table_packet(pid: int, table_id: int, body: bytes) -> bytes:
    """A packet with one section: number 1, version 0, current."""
    section = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + b"\x00\x01\xc1\x00\x00" + body
    section += crc_mpeg(section).to_bytes(4, "big")
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00" + section).ljust(PACKET, b"\xff")


def _stamp(mark: int, t: int) -> bytes:
    return bytes([mark << 4 | (t >> 29 & 14) | 1]) + ((t >> 14 & 0xFFFE) | 1).to_bytes(2, "big") + ((t << 1 & 0xFFFE) | 1).to_bytes(2, "big")


def mux(data: bytes, unit: int = UNIT) -> bytes:
    out = [
        _table_packet(0, 0, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")),
        _table_packet(PMT_PID, 2, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"),
    ]
    count = 0
    for k, low in enumerate(range(0, len(data), unit)):
        time = k * CLOCK // RATE
        part = data[low : low + unit]
        pes = b"\x00\x00\x01" + bytes([PRIVATE_ID]) + (len(part) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, time) + part
        room = PACKET - 12
        stuff = max(0, room - len(pes))
        clock = (time % (1 << 33)) << 15 | 0x7E00
        start = 0x10 if part[0] & 0xC0 == 0x80 else 0x50  # a continuation byte is no place to start
        out.append(bytes([SYNC, 0x40 | DATA_PID >> 8, DATA_PID & 255, 0x30 | count, 7 + stuff, start]) + clock.to_bytes(6, "big") + b"\xff" * stuff + pes[: room - stuff])
        count = (count + 1) & 15
        rest = pes[room - stuff :]
        n = len(rest) // (PACKET - 4)
        if n:
            rows = np.empty((n, PACKET), np.uint8)
            rows[:, :3] = SYNC, DATA_PID >> 8, DATA_PID & 255
            rows[:, 3] = 0x10 | (count + np.arange(n)) & 15
            rows[:, 4:] = np.frombuffer(rest, np.uint8, n * (PACKET - 4)).reshape(n, -1)
            out.append(rows.tobytes())
            count = (count + n) & 15
        if tail := rest[n * (PACKET - 4) :]:
            stuff = PACKET - 5 - len(tail)
            out.append(bytes([SYNC, DATA_PID >> 8, DATA_PID & 255, 0x30 | count, stuff]) + (b"\x00" + b"\xff" * (stuff - 1) if stuff else b"") + tail)
            count = (count + 1) & 15
    return b"".join(out)


def _section(packet: np.ndarray, table_id: int) -> bytes:
    raw = packet.tobytes()
    start = 5 + raw[4]
    size = 3 + (int.from_bytes(raw[start + 1 : start + 3], "big") & 0xFFF)
    section = raw[start : start + size]
    if section[:1] != bytes([table_id]) or len(section) != size or crc_mpeg(section):
        raise ValueError(f"damaged table {table_id}")
    return section


def demux(media: bytes) -> dict:
    """payload, packets, units, pts (of each unit), clocks, random_access (packet numbers), access_pts (their units' timestamps), continuity_errors."""
    if not media or len(media) % PACKET:
        raise ValueError("not whole packets")
    rows = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (rows[:, 0] != SYNC).any():
        raise ValueError("sync byte missing")
    pids = (rows[:, 1] & 0x1F).astype(np.int32) << 8 | rows[:, 2]
    if not (at := np.nonzero(pids == 0)[0]).size:
        raise ValueError("no program association table")
    pat = _section(rows[at[0]], 0)
    programs = {int.from_bytes(pat[i : i + 2], "big"): int.from_bytes(pat[i + 2 : i + 4], "big") & 0x1FFF for i in range(8, len(pat) - 4, 4)}
    where = next((p for n, p in programs.items() if n), None)
    if where is None or not (at := np.nonzero(pids == where)[0]).size:
        raise ValueError("no program map table")
    pmt = _section(rows[at[0]], 2)
    i = 12 + (int.from_bytes(pmt[10:12], "big") & 0xFFF)
    streams = []
    while i < len(pmt) - 4:
        streams.append((pmt[i], int.from_bytes(pmt[i + 1 : i + 3], "big") & 0x1FFF))
        i += 5 + (int.from_bytes(pmt[i + 3 : i + 5], "big") & 0xFFF)
    pid = next((p for kind, p in streams if kind == PRIVATE_TYPE), None)
    if pid is None:
        raise ValueError("no private stream")
    number = np.nonzero(pids == pid)[0]
    rows = rows[number]
    field, has = rows[:, 3] >> 4 & 3, rows[:, 3] & 0x10 != 0
    count = (rows[has, 3] & 15).astype(int)
    errors = int(((np.diff(count) & 15) != 1).sum())
    start = 4 + np.where(field & 2, 1 + rows[:, 4].astype(int), 0)
    start[~has] = PACKET
    flags = np.where((field & 2 != 0) & (rows[:, 4] > 0), rows[:, 5], 0)
    timed = np.nonzero((flags & 0x10 != 0) & (rows[:, 4] >= 7))[0]
    clocks = [int.from_bytes(rows[i, 6:12].tobytes(), "big") >> 15 for i in timed]
    data = rows[np.arange(PACKET) >= start[:, None]].tobytes()
    ends = np.cumsum(PACKET - start)
    first = np.nonzero(rows[:, 1] & 0x40)[0]
    begins = (ends - (PACKET - start))[first].tolist()
    parts, pts, stamps = [], [], []
    for low, high in zip(begins, [*begins[1:], len(data)]):
        pes = data[low:high]
        if pes[:3] != b"\x00\x00\x01" or 6 + int.from_bytes(pes[4:6], "big") != len(pes):
            raise ValueError("damaged elementary packet")
        if pes[7] & 0x80:
            stamps.append((pes[9] >> 1 & 7) << 30 | (int.from_bytes(pes[10:12], "big") >> 1) << 15 | int.from_bytes(pes[12:14], "big") >> 1)
            pts.append(stamps[-1])
        else:
            stamps.append(None)
        parts.append(pes[9 + pes[8] :])
    points = np.nonzero(flags & 0x40 != 0)[0]
    unit_of = np.searchsorted(first, points, "right") - 1
    access = [stamps[u] if u >= 0 else None for u in unit_of]
    return {"payload": b"".join(parts), "packets": len(pids), "units": len(parts), "pts": pts, "clocks": clocks, "random_access": number[points].tolist(), "access_pts": access, "continuity_errors": errors}


def feature(x: dict) -> str:
    """What the stream and its payload look like: packets, units, points, last timestamp, share of bytes in eight ranges (per mille)."""
    data = np.frombuffer(x["payload"], np.uint8)
    bins = np.bincount(data >> 5, minlength=8) * 1000 // max(1, data.size)
    return f"packets={x['packets']};units={x['units']};points={len(x['random_access'])};pts={x['pts'][-1] if x['pts'] else -1};bytes={'/'.join(map(str, bins))}"


STREAM = "doc_id long, n_bytes long, media binary"
READ = "payload: binary, packets: int, units: int, pts: array<long>, clocks: array<long>, random_access: array<int>, access_pts: array<long>, continuity_errors: int, feature: string, error: string"


def to_streams(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes (before padding) and media, the transport stream of each row's payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            raw = [x.as_py() or b"" for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(len, raw), pa.int64()), pa.array((mux(payload(x)) for x in raw), pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")).mapInArrow(run, STREAM)


def read_stream(media: bytes | None) -> dict | None:
    if media is None:
        return None
    try:
        x = demux(media)
    except (ValueError, IndexError) as e:
        return {"error": str(e)}
    return x | {"feature": feature(x)}


def from_streams(df: DataFrame) -> DataFrame:
    """Adds `stream`, what reading the stored bytes of `media` gives."""

    kinds = pa.struct([("payload", pa.binary()), ("packets", pa.int32()), ("units", pa.int32()), ("pts", pa.list_(pa.int64())), ("clocks", pa.list_(pa.int64())), ("random_access", pa.list_(pa.int32())), ("access_pts", pa.list_(pa.int64())), ("continuity_errors", pa.int32()), ("feature", pa.string()), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 2):
            read = pa.array((read_stream(x.as_py()) for x in b.column("media")), kinds)
            yield pa.RecordBatch.from_arrays([*b.columns, read], names=[*b.schema.names, "stream"])

    return df.mapInArrow(run, f"{STREAM}, stream struct<{READ}>")


def digests(df: DataFrame) -> DataFrame:
    s = F.col("stream")
    return df.select(
        "doc_id",
        "n_bytes",
        F.octet_length(s["payload"]).cast("long").alias("payload_bytes"),
        F.sha2(s["payload"], 256).alias("payload_sha256"),
        F.crc32(F.substring(s["payload"], -ALIGN, ALIGN)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        s["feature"].alias("feature"),
        s["pts"].alias("timestamps"),
        s["random_access"].alias("random_access_packets"),
        s["access_pts"].alias("random_access_timestamps"),
        s["continuity_errors"].cast("long").alias("continuity_errors"),
    )


def op7_transport(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(from_streams(to_streams(table(spark, sf_dir, "documents"))))
