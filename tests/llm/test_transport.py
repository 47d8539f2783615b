import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import transport as ts


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([1, 64, 100, 161, 162, 163, 345, 346, 1000, ts.UNIT]))
def test_round_trip(data, unit):
    media = ts.mux(data, unit)
    assert len(media) % ts.PACKET == 0
    if data:
        x = ts.demux(media)
        assert x["payload"] == data and x["continuity_errors"] == 0
        assert x["units"] == -(-len(data) // unit) and x["pts"] == x["clocks"] == [k * 3000 for k in range(x["units"])]
        starts = [k for k in range(x["units"]) if data[k * unit] & 0xC0 != 0x80]
        assert x["access_pts"] == [k * 3000 for k in starts] and len(x["random_access"]) == len(starts)
        assert all(media[n * ts.PACKET + 5] & 0x40 for n in x["random_access"])


def crc(data):
    c = 0xFFFFFFFF
    for b in data:
        for i in range(7, -1, -1):
            c = (c << 1 & 0xFFFFFFFF) ^ (0x04C11DB7 if (c >> 31) ^ (b >> i & 1) else 0)
    return c.to_bytes(4, "big")


def test_stream_equals_one_written_by_hand():
    """Tables, adaptation field, clock and packet header as the format's description gives them; the first table is the one that most muxers write."""
    pat = bytes.fromhex("474000100000b00d0001c100000001f0002ab104b2").ljust(188, b"\xff")
    section = bytes.fromhex("02b0120001c10000e100f00006e100f000")
    pmt = (bytes.fromhex("4750001000") + section + crc(section)).ljust(188, b"\xff")
    pes = bytes.fromhex("000001bd000d848005" + "2100010001") + b"hello"
    data = bytes.fromhex("47410030" + "a4" + "50" + "000000007e00") + b"\xff" * 157 + pes
    assert len(data) == 188 and ts.mux(b"hello") == pat + pmt + data
    late = bytes.fromhex("000001bd000a848005" + "2100011771") + b"lo"
    second = ts.mux(b"hello", 3)[3 * 188 :]
    assert len(second) == 188 and second.endswith(late) and second[:6] == bytes.fromhex("47410031a750") and second[6:12] == (3000 << 15 | 0x7E00).to_bytes(6, "big")


def test_long_payload_and_stamps():
    data = bytes(range(256)) * 2000
    x = ts.demux(ts.mux(data))
    assert x["payload"] == data and x["units"] == 16
    text = ("é" * 40_000).encode()[1:]  # units begin within a character
    assert ts.demux(ts.mux(text))["access_pts"] == [] and ts.demux(ts.mux(text[1:]))["access_pts"] == [0, 3000, 6000]
    assert ts.payload(b"") == bytes(64) and len(ts.payload(b"a" * 65)) == 128 and ts.payload(b"a" * 64) == b"a" * 64


def test_faults_are_found():
    media = ts.mux(b"x" * 2000)
    packets = [media[i : i + ts.PACKET] for i in range(0, len(media), ts.PACKET)]
    assert ts.read_stream(b"".join(packets[:3] + packets[4:])) == {"error": "damaged elementary packet"}
    lost = b"".join([*packets[:2], packets[2], *packets[2:]])
    assert "error" in ts.read_stream(lost)
    broken = bytearray(media)
    broken[10] ^= 1
    assert ts.read_stream(bytes(broken)) == {"error": "damaged table 0"}
    assert ts.read_stream(b"abc") == {"error": "not whole packets"} and ts.read_stream(None) is None
    assert ts.read_stream(packets[0])["error"] == "no program map table"
    renumbered = bytearray(media)
    renumbered[5 * ts.PACKET + 3] ^= 7
    assert ts.read_stream(bytes(renumbered))["continuity_errors"] == 2
    assert ts.crc_mpeg(b"123456789") == 0x0376E6E7


def test_operator(spark, odd, empty):
    got = ts.digests(ts.from_streams(ts.to_streams(odd.withColumn("media", odd["source"])))).collect()
    texts = [r["text"] for r in odd.collect()]
    assert len(got) == len(texts)
    want = sorted((len((t or "").encode()), hashlib.sha256(ts.payload((t or "").encode())).hexdigest(), zlib.crc32(ts.payload((t or "").encode())[-64:])) for t in texts)
    assert sorted((r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == want
    same = [str(tuple(r)[1:]) for r in got if r["doc_id"] in (5, 6)]
    assert len(set(same)) == 1
    assert ts.digests(ts.from_streams(ts.to_streams(empty))).count() == 0


def test_null_media(spark):
    df = spark.createDataFrame([(1, 0, None), (2, 0, bytearray(b"junk"))], ts.STREAM)
    got = {r["doc_id"]: r["stream"] for r in ts.from_streams(df).collect()}
    assert got[1] is None and got[2]["error"] == "not whole packets" and got[2]["payload"] is None
