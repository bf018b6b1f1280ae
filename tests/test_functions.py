import random

import pytest
from pyspark.sql import functions as F

from slotlake.functions import address, codecs, fid, parse
from slotlake.types import ANCHOR_CODE, GRID_START, JUMP_SENTINEL, PACKED_SENTINEL, signed, unsigned_decimal, unsigned_mod, unsigned_order


def test_known_fids():
    assert fid.content_fid(b"") == signed(0x2D06800538D394C2)
    assert fid.content_fid(b"abc") == signed(0x78AF5F94892F3950)
    assert fid.jump_fids(b"abc", 3) == [fid.jump_fid(b"abc", j) for j in (1, 2, 3)]
    with pytest.raises(ValueError):
        fid.jump_fid(b"abc", 0)


def test_fid_columns(frame):
    df = frame("p binary", [(b"abc",), (b"",), (None,)])
    got = [r[0] for r in df.select(fid.xxh3("p")).collect()]
    assert got == [signed(0x78AF5F94892F3950), signed(0x2D06800538D394C2), None]
    jumps = [r[0] for r in df.select(fid.xxh3_jumps("p", F.lit(2))).collect()]
    assert jumps == [fid.jump_fids(b"abc", 2), fid.jump_fids(b"", 2), None]


def test_unsigned(frame):
    rng = random.Random(3)
    values = [0, 1, -1, 2**63 - 1, -(2**63), *(signed(rng.getrandbits(64)) for _ in range(300))]
    df = frame("x long", [(v,) for v in values])
    out = df.select("x", unsigned_mod(F.col("x"), F.lit(12345)).alias("m"), unsigned_decimal(F.col("x")).alias("d"), unsigned_order(F.col("x")).alias("o")).collect()
    for r in out:
        u = r.x & (2**64 - 1)
        assert r.m == u % 12345 and int(r.d) == u
    assert [r.x for r in sorted(out, key=lambda r: r.o)] == sorted(values, key=lambda v: v & (2**64 - 1))


def test_address(frame):
    df = frame("slots long, fid long, size long", [(10, -1, 4096), (10, 5, 0), (10, 5, 10 * 4096 + 1), (0, 5, 1), (1, 7, 1)])
    got = [tuple(r.a) for r in df.select(address.address(F.col("slots"), F.col("fid"), F.col("size")).alias("a")).collect()]
    slot = (2**64 - 1) % 10
    assert got[0] == (slot, 1, GRID_START + slot * 4096, None)
    assert [g[3] for g in got[1:]] == ["empty", "too_large", "no_slots", None]
    assert got[4][0] == 0


def test_powers(frame):
    values = [0, 1, 2, 3, 4, 7, 8, 1023, 1024, 1 << 20, (1 << 20) + 500, 2**48 - 1, 2**62 + 1]
    df = frame("x long", [(v,) for v in values])
    assert [r[0] for r in df.select(address.floor_log2(F.col("x"))).collect()] == [max(0, v.bit_length() - 1) for v in values]
    assert [address.small_file_bytes(p) for p in (-1, 0, 6, 51)] == [0, 4096, 262144, 2**64 - 1]
    p = frame("p int", [(-3,), (0,), (10,), (70,)])
    assert [r[0] for r in p.select(address.pow2_bytes(F.col("p"))).collect()] == [1, 1, 1024, 2**62]


def test_padding(frame):
    df = frame("p binary", [(b"a" * 5000,), (b"\xc3\xa9",)])
    assert [bytes(r[0]) for r in df.select(address.padded(F.col("p"))).collect()] == [b"a" * 5000 + bytes(3192), b"\xc3\xa9" + bytes(4094)]


@pytest.mark.parametrize(("text", "size"), [("1024", 1024), ("4KB", 4096), ("4K", 4096), ("1MB", 1 << 20), ("256M", 1 << 28), ("1GB", 1 << 30), ("2g", 2 << 30), ("512B", 512)])
def test_sizes(frame, text, size):
    assert parse.parse_size(text) == size
    assert frame("t string", [(text,)]).select(parse.parse_size_column(F.col("t"))).first()[0] == size


@pytest.mark.parametrize("text", ["", "invalid", "4X", "-1", "99999999999G"])
def test_bad_sizes(text):
    with pytest.raises(ValueError):
        parse.parse_size(text)


def test_ids_and_ranges(frame):
    assert parse.parse_id("0xFFFFFFFFFFFFFFFF") == -1 and parse.parse_id("42") == 42 and parse.parse_id("010") == 8
    assert parse.parse_range("5-10") == (5, 10) and parse.parse_range("5-") == (5, 0)
    for bad in ("", "a-b", "-5", "5"):
        with pytest.raises(ValueError):
            parse.parse_range(bad)
    a, b = parse.range_columns(F.col("t"))
    got = frame("t string", [("5-10",), ("5-",), ("x",), (None,)]).select(a.alias("a"), b.alias("b")).collect()
    assert [tuple(r) for r in got] == [(5, 10), (5, 0), (None, None), (None, None)]
    z = frame("p string", [("/dev/zram0",), ("/dev/zram12",), ("/dev/zram",), ("/dev/zram-backup",), ("/dev/zram1x",)])
    assert [r[0] for r in z.select(parse.is_zram_path(F.col("p"))).collect()] == [True, True, False, False, False]
    t = frame("f long", [(-1,), (0,), (255,)])
    assert [tuple(r) for r in t.select(parse.disk_id_text(F.col("f")), parse.fid_text(F.col("f"))).collect()] == [("0xFFFFFFFFFFFFFFFF", "0x" + "f" * 16), ("", "0x" + "0" * 16), ("0xFF", "0x" + "0" * 14 + "ff")]


def test_entries(frame):
    rows = [(5, 100, 0), (-7, JUMP_SENTINEL, 1), (9, PACKED_SENTINEL, ANCHOR_CODE), (3, 0, 0)]
    data = b"".join(codecs.encode_entry(*r) for r in rows)
    fid_, size, code = codecs.decode_entries(data + b"xx")
    assert list(zip(fid_.tolist(), size.tolist(), code.tolist(), strict=True)) == rows
    for bad in ((1, 5, 1), (1, PACKED_SENTINEL, 1), (1, 2**56, 0)):
        with pytest.raises(ValueError):
            codecs.encode_entry(*bad)
    df = frame("b binary", [(data + bytes(16) + data,), (b"",), (None,)])
    got = [r[0] for r in df.select(codecs.entries_udf("b")).collect()]
    assert [tuple(x) for x in got[0]] == rows and got[1] == [] and got[2] is None
    back = frame("f long, s long, c int", [*rows, (1, 5, 1)]).select(codecs.entry_bytes_udf("f", "s", "c")).collect()
    assert b"".join(bytes(r[0]) for r in back[:-1]) == data and back[-1][0] is None


def test_header(frame):
    h = codecs.encode_header(5, -3, "a note")
    assert len(h) == 4096 and codecs.decode_header(h) == {"version": 2, "capacity_gb": 5, "disk_id": -3, "note": "a note"}
    got = frame("b binary", [(h,), (b"NOPE" + h[4:],), (None,), (b"",)]).select(codecs.header_udf("b").alias("h")).select("h.*").collect()
    assert tuple(got[0]) == (2, 5, -3, "a note") and all(tuple(r) == (None,) * 4 for r in got[1:])


def test_packed(frame):
    good = codecs.encode_packed(-1, 7, 8192, [(1, 0, 100), (-2, 100, 200)], nonce=3)
    d = codecs.decode_packed(good)
    assert d["entries"][1] == {"fid": -2, "byte_offset": 100, "size": 200} and d["nonce"] == 3
    faults = {
        "short": good[:40],
        "magic": b"X" + good[1:],
        "length": good + b"x",
        "entry_range": codecs.encode_packed(1, 7, 128, [(1, 100, 40)]),
        "entry_size": codecs.encode_packed(1, 7, 128, [(1, 100, 0)]),
        "container_size": codecs.encode_packed(1, 7, 0, []),
    }
    assert {k: codecs.packed_fault(v) for k, v in faults.items()} == {k: k for k in faults}
    got = frame("b binary", [(good,), (faults["magic"],), (None,)]).select(codecs.packed_udf("b").alias("p")).select("p.*").collect()
    assert got[0].container_size == 8192 and len(got[0].entries) == 2 and got[0].fault is None
    assert [r.fault for r in got] == [None, "magic", "short"]


def test_manifest(frame):
    m = {"version": 1, "total_size": 300, "full_content_hash": -5, "filename": "é.bin", "chunk_target_size": 16 << 20}
    m["chunks"] = [{"fid": -9, "target_fid": 0, "byte_offset": 0, "size": 100, "jumps_taken": 0}, {"fid": 8, "target_fid": 7, "byte_offset": 100, "size": 200, "jumps_taken": 1}]
    data = codecs.encode_manifest(m)
    assert data[:5] == b"BSMN\x01" and codecs.decode_manifest(data) == m
    for bad in (b"plain text", data[:-1], b""):
        with pytest.raises(ValueError):
            codecs.decode_manifest(bad)
    got = frame("b binary", [(data,), (b"plain",), (None,)]).select(codecs.manifest_udf("b").alias("m")).select("m.*").collect()
    assert got[0].total_size == 300 and got[0].chunks[1].target_fid == 7 and got[1].version is None and got[2].chunks is None
    assert codecs.parse_snapshot_meta(codecs.snapshot_meta(9, "a" * 64)) == (9, "a" * 64)


def test_manifest_below_zero(frame):
    m = {"version": 1, "total_size": -1, "full_content_hash": -5, "filename": "f", "chunk_target_size": -(2**63)}
    m["chunks"] = [{"fid": -9, "target_fid": -1, "byte_offset": -1, "size": -(2**63), "jumps_taken": -1}, {"fid": 8, "target_fid": 7, "byte_offset": 2**63 - 1, "size": 0, "jumps_taken": 2**31 - 1}]
    got = frame("b binary", [(codecs.encode_manifest(m),), (b"plain",)]).select(codecs.manifest_udf("b").alias("m")).select("m.*").collect()
    assert got[0].asDict(recursive=True) == m and got[1].version is None
