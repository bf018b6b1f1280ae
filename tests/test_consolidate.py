import random

from conftest import rows
from pyspark.sql import functions as F

from slotlake.operators import consolidate
from slotlake.operators.prefix import blocked_running_sum

REFS = "disk_id long, fid long, target_fid long, stored_size long, size long, byte_offset long, packed boolean"
PACKED = "table_fid long, disk_id long, container_fid long, container_size long, nonce long, entries array<struct<fid:long,byte_offset:long,size:long>>"
TRIM = "disk_id long, last_check_at timestamp, last_threshold_bytes long, last_small_files long"


def test_small_objects(frame):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    refs = [(1, 1, None, 5, 5, 0, None), (1, 1, None, 5, 5, 0, True), (1, 2, 2, 7, None, 0, False), (1, 3, 4, 5, 5, 0, False), (1, 4, 4, 6, 6, 0, False), (1, 5, 5, 100, 100, 0, False)]
    refs += [(1, 6, 6, 5, 5, 0, False), (1, 7, 7, 5, 5, 0, False), (1, 8, 8, 5, 5, 0, False), (1, 9, 9, 5, 5, 0, False), (1, 10, 10, None, None, 0, False), (2, 1, 1, 1, 1, 0, False), (None, 1, 1, 1, 1, 0, False)]
    packed = [(6, 1, 7, 10, 0, [(8, 0, 5), (9, 8, 5), (1, 0, 0)]), (6, 1, 7, 10, 0, [(8, 0, 5)]), (20, 1, 21, 10, None, None)]
    trim = [(1, t(1), 1000, 0), (1, t(2), 50, 0), (1, None, 1, 0), (2, t(1), None, 0)]
    got = consolidate.small_objects(frame(REFS, refs), frame(PACKED, packed), frame(TRIM, trim))
    assert {(r.disk_id, r.fid, r.size) for r in got.collect()} == {(1, 1, 5), (1, 2, 7), (1, 9, 5)}
    empty = consolidate.small_objects(frame(REFS, []), frame(PACKED, []), frame(TRIM, []))
    assert consolidate.consolidate(empty).count() == 0


def test_containers_hold_every_object_once_and_are_filled(frame):
    rng = random.Random(2)
    objects = [(d, rng.getrandbits(64) - 2**63, rng.randrange(1, 64), 64) for d in (1, 1, 1, 2) for _ in range(700)]
    c = consolidate.consolidate(frame("disk_id long, fid long, size long, threshold long", objects), container_bytes=1000, range_bits=3).collect()
    held = [(r.disk_id, e.fid, e.size) for r in c for e in r.entries]
    assert sorted(held) == sorted(o[:3] for o in objects)
    for r in c:
        at = 0
        for e in r.entries:
            assert e.byte_offset == at
            at += e.size
        assert at == r.container_size <= 1000
        unsigned = [e.fid & (2**64 - 1) for e in r.entries]
        assert unsigned == sorted(unsigned) and (r.first_fid, r.last_fid) == (r.entries[0].fid, r.entries[-1].fid)
    last = {d: max(r.container_no for r in c if r.disk_id == d) for d in (1, 2)}
    assert all(r.container_size > 1000 - 2 * 64 for r in c if r.container_no < last[r.disk_id])


def test_repeats_stay(frame):
    o = [(1, 5, 10, 20), (1, 5, 10, 20), (1, 6, None, 20)]
    c = consolidate.consolidate(frame("disk_id long, fid long, size long, threshold long", o)).collect()
    assert [(e.fid, e.byte_offset, e.size) for e in c[0].entries] == [(5, 0, 10), (5, 10, 10), (6, 20, 0)]


def test_running_sum(frame):
    rng = random.Random(1)
    data = [(g, k, rng.choice([None, 1, 5])) for g in (1, 2) for k in range(50)]
    got = blocked_running_sum(frame("g long, k long, v long", data), ["g"], F.floor(F.col("k") / 7), [F.col("k")], "v", "before")
    for r in got.collect():
        assert r.before == sum(v or 0 for g, k, v in data if g == r.g and k < r.k)
    assert rows(blocked_running_sum(frame("g long, k long, v long", []), ["g"], F.col("k"), [F.col("k")], "v", "b")) == []


def test_empty_objects_fill_many_containers(spark):
    o = spark.range(20_000).select(F.lit(1).cast("long").alias("disk_id"), F.xxhash64("id").alias("fid"), F.lit(0).cast("long").alias("size"), F.lit(10).cast("long").alias("threshold"))
    c = consolidate.consolidate(o, container_bytes=10_000, entries=1_000).select(F.size("entries").alias("n")).collect()
    assert sum(r.n for r in c) == 20_000 and max(r.n for r in c) <= 2_000


def test_rows_without_a_key_are_left_out(frame):
    o = [(None, 5, 10, 20), (1, None, 10, 20), (1, -1, 3, 20), (1, 1, -4, None)]
    got = consolidate.merged_objects(frame("disk_id long, fid long, size long, threshold long", o)).collect()
    assert sorted((r.disk_id, r.fid, r.size, r.lies, r.container_no) for r in got) == [(1, -1, 3, 0, 0), (1, 1, 0, 0, 0)]
