import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from slotlake.functions.fid import sample_fids
from slotlake.operators import catalog, chunking, placement, reads, trim, writes
from slotlake.session import cut
from slotlake.types import GRID_START, SLOT_BYTES

EXT = "disk_id long, fid long, start long, end long"


def random_extents(rng, n, slots):
    out = []
    for k in range(n):
        s = rng.randrange(slots)
        out.append((rng.randrange(3), k, s, s + rng.randrange(4)))
    return out


@pytest.mark.parametrize("block", [2, 7, 1 << 20])
def test_overlap_against_brute_force(frame, block):
    rng = random.Random(block)
    e = random_extents(rng, 150, 400) + [(9, 1, None, None)]
    df = frame(EXT, e)
    live = [x for x in e if x[2] is not None]
    hit = {a for a in live for b in live if a != b and a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3]}
    assert set(map(tuple, placement.contested(df, block).collect())) == hit
    pairs = {(a[0], a[1], b[1]) for a in live for b in live if a[1] < b[1] and a[0] == b[0] and a[2] <= b[3] and b[2] <= a[3]}
    assert {tuple(r) for r in placement.conflicts(df, ["disk_id"], "fid").collect()} == pairs
    bad = {(r.disk_id, r.fid) for r in placement.occupancy_violations(df, block).collect()}
    order = sorted(live, key=lambda x: (x[0], x[2], x[3], x[1]))
    assert bad == {(x[0], x[1]) for i, x in enumerate(order) if any(y[0] == x[0] and y[3] >= x[2] for y in order[:i])}
    free = placement.free_of(df.where("fid < 75"), df.where("fid >= 75"), ["disk_id"])
    assert {r.fid for r in free.collect()} == {x[1] for x in e if x[1] < 75 and not any(y[1] >= 75 and y[0] == x[0] and None not in (x[2], y[2]) and x[2] <= y[3] and y[2] <= x[3] for y in e)}


def chd_brute(disk, slots, extents, p=0.2):
    need = placement.required_samples(p)
    fids = [f & (2**64 - 1) for f in sample_fids(disk)]

    def free(s):
        ok = 0
        for f in fids:
            a = f % (slots - s + 1)
            ok += not any(x <= a + s - 1 and a <= y for x, y in extents)
        return ok >= need

    lo, hi, best = 1, slots, 0
    while lo <= hi:
        m = (lo + hi) // 2
        if free(m):
            best, lo = m, m + 1
        else:
            hi = m - 1
    return best * SLOT_BYTES


def test_chd(frame):
    rng = random.Random(5)
    assert placement.chd_bytes(7, 2048, [], []) == 8 << 20
    assert placement.chd_bytes(7, 2048, [0], [2047]) == 0
    assert [placement.required_samples(p) for p in (0.2, 0, -1, 2, float("nan"), float("inf"), None, 1)] == [13] * 7 + [64]
    disks, ext, want = [], [], {}
    for d in range(8):
        e = [(s, s + rng.randrange(3)) for s in rng.sample(range(250), 10 * d)]
        disks.append((d, 256))
        ext += [(d, k, a, b) for k, (a, b) in enumerate(e)]
        want[d] = chd_brute(d, 256, e)
    got = placement.chd(frame("disk_id long, slots long", disks), frame(EXT, ext + ext[:5]))
    assert {r.disk_id: r.chd for r in got.collect()} == want


POOL = "disk_id long, pool_pos int, is_zram boolean, faulted boolean, slots long, chd long"


def routed(pool, size, small):
    """The disk for a size, by the rules one after another."""
    can = [x for x in pool if not x[3] and 0 < size <= x[4] * SLOT_BYTES]
    fit = [x for x in can if x[5] >= size]
    zram = [x for x in fit if x[2]] if size < small else []
    if zram:
        return min(zram, key=lambda x: (x[5], x[1]))[0], "zram"
    best = [x for x in fit if not x[2]]
    rest = [x for x in can if not x[2]]
    if best:
        return min(best, key=lambda x: (x[5], x[1]))[0], "disk"
    return (min(rest, key=lambda x: (-x[5], x[1]))[0], "disk") if rest else (None, None)


def test_routing(frame):
    pool = [(1, 0, False, False, 64, 16 * SLOT_BYTES), (2, 1, False, False, 64, 32 * SLOT_BYTES), (3, 2, True, False, 64, 8 * SLOT_BYTES), (4, 3, False, True, 999, 99 * SLOT_BYTES)]
    sizes = [1, 2 * SLOT_BYTES, 17 * SLOT_BYTES, 33 * SLOT_BYTES, 0, None, 65 * SLOT_BYTES, 1 << 40]
    r = frame("req_id long, size long", list(enumerate(sizes)))
    got = {x.req_id: (x.disk_id, x.tier) for x in placement.route(r, frame(POOL, pool), 2 * SLOT_BYTES).collect()}
    assert got == {0: (3, "zram"), 1: (1, "disk"), 2: (2, "disk"), 3: (2, "disk"), 4: (None, None), 5: (None, None), 6: (None, None), 7: (None, None)}
    # Full disks stay in the pool: they are the last resort, and healthy.
    full = [(*x[:5], 0) for x in pool]
    assert [x.disk_id for x in placement.route(r, frame(POOL, full), 2 * SLOT_BYTES).orderBy("req_id").collect()] == [1, 1, 1, 1, None, None, None, None]
    assert all(x.disk_id is None for x in placement.route(r, frame(POOL, []), 2 * SLOT_BYTES).collect())
    assert tuple(placement.bonnie(frame(POOL, pool), 100 * SLOT_BYTES).first()) == (17, 1 << 17)
    assert tuple(placement.bonnie(frame(POOL, pool), 5 * SLOT_BYTES).first()) == (14, 1 << 14) and tuple(placement.bonnie(frame(POOL, pool), 0).first()) == (17, 1 << 17)
    assert tuple(placement.bonnie(frame(POOL, [])).first()) == (0, 1)
    assert [placement.health(frame(POOL, p)).first()[0] for p in (pool, pool[:3], full[:3], [])] == [False, True, True, False]
    assert placement.health(frame(POOL, pool[:3]), degraded=True).first()[0] is False


def test_routing_against_the_rules(frame):
    rng = random.Random(4)
    for _ in range(3):
        pool = [(d, p, rng.random() < 0.3, rng.random() < 0.1, s := rng.randrange(0, 40), SLOT_BYTES * rng.randrange(0, s + 1)) for p, d in enumerate(rng.sample(range(99), 12))]
        sizes = [rng.randrange(1, 45 * SLOT_BYTES) for _ in range(150)] + [k * SLOT_BYTES + j for k in range(1, 40) for j in (0, 1)]
        got = {x.req_id: (x.disk_id, x.tier) for x in placement.route(frame("req_id long, size long", list(enumerate(sizes))), frame(POOL, pool), 9 * SLOT_BYTES).collect()}
        assert got == {k: routed(pool, n, 9 * SLOT_BYTES) for k, n in enumerate(sizes)}


def test_gate(frame):
    def one_by_one(requests, taken):
        held, out = set(taken), set()
        for seq, fid, alias in sorted(requests):
            keys = {k for k in (fid, alias or None) if k is not None}
            if keys and not keys & held:
                held |= keys
                out.add(seq)
        return out

    schema = "seq long, fid long, alias_for long"
    a = [(1, 1, None), (2, 2, 1), (3, 2, 0)]
    assert {r.seq for r in writes.gate(frame(schema, a), frame("fid long", [])).where("granted").collect()} == {1, 3} == one_by_one(a, [])
    rng = random.Random(9)
    many = [(k, rng.choice([None, 7, *range(60)]), rng.choice([None, 0, 7, *range(60)])) for k in range(200)] + [(200 + k, 100 + k, 101 + k) for k in range(40)]
    for in_order in (0, 10_000):
        got = writes.gate(frame(schema, many), frame("fid long", [(3,), (None,), (3,)]), in_order)
        assert {r.seq for r in got.where("granted").collect()} == one_by_one(many, [3]) and got.count() == len(many)
    assert writes.gate(frame(schema, []), frame("fid long", [])).count() == 0


def fold(requests, slots):
    taken, known, out = [], set(), {}
    for seq, fid, size in sorted(requests):
        need = -(-size // SLOT_BYTES)
        if fid in known:
            out[seq] = "duplicate"
            continue
        if not 0 < need <= slots:
            out[seq] = "empty" if need == 0 else "too_large"
            continue
        a = (fid & (2**64 - 1)) % (slots - need + 1)
        if any(x <= a + need - 1 and a <= y for x, y in taken):
            out[seq] = "extent"
        else:
            taken.append((a, a + need - 1))
            known.add(fid)
            out[seq] = "ok"
    return out


def test_placement_in_order(frame):
    rng = random.Random(11)
    for slots in (60, 400):
        req = [(k, rng.getrandbits(64) - 2**63 if rng.random() < 0.9 else 5, rng.randrange(0, 4 * SLOT_BYTES)) for k in range(80)]
        got = placement.place_in_order(frame("seq long, fid long, size long", req), slots)
        assert {r.seq: r.status for r in got.collect()} == fold(req, slots)
    assert placement.place_in_order(frame("seq long, fid long, size long", []), 10).count() == 0


def test_jumps_in_order(frame):
    """Against the same puts one after another; jump fids are the payload's numbers, one after another."""
    rng = random.Random(6)

    def of(payload, n):
        return F.slice(F.from_json(payload.cast("string"), "array<long>"), 1, n)

    req, taken = [], [(0, 1, 3), (1, 0, 0), (0, None, None)]
    for k in range(120):
        disk, fid, size = rng.randrange(2), rng.randrange(10**6), rng.randrange(1, 3 * SLOT_BYTES)
        if k % 9 == 8:
            disk, _, _, fid, size, jumps = req[rng.randrange(len(req))]
        else:
            jumps = str([rng.choice([req[rng.randrange(len(req))][3]] if req and rng.random() < 0.2 else [rng.randrange(10**6)]) for _ in range(20)]).encode()
        req.append((disk, 90, k, fid, size, jumps))
    out, state = {}, {d: (set(), [(a, b) for e, a, b in taken if e == d and a is not None]) for d in (0, 1)}
    for disk, slots, seq, fid, size, jumps in req:
        fids, ext = state[disk]
        if fid in fids:
            out[seq] = ("duplicate", 0, fid)
            continue
        out[seq] = ("jump_exhausted", 20, fid)
        for j, f in enumerate([fid, *__import__("json").loads(jumps)]):
            need = -(-(size + (j > 0)) // SLOT_BYTES)
            a = f % (slots - need + 1)
            if (j and f in fids) or any(x <= a + need - 1 and a <= y for x, y in ext):
                continue
            ext.append((a, a + need - 1))
            fids |= {fid, f}
            out[seq] = ("ok", j, f)
            break
    got = placement.put_in_order(frame("disk_id long, slots long, seq long, fid long, size long, payload binary", req), frame("disk_id long, start long, end long", taken), 20, of)
    assert {r.seq: (r.status, r.jumps_taken, r.target_fid) for r in got.collect()} == out
    assert {s for s, *_ in out.values()} == {"ok", "duplicate", "jump_exhausted"} and max(j for s, j, _ in out.values() if s == "ok") > 10


def test_extent_states(frame):
    ext = frame("disk_id long, fid long, start long, end long", [(1, k, 4 * k, 4 * k + 1) for k in range(4)])
    ev = frame("disk_id long, fid long, seq long, event string", [(1, 0, 1, "confirm"), (1, 0, 2, "release"), (1, 1, 1, "release"), (1, 2, 1, "open"), (9, 3, 1, "confirm"), (1, 1, None, None)])
    s = placement.transitions(ext, ev)
    assert {r.fid: r.state for r in s.collect()} == {0: "confirmed", 1: "released", 2: "pending", 3: "pending"}
    live = [(0, 1), (8, 9), (12, 13)]
    assert placement.current_chd(frame("disk_id long, slots long", [(1, 64)]), s).first().chd == chd_brute(1, 64, live)
    for block in (3, 1 << 20):
        r = {(x.start, x.end) for x in placement.occupied_runs(frame("disk_id long, start long, end long", [(1, 0, 4), (1, 2, 9), (1, 10, 10), (1, 12, 12), (1, None, None)]), block).collect()}
        assert {k for a, b in r for k in range(a, b + 1)} == {*range(11), 12} and sum(b - a + 1 for a, b in r) == 12


def test_histogram(frame):
    cases = {1: [4096, 5000, 6000], 2: [1024, 2048, 4096, 8192], 3: [4096, 5000, 6000, 7000, 8192, 1 << 20, 2 << 20], 4: [0, None]}
    df = frame("disk_id long, size long", [(d, s) for d, v in cases.items() for s in v])
    assert {r.disk_id: r.threshold for r in trim.fragmentation_threshold(df, ["disk_id"]).collect()} == {1: 8192, 2: 2048, 3: 8192}
    h = [tuple(r) for r in trim.histogram(df, ["disk_id"]).where("disk_id = 2").orderBy("pow").collect()]
    assert h[0] == (2, 0, 2, 0, 4) and h[10:] == [(2, 10, 2048, 1, 4), (2, 11, 4096, 1, 3), (2, 12, 8192, 1, 2), (2, 13, 16384, 1, 1)]


def test_batch_and_containers(frame):
    data = [(1, k, 100 + k, n, bytes([k]) * n) for k, n in enumerate([5, 3, 4, 9, 1])] + [(2, 1, 7, 50, b"x" * 50), (2, 2, 8, 1, b"y")]
    df = frame("disk_id long, seq long, fid long, size long, payload binary", data)
    b = trim.batch(df, 12, ["disk_id"], block=2)
    assert {(r.disk_id, r.seq, r.byte_offset) for r in b.collect()} == {(1, 0, 0), (1, 1, 5), (1, 2, 8), (2, 1, 0)}
    c = {r.disk_id: r for r in trim.containers(b, ["disk_id"]).collect()}
    assert bytes(c[1].payload) == b"\0" * 5 + b"\1" * 3 + b"\2" * 4 and c[1].container_size == 12
    assert [tuple(e) for e in c[1].entries] == [(100, 0, 5), (101, 5, 3), (102, 8, 4)]
    e = frame("disk_id long, fid long, size long, digest string", [(1, 1, 5, "a"), (1, 2, 5, "a"), (1, 3, 5, "b")])
    w = frame("disk_id long, fid long, size long, digest string", [(1, 1, 5, "a"), (1, 2, 6, "a"), (1, 3, 5, "a"), (1, 4, 1, "z")])
    assert rows(trim.verify(e, w)) == [(1, 2, "size"), (1, 3, "content"), (1, 4, "missing")]


def test_ranges(frame):
    obj = frame("fid long, payload binary", [(1, b"abcdefghij"), (1, b"abcdefghij")])
    asked = [(0, 1, 2, 5), (1, 1, 2, 0), (2, 1, 10, 10), (3, 1, 11, 0), (4, 1, 5, 2), (5, 9, 0, 0), (6, 1, None, None), (7, 1, 0, 99)]
    got = {r.req_id: (r.status, None if r.data is None else bytes(r.data)) for r in reads.get(frame("req_id long, fid long, range_start long, range_end long", asked), obj).collect()}
    assert got == {0: ("ok", b"cde"), 1: ("ok", b"cdefghij"), 2: ("ok", b""), 3: ("invalid_argument", None), 4: ("invalid_argument", None), 5: ("not_found", None), 6: ("ok", b"abcdefghij"), 7: ("ok", b"abcdefghij")}
    m = reads.messages(frame("req_id long, status string, start long, end long", [(1, "ok", 3, 10), (2, "ok", 5, 5), (3, "not_found", 0, 9)]), 4)
    assert rows(m) == [(1, 0, 3, 7), (1, 1, 7, 10), (2, 0, 5, 5)]


def test_alias_and_packed_reads(frame):
    refs = [(1, 50, 50, 4, 4, 0, False), (1, 60, 50, 4, 3, 0, False), (1, 70, 99, 8, 3, 2, True), (1, 80, 98, 1, 1, 0, False), (1, 90, 99, 8, 9, 2, True)]
    obj = frame("fid long, payload binary", [(50, b"abc\x01"), (99, b"01234567")])
    got = {r.fid: None if r.data is None else bytes(r.data) for r in reads.resolve(frame("disk_id long, fid long, target_fid long, stored_size long, size long, byte_offset long, packed boolean", refs), obj).collect()}
    assert got == {50: b"abc\x01", 60: b"abc", 70: b"234", 80: None, 90: None}
    parts = frame("id long, k long, d binary", [(1, 2, b"c"), (1, 0, b"a"), (1, 1, None)])
    assert bytes(reads.joined(parts, ["id"], "k", "d").first().data) == b"ac"
    v = reads.verify_content(frame("fid long, payload binary", [(50, b"abc\x01"), (99, b"0"), (1, b""), (98, b"q")]), obj)
    assert rows(v) == [(1, "not_found"), (50, "ok"), (98, "not_found"), (99, "size")]


def test_admission(frame):
    puts = [(1, 5, 10, None), (2, 5, 10, 0), (2, 5, 10, 0), (3, 6, 0, None), (4, 6, 5, None), (5, 7, 5, 7), (6, 8, 1, 9), (7, 9, 300 << 20, None), (8, None, 5, None), (9, 20, 5, None), (None, 1, 1, None)]
    got = writes.admit(frame("seq long, fid long, total_size long, alias_for long", puts), frame("fid long", [(20,), (20,), (None,)]))
    assert {r.seq: r.status for r in got.collect()} == {
        1: "ok", 2: "already_exists", 3: "invalid_argument:empty", 4: "ok", 5: "invalid_argument:self_alias", 6: "invalid_argument:alias_too_small", 7: "invalid_argument:too_large", 8: "invalid_argument:no_fid", 9: "already_exists",
    }
    g = writes.gate(frame("seq long, fid long, alias_for long", [(1, 1, None), (2, 2, 1), (3, 3, 4), (4, 4, 0), (5, 9, None)]), frame("fid long", [(9,)]))
    assert {r.seq: r.granted for r in g.collect()} == {1: True, 2: False, 3: True, 4: False, 5: False}
    s = frame("size long", [(16 << 20,), ((16 << 20) + 1,), (None,)])
    assert [r[0] for r in s.select(writes.path_of(F.col("size"))).collect()] == ["atomic", "cdc", "atomic"]
    with pytest.raises(ValueError):
        writes.path_of(F.col("size"), cdc=True, atomic=True)


def test_stream_faults(frame):
    parts = [(1, 0, 5), (1, 1, 5), (1, 1, 5), (2, 0, 5), (2, 2, 5), (3, 0, 5), (4, 0, 50)]
    got = writes.stream_faults(frame("id long, idx long, size long", parts), frame("id long, total long", [(1, 10), (2, 10), (3, 9), (4, 9), (5, 1)]))
    assert {r.id: r.fault for r in got.collect()} == {1: None, 2: "gap", 3: "short", 4: "long", 5: "short"}


def test_chunker(frame):
    data = np.random.default_rng(42).integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    sizes = chunking.cut_sizes(data, 512, 2048, 8192)
    assert sum(sizes) == len(data) and sizes == chunking.cut_sizes(data, 512, 2048, 8192)
    assert all(512 <= s <= 8192 for s in sizes[:-1]) and 800 < len(data) / len(sizes) < 5000
    gear = chunking.gear_table()
    h, want = 0, []
    for b in data[:500]:
        h = ((h << 1) + int(gear[b])) & (2**64 - 1)
        want.append(h)
    assert chunking.gear_hashes(np.frombuffer(data[:500], dtype=np.uint8)).tolist() == want
    ends = lambda d: {bytes(x) for x in np.split(np.frombuffer(d, dtype=np.uint8), np.cumsum(chunking.cut_sizes(d, 512, 2048, 8192))[:-1])}
    lost = ends(data) - ends(b"an inserted prefix" + data)
    assert len(lost) <= 2
    c = chunking.chunk(frame("file_id long, payload binary", [(1, data), (2, b""), (3, None), (4, b"x")]), 512, 2048, 8192)
    parts = sorted(c.collect(), key=lambda r: (r.file_id, r.idx))
    assert b"".join(bytes(r.payload) for r in parts if r.file_id == 1) == data and {r.file_id for r in parts} == {1, 4}
    assert chunking.contiguity_faults(c).count() == 0
    with pytest.raises(ValueError):
        chunking.cut_sizes(b"x", 5, 4, 6)
    m = chunking.manifests(c)
    assert m.where("file_id = 1").first().total_size == len(data)
    touched = chunking.sparse_range(m, frame("req_id long, file_id long, range_start long, range_end long", [(7, 1, 1000, 99_999), (8, 1, 5, 5), (9, 1, 0, 0), (10, 1, 9, 2)]))
    got = {r.req_id: (bytes(r.data), r.missing) for r in chunking.read_sparse(touched, c).collect()}
    assert got == {7: (data[1000:99_999], 0), 9: (data, 0)}
    lost = chunking.read_sparse(touched.where("req_id = 9"), c.where("idx != 1")).first()
    assert lost.missing == 1
    assert tuple(chunking.dedup_ratio(c.where("file_id = 1"), c).first())[2] == 1.0


def test_pools(frame):
    dev = frame("disk_id long, device_path string", [(1, "a"), (2, "b")])
    run = frame("disk_id long, device_path string", [(2, "c"), (3, "d"), (1, "a")])
    assert rows(catalog.merge_pool(dev, run)) == [(1, "a", False), (2, "c", True), (3, "d", True)]
    pool = frame("pool_pos int, disk_id long", [(1, 255), (0, 7)])
    assert catalog.select_device(pool).first().disk_id == 7 and catalog.select_device(pool, "0XfF").first().disk_id == 255
    assert catalog.select_device(pool, "0x1").count() == 0
    d = frame("device_path string, disk_id long, version int, size_bytes long, expected_id long", [("a", 1, 2, GRID_START + 1, 1), ("b", 2, None, 1, None), ("c", 3, 1, GRID_START + 1, None), ("d", 4, 2, GRID_START + 1, 5), ("e", 6, 2, GRID_START, None), ("f", 7, 2, GRID_START + 1, None), ("g", 7, 2, GRID_START + 1, None)])
    assert dict(map(tuple, catalog.device_faults(d).collect())) == {"a": None, "b": "no_header", "c": "version", "d": "id", "e": "too_small", "f": "duplicate_id", "g": "duplicate_id"}
    f = frame("disk_id long, path string, is_zst boolean", [(1, "r", False), (1, "z", True), (2, "r2", False)])
    assert {r.path for r in catalog.newest_snapshots(f).collect()} == {"z", "r2"}
    s = "disk_id long, is_zst boolean, size_bytes long, version int, header_id long, meta_size long, meta_sha256 string, sha256 string"
    ok = GRID_START + SLOT_BYTES
    snaps = [(1, True, ok, 2, 1, ok, "a", "a"), (2, True, ok, 2, 2, None, None, "a"), (3, False, ok, 2, 3, None, None, "a"), (4, False, ok, 2, 4, ok, "b", "a"), (5, False, ok + 1, 2, 5, None, None, "a"), (6, False, 5, 2, 6, None, None, "a"), (7, False, ok, 2, 8, None, None, "a"), (8, True, ok, 2, 8, 1, "a", "a")]
    assert dict(map(tuple, catalog.snapshot_faults(frame(s, snaps)).collect())) == {1: None, 2: "no_meta", 3: None, 4: "checksum", 5: "alignment", 6: "small", 7: "header", 8: "length"}
    out = catalog.restore_pool(frame("disk_id long", [(1,), (2,), (3,)]), frame("disk_id long, device_path string", [(1, "live1")]), frame("disk_id long, path string", [(1, "s1"), (2, "s2"), (5, "s5")]), frame("disk_id long, device_path string", [(5, "o5"), (6, "o6")]))
    assert {r.disk_id: r.source for r in out.collect()} == {1: "live", 2: "snapshot", 3: "missing", 5: "conflict", 6: "ordinary"}


def test_trim_cycle(frame):
    from slotlake.functions.fid import content_fid, file_fid, nonce_fids
    from slotlake.operators import changefeed, indexlog

    data = {k: f"trim-small-object-payload-{k:04d}".encode() for k in range(105)}
    log = [(1, k + 1, content_fid(v), len(v), 0, "plain") for k, v in data.items()] + [(2, 1, 5, 10, 0, "plain")]
    log += [(1, 106, 77, 2**56 - 1, 1, "jump"), (1, 107, content_fid(b"alias\x01"), 6, 0, "plain"), (1, 108, 42, 5000, 0, "plain")]
    schema = "disk_id long, seq long, fid long, size long, jump_code int, kind string"
    packed = "table_fid long, disk_id long, container_fid long, container_size long, nonce long, entries array<struct<fid:long,byte_offset:long,size:long>>"
    payloads = frame("fid long, payload binary", [(content_fid(v), bytearray(v)) for v in data.values()] + [(content_fid(b"alias\x01"), bytearray(b"alias\x01"))])
    limits = frame("disk_id long, threshold long", [(1, 4096), (2, 4096)])
    df = frame(schema, log)
    rows_, tables, boxes = trim.cycle(df, frame(packed, []), limits, payloads)
    new = cut(df.drop("kind").unionByName(rows_))
    t = tables.drop("table")
    refs = cut(indexlog.replay_refs(new, t))
    objects = payloads.unionByName(boxes.select("fid", "payload"))
    got = {r.fid: None if r.data is None else bytes(r.data) for r in reads.resolve(refs, objects).collect()}
    assert all(got[content_fid(v)] == v for v in data.values()) and got[77] == b"alias"
    assert refs.where("packed").count() == 105 and 42 in got and 5 in got
    assert indexlog.validate_compacted(cut(indexlog.compact_entries(new))).count() == 0
    again, _, _ = trim.cycle(new, t, limits, payloads, least_files=10)
    assert again.count() == 0
    lost, _, _ = trim.cycle(df, frame(packed, []), limits, payloads.where(F.col("fid") != content_fid(data[3])))
    assert lost.count() == 0
    assert changefeed.latest_records(new).where("packed").count() == 1
    assert next(nonce_fids(b"abc"))[0] == content_fid(b"abc") and [len(p) for _, p in nonce_fids(b"abc", 3)] == [3, 11, 19]
    with pytest.raises(IsADirectoryError):
        file_fid("/tmp")
