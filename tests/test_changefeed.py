import random

import pytest
from conftest import rows

from slotlake.operators import changefeed, indexlog
from slotlake.types import JUMP_SENTINEL, PACKED_SENTINEL

SCHEMA = "disk_id long, seq long, fid long, size long, jump_code int, kind string"


def replay(entries):
    """Brute force: one disk's entries in seq order -> {fid: seq of the record}."""
    out, pending = {}, None
    for seq, fid, size, code in sorted(entries):
        if fid == size == code == 0:
            break
        ind = (code != 0 and size == JUMP_SENTINEL) or (code == 255 and size == PACKED_SENTINEL)
        if pending is not None:
            if code == 0 and size != 0:
                out[pending[1]] = pending[0]
            pending = None
        elif ind:
            pending = (seq, fid)
        elif code == 0 and size == 0:
            out.pop(fid, None)
        elif code == 0:
            out[fid] = seq
    return out


def random_log(rng, n, gaps=False):
    entries, seq = [], 0
    for _ in range(n):
        seq += 1 + (gaps and rng.random() < 0.1)
        kind = rng.choice(["p", "p", "t", "j", "a", "s"] if rng.random() < 0.5 else ["p", "j", "j"])
        fid = rng.randrange(1, 9)
        size, code = {"p": (rng.randrange(1, 99), 0), "t": (0, 0), "j": (JUMP_SENTINEL, rng.randrange(1, 255)), "a": (PACKED_SENTINEL, 255), "s": (5, 3)}[kind]
        entries.append((seq, fid, size, code))
    if rng.random() < 0.3:
        entries.insert(rng.randrange(n), None)
        entries = [e if e else (0, 0, 0, 0) for e in entries]
        entries = [(k + 1, *e[1:]) for k, e in enumerate(entries)]
    return entries


@pytest.mark.parametrize("bits", [1, 2, 16])
def test_latest_records_match_brute_force(frame, bits):
    rng = random.Random(bits)
    log, want = [], set()
    for disk in range(40):
        entries = random_log(rng, rng.randrange(1, 40), gaps=disk % 2 == 0)
        want |= {(disk, f, s) for f, s in replay(entries).items()}
        log += [(disk, *e, None) for e in entries]
    log += rng.sample(log, len(log) // 5)
    rng.shuffle(log)
    got = changefeed.latest_records(frame(SCHEMA, log), block_bits=bits)
    assert {(r.disk_id, r.fid, r.seq) for r in got.collect()} == want
    assert got.count() == len(want)


def test_pairs(frame):
    log = [(1, 1, 7, JUMP_SENTINEL, 4, "jump"), (1, 2, 70, 100, 0, None), (1, 3, 8, PACKED_SENTINEL, 255, None), (1, 4, 8, 72, 0, "plain"), (1, 5, 9, JUMP_SENTINEL, 1, None)]
    got = {r.fid: r for r in changefeed.latest_records(frame(SCHEMA, log)).collect()}
    assert set(got) == {7, 8}
    assert (got[7].size, got[7].actual_fid, got[7].actual_size, got[7].jump_code, got[7].seq, got[7].jump) == (99, 70, 100, 4, 1, True)
    assert (got[8].size, got[8].packed, got[8].seq) == (72, True, 3)


def test_gaps_are_held(frame):
    log = frame(SCHEMA, [(1, 1, 5, 10, 0, None), (1, 2, 6, 10, 0, None), (1, 4, 7, 10, 0, None), (2, 2, 5, 10, 0, None), (3, 1, 0, 0, 0, None), (3, 2, 4, 4, 0, None)])
    assert {(r.disk_id, r.fid) for r in changefeed.latest_records(log, sealed=False).collect()} == {(1, 5), (1, 6)}
    assert rows(changefeed.watermarks(log)) == [(1, 3, 4, 2, 1, None), (2, 1, 2, 0, 1, None), (3, 2, 2, 2, 0, 1)]
    assert rows(changefeed.watermarks(log, block_bits=1)) == rows(changefeed.watermarks(log))


def test_nulls_empty_and_extra_columns(frame):
    assert changefeed.latest_records(frame(SCHEMA, [])).count() == 0
    assert changefeed.watermarks(frame(SCHEMA, [])).count() == 0
    log = [(None, 1, 5, 10, 0, None, 1), (1, None, 5, 10, 0, None, 1), (1, 1, 5, None, None, "jump", 2), (1, 2, None, 5, 0, None, 3), (1, 3, 6, None, 0, "tombstone", 3), (1, 4, 7, 3, None, "plain", 9)]
    got = changefeed.latest_records(frame(SCHEMA + ", block long", log))
    assert [(r.fid, r.seq) for r in got.collect()] == [(7, 4)]


def test_hot_block_repeats(frame):
    log = [(1, 1, 5, 10, 0, None)] * 500 + [(1, 2, 5, 20, 0, "plain")] * 500
    assert [(r.seq, r.size) for r in changefeed.latest_records(frame(SCHEMA, log)).collect()] == [(2, 20)]


def test_compaction_round_trip(frame):
    rng = random.Random(9)
    log = [(d, *e, None) for d in range(6) for e in random_log(rng, 30)]
    records = {(r.disk_id, r.fid, r.size, r.actual_fid, r.jump, r.packed) for r in changefeed.latest_records(frame(SCHEMA, log)).collect()}
    compacted = indexlog.compact_entries(frame(SCHEMA, log), block_bits=2)
    again = {(r.disk_id, r.fid, r.size, r.actual_fid, r.jump, r.packed) for r in changefeed.latest_records(compacted).collect()}
    assert again == records
    assert indexlog.validate_compacted(compacted).where("rule != 'duplicate_fid'").count() == 0
    assert indexlog.strict_violations(frame(SCHEMA, [])).count() == 0


def test_strict_rules(frame):
    log = frame(SCHEMA, [(1, 1, 5, 10, 0, None), (1, 2, 5, 11, 0, None), (2, 1, 4, JUMP_SENTINEL, 1, None), (2, 2, 9, 0, 0, None), (2, 3, 3, JUMP_SENTINEL, 1, None), (3, 1, 2, 7, 9, None)])
    got = {(r.rule, r.disk_id, r.seq) for r in indexlog.strict_violations(log).collect()}
    assert got == {("duplicate_fid", 1, 2), ("indicator_twice", 2, 3), ("dangling", 2, 3), ("stray_code", 3, 1)}


def test_replay_refs_with_packed(frame):
    log = frame(SCHEMA, [(1, 1, 5, 10, 0, None), (1, 2, 8, PACKED_SENTINEL, 255, None), (1, 3, 8, 72, 0, None), (1, 4, 7, JUMP_SENTINEL, 1, None), (1, 5, 70, 100, 0, None)])
    packed = frame("table_fid long, disk_id long, container_fid long, container_size long, nonce long, entries array<struct<fid:long,byte_offset:long,size:long>>", [(8, 1, 99, 50, 0, [(5, 0, 10), (6, 45, 10)])])
    got = {r.fid: r for r in indexlog.replay_refs(log, packed).collect()}
    assert got[5].packed and got[5].target_fid == 99 and 6 not in got
    assert (got[7].size, got[7].stored_size, got[7].target_fid) == (99, 100, 70) and got[70].size == 100
