"""Images on disk through the command line, scrubbing, and periodic jobs."""

import json
import time

from slotlake import cli
from slotlake.functions import codecs
from slotlake.functions.fid import content_fid
from slotlake.operators import changefeed
from slotlake.sources import images
from slotlake.streaming import jobs
from slotlake.types import ANCHOR_CODE, GRID_START, PACKED_SENTINEL, SLOT_BYTES


def run(capsys, *argv):
    code = cli.main(["--store", "/tmp/none", *argv])
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def image(path, disk=5):
    """An image with two objects, a sound packed table and one whose bytes are gone."""
    images.init_image(str(path), disk, GRID_START + 64 * SLOT_BYTES)
    good = codecs.encode_packed(disk, 77, 10, [(1, 0, 4), (2, 4, 6)])
    lost = codecs.encode_packed(disk, 78, 10, [(3, 0, 4)])
    images.write_object(str(path), content_fid(good), good)
    rows = [(100, 5, 0), (101, 9, 0)]
    for t in (good, lost):
        f = content_fid(t)
        rows += [(f, len(t), 0), (f, PACKED_SENTINEL, ANCHOR_CODE), (f, len(t), 0)]
    images.write_index(str(path), rows)
    return content_fid(good), content_fid(lost)


def test_scrub_finds_and_drops_bad_tables(spark, tmp_path, capsys):
    p = tmp_path / "sda"
    good, lost = image(p)
    code, rows = run(capsys, "blk", "packed-scrub", "--path", str(p))
    by = {int(r["table_fid"], 16): r for r in rows}
    assert code == 1 and by[good & (2**64 - 1)]["reason"] is None and by[lost & (2**64 - 1)]["reason"] == "magic" and by[lost & (2**64 - 1)]["zero_filled"]
    code, _ = run(capsys, "blk", "packed-scrub", "--path", str(p), "--fix", "-o", str(tmp_path / "before"))
    assert code == 0
    devices = images.find_devices(spark, [str(tmp_path)])
    left = {r.fid: r.packed for r in changefeed.latest_records(images.read_index(devices)).collect()}
    assert left == {100: False, 101: False, good: True}
    assert run(capsys, "blk", "packed-scrub", "--path", str(p))[0] == 0
    # The backup brings the old index back; a backup of another disk needs force.
    assert run(capsys, "blk", "index-restore", "--path", str(p), "--input", str(tmp_path / "before"))[0] == 0
    assert lost in {r.fid for r in changefeed.latest_records(images.read_index(devices)).collect()}
    q = tmp_path / "vdb"
    images.init_image(str(q), 6, GRID_START + 64 * SLOT_BYTES)
    assert run(capsys, "blk", "index-restore", "--path", str(q), "--input", str(tmp_path / "before"), "--disk-id", "5")[0] == 1
    assert run(capsys, "blk", "index-restore", "--path", str(q), "--input", str(tmp_path / "before"), "--disk-id", "5", "--force")[0] == 0
    assert images.read_index(images.find_devices(spark, [str(q)])).count() == 8


def test_folders_are_searched_and_full_state(spark, tmp_path):
    image(tmp_path / "sdb", 1)
    image(tmp_path / "zram0", 2)
    (tmp_path / "notes.txt").write_text("x")
    (tmp_path / "extra1").write_text("x")
    found = images.find_devices(spark, [str(tmp_path)], include=("extra",))
    assert {(r.device_path.rsplit("/", 1)[1], r.status) for r in found.collect()} == {("sdb", "match"), ("zram0", "match"), ("extra1", "no_header")}
    state = {r.disk_id: r for r in images.pool_state(found).collect()}
    assert [state[d].pool_pos for d in (1, 2)] == [0, 1] and state[2].is_zram and state[1].slots == 64 and not state[1].faulted
    images.write_index(str(tmp_path / "sdb"), [(7, 5, 0), (7, 6, 0)])
    assert {r.disk_id: r.faulted for r in images.pool_state(found).collect()} == {1: True, 2: False}


def test_snapshot_verbs(tmp_path, capsys):
    p, folder, back = tmp_path / "zram1", tmp_path / "snaps", tmp_path / "back"
    back.mkdir()
    assert run(capsys, "zram", "create", "--path", str(p), "--disk-id", "9", "--size", str(GRID_START + 4 * SLOT_BYTES))[0] == 0
    assert run(capsys, "zram", "flush", "--path", str(p), "--dir", str(folder))[1][0]["written"] is True
    assert run(capsys, "zram", "flush", "--path", str(p), "--dir", str(folder))[1][0]["written"] is False
    assert run(capsys, "zram", "load", "--dir", str(folder), "--path", str(back)) == (0, [{"path": str(folder / "0x9.zst"), "fault": None}])
    assert (back / "zram-0x9").read_bytes()[:5000] == p.read_bytes()[:5000]


def test_jobs(spark, frame):
    ran = []
    q = jobs.every(spark, 0.2, ran.append)
    began = time.time()
    while len(ran) < 2 and time.time() - began < 60:
        time.sleep(0.2)
    q.stop()
    assert len(ran) >= 2
    done, failed = [], []

    def trim(disk):
        if disk == 2:
            raise ValueError("no room")
        done.append(disk)

    disks = frame("disk_id long, slots long, faulted boolean", [(1, 5, False), (2, 5, False), (3, 5, True), (4, 0, False), (5, 1, False)])
    jobs.trim_job(lambda: disks, trim, lambda d, e: failed.append((d, str(e))))(0)
    assert done == [1, 5] and failed == [(2, "no room")]


def test_two_writers(spark, frame, tmp_path):
    from slotlake.store import Store

    a, b = Store(spark, str(tmp_path / "s")), Store(spark, str(tmp_path / "s"))
    a.put_bytes(b"first")
    rows = frame("seq long, payload binary, alias_for long", [(0, b"same", None), (1, b"first", None)])
    inner, raced = a._commit, []

    def commit(df, seen):
        if not raced:
            raced.append(b.put_bytes(b"same")["is_duplicate"])
        return inner(df, seen)

    a._commit = commit
    got = {r.seq: r.status for r in a.put(rows).collect()}
    assert raced == [False] and got == {0: "already_exists", 1: "already_exists"}
    assert a.objects().count() == 2
    b.compact()
    assert a.objects().count() == 2 and len(a._batches()) == 1
