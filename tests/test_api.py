import json

import numpy as np
import pytest

from slotlake import cli, config
from slotlake.functions import codecs
from slotlake.functions.fid import content_fid
from slotlake.operators import changefeed
from slotlake.sources import images
from slotlake.store import NotFound, Store
from slotlake.types import GRID_START, JUMP_SENTINEL


def test_settings(tmp_path):
    f = tmp_path / "s.toml"
    f.write_text('pan_path = "/p.json"\nmax_put = "128MB"\nsmall_file_pow2 = 8\ntrim_interval = "1h30m"\ntrim_min_threshold_bytes = "8KB"\ntrim_max_threshold_bytes = "64MB"\nchd_target_p = 0.25\nzram_snapshot_dir = "~/x"\ngrpc_listen = " "\nunknown = 1\n')
    s = config.load(str(f), chd_target_p=0.5, max_put="1GB")
    assert (s.pan_path, s.max_put, s.small_file_pow2, s.trim_interval_seconds, s.trim_min_threshold_bytes, s.chd_target_p, s.grpc_listen) == ("/p.json", 1 << 30, 8, 5400, 8192, 0.5, ":9090")
    assert not s.zram_snapshot_dir.startswith("~") and config.load().trim_interval_seconds == 900
    bad = ["small_file_pow2 = -1", "reservation_stall_timeout_ms = 0", "pool_gate_fanout_timeout_ms = -5", "write_dispatch_concurrency = 0", "chd_target_p = 0", "chd_target_p = 1.5", "trim_interval_seconds = 0", 'trim_min_threshold_bytes = "64MB"\ntrim_max_threshold_bytes = "4KB"', "trim_min_file_count = -1", "trim_threshold_ratio = 2.0", 'trim_interval = "x"', 'max_put = "lots"']
    for text in bad:
        f.write_text(text)
        with pytest.raises(ValueError):
            config.load(str(f))


def test_pool_and_images(spark, tmp_path):
    a, b, c = (str(tmp_path / n) for n in "abc")
    images.init_image(a, -2, GRID_START + 8192, "first")
    images.init_image(b, 7, GRID_START + 4096)
    (tmp_path / "c").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        images.init_image(a, 5, GRID_START + 8192)
    with pytest.raises(ValueError):
        images.init_image(str(tmp_path / "z"), 5, GRID_START)
    found = images.find_devices(spark, [a, b, c, str(tmp_path / "gone")])
    assert {(r.device_path[-1], r.status, r.disk_id, r.note) for r in found.collect()} == {("a", "match", -2, "first"), ("b", "match", 7, ""), ("c", "no_header", None, None), ("e", "error", None, None)}
    entries = [(0xAAA, 4096, 0), (0x10000000000, 1 << 48, 0), (0xBBB, JUMP_SENTINEL, 1), (0xCCC, 10, 0), (0xAAA, 0, 0)]
    images.write_index(a, entries)
    log = images.read_index(found)
    assert sorted((r.seq, r.fid, r.size, r.jump_code) for r in log.collect()) == [(k + 1, *e) for k, e in enumerate(entries)]
    assert {r.fid for r in changefeed.latest_records(log).collect()} == {0x10000000000, 0xBBB}
    pool = spark.createDataFrame([(1, 7, b, "match", 2, 5), (0, -2, a, "match", 2, 6)], "pool_pos int, disk_id long, device_path string, status string, version int, size_bytes long")
    images.write_pool(pool, str(tmp_path / "pan.json"))
    assert json.loads((tmp_path / "pan.json").read_text())["devices"][0]["disk_id"] == "0xFFFFFFFFFFFFFFFE"
    assert {tuple(r) for r in images.read_pool(spark, str(tmp_path / "pan.json")).collect()} == {tuple(r) for r in pool.collect()}


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path), cdc=(512, 2048, 8192))
    assert s.objects().count() == 0
    one = s.put_bytes(b"abc\x01", alias_for=60)
    assert one == {"fid": content_fid(b"abc\x01"), "target_fid": content_fid(b"abc\x01"), "jumps_taken": 0, "is_duplicate": False}
    assert s.get(60) == b"abc" and s.get(one["fid"]) == b"abc\x01" and s.head(60) == 3
    assert s.put_bytes(b"abc\x01")["is_duplicate"]
    assert s.put_bytes(b"other\x01", alias_for=60)["is_duplicate"]
    for bad in (b"",):
        with pytest.raises(ValueError):
            s.put_bytes(bad)
    with pytest.raises(NotFound):
        s.get(12345)
    with pytest.raises(ValueError):
        s.get(one["fid"], 3, 2)
    batch = spark.createDataFrame([(1, bytearray(b"x"), None), (2, bytearray(b"x"), None), (3, None, None)], "seq long, payload binary, alias_for long")
    assert {r.seq: r.status for r in s.put(batch).collect()} == {1: "ok", 2: "already_exists", 3: "invalid_argument:no_fid"}
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    r = s.put_cdc(data, "f.bin")
    assert r["uploaded"] == r["chunks"] > 5 and s.get_auto(r["manifest_fid"]) == data
    assert s.get_auto(r["manifest_fid"], 2000, 7000) == data[2000:7000] and s.get_cdc(r["manifest_fid"], 9, 9) == b""
    again = s.put_cdc(b"prefix" + data, "g.bin")
    assert again["deduplicated"] >= again["chunks"] - 2
    assert s.inspect_manifest(r["manifest_fid"])["filename"] == "f.bin"
    v = spark.createDataFrame([(one["fid"], bytearray(b"abc\x01")), (9, bytearray(b"q"))], "fid long, payload binary")
    assert dict(map(tuple, s.verify(v).collect())) == {one["fid"]: "ok", 9: "not_found"}
    n = s.objects().count()
    s.compact()
    assert s.objects().count() == n and len(s._batches()) == 1 and s.get_auto(r["manifest_fid"], 5, 50) == data[5:50]


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "f"
    f.write_bytes(b"A" * 1024 + b"B" * 1024)
    base = ["--store", str(tmp_path / "s")]
    assert cli.main([*base, "put", str(f)]) == 0
    fid = json.loads(capsys.readouterr().out)["fid"]
    assert fid == f"0x{content_fid(f.read_bytes()) & (2**64 - 1):016x}"
    assert cli.main([*base, "get", fid, "--range", "512-1536", "-o", str(tmp_path / "o")]) == 0 and (tmp_path / "o").read_bytes() == b"A" * 512 + b"B" * 512
    assert cli.main([*base, "head", fid]) == 0 and json.loads(capsys.readouterr().out) == {"fid": fid, "size": 2048}
    assert cli.main([*base, "put", "--cdc", str(f)]) == 0
    m = json.loads(capsys.readouterr().out)
    assert cli.main([*base, "manifest", m["manifest_fid"]]) == 0 and json.loads(capsys.readouterr().out)["chunks"][0]["index"] == 0
    assert cli.main([*base, "head", "0x1"]) == 2 and cli.main([*base, "manifest", fid]) == 1
    assert codecs.MANIFEST_MAGIC


def test_snapshots(spark, tmp_path):
    from slotlake.operators import catalog

    image, folder = str(tmp_path / "zram0"), str(tmp_path / "snaps")
    images.init_image(image, 9, GRID_START + 4096)
    assert images.write_snapshot(image, folder, 9) and not images.write_snapshot(image, folder, 9)
    (tmp_path / "snaps" / "note.tmp").write_text("x")
    (tmp_path / "snaps" / "readme").write_text("x")
    s = images.read_snapshots(spark, folder)
    assert [(r.disk_id, r.fault) for r in catalog.snapshot_faults(s).collect()] == [(9, None)]
    images.restore_snapshot(s.first().path, str(tmp_path / "back"))
    assert images._unpacked(str(tmp_path / "back")) == images._unpacked(image)
    with pytest.raises(FileExistsError):
        images.restore_snapshot(s.first().path, image)
    assert images.read_snapshots(spark, str(tmp_path / "none")).count() == 0


def test_image_verbs(spark, tmp_path, capsys):
    a, pan = str(tmp_path / "a"), str(tmp_path / "pan.json")
    base = ["--store", str(tmp_path / "s")]
    assert cli.main([*base, "blk", "init", "--path", a, "--disk-id", "0x10", "--size", str(GRID_START + (8 << 20))]) == 0
    assert cli.main([*base, "blk", "init", "--path", a, "--disk-id", "0x10", "--size", str(GRID_START + (8 << 20))]) == 1
    assert cli.main([*base, "blk", "find", "--path", a, "-o", pan]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["disk_id"] == "0x10"
    (tmp_path / "c.toml").write_text(f'pan_path = "{pan}"')
    base += ["--config", str(tmp_path / "c.toml")]
    assert cli.main([*base, "bonnie"]) == 0 and json.loads(capsys.readouterr().out) == {"ch_d_pow2": 23, "bytes": 8 << 20}
    assert cli.main([*base, "health"]) == 0 and json.loads(capsys.readouterr().out) == {"ok": True}
    images.write_index(a, [(5, 8 << 20, 0), (6, 10, 0), (6, 0, 0)])
    assert cli.main([*base, "bonnie"]) == 0 and json.loads(capsys.readouterr().out)["ch_d_pow2"] == 0
    # A full disk is healthy; one whose log a strict replay refuses is not.
    assert cli.main([*base, "health"]) == 0
    images.write_index(a, [(5, 4096, 0), (5, 4096, 0)])
    assert cli.main([*base, "health"]) == 1
    assert cli.main([*base, "blk", "index-compact", "--path", a, "-o", str(tmp_path / "log")]) == 0
    assert [(r.seq, r.fid) for r in spark.read.parquet(str(tmp_path / "log")).collect()] == [(1, 5)]
