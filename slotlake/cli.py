"""python -m slotlake.cli --store DIR put|get|head|manifest|compact|bonnie|health|blk ..."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import functions as F

from .config import load
from .functions.parse import parse_id, parse_range, parse_size
from .operators import catalog, indexlog, placement
from .session import local_session, ship_package
from .sources import images
from .store import NotFound, Store


def text(fid: int) -> str:
    return f"0x{fid & (2**64 - 1):016x}"


def images_verb(spark, a: argparse.Namespace) -> int:
    if a.action == "init":
        images.init_image(a.path[0], parse_id(a.disk_id), parse_size(a.size), a.note, a.force)
        return 0
    found = images.find_devices(spark, a.path)
    if a.action in ("find", "info"):
        for r in found.orderBy("device_path").collect():
            print(json.dumps(r.asDict() | {"disk_id": None if r["disk_id"] is None else f"0x{r['disk_id'] & (2**64 - 1):X}"}))
        if a.output:
            images.write_pool(found.where("status = 'match'").withColumn("pool_pos", F.lit(0)), a.output)
        return 0 if a.action == "find" or not found.where("status != 'match'").count() else 1
    found = found.where("status = 'match'")
    if a.disk_id and a.action != "index-restore":
        found = found.where(F.col("disk_id") == parse_id(a.disk_id))
    if a.action == "index-restore":
        return restore_verb(spark, a, found)
    log = images.read_index(found)
    if a.action == "packed-scrub":
        report = images.scrub_images(found, log)
        rows = report.orderBy("table_fid").collect()
        for r in rows:
            print(json.dumps(r.asDict() | {"disk_id": text(r["disk_id"]), "table_fid": text(r["table_fid"])}))
        bad = [r for r in rows if r["reason"]]
        if not bad or not a.fix:
            return 1 if bad else 0
        wrong = report.where("reason is not null").select("disk_id", "table_fid")
        kept = indexlog.without_tables(log, wrong)
        images.rewrite_index(spark, found.join(wrong.select("disk_id").distinct(), "disk_id", "left_semi"), kept.join(wrong.select("disk_id").distinct(), "disk_id", "left_semi"), a.output)
        return 0
    indexlog.backup(log.drop("kind") if a.action == "index-backup" else indexlog.compacted(log), a.output)
    return 0


def restore_verb(spark, a: argparse.Namespace, found) -> int:
    """Writes one disk's index from a backup; another disk's only with --force."""
    for r in found.collect():
        wanted = parse_id(a.disk_id) if a.disk_id else r["disk_id"]
        log = indexlog.restore(spark, a.input, wanted, r["disk_id"], a.force).orderBy("seq").select("fid", "size", "jump_code")
        images.write_index(r["device_path"], [(x["fid"], x["size"], x["jump_code"]) for x in log.toLocalIterator()])
    return 0


def zram_verb(spark, a: argparse.Namespace) -> int:
    """Snapshots of images: create an image, flush images to a folder, load what a folder has."""
    if a.action == "create":
        images.init_image(a.path[0], parse_id(a.disk_id), parse_size(a.size), "", a.force)
        return 0
    if a.action == "flush":
        for r in images.find_devices(spark, a.path).where("status = 'match'").collect():
            print(json.dumps({"device_path": r["device_path"], "written": images.write_snapshot(r["device_path"], a.dir, r["disk_id"])}))
        return 0
    files = images.read_snapshots(spark, a.dir)
    sound = catalog.newest_snapshots(files).join(catalog.snapshot_faults(catalog.newest_snapshots(files)), "disk_id")
    bad = 0
    for r in sound.collect():
        target = os.path.join(a.path[0], f"zram-0x{r['disk_id'] & (2**64 - 1):X}")
        if r["fault"] is None and not os.path.exists(target):
            images.restore_snapshot(r["path"], target)
        bad += r["fault"] is not None
        print(json.dumps({"path": r["path"], "fault": r["fault"]}))
    return 1 if bad else 0


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="slotlake")
    p.add_argument("--store", required=True)
    p.add_argument("--config")
    p.add_argument("--max-put")
    verbs = p.add_subparsers(dest="verb", required=True)
    put = verbs.add_parser("put")
    put.add_argument("path", help="a file, or - for standard input")
    put.add_argument("--cdc", action="store_true")
    put.add_argument("--atomic", action="store_true")
    put.add_argument("--alias")
    get = verbs.add_parser("get")
    get.add_argument("fid")
    get.add_argument("--range", default="0-")
    get.add_argument("-o", "--output")
    for v in ("head", "manifest"):
        verbs.add_parser(v).add_argument("fid")
    verbs.add_parser("compact")
    verbs.add_parser("bonnie")
    verbs.add_parser("health")
    blk = verbs.add_parser("blk", help="device images")
    blk.add_argument("action", choices=["find", "info", "index-backup", "index-restore", "index-compact", "packed-scrub", "init"])
    blk.add_argument("--path", action="append", default=[], help="an image; may be repeated")
    blk.add_argument("-o", "--output")
    blk.add_argument("--disk-id")
    blk.add_argument("--size")
    blk.add_argument("--note", default="")
    blk.add_argument("--force", action="store_true")
    blk.add_argument("--fix", action="store_true", help="packed-scrub: drop bad tables, after a backup to --output")
    blk.add_argument("--input", help="index-restore: a backup")
    zram = verbs.add_parser("zram", help="snapshots of images")
    zram.add_argument("action", choices=["create", "flush", "load"])
    zram.add_argument("--path", action="append", default=[], help="an image, or the folder to load into")
    zram.add_argument("--dir", help="the folder of the snapshots")
    zram.add_argument("--disk-id")
    zram.add_argument("--size")
    zram.add_argument("--force", action="store_true")
    up = verbs.add_parser("upload", help="store files whose content is not there yet")
    up.add_argument("paths", nargs="+")
    a = p.parse_args(argv)
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    store = Store(spark, a.store, load(a.config, max_put=a.max_put))
    try:
        if a.verb == "put":
            if a.path == "-":
                r = store.put_bytes(sys.stdin.buffer.read(), parse_id(a.alias) if a.alias else None)
            else:
                r = store.put_file(a.path, a.cdc, a.atomic)
            print(json.dumps({k: text(v) if k.endswith("fid") else v for k, v in r.items()}))
        elif a.verb == "get":
            data = store.get_auto(parse_id(a.fid), *parse_range(a.range))
            if a.output:
                with open(a.output, "wb") as f:
                    f.write(data)
            else:
                sys.stdout.buffer.write(data)
        elif a.verb == "head":
            print(json.dumps({"fid": text(parse_id(a.fid)), "size": store.head(parse_id(a.fid))}))
        elif a.verb == "manifest":
            m = store.inspect_manifest(parse_id(a.fid))
            m["full_content_hash"] = text(m["full_content_hash"])
            m["chunks"] = [{"index": k} | c | {"fid": text(c["fid"]), "target_fid": text(c["target_fid"])} for k, c in enumerate(m["chunks"])]
            print(json.dumps(m))
        elif a.verb == "compact":
            store.compact()
        elif a.verb == "upload":
            for path in a.paths:
                r = store.put_file(path)
                new = not r.get("is_duplicate", False) and r.get("uploaded", 1) > 0
                print(json.dumps({"path": path, "fid": text(r.get("fid", r.get("manifest_fid"))), "status": "uploaded" if new else "deduplicated"}))
        elif a.verb == "zram":
            return zram_verb(spark, a)
        elif a.verb == "blk":
            return images_verb(spark, a)
        else:
            pool = images.read_pool(spark, store.settings.pan_path).select("pool_pos", "device_path")
            found = images.find_devices(spark, [r["device_path"] for r in pool.collect()])
            disks = images.pool_state(found.join(pool, "device_path"), store.settings.chd_target_p)
            if a.verb == "bonnie":
                r = placement.bonnie(disks, store.settings.max_put).first()
                print(json.dumps({"ch_d_pow2": r["ch_d_pow2"], "bytes": r["bytes"]}))
            else:
                ok = placement.health(disks).first()["ok"]
                print(json.dumps({"ok": ok}))
                return 0 if ok else 1
    except NotFound as e:
        print(f"not found: {e}", file=sys.stderr)
        return 2
    except ValueError as e:
        print(str(e), file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
