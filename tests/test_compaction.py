import glob
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from slotlake.operators import compaction


def write_runs(folder, n, rows, seed=0, hot=None):
    rng = random.Random(seed)
    every = []
    for k in range(n):
        keys = sorted(hot if hot is not None and rng.random() < 0.4 else rng.randrange(-(10**6), 10**6) for _ in range(rows))
        vals = [f"{k}-{i}" for i in range(len(keys))]
        pq.write_table(pa.table({"k": pa.array(keys, pa.int64()), "v": vals}), f"{folder}/run{k:03d}.parquet", row_group_size=50)
        every += zip(keys, vals, strict=True)
    return sorted(glob.glob(f"{folder}/run*.parquet")), sorted(every)


@pytest.mark.parametrize("hot", [None, 7])
def test_consolidation(spark, tmp_path, hot, monkeypatch):
    src, dst = tmp_path / "s", str(tmp_path / "d")
    src.mkdir()
    paths, every = write_runs(src, 40, 200, hot=hot)
    ranges = compaction.consolidate_files(spark, paths, dst, "k", target_bytes=8_000, files_per_range=3).collect()
    assert len(ranges) < 30 and sum(r.rows for r in ranges) == len(every)
    got = compaction.read_consolidated(spark, dst)
    assert sorted(map(tuple, got.collect())) == every
    for r in ranges:
        keys = pq.read_table(r.path)["k"].to_pylist()
        assert keys == sorted(keys) and (keys[0], keys[-1], len(keys)) == (r.key_min, r.key_max, r.rows)
    order = sorted(ranges, key=lambda r: r.path.rsplit("/", 1)[1].split("-")[1] + r.path[-13:])
    assert all(a.key_max <= b.key_min for a, b in zip(order, order[1:], strict=False))
    part = compaction.read_consolidated(spark, dst, 0, 1000)
    assert {tuple(r) for r in part.where("k between 0 and 1000").collect()} == {x for x in every if 0 <= x[0] <= 1000}


def test_equal_keys_keep_run_order():
    t = lambda k, v: pa.table({"k": k, "v": v})
    out = pa.concat_tables(compaction.merge_runs([iter([t([1, 2, 2], ["a", "b", "c"]), t([2, 5], ["d", "e"])]), iter([t([2, 3], ["x", "y"])])], "k"))
    assert out["k"].to_pylist() == [1, 2, 2, 2, 2, 3, 5] and sorted(out["v"].to_pylist()) == list("abcdexy")


def test_refuses_unsorted_and_takes_nothing(spark, tmp_path):
    p = str(tmp_path / "a.parquet")
    pq.write_table(pa.table({"k": [5, 6, 1, 2]}), p, row_group_size=2)
    with pytest.raises(ValueError, match="not sorted"):
        compaction.consolidate_files(spark, [p], str(tmp_path / "o"), "k")
    pq.write_table(pa.table({"k": pa.array([], pa.int64())}), p)
    assert compaction.consolidate_files(spark, [p], str(tmp_path / "o"), "k").count() == 0
    assert compaction.consolidate_files(spark, [], str(tmp_path / "o"), "k").count() == 0


def test_cut_keys():
    assert compaction.cut_keys([], 10) == [] and compaction.cut_keys([(0, 9, 5)], 10) == []
    cuts = compaction.cut_keys([(0, 999, 100), (0, 999, 100), (500, 999, 200)], 100)
    assert len(cuts) == 3 and cuts == sorted(cuts) and all(0 < c < 1000 for c in cuts)


def test_sort_runs_refuses_null_keys(spark, frame, tmp_path):
    with pytest.raises(Exception, match="null keys in k"):
        compaction.sort_runs(frame("k long, v string", [(2, "a"), (None, "b")]), "k", str(tmp_path / "bad"))
    compaction.sort_runs(frame("k long, v string", [(2, "a"), (1, "b"), (2, "c")]), "k", str(tmp_path / "good"))
    paths = sorted(glob.glob(f"{tmp_path}/good/*.parquet"))
    compaction.consolidate_files(spark, paths, str(tmp_path / "out"), "k")
    assert sorted(map(tuple, compaction.read_consolidated(spark, str(tmp_path / "out")).collect())) == [(1, "b"), (2, "a"), (2, "c")]


def test_many_runs_need_few_open_files(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    paths, every = write_runs(src, 150, 20, seed=3)
    out = compaction.consolidate_files(spark, str(src), str(tmp_path / "d"), "k", target_bytes=8_000, files_per_range=3, fan_in=4)
    assert sum(r.rows for r in out.collect()) == len(every)
    assert sorted(map(tuple, compaction.read_consolidated(spark, str(tmp_path / "d")).collect())) == every


def test_hot_key_is_spread_and_order_inside_a_row_group_is_checked(spark, tmp_path):
    src = tmp_path / "s"
    src.mkdir()
    for k in range(12):
        pq.write_table(pa.table({"k": pa.array([1] + [5] * 500 + [9], pa.int64()), "v": [f"{k}-{i}" * 9 for i in range(502)]}), f"{src}/r{k:02d}.parquet")
    files = compaction.described(spark, str(src), "k").withColumn("grp", F.lit("all"))
    cuts = compaction.plan(files, 1, 20_000)
    spread, tasks = compaction.assigned(files, cuts)
    assert (5,) in cuts["all"][0] and max(cuts["all"][1].values()) > 3
    assert spread.where("part > 0").count() > 0
    compaction.consolidate_files(spark, str(src), str(tmp_path / "d"), "k", target_bytes=5_000)
    assert compaction.read_consolidated(spark, str(tmp_path / "d")).groupBy("k").count().where("k = 5").first()["count"] == 6000
    pq.write_table(pa.table({"k": pa.array([5, 900, 3, 7, 1], pa.int64())}), f"{src}/bad.parquet")
    with pytest.raises(ValueError, match="not sorted"):
        compaction.consolidate_files(spark, [f"{src}/bad.parquet"], str(tmp_path / "e"), "k")


def test_two_key_columns(spark, tmp_path):
    rng = random.Random(5)
    src = tmp_path / "s"
    src.mkdir()
    every = []
    for n in range(9):
        rows = sorted((rng.choice([-3, 2**62, 7]), rng.getrandbits(64) - 2**63) for _ in range(300))
        every += rows
        pq.write_table(pa.table({"a": pa.array([r[0] for r in rows], pa.int64()), "b": pa.array([r[1] for r in rows], pa.int64())}), f"{src}/r{n}.parquet")
    done = compaction.consolidate_files(spark, str(src), str(tmp_path / "d"), ["a", "b"], target_bytes=3_000, files_per_range=2).orderBy("low").collect()
    got = [tuple(r) for f in done for r in zip(*(pq.read_table(f.path)[c].to_pylist() for c in "ab"), strict=True)]
    assert got == sorted(every) and len(done) > 3
    assert all(tuple(f.low) <= tuple(f.high) for f in done)
