import time

import pytest
from pyspark.sql import functions as F

from slotlake.operators import changefeed
from slotlake.streaming import uploads


def feed(spark, folder, schema, batches):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/f{k}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def run(df, folder, sink, done):
    """Runs until done(): processing-time timers keep such a query busy for ever."""
    q = df.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/cp").foreachBatch(sink).start()
    until = time.time() + 100
    while not done() and q.isActive and time.time() < until:
        time.sleep(0.2)
    q.stop()
    assert q.exception() is None


@pytest.fixture
def batches():
    m = lambda u, i, f=None, t=None, a=None, d=b"": (u, i, f, t, a, d)
    return [
        [m("a", 0, 5, 6, None, b"ab"), m("a", 2, d=b"ef"), m("b", 0, 6, 3, 0, b"xyz"), m("c", 0, 7, 0), m("d", 0, d=b"q")],
        [m("a", 1, d=b"cd"), m("a", 1, d=b"cd"), m("e", 0, 5, 6, None, b"abcdef"), m("f", 0, 8, 2, None, b"abc"), m("g", 0, 9, 5, None, b"12")],
        [m("g", 1, d=b""), m("h", 0, 10, 1 << 40)],
    ]


def test_uploads(spark, tmp_path, batches):
    src = feed(spark, str(tmp_path / "in"), uploads.MESSAGES, batches)
    seen = []

    def sink(df, n):
        seen.extend((r.upload_id, r.status, r.size, None if r.payload is None else bytes(r.payload)) for r in df.collect())
        uploads.store_batch(str(tmp_path / "out"))(df, n)
        uploads.store_batch(str(tmp_path / "out"))(df, n)

    run(uploads.assemble(src), str(tmp_path), sink, lambda: len(seen) >= 7)
    assert sorted(seen, key=lambda x: x[0]) == [
        ("a", "ok", 6, b"abcdef"), ("b", "ok", 3, b"xyz"), ("c", "empty", 0, None), ("d", "no_header", 1, None), ("e", "ok", 6, b"abcdef"), ("f", "long", 3, None), ("h", "too_large", 0, None),
    ]
    got = uploads.stored(spark, str(tmp_path / "out"))
    assert sorted((r.fid, r.upload_id) for r in got.collect()) == [(5, "a"), (6, "b")]
    assert uploads.stored(spark, str(tmp_path / "nowhere")) is None


def test_change_feed_stream(spark, tmp_path):
    schema = "disk_id long, seq long, fid long, size long, jump_code int, kind string"
    src = feed(spark, str(tmp_path / "in"), schema, [[(1, 1, 5, 10, 0, None), (1, 4, 6, 10, 0, None)], [(1, 2, 5, 0, 0, None), (1, 1, 5, 10, 0, None)], [(1, 3, 7, 9, 0, None)]])
    path, states = str(tmp_path / "log"), []

    def sink(df, n):
        uploads.append_log(path)(df, n)
        log = spark.read.parquet(path).where(F.col("batch") <= n)
        states.append(sorted(r.fid for r in changefeed.latest_records(log, sealed=False).collect()))

    run(src, str(tmp_path), sink, lambda: len(states) >= 3)
    assert states == [[5], [], [6, 7]]
