"""Millions of tiny files into few well-sized ones: sorted-run consolidation.

Every input file is a run, sorted by the key. Runs are described first (key column only,
read in order, so a file that is not sorted is found before anything is written): key
range, rows, bytes, and marks, keys at equal distances. While there are more than FAN_IN
runs, groups of FAN_IN are merged to one run each, then the rest to the result. A merge is
cut into key ranges of a few output files by the marks; a range is one task that opens the
files reaching into it, at most FAN_IN at a time, and merges them k-way in bounded memory.
Rows with equal keys all stay. A key whose rows outgrow a range is spread over several
tasks by run. Output rolls to a new file by bytes. The table of files with their ranges,
taken from what was written, is the commit: files of lost attempts are not in it.

Files are read and written through pyarrow's file systems, so a path may be a URI of any
store that all executors reach, or a plain path of a shared folder. The lists of files
are DataFrames; the driver sees the cut keys, one for each range.
"""

from __future__ import annotations

import heapq
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, delete_at_end, shared_dir

#: Bytes at which an output file is closed, and output files per key range.
TARGET_BYTES = 128 << 20
FILES_PER_RANGE = 4
#: Runs merged at a time, and so the files a task holds open.
FAN_IN = 128
#: Most rows a run holds in memory at a time, and bytes all runs of a merge may hold.
BATCH_ROWS = 65_536
MERGE_BYTES = 256 << 20
#: Marks of all files together, and of one.
MARKS_TOTAL = 1_000_000
MARKS = 64
#: Most tasks of one merge; more ranges share them.
TASKS = 10_000

_META = "run string, path string, key_min long, key_max long, low array<long>, high array<long>, rows long, bytes long, sorted boolean, marks array<array<long>>"
_RANGES = "path string, key_min long, key_max long, rows long, bytes long, low array<long>, high array<long>"
_NAMES = [c.split()[0] for c in _META.split(", ")]
_BIAS = 1 << 63

Key = tuple[int, ...]


def _file(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[5:]
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _keys(key: str | list[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _number(k: Key) -> int:
    """A key as one number of the same order; a single column is itself."""
    if len(k) == 1:
        return k[0]
    n = 0
    for x in k:
        n = (n << 64) + x + _BIAS
    return n


def _key(n: int, width: int) -> Key:
    if width == 1:
        return (n,)
    return tuple(((n >> (64 * (width - 1 - i))) & (2**64 - 1)) - _BIAS for i in range(width))


def _columns(t: pa.Table | pa.RecordBatch, keys: list[str]) -> list[np.ndarray]:
    return [np.asarray(t.column(k).to_numpy(zero_copy_only=False) if isinstance(t, pa.RecordBatch) else t[k].to_numpy()) for k in keys]


def _ascending(columns: list[np.ndarray]) -> bool:
    """Whether rows are in order of their keys."""
    undecided = np.ones(max(0, len(columns[0]) - 1), dtype=bool)
    for c in columns:
        if (undecided & (c[1:] < c[:-1])).any():
            return False
        undecided &= c[1:] == c[:-1]
    return True


def _upto(columns: list[np.ndarray], k: Key, side: str, begin: int = 0) -> int:
    """Rows of sorted columns before k (side left) or up to it (side right), from row `begin` on."""
    lo, hi = begin, len(columns[0])
    for c, x in zip(columns[:-1], k, strict=False):
        lo, hi = lo + int(np.searchsorted(c[lo:hi], x, "left")), lo + int(np.searchsorted(c[lo:hi], x, "right"))
    return lo + int(np.searchsorted(columns[-1][lo:hi], k[-1], side))


def _row(columns: list[np.ndarray], i: int) -> Key:
    return tuple(int(c[i]) for c in columns)


def _describe(path: str, keys: list[str], marks: int) -> tuple:
    """A run as a row of _META, from its footer and its key columns; a null key counts as out of order."""
    fs, at = _file(path)
    with fs.open_input_file(at) as source:
        f = pq.ParquetFile(source)
        rows, size = f.metadata.num_rows, sum(f.metadata.row_group(g).total_byte_size for g in range(f.metadata.num_row_groups))
        wanted = [int((i + 0.5) * rows / min(marks, rows)) for i in range(min(marks, rows))]
        low = last = None
        found, done = [], 0
        for b in f.iter_batches(batch_size=BATCH_ROWS, columns=keys):
            if not b.num_rows:
                continue
            if any(b.column(k).null_count for k in keys):
                return path, path, None, None, None, None, rows, size, False, []
            c = _columns(b, keys)
            first = _row(c, 0)
            if not _ascending(c) or last is not None and first < last:
                return path, path, None, None, None, None, rows, size, False, []
            low = first if low is None else low
            last = _row(c, b.num_rows - 1)
            found += [_row(c, w - done) for w in wanted if done <= w < done + b.num_rows]
            done += b.num_rows
    if low is None:
        return path, path, None, None, None, None, 0, size, True, []
    return path, path, low[0], last[0], list(low), list(last), rows, size, True, [list(m) for m in found]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_NAMES).astype({"key_min": "Int64", "key_max": "Int64"})


def _listed(spark: SparkSession, source: DataFrame | list[str] | str) -> DataFrame:
    """(path) of a DataFrame with that column, a list, or all Parquet files of a folder."""
    if isinstance(source, DataFrame):
        return source.select("path")
    if isinstance(source, str):
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(source).select("path")
    return spark.createDataFrame([(p,) for p in source], "path string")


def runs(spark: SparkSession, source: DataFrame | list[str] | str, key: str | list[str], slices: int = 16) -> DataFrame:
    """The runs of _META, their key columns read in parallel. `source`: see consolidate_files()."""
    keys, files = _keys(key), _listed(spark, source)
    n = files.count()
    marks = max(1, min(MARKS, MARKS_TOTAL // max(1, n)))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield _frame([_describe(p, keys, marks) for p in b["path"]])

    return files.repartition(max(1, min(n, max(slices, n // 200)))).mapInPandas(read, _META)


def cut_keys(metadata: list[tuple[int, int, int]], range_bytes: int) -> list[int]:
    """Keys that split pieces of runs (key_min, key_max, bytes) into ranges of about range_bytes, each piece spread evenly over its keys."""
    total = sum(m[2] for m in metadata)
    n = max(1, round(total / range_bytes))
    if n == 1 or not metadata:
        return []
    # Density changes only at the pieces' ends: walk these points and place the cuts by interpolation.
    points = sorted({m[0] for m in metadata} | {m[1] + 1 for m in metadata})
    rate: dict[int, float] = {}
    for lo, hi, size in metadata:
        d = size / (hi + 1 - lo)
        rate[lo] = rate.get(lo, 0.0) + d
        rate[hi + 1] = rate.get(hi + 1, 0.0) - d
    cuts, done, density, step = [], 0.0, 0.0, total / n
    for a, b in zip(points, points[1:], strict=False):
        density += rate.get(a, 0.0)
        mass = density * (b - a)
        while density > 0 and len(cuts) < n - 1 and (len(cuts) + 1) * step <= done + mass:
            cuts.append(min(b, a + max(1, int(((len(cuts) + 1) * step - done) / density))))
        done += mass
    return sorted(set(cuts))


def _pieces(low: Key, high: Key, size: int, marks: list[Key]) -> list[tuple[int, int, float]]:
    """A run as pieces of equal bytes between its marks; a key that fills several marks is a piece of its own."""
    ends = [low, *marks, high]
    share = [0.5, *[1.0] * (len(marks) - 1), 0.5] if marks else [1.0]
    return [(_number(a), _number(b), size * s / max(1, len(marks))) for a, b, s in zip(ends[:-1], ends[1:], share, strict=True)]


def plan(files: DataFrame, width: int, range_bytes: int) -> dict[str, tuple[list[Key], dict[int, int]]]:
    """Per group of runs (column grp): its cut keys, and the number of tasks for each range that is one hot key.

    The cuts of a group are computed in one task from the marks, at most MARKS_TOTAL or
    one for each file; the driver gets one row for each range.
    """

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = [p for lo, hi, n, marks in zip(pdf["low"], pdf["high"], pdf["bytes"], pdf["marks"], strict=True) for p in _pieces(tuple(map(int, lo)), tuple(map(int, hi)), int(n), [tuple(map(int, m)) for m in marks])]
        single: dict[int, float] = {}
        for a, b, n in pieces:
            if a == b:
                single[a] = single.get(a, 0.0) + n
        hot = {k: n for k, n in single.items() if n > range_bytes}
        found = sorted(set(cut_keys(pieces, range_bytes)) | {x for k in hot for x in (k, k + 1)})
        rows = [(pdf["grp"].iloc[0], list(_key(x, width)), int(-(-hot[x] // range_bytes)) if x in hot else 1) for x in found]
        return pd.DataFrame(rows, columns=["grp", "at", "parts"])

    out: dict[str, tuple[list[Key], dict[int, int]]] = {}
    rows = files.select("grp", "low", "high", "bytes", "marks").groupBy("grp").applyInPandas(cuts, "grp string, at array<long>, parts int").collect()
    for r in sorted(rows, key=lambda r: (r["grp"], tuple(r["at"]))):
        keys, parts = out.setdefault(r["grp"], ([], {}))
        keys.append(tuple(r["at"]))
        if r["parts"] > 1:
            parts[len(keys)] = r["parts"]
    return out


def assigned(files: DataFrame, cuts: dict[str, tuple[list[Key], dict[int, int]]]) -> tuple[DataFrame, int]:
    """(files with range and part, tasks): every file once for each range of its group that it reaches into."""
    sent = files.sparkSession.sparkContext.broadcast(cuts)
    schema = "grp string, range int, part int, run string, path string, low array<long>, rows long, bytes long"

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for grp, run, path, low, high, n, size in zip(b["grp"], b["run"], b["path"], b["low"], b["high"], b["rows"], b["bytes"], strict=True):
                keys, parts = sent.value.get(grp, ([], {}))
                for r in range(bisect_right(keys, tuple(map(int, low))), bisect_right(keys, tuple(map(int, high))) + 1):
                    rows.append((grp, r, zlib.crc32(path.encode()) % parts.get(r, 1), run, path, low, n, size))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    groups = files.select("grp").distinct().count()
    tasks = groups + sum(len(keys) + sum(parts.values()) - len(parts) for keys, parts in cuts.values())
    return files.select("grp", "run", "path", "low", "high", "rows", "bytes").mapInPandas(spread, schema), tasks


def _stream(paths: list[str], keys: list[str], low: Key | None, high: Key | None, rows: int) -> Iterator[pa.Table]:
    """A run's batches with low <= key < high, file after file, skipping row groups outside; refuses what is out of order."""
    last = None
    for path in paths:
        fs, name = _file(path)
        with fs.open_input_file(name) as source:
            f = pq.ParquetFile(source)
            at = next(i for i in range(f.metadata.num_columns) if f.metadata.schema.column(i).path == keys[0])
            groups = []
            for g in range(f.metadata.num_row_groups):
                s = f.metadata.row_group(g).column(at).statistics
                if s is None or not s.has_min_max or ((high is None or s.min <= high[0]) and (low is None or s.max >= low[0])):
                    groups.append(g)
            for b in f.iter_batches(batch_size=rows, row_groups=groups):
                if not b.num_rows:
                    continue
                c = _columns(b, keys)
                if not _ascending(c) or last is not None and _row(c, 0) < last:
                    raise ValueError(f"not sorted by {keys}: {path}")
                last = _row(c, b.num_rows - 1)
                i = 0 if low is None else _upto(c, low, "left")
                j = b.num_rows if high is None else _upto(c, high, "left")
                if j > i:
                    yield pa.Table.from_batches([b.slice(i, j - i)])
                if j < b.num_rows:
                    return


def merge_runs(streams: list[Iterator[pa.Table]], key: str | list[str]) -> Iterator[pa.Table]:
    """K-way merge of sorted streams into sorted tables; equal keys of one step keep the order of the streams.

    At a time each stream holds one batch. A heap of the batches' last keys gives the least:
    all rows up to it are safe to give out, and the stream that had it moves on. So each
    step uses up a batch.
    """
    keys = _keys(key)
    heads: dict[int, tuple[pa.Table, list[np.ndarray], int]] = {}
    ends: list[tuple[Key, int]] = []

    def advance(k: int) -> None:
        t = next(streams[k], None)
        if t is not None:
            c = _columns(t, keys)
            heads[k] = (t, c, 0)
            heapq.heappush(ends, (_row(c, t.num_rows - 1), k))

    for k in range(len(streams)):
        advance(k)
    while ends:
        limit, parts, empty = ends[0][0], [], []
        for k in sorted(heads):
            t, c, at = heads[k]
            if _row(c, at) > limit:
                continue
            # A stream that is not at its end may bring more rows of the limit itself: they
            # come after, which is in order.
            n = _upto(c, limit, "right", at)
            parts.append((t.slice(at, n - at), [x[at:n] for x in c]))
            if n == t.num_rows:
                empty.append(k)
            else:
                heads[k] = (t, c, n)
        for k in empty:
            del heads[k]
        while ends and ends[0][0] == limit:
            heapq.heappop(ends)
        for k in empty:
            advance(k)
        if len(parts) == 1:
            yield parts[0][0]
        else:
            order = np.lexsort([np.concatenate(x) for x in zip(*(c for _, c in parts), strict=True)][::-1])
            yield pa.concat_tables([t for t, _ in parts]).take(pa.array(order))


def merged(files: DataFrame, key: str | list[str], cuts: dict[str, tuple[list[Key], dict[int, int]]], emit: Callable[[str, int, int, Iterator[pa.Table]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """One task for each range: emit(grp, range, part, its rows in key order) gives the rows of the result."""
    keys = _keys(key)
    spread, tasks = assigned(files, cuts)
    sent = files.sparkSession.sparkContext.broadcast(cuts)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        grp, r, part = pdf["grp"].iloc[0], int(pdf["range"].iloc[0]), int(pdf["part"].iloc[0])
        bounds = [None, *sent.value.get(grp, ([], {}))[0], None]
        pdf = pdf.assign(low=pdf["low"].map(lambda x: tuple(map(int, x)))).sort_values(["run", "low", "path"])
        of_run = [g["path"].tolist() for _, g in pdf.groupby("run", sort=True)]
        wide = max(1, int(pdf["bytes"].sum() // max(1, pdf["rows"].sum())))
        rows = int(max(16, min(BATCH_ROWS, MERGE_BYTES // (len(of_run) * wide))))
        tables = merge_runs([_stream(p, keys, bounds[r], bounds[r + 1], rows) for p in of_run], keys)
        out = list(emit(grp, r, part, tables))
        return pd.concat(out) if out else pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")])

    return spread.repartition(max(1, min(tasks, TASKS)), "grp", "range", "part").groupBy("grp", "range", "part").applyInPandas(merge, schema)


class _Roller:
    """Writes tables to files that are closed at a number of bytes; what it tells of them is what it wrote."""

    def __init__(self, folder: str, stem: str, run: str, keys: list[str], target: int) -> None:
        self.folder, self.stem, self.run, self.keys, self.target = folder, stem, run, keys, target
        self.out: list[tuple] = []
        self.writer = None

    def write(self, t: pa.Table) -> None:
        per_row = max(1, t.nbytes // max(1, t.num_rows))
        step = max(1, min(BATCH_ROWS, self.target // (4 * per_row)))
        for i in range(0, t.num_rows, step):
            piece = t.slice(i, step)
            c = _columns(piece, self.keys)
            if self.writer is None:
                self.path = f"{self.folder}/{self.stem}-{len(self.out):05d}.parquet"
                fs, at = _file(self.path)
                self.sink = fs.open_output_stream(at)
                self.writer = pq.ParquetWriter(self.sink, t.schema, compression="zstd")
                self.low, self.rows, self.raw, self.marks = _row(c, 0), 0, 0, []
            elif _row(c, 0) < self.high:
                raise ValueError(f"not sorted by {self.keys}: {self.path}")
            self.writer.write_table(piece)
            self.high = _row(c, piece.num_rows - 1)
            self.rows += piece.num_rows
            self.raw += piece.nbytes
            # A mark for each 16th part of a piece; pieces are about equal in bytes.
            self.marks += [list(_row(c, int((m + 0.5) * piece.num_rows / 16))) for m in range(16)]
            if self.sink.tell() >= self.target:
                self.close()

    def close(self) -> None:
        if self.writer is not None:
            self.writer.close()
            size = self.sink.tell()
            self.sink.close()
            thin = self.marks[:: max(1, len(self.marks) // MARKS)]
            self.out.append((self.run, self.path, self.low[0], self.high[0], list(self.low), list(self.high), self.rows, size, True, thin))
            self.writer = None


def _rolled(folder: str, keys: list[str], target_bytes: int) -> Callable[[str, int, int, Iterator[pa.Table]], Iterator[pd.DataFrame]]:
    def emit(grp: str, r: int, part: int, tables: Iterator[pa.Table]) -> Iterator[pd.DataFrame]:
        roller = _Roller(folder, f"part-{r:06d}-{part:04d}{uuid.uuid4().hex[:12]}", grp, keys, target_bytes)
        for t in tables:
            roller.write(t)
        roller.close()
        yield _frame(roller.out)

    return emit


def _make_folder(folder: str) -> None:
    fs, at = _file(folder)
    fs.create_dir(at, recursive=True)


def few_runs(files: DataFrame, key: str | list[str], range_bytes: int, target_bytes: int = TARGET_BYTES, fan_in: int = FAN_IN) -> DataFrame:
    """Merges groups of `fan_in` runs until at most that many are left; intermediate runs lie in the shared folder until the session ends."""
    keys, spark = _keys(key), files.sparkSession

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        n, own = 0, TaskContext.get().partitionId()
        for b in batches:
            yield pd.DataFrame({"run": b["run"], "grp": [f"{own:08d}-{(n + i) // fan_in:08d}" for i in range(len(b))]})
            n += len(b)

    while (n := files.select("run").distinct().count()) > fan_in:
        groups = files.select("run").distinct().repartitionByRange(-(-n // (64 * fan_in)), "run").sortWithinPartitions("run").mapInPandas(number, "run string, grp string")
        level = cut(files.drop("grp").join(cut(groups), "run"))
        folder = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"
        _make_folder(folder)
        delete_at_end(spark, folder)
        files = cut(merged(level, keys, plan(level, len(keys), range_bytes), _rolled(folder, keys, target_bytes), _META))
    return files


def described(spark: SparkSession, source: DataFrame | list[str] | str, key: str | list[str]) -> DataFrame:
    """runs() without empty ones, written once; ValueError names runs that are not sorted by the key or have null keys."""
    found = cut(runs(spark, source, key))
    bad = [r["path"] for r in found.where("not sorted").select("path").limit(5).collect()]
    if bad:
        raise ValueError(f"not sorted by {key}: {bad}")
    return found.where("rows > 0")


def consolidate_files(spark: SparkSession, source: DataFrame | list[str] | str, target: str, key: str | list[str], target_bytes: int = TARGET_BYTES, files_per_range: int = FILES_PER_RANGE, fan_in: int = FAN_IN) -> DataFrame:
    """Merges the runs into files of about target_bytes under `target`/data; returns their table of ranges.

    source: a DataFrame of paths (column path), a list of them, or a folder. key: LONG
    columns without nulls by which every run is sorted; others are refused by name, before
    anything is written. No row is lost or doubled. A key with more rows than a range holds
    is spread over tasks by run, so its rows lie in several files. Without any rows nothing
    is written; a target that has been committed is not written again.
    """
    keys, range_bytes = _keys(key), target_bytes * files_per_range
    found = described(spark, source, keys)
    if found.isEmpty():
        return spark.createDataFrame([], _RANGES)
    files = few_runs(found, keys, range_bytes, target_bytes, fan_in).withColumn("grp", F.lit("all"))
    _make_folder(f"{target}/data")
    done = merged(files, keys, plan(files, len(keys), range_bytes), _rolled(f"{target}/data", keys, target_bytes), _META)
    done.select(*(c.split()[0] for c in _RANGES.split(", "))).write.mode("errorifexists").parquet(f"{target}/ranges")
    return read_ranges(spark, target)


def read_ranges(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema(_RANGES).parquet(f"{target}/ranges")


def read_consolidated(spark: SparkSession, target: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """The committed files, only those whose range of the first key column meets [low, high]."""
    r = read_ranges(spark, target)
    wanted = r if high is None else r.where(F.col("key_min") <= high)
    wanted = wanted if low is None else wanted.where(F.col("key_max") >= low)
    paths = [x["path"] for x in wanted.select("path").collect()]
    if not paths:
        return spark.read.parquet(r.select("path").first()["path"]).where(F.lit(False))
    return spark.read.parquet(*paths)


def sort_runs(df: DataFrame, key: str | list[str], path: str) -> None:
    """Writes a table as sorted runs, one per partition: the first step for unsorted input. Null keys are refused, as in consolidate_files."""
    for k in _keys(key):
        df = df.withColumn(k, F.coalesce(F.col(k), F.raise_error(F.lit(f"null keys in {k}")).cast(df.schema[k].dataType)))
    df.sortWithinPartitions(*_keys(key)).write.mode("errorifexists").parquet(path)


def range_of(cuts: list[Key], columns: list[np.ndarray]) -> np.ndarray:
    """The range that each row falls into."""
    if not cuts:
        return np.zeros(len(columns[0]), dtype=np.int64)
    bounds = [np.array([c[i] for c in cuts], dtype=np.int64) for i in range(len(columns))]
    if len(columns) == 1:
        return np.searchsorted(bounds[0], columns[0], side="right")
    # Rows of a sorted batch fall into few ranges: its distinct leading keys are looked up one by one.
    out = np.zeros(len(columns[0]), dtype=np.int64)
    for lead in np.unique(columns[0]):
        own = columns[0] == lead
        lo, hi = bisect_left(bounds[0], lead), bisect_right(bounds[0], lead)
        if len(columns) == 2:
            out[own] = lo + np.searchsorted(bounds[1][lo:hi], columns[1][own], side="right")
        else:
            out[own] = lo + range_of([c[1:] for c in cuts[lo:hi]], [c[own] for c in columns[1:]])
    return out
