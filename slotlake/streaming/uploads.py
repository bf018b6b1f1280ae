"""Put streams: uploads assembled from ordered messages, with exact length and a stall timeout.

State is kept per upload only while it is open, so it is bounded by the uploads in flight
and max_put. First-writer-wins on fids is decided against the stored table in each
micro-batch, so no fid stays in stream state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..types import MAX_PUT

#: Messages of an upload: the first has fid, total_size and alias_for, the others only data.
MESSAGES = "upload_id string, msg_idx long, fid long, total_size long, alias_for long, data binary"
RESULTS = "upload_id string, fid long, alias_for long, size long, status string, payload binary"
_STATE = "fid long, alias_for long, total long, next_idx long, payload binary, early array<struct<idx:long,data:binary>>"
STALL_SECONDS = 30


def assemble(messages: DataFrame, stall_seconds: int = STALL_SECONDS, max_put: int = MAX_PUT) -> DataFrame:
    """One row per finished upload: ok with its payload, or no_header, empty, too_large, long, stalled.

    Messages may come in any order and more than once; they count in order of msg_idx. An
    upload is stalled when no message with data came for stall_seconds of processing time;
    empty messages do not extend it. What comes for an upload after its end begins a new one.
    """

    def step(key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        def end(fid, alias, size, status, payload=None) -> pd.DataFrame:
            state.remove()
            row = {"upload_id": [key[0]], "fid": pd.array([fid], "Int64"), "alias_for": pd.array([alias], "Int64"), "size": [size], "status": [status], "payload": pd.Series([payload], dtype=object)}
            return pd.DataFrame(row)

        if state.hasTimedOut:
            fid, alias, _, _, payload, _ = state.get
            yield end(fid, alias, len(payload or b""), "stalled")
            return
        if state.exists:
            fid, alias, total, following, payload, early = state.get
            waiting = {e["idx"] if isinstance(e, dict) else e[0]: bytes((e["data"] if isinstance(e, dict) else e[1]) or b"") for e in early or []}
            payload = bytes(payload or b"")
        else:
            fid = alias = total = None
            following, payload, waiting = 0, b"", {}
        grew = False
        for b in batches:
            for idx, f, t, a, data in zip(b["msg_idx"], b["fid"], b["total_size"], b["alias_for"], b["data"], strict=True):
                if idx == 0 and total is None and pd.notna(t):
                    total, fid = int(t), None if pd.isna(f) else int(f)
                    alias = None if pd.isna(a) else int(a)
                waiting.setdefault(int(idx), bytes(data) if data is not None else b"")
        while following in waiting:
            part = waiting.pop(following)
            payload += part
            grew = grew or bool(part)
            following += 1
        waiting = {k: v for k, v in waiting.items() if k >= following}
        if following and (total is None or fid is None):
            yield end(fid, alias, len(payload), "no_header")
        elif total is not None and total <= 0:
            yield end(fid, alias, 0, "empty")
        elif total is not None and total > max_put:
            yield end(fid, alias, len(payload), "too_large")
        elif total is not None and len(payload) > total:
            yield end(fid, alias, len(payload), "long")
        elif total is not None and len(payload) == total:
            yield end(fid, alias, total, "ok", payload)
        else:
            fresh = not state.exists
            state.update((fid, alias, total, following, payload, [(k, v) for k, v in sorted(waiting.items())]))
            if grew or fresh:
                state.setTimeoutDuration(stall_seconds * 1000)

    return messages.groupBy("upload_id").applyInPandasWithState(step, RESULTS, _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)


def store_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: finished uploads whose fid is new go to path/batch=N, the first of each fid.

    A batch that runs again overwrites its own folder and is compared with earlier batches
    only, so each upload is stored once.
    """

    def write(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        ok = df.where("status = 'ok'").groupBy("fid").agg(F.min_by(F.struct("upload_id", "alias_for", "size", "payload"), "upload_id").alias("r")).select("fid", "r.*")
        known = stored(spark, path, before=batch)
        if known is not None:
            ok = ok.join(known.select("fid"), "fid", "left_anti")
        ok.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write


def stored(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The objects stored so far (those of batches below `before`), or None."""
    try:
        df = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return df if before is None else df.where(F.col("batch") < before)


def append_log(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for a change feed: rows go to path/batch=N as they come, in any order, once per batch.

    changefeed.latest_records(spark.read.parquet(path), sealed=False) then shows the state
    up to the contiguous watermark.
    """

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return write
