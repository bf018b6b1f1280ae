"""Reading objects: lookup, ranges, aliases, packed slices, messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import MANIFEST_MAGIC, STREAM_CHUNK


def normal_range(size: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    """(start, end, status) of a byte range [start, end): end 0, null or beyond the size means the size.

    A start after the end is invalid_argument; an equal one is ok and empty. A null start is 0.
    """
    s = F.coalesce(start, F.lit(0))
    e = F.when(end.isNull() | (end == 0) | (end > size), size).otherwise(end)
    status = F.when(size.isNull(), "not_found").when((s > e) | (s < 0), "invalid_argument").otherwise("ok")
    return s, e, status


def byte_slice(payload: Column, start: Column, end: Column) -> Column:
    """payload[start:end]."""
    return F.substring(payload, (start + 1).cast("int"), (end - start).cast("int"))


def head(requests: DataFrame, refs: DataFrame) -> DataFrame:
    """(req_id, fid, size, status): the logical size of each requested fid, on whichever disk has it."""
    r = refs.groupBy("fid").agg(F.max(F.coalesce("size", "stored_size")).alias("size"))
    x = requests.select("req_id", "fid").join(r, "fid", "left")
    return x.select("req_id", "fid", "size", F.when(F.col("size").isNull(), "not_found").otherwise("ok").alias("status"))


def exists(keys: DataFrame, known: DataFrame, on: str = "fid") -> DataFrame:
    """The rows whose key is known. Known keys are reduced to one each before the join."""
    return keys.join(known.select(on).distinct(), on, "left_semi")


def missing(keys: DataFrame, known: DataFrame, on: str = "fid") -> DataFrame:
    """The rows whose key is not known: what has to be uploaded. A null key is never known."""
    return keys.join(known.select(on).distinct(), on, "left_anti")


def get(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """(req_id, fid, status, start, end, data): the asked range of each object.

    requests: req_id, fid, range_start, range_end. Only asked objects' payloads move.
    """
    x = requests.join(objects.select("fid", "payload").dropDuplicates(["fid"]), "fid", "left")
    s, e, status = normal_range(F.octet_length("payload").cast("long"), F.col("range_start"), F.col("range_end"))
    x = x.select("req_id", "fid", status.alias("status"), s.alias("start"), e.alias("end"), "payload")
    ok = F.col("status") == "ok"
    return x.select("req_id", "fid", "status", F.when(ok, F.col("start")).alias("start"), F.when(ok, F.col("end")).alias("end"), F.when(ok, byte_slice(F.col("payload"), F.col("start"), F.col("end"))).alias("data"))


def messages(ranges: DataFrame, chunk: int = STREAM_CHUNK) -> DataFrame:
    """(req_id, msg, start, end) of each ok range in messages of at most `chunk` bytes; an empty range is one empty message."""
    n = F.greatest(F.ceil((F.col("end") - F.col("start")) / chunk), F.lit(1))
    x = ranges.where("status = 'ok'").select("req_id", "start", "end", F.posexplode(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).alias("msg", "k"))
    s = F.col("start") + F.col("k") * chunk
    return x.select("req_id", F.col("msg").cast("long").alias("msg"), s.alias("start"), F.least(s + chunk, F.col("end")).alias("end"))


def resolve(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """(disk_id, fid, data): the logical bytes of every ref.

    A direct ref reads its object; an alias the target without its last byte; a packed ref
    its slice of the container. refs.target_fid names the object that holds the bytes. Refs
    whose object is missing or too short have null data.
    """
    o = objects.select(F.col("fid").alias("target_fid"), "payload").dropDuplicates(["target_fid"])
    x = refs.withColumn("target_fid", F.coalesce("target_fid", "fid")).join(o, "target_fid", "left")
    offset = F.coalesce("byte_offset", F.lit(0).cast("long"))
    size = F.coalesce("size", "stored_size")
    whole = offset + size <= F.octet_length("payload")
    return x.select("disk_id", "fid", F.when(whole, byte_slice(F.col("payload"), offset, offset + size)).alias("data"))


def joined(parts: DataFrame, group: list[str], order: str, data: str) -> DataFrame:
    """(group, data): the parts of each group end to end, in order. One object is one row, bounded by max_put."""
    g = parts.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(data).alias("d")))).alias("p"))
    return g.select(*group, F.aggregate("p", F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, F.coalesce(x["d"], F.lit(b"").cast("binary")))).alias("data"))


def is_manifest(payload: Column) -> Column:
    return F.substring(payload, 1, len(MANIFEST_MAGIC)) == F.lit(MANIFEST_MAGIC).cast("binary")


def verify_content(expected: DataFrame, stored: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(fid, status) of expected (fid, payload) against what is stored: ok, not_found, size or content; with the columns to keep of expected."""
    s = stored.select("fid", F.col("payload").alias("have")).dropDuplicates(["fid"])
    x = expected.join(s, "fid", "left")
    status = F.when(F.col("have").isNull(), "not_found").when(F.octet_length("have") != F.octet_length("payload"), "size").when(F.col("have") != F.col("payload"), "content").otherwise("ok")
    return x.select("fid", *(keep or []), status.alias("status"))
