"""Queries of the general problems: consolidation (p2) and the change feed (p4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import changefeed, consolidate
from ..sources.tables import table


def _small(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.small_objects(table(spark, d, "refs"), table(spark, d, "packed"), table(spark, d, "trim_status"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    """The small objects as the k-way merge of their sorted runs deals them to containers."""
    return consolidate.merged_objects(_small(spark, d))


def p2_containers(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.container_ranges(_placed(spark, d))


def p2_entries(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.entries_of(_placed(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The objects that the containers hold."""
    return _placed(spark, d).select("disk_id", "fid")


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    """Per disk: small objects found against the count the device reported, and the containers they fill."""
    c = consolidate.container_ranges(_placed(spark, d)).groupBy("disk_id").agg(F.sum("objects").alias("small_files"), F.count(F.lit(1)).alias("containers"), F.sum("container_size").alias("bytes"))
    limits = consolidate.latest_thresholds(table(spark, d, "trim_status"))
    return limits.join(c, "disk_id", "left").select("disk_id", "threshold", "reported", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("small_files", "containers", "bytes")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.latest_records(table(spark, d, "index_log")).select("disk_id", "fid", "seq")


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.latest_records(table(spark, d, "index_log"))


def p4_committed(spark: SparkSession, d: str) -> DataFrame:
    """The records as far as the logs are known to be complete: up to each disk's contiguous watermark."""
    return changefeed.latest_records(table(spark, d, "index_log"), sealed=False).select("disk_id", "fid", "seq")


def p4_watermarks(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.watermarks(table(spark, d, "index_log"))


def p4_as_of(spark: SparkSession, d: str) -> DataFrame:
    """The records that could be shown when three quarters of the time had passed: what had come by then, up to the first gap."""
    log = changefeed.arrived_by(table(spark, d, "index_log"), 0.75)
    return changefeed.latest_records(log, sealed=False).select("disk_id", "fid", "seq")


def p4_as_of_watermarks(spark: SparkSession, d: str) -> DataFrame:
    return changefeed.watermarks(changefeed.arrived_by(table(spark, d, "index_log"), 0.75))


QUERIES = {f.__name__: f for f in (p2_found, p2_containers, p2_entries, p2_report, p4_found, p4_records, p4_committed, p4_watermarks, p4_as_of, p4_as_of_watermarks)}

_SMALL_SQL = """
lim AS (SELECT disk_id, last_threshold_bytes AS threshold, last_small_files AS reported FROM (
  SELECT *, row_number() OVER (PARTITION BY disk_id ORDER BY last_check_at DESC NULLS LAST, last_threshold_bytes DESC NULLS LAST, last_small_files DESC NULLS LAST) AS rn FROM trim_status) WHERE rn = 1),
ent AS (SELECT disk_id, container_size, unnest(entries) AS e FROM packed),
excluded AS (
  SELECT disk_id, target_fid AS fid FROM refs WHERE target_fid <> fid
  UNION SELECT disk_id, table_fid FROM packed
  UNION SELECT disk_id, container_fid FROM packed
  UNION SELECT disk_id, e.fid FROM ent WHERE e.size > 0 AND e.byte_offset + e.size <= container_size),
small AS (
  SELECT DISTINCT r.disk_id, r.fid, coalesce(r.size, r.stored_size) AS size, l.threshold
  FROM refs r JOIN lim l ON r.disk_id = l.disk_id
  WHERE (r.target_fid IS NULL OR r.target_fid = r.fid) AND coalesce(r.size, r.stored_size) < l.threshold
    AND NOT EXISTS (SELECT 1 FROM excluded x WHERE x.disk_id = r.disk_id AND x.fid = r.fid)),
charged AS (SELECT *, greatest(size + (8388608 - threshold + 1) // 262144, 1) AS charge FROM small),
placed AS (SELECT *, sum(size) OVER w - size AS lies, sum(charge) OVER w - charge AS place FROM charged WINDOW w AS (PARTITION BY disk_id ORDER BY fid < 0, fid ROWS UNBOUNDED PRECEDING)),
numbered AS (SELECT *, CAST(place // (8388608 - threshold + 1) AS BIGINT) AS container_no FROM placed)
"""

_LOG_SQL = """
one AS (SELECT disk_id, seq, min(fid) AS fid, min(size) AS size, min(jump_code) AS code FROM index_log GROUP BY ALL),
fin AS (SELECT disk_id, min(seq) AS end_seq FROM one WHERE fid = 0 AND size = 0 AND code = 0 GROUP BY disk_id),
live AS (SELECT o.* FROM one o LEFT JOIN fin f ON o.disk_id = f.disk_id WHERE f.end_seq IS NULL OR o.seq < f.end_seq),
kinds AS (SELECT *, (code <> 0 AND size = 72057594037927935) OR (code = 255 AND size = 72057594037927934) AS ind,
  row_number() OVER w AS rn, lag(fid) OVER w AS pfid, lag(seq) OVER w AS pseq, lag(code) OVER w AS pcode, lag(size) OVER w AS psize
  FROM live WINDOW w AS (PARTITION BY disk_id ORDER BY seq)),
runs AS (SELECT *, (rn - 1 - coalesce(max(CASE WHEN NOT ind THEN rn END) OVER (PARTITION BY disk_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) % 2 = 1 AS is_open FROM kinds),
acts AS (
  SELECT disk_id, pfid AS fid, seq AS pos, pseq AS seq, CASE WHEN pcode = 255 AND psize = 72057594037927934 THEN size ELSE size - 1 END AS size,
    fid AS actual_fid, size AS actual_size, pcode AS jump_code, NOT (pcode = 255 AND psize = 72057594037927934) AS jump, pcode = 255 AND psize = 72057594037927934 AS packed, TRUE AS put
  FROM runs WHERE is_open AND code = 0 AND size <> 0
  UNION ALL SELECT disk_id, fid, seq, seq, size, fid, size, 0, FALSE, FALSE, size <> 0 FROM runs WHERE NOT is_open AND NOT ind AND code = 0),
last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disk_id, fid ORDER BY pos DESC) AS k FROM acts) WHERE k = 1 AND put)
"""

_COMMITTED_SQL = _LOG_SQL.replace(
    "live AS (SELECT o.* FROM one o",
    """marks AS (SELECT disk_id, coalesce(max(seq) FILTER (WHERE shift = 0), 0) AS mark FROM (SELECT disk_id, seq, seq - row_number() OVER (PARTITION BY disk_id ORDER BY seq) AS shift FROM one) GROUP BY disk_id),
live AS (SELECT o.* FROM (SELECT o1.* FROM one o1 JOIN marks m ON o1.disk_id = m.disk_id WHERE o1.seq <= m.mark) o""",
)

_WATERMARKS_SQL = """
WITH one AS (SELECT DISTINCT disk_id, seq, fid, size, jump_code FROM index_log),
g AS (SELECT *, seq - row_number() OVER (PARTITION BY disk_id ORDER BY seq) AS shift FROM one)
SELECT disk_id, count(*) AS entries, max(seq) AS last_seq, coalesce(max(seq) FILTER (WHERE shift = 0), 0) AS watermark,
  count(*) - coalesce(max(seq) FILTER (WHERE shift = 0), 0) AS held, min(seq) FILTER (WHERE fid = 0 AND size = 0 AND jump_code = 0) AS end_seq
FROM g GROUP BY disk_id"""

_ARRIVED = "(SELECT * FROM index_log WHERE epoch_us(arrived_at) <= (SELECT min(epoch_us(arrived_at)) + CAST(floor((max(epoch_us(arrived_at)) - min(epoch_us(arrived_at))) * 0.75) AS BIGINT) FROM index_log))"

ORACLE = {
    "p4_as_of": f"WITH {_COMMITTED_SQL.replace('FROM index_log', f'FROM {_ARRIVED}')} SELECT disk_id, fid, seq FROM last",
    "p4_as_of_watermarks": _WATERMARKS_SQL.replace("FROM index_log", f"FROM {_ARRIVED}"),
    "p4_committed": f"WITH {_COMMITTED_SQL} SELECT disk_id, fid, seq FROM last",
    "p2_found": f"WITH {_SMALL_SQL} SELECT disk_id, fid FROM small",
    "p2_containers": f"WITH {_SMALL_SQL} SELECT disk_id, container_no, CAST(sum(size) AS BIGINT) AS container_size, first(fid ORDER BY lies) AS first_fid, last(fid ORDER BY lies) AS last_fid, count(*) AS objects FROM numbered GROUP BY ALL",
    "p2_entries": f"WITH {_SMALL_SQL} SELECT disk_id, container_no, fid, CAST(lies - min(lies) OVER (PARTITION BY disk_id, container_no) AS BIGINT) AS byte_offset, size FROM numbered",
    "p2_report": f"WITH {_SMALL_SQL} SELECT l.disk_id, l.threshold, l.reported, count(n.fid) AS small_files, count(DISTINCT n.container_no) AS containers, CAST(coalesce(sum(n.size), 0) AS BIGINT) AS bytes FROM lim l LEFT JOIN numbered n ON n.disk_id = l.disk_id GROUP BY ALL",
    "p4_found": f"WITH {_LOG_SQL} SELECT disk_id, fid, seq FROM last",
    "p4_records": f"WITH {_LOG_SQL} SELECT disk_id, fid, size, actual_fid, actual_size, jump_code, seq, jump, packed FROM last",
    "p4_watermarks": _WATERMARKS_SQL,
}
