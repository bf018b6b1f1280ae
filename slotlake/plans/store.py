"""Queries of the store's own operators over the tables of a data folder, and their SQL.

Payloads are the documents' texts; objects on disks are `refs`; logs are `index_log`;
files in parts are `chunks`. Where SQL has to follow, fids of texts are the first 64
bits of md5.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address, fid, parse
from ..operators import catalog, changefeed, chunking, consolidate, indexlog, placement, reads, trim, writes
from ..session import broadcast_if_small
from ..sources.tables import table
from ..types import hex_fid

#: Slots of the grids on which documents and objects are placed.
DOC_SLOTS = 1 << 20
DISK_SLOTS = 1 << 24
#: Bytes of a fixed chunk; least, target and largest content-defined chunk at the scale of texts.
FIXED = 1024
CDC = (256, 1024, 4096)
TRIM_BYTES = 8 << 20

#: SQL of a LONG read as unsigned.
_U = lambda c: f"CAST(CASE WHEN {c} < 0 THEN CAST({c} AS HUGEINT) + 18446744073709551616 ELSE CAST({c} AS HUGEINT) END AS UBIGINT)"

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _docs(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "documents").where("doc_id is not null and text is not null").select("doc_id", F.col("text").cast("binary").alias("payload"))
    return t


def _doc_objects(s: SparkSession, d: str) -> DataFrame:
    x = _docs(s, d)
    return x.select("doc_id", "payload", fid.md5_fid(F.col("payload")).alias("fid"), F.octet_length("payload").cast("long").alias("size"))


_DOCS_SQL = "docs AS (SELECT doc_id, text, md5(text) AS digest, substr(md5(text), 1, 16) AS hex, ('0x' || substr(md5(text), 1, 16))::UBIGINT AS ufid, octet_length(encode(text)) AS size FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)"


@query(f"WITH {_DOCS_SQL} SELECT doc_id, hex AS fid, min(doc_id) OVER (PARTITION BY hex) AS \"first\", doc_id <> min(doc_id) OVER (PARTITION BY hex) AS is_duplicate FROM docs")
def fid_dedup(s, d):
    x = writes.deduplicate(_doc_objects(s, d).select("doc_id", "fid"), "doc_id")
    return x.select("doc_id", hex_fid(F.col("fid")).alias("fid"), "first", "is_duplicate")


_ADDRESS_SQL = f"""
addr AS (SELECT doc_id, CAST(ceil(size / 4096.0) AS BIGINT) AS need, ufid, size, CASE WHEN size = 0 THEN 'empty' WHEN ceil(size / 4096.0) > {DOC_SLOTS} THEN 'too_large' END AS reason FROM docs),
placed AS (SELECT doc_id, need, reason, CASE WHEN reason IS NULL THEN CAST(ufid % CAST({DOC_SLOTS} - need + 1 AS UBIGINT) AS BIGINT) END AS slot FROM addr)
"""


@query(f"WITH {_DOCS_SQL}, {_ADDRESS_SQL} SELECT doc_id, slot, need, slot * 4096 + 268435456 AS addr, reason FROM placed")
def slot_address(s, d):
    x = _doc_objects(s, d).select("doc_id", address.address(F.lit(DOC_SLOTS).cast("long"), F.col("fid"), F.col("size")).alias("a"))
    return x.select("doc_id", "a.slot", "a.need", "a.addr", "a.reason")


@query(f"WITH {_DOCS_SQL} SELECT doc_id, CAST(ceil(size / 4096.0) * 4096 AS BIGINT) AS padded, TRUE AS zero_tail FROM docs")
def slot_padding(s, d):
    p = address.padded(F.col("payload"))
    tail = F.substring(p, F.octet_length("payload") + 1, F.octet_length(p) - F.octet_length("payload"))
    return _docs(s, d).select("doc_id", F.octet_length(p).cast("long").alias("padded"), parse.all_zero(tail).alias("zero_tail"))


def _ref_extents(s: SparkSession, d: str, slots: int = DISK_SLOTS) -> DataFrame:
    r = table(s, d, "refs").where("disk_id is not null and fid is not null and (target_fid is null or target_fid = fid)")
    r = r.groupBy("disk_id", "fid").agg(F.max(F.coalesce("stored_size", "size")).alias("size"))
    return placement.extents(r, F.lit(slots).cast("long"))


_EXTENTS_SQL = f"""
objs AS (SELECT disk_id, fid, max(coalesce(stored_size, size)) AS size FROM refs WHERE disk_id IS NOT NULL AND fid IS NOT NULL AND (target_fid IS NULL OR target_fid = fid) GROUP BY disk_id, fid),
needs AS (SELECT disk_id, fid, CAST(ceil(size / 4096.0) AS BIGINT) AS need, CAST(CASE WHEN fid < 0 THEN CAST(fid AS HUGEINT) + 18446744073709551616 ELSE CAST(fid AS HUGEINT) END AS UBIGINT) AS u FROM objs WHERE size > 0),
spots AS (SELECT disk_id, fid, need, CAST(u % CAST({DISK_SLOTS} - need + 1 AS UBIGINT) AS BIGINT) AS b FROM needs WHERE need <= {DISK_SLOTS}),
ext AS (SELECT disk_id, fid, b AS "start", b + need - 1 AS "end" FROM spots),
reach AS (SELECT *, max("end") OVER (PARTITION BY disk_id ORDER BY "start", "end", fid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end,
  lead("start") OVER (PARTITION BY disk_id ORDER BY "start", "end", fid) AS next_start FROM ext)
"""


@query(f'WITH {_EXTENTS_SQL} SELECT disk_id, fid, "start", "end" FROM reach WHERE previous_end >= "start" OR next_start <= "end"')
def extent_conflicts(s, d):
    return placement.contested(_ref_extents(s, d))


@query(f'WITH {_EXTENTS_SQL} SELECT disk_id, fid, "start", previous_end FROM reach WHERE "start" <= previous_end')
def occupancy_overlap(s, d):
    return placement.occupancy_violations(_ref_extents(s, d))


def _log(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "index_log")


def _live_sql() -> str:
    from .general import _LOG_SQL

    return _LOG_SQL


@query(f"WITH {_live_sql()} SELECT disk_id, fid, actual_fid AS target_fid, size, actual_size AS stored_size FROM last WHERE jump")
def alias_resolution(s, d):
    return changefeed.latest_records(_log(s, d)).where("jump").select("disk_id", "fid", F.col("actual_fid").alias("target_fid"), "size", F.col("actual_size").alias("stored_size"))


_KINDS_SQL = """
one AS (SELECT disk_id, seq, min(fid) AS fid, min(size) AS size, min(jump_code) AS code FROM index_log GROUP BY ALL),
fin AS (SELECT disk_id, min(seq) AS end_seq FROM one WHERE fid = 0 AND size = 0 AND code = 0 GROUP BY disk_id),
k AS (SELECT o.*, CASE WHEN code = 255 AND size = 72057594037927934 THEN 'anchor' WHEN code <> 0 AND size = 72057594037927935 THEN 'jump' WHEN code <> 0 THEN 'stray' WHEN size = 0 THEN 'tombstone' ELSE 'plain' END AS kind
  FROM one o LEFT JOIN fin f ON o.disk_id = f.disk_id WHERE f.end_seq IS NULL OR o.seq < f.end_seq)
"""


@query("WITH one AS (SELECT disk_id, seq, min(fid) AS fid, min(size) AS size, min(jump_code) AS code FROM index_log GROUP BY ALL) SELECT disk_id, min(seq) FILTER (WHERE fid = 0 AND size = 0 AND code = 0) AS end_seq FROM one GROUP BY disk_id")
def index_end(s, d):
    return indexlog.index_end(_log(s, d))


@query(f"WITH {_KINDS_SQL} SELECT disk_id, kind, count(*) AS entries FROM k GROUP BY ALL")
def entry_kinds(s, d):
    return indexlog.with_kind(_log(s, d)).groupBy("disk_id", "kind").agg(F.count(F.lit(1)).alias("entries"))


@query(f"""
WITH {_live_sql()},
k AS (SELECT *, CASE WHEN code = 255 AND size = 72057594037927934 THEN 'anchor' WHEN code <> 0 AND size = 72057594037927935 THEN 'jump' WHEN code <> 0 THEN 'stray' WHEN size = 0 THEN 'tombstone' ELSE 'plain' END AS kind FROM live),
solid AS (SELECT *, last_value(CASE WHEN kind <> 'tombstone' THEN kind END IGNORE NULLS) OVER (PARTITION BY disk_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k),
tails AS (SELECT disk_id, arg_max(kind, seq) AS kind, max(seq) AS seq, arg_max(fid, seq) AS fid FROM k WHERE kind <> 'tombstone' GROUP BY disk_id),
life AS (SELECT *, lag(put) OVER (PARTITION BY disk_id, fid ORDER BY pos) AS was FROM acts)
SELECT 'indicator_twice' AS rule, disk_id, seq, fid FROM solid WHERE before IN ('jump', 'anchor') AND kind IN ('jump', 'anchor')
UNION ALL SELECT 'stray_code', disk_id, seq, fid FROM solid WHERE kind = 'stray' AND coalesce(before NOT IN ('jump', 'anchor'), TRUE)
UNION ALL SELECT 'dangling', disk_id, seq, fid FROM tails WHERE kind IN ('jump', 'anchor')
UNION ALL SELECT 'duplicate_fid', disk_id, pos, fid FROM life WHERE put AND was AND NOT packed AND NOT jump""")
def replay_strict_violations(s, d):
    return indexlog.strict_violations(_log(s, d))


_COMPACT_SQL = """
e AS (SELECT disk_id, seq AS at_seq, 0 AS sub, fid, CASE WHEN packed THEN 72057594037927934 WHEN jump THEN 72057594037927935 ELSE actual_size END AS size, CASE WHEN packed OR jump THEN jump_code ELSE 0 END AS jump_code FROM last
  UNION ALL SELECT disk_id, seq, 1, actual_fid, actual_size, 0 FROM last WHERE packed OR jump)
"""


@query(f"WITH {_live_sql()}, {_COMPACT_SQL} SELECT disk_id, row_number() OVER (PARTITION BY disk_id ORDER BY at_seq, sub) AS seq, fid, size, jump_code FROM e")
def compact_entries(s, d):
    return indexlog.compact_entries(_log(s, d))


@query(f"""
WITH {_KINDS_SQL},
n AS (SELECT *, lead(kind) OVER (PARTITION BY disk_id ORDER BY seq) AS nk, coalesce(lag(kind) OVER (PARTITION BY disk_id ORDER BY seq) IN ('jump', 'anchor'), FALSE) AS opened FROM k),
c AS (SELECT disk_id, fid, count(*) AS n, max(seq) AS seq FROM n WHERE kind IN ('jump', 'anchor') OR (kind = 'plain' AND NOT opened) GROUP BY ALL)
SELECT kind AS rule, disk_id, seq, fid FROM n WHERE kind = 'tombstone'
UNION ALL SELECT 'stray_code', disk_id, seq, fid FROM n WHERE kind = 'stray'
UNION ALL SELECT 'broken_pair', disk_id, seq, fid FROM n WHERE kind IN ('jump', 'anchor') AND coalesce(nk, '') <> 'plain'
UNION ALL SELECT 'duplicate_fid', disk_id, seq, fid FROM c WHERE n > 1""")
def validate_compacted(s, d):
    return indexlog.validate_compacted(_log(s, d))


@query(f"WITH {_live_sql()} SELECT fid, count(DISTINCT disk_id) AS disks FROM last GROUP BY fid HAVING count(DISTINCT disk_id) > 1")
def cross_disk_duplicates(s, d):
    return indexlog.cross_disk_duplicates(changefeed.latest_records(_log(s, d)))


_WANTED_SQL = "w AS (SELECT DISTINCT disk_id, fid FROM refs WHERE fid % 100 = 0)"


@query(
    f"""WITH {_KINDS_SQL}, {_WANTED_SQL},
n AS (SELECT *, lag(fid) OVER o AS pf, lag(seq) OVER o AS ps, coalesce(lag(kind) OVER o = 'jump', FALSE) AS pend FROM k WINDOW o AS (PARTITION BY disk_id ORDER BY seq)),
bad AS (SELECT DISTINCT disk_id FROM n WHERE pend AND (code <> 0 OR size = 0)),
v AS (SELECT disk_id, pf AS fid, seq AS pos, 0 AS own, ps AS seq, size - 1 AS size, fid AS target_fid FROM n WHERE pend UNION ALL SELECT disk_id, fid, seq, 1, seq, size, fid FROM n WHERE kind <> 'jump'),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disk_id, fid ORDER BY pos DESC, own DESC) AS k FROM v) WHERE k = 1),
r AS (SELECT w.disk_id, w.fid, CASE WHEN b.disk_id IS NOT NULL THEN 'invalid_pair' WHEN coalesce(l.size, 0) = 0 THEN 'not_found' ELSE 'found' END AS status, l.size, l.target_fid, l.seq FROM w LEFT JOIN l ON l.disk_id = w.disk_id AND l.fid = w.fid LEFT JOIN bad b ON b.disk_id = w.disk_id)
SELECT disk_id, fid, status, CASE WHEN status = 'found' THEN size END AS size, CASE WHEN status = 'found' THEN target_fid END AS target_fid, CASE WHEN status = 'found' THEN seq END AS seq FROM r"""
)
def find_latest(s, d):
    """Point lookups of the refs whose fid is divisible by 100 (the query set) against the whole log."""
    return indexlog.find_latest(_log(s, d), table(s, d, "refs").where("fid % 100 = 0"))


@query(f"WITH {_live_sql()}, {_WANTED_SQL} SELECT w.disk_id, w.fid, CASE WHEN l.seq IS NULL THEN 'not_found' ELSE 'found' END AS status, l.size, l.actual_fid AS target_fid, l.seq FROM w LEFT JOIN last l ON w.disk_id = l.disk_id AND w.fid = l.fid")
def find_latest_lenient(s, d):
    """The same, bad pairs skipped."""
    return indexlog.find_latest(_log(s, d), table(s, d, "refs").where("fid % 100 = 0"), lenient=True)


def _ref_sizes(s: SparkSession, d: str) -> DataFrame:
    return placement.logical_sizes(table(s, d, "refs"))


_SIZES_SQL = """
sizes AS (SELECT disk_id, fid, max(coalesce(size, stored_size)) AS size FROM refs r WHERE (target_fid IS NULL OR target_fid = fid) AND NOT coalesce(packed, FALSE)
  AND NOT EXISTS (SELECT 1 FROM refs a WHERE a.disk_id = r.disk_id AND a.target_fid = r.fid AND a.target_fid <> a.fid AND NOT coalesce(a.packed, FALSE)) GROUP BY disk_id, fid),
bins AS (SELECT disk_id, CAST(length(bin(size)) - 1 AS INT) AS p, count(*) AS files FROM sizes WHERE size > 0 GROUP BY ALL)
"""


@query(f"WITH {_SIZES_SQL} SELECT disk_id, fid, size FROM sizes")
def logical_sizes(s, d):
    return _ref_sizes(s, d)


@query(
    f"""WITH {_SIZES_SQL}, grid AS (SELECT disk_id, unnest(range(max(p) + 1)) AS p FROM bins GROUP BY disk_id)
SELECT g.disk_id, CAST(g.p AS INT) AS pow, CAST(2 AS BIGINT) << CAST(g.p AS INT) AS upper, coalesce(b.files, 0) AS files, CAST(sum(coalesce(b.files, 0)) OVER (PARTITION BY g.disk_id ORDER BY g.p DESC) AS BIGINT) AS from_top
FROM grid g LEFT JOIN bins b ON g.disk_id = b.disk_id AND g.p = b.p"""
)
def frag_histogram(s, d):
    return trim.histogram(_ref_sizes(s, d), ["disk_id"])


@query(f"WITH {_SIZES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY disk_id ORDER BY files DESC, p) AS k FROM bins) SELECT disk_id, CAST(2 AS BIGINT) << p AS threshold, least(greatest(CAST(2 AS BIGINT) << p, 4096), 268435456) AS clamped FROM r WHERE k = 1")
def frag_threshold(s, d):
    x = trim.fragmentation_threshold(_ref_sizes(s, d), ["disk_id"])
    return x.withColumn("clamped", trim.clamp(F.col("threshold")))


def _eligible(s: SparkSession, d: str) -> DataFrame:
    return trim.eligible(changefeed.latest_records(_log(s, d)), table(s, d, "packed"))


_ELIGIBLE_SQL = """
eli AS (SELECT disk_id, fid, seq, size FROM last l WHERE NOT jump AND NOT packed
  AND NOT EXISTS (SELECT 1 FROM last j WHERE j.jump AND j.disk_id = l.disk_id AND j.actual_fid = l.fid)
  AND NOT EXISTS (SELECT 1 FROM packed p WHERE p.disk_id = l.disk_id AND (p.container_fid = l.fid OR p.table_fid = l.fid))),
lim AS (SELECT disk_id, last_threshold_bytes AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY disk_id ORDER BY last_check_at DESC NULLS LAST, last_threshold_bytes DESC NULLS LAST) AS rn FROM trim_status WHERE disk_id IS NOT NULL) WHERE rn = 1),
small AS (SELECT e.*, l.threshold FROM eli e JOIN lim l ON e.disk_id = l.disk_id WHERE e.size < l.threshold AND e.size > 0),
laid AS (SELECT *, CAST(sum(size) OVER (PARTITION BY disk_id ORDER BY seq ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS byte_offset FROM small)
"""


@query(f"WITH {_live_sql()}, {_ELIGIBLE_SQL} SELECT disk_id, fid, seq, size FROM eli")
def trim_eligible(s, d):
    return _eligible(s, d).select("disk_id", "fid", "seq", "size")


def _thresholds(s: SparkSession, d: str) -> DataFrame:
    return broadcast_if_small(consolidate.latest_thresholds(table(s, d, "trim_status")).select("disk_id", "threshold"))


@query(f"WITH {_live_sql()}, {_ELIGIBLE_SQL} SELECT e.disk_id, l.threshold, count(*) AS total_files, count(*) FILTER (WHERE e.size < l.threshold) AS small_files, count(*) FILTER (WHERE e.size < l.threshold) > 100 AND count(*) FILTER (WHERE e.size < l.threshold) > count(*) * 0.2 AS fires FROM eli e JOIN lim l ON e.disk_id = l.disk_id GROUP BY ALL")
def trim_trigger(s, d):
    return trim.trigger(_eligible(s, d), _thresholds(s, d))


def _batch(s: SparkSession, d: str) -> DataFrame:
    small = _eligible(s, d).join(_thresholds(s, d), "disk_id").where("size < threshold").select("disk_id", "fid", "seq", "size")
    return trim.batch(small, TRIM_BYTES, ["disk_id"])


@query(f"WITH {_live_sql()}, {_ELIGIBLE_SQL} SELECT disk_id, fid, seq, size, byte_offset FROM laid WHERE byte_offset + size <= {TRIM_BYTES} OR byte_offset = 0")
def trim_batch(s, d):
    """The candidates of one trim pass per disk, and where each lies in the container to be written."""
    return _batch(s, d).select("disk_id", "fid", "seq", "size", "byte_offset")


@query(
    """WITH e AS (SELECT DISTINCT disk_id, table_fid, container_fid, container_size, unnest(entries) AS e FROM packed)
SELECT DISTINCT disk_id, table_fid, container_fid, e.fid AS fid, e.byte_offset AS byte_offset, e.size AS size FROM e WHERE e.size > 0 AND e.byte_offset + e.size <= container_size"""
)
def packed_read(s, d):
    """Where every packed object's bytes lie."""
    return consolidate.valid_entries(table(s, d, "packed")).select("disk_id", "table_fid", "container_fid", "fid", "byte_offset", "size").distinct()


_SCRUB_SQL = """
t AS (SELECT disk_id, table_fid, container_size, coalesce(len(entries), 0) AS n, len(list_filter(entries, lambda x: coalesce(x.size, 0) <= 0)) AS bad_size,
    len(list_filter(entries, lambda x: coalesce(x.byte_offset + x.size > container_size, TRUE))) AS bad_range,
    len(list_filter(entries, lambda x: coalesce(x.size, 0) <= 0 OR coalesce(x.byte_offset + x.size > container_size, TRUE))) AS bad
  FROM (SELECT *, row_number() OVER (PARTITION BY disk_id, table_fid ORDER BY container_size DESC, container_fid DESC, len(entries) DESC) AS k FROM packed) WHERE k = 1),
st AS (SELECT disk_id, fid, max(coalesce(stored_size, size)) AS stored FROM refs GROUP BY ALL),
scrub AS (SELECT t.disk_id, t.table_fid, st.stored, n AS entries, bad AS bad_entries,
  CASE WHEN st.stored IS NULL THEN 'no_ref' WHEN coalesce(container_size, 0) <= 0 THEN 'container_size' WHEN st.stored <> 48 + 24 * n THEN 'length' WHEN bad_size > 0 THEN 'entry_size' WHEN bad_range > 0 THEN 'entry_range' END AS reason
  FROM t LEFT JOIN st ON t.disk_id = st.disk_id AND t.table_fid = st.fid)
"""


@query(f"WITH {_SCRUB_SQL} SELECT * FROM scrub")
def packed_scrub(s, d):
    return indexlog.scrub(table(s, d, "packed"), table(s, d, "refs"))


@query(f"WITH {_live_sql()}, {_SCRUB_SQL} SELECT disk_id, fid, seq, packed FROM last l WHERE NOT packed OR NOT EXISTS (SELECT 1 FROM scrub x WHERE x.reason IS NOT NULL AND x.disk_id = l.disk_id AND x.table_fid = l.fid)")
def scrub_fix(s, d):
    return indexlog.scrub_fix(changefeed.latest_records(_log(s, d)), indexlog.scrub(table(s, d, "packed"), table(s, d, "refs"))).select("disk_id", "fid", "seq", "packed")


def _doc_ranges(s: SparkSession, d: str) -> DataFrame:
    return _doc_objects(s, d).select(F.col("doc_id").alias("req_id"), F.col("doc_id").alias("fid"), (F.col("doc_id") % 97).alias("range_start"), (F.col("doc_id") % 1000).alias("range_end"), "payload")


@query(
    f"""WITH {_DOCS_SQL}, r AS (SELECT doc_id AS req_id, encode(text) AS b, size, doc_id % 97 AS s, CASE WHEN doc_id % 1000 = 0 OR doc_id % 1000 > size THEN size ELSE doc_id % 1000 END AS e FROM docs)
SELECT req_id, CASE WHEN s > e THEN 'invalid_argument' ELSE 'ok' END AS status, CASE WHEN s <= e THEN s END AS "start", CASE WHEN s <= e THEN e END AS "end",
  CASE WHEN s <= e THEN substr(hex(b), 2 * s + 1, 2 * (e - s)) END AS data FROM r"""
)
def range_read(s, d):
    """A byte range of every document, as hex."""
    x = _doc_ranges(s, d)
    g = reads.get(x.drop("payload"), x.select("fid", "payload"))
    return g.select("req_id", "status", "start", "end", F.hex("data").alias("data"))


@query(
    f"""WITH {_DOCS_SQL}, m AS (SELECT doc_id, size, unnest(range(greatest(CAST(ceil(size / 1024.0) AS BIGINT), 1))) AS k FROM docs)
SELECT doc_id AS req_id, k AS msg, k * 1024 AS "start", least(k * 1024 + 1024, size) AS "end" FROM m"""
)
def range_messages(s, d):
    """Every document in messages of 1 KiB."""
    r = _doc_objects(s, d).select(F.col("doc_id").alias("req_id"), F.lit("ok").alias("status"), F.lit(0).cast("long").alias("start"), F.col("size").alias("end"))
    return reads.messages(r, 1024)


def _puts(s: SparkSession, d: str) -> DataFrame:
    """Put requests, each seq once."""
    p = table(s, d, "put_requests").where("seq is not null").groupBy("seq").agg(F.min(F.struct("fid", "total_size", "alias_for")).alias("r"))
    return p.select("seq", "r.*")


_PUTS_SQL = "puts AS (SELECT DISTINCT seq, fid, total_size, alias_for FROM put_requests WHERE seq IS NOT NULL)"


@query(
    f"""WITH {_PUTS_SQL}, k AS (SELECT fid, max(coalesce(size, stored_size)) AS size FROM refs GROUP BY fid)
SELECT p.seq AS req_id, p.fid, k.size, CASE WHEN k.size IS NULL THEN 'not_found' ELSE 'ok' END AS status FROM puts p LEFT JOIN k ON p.fid = k.fid"""
)
def head_lookup(s, d):
    return reads.head(_puts(s, d).withColumnRenamed("seq", "req_id"), table(s, d, "refs"))


@query(f"WITH {_PUTS_SQL} SELECT seq, fid FROM puts WHERE fid IN (SELECT fid FROM stored_fids WHERE fid IS NOT NULL)")
def existence_semi(s, d):
    return reads.exists(_puts(s, d).select("seq", "fid"), table(s, d, "stored_fids"))


@query(f"WITH {_PUTS_SQL} SELECT seq, fid FROM puts p WHERE NOT EXISTS (SELECT 1 FROM stored_fids s WHERE s.fid = p.fid)")
def existence_anti(s, d):
    return reads.missing(_puts(s, d).select("seq", "fid"), table(s, d, "stored_fids"))


@query(f"WITH {_PUTS_SQL} SELECT seq, CASE WHEN total_size > 16777216 THEN 'cdc' ELSE 'atomic' END AS path FROM puts")
def route_dual_path(s, d):
    return _puts(s, d).select("seq", writes.path_of(F.col("total_size")).alias("path"))


_ADMIT_SQL = """
f AS (SELECT *, CASE WHEN fid IS NULL THEN 'no_fid' WHEN total_size IS NULL OR total_size <= 0 THEN 'empty' WHEN alias_for <> 0 AND alias_for = fid THEN 'self_alias'
  WHEN alias_for <> 0 AND total_size < 2 THEN 'alias_too_small' WHEN total_size > 268435456 THEN 'too_large' END AS fault FROM puts),
w AS (SELECT fid, min(seq) AS seq FROM f WHERE fault IS NULL AND fid NOT IN (SELECT fid FROM stored_fids WHERE fid IS NOT NULL) GROUP BY fid)
"""


@query(f"WITH {_PUTS_SQL}, {_ADMIT_SQL} SELECT f.seq, f.fid, CASE WHEN fault IS NOT NULL THEN 'invalid_argument:' || fault WHEN w.seq IS NOT NULL THEN 'ok' ELSE 'already_exists' END AS status FROM f LEFT JOIN w ON f.seq = w.seq")
def put_batch(s, d):
    return writes.admit(table(s, d, "put_requests"), table(s, d, "stored_fids"))


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks")


def _cdc_sql() -> str:
    """FastCDC of the documents: the gear hash in doublings over neighbouring bytes, then cut after cut."""
    gear = ", ".join(f"{x}::UBIGINT" for x in chunking.gear_table().tolist())
    least, target, most = CDC
    bits = target.bit_length() - 1
    mask = lambda n: f"{((1 << n) - 1) << (64 - n)}::UBIGINT"
    steps = f"gear0 AS (SELECT doc_id, i, ([{gear}])[CAST(('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2))::BIGINT + 1 AS BIGINT)] AS x FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(size)) AS i FROM docs))"
    for k in range(6):
        n = 1 << k
        steps += f",\ngear{k + 1} AS (SELECT doc_id, i, CAST((x::UHUGEINT + coalesce(lag(x, {n}) OVER (PARTITION BY doc_id ORDER BY i), 0)::UHUGEINT * {1 << n}::UHUGEINT % {1 << 64}::UHUGEINT) % {1 << 64}::UHUGEINT AS UBIGINT) AS x FROM gear{k})"
    return f"""{steps},
easy AS (SELECT doc_id, list(i + 1 ORDER BY i) AS l FROM gear6 WHERE x & {mask(bits - chunking.NORMAL)} = 0 GROUP BY doc_id),
hard AS (SELECT doc_id, list(i + 1 ORDER BY i) AS l FROM gear6 WHERE x & {mask(bits + chunking.NORMAL)} = 0 GROUP BY doc_id),
marks AS (SELECT d.doc_id, d.size, coalesce(e.l, []) AS e, coalesce(h.l, []) AS h FROM docs d LEFT JOIN easy e ON e.doc_id = d.doc_id LEFT JOIN hard h ON h.doc_id = d.doc_id WHERE d.size > 0),
cuts(doc_id, idx, a, b) AS (SELECT doc_id, -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM marks
  UNION ALL SELECT c.doc_id, idx + 1, c.b, CASE WHEN m.size - c.b <= {least} THEN m.size ELSE
    coalesce(list_filter(h, lambda x: x >= c.b + {least} AND x < least(c.b + {target}, m.size))[1], list_filter(e, lambda x: x >= greatest(least(c.b + {target}, m.size), c.b + {least}) AND x <= least(c.b + {most}, m.size))[1], least(c.b + {most}, m.size)) END
  FROM cuts c JOIN marks m ON m.doc_id = c.doc_id WHERE c.b < m.size)"""


@query(f"WITH RECURSIVE {_DOCS_SQL}, {_cdc_sql()} SELECT c.doc_id AS file_id, idx, md5(unhex(substr(hex(encode(text)), CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)))) AS digest, a AS byte_offset, b - a AS size FROM cuts c JOIN docs d ON d.doc_id = c.doc_id WHERE idx >= 0")
def cdc_chunks(s, d):
    x = _docs(s, d).withColumnRenamed("doc_id", "file_id")
    return chunking.chunk(x, *CDC).select("file_id", "idx", F.md5("payload").alias("digest"), "byte_offset", "size")


@query(
    f"""WITH {_DOCS_SQL}, c AS (SELECT doc_id, hex(encode(text)) AS h, size, unnest(range(CAST(ceil(size / {FIXED}.0) AS BIGINT))) AS k FROM docs WHERE size > 0)
SELECT doc_id AS file_id, CAST(k AS INT) AS idx, k * {FIXED} AS byte_offset, least(size - k * {FIXED}, {FIXED}) AS size, substr(h, CAST(2 * k * {FIXED} + 1 AS BIGINT), 16) AS head FROM c"""
)
def fixed_chunks(s, d):
    x = chunking.fixed_chunks(_docs(s, d).withColumnRenamed("doc_id", "file_id"), FIXED)
    return x.select("file_id", "idx", "byte_offset", "size", F.substring(F.hex("payload"), 1, 16).alias("head"))


_CHUNK_SQL = "one AS (SELECT file_id, idx, max(fid) AS fid, max(byte_offset) AS byte_offset, max(size) AS size FROM chunks WHERE file_id IS NOT NULL AND idx IS NOT NULL GROUP BY ALL)"


def _whole_chunks(s: SparkSession, d: str) -> DataFrame:
    """One row per chunk, nulls of one copy filled from another."""
    c = _chunks(s, d).where("file_id is not null and idx is not null")
    return c.groupBy("file_id", "idx").agg(*(F.max(k).alias(k) for k in ("fid", "byte_offset", "size")))


@query(f"WITH {_CHUNK_SQL} SELECT file_id, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS chunks FROM one GROUP BY file_id")
def manifest_build(s, d):
    return chunking.manifests(_whole_chunks(s, d)).select("file_id", "total_size", F.size("chunks").cast("long").alias("chunks"))


@query(f"WITH {_CHUNK_SQL} SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY byte_offset NULLS FIRST, idx) - 1 AS no, fid, byte_offset, size FROM one")
def manifest_inspect(s, d):
    return chunking.inspect(chunking.manifests(_whole_chunks(s, d)))


@query(
    f"""WITH {_CHUNK_SQL}, f AS (SELECT file_id, CAST(sum(size) AS BIGINT) AS total FROM one GROUP BY file_id),
r AS (SELECT o.*, row_number() OVER (PARTITION BY o.file_id ORDER BY byte_offset NULLS FIRST, idx) - 1 AS no, f.file_id % 5000 AS s, least(f.file_id % 5000 + 9000, total) AS e FROM one o JOIN f ON o.file_id = f.file_id)
SELECT file_id AS req_id, file_id, no, fid, greatest(s, byte_offset) - byte_offset AS skip, least(e, byte_offset + size) - greatest(s, byte_offset) AS take FROM r WHERE least(e, byte_offset + size) > greatest(s, byte_offset) AND byte_offset IS NOT NULL AND size IS NOT NULL"""
)
def sparse_range(s, d):
    """9,000 bytes from the middle of every file: the chunks to fetch and which of their bytes."""
    m = chunking.manifests(_whole_chunks(s, d))
    r = m.select(F.col("file_id").alias("req_id"), "file_id", (F.col("file_id") % 5000).alias("range_start"), (F.col("file_id") % 5000 + 9000).alias("range_end"))
    return chunking.sparse_range(m, r)


@query(
    f"""WITH {_CHUNK_SQL}, x AS (SELECT *, CAST(coalesce(sum(coalesce(size, 0)) OVER (PARTITION BY file_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS expected FROM one)
SELECT file_id, idx, byte_offset, expected FROM x WHERE byte_offset IS NOT NULL AND byte_offset <> expected"""
)
def chunk_contiguity(s, d):
    return chunking.contiguity_faults(_chunks(s, d))


@query(
    """WITH one AS (SELECT file_id, idx, max(size) AS size FROM chunks GROUP BY ALL), t AS (SELECT file_id, max(byte_offset + size) AS total FROM chunks GROUP BY file_id),
g AS (SELECT file_id, count(*) AS parts, min(idx) AS lo, max(idx) AS hi, CAST(coalesce(sum(size), 0) AS BIGINT) AS bytes FROM one GROUP BY file_id)
SELECT t.file_id AS id, parts, bytes, total, CASE WHEN lo <> 0 OR hi + 1 <> parts THEN 'gap' WHEN bytes < total THEN 'short' WHEN bytes > total THEN 'long' END AS fault FROM t JOIN g ON t.file_id = g.file_id"""
)
def stream_faults(s, d):
    """Files in parts against the end of their last part: gaps, short and long ones."""
    c = _chunks(s, d)
    totals = c.groupBy(F.col("file_id").alias("id")).agg(F.max(F.col("byte_offset") + F.col("size")).alias("total"))
    return writes.stream_faults(c.select(F.col("file_id").alias("id"), "idx", "size"), totals)


@query("WITH a AS (SELECT DISTINCT fid FROM chunks WHERE fid IS NOT NULL), b AS (SELECT DISTINCT fid FROM stored_fids WHERE fid IS NOT NULL) SELECT count(*) AS chunks, count(b.fid) AS found, count(b.fid) / greatest(count(*), 1)::DOUBLE AS ratio FROM a LEFT JOIN b ON a.fid = b.fid")
def dedup_ratio(s, d):
    """How much of the chunks' content was stored before."""
    return chunking.dedup_ratio(_chunks(s, d), table(s, d, "stored_fids"))


# Two catalogs of the same disks: those that ever trimmed, and those whose trim was triggered, on a partition now.
_POOLS_SQL = """
old AS (SELECT disk_id, min(device_path) AS device_path FROM trim_status WHERE last_success_at IS NOT NULL GROUP BY disk_id),
run AS (SELECT disk_id, min(device_path) || CASE WHEN bool_or(last_error IS NOT NULL) THEN 'p1' ELSE '' END AS device_path FROM trim_status WHERE last_trigger GROUP BY disk_id)
"""


def _pools(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(s, d, "trim_status")
    old = t.where("last_success_at is not null").groupBy("disk_id").agg(F.min("device_path").alias("device_path"))
    suffix = F.when(F.bool_or(F.col("last_error").isNotNull()), "p1").otherwise("")
    return old, t.where("last_trigger").groupBy("disk_id").agg(F.concat(F.min("device_path"), suffix).alias("device_path"))


@query(f"WITH {_POOLS_SQL} SELECT coalesce(o.disk_id, r.disk_id) AS disk_id, coalesce(r.device_path, o.device_path) AS device_path, r.device_path IS NOT NULL AND r.device_path IS DISTINCT FROM o.device_path AS changed FROM old o FULL OUTER JOIN run r ON o.disk_id = r.disk_id")
def pan_merge(s, d):
    return catalog.merge_pool(*_pools(s, d))


@query(
    f"""WITH {_POOLS_SQL}, conf AS (SELECT DISTINCT disk_id FROM trim_status), snap AS (SELECT disk_id, min(last_container_fid) AS path FROM trim_status WHERE last_container_fid IS NOT NULL GROUP BY disk_id),
ordy AS (SELECT disk_id, min(device_path) AS device_path FROM trim_status WHERE last_threshold_bytes >= 65536 GROUP BY disk_id),
ids AS (SELECT disk_id FROM conf UNION SELECT disk_id FROM snap),
x AS (SELECT coalesce(i.disk_id, o.disk_id) AS disk_id, l.device_path AS live, s.path AS snap, o.device_path AS ord FROM ids i LEFT JOIN run l ON i.disk_id = l.disk_id LEFT JOIN snap s ON i.disk_id = s.disk_id FULL OUTER JOIN ordy o ON i.disk_id = o.disk_id)
SELECT disk_id, CASE WHEN ord IS NOT NULL AND (live IS NOT NULL OR snap IS NOT NULL) THEN 'conflict' WHEN ord IS NOT NULL THEN 'ordinary' WHEN live IS NOT NULL THEN 'live' WHEN snap IS NOT NULL THEN 'snapshot' ELSE 'missing' END AS source,
  coalesce(ord, live, snap) AS device_path, ord IS NULL AND live IS NULL AND snap IS NULL AS warning FROM x"""
)
def restore_pool(s, d):
    """Every disk checked is configured; those triggered are live, those with a container have a snapshot, those of large thresholds are ordinary."""
    t = table(s, d, "trim_status")
    snaps = t.where("last_container_fid is not null").groupBy("disk_id").agg(F.min("last_container_fid").alias("path"))
    return catalog.restore_pool(t.select("disk_id").distinct(), _pools(s, d)[1], snaps, t.where("last_threshold_bytes >= 65536").select("disk_id", "device_path"))


@query(
    """WITH n AS (SELECT disk_id, last_total_files, last_small_files, row_number() OVER (PARTITION BY disk_id ORDER BY last_check_at DESC NULLS LAST, last_total_files DESC NULLS LAST, last_small_files DESC NULLS LAST) AS k FROM trim_status),
c AS (SELECT disk_id, coalesce(last_total_files, -1) AS size_bytes, sha256(CAST(disk_id AS VARCHAR) || '/' || coalesce(last_total_files, -1)) AS sha256, k FROM n)
SELECT a.disk_id, a.size_bytes, a.sha256 FROM c a WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM c b WHERE b.k > 1 AND b.disk_id = a.disk_id AND b.size_bytes = a.size_bytes AND b.sha256 = a.sha256)"""
)
def snapshot_changed(s, d):
    """Disks whose newest state is none of those recorded before."""
    from pyspark.sql.window import Window as W

    t = table(s, d, "trim_status")
    k = F.row_number().over(W.partitionBy("disk_id").orderBy(F.col("last_check_at").desc_nulls_last(), F.col("last_total_files").desc_nulls_last(), F.col("last_small_files").desc_nulls_last()))
    n = F.coalesce("last_total_files", F.lit(-1))
    x = t.select("disk_id", n.alias("size_bytes"), F.sha2(F.concat_ws("/", F.col("disk_id").cast("string"), n.cast("string")).cast("binary"), 256).alias("sha256"), k.alias("k"))
    return catalog.changed_snapshots(x.where("k = 1").drop("k"), x.where("k > 1"))


@query("SELECT DISTINCT disk_id, device_path, regexp_matches('/' || device_path, '/zram[0-9]+$') AS is_zram FROM trim_status")
def zram_tier(s, d):
    return table(s, d, "trim_status").select("disk_id", "device_path", parse.is_zram_path(F.col("device_path")).alias("is_zram")).distinct()
