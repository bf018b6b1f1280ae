"""Queries of the pool: who may write, where it goes, and what puts find in their way, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address
from ..functions.fid import md5_fid
from ..operators import placement, writes
from ..sources.tables import table
from .store import _DOCS_SQL, _PUTS_SQL, _U, DISK_SLOTS, _doc_objects, _puts, _ref_extents, query
from .xxh3_sql import xxh3_sql

#: Slots of the disks of the pool, and of the disk on which puts jump; jumps tried there.
POOL_SLOTS = 1 << 20
JUMP_SLOTS = 1 << 14
JUMPS = 8

def _extents_sql(slots: int, name: str = "ext") -> str:
    return f"""
objs AS (SELECT disk_id, fid, max(coalesce(stored_size, size)) AS size FROM refs WHERE disk_id IS NOT NULL AND fid IS NOT NULL AND (target_fid IS NULL OR target_fid = fid) GROUP BY disk_id, fid),
needs AS (SELECT disk_id, fid, CAST(ceil(size / 4096.0) AS BIGINT) AS need, {_U('fid')} AS u FROM objs WHERE size > 0),
spots AS (SELECT disk_id, fid, need, CAST(u % CAST({slots} - need + 1 AS UBIGINT) AS BIGINT) AS b FROM needs WHERE need <= {slots}),
{name} AS (SELECT disk_id, fid, b AS "start", b + need - 1 AS "end" FROM spots)"""


def _chd_sql(slots: int) -> str:
    """room (disk_id, chd): the binary search over the 64 sample fids of every disk with an extent in ext."""
    samples = f"""SELECT {{'d': disk_id, 'i': i}} AS id, hex(encode('chd:' || {_U('disk_id')} || ':' || i)) AS h FROM (SELECT DISTINCT disk_id FROM ext), range(64) r(i)"""
    return f"""
{xxh3_sql(samples)},
smp AS (SELECT id.d AS disk_id, id.i AS i, u FROM x3),
bs(disk_id, low, high, best) AS (SELECT DISTINCT disk_id, CAST(1 AS BIGINT), CAST({slots} AS BIGINT), CAST(0 AS BIGINT) FROM ext
  UNION ALL SELECT disk_id, CASE WHEN ok THEN mid + 1 ELSE low END, CASE WHEN ok THEN high ELSE mid - 1 END, CASE WHEN ok THEN mid ELSE best END
  FROM (SELECT disk_id, low, high, best, mid, count(*) FILTER (WHERE NOT hit) >= 13 AS ok
    FROM (SELECT t.disk_id, low, high, best, mid, i, bool_or(e.disk_id IS NOT NULL) AS hit
      FROM (SELECT bs.*, (low + high) // 2 AS mid, i, CAST(u % CAST({slots} - (low + high) // 2 + 1 AS UBIGINT) AS BIGINT) AS b FROM bs JOIN smp ON bs.disk_id = smp.disk_id WHERE low <= high) t
      LEFT JOIN ext e ON e.disk_id = t.disk_id AND e."start" <= b + mid - 1 AND e."end" >= b GROUP BY ALL) GROUP BY ALL)),
room AS (SELECT disk_id, best * 4096 AS chd FROM bs WHERE low > high)"""


def _room(s: SparkSession, d: str, slots: int) -> DataFrame:
    e = _ref_extents(s, d, slots).where("start is not null")
    return placement.chd(e.select("disk_id").distinct().withColumn("slots", F.lit(slots).cast("long")), e)


@query(f"WITH RECURSIVE {_extents_sql(DISK_SLOTS)}, {_chd_sql(DISK_SLOTS)} SELECT disk_id, chd FROM room")
def chd_estimate(s, d):
    """Room estimate of every disk over the extents of its refs."""
    return _room(s, d, DISK_SLOTS)


def _disks(s: SparkSession, d: str) -> DataFrame:
    """The disks with refs as a pool: room by their extents, every third a RAM disk, those with an unnamed check faulted."""
    t = table(s, d, "trim_status").groupBy("disk_id").agg(F.bool_or(F.col("last_error").isNotNull()).alias("failed"))
    r = _room(s, d, POOL_SLOTS).join(t, "disk_id", "left")
    return r.select("disk_id", F.pmod("disk_id", F.lit(1_000_003)).cast("int").alias("pool_pos"), (F.pmod("disk_id", F.lit(3)) == 0).alias("is_zram"), (F.coalesce("failed", F.lit(False)) & (F.pmod("disk_id", F.lit(5)) == 0)).alias("faulted"), F.lit(POOL_SLOTS).cast("long").alias("slots"), "chd")


_DISKS_SQL = f"""
{_extents_sql(POOL_SLOTS)}, {_chd_sql(POOL_SLOTS)},
failed AS (SELECT disk_id, bool_or(last_error IS NOT NULL) AS failed FROM trim_status GROUP BY disk_id),
disks AS (SELECT r.disk_id, (r.disk_id % 1000003 + 1000003) % 1000003 AS pool_pos, (r.disk_id % 3 + 3) % 3 = 0 AS is_zram, coalesce(failed, FALSE) AND r.disk_id % 5 = 0 AS faulted, CAST({POOL_SLOTS} AS BIGINT) AS slots, chd
  FROM room r LEFT JOIN failed f ON r.disk_id = f.disk_id)
"""

_ROUTE_SQL = f"""
{_PUTS_SQL}, {_DISKS_SQL}, sz AS (SELECT DISTINCT total_size AS size FROM puts WHERE total_size > 0),
c AS (SELECT z.size, d.*, chd >= z.size AS fits FROM sz z, disks d WHERE NOT faulted AND z.size <= slots * 4096),
zr AS (SELECT size, disk_id AS z FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY chd, pool_pos, disk_id) AS k FROM c WHERE is_zram AND fits AND size < 262144) WHERE k = 1),
od AS (SELECT size, disk_id AS b FROM (SELECT *, row_number() OVER (PARTITION BY size ORDER BY fits DESC, CASE WHEN fits THEN chd ELSE -chd END, pool_pos, disk_id) AS k FROM c WHERE NOT is_zram) WHERE k = 1)
"""


@query(f"WITH RECURSIVE {_ROUTE_SQL} SELECT p.seq AS req_id, p.total_size AS size, coalesce(zr.z, od.b) AS disk_id, CASE WHEN zr.z IS NOT NULL THEN 'zram' WHEN od.b IS NOT NULL THEN 'disk' END AS tier FROM puts p LEFT JOIN zr ON p.total_size = zr.size LEFT JOIN od ON p.total_size = od.size")
def tier_route(s, d):
    r = _puts(s, d).select(F.col("seq").alias("req_id"), F.col("total_size").alias("size"))
    return placement.route(r, _disks(s, d), address.small_file_bytes(6))


@query(f"WITH RECURSIVE {_DISKS_SQL}, m AS (SELECT coalesce(max(least(chd, 268435456)), 0) AS room FROM disks WHERE NOT is_zram AND NOT faulted) SELECT CAST(CASE WHEN room > 0 THEN length(bin(room)) - 1 ELSE 0 END AS INT) AS ch_d_pow2, CAST(1 AS BIGINT) << CAST(CASE WHEN room > 0 THEN length(bin(room)) - 1 ELSE 0 END AS INT) AS bytes FROM m")
def bonnie(s, d):
    return placement.bonnie(_disks(s, d))


def _catalog(s: SparkSession, d: str) -> DataFrame:
    """The disks of trim_status with as many slots as the threshold of their last check says, some of them none."""
    t = table(s, d, "trim_status").where("disk_id is not null").groupBy("disk_id").agg(F.max("last_threshold_bytes").alias("t"), F.max("last_total_files").alias("n"), F.bool_or(F.col("last_error").isNotNull()).alias("failed"))
    return t.select("disk_id", F.floor(F.col("t") / 4096 - 1).cast("long").alias("slots"), F.col("failed").alias("faulted"), F.coalesce("n", F.lit(0)).alias("n"))


_CATALOG_SQL = "cat AS (SELECT disk_id, CAST(floor(max(last_threshold_bytes) / 4096.0 - 1) AS BIGINT) AS slots, bool_or(last_error IS NOT NULL) AS faulted, coalesce(max(last_total_files), 0) AS n FROM trim_status WHERE disk_id IS NOT NULL GROUP BY disk_id)"


@query(f"WITH {_CATALOG_SQL} SELECT disk_id, n > 0 AND n <= slots * 4096 AND NOT faulted AS writable FROM cat")
def can_write(s, d):
    """Whether each disk could hold an object of as many bytes as it has files."""
    return _catalog(s, d).select("disk_id", placement.can_write(F.col("n"), F.col("slots"), F.col("faulted")).alias("writable"))


_FINE = "coalesce(bool_and(slots >= 1 AND NOT faulted)"


@query(f"WITH {_CATALOG_SQL} SELECT TRUE AS faulted, {_FINE} FILTER (WHERE faulted), FALSE) AS ok FROM cat UNION ALL SELECT FALSE, {_FINE} FILTER (WHERE NOT faulted), FALSE) FROM cat UNION ALL SELECT NULL, {_FINE}, FALSE) FROM cat")
def health(s, d):
    """Health of the pool of faulted disks, of that of sound ones, and of all."""
    c = _catalog(s, d)
    part = lambda f, df: placement.health(df).select(F.lit(f).cast("boolean").alias("faulted"), "ok")
    return part(True, c.where("faulted")).unionByName(part(False, c.where("not faulted"))).unionByName(part(None, c))


@query(f"WITH {_CATALOG_SQL} SELECT count(*) AS disks, count(*) * 16776960 AS max_entries, count(*) * 16776960 * 64 AS max_ram_bytes FROM cat")
def index_capacity(s, d):
    return placement.index_capacity(_catalog(s, d))


@query(
    f"""WITH RECURSIVE {_PUTS_SQL}, k AS (SELECT seq, fid AS key FROM puts WHERE fid IS NOT NULL UNION SELECT seq, alias_for FROM puts WHERE alias_for <> 0),
n AS (SELECT seq, key, count(*) OVER (PARTITION BY seq) AS n FROM k),
early AS (SELECT key, min(seq) AS seq FROM n WHERE n = 1 GROUP BY key),
late AS (SELECT DISTINCT n.seq FROM n LEFT JOIN early e ON n.key = e.key WHERE e.seq < n.seq OR n.key IN (SELECT fid FROM stored_fids WHERE fid IS NOT NULL)),
free AS (SELECT * FROM n WHERE seq NOT IN (SELECT seq FROM late)),
meet AS (SELECT DISTINCT key FROM free WHERE n = 2),
hard AS (SELECT seq, list(key) AS keys, row_number() OVER (ORDER BY seq) AS rn FROM free WHERE n = 2 OR key IN (SELECT key FROM meet) GROUP BY seq),
f(rn, seq, won, held) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), FALSE, CAST([] AS BIGINT[])
  UNION ALL SELECT h.rn, h.seq, NOT list_has_any(held, keys), CASE WHEN list_has_any(held, keys) THEN held ELSE list_concat(held, keys) END FROM f JOIN hard h ON h.rn = f.rn + 1),
ok AS (SELECT seq FROM f WHERE won UNION SELECT seq FROM free WHERE n = 1 AND key NOT IN (SELECT key FROM meet))
SELECT seq, seq IN (SELECT seq FROM ok) AS granted FROM puts"""
)
def put_gate(s, d):
    return writes.gate(_puts(s, d), table(s, d, "stored_fids")).select("seq", "granted")


def _fold_sql(slots: int, jumps: int) -> str:
    """Puts of the documents one after another on one disk, with jumps under the md5 of the text and one byte."""
    return f"""
reqs AS (SELECT row_number() OVER (ORDER BY doc_id) AS rn, doc_id AS seq, size,
  list_transform(range({jumps + 1}), lambda j: {{'j': j, 'u': CASE WHEN j = 0 THEN ufid ELSE ('0x' || substr(md5(encode(text) || unhex(printf('%02x', j))), 1, 16))::UBIGINT END, 'need': CAST(ceil((size + least(j, 1)) / 4096.0) AS BIGINT)}}) AS tries FROM docs),
spots AS (SELECT rn, seq, size, tries[1].u AS own, CASE WHEN size = 0 THEN 'empty' WHEN ceil(size / 4096.0) > {slots} THEN 'too_large' END AS reason,
  list_transform(list_filter(tries, lambda t: t.need <= {slots} AND t.need > 0), lambda t: {{'j': t.j, 'u': t.u, 'a': CAST(t.u % CAST({slots} - t.need + 1 AS UBIGINT) AS BIGINT), 'b': CAST(t.u % CAST({slots} - t.need + 1 AS UBIGINT) AS BIGINT) + t.need - 1}}) AS spots FROM reqs),
fold(rn, seq, own, status, hit, fids, ext) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS UBIGINT), '', {{'j': CAST(0 AS BIGINT), 'u': CAST(0 AS UBIGINT), 'a': CAST(0 AS BIGINT), 'b': CAST(0 AS BIGINT)}}, CAST([] AS UBIGINT[]), CAST([] AS STRUCT(a BIGINT, b BIGINT)[])
  UNION ALL SELECT rn, seq, own, CASE WHEN reason IS NOT NULL THEN reason WHEN known THEN 'duplicate' WHEN hit IS NULL THEN '{'jump_exhausted' if jumps else 'extent'}' ELSE 'ok' END, hit,
    CASE WHEN reason IS NULL AND NOT known AND hit IS NOT NULL THEN list_concat(fids, [own, hit.u]) ELSE fids END, CASE WHEN reason IS NULL AND NOT known AND hit IS NOT NULL THEN list_append(ext, {{'a': hit.a, 'b': hit.b}}) ELSE ext END
  FROM (SELECT s.rn, s.seq, s.own, s.reason, list_contains(f.fids, s.own) AS known, f.fids, f.ext,
      list_filter(s.spots, lambda t: (t.j = 0 OR NOT list_contains(f.fids, t.u)) AND len(list_filter(f.ext, lambda e: e.a <= t.b AND t.a <= e.b)) = 0)[1] AS hit FROM fold f JOIN spots s ON s.rn = f.rn + 1))"""


def _md5_jumps(payload: Column, n: int) -> Column:
    return F.array(*(md5_fid(F.concat(payload, F.lit(bytes([j])))) for j in range(1, n + 1)))


@query(
    f"""WITH RECURSIVE {_DOCS_SQL}, {_fold_sql(1 << 12, 0)} SELECT f.seq, f.status, CASE WHEN s.reason IS NULL THEN s.spots[1].a END AS "start" FROM fold f JOIN spots s ON f.rn = s.rn WHERE f.rn > 0"""
)
def place_documents(s, d):
    """Every document put in order of doc_id on one disk: ok, duplicate or in the way of an earlier one."""
    r = _doc_objects(s, d).select(F.col("doc_id").alias("seq"), "fid", "size")
    return placement.place_in_order(r, 1 << 12).select("seq", "status", "start")


@query(
    f"""WITH RECURSIVE {_DOCS_SQL}, {_fold_sql(JUMP_SLOTS, JUMPS)} SELECT seq, status, CASE WHEN status = 'ok' THEN CAST(hit.j AS INT) WHEN status = 'jump_exhausted' THEN {JUMPS} ELSE 0 END AS jumps_taken,
  lower(lpad(hex(CASE WHEN status = 'ok' THEN hit.u ELSE own END), 16, '0')) AS target_fid, CASE WHEN status = 'ok' THEN hit.a END AS slot FROM fold WHERE rn > 0"""
)
def put_jump(s, d):
    """The same with up to 8 jumps: what a client's put with retries ends with."""
    r = _doc_objects(s, d).select(F.lit(0).cast("long").alias("disk_id"), F.lit(JUMP_SLOTS).cast("long").alias("slots"), F.col("doc_id").alias("seq"), "fid", "size", "payload")
    x = placement.put_in_order(r, None, JUMPS, _md5_jumps)
    return x.select("seq", "status", "jumps_taken", F.lower(F.lpad(F.hex("target_fid"), 16, "0")).alias("target_fid"), "slot")


def _asked(s: SparkSession, d: str) -> DataFrame:
    """An extent on every disk for every document, by the md5 of its text."""
    disks = table(s, d, "trim_status").select("disk_id").distinct()
    x = _doc_objects(s, d).where("size > 0").select("doc_id", "fid", "size", F.element_at(F.array(F.lit(0)), 1).alias("one")).join(F.broadcast(disks.agg(F.sort_array(F.collect_set("disk_id")).alias("disks")).withColumn("one", F.lit(0))), "one")
    x = x.select(F.element_at("disks", (F.pmod("doc_id", F.size("disks")) + 1).cast("int")).alias("disk_id"), F.col("doc_id").alias("fid"), F.col("fid").alias("content"), "size")
    a = address.address(F.lit(POOL_SLOTS).cast("long"), F.col("content"), F.col("size"))
    return x.select("disk_id", "fid", a["slot"].alias("start"), (a["slot"] + a["need"] - 1).alias("end"))


_ASKED_SQL = f"""
dk AS (SELECT list_sort(list(DISTINCT disk_id)) AS l FROM trim_status WHERE disk_id IS NOT NULL),
asked0 AS (SELECT l[CAST(doc_id % len(l) + 1 AS BIGINT)] AS disk_id, doc_id AS fid, CAST(ceil(size / 4096.0) AS BIGINT) AS need, ufid FROM docs, dk WHERE size > 0),
asked AS (SELECT disk_id, fid, CAST(ufid % CAST({POOL_SLOTS} - need + 1 AS UBIGINT) AS BIGINT) AS "start", CAST(ufid % CAST({POOL_SLOTS} - need + 1 AS UBIGINT) AS BIGINT) + need - 1 AS "end" FROM asked0)
"""
_HITS = 'EXISTS (SELECT 1 FROM ext e WHERE e.disk_id = a.disk_id AND e."start" <= a."end" AND a."start" <= e."end")'


@query(f'WITH {_DOCS_SQL}, {_extents_sql(POOL_SLOTS)}, {_ASKED_SQL} SELECT disk_id, fid, "start", "end" FROM asked a WHERE NOT {_HITS}')
def reserve_extents(s, d):
    """The documents' extents that are free beside the objects of the disk they ask."""
    return placement.free_of(_asked(s, d), _ref_extents(s, d, POOL_SLOTS), ["disk_id"])


@query(f"WITH {_DOCS_SQL}, {_extents_sql(POOL_SLOTS)}, {_ASKED_SQL} SELECT disk_id, fid FROM asked a WHERE {_HITS}")
def any_overlap(s, d):
    """The documents' extents that an object of the disk is in the way of."""
    return placement.any_overlap(_asked(s, d), _ref_extents(s, d, POOL_SLOTS), ["disk_id"]).select("disk_id", "fid")


_EVENTS_SQL = """ev AS (SELECT disk_id, fid, CASE WHEN fid % 3 = 0 THEN 'confirm' WHEN fid % 3 = 1 THEN 'release' END AS event FROM asked),
st AS (SELECT a.*, CASE e.event WHEN 'confirm' THEN 'confirmed' WHEN 'release' THEN 'released' ELSE 'pending' END AS state FROM asked a LEFT JOIN ev e ON a.disk_id = e.disk_id AND a.fid = e.fid)"""


def _states(s: SparkSession, d: str) -> DataFrame:
    """The asked extents, a third of them confirmed (and released too late), a third released, the rest pending."""
    a = _asked(s, d)
    third = F.pmod("fid", F.lit(3))
    ev = a.select("disk_id", "fid", F.explode(F.when(third == 0, F.array(F.struct(F.lit(1).alias("seq"), F.lit("confirm").alias("event")), F.struct(F.lit(2).alias("seq"), F.lit("release").alias("event")))).when(third == 1, F.array(F.struct(F.lit(1).alias("seq"), F.lit("release").alias("event"))))).alias("e"))
    return placement.transitions(a, ev.select("disk_id", "fid", "e.seq", "e.event"))


@query(f'WITH {_DOCS_SQL}, {_ASKED_SQL}, {_EVENTS_SQL} SELECT disk_id, fid, "start", "end", state FROM st')
def extent_states(s, d):
    return _states(s, d)


@query(f"WITH RECURSIVE {_DOCS_SQL}, {_ASKED_SQL}, {_EVENTS_SQL}, ext AS (SELECT * FROM st WHERE state <> 'released'), {_chd_sql(POOL_SLOTS)} SELECT disk_id, chd FROM room")
def current_chd(s, d):
    """Room beside confirmed and pending extents."""
    x = _states(s, d).where("state != 'released'")
    return placement.current_chd(x.select("disk_id").distinct().withColumn("slots", F.lit(POOL_SLOTS).cast("long")), x)
