"""Queries of the formats: ids, texts, binary codecs and the bytes of objects, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import address, codecs, fid, parse
from ..operators import catalog, chunking, indexlog, reads, trim, writes
from ..sources.tables import table
from ..types import hex_fid
from .store import _ADMIT_SQL, _CHUNK_SQL, _DOCS_SQL, _PUTS_SQL, _U, _chunks, _docs, _whole_chunks, query
from .xxh3_sql import xxh3_sql

_HEX16 = "lower(lpad(hex(u), 16, '0'))"


def _le(u: str, size: int) -> str:
    """Hex of the lowest `size` bytes of an unsigned value, little-endian."""
    return "(" + " || ".join(f"substr(lpad(hex({u}), 16, '0'), {15 - 2 * i}, 2)" for i in range(size)) + ")"


@query(f"WITH {_DOCS_SQL}, {xxh3_sql('SELECT doc_id AS id, hex(encode(text)) AS h FROM docs')} SELECT doc_id, '0x' || {_HEX16} AS fid, size FROM docs JOIN x3 ON doc_id = id")
def fid_xxh3(s, d):
    x = _docs(s, d).select("doc_id", fid.xxh3("payload").alias("fid"), F.octet_length("payload").cast("long").alias("size"))
    return x.select("doc_id", parse.fid_text(F.col("fid")).alias("fid"), "size")


@query(
    f"""WITH {_DOCS_SQL}, {xxh3_sql("SELECT {'d': doc_id, 'j': j} AS id, hex(encode(text)) || printf('%02x', j + 1) AS h FROM docs, range(3) r(j)")}
SELECT id.d AS doc_id, CAST(id.j AS INT) AS jump, {_HEX16} AS fid FROM x3"""
)
def jump_fids(s, d):
    x = _docs(s, d).select("doc_id", fid.xxh3_jumps("payload", F.lit(3)).alias("fids"))
    return x.select("doc_id", F.posexplode("fids").alias("jump", "fid")).select("doc_id", "jump", hex_fid(F.col("fid")).alias("fid"))


@query(
    f"""WITH c AS (SELECT DISTINCT payload, fid FROM chunks WHERE payload IS NOT NULL AND fid IS NOT NULL), {xxh3_sql("SELECT DISTINCT md5(payload) AS id, hex(payload) AS h FROM c")},
y AS (SELECT lower(lpad(hex({_U('fid')}), 16, '0')) = {_HEX16} AS same FROM chunks JOIN x3 ON md5(payload) = id WHERE fid IS NOT NULL AND payload IS NOT NULL)
SELECT same, count(*) AS chunks FROM y GROUP BY same"""
)
def chunk_identity(s, d):
    """Chunks whose fid is, or is not, the XXH3 of their payload."""
    c = _chunks(s, d).where("payload is not null and fid is not null").select("file_id", "idx", "fid", fid.xxh3("payload").alias("computed"))
    return c.groupBy((F.col("fid") == F.col("computed")).alias("same")).agg(F.count(F.lit(1)).alias("chunks"))


@query(f"WITH z AS (SELECT DISTINCT size FROM refs WHERE size IS NOT NULL) SELECT size, {_le('size', 7)} AS bytes, size AS back FROM z")
def size7_codec(s, d):
    b = codecs.size7_bytes(F.col("size"))
    return table(s, d, "refs").where("size is not null").select("size").distinct().select("size", F.hex(b).alias("bytes"), codecs.size7_value(b).alias("back"))


@query(
    f"""WITH o AS (SELECT disk_id, seq, min(fid) AS fid, min(size) AS size, min(jump_code) AS code FROM index_log GROUP BY ALL)
SELECT disk_id, seq, CASE WHEN code = 0 OR size = 72057594037927935 OR (code = 255 AND size = 72057594037927934) THEN {_le(_U('fid'), 8)} || {_le('size', 7)} || lpad(hex(code), 2, '0') END AS entry FROM o"""
)
def entry_codec(s, d):
    """Every log entry in its 16 bytes; null where they make none."""
    e = table(s, d, "index_log").groupBy("disk_id", "seq").agg(*(F.min(c).alias(c) for c in ("fid", "size", "jump_code")))
    return e.select("disk_id", "seq", F.hex(codecs.entry_bytes_udf("fid", "size", "jump_code")).alias("entry"))


_DEVICES_SQL = "dev AS (SELECT disk_id, min(device_path) AS device_path, max(last_total_files) AS n, max(last_small_files) AS m, bool_or(last_error IS NOT NULL) AS failed FROM trim_status WHERE disk_id IS NOT NULL GROUP BY disk_id)"


def _devices(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "trim_status").where("disk_id is not null").groupBy("disk_id")
    return t.agg(F.min("device_path").alias("device_path"), F.max("last_total_files").alias("n"), F.max("last_small_files").alias("m"), F.bool_or(F.col("last_error").isNotNull()).alias("failed"))


@query(f"WITH {_DEVICES_SQL} SELECT disk_id, '4E425353' || '0200' || {_le('coalesce(n, 0) % 65536', 2)} || {_le(_U('disk_id'), 8)} || hex(encode(device_path)) || '00' AS head, CAST(2 AS INT) AS version, CAST(coalesce(n, 0) % 65536 AS INT) AS capacity_gb, device_path AS note FROM dev")
def header_codec(s, d):
    """Headers of the disks, written and read."""
    x = _devices(s, d).select("disk_id", "device_path", codecs.header_bytes_udf((F.coalesce("n", F.lit(0)) % 65536).cast("int"), "disk_id", "device_path").alias("b"))
    x = x.select("disk_id", F.substring(F.hex("b"), F.lit(1), 34 + 2 * F.octet_length("device_path")).alias("head"), codecs.header_udf("b").alias("h"), F.octet_length("b").alias("n"))
    return x.where("n = 4096 and h.disk_id = disk_id").select("disk_id", "head", "h.version", "h.capacity_gb", "h.note")


@query("WITH p AS (SELECT DISTINCT CAST(size % 80 - 8 AS INT) AS p FROM refs WHERE size IS NOT NULL) SELECT p, CASE WHEN p <= 0 THEN 1 WHEN p >= 62 THEN 4611686018427387904 ELSE CAST(1 AS BIGINT) << p END AS bytes FROM p")
def pow2_sizes(s, d):
    p = table(s, d, "refs").where("size is not null").select((F.col("size") % 80 - 8).cast("int").alias("p")).distinct()
    return p.select("p", address.pow2_bytes(F.col("p")).alias("bytes"))


@query(
    """WITH t AS (SELECT DISTINCT unnest([size || '', size || 'k', ' ' || size || ' KB ', size || 'mb', size || 'T', size || 'B', 'x' || size, size || '99999999999G']) AS t FROM refs WHERE size IS NOT NULL),
r AS (SELECT t, regexp_extract(upper(trim(t)), '^([0-9]{1,18})\\s*(G|GB|M|MB|K|KB|B|)$', 1) AS n, substr(regexp_extract(upper(trim(t)), '^([0-9]{1,18})\\s*(G|GB|M|MB|K|KB|B|)$', 2), 1, 1) AS unit FROM t),
v AS (SELECT t, CASE WHEN n <> '' THEN n::HUGEINT * CASE unit WHEN 'G' THEN 1073741824 WHEN 'M' THEN 1048576 WHEN 'K' THEN 1024 ELSE 1 END END AS v FROM r)
SELECT t AS text, CASE WHEN v <= 9223372036854775807 THEN v::BIGINT END AS bytes FROM v"""
)
def parsed_sizes(s, d):
    """Sizes written in all ways a setting may have them, and in some it may not."""
    n = F.col("size").cast("string")
    forms = F.array(n, F.concat(n, F.lit("k")), F.concat(F.lit(" "), n, F.lit(" KB ")), F.concat(n, F.lit("mb")), F.concat(n, F.lit("T")), F.concat(n, F.lit("B")), F.concat(F.lit("x"), n), F.concat(n, F.lit("99999999999G")))
    t = table(s, d, "refs").where("size is not null").select(F.explode(forms).alias("text")).distinct()
    return t.select("text", parse.parse_size_column(F.col("text")).alias("bytes"))


@query(f"SELECT DISTINCT disk_id, fid, CASE WHEN disk_id = 0 THEN '' ELSE '0x' || hex({_U('disk_id')}) END AS disk_text, '0x' || lower(lpad(hex({_U('fid')}), 16, '0')) AS fid_text, printf('%.2f GiB', coalesce(size, 0) / 1073741824.0) AS size_text FROM refs")
def id_texts(s, d):
    r = table(s, d, "refs").select("disk_id", "fid", parse.disk_id_text(F.col("disk_id")).alias("disk_text"), parse.fid_text(F.col("fid")).alias("fid_text"), parse.gib_text(F.coalesce("size", F.lit(0))).alias("size_text"))
    return r.distinct()


@query(
    f"""WITH {_DEVICES_SQL}, h AS (SELECT disk_id, sha256(unhex({_le('coalesce(n, 0)', 8)}) || encode(device_path) || unhex(md5(device_path))) AS h FROM dev)
SELECT disk_id, lower({' || '.join(f'substr(h, {15 - 2 * i}, 2)' for i in range(8))}) AS made FROM h"""
)
def made_disk_ids(s, d):
    """Ids made from size, path and a salt (here the md5 of the path)."""
    salt = F.unhex(F.md5(F.col("device_path").cast("binary")))
    return _devices(s, d).select("disk_id", hex_fid(fid.auto_disk_id_column(F.col("device_path"), F.coalesce("n", F.lit(0)), salt)).alias("made"))


@query(
    """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN doc_id || '-' WHEN 1 THEN (doc_id % 100) || '-' || doc_id WHEN 2 THEN ' ' || doc_id || '-7 ' ELSE doc_id || '' END AS t FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, TRY_CAST(nullif(regexp_extract(trim(t), '^([0-9]{1,18})-([0-9]{0,18})$', 1), '') AS BIGINT) AS "start", CASE WHEN trim(t) ~ '[0-9]-$' THEN 0 ELSE TRY_CAST(nullif(regexp_extract(trim(t), '^([0-9]{1,18})-([0-9]{0,18})$', 2), '') AS BIGINT) END AS "end" FROM t"""
)
def range_texts(s, d):
    i = F.col("doc_id").cast("string")
    k = F.pmod("doc_id", F.lit(4))
    t = F.when(k == 0, F.concat(i, F.lit("-"))).when(k == 1, F.concat((F.col("doc_id") % 100).cast("string"), F.lit("-"), i)).when(k == 2, F.concat(F.lit(" "), i, F.lit("-7 "))).otherwise(i)
    start, end = parse.range_columns(t)
    return table(s, d, "documents").where("doc_id is not null").select("doc_id", start.alias("start"), end.alias("end"))


@query(f"WITH {_DEVICES_SQL} SELECT disk_id, coalesce(n, 0) AS size, sha256(device_path) AS sha256, coalesce(n, 0) || ' ' || sha256(device_path) || chr(10) AS text, CAST(NULL AS BIGINT) AS cut FROM dev")
def snapshot_side_files(s, d):
    """Side files of snapshots, written and read; a text cut short reads as nothing."""
    h = F.sha2(F.col("device_path").cast("binary"), 256)
    x = _devices(s, d).select("disk_id", codecs.snapshot_meta_text(F.coalesce("n", F.lit(0)), h).alias("text"))
    size, digest = codecs.snapshot_meta_columns(F.col("text"))
    return x.select("disk_id", size.alias("size"), digest.alias("sha256"), "text", codecs.snapshot_meta_columns(F.substring("text", 1, 60))[0].alias("cut"))


_PACK_SQL = f"""
pk AS (SELECT disk_id, table_fid, coalesce(container_fid, 0) AS c, greatest(coalesce(container_size, 0), 0) AS n, greatest(coalesce(nonce, 0), 0) AS k,
    list_transform(coalesce(entries, []), lambda e: {{'fid': coalesce(e.fid, 0), 'o': greatest(coalesce(e.byte_offset, 0), 0), 's': greatest(coalesce(e.size, 0), 0)}}) AS es FROM packed),
pb AS (SELECT DISTINCT disk_id, table_fid, '4E425054' || '01003000' || {_le(_U('disk_id'), 8)} || {_le(_U('c'), 8)} || {_le('n', 8)} || {_le('len(es)', 8)} || {_le('k', 8)}
    || array_to_string(list_transform(es, lambda e: {_le(_U('e.fid'), 8)} || {_le('e.o', 8)} || {_le('e.s', 8)}), '') AS h, len(es) AS entries,
    CASE WHEN n = 0 THEN 'container_size' WHEN len(list_filter(es, lambda e: e.s = 0 OR e.o + e.s > n)) > 0 THEN CASE WHEN list_filter(es, lambda e: e.s = 0 OR e.o + e.s > n)[1].s = 0 THEN 'entry_size' ELSE 'entry_range' END END AS fault FROM pk)
"""


@query(f"WITH {_PACK_SQL} SELECT disk_id, table_fid, md5(unhex(h)) AS digest, fault, CASE WHEN fault IS NULL THEN entries ELSE NULL END AS entries FROM pb")
def packed_codec(s, d):
    """Every packed table as bytes, and what reading them gives."""
    z = lambda c: F.greatest(F.coalesce(c, F.lit(0)), F.lit(0))
    e = F.transform(F.coalesce("entries", F.array().cast("array<struct<fid:bigint,byte_offset:bigint,size:bigint>>")), lambda x: F.struct(F.coalesce(x["fid"], F.lit(0)).alias("fid"), z(x["byte_offset"]).alias("byte_offset"), z(x["size"]).alias("size")))
    b = codecs.packed_bytes_udf("disk_id", F.coalesce("container_fid", F.lit(0)), z(F.col("container_size")), z(F.col("nonce")), e)
    x = table(s, d, "packed").select("disk_id", "table_fid", b.alias("b")).distinct()
    return x.select("disk_id", "table_fid", F.md5("b").alias("digest"), codecs.packed_udf("b").alias("p")).select("disk_id", "table_fid", "digest", "p.fault", F.when(F.col("p.fault").isNull(), F.size("p.entries")).cast("long").alias("entries"))


@query(
    f"""WITH {_CHUNK_SQL}, t AS (SELECT file_id, CAST(sum(size) AS BIGINT) AS total FROM one GROUP BY file_id)
SELECT o.file_id, row_number() OVER (PARTITION BY o.file_id ORDER BY byte_offset NULLS FIRST, idx) - 1 AS no, coalesce(fid, 0) AS fid, coalesce(byte_offset, 0) AS byte_offset, coalesce(size, 0) AS size, coalesce(total, 0) AS total_size, 'file-' || o.file_id AS filename, TRUE AS is_manifest FROM one o JOIN t ON o.file_id = t.file_id"""
)
def manifest_codec(s, d):
    """Manifests of all files as bytes, and what reading them gives."""
    m = chunking.manifests(_whole_chunks(s, d))
    c = F.transform("chunks", lambda x: F.struct(*(F.coalesce(x[k], F.lit(0)).alias(k) for k in ("fid", "byte_offset", "size"))))
    b = codecs.manifest_bytes_udf(F.coalesce("total_size", F.lit(0)), F.lit(7).cast("long"), F.concat(F.lit("file-"), F.col("file_id").cast("string")), F.lit(4096).cast("long"), c)
    x = m.select("file_id", b.alias("b")).select("file_id", reads.is_manifest(F.col("b")).alias("is_manifest"), codecs.manifest_udf("b").alias("m"))
    x = x.where("m.full_content_hash = 7 and m.chunk_target_size = 4096").select("file_id", "is_manifest", "m.total_size", "m.filename", F.posexplode("m.chunks").alias("no", "c"))
    return x.select("file_id", F.col("no").cast("long").alias("no"), "c.fid", "c.byte_offset", "c.size", "total_size", "filename", "is_manifest")


# Whole files: the chunks of a file end to end.
_FILES_SQL = """
one AS (SELECT file_id, idx, max(hex(payload)) AS h FROM chunks WHERE file_id IS NOT NULL AND idx IS NOT NULL GROUP BY ALL),
laid AS (SELECT file_id, idx, coalesce(h, '') AS h, CAST(sum(length(coalesce(h, '')) // 2) OVER (PARTITION BY file_id ORDER BY idx ROWS UNBOUNDED PRECEDING) - length(coalesce(h, '')) // 2 AS BIGINT) AS o FROM one),
files AS (SELECT file_id, string_agg(h, '' ORDER BY idx) AS h FROM laid GROUP BY file_id)
"""


def _parts(s: SparkSession, d: str) -> DataFrame:
    """(file_id, idx, payload), each once; a lost payload is empty."""
    c = _chunks(s, d).where("file_id is not null and idx is not null").groupBy("file_id", "idx").agg(F.max("payload").alias("payload"))
    return c.withColumn("payload", F.coalesce("payload", F.lit(b"").cast("binary")))


def _files(s: SparkSession, d: str) -> DataFrame:
    return reads.joined(_parts(s, d), ["file_id"], "idx", "payload")


@query(f"WITH {_FILES_SQL}, {xxh3_sql('SELECT file_id AS id, h FROM files')} SELECT file_id, length(h) // 2 AS size, md5(unhex(h)) AS digest, {_HEX16} AS fid FROM (SELECT file_id, files.h, u FROM files JOIN x3 ON file_id = id)")
def file_content(s, d):
    """Every file's bytes: length, digest and the content hash that its manifest has."""
    return _files(s, d).select("file_id", F.octet_length("data").cast("long").alias("size"), F.md5("data").alias("digest"), hex_fid(fid.xxh3("data")).alias("fid"))


@query(
    f"""WITH {_FILES_SQL} SELECT CAST(1 AS BIGINT) AS disk_id, l.file_id * 100000 + l.idx AS fid, md5(unhex(l.h)) AS digest FROM laid l
UNION ALL SELECT 2, file_id, CASE WHEN length(h) >= 2 THEN md5(unhex(substr(h, 1, length(h) - 2))) END FROM files UNION ALL SELECT 3, file_id, NULL FROM files"""
)
def resolved_bytes(s, d):
    """Logical objects: every chunk as a packed slice of its file, every file behind an alias without its last byte, and a slice beyond the end."""
    f = _files(s, d).select(F.col("file_id").alias("fid"), F.col("data").alias("payload"))
    p = _parts(s, d).withColumn("size", F.octet_length("payload").cast("long"))
    from ..operators.prefix import blocked_running_sum

    at = blocked_running_sum(p.select("file_id", "idx", "size"), ["file_id"], F.floor(F.col("idx") / 4096), [F.col("idx")], "size", "byte_offset")
    ref = lambda disk, df, i, n, o, packed: df.select(F.lit(disk).cast("long").alias("disk_id"), i.alias("fid"), F.col("file_id").alias("target_fid"), F.lit(None).cast("long").alias("stored_size"), n.cast("long").alias("size"), o.cast("long").alias("byte_offset"), F.lit(packed).alias("packed"))
    slices = ref(1, at, F.col("file_id") * 100000 + F.col("idx"), F.col("size"), F.col("byte_offset"), True)
    whole = f.select(F.col("fid").alias("file_id"), F.octet_length("payload").cast("long").alias("n"))
    refs = slices.unionByName(ref(2, whole, F.col("file_id"), F.col("n") - 1, F.lit(0), False)).unionByName(ref(3, whole, F.col("file_id"), F.lit(5), F.col("n"), True))
    return reads.resolve(refs, f).select("disk_id", "fid", F.md5("data").alias("digest"))


@query(
    f"""WITH {_FILES_SQL}, r AS (SELECT file_id, h, length(h) // 2 AS n, file_id % 3000 AS s, file_id % 3000 + 5000 AS e FROM files)
SELECT file_id AS req_id, md5(unhex(substr(h, 2 * s + 1, 2 * (least(e, n) - s)))) AS digest, CAST(0 AS BIGINT) AS missing FROM r WHERE s < least(e, n)"""
)
def sparse_bytes(s, d):
    """5,000 bytes from the middle of every file, read chunk by chunk."""
    from ..operators.prefix import blocked_running_sum

    p = _parts(s, d).withColumn("size", F.octet_length("payload").cast("long")).withColumn("fid", F.col("file_id") * 100000 + F.col("idx"))
    at = blocked_running_sum(p.select("file_id", "idx", "fid", "size"), ["file_id"], F.floor(F.col("idx") / 4096), [F.col("idx")], "size", "byte_offset")
    r = p.select("file_id").distinct().select(F.col("file_id").alias("req_id"), "file_id", (F.col("file_id") % 3000).alias("range_start"), (F.col("file_id") % 3000 + 5000).alias("range_end"))
    touched = chunking.sparse_range(chunking.manifests(at), r)
    return chunking.read_sparse(touched, p.select("fid", "payload")).select("req_id", F.md5("data").alias("digest"), "missing")


@query(
    f"""WITH {_DOCS_SQL}, b AS (SELECT doc_id % 40 AS box, doc_id AS seq, size, text FROM docs WHERE size > 0)
SELECT box, CAST(sum(size) AS BIGINT) AS container_size, md5(unhex(string_agg(hex(encode(text)), '' ORDER BY seq))) AS digest, count(*) AS entries FROM b GROUP BY box"""
)
def container_build(s, d):
    """Documents packed into 40 containers: size, digest and entries."""
    x = _docs(s, d).where("octet_length(payload) > 0").select((F.col("doc_id") % 40).alias("box"), F.col("doc_id").alias("seq"), F.col("doc_id").alias("fid"), F.octet_length("payload").cast("long").alias("size"), "payload")
    b = trim.batch(x, 1 << 40, ["box"])
    return trim.containers(b, ["box"]).select("box", "container_size", F.md5("payload").alias("digest"), F.size("entries").cast("long").alias("entries"))


@query(
    """WITH c AS (SELECT DISTINCT fid, md5(payload) AS m, octet_length(payload) AS n FROM chunks WHERE fid IS NOT NULL AND payload IS NOT NULL), k AS (SELECT fid, min(m) AS m, arg_min(n, m) AS n FROM c WHERE fid % 7 <> 0 GROUP BY fid)
SELECT c.fid, c.m AS digest, CASE WHEN k.m IS NULL THEN 'not_found' WHEN k.n <> c.n THEN 'size' WHEN k.m <> c.m THEN 'content' ELSE 'ok' END AS status FROM c LEFT JOIN k ON c.fid = k.fid"""
)
def verify_content(s, d):
    """Every content that goes under a chunk's fid, compared with what is stored under it (every seventh fid is lost)."""
    c = _chunks(s, d).where("fid is not null and payload is not null").select("fid", "payload").distinct()
    stored = c.where("fid % 7 != 0").groupBy("fid").agg(F.min_by("payload", F.md5("payload")).alias("payload"))
    x = reads.verify_content(c, stored, keep=["payload"])
    return x.select("fid", F.md5("payload").alias("digest"), "status")


@query(f"WITH {_PUTS_SQL}, {_ADMIT_SQL}, st AS (SELECT CASE WHEN fault IS NOT NULL THEN 'invalid_argument' WHEN w.seq IS NULL THEN 'conflict' END AS class FROM f LEFT JOIN w ON f.seq = w.seq) SELECT class, count(*) AS requests FROM st GROUP BY class")
def error_classes(s, d):
    x = writes.admit(table(s, d, "put_requests"), table(s, d, "stored_fids"))
    return x.groupBy(writes.error_class(F.col("status")).alias("class")).agg(F.count(F.lit(1)).alias("requests"))


@query(f"WITH {_PUTS_SQL} SELECT seq, CASE WHEN total_size IS NULL OR total_size <= 0 THEN 'empty' WHEN total_size > 16777216 THEN 'too_large' END AS fault FROM puts")
def atomic_puts(s, d):
    return table(s, d, "put_requests").where("seq is not null").groupBy("seq").agg(F.min("total_size").alias("n")).select("seq", writes.atomic_fault(F.col("n")).alias("fault"))


@query(f"WITH {_DEVICES_SQL}, x AS (SELECT *, CASE disk_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 1 ELSE 2 END AS version, CASE WHEN disk_id % 7 = 0 THEN 268435456 ELSE 268435456 + 4096 * coalesce(n, 0) + 4096 END AS size FROM dev) SELECT disk_id, CASE WHEN version IS NULL THEN 'no_header' WHEN version <> 2 THEN 'version' WHEN failed THEN 'id' WHEN size <= 268435456 THEN 'too_small' END AS fault FROM x")
def device_faults(s, d):
    """Checks of devices at opening: every fifth has no header, every fifth an old one, failed ones another id in the pool, every seventh no grid."""
    x = _devices(s, d).select(F.col("disk_id").cast("string").alias("device_path"), "disk_id", F.when(F.col("disk_id") % 5 == 0, None).when(F.col("disk_id") % 5 == 1, 1).otherwise(2).alias("version"), F.when(F.col("disk_id") % 7 == 0, 268435456).otherwise(268435456 + 4096 * F.coalesce("n", F.lit(0)) + 4096).alias("size_bytes"), F.when(F.col("failed"), F.col("disk_id") + 1).otherwise(F.col("disk_id")).alias("expected_id"))
    return catalog.device_faults(x).select(F.col("device_path").cast("long").alias("disk_id"), "fault")


@query(f"WITH {_DEVICES_SQL} SELECT disk_id, CASE WHEN disk_id % 7 = 0 THEN 'too_small' WHEN disk_id % 11 = 0 THEN 'capacity' WHEN failed THEN 'has_header' WHEN coalesce(n, 0) > 0 THEN 'has_index' END AS fault FROM dev")
def init_faults(s, d):
    """Checks of devices to be initialised: failed ones have a header, those with files an index."""
    size = F.when(F.col("disk_id") % 7 == 0, 1 << 20).when(F.col("disk_id") % 11 == 0, 65536 << 30).otherwise(1 << 30)
    x = _devices(s, d).select(F.col("disk_id").cast("string").alias("device_path"), size.alias("size_bytes"), F.when(F.col("failed"), 2).alias("version"), F.coalesce("n", F.lit(0)).alias("index_entries"))
    return catalog.init_fault(x).select(F.col("device_path").cast("long").alias("disk_id"), "fault")


@query(
    f"""WITH {_DEVICES_SQL} SELECT disk_id, disk_id % 3 <> 0 AS is_zst, CASE WHEN disk_id % 7 = 0 THEN 'small' WHEN disk_id % 11 = 0 THEN 'alignment' WHEN failed AND disk_id % 2 = 0 THEN 'header' WHEN disk_id % 3 <> 0 AND m IS NULL THEN 'no_meta' WHEN disk_id % 13 = 0 AND m IS NOT NULL THEN 'length' WHEN m <> n THEN 'checksum' END AS fault FROM dev"""
)
def snapshot_faults(s, d):
    """Checks of snapshots, two in three of them compressed (with an older raw one beside)."""
    x = _devices(s, d)
    size = F.when(F.col("disk_id") % 7 == 0, 268435456).when(F.col("disk_id") % 11 == 0, 268435456 + 100).otherwise(268435456 + 4096).cast("long")
    digest = lambda c: F.sha2(F.col(c).cast("string").cast("binary"), 256)
    f = x.select("disk_id", F.explode(F.when(F.col("disk_id") % 3 != 0, F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("is_zst"), size.alias("size_bytes"), F.lit(2).alias("version"), F.when(F.col("failed") & (F.col("disk_id") % 2 == 0), F.lit(0)).otherwise(F.col("disk_id")).alias("header_id"), F.when(F.col("m").isNotNull(), size + F.when(F.col("disk_id") % 13 == 0, 1).otherwise(0)).alias("meta_size"), digest("m").alias("meta_sha256"), digest("n").alias("sha256"))
    f = f.withColumn("path", F.concat(F.col("disk_id").cast("string"), F.when(F.col("is_zst"), ".zst").otherwise("")))
    return catalog.snapshot_faults(catalog.newest_snapshots(f)).join(catalog.newest_snapshots(f).select("disk_id", "is_zst"), "disk_id")


@query("WITH t AS (SELECT DISTINCT disk_id, table_fid, 48 + 24 * coalesce(len(entries), 0) AS size FROM packed) SELECT disk_id, table_fid AS fid, 0 AS sub, 72057594037927934 AS size, 255 AS jump_code FROM t UNION ALL SELECT disk_id, table_fid, 1, size, 0 FROM t")
def anchor_rows(s, d):
    """The log rows that publish every packed table."""
    n = F.size(F.coalesce("entries", F.array().cast("array<struct<fid:bigint,byte_offset:bigint,size:bigint>>")))
    t = table(s, d, "packed").select("disk_id", F.col("table_fid").alias("fid"), (48 + 24 * n).cast("long").alias("size")).distinct()
    return indexlog.anchor_rows(t).select("disk_id", "fid", "sub", "size", "jump_code")
