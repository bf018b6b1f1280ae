"""Queries over the tables of a data folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut
from ..sources.tables import table
from . import leak, packing, seen, split, subjects


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that came out in more than one piece."""
    cuts = split.cut_oversized(table(spark, d, "chunks"), table(spark, d, "cdc_options"))
    return cuts.where(F.size("cuts") > 1).select("file_id", "idx")


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.split_oversized(table(spark, d, "chunks"), table(spark, d, "cdc_options"))


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Per maximum: chunks cut, pieces, and the least and largest piece."""
    cuts = split.cut_oversized(table(spark, d, "chunks"), table(spark, d, "cdc_options")).select("max_bytes", F.posexplode("cuts").alias("no", "cut"))
    return cuts.groupBy("max_bytes").agg(F.count_if(F.col("no") == 0).alias("chunks"), F.count(F.lit(1)).alias("pieces"), F.min("cut.piece_size").alias("least"), F.max("cut.piece_size").alias("largest"))


def _seen(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, int, DataFrame]:
    puts, chunks = table(spark, d, "put_requests"), table(spark, d, "chunks")
    rows = puts.count() + chunks.count()  # from the files' footers
    return seen.records_of(puts, chunks), table(spark, d, "stored_fids"), rows, seen.rows_of(puts, chunks)


def _asked(f: Callable, spark: SparkSession, d: str) -> DataFrame:
    records, known, rows, delivered = _seen(spark, d)
    return f(records, known, rows, delivered=delivered)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _asked(seen.answers, spark, d).where("seen").select("origin", "id", "pos")


def p3_answers(spark: SparkSession, d: str) -> DataFrame:
    return _asked(seen.answers, spark, d)


def p3_filter_errors(spark: SparkSession, d: str) -> DataFrame:
    """The filters' expected and measured rate of wrong answers, per origin and batch."""
    return _asked(seen.error_report, spark, d)


def p3_store_errors(spark: SparkSession, d: str) -> DataFrame:
    """How the store's own answers (jump_results.is_duplicate) compare: right, wrong, missing and the share of wrong ones."""
    truth = _asked(seen.answers, spark, d).where("origin = 'put_requests' and key is not null").select(F.col("id").alias("seq"), "seen")
    told = table(spark, d, "jump_results").where("seq is not null").groupBy("seq").agg(F.max("is_duplicate").alias("is_duplicate"))
    x = told.join(truth, "seq")
    right, wrong = F.count_if(F.col("is_duplicate") == F.col("seen")), F.count_if(F.col("is_duplicate") != F.col("seen"))
    return x.groupBy("seen").agg(right.alias("right"), wrong.alias("wrong"), F.count_if(F.col("is_duplicate").isNull()).alias("missing"), (wrong / F.greatest(right + wrong, F.lit(1))).alias("wrong_share"))


def p5_bins(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return packing.pack_documents(docs, docs.count())


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p5_bins(spark, d))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Every leak with its cosine, the share of the item's words and of its answer words."""
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """The test items that leaked and the number of documents that carry each."""
    return p6_leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("share").alias("largest_share"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))


def p7_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents per subject; one with several counts for each."""
    return p7_found(spark, d).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))


def p1_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds of all pieces: chunks cut, and pieces that are too long, leave a gap, do not repeat the overlap, or are not what they say."""
    chunks, options = table(spark, d, "chunks"), table(spark, d, "cdc_options")
    p = split.split_oversized(chunks, options).join(split.oversized(chunks, options).select("file_id", "idx", "max_bytes", "overlap", "length"), ["file_id", "idx"])
    w = W.partitionBy("file_id", "idx").orderBy("piece_no")
    end = F.col("piece_offset") + F.col("size")
    p = p.withColumn("before", F.lag(end).over(w)).withColumn("last", F.lead("piece_no").over(w).isNull())
    asked = F.least("overlap", F.when(F.col("overlap") >= F.col("max_bytes"), F.floor(F.col("max_bytes") / 2)).otherwise(F.col("overlap")))
    gap = (F.col("piece_offset") > F.coalesce("before", F.lit(0))) | (F.col("last") & (end != F.col("length")))
    return p.agg(
        F.count_if(F.col("piece_no") == 0).alias("chunks"),
        F.count_if(F.col("size") > F.col("max_bytes")).alias("too_long"),
        F.count_if(gap).alias("gaps"),
        F.count_if(F.col("before") - F.col("piece_offset") < asked).alias("overlap_short"),
        F.count_if(F.octet_length("payload") != F.col("size")).alias("other_size"),
    )


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per origin: whether the wrong answers of every batch stay within ten times the number expected, and five."""
    r = p3_filter_errors(spark, d)
    return r.groupBy("origin").agg(F.bool_and(F.col("wrong_yes") <= 10 * F.col("expected_rate") * F.col("keys") + 5).alias("within"))


def p5_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds of all bins: documents placed, bins too full, documents cut though they fit, pieces out of place, and whether the bins are few."""
    p = p5_bins(spark, d)
    full = p.groupBy("group_no", "bin_no").agg(F.sum("tokens").alias("n")).agg(F.count_if(F.col("n") > packing.CAPACITY).alias("overfull"), F.count(F.lit(1)).alias("bins"), F.ceil(F.sum("n") / packing.CAPACITY).alias("least"))
    docs = p.groupBy("doc_id").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("pieces"), F.max(F.col("token_start") + F.col("tokens")).alias("end"))
    docs = docs.agg(F.count(F.lit(1)).alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= packing.CAPACITY)).alias("cut_needlessly"), F.count_if(F.col("end") != F.col("n")).alias("out_of_place"))
    few = F.col("bins") <= F.col("least") * 1.02 + 2
    return docs.withColumn("k", F.lit(1)).join(full.withColumn("k", F.lit(1)), "k").select("documents", "overfull", "cut_needlessly", "out_of_place", few.alias("few"))


def _folded(text: str) -> Column:
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def p6_verbatim(spark: SparkSession, d: str) -> DataFrame:
    """The leaks whose document has 55 % of the item, its beginning or its end, word for word without markup between: SQL can find them all."""
    docs, items = table(spark, d, "documents"), table(spark, d, "eval_items")
    w = F.split(F.trim(_folded("text")), " ")
    n = F.ceil(F.size(w) * 0.55).cast("int")
    piece = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    parts = items.where("item_id is not null and text is not null").select("item_id", piece(F.slice(w, 1, n)).alias("head"), piece(F.slice(w, F.size(w) - n + 1, n)).alias("tail"))
    x = p6_found(spark, d).join(docs.select("doc_id", _folded("text").alias("t")), "doc_id").join(parts, "item_id")
    return x.where(F.contains("t", "head") | F.contains("t", "tail")).select("doc_id", "item_id").distinct()


def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """What holds of the subjects found: none unknown, none repeated, and four in five of the raters' labels among them (of a hundred or more)."""
    found = cut(p7_found(spark, d))
    names = table(spark, d, "subjects").select(F.lower(F.trim("subject")).alias("subject")).distinct()
    labels = table(spark, d, "subject_labels").select("doc_id", F.lower(F.trim("subject")).alias("subject")).distinct().join(names, "subject", "left_semi").join(table(spark, d, "documents").select("doc_id"), "doc_id", "left_semi")
    unknown = found.join(names, "subject", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    repeated = found.groupBy("doc_id", "subject").count().agg(F.count_if(F.col("count") > 1).alias("repeated"))
    hit = labels.join(found.withColumn("hit", F.lit(1)), ["doc_id", "subject"], "left").agg(((F.count("hit") >= 0.8 * F.count(F.lit(1))) | (F.count(F.lit(1)) < 100)).alias("agrees"))
    one = lambda df: df.withColumn("k", F.lit(1))
    return one(unknown).join(one(repeated), "k").join(one(hit), "k").drop("k")


#: Queries that SQL cannot express, and those that check them by what must hold.
CHECKED = {"p1_pieces": "p1_checks", "p1_report": "p1_checks", "p3_filter_errors": "p3_checks", "p5_bins": "p5_checks", "p5_report": "p5_checks", "p6_found": "p6_verbatim", "p6_leaks": "p6_verbatim", "p6_items": "p6_verbatim", "p7_found": "p7_checks", "p7_composition": "p7_checks"}

QUERIES = {f.__name__: f for f in (p1_checks, p3_checks, p5_checks, p6_verbatim, p7_checks, p1_found, p1_pieces, p1_report, p3_found, p3_answers, p3_filter_errors, p3_store_errors, p5_bins, p5_report, p6_found, p6_leaks, p6_items, p7_found, p7_composition)}

_P3 = """
rec AS (SELECT 'put_requests' AS origin, seq AS id, CAST(0 AS BIGINT) AS pos, min(fid) AS key FROM put_requests WHERE seq IS NOT NULL GROUP BY seq
  UNION ALL SELECT 'chunks', file_id, CAST(idx AS BIGINT), min(fid) FROM chunks WHERE file_id IS NOT NULL AND idx IS NOT NULL GROUP BY file_id, idx),
ans AS (SELECT origin, id, pos, key, CASE WHEN key IS NULL THEN NULL ELSE row_number() OVER (PARTITION BY origin, key ORDER BY id, pos) > 1 OR key IN (SELECT fid FROM stored_fids WHERE fid IS NOT NULL) END AS seen FROM rec)
"""

_P1 = """
WITH o AS (SELECT profile_id, min(max_chunk_size) AS m FROM cdc_options GROUP BY profile_id),
x AS (SELECT DISTINCT c.file_id, c.idx FROM chunks c LEFT JOIN o ON c.profile_id = o.profile_id WHERE coalesce(octet_length(c.payload), c.size) > CASE WHEN o.m > 0 THEN o.m ELSE 4096 END)
"""
_FOLDED = "' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' '"

ORACLE = {
    "p1_checks": f"{_P1} SELECT count(*) AS chunks, 0 AS too_long, 0 AS gaps, 0 AS overlap_short, 0 AS other_size FROM x",
    "p3_checks": "SELECT 'put_requests' AS origin, TRUE AS within UNION ALL SELECT 'chunks', TRUE",
    "p5_checks": "SELECT count(*) AS documents, 0 AS overfull, 0 AS cut_needlessly, 0 AS out_of_place, TRUE AS few FROM documents",
    "p6_verbatim": f"""
WITH w AS (SELECT item_id, string_split(trim({_FOLDED}), ' ') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL),
parts AS (SELECT item_id, ' ' || array_to_string(w[1:CAST(ceil(len(w) * 0.55) AS BIGINT)], ' ') || ' ' AS head, ' ' || array_to_string(w[len(w) - CAST(ceil(len(w) * 0.55) AS BIGINT) + 1:len(w)], ' ') || ' ' AS tail FROM w),
docs AS (SELECT doc_id, {_FOLDED} AS t FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM docs, parts WHERE contains(t, head) OR contains(t, tail)""",
    "p7_checks": "SELECT 0 AS unknown, 0 AS repeated, TRUE AS agrees",
    "p1_found": """
WITH o AS (SELECT profile_id, min(max_chunk_size) AS m FROM cdc_options GROUP BY profile_id)
SELECT DISTINCT c.file_id, c.idx FROM chunks c LEFT JOIN o ON c.profile_id = o.profile_id
WHERE coalesce(octet_length(c.payload), c.size) > CASE WHEN o.m > 0 THEN o.m ELSE 4096 END""",
    "p3_found": f"WITH {_P3} SELECT origin, id, pos FROM ans WHERE seen",
    "p3_answers": f"WITH {_P3} SELECT origin, id, pos, key, seen FROM ans",
    "p3_store_errors": f"""WITH {_P3}, told AS (SELECT seq, max(is_duplicate) AS is_duplicate FROM jump_results WHERE seq IS NOT NULL GROUP BY seq),
x AS (SELECT a.seen, t.is_duplicate FROM told t JOIN ans a ON a.origin = 'put_requests' AND a.id = t.seq WHERE a.key IS NOT NULL)
SELECT seen, count(*) FILTER (WHERE is_duplicate = seen) AS "right", count(*) FILTER (WHERE is_duplicate <> seen) AS wrong, count(*) FILTER (WHERE is_duplicate IS NULL) AS missing,
  CAST(count(*) FILTER (WHERE is_duplicate <> seen) AS DOUBLE) / greatest(count(*) FILTER (WHERE is_duplicate IS NOT NULL), 1) AS wrong_share FROM x GROUP BY seen""",
}
