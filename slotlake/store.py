"""An object store over Parquet: the client's verbs as batch operations.

Objects lie in one folder per committed batch. A batch is written first and takes the next
number in the folder of batches last, so a reader never sees half of one. Of two writers
only one gets a number; the other decides anew which of its objects are still new. Objects
have no slots here, so a put never jumps; placement on slot grids is in operators.placement.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Settings
from .functions import codecs
from .functions.fid import content_fid, xxh3
from .operators import chunking, reads, writes
from .session import cut, file_system
from .types import ATOMIC_LIMIT, CDC_SIZES, signed

_OBJECTS = "fid long, target_fid long, size long, payload binary"


class NotFound(KeyError):
    """No object has this fid."""


class Store:
    def __init__(self, spark: SparkSession, path: str, settings: Settings | None = None, cdc: tuple[int, int, int] = CDC_SIZES) -> None:
        self.spark, self.path, self.settings, self.cdc = spark, path, settings or Settings(), cdc

    def _batches(self) -> dict[int, str]:
        """The folders of the committed batches by their numbers."""
        fs, marks = file_system(self.spark, f"{self.path}/batches")
        names = [f.getPath().getName() for f in fs.listStatus(marks)] if fs.exists(marks) else []
        numbers = sorted(n for n in names if n.isdigit())
        return {int(n): n for n in numbers}

    def _read(self, batches: dict[int, str]) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], _OBJECTS)
        return self.spark.read.schema(_OBJECTS).parquet(*(f"{self.path}/objects/{self._folder(n)}" for n in batches.values()))

    def _folder(self, name: str) -> str:
        """The folder that a batch's mark names."""
        fs, mark = file_system(self.spark, f"{self.path}/batches/{name}")
        stream = fs.open(mark)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def objects(self) -> DataFrame:
        """fid, target_fid (whose payload it reads), size, payload of all committed objects."""
        return self._read(self._batches())

    def _commit(self, df: DataFrame, seen: dict[int, str]) -> bool:
        """Writes a batch and takes the number after those seen; False, and nothing committed, if another writer has it."""
        folder, number = uuid.uuid4().hex, max(seen, default=-1) + 1
        where = f"{self.path}/objects/{folder}"
        df.select("fid", "target_fid", "size", "payload").write.option("compression", "zstd").parquet(where)
        fs, mark = file_system(self.spark, f"{self.path}/batches/{number:08d}")
        fs.mkdirs(mark.getParent())
        try:
            out = fs.create(mark, False)  # fails if it is there
        except Exception as e:  # noqa: BLE001
            if not fs.exists(mark):
                raise
            del e
            data, at = file_system(self.spark, where)
            data.delete(at, True)
            return False
        out.write(bytearray(folder.encode()))
        out.close()
        return True

    def put(self, rows: DataFrame) -> DataFrame:
        """Stores rows (seq, payload, alias_for); returns (seq, fid, status).

        status: ok, already_exists (also for a later row of the same batch), or
        invalid_argument with the reason. An alias is a second fid that reads the payload
        without its last byte. Payloads are written once; admission sees narrow rows only.
        """
        while True:
            seen = self._batches()
            verdict, new = self._decide(rows, self._read(seen).select("fid"))
            if self._commit(new, seen):
                return verdict

    def _decide(self, rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(seq, fid, status) of the rows, and the objects to store."""
        x = rows.select("seq", "payload", F.nullif("alias_for", F.lit(0)).alias("alias_for"), xxh3("payload").alias("fid"), F.coalesce(F.octet_length("payload"), F.lit(0)).cast("long").alias("total_size"))
        verdict = writes.admit(x.drop("payload"), known, self.settings.max_put)
        clash = reads.exists(x.where("alias_for is not null").select("seq", F.col("alias_for").alias("fid")), known).select("seq", F.lit(True).alias("clash"))
        status = F.when(F.col("clash") & (F.col("status") == "ok"), "already_exists").otherwise(F.col("status"))
        verdict = verdict.join(clash, "seq", "left").select("seq", "fid", status.alias("status")).persist()
        ok = x.join(verdict.where("status = 'ok'").select("seq"), "seq", "left_semi")
        direct = ok.select("fid", F.col("fid").alias("target_fid"), F.col("total_size").alias("size"), "payload")
        alias = ok.where("alias_for is not null").select(F.col("alias_for").alias("fid"), F.col("fid").alias("target_fid"), (F.col("total_size") - 1).alias("size"), F.lit(None).cast("binary").alias("payload"))
        verdict.count()
        return verdict, direct.unionByName(alias)

    def put_bytes(self, data: bytes, alias_for: int | None = None) -> dict:
        """Stores one payload; fid, is_duplicate, jumps_taken. ValueError if refused."""
        row = self.put(self.spark.createDataFrame([(0, bytearray(data), alias_for)], "seq long, payload binary, alias_for long")).first()
        if row["status"].startswith("invalid"):
            raise ValueError(row["status"])
        return {"fid": row["fid"], "target_fid": row["fid"], "jumps_taken": 0, "is_duplicate": row["status"] == "already_exists"}

    def put_file(self, path: str, cdc: bool = False, atomic: bool = False) -> dict:
        """Stores a file: as one object up to 16 MiB, else in content-defined chunks with a manifest."""
        if cdc and atomic:
            raise ValueError("cdc and atomic exclude each other")
        size = os.path.getsize(path)
        if atomic and size > ATOMIC_LIMIT:
            raise ValueError("payload too large")
        if cdc or (not atomic and size > ATOMIC_LIMIT):
            return self._put_chunks(self.spark.read.format("binaryFile").load(path).select(F.col("content").alias("payload")), os.path.basename(path))
        with open(path, "rb") as f:
            return self.put_bytes(f.read())

    def put_cdc(self, data: bytes, filename: str = "") -> dict:
        """Stores chunks and their manifest; manifest_fid, chunks, uploaded and deduplicated counts."""
        return self._put_chunks(self.spark.createDataFrame([(bytearray(data),)], "payload binary"), filename)

    def _put_chunks(self, file: DataFrame, filename: str) -> dict:
        """put_cdc of the one row of file (payload): it is cut, hashed and stored by a task; the driver sees the chunks' descriptors."""
        one = file.withColumn("file_id", F.lit(0).cast("long"))
        parts = cut(chunking.chunk(one, *self.cdc))
        chunks = parts.select("idx", "fid", "byte_offset", "size").orderBy("idx").collect()
        if not chunks:
            raise ValueError("invalid_argument:empty")
        done = self.put(parts.select(F.col("idx").cast("long").alias("seq"), "payload", F.lit(None).cast("long").alias("alias_for")))
        uploaded = done.where("status = 'ok'").count()
        content = one.select(xxh3("payload")).first()[0]
        listed = [{"fid": c["fid"], "target_fid": 0, "byte_offset": c["byte_offset"], "size": c["size"], "jumps_taken": 0} for c in chunks]
        m = codecs.encode_manifest({"total_size": sum(c["size"] for c in chunks), "full_content_hash": content, "filename": filename, "chunk_target_size": self.cdc[1], "chunks": listed})
        return {"manifest_fid": self.put_bytes(m)["fid"], "chunks": len(chunks), "uploaded": uploaded, "deduplicated": len(chunks) - uploaded}

    def get_many(self, requests: DataFrame) -> DataFrame:
        """(req_id, fid, status, start, end, data) of requests (req_id, fid, range_start, range_end)."""
        asked = self.objects().join(requests.select("fid").distinct(), "fid", "left_semi")
        direct = asked.where("payload is not null").select("fid", "payload")
        alias = asked.where("payload is null").select("fid", "target_fid", "size")
        target = self.objects().where("payload is not null").select(F.col("fid").alias("target_fid"), "payload")
        alias = alias.join(target, "target_fid").select("fid", F.substring(F.col("payload"), F.lit(1), F.col("size").cast("int")).alias("payload"))
        return reads.get(requests, direct.unionByName(alias))

    def get(self, fid: int, start: int = 0, end: int = 0) -> bytes:
        """Bytes [start, end) of an object; end 0 or beyond its size means its size."""
        r = self.get_many(self.spark.createDataFrame([(0, signed(fid), start, end)], "req_id long, fid long, range_start long, range_end long")).first()
        if r["status"] == "not_found":
            raise NotFound(fid)
        if r["status"] != "ok":
            raise ValueError(r["status"])
        return bytes(r["data"])

    def inspect_manifest(self, fid: int) -> dict:
        return codecs.decode_manifest(self.get(fid))

    def get_cdc(self, fid: int, start: int = 0, end: int = 0) -> bytes:
        """Bytes [start, end) of a file in chunks; an empty or inverted range gives none. Checked against the
        file's hash when read whole; a chunk that is gone is NotFound."""
        m = self.inspect_manifest(fid)
        d = self.spark.createDataFrame([(0, m["total_size"], [(c["byte_offset"], k, c["fid"], c["size"]) for k, c in enumerate(m["chunks"])])], "file_id long, total_size long, chunks array<struct<byte_offset:long,idx:int,fid:long,size:long>>")
        r = self.spark.createDataFrame([(0, 0, start, end)], "req_id long, file_id long, range_start long, range_end long")
        row = chunking.read_sparse(chunking.sparse_range(d, r), self.objects()).first()
        data = bytes(row["data"]) if row else b""
        if row and row["missing"]:
            raise NotFound(fid)
        if len(data) == m["total_size"] and content_fid(data) != m["full_content_hash"]:
            raise ValueError("content hash differs")
        return data

    def get_auto(self, fid: int, start: int = 0, end: int = 0) -> bytes:
        """get_cdc for a manifest, else get."""
        probe = self.get(fid, 0, 5)
        return self.get_cdc(fid, start, end) if probe == codecs.MANIFEST_MAGIC else self.get(fid, start, end)

    def head(self, fid: int) -> int:
        row = self.objects().where(F.col("fid") == signed(fid)).agg(F.max("size").alias("size")).first()
        if row["size"] is None:
            raise NotFound(fid)
        return row["size"]

    def verify(self, expected: DataFrame) -> DataFrame:
        """(fid, status) of expected (fid, payload) against the store."""
        return reads.verify_content(expected, self.objects().where("payload is not null"))

    def compact(self) -> None:
        """Rewrites all batches as one, each object once: the store's own small files. Old batches go after the new one is there; their files stay for readers that have begun."""
        while len(seen := self._batches()) > 1:
            if self._commit(self._read(seen).dropDuplicates(["fid"]), seen):
                for n in seen.values():
                    fs, mark = file_system(self.spark, f"{self.path}/batches/{n}")
                    fs.delete(mark, False)
