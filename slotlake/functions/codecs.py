"""Byte layouts: index entries, disk headers, packed tables, chunk manifests, snapshot side files.

Each codec is plain Python over bytes; the *_udf functions run them in Arrow batches.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import ANCHOR_CODE, ENTRY_BYTES, HEADER_MAGIC, JUMP_SENTINEL, MANIFEST_MAGIC, PACKED_MAGIC, PACKED_SENTINEL, signed

_U64 = 2**64 - 1


def _row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _frame(rows: list[dict], type_: T.StructType) -> pd.DataFrame:
    """Rows as a frame of the type; what a row lacks is null, also in integer and array columns."""
    kinds = {T.LongType: "Int64", T.IntegerType: "Int32"}
    return pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=kinds.get(type(f.dataType), object)) for f in type_})


_LONG, _INT, _TEXT = T.LongType(), T.IntegerType(), T.StringType()
_HEADER = struct.Struct("<4sHHQ")
_PACKED = struct.Struct("<4sHHQQQQQ")
_PACKED_ENTRY = struct.Struct("<QQQ")
HEADER_BYTES = 4096
NOTE_BYTES = HEADER_BYTES - _HEADER.size
HEADER_VERSION = 2
PACKED_VERSION = 1


def encode_size(size: int) -> bytes:
    """56 bits, little-endian."""
    if not 0 <= size <= JUMP_SENTINEL:
        raise ValueError(f"size {size} exceeds 56 bits")
    return size.to_bytes(7, "little")


def decode_size(data: bytes) -> int:
    return int.from_bytes(data[:7], "little")


def little_endian(x: Column, size: int) -> Column:
    """The lowest `size` bytes of a LONG, little-endian, as BINARY."""
    return F.unhex(F.concat(*(F.lpad(F.hex(F.shiftrightunsigned(x, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size))))


def size7_bytes(x: Column) -> Column:
    """encode_size on a column; null beyond 56 bits."""
    return F.when((x >= 0) & (x <= JUMP_SENTINEL), little_endian(x, 7))


def size7_value(data: Column) -> Column:
    """decode_size on a column."""
    h = F.hex(data)
    return F.conv(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(7)))), 16, 10).cast("long")


def encode_entry(fid: int, size: int, code: int) -> bytes:
    """16 bytes; a non-zero code needs a sentinel size that goes with it."""
    if not 0 <= code <= 255:
        raise ValueError(f"code {code} is not a byte")
    if code and size != JUMP_SENTINEL and not (code == ANCHOR_CODE and size == PACKED_SENTINEL):
        raise ValueError("a code needs its sentinel size")
    return (fid & _U64).to_bytes(8, "little") + encode_size(size) + bytes([code])


def decode_entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fid, size, code) of all whole entries."""
    raw = np.frombuffer(data, dtype=np.uint8, count=len(data) // ENTRY_BYTES * ENTRY_BYTES).reshape(-1, ENTRY_BYTES)
    words = raw.copy().view("<u8")
    return words[:, 0].view(np.int64), (words[:, 1] & np.uint64(JUMP_SENTINEL)).astype(np.int64), raw[:, 15].astype(np.int32)


@F.pandas_udf(T.ArrayType(_row(fid=_LONG, size=_LONG, jump_code=_INT)))
def entries_udf(data: pd.Series) -> pd.Series:
    """An index stream as its entries up to the first aligned all-zero one. Null stays null."""

    def one(x: bytes | None) -> list[dict] | None:
        if x is None:
            return None
        fid, size, code = decode_entries(bytes(x))
        end = np.flatnonzero((fid == 0) & (size == 0) & (code == 0))
        n = int(end[0]) if len(end) else len(fid)
        return [{"fid": int(a), "size": int(b), "jump_code": int(c)} for a, b, c in zip(fid[:n], size[:n], code[:n], strict=True)]

    return data.map(one)


@F.pandas_udf(T.BinaryType())
def entry_bytes_udf(fid: pd.Series, size: pd.Series, code: pd.Series) -> pd.Series:
    """(fid, size, code) -> 16 bytes; null where they make no valid entry."""

    def one(f, s, c):
        try:
            return encode_entry(int(f), int(s), int(c))
        except (ValueError, TypeError, OverflowError):
            return None

    return pd.Series([one(*x) for x in zip(fid, size, code, strict=True)])


def encode_header(capacity_gb: int, disk_id: int, note: str = "", version: int = HEADER_VERSION) -> bytes:
    """The 4096-byte header; the note is cut to what fits before its NUL."""
    text = note.encode()[: NOTE_BYTES - 1]
    return _HEADER.pack(HEADER_MAGIC, version, capacity_gb, disk_id & _U64) + text.ljust(NOTE_BYTES, b"\0")


def decode_header(data: bytes) -> dict | None:
    """version, capacity_gb, disk_id, note; None without magic or room."""
    if len(data) < _HEADER.size or data[:4] != HEADER_MAGIC:
        return None
    _, version, capacity, disk = _HEADER.unpack_from(data)
    return {"version": version, "capacity_gb": capacity, "disk_id": signed(disk), "note": data[_HEADER.size : HEADER_BYTES].split(b"\0")[0].decode("utf-8", "replace")}


HEADER_TYPE = _row(version=_INT, capacity_gb=_INT, disk_id=_LONG, note=_TEXT)


@F.pandas_udf(HEADER_TYPE)
def header_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """The header of a disk image's first bytes; all null where there is none."""
    for b in batches:
        yield _frame([(None if x is None else decode_header(bytes(x))) or {} for x in b], HEADER_TYPE)


@F.pandas_udf(T.BinaryType())
def header_bytes_udf(capacity_gb: pd.Series, disk_id: pd.Series, note: pd.Series) -> pd.Series:
    """(capacity_gb, disk_id, note) -> the header's bytes; a null note is empty."""
    return pd.Series([encode_header(int(c), int(d), n or "") for c, d, n in zip(capacity_gb, disk_id, note, strict=True)])


#: Where a packed table's nonce lies.
NONCE_AT = 40


def encode_packed(disk_id: int, container_fid: int, container_size: int, entries: list[tuple[int, int, int]], nonce: int = 0) -> bytes:
    """A packed table; entries are (fid, offset, size)."""
    head = _PACKED.pack(PACKED_MAGIC, PACKED_VERSION, _PACKED.size, disk_id & _U64, container_fid & _U64, container_size, len(entries), nonce)
    return head + b"".join(_PACKED_ENTRY.pack(f & _U64, o, s) for f, o, s in entries)


@F.pandas_udf(T.BinaryType())
def packed_bytes_udf(disk_id: pd.Series, container_fid: pd.Series, container_size: pd.Series, nonce: pd.Series, entries: pd.Series) -> pd.Series:
    """(disk_id, container_fid, container_size, nonce, entries) -> a packed table's bytes."""
    rows = zip(disk_id, container_fid, container_size, nonce, entries, strict=True)
    return pd.Series([encode_packed(int(d), int(c), int(n), [(e["fid"], e["byte_offset"], e["size"]) for e in x], int(k)) for d, c, n, k, x in rows])


def packed_fault(data: bytes | None) -> str | None:
    """Why a packed table is not valid: the first rule it breaks, or None."""
    if data is None or len(data) < _PACKED.size:
        return "short"
    magic, version, head, _, _, container, count, _ = _PACKED.unpack_from(data)
    if magic != PACKED_MAGIC:
        return "magic"
    if version != PACKED_VERSION:
        return "version"
    if head != _PACKED.size:
        return "header_size"
    if container == 0:
        return "container_size"
    if len(data) != _PACKED.size + count * _PACKED_ENTRY.size:
        return "length"
    for _, offset, size in _PACKED_ENTRY.iter_unpack(data[_PACKED.size :]):
        if size == 0:
            return "entry_size"
        if offset + size > container:
            return "entry_range"
    return None


def decode_packed(data: bytes) -> dict:
    """disk_id, container_fid, container_size, nonce, entries; ValueError with the fault."""
    fault = packed_fault(data)
    if fault:
        raise ValueError(f"packed table: {fault}")
    _, _, _, disk, container, size, _, nonce = _PACKED.unpack_from(data)
    entries = [{"fid": signed(f), "byte_offset": o, "size": s} for f, o, s in _PACKED_ENTRY.iter_unpack(data[_PACKED.size :])]
    return {"disk_id": signed(disk), "container_fid": signed(container), "container_size": size, "nonce": nonce, "entries": entries}


PACKED_TYPE = _row(disk_id=_LONG, container_fid=_LONG, container_size=_LONG, nonce=_LONG, fault=_TEXT, entries=T.ArrayType(_row(fid=_LONG, byte_offset=_LONG, size=_LONG)))


@F.pandas_udf(PACKED_TYPE)
def packed_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """A packed table's bytes decoded; fault says why not."""
    for b in batches:
        rows = []
        for x in b:
            fault = packed_fault(None if x is None else bytes(x))
            rows.append({"fault": fault} if fault else decode_packed(bytes(x)) | {"fault": None})
        yield _frame(rows, PACKED_TYPE)


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 0x7F:
        out.append(value & 0x7F | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def _field(number: int, value: int | bytes | str) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value & _U64) if value else b""
    data = value.encode() if isinstance(value, str) else value
    return _varint(number << 3 | 2) + _varint(len(data)) + data if data else b""


def _read(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            if at >= len(data) or shift > 63:
                raise ValueError("manifest: cut off")
            b = data[at]
            at += 1
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return value & _U64
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind in (1, 5):
            at += 8 if kind == 1 else 4
        elif kind == 2:
            n = varint()
            if at + n > len(data):
                raise ValueError("manifest: cut off")
            yield key >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError("manifest: wire type")


# The field numbers of a manifest and of its chunks.
_MANIFEST = {"version": 1, "total_size": 2, "full_content_hash": 3, "filename": 4, "chunk_target_size": 5, "chunks": 6}
_CHUNK = {"fid": 1, "target_fid": 2, "byte_offset": 3, "size": 4, "jumps_taken": 5}


def encode_manifest(manifest: dict) -> bytes:
    """Magic and proto3 message; a missing version is written as 1."""
    m = manifest | {"version": manifest.get("version") or 1}
    parts = [MANIFEST_MAGIC, *(_field(n, m.get(k) or 0) for k, n in _MANIFEST.items() if k not in ("filename", "chunks")), _field(_MANIFEST["filename"], m.get("filename") or "")]
    for c in m.get("chunks") or []:
        data = b"".join(_field(n, c.get(k) or 0) for k, n in _CHUNK.items())
        parts += (_varint(_MANIFEST["chunks"] << 3 | 2), _varint(len(data)), data)
    return b"".join(parts)


def decode_manifest(data: bytes) -> dict:
    """The manifest; ValueError for a wrong magic, version or a message cut off."""
    if data[: len(MANIFEST_MAGIC)] != MANIFEST_MAGIC:
        raise ValueError("manifest: magic")
    names, chunk_names = {n: k for k, n in _MANIFEST.items()}, {n: k for k, n in _CHUNK.items()}
    out = {"version": 0, "total_size": 0, "full_content_hash": 0, "filename": "", "chunk_target_size": 0, "chunks": []}
    for n, v in _read(data[len(MANIFEST_MAGIC) :]):
        name = names.get(n)
        if name == "chunks":
            chunk = dict.fromkeys(_CHUNK, 0) | {chunk_names[a]: b for a, b in _read(v) if a in chunk_names}
            out["chunks"].append(chunk | {k: signed(chunk[k]) for k in ("fid", "target_fid")})
        elif name == "filename":
            out[name] = v.decode("utf-8", "replace")
        elif name:
            out[name] = v
    out["full_content_hash"] = signed(out["full_content_hash"])
    if out["version"] not in (0, 1):
        raise ValueError(f"manifest: version {out['version']}")
    out["version"] = 1
    return out


MANIFEST_TYPE = _row(
    version=_INT, total_size=_LONG, full_content_hash=_LONG, filename=_TEXT, chunk_target_size=_LONG, chunks=T.ArrayType(_row(fid=_LONG, target_fid=_LONG, byte_offset=_LONG, size=_LONG, jumps_taken=_INT))
)


@F.pandas_udf(T.BinaryType())
def manifest_bytes_udf(total: pd.Series, content: pd.Series, name: pd.Series, target: pd.Series, chunks: pd.Series) -> pd.Series:
    """(total_size, full_content_hash, filename, chunk_target_size, chunks) -> manifest bytes."""
    return pd.Series(
        [
            encode_manifest({"total_size": int(t or 0), "full_content_hash": int(h or 0), "filename": n or "", "chunk_target_size": int(g or 0), "chunks": [dict(c) for c in ch]})
            for t, h, n, g, ch in zip(total, content, name, target, chunks, strict=True)
        ]
    )


def _as_columns(manifest: dict) -> dict:
    """A decoded manifest with the bits of its unsigned numbers as LONG and INT have them: a -1 that was written comes back as -1."""
    chunks = [{k: signed(v) for k, v in c.items()} | {"jumps_taken": signed(c["jumps_taken"] << 32) >> 32} for c in manifest["chunks"]]
    return manifest | {k: signed(manifest[k]) for k in ("total_size", "chunk_target_size")} | {"chunks": chunks}


@F.pandas_udf(MANIFEST_TYPE)
def manifest_udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Manifest bytes decoded; all null where they are none."""
    for b in batches:
        rows = []
        for x in b:
            try:
                rows.append(_as_columns(decode_manifest(bytes(x))))
            except (ValueError, TypeError):
                rows.append({})
        yield _frame(rows, MANIFEST_TYPE)


def snapshot_meta(size: int, sha256: str) -> str:
    return f"{size} {sha256}\n"


def parse_snapshot_meta(text: str) -> tuple[int, str]:
    """(size, sha256) of a side file; ValueError if malformed."""
    parts = text.split()
    if len(parts) != 2 or len(parts[1]) != 64 or not parts[0].isdigit():
        raise ValueError("snapshot side file")
    return int(parts[0]), parts[1].lower()


def snapshot_meta_text(size: Column, sha256: Column) -> Column:
    """snapshot_meta on columns."""
    return F.concat(size.cast("string"), F.lit(" "), sha256, F.lit("\n"))


def snapshot_meta_columns(text: Column) -> tuple[Column, Column]:
    """(size, sha256) of a side file's text; both null where malformed."""
    parts = F.split(F.trim(F.regexp_replace(text, "[\\s]+", " ")), " ")
    ok = (F.size(parts) == 2) & (F.length(parts[1]) == 64) & parts[0].rlike("^[0-9]{1,18}$")
    return F.when(ok, parts[0].try_cast("long")), F.when(ok, F.lower(parts[1]))
