"""Content identity: XXH3-64 in Arrow batches, jump fids, CHD sample fids, and an md5 fid for SQL oracles."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import CHD_SAMPLES, MAX_JUMPS, signed


#: Nonces tried for a container and for a packed table.
NONCES = 256


def content_fid(data: bytes) -> int:
    """The fid of a payload as a signed LONG: XXH3-64, seed 0."""
    return signed(xxhash.xxh3_64_intdigest(data))


def jump_fid(data: bytes, jump: int) -> int:
    """The fid of a payload followed by one jump byte (1..255)."""
    if not 1 <= jump <= MAX_JUMPS:
        raise ValueError(f"jump {jump} is not in 1..{MAX_JUMPS}")
    return content_fid(data + bytes([jump]))


def jump_fids(data: bytes, most: int = MAX_JUMPS) -> list[int]:
    """jump_fid for 1..most with the payload hashed once."""
    whole = xxhash.xxh3_64(data)
    out = []
    for j in range(1, most + 1):
        h = whole.copy()
        h.update(bytes([j]))
        out.append(signed(h.intdigest()))
    return out


@F.pandas_udf(T.LongType())
def xxh3(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """BINARY -> fid. Null stays null; an empty payload has the fid of no bytes."""
    for b in batches:
        yield pd.Series([None if x is None else content_fid(bytes(x)) for x in b], dtype="Int64")


@F.pandas_udf(T.ArrayType(T.LongType()))
def xxh3_jumps(payload: pd.Series, most: pd.Series) -> pd.Series:
    """(BINARY, most) -> the jump fids 1..most. Null stays null."""
    return pd.Series([None if x is None else jump_fids(bytes(x), int(n)) for x, n in zip(payload, most, strict=True)])


def md5_fid(payload: Column) -> Column:
    """The first 64 bits of md5 as a signed LONG: the identity that SQL engines can check."""
    h = F.substring(F.md5(payload.cast("binary")), 1, 16)
    # Two halves of 32 bits stay inside LONG arithmetic.
    hi, lo = F.conv(F.substring(h, 1, 8), 16, 10).cast("long"), F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def sample_fids(disk_id: int, samples: int = CHD_SAMPLES) -> list[int]:
    """The fids that probe a disk's free room; disk_id is written as an unsigned decimal."""
    return [content_fid(f"chd:{disk_id & (2**64 - 1)}:{i}".encode()) for i in range(samples)]


def file_fid(path: str, block: int = 1 << 20) -> tuple[int, int]:
    """(fid, size) of a file, read in blocks; a folder raises IsADirectoryError."""
    h, n = xxhash.xxh3_64(), 0
    with open(path, "rb") as f:
        while data := f.read(block):
            h.update(data)
            n += len(data)
    return signed(h.intdigest()), n


def nonce_fids(payload: bytes, tries: int = 256) -> Iterator[tuple[int, bytes]]:
    """(fid, payload) of a container as it is, then with 8-byte counters 1, 2, ... appended one after another; hashed once."""
    h, tail = xxhash.xxh3_64(payload), b""
    for nonce in range(tries):
        if nonce:
            step = nonce.to_bytes(8, "little")
            h.update(step)
            tail += step
        yield signed(h.intdigest()), payload + tail


@F.pandas_udf(T.ArrayType(T.LongType()))
def container_fids(payload: pd.Series) -> pd.Series:
    """BINARY -> the fids of nonce_fids(), as they come, without the payloads."""

    def of(data: bytes) -> list[int]:
        h = xxhash.xxh3_64(data)
        out = [signed(h.intdigest())]
        for nonce in range(1, NONCES):
            h.update(nonce.to_bytes(8, "little"))
            out.append(signed(h.intdigest()))
        return out

    return payload.map(lambda x: of(bytes(x)))


def auto_disk_id(path: str, size: int, salt: bytes) -> int:
    """A disk id from size, path and 16 random bytes, which the caller gives."""
    digest = hashlib.sha256(size.to_bytes(8, "little") + path.encode() + salt).digest()
    return signed(int.from_bytes(digest[:8], "little"))


def auto_disk_id_column(path: Column, size: Column, salt: Column) -> Column:
    """auto_disk_id on columns (salt BINARY)."""
    from .codecs import little_endian

    h = F.sha2(F.concat(little_endian(size, 8), path.cast("binary"), salt), 256)
    half = lambda i: F.conv(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in reversed(range(i, i + 4)))), 16, 10).cast("long")
    return F.shiftleft(half(4), 32).bitwiseOR(half(0))
