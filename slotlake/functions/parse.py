"""Texts of the command line and the configuration: sizes, ids, ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import hex_fid, signed

# The suffixes of a size, 1024-based.
UNITS = {"": 1, "B": 1, "K": 1 << 10, "KB": 1 << 10, "M": 1 << 20, "MB": 1 << 20, "G": 1 << 30, "GB": 1 << 30}


def parse_size(text: str, checked: bool = True) -> int:
    """Bytes of '4K', '1 MB', '512B'; ValueError if malformed or, checked, beyond 64 bits."""
    m = re.fullmatch(r"\s*(\d+)\s*([A-Za-z]*)\s*", text)
    if not m or m[2].upper() not in UNITS:
        raise ValueError(f"not a size: {text!r}")
    value = int(m[1]) * UNITS[m[2].upper()]
    if checked and value >= 1 << 64:
        raise ValueError(f"size beyond 64 bits: {text!r}")
    return value & (2**64 - 1)


def parse_size_column(text: Column) -> Column:
    """parse_size on a column; null where malformed or beyond a LONG."""
    t = F.upper(F.trim(text))
    digits = F.regexp_extract(t, r"^(\d{1,18})\s*(G|GB|M|MB|K|KB|B|)$", 1)
    unit = F.substring(F.regexp_extract(t, r"^(\d{1,18})\s*(G|GB|M|MB|K|KB|B|)$", 2), 1, 1)
    factor = F.when(unit == "G", 1 << 30).when(unit == "M", 1 << 20).when(unit == "K", 1 << 10).otherwise(1).cast("long")
    return F.when(digits != "", F.try_multiply(digits.cast("long"), factor))


def parse_id(text: str) -> int:
    """A disk id or fid, base by prefix (0x, 0o, 0b, leading 0 for octal, else decimal), as a signed LONG."""
    t = text.strip().replace("_", "")
    value = int(t, 8) if re.fullmatch(r"0[0-7]+", t) else int(t, 0)
    if not 0 <= value < 1 << 64:
        raise ValueError(f"not an unsigned 64-bit id: {text!r}")
    return signed(value)


def disk_id_text(disk_id: Column) -> Column:
    """0x and upper-case hex digits without leading zeros; empty for 0."""
    return F.when(disk_id == 0, "").otherwise(F.concat(F.lit("0x"), F.hex(disk_id)))


def fid_text(fid: Column) -> Column:
    return F.concat(F.lit("0x"), hex_fid(fid))


def parse_range(text: str) -> tuple[int, int]:
    """'a-b' or 'a-' as [a, b), b = 0 for the end; ValueError if malformed."""
    m = re.fullmatch(r"(\d+)-(\d*)", text.strip())
    if not m:
        raise ValueError(f"not a range: {text!r}")
    return int(m[1]), int(m[2] or 0)


def range_columns(text: Column) -> tuple[Column, Column]:
    """(start, end) of a range text; both null where malformed, end 0 where open."""
    ok = text.rlike(r"^\s*\d{1,18}-\d{0,18}\s*$")
    parts = F.split(F.trim(text), "-")
    end = F.when(parts[1] == "", "0").otherwise(parts[1])
    return F.when(ok, parts[0].try_cast("long")), F.when(ok, end.try_cast("long"))


def all_zero(payload: Column) -> Column:
    """Whether every byte is 0; true for no bytes."""
    return payload == F.unhex(F.repeat(F.lit("00"), F.octet_length(payload)))


def is_zram_path(path: Column) -> Column:
    return F.concat(F.lit("/"), path).rlike(r"/zram[0-9]+$")


def gib_text(size: Column) -> Column:
    return F.format_string("%.2f GiB", size / float(1 << 30))
