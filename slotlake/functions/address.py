"""Slots, addresses, powers of two and interval overlap as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import GRID_START, SLOT_BYTES, unsigned_mod


def slot_count(disk_bytes: Column) -> Column:
    """Whole slots of the grid; 0 for a disk that ends before it."""
    return F.greatest(F.floor((disk_bytes - GRID_START) / SLOT_BYTES), F.lit(0)).cast("long")


def slots_needed(size: Column) -> Column:
    return F.ceil(size / SLOT_BYTES).cast("long")


def address(slots: Column, fid: Column, size: Column) -> Column:
    """struct(slot, need, addr, reason): where an object lies on a grid of `slots`.

    reason is null when it fits, else no_slots, empty or too_large; then slot and addr
    are null.
    """
    need = slots_needed(size)
    reason = F.when(slots <= 0, "no_slots").when(need <= 0, "empty").when(need > slots, "too_large")
    slot = F.when(reason.isNull(), unsigned_mod(fid, F.greatest(slots - need + 1, F.lit(1))))
    return F.struct(slot.alias("slot"), need.alias("need"), (slot * SLOT_BYTES + GRID_START).alias("addr"), reason.alias("reason"))


def floor_log2(x: Column) -> Column:
    """Bit length minus one; 0 for 0. Exact for every positive LONG."""
    return F.when(x > 0, F.length(F.bin(x)) - 1).otherwise(0)


def pow2_bytes(p: Column) -> Column:
    """2^p in LONG: 1 for p <= 0, capped at 2^62."""
    return F.when(p <= 0, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.least(p, F.lit(62))).cast("long"))


def small_file_bytes(pow2: int) -> int:
    """Size below which an object is small; 0 for a negative power, unlimited from 51 up."""
    if pow2 < 0:
        return 0
    return 2**64 - 1 if pow2 >= 51 else 1 << (12 + pow2)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two inclusive intervals share a slot."""
    return (a_start <= b_end) & (b_start <= a_end)


def padded(payload: Column) -> Column:
    """The payload with zero bytes up to the end of its last slot."""
    want = (slots_needed(F.octet_length(payload)) * SLOT_BYTES - F.octet_length(payload)).cast("int")
    return F.concat(payload, F.unhex(F.repeat(F.lit("00"), want)))
