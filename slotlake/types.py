"""Constants of the data model and unsigned arithmetic on LONG columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the on-disk format.
SLOT_BYTES = 4096
GRID_START = 0x10000000
INDEX_START = 4096
INDEX_BYTES = GRID_START - INDEX_START
ENTRY_BYTES = 16
CAPACITY_UNIT = 1_000_000_000
JUMP_SENTINEL = 2**56 - 1
PACKED_SENTINEL = 2**56 - 2
ANCHOR_CODE = 0xFF

# Fixed default values of the service.
MAX_PUT = 256 << 20
ATOMIC_LIMIT = 16 << 20
STREAM_CHUNK = 1 << 20
MAX_JUMPS = 255
SMALL_FILE_POW2 = 6
CHD_TARGET_P = 0.2
CHD_SAMPLES = 64
TRIM_MIN_THRESHOLD = 4096
TRIM_MAX_THRESHOLD = 256 << 20
TRIM_MIN_FILES = 100
TRIM_RATIO = 0.20
TRIM_BATCH = (8 << 20, 256 << 20)
CDC_SIZES = (4 << 20, 16 << 20, 32 << 20)
MANIFEST_MAGIC = b"BSMN\x01"
PACKED_MAGIC = b"NBPT"
HEADER_MAGIC = b"NBSS"

TWO63 = 1 << 63
TWO64 = 1 << 64


def signed(value: int) -> int:
    """The 64 bits of an unsigned value as a signed LONG."""
    value &= TWO64 - 1
    return value - TWO64 if value >= TWO63 else value


def unsigned_mod(x: Column, n: Column) -> Column:
    """x mod n with x read as unsigned 64 bits; 0 < n < 2^61. Stays in LONG arithmetic."""
    half = F.pmod(F.shiftrightunsigned(x, 1), n)
    return F.pmod(half * 2 + x.bitwiseAND(F.lit(1)), n)


def unsigned_decimal(x: Column) -> Column:
    """The unsigned value of 64 raw bits as DECIMAL(20,0)."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit(str(TWO64)).cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def unsigned_order(x: Column) -> Column:
    """A LONG whose signed order is the unsigned order of x."""
    return x.bitwiseXOR(F.lit(-TWO63).cast("long"))


def hex_fid(x: Column) -> Column:
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(x), 16, "0"))
