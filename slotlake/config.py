"""Settings: defaults, a TOML file over them, flags over both."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, replace

from .functions.parse import parse_size
from .types import CHD_TARGET_P, MAX_PUT, SMALL_FILE_POW2, TRIM_MAX_THRESHOLD, TRIM_MIN_FILES, TRIM_MIN_THRESHOLD, TRIM_RATIO


@dataclass(frozen=True)
class Settings:
    pan_path: str = "pan.json"
    grpc_listen: str = ":9090"
    max_put: int = MAX_PUT
    reservation_stall_timeout_ms: int = 30_000
    pool_gate_fanout_timeout_ms: int = 2_000
    write_dispatch_concurrency: int = 64
    small_file_pow2: int = SMALL_FILE_POW2
    chd_target_p: float = CHD_TARGET_P
    zram_snapshot_dir: str = "~/.slotlake_zram_snapshots"
    trim_interval_seconds: float = 900
    trim_min_threshold_bytes: int = TRIM_MIN_THRESHOLD
    trim_max_threshold_bytes: int = TRIM_MAX_THRESHOLD
    trim_min_file_count: int = TRIM_MIN_FILES
    trim_threshold_ratio: float = TRIM_RATIO
    trim_temp_dir: str = ""


#: What each value must satisfy, and how that reads.
_RULES = {
    "reservation_stall_timeout_ms": (lambda v: v > 0, "positive"),
    "pool_gate_fanout_timeout_ms": (lambda v: v > 0, "positive"),
    "write_dispatch_concurrency": (lambda v: v > 0, "positive"),
    "small_file_pow2": (lambda v: v >= 0, ">= 0"),
    "chd_target_p": (lambda v: 0 < v <= 1, "in (0, 1]"),
    "trim_interval_seconds": (lambda v: v > 0, "positive"),
    "trim_min_file_count": (lambda v: v >= 0, ">= 0"),
    "trim_threshold_ratio": (lambda v: 0 <= v <= 1, "in [0, 1]"),
}
_SIZES = ("max_put", "trim_min_threshold_bytes", "trim_max_threshold_bytes")
_TEXTS = ("pan_path", "grpc_listen", "zram_snapshot_dir", "trim_temp_dir")
_SECONDS = {"h": 3600.0, "m": 60.0, "s": 1.0, "ms": 1e-3, "us": 1e-6, "µs": 1e-6, "ns": 1e-9}


def parse_duration(text: str) -> float:
    """Seconds of '15m', '1h30m', '250ms'; ValueError if malformed."""
    parts = re.findall(r"(\d+(?:\.\d*)?|\.\d+)(ns|us|µs|ms|h|m|s)", text)
    if not parts or "".join(a + b for a, b in parts) != text.strip():
        raise ValueError(f"not a duration: {text!r}")
    return sum(float(a) * _SECONDS[b] for a, b in parts)


def load(path: str | None = None, **flags) -> Settings:
    """Defaults, then the file, then the flags that are not None. Blank texts in the file do not count.

    trim_interval (a duration) may stand for trim_interval_seconds, which wins if both are
    there. Unknown keys of the file are ignored. ValueError names a value out of bounds.
    """
    values: dict = {}
    if path:
        with open(path, "rb") as f:
            raw = tomllib.load(f)
        if str(raw.get("trim_interval", "")).strip():
            values["trim_interval_seconds"] = parse_duration(raw["trim_interval"])
        for k in Settings.__dataclass_fields__:
            v = raw.get(k)
            if v is None or isinstance(v, str) and not v.strip():
                continue
            values[k] = parse_size(v) if k in _SIZES else v.strip() if k in _TEXTS else v
    for k, v in flags.items():
        if v is not None:
            values[k] = parse_size(v) if k in _SIZES and isinstance(v, str) else parse_duration(v) if k == "trim_interval_seconds" and isinstance(v, str) else v
    s = replace(Settings(), **values)
    for k, (fine, text) in _RULES.items():
        if not fine(getattr(s, k)):
            raise ValueError(f"{k} must be {text}")
    if 0 < s.trim_max_threshold_bytes < s.trim_min_threshold_bytes:
        raise ValueError("trim_min_threshold_bytes must be <= trim_max_threshold_bytes")
    return replace(s, zram_snapshot_dir=os.path.expanduser(s.zram_snapshot_dir))
