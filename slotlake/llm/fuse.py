"""Peeling-based fingerprint filters (three-way, immutable) over 64-bit keys, in numpy.

A filter maps each key to three slots, one per third of its table, and stores numbers
such that the XOR of the three slots is the key's fingerprint. Building peels keys off
slots that only one of them uses, in rounds over whole arrays, and then assigns the
slots in reverse order of the rounds. A key that was built in is always found; another
is found with probability 2^-bits.
"""

from __future__ import annotations

import struct

import numpy as np

#: Bits of a fingerprint: 8, 16 or 32.
BITS = 16
#: Slots per key; peeling succeeds with high probability from 1.23 up.
SLOTS_PER_KEY = 1.23
_HEAD = struct.Struct("<BqqQ")


def mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijective mixing of 64-bit values, seeded."""
    h = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    with np.errstate(over="ignore"):
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(33)
    return h


def _slots(h: np.ndarray, third: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t = np.uint64(third)
    m = np.uint64(0x1FFFFF)
    return tuple((((h >> np.uint64(s)) & m) * t >> np.uint64(21)).astype(np.int64) + i * third for i, s in enumerate((0, 21, 42)))


def _wide_slots(h: np.ndarray, third: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As _slots, for tables too large for 21 bits a slot."""
    return tuple((mix(h, i + 1) % np.uint64(third)).astype(np.int64) + i * third for i in range(3))


def slots_of(h: np.ndarray, third: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _slots(h, third) if third < 1 << 18 else _wide_slots(h, third)


def _fingerprint(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h, 77) >> np.uint64(64 - bits)).astype(f"u{bits // 8}")


def build(keys: np.ndarray, bits: int = BITS) -> bytes:
    """The filter over the distinct keys, as bytes. No keys give a filter that finds nothing."""
    keys = np.unique(np.asarray(keys).astype(np.int64).view(np.uint64))
    n = len(keys)
    if not n:
        return _HEAD.pack(bits, 0, 0, 0)
    third = int(n * SLOTS_PER_KEY / 3) + 11
    for seed in range(1, 1000):
        h = mix(keys, seed)
        slots = np.stack(slots_of(h, third))
        order = _peel(slots, 3 * third)
        if order is not None:
            break
    else:
        raise RuntimeError("no seed peels these keys")
    table, prints = np.zeros(3 * third, dtype=f"u{bits // 8}"), _fingerprint(h, bits)
    for ids, own in reversed(order):
        s = slots[:, ids]
        others = table[s[0]] ^ table[s[1]] ^ table[s[2]]  # the own slot still holds 0
        table[own] = prints[ids] ^ others
    return _HEAD.pack(bits, n, third, seed) + table.tobytes()


def _peel(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """Rounds of (key numbers, the slot each is alone in); None if a core is left."""
    n = slots.shape[1]
    left, rounds = np.arange(n), []
    count = np.bincount(slots.ravel(), minlength=size)
    who = np.zeros(size, dtype=np.int64)
    for row in slots:
        np.bitwise_xor.at(who, row, np.arange(n))
    while len(left):
        single = np.flatnonzero(count == 1)
        if not len(single):
            return None
        ids, first = np.unique(who[single], return_index=True)
        own = single[first]
        rounds.append((ids, own))
        gone = slots[:, ids]
        np.subtract.at(count, gone.ravel(), 1)
        for row in gone:
            np.bitwise_xor.at(who, row, ids)
        keep = np.ones(n, dtype=bool)
        keep[ids] = False
        left = left[keep[left]]
        if len(left):
            continue
    return rounds


class Probe:
    """A built filter, ready to be asked."""

    def __init__(self, blob: bytes) -> None:
        self.bits, self.n, self.third, self.seed = _HEAD.unpack_from(blob)
        self.table = np.frombuffer(blob, dtype=f"u{self.bits // 8}", offset=_HEAD.size)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        if not self.n:
            return np.zeros(len(keys), dtype=bool)
        h = mix(np.asarray(keys).astype(np.int64).view(np.uint64), self.seed)
        a, b, c = slots_of(h, self.third)
        return (self.table[a] ^ self.table[b] ^ self.table[c]) == _fingerprint(h, self.bits)

    @property
    def error_rate(self) -> float:
        return 2.0**-self.bits if self.n else 0.0


def compounded(rates: list[float]) -> float:
    """The chance that at least one of several filters answers wrongly."""
    right = 1.0
    for r in rates:
        right *= 1.0 - r
    return 1.0 - right
