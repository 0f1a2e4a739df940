"""Hashes of spans of an array, and a bit set of bounded size that tells what cannot be in a set."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(max(n, 1), dtype=np.uint64)
    have, step = 1, base
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(step)
        step, have = step * step % (1 << 64), have + more
    return out


class Spans:
    """Hashes of any spans of an array of code points; equal spans have equal ones. They serve to rule out, never to decide."""

    def __init__(self, codes: np.ndarray):
        values = (codes.astype(np.uint64) + np.uint64(1)) * _A
        values ^= values >> np.uint64(29)
        self.sums = np.zeros(len(codes) + 1, dtype=np.uint64)
        np.cumsum(values * _powers(_BASE, len(codes)), out=self.sums[1:])
        self.back = _powers(_INVERSE, len(codes) + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(np.uint64) * _B
        h = (h ^ (h >> np.uint64(31))) * _B
        return h ^ (h >> np.uint64(29))


def bit_places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a set of 2 ** bits bits."""
    mask = np.uint64((1 << bits) - 1)
    return (h & mask).astype(np.int64), ((h >> np.uint64(32)) & mask).astype(np.int64)


def bit_set(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bit set of a column h of hashes (as long): 2 ** bits bits, however many rows there are; it is put together in the tasks."""
    places = [F.col("h").bitwiseAND(F.lit((1 << bits) - 1)), F.shiftright("h", 32).bitwiseAND(F.lit((1 << bits) - 1))]
    at = hashes.select(F.explode(F.array(*places)).alias("at"))
    words = at.groupBy(F.shiftright("at", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 31 as int))")).alias("set")).collect()
    out = np.zeros(1 << (bits - 5), dtype=np.uint32)
    for r in words:
        out[r["word"]] = r["set"]
    return out


def may_hold(set_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may be in the set; a no is certain."""
    bits = int(len(set_) * 32).bit_length() - 1
    out = np.ones(len(h), dtype=bool)
    for at in bit_places(h, bits):
        out &= (set_[at >> 5] >> (at & 31).astype(np.uint32)) & np.uint32(1) != 0
    return out
