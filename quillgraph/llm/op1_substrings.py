"""Exact substring deduplication over bytes.

Strings that can hold a repeat are those whose minimiser stands in several segments; equal
segments count once (see ``repeats``). Inside each bucket of these strings, suffixes are sorted to
the threshold depth, the Burrows-Wheeler transform is read off, and intervals are
extended backwards breadth first: level l sets exactly the common-prefix values
equal to l, and the search stops at the threshold. Boundaries still open there
have a longer common prefix, so what lies between two set boundaries is one group
of equal windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import repeats, shared

#: Bytes of a repeated string.
LENGTH = 100


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of x (small non-negative codes) in the order of their first ``depth`` codes at least."""
    n = len(x)
    bits = max(1, int(x.max(initial=1)).bit_length())
    per = max(1, 62 // bits)
    key = np.zeros(n, dtype=np.int64)
    wide = np.concatenate([x.astype(np.int64), np.zeros(per, np.int64)])
    for i in range(per):
        key = (key << bits) | wide[i : i + n]
    order = np.argsort(key)
    k = key[order]
    rank = np.empty(n, dtype=np.int64)
    # A suffix ranks as the first of its equals.
    head = np.append(True, k[1:] != k[:-1])
    rank[order] = np.flatnonzero(head)[np.cumsum(head) - 1]
    have = per
    while have < depth:
        places = rank[order]
        tied = np.append(places[1:] == places[:-1], False)
        tied[1:] |= tied[:-1].copy()
        at = np.flatnonzero(tied)
        if not len(at):
            break
        own = order[at]
        then = own + have
        after = np.where(then < n, rank[np.minimum(then, n - 1)] + 1, 0)
        pair = rank[own] * (n + 1) + after
        by = np.argsort(pair)
        own, pair = own[by], pair[by]
        order[at] = own
        head = np.append(True, pair[1:] != pair[:-1])
        rank[own] = at[np.flatnonzero(head)[np.cumsum(head) - 1]]
        have *= 2
    return order


def prefix_groups(x: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For each rank, the number of its group of suffixes that share ``depth`` codes; code 0 ends strings and extends none."""
    n = len(x)
    bwt = np.where(order > 0, x[order - 1], 0).astype(np.uint8 if x.max(initial=0) < 256 else np.uint16)
    by = np.argsort(bwt, kind="stable")
    back = np.empty(n, dtype=np.int64)
    back[by] = np.arange(n)
    sorted_keys = bwt[by].astype(np.int64) * n + by
    # The next place with the same code, or n.
    follow = np.full(n, n, dtype=np.int64)
    same = bwt[by[1:]] == bwt[by[:-1]]
    follow[by[:-1][same]] = by[1:][same]
    lcp = np.full(n + 1, -1, dtype=np.int32)
    lcp[0] = lcp[n] = 0
    counts = np.bincount(x, minlength=1)
    edges = np.append(0, np.cumsum(counts))
    present = np.flatnonzero(counts)
    low, high = edges[present], edges[present + 1]
    lcp[high] = 0
    for level in range(1, depth):
        size = high - low
        total = int(size.sum())
        if not total:
            break
        which = np.repeat(np.arange(len(low)), size)
        at = np.arange(total) + np.repeat(low - (np.cumsum(size) - size), size)
        last = np.flatnonzero((follow[at] >= high[which]) & (bwt[at] > 0))
        at, which = at[last], which[last]
        up = back[at] + 1
        new = lcp[up] < 0
        at, which, up = at[new], which[new], up[new]
        lcp[up] = level
        low = np.searchsorted(sorted_keys, bwt[at].astype(np.int64) * n + low[which])
        high = up
    return np.cumsum(lcp[:n] >= 0) - 1


class Bytes(repeats.Units):
    gram_bits = 5
    result = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def __init__(self, window: int = LENGTH):
        if window < 64:
            raise ValueError("window must be 64 bytes at least")  # grams of 32
        self.window = window

    def units(self, flat, offsets):
        places = np.arange(len(flat))
        return shared._BYTE[flat], offsets, np.ascontiguousarray(flat), places, places + 1

    def split(self, text):
        return text

    def pack(self, run):
        return run

    def repeated(self, strings, order):
        flat = np.frombuffer(b"".join(strings), dtype=np.uint8)
        sizes = np.array([len(s) for s in strings])
        ends = np.cumsum(sizes)
        used = np.unique(flat)
        code = np.zeros(256, dtype=np.int64)
        code[used] = np.arange(1, len(used) + 1)
        x = np.zeros(len(flat) + len(strings), dtype=np.int64)
        whose = np.repeat(np.arange(len(strings)), sizes)
        x[np.arange(len(flat)) + whose] = code[flat]
        starts = np.append(0, ends[:-1]) + np.arange(len(strings))
        ranks = suffix_order(x, self.window)
        groups = prefix_groups(x, ranks, self.window)
        string = np.searchsorted(starts, ranks, "right") - 1
        offset = ranks - starts[string]
        valid = offset + self.window <= sizes[string]
        string, offset, groups = string[valid], offset[valid], groups[valid]
        if not len(groups):
            return string, offset
        when = order[string] + offset
        head = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
        earliest = np.repeat(np.minimum.reduceat(when, head), np.diff(np.append(head, len(groups))))
        again = when > earliest
        return string[again], offset[again]

    def row(self, text, covered):
        if not len(covered):
            return len(text), 0, 0, hashlib.sha256(text).hexdigest()
        kept, at = [], 0
        for a, b in covered.tolist():
            kept.append(text[at:a])
            at = b
        kept.append(text[at:])
        return len(text), int((covered[:, 1] - covered[:, 0]).sum()), len(covered), hashlib.sha256(b"".join(kept)).hexdigest()


class KeptBytes(Bytes):
    """As Bytes, with the remaining bytes themselves."""

    result = f"{Bytes.result}, kept binary"

    def row(self, text, covered):
        gone = np.zeros(len(text) + 1, dtype=bool)
        for a, b in covered.tolist():
            gone[a:b] = True
        return (*super().row(text, covered), np.frombuffer(text, dtype=np.uint8)[~gone[:-1]].tobytes())


def remove_repeated_substrings(docs: DataFrame, length: int = LENGTH, texts: bool = False, bits: int = 64) -> DataFrame:
    """Remove every byte covered by a ``length``-byte string that also starts earlier.

    Input: doc_id, text; other columns are ignored. One row per input row: doc_id,
    n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, and with ``texts``
    the kept bytes. A null or empty text has 0 bytes and the digest of nothing; a null
    doc_id comes before all others; rows that repeat a doc_id and a text are one
    document; rows that share a doc_id alone are ordered by their texts' hash. No rows
    give no rows. A text is worked on whole: a worker holds some hundred times its bytes.
    ``bits``: of the hashes that bring strings together; the result does not depend on it.
    """
    return repeats.remove_repeats(docs, KeptBytes(length) if texts else Bytes(length), bits)
