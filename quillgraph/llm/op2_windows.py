"""Exact removal of repeated word windows by super-k-mer partitioning.

Consecutive windows that share a minimiser form one packed string. Equal strings are
merged by their digest; where different strings share a minimiser they travel, packed, to
its bucket, where the windows of all strings are sorted and equal neighbours counted (see
``repeats``).
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame

from . import repeats, shared

#: Words of a window.
WORDS = 20


class Words(repeats.Units):
    gram_bits = 3
    result = "n_words long, n_removed long, kept_sha256 string"

    def __init__(self, window: int = WORDS):
        if window < 16:
            raise ValueError("window must be 16 words at least")  # grams of 8
        self.window = window

    def units(self, flat, offsets):
        starts, ends, rows = shared.word_spans(flat, offsets, shared.SPACED_WORD)
        # The words with one space after each: a run of them is packed as pack() does it.
        sizes = ends - starts + 1
        close = np.cumsum(sizes)
        packed = flat[np.minimum(np.repeat(starts - (close - sizes), sizes) + np.arange(int(close[-1]) if len(close) else 0), max(0, len(flat) - 1))]
        packed[close - 1] = 0x20
        return shared.span_hashes(flat, starts, ends), rows, packed, close - sizes, close - 1

    def split(self, text):
        return text.split()  # of bytes: at space and \x09-\x0d, as the contract has it

    def pack(self, run):
        return b" ".join(run)

    def repeated(self, strings, order):
        codes: dict[bytes, int] = {}
        words = [[codes.setdefault(w, len(codes)) for w in s.split()] for s in strings]
        sizes = np.array([len(w) for w in words])
        flat = np.array([c for w in words for c in w], dtype=np.int32)
        windows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(flat, self.window))
        string = np.repeat(np.arange(len(words)), sizes)[: len(windows)]
        offset = np.arange(len(windows)) - (np.cumsum(sizes) - sizes)[string]
        valid = offset + self.window <= sizes[string]
        string, offset, windows = string[valid], offset[valid], windows[valid]
        when = order[string] + offset
        rows = windows.view(np.dtype((np.void, windows.itemsize * self.window))).ravel()
        by = np.argsort(rows)
        ranked = windows[by]
        head = np.flatnonzero(np.append(True, (ranked[1:] != ranked[:-1]).any(axis=1)))
        earliest = np.repeat(np.minimum.reduceat(when[by], head), np.diff(np.append(head, len(by))))
        again = by[when[by] > earliest]
        return string[again], offset[again]

    def kept(self, text, covered):
        words = text.split()
        out, at = [], 0
        for a, b in covered.tolist():
            out += words[at:a]
            at = b
        return len(words), b" ".join(out + words[at:])

    def row(self, text, covered):
        n, kept = self.kept(text, covered)
        return n, int((covered[:, 1] - covered[:, 0]).sum()), hashlib.sha256(kept).hexdigest()


class KeptWords(Words):
    """As Words, with the remaining words themselves."""

    result = f"{Words.result}, kept string"

    def row(self, text, covered):
        return (*super().row(text, covered), self.kept(text, covered)[1].decode())


def remove_repeated_windows(docs: DataFrame, words: int = WORDS, texts: bool = False, bits: int = 64) -> DataFrame:
    r"""Remove every word covered by a window of ``words`` words that also starts earlier.

    Words are runs of anything but space and \x09-\x0D. Input: doc_id, text; other columns
    are ignored. One row per input row: doc_id, n_words, n_removed, kept_sha256 (of the kept
    words joined by one space), and with ``texts`` those words. Null and empty texts have no
    words; a null doc_id comes before all others; rows that repeat a doc_id and a text are
    one document; rows that share a doc_id alone are ordered by their texts' hash. No rows give
    no rows. A text is worked on whole: a worker holds some hundred times its bytes. ``bits``:
    of the hashes that bring strings together; the result does not depend on it.
    """
    return repeats.remove_repeats(docs, KeptWords(words) if texts else Words(words), bits)
