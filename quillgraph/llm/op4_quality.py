"""A quality classifier: a generalised additive model with pairwise interactions.

Every feature of the text is cut into bins; a score is the sigmoid of an intercept plus
one table entry per feature and per chosen pair of features. Tables are learned by
cyclic boosting: in each round every feature in turn gets a small step towards a shallow
tree over its bins, fitted to what all tables together leave over; the strongest pairs
follow the same way on a coarser grid. Scoring looks bins up and adds, vectorised.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

#: Labelled rows to fit on at most, the smallest by a hash of their id.
SAMPLE = 20_000
#: Scores from here on are predicted 1.
THRESHOLD = 0.3

FEATURES = (
    "log_words", "log_chars", "upper", "digits", "sentence_marks", "symbols", "exclaims", "pipes", "word_bytes", "distinct_words", "repeats_next",
    "short_words", "long_words", "ends_sentence", "starts_upper", "beyond_ascii", "lines_per_word", "distinct_lines", "distinct_pairs", "top_word",
)


def _mask(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _mask(bytes(range(65, 91))), _mask(b"0123456789")
_LETTER = _mask(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(0xC3, 0xF5)))
_SENTENCE, _EXCLAIM, _STOP = _mask(b".,;:!?"), _mask(b"!?"), _mask(b".!?")
_SYMBOL = _mask(b"#$%&*+/<=>@[\\]^_`{|}~")
_LINE = np.ones(256, dtype=bool)
_LINE[10] = False


def _per_row(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.append(0, np.cumsum(mask))
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _distinct(rows: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes of each row, and how often its most frequent one occurs."""
    most = np.zeros(n)
    if not len(hashes):
        return np.zeros(n), most
    by = np.lexsort((hashes, rows))
    r, h = rows[by], hashes[by]
    head = np.flatnonzero(np.append(True, (r[1:] != r[:-1]) | (h[1:] != h[:-1])))
    np.maximum.at(most, r[head], np.diff(np.append(head, len(r))))
    return np.bincount(r[head], minlength=n).astype(float), most


def features(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; an empty text's are 0."""
    n = len(offsets) - 1
    count = lambda mask: _per_row(mask[flat], offsets)
    chars = _per_row((flat < 0x80) | (flat >= 0xC0), offsets)
    starts, ends, rows = shared.word_spans(flat, offsets, shared.SPACED_WORD)
    words = np.diff(rows).astype(float)
    row = np.repeat(np.arange(n), np.diff(rows))
    hashes = shared.span_hashes(flat, starts, ends)
    size = ends - starts
    some = lambda flags: np.bincount(row, weights=flags, minlength=n)
    distinct, top = _distinct(row, hashes, n)
    same = row[1:] == row[:-1]
    pairs, _ = _distinct(row[:-1][same], shared.mix(hashes[:-1][same]) + hashes[1:][same], n)
    again = np.bincount(row[1:], weights=same & (hashes[1:] == hashes[:-1]), minlength=n) if len(row) > 1 else np.zeros(n)
    first, last, line_rows = shared.word_spans(flat, offsets, _LINE)
    lines = np.diff(line_rows).astype(float)
    line_distinct, _ = _distinct(np.repeat(np.arange(n), np.diff(line_rows)), shared.span_hashes(flat, first, last), n)
    w, c, one = np.maximum(words, 1), np.maximum(chars, 1), np.maximum(words - 1, 1)
    at_end = flat[ends - 1] if len(ends) else flat[:0]
    at_start = flat[starts] if len(starts) else flat[:0]
    return np.stack(
        [
            np.log1p(words), np.log1p(chars), count(_UPPER) / np.maximum(count(_LETTER), 1), count(_DIGIT) / c, count(_SENTENCE) / w, count(_SYMBOL) / c, count(_EXCLAIM) / w,
            count(_mask(b"|")) / w, some(size) / w, distinct / w, again / w, some(size <= 3) / w, some(size > 12) / w, some(_STOP[at_end]) / w, some(_UPPER[at_start]) / w,
            _per_row(flat >= 0xC0, offsets) / c, count(_mask(b"\n")) / w, line_distinct / np.maximum(lines, 1), pairs / one, top / w,
        ],
        axis=1,
    )


# -- the model ------------------------------------------------------------------


@dataclass
class Model:
    intercept: float
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    #: (feature, feature, coarse cuts of both, table)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, j], "right")]
        for i, j, a, b, table in self.pairs:
            z += table[np.searchsorted(a, x[:, i], "right"), np.searchsorted(b, x[:, j], "right")]
        return _sigmoid(z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _leaf(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """The values of a least-squares tree of the given depth over ordered bins, from gradients and weights."""
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gr, hr = g.sum() - gl, h.sum() - hl
        gain = np.where((hl > 1) & (hr > 1), gl**2 / (hl + 1) + gr**2 / (hr + 1), -1.0)
        k = int(np.argmax(gain)) + 1
        if gain[k - 1] > g.sum() ** 2 / (h.sum() + 1) + 1e-9:
            return np.concatenate([_tree(g[:k], h[:k], depth - 1), _tree(g[k:], h[k:], depth - 1)])
    return np.full(len(g), _leaf(g.sum(), h.sum()))


def _grid_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One split on either axis and one on the other within each side, by the gain of both levels together."""
    found = [_two_levels(g, h), _two_levels(g.T, h.T)]
    return found[0][1] if found[0][0] >= found[1][0] else found[1][1].T


def _two_levels(g, h) -> tuple[float, np.ndarray]:
    def best(a, b):  # of one more split of each row of a
        left, weight = np.cumsum(a, axis=1), np.cumsum(b, axis=1)
        rest, other = left[:, -1:] - left, weight[:, -1:] - weight
        return (left**2 / (weight + 1) + rest**2 / (other + 1)).max(axis=1)

    top, wide = np.cumsum(g, axis=0), np.cumsum(h, axis=0)
    gains = best(top, wide) + best(top[-1] - top, wide[-1] - wide)
    k = int(np.argmax(gains)) + 1
    sides = [(a, b) for a, b in ((g[:k], h[:k]), (g[k:], h[k:])) if len(a)]
    return float(gains[k - 1]), np.concatenate([np.tile(_tree(a.sum(0), b.sum(0), 1), (len(a), 1)) for a, b in sides])


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, pairs: int = 6, coarse: int = 12, pair_rounds: int = 40) -> Model:
    """Fit on features x and labels y of 0 or 1. With no rows or one class alone, every score is the smoothed share of 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(share / (1 - share)))
    k = x.shape[1]
    if not 0 < y.sum() < len(y):
        return Model(base, [np.zeros(0)] * k, [np.zeros(1)] * k, [])
    cuts = [_cuts(x[:, j], bins) for j in range(k)]
    binned = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]
    z = np.full(len(y), base)
    for _ in range(rounds):
        for j in range(k):
            p = _sigmoid(z)
            step = rate * _tree(np.bincount(binned[j], y - p, len(tables[j])), np.bincount(binned[j], p * (1 - p), len(tables[j])), 2)
            tables[j] += step
            z += step[binned[j]]
    rough = [_cuts(x[:, j], coarse) for j in range(k)]
    cell = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(rough)]

    def grid(i, j, values):
        shape = len(rough[i]) + 1, len(rough[j]) + 1
        return np.bincount(cell[i] * shape[1] + cell[j], values, shape[0] * shape[1]).reshape(shape)

    p = _sigmoid(z)
    gains = []
    for i in range(k):
        for j in range(i):
            g, h = grid(i, j, y - p), grid(i, j, p * (1 - p))
            gains.append((max(_two_levels(g, h)[0], _two_levels(g.T, h.T)[0]), i, j))
    chosen = [(i, j, np.zeros((len(rough[i]) + 1, len(rough[j]) + 1))) for _, i, j in sorted(gains, reverse=True)[:pairs]]
    for _ in range(pair_rounds):
        for i, j, table in chosen:
            p = _sigmoid(z)
            step = rate * _grid_tree(grid(i, j, y - p), grid(i, j, p * (1 - p)))
            table += step
            z += step[cell[i], cell[j]]
    return Model(base, cuts, tables, [(i, j, rough[i], rough[j], t) for i, j, t in chosen])


# -- Spark ----------------------------------------------------------------------


def _features(batches) -> Iterator[pa.RecordBatch]:
    for b in shared.blocks(batches):
        x = features(*shared.text_array(b.column("text")))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])


def _score(sent):
    def run(batches) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            x = np.frombuffer(b"".join(b.column("x").to_pylist()), dtype=float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.score(x))], ["doc_id", "held_out", "score"])

    return run


def _mark(sent, name: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in shared.blocks(batches):
            score = model.score(features(*shared.text_array(b.column("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(score)], [*b.schema.names, name])

    return run


def _held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def _least(rows: DataFrame, by: Column, n: int) -> DataFrame:
    """Some ``n`` rows, those with the smallest hashes ``by``, and few more, chosen by a threshold: no task sends more than its share of them."""
    total = rows.count()
    if total <= n:
        return rows
    share = (n + 6 * n**0.5) / total
    return rows.where(F.pmod(by, F.lit(1 << 30)) < int(min(1.0, share) * (1 << 30)))


def train(scored: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out fold; scored: doc_id and x."""
    own = labels.where("quality in (0, 1) and doc_id is not null").where(~_held_out()).select("doc_id", "quality")
    rows = scored.join(own, "doc_id").select("x", "quality", F.xxhash64("doc_id", "quality").alias("h"))
    order = F.pmod("h", F.lit(1 << 30))
    rows = _least(rows, F.col("h"), sample).orderBy(order, "h", "x").limit(sample).collect()
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in rows), dtype=float).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["quality"] for r in rows], dtype=float))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    docs: doc_id, text; labels: doc_id, quality; other columns are ignored and never inputs of
    a score. held_out: crc32 of doc_id as text leaves 0 modulo 5 (a null doc_id as the empty
    text); no such row trains. Null and empty texts have all features 0. Labels that are null,
    or neither 0 nor 1, or of unknown documents do not count; repeated ones count each. With
    no usable labels, or of one class alone, every score is the smoothed share of 1.
    """
    spark = docs.sparkSession
    shared.ready(spark)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_features, "doc_id long, x binary").checkpoint()
    model = spark.sparkContext.broadcast(train(found, labels, sample))
    scored = found.select("doc_id", "x", _held_out().alias("held_out")).mapInArrow(_score(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, training: DataFrame | None = None, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs whose score is the threshold at least, with all their columns, whatever these are called.

    training: documents to fit on, docs by default; only labelled ones are read to the end. Null
    and empty texts are scored as such; repeated rows stay or go together; no rows give no rows.
    """
    spark = docs.sparkSession
    shared.ready(spark)
    source = (docs if training is None else training).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    wanted = labels.where("quality in (0, 1) and doc_id is not null").where(~_held_out()).select("doc_id").distinct()
    some = _least(wanted, F.xxhash64("doc_id"), 2 * sample)
    found = source.join(some, "doc_id").mapInArrow(_features, "doc_id long, x binary").checkpoint()
    model = spark.sparkContext.broadcast(train(found, labels, sample))
    name = shared.fresh("quality_score", docs.columns)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(_mark(model, name), f"{fields}, `{name}` double").where(F.col(f"`{name}`") >= threshold).drop(name)
