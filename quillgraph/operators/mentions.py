"""Natural mentions: leftmost-longest dictionary matches in text, and the token fast path.

A name touches no letter, number or ``_`` beyond a side of its own that is Latin, so it consists
of whole units of the text: maximal runs of such characters, and every other character alone.
``dictionary_mentions`` therefore finds names by equality: every run of as many units as some name
has is a key, the keys that a bit set of bounded size cannot rule out join the names, and a fold
over each span keeps the leftmost longest ones. No task holds the dictionary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashes import Spans, bit_set, may_hold
from ..functions.keep import kept
from ..functions.text import WORD, name_key, nfc
from .entities import resolutions

#: The bit set of names: bits for each name, and its size in powers of two at least and at most (8 MB).
BITS_EACH, BITS = 16, (16, 26)
#: Parts of a frequent name's places, each joined by a task of its own.
SALTS = 8
#: Characters that a task looks at together.
BLOCK = 1 << 20


def fold(char: str) -> str:
    """Upper then lower case of one character, while that stays one character."""
    up = char.upper()
    return up.lower() if len(up) == 1 and len(up.lower()) == 1 else char.lower()


def _latin(char: str) -> bool:
    import regex

    return bool(regex.match(r"[\p{Script=Latin}\p{N}_]", char))


class Matcher:
    """Finds the leftmost longest names by a trie; a side of a name needs a word boundary only where its own character is Latin, a number or ``_``.

    Only places where some name can begin are looked at, and one costs the length of the longest
    name that begins there, however many names there are.
    """

    def __init__(self, names: list[str]):
        import regex

        self.root: dict = {}
        for n in {"".join(map(fold, n)) for n in names if n}:
            node = self.root
            for c in n:
                node = node.setdefault(c, {})
            node[""] = _latin(n[0]), _latin(n[-1])
        self.latin: dict[str, bool] = {}
        first = [c for c in self.root if _latin(c)], [c for c in self.root if not _latin(c)]
        latin, other = ("".join(map(regex.escape, sorted(cs))) for cs in first)
        either = [rf"(?<![\p{{Script=Latin}}\p{{N}}_])[{latin}]" if latin else "", f"[{other}]" if other else ""]
        self.starts = regex.compile("|".join(filter(None, either)) or r"(?!)")

    def _bound(self, text: str, i: int) -> bool:
        """Whether the character at a place is such that a Latin name cannot touch it."""
        if not 0 <= i < len(text):
            return False
        c = text[i]
        if c not in self.latin:
            self.latin[c] = _latin(c)
        return self.latin[c]

    def matches(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, text) in code points."""
        folded = text.lower() if text.isascii() else "".join(f if len(f := fold(c)) == 1 else c for c in text)
        out, free = [], 0
        for start in self.starts.finditer(folded):
            at = start.start()
            if at < free:
                continue
            node, to, best = self.root, at, -1
            while node is not None and to < len(folded):
                node = node.get(folded[to])
                to += 1
                if node is not None and "" in node:
                    left, right = node[""]
                    if not (left and self._bound(folded, at - 1)) and not (right and self._bound(folded, to)):
                        best = to
            if best >= 0:
                out.append((at, best, text[at:best]))
                free = best
        return out


class _Folds(dict):
    def __missing__(self, code: int) -> str:
        f = fold(chr(code))
        self[code] = f if len(f) == 1 else chr(code)
        return self[code]


_FOLDS = _Folds()
_WORDLIKE: list[np.ndarray] = []


def folded(text: str) -> str:
    """The text with each character folded, so places stay."""
    return text.lower() if text.isascii() else text.translate(_FOLDS)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _wordlike(codes: np.ndarray) -> np.ndarray:
    if not _WORDLIKE:
        import regex

        every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        table = np.zeros(0x110000, dtype=bool)
        table[_codes("".join(regex.findall(r"[\p{Script=Latin}\p{N}_]", every)))] = True
        _WORDLIKE.append(table)
    return _WORDLIKE[0][codes]


def unit_starts(codes: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Where units begin: at every head of a text, and at characters that do not continue a run."""
    word = _wordlike(codes)
    begins = np.ones(len(codes), dtype=bool)
    begins[1:] = ~(word[1:] & word[:-1])
    begins[heads[heads < len(codes)]] = True
    return np.flatnonzero(begins)


def _keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, units, h of names."""
    for p in parts:
        keys = [folded(n) for n in p["name_key"] if n]
        codes = _codes("".join(keys))
        offsets = np.append(0, np.cumsum([len(k) for k in keys], dtype=np.int64))
        units = np.diff(np.searchsorted(unit_starts(codes, offsets), offsets))
        h = Spans(codes).of(offsets[:-1], offsets[1:]).view(np.int64)
        yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "units": units.astype(np.int32), "h": h})


def _grams(sent, lengths: list[int]):
    def blocks(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            size = p["text"].str.len().fillna(0).cumsum().to_numpy()
            at = 0
            while at < len(p):
                to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BLOCK, "right")))
                yield p.iloc[at:to]
                at = to

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Places of the runs of units that may be names: the span's columns, at, to, key, name."""
        known = sent.value if sent is not None else None
        for p in blocks(parts):
            texts = p["text"].fillna("").tolist()
            whole = "".join(texts)
            low = "".join(map(folded, texts))
            offsets = np.append(0, np.cumsum([len(t) for t in texts]))
            codes = _codes(low)
            starts = unit_starts(codes, offsets)
            ends = np.append(starts[1:], len(codes))
            row = np.searchsorted(offsets, starts, "right") - 1
            spans, found = Spans(codes), []
            for n in lengths:
                if n <= len(starts):
                    a, z, r = starts[: len(starts) - n + 1], ends[n - 1 :], row[: len(starts) - n + 1]
                    keep = r == row[n - 1 :]
                    if known is not None:
                        keep[keep] = may_hold(known, spans.of(a[keep], z[keep]))
                    found.append((a[keep], z[keep], r[keep]))
            if not found:
                continue
            a, z, r = (np.concatenate(c) for c in zip(*found, strict=True))
            cut = [(low[i:j], whole[i:j]) for i, j in zip(a.tolist(), z.tolist(), strict=True)]
            own = p.iloc[r][["doc", "section", "block", "start"]].reset_index(drop=True)
            yield own.assign(at=a - offsets[r], to=z - offsets[r], key=[k for k, _ in cut], name=[n for _, n in cut])

    return run


def _thin(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The leftmost longest of each span's intervals, which come sorted by place and falling end."""
    span, free = None, 0
    for p in parts:
        keep = []
        for i, (*own, at, to) in enumerate(zip(p["doc"], p["section"], p["block"], p["start"], p["at"], p["to"], strict=True)):
            if own != span:
                span, free = own, 0
            if at >= free:
                keep.append(i)
                free = to
        got = p.iloc[keep]
        yield pd.DataFrame({"doc": got["doc"], "section": got["section"], "block": got["block"], "start": got["start"] + got["at"], "end": got["start"] + got["to"], "name": got["name"]})


def intervals(spans: DataFrame, names: DataFrame, filtered: bool = True, salts: int = SALTS) -> DataFrame:
    """doc, section, block, start, end, name: the leftmost longest of the names (name_key) in each span.

    A bit set of at most 8 MB, whatever the number of names, spares the shuffle what is no name;
    without it (``filtered`` false) every run of units travels, and the result is the same.
    Places of a name are dealt to ``salts`` tasks.
    """
    spark = spans.sparkSession
    some = names.select("name_key").repartition(spark.sparkContext.defaultParallelism)  # what an aggregation leaves may be one task
    keyed = kept(some.mapInPandas(_keys, "key string, units int, h long").dropDuplicates(["key"]))  # counted, made a bit set and joined
    sizes = {r["units"]: r["n"] for r in keyed.groupBy("units").agg(F.count("*").alias("n")).collect()}
    sent = None
    if filtered and sizes:
        bits = min(max((sum(sizes.values()) * BITS_EACH - 1).bit_length(), BITS[0]), BITS[1])
        sent = spark.sparkContext.broadcast(bit_set(keyed, bits))
    fields = "doc string, section string, block string, start long"
    text = spans.select("doc", F.col("section").cast("string").alias("section"), "block", F.col("start").cast("long").alias("start"), "text")
    grams = text.mapInPandas(_grams(sent, sorted(sizes)), f"{fields}, at long, to long, key string, name string")
    salted = grams.withColumn("salt", F.pmod(F.xxhash64("doc", "start", "at"), F.lit(salts)).cast("int"))
    each = keyed.select("key", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    found = salted.join(each, ["key", "salt"], "left_semi").drop("salt", "key")
    span = ["doc", "section", "block", "start"]
    return found.repartition(*span).sortWithinPartitions(*span, "at", F.desc("to")).mapInPandas(_thin, "doc string, section string, block string, start long, end long, name string")


def dictionary_mentions(spans: DataFrame, entities: DataFrame, filtered: bool = True) -> DataFrame:
    """The mentions in text spans (doc, section, block, start, text): doc, section, block, start, end, name, status, candidates, target, decorate.

    Any number of names, of any number of words. Spans are told apart by their first four columns;
    a null text is an empty one.
    """
    found = kept(resolutions(entities).where("status <> 'suppressed'"))  # read for the keys and for what they mean
    hits = intervals(spans, found, filtered)
    joined = hits.withColumn("name_key", name_key(F.col("name"))).join(found, "name_key")
    return with_decoration(joined.drop("name_key"))


def with_decoration(mentions: DataFrame) -> DataFrame:
    """decorate: the first hit of each block and target."""
    order = W.partitionBy("block", F.coalesce("target", F.col("name"))).orderBy("start")
    return mentions.withColumn("decorate", F.row_number().over(order) == 1)


def tokens(lines: DataFrame) -> DataFrame:
    """(doc, section, place, token) of lines (doc, section, text): lower-cased words, numbered within their line."""
    return lines.select("doc", "section", F.posexplode(F.regexp_extract_all(F.lower(nfc(F.col("text"))), F.lit(WORD), F.lit(0))).alias("place", "token"))


def _hashes(strings: pa.Array) -> np.ndarray:
    """Hashes of strings, by their bytes."""
    text = strings.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int64)
    data = text.buffers()[2]
    codes = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(text) else np.zeros(0, np.uint8)
    return Spans(codes).of(offsets[:-1] - offsets[0], offsets[1:] - offsets[0])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array(_hashes(b.column("name_key")).view(np.int64))], ["h"])


def _known(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Places of the tokens that may be names, of lines (doc, section, token: a list)."""
        for b in batches:
            if not len(b):
                continue
            token = b.column("token")
            place = np.flatnonzero(may_hold(sent.value, _hashes(token.flatten())))
            ends = np.cumsum(pc.list_value_length(token).to_numpy(zero_copy_only=False))
            row = np.searchsorted(ends, place, "right")
            at = pa.array(row)
            start = np.append(0, ends[:-1])[row]
            yield pa.RecordBatch.from_arrays([b.column("doc").take(at), b.column("section").take(at), pa.array((place - start).astype(np.int32)), token.flatten().take(pa.array(place))], ["doc", "section", "place", "token"])

    return run


def known_tokens(lines: DataFrame, names: DataFrame) -> DataFrame:
    """tokens of lines, without most of those that are none of the names (name_key): a bit set of at most 8 MB keeps them out of the shuffle."""
    sent = lines.sparkSession.sparkContext.broadcast(bit_set(names.select("name_key").mapInArrow(_hashed, "h long"), BITS[1]))
    rows = lines.select("doc", "section", F.regexp_extract_all(F.lower(nfc(F.col("text"))), F.lit(WORD), F.lit(0)).alias("token")).where(F.size("token") > 0)
    section = lines.schema["section"].dataType.simpleString()
    return rows.mapInArrow(_known(sent), f"doc string, section {section}, place int, token string")


def token_mentions(lines: DataFrame, entities: DataFrame, resolved: bool = False) -> DataFrame:
    """Mentions of names that are one token, as an equi-join: no dictionary is ever gathered.

    (kind, source, section, place, name_key, status, candidates, target); with ``resolved`` only
    those of one meaning, and tokens that are no such name are left out before the shuffle.
    """
    found = resolutions(entities).where("status = 'resolved'" if resolved else "status <> 'suppressed'")
    found = kept(found) if resolved else found
    met = known_tokens(lines, found) if resolved else tokens(lines)
    joined = met.join(found, F.col("token") == F.col("name_key"))
    return joined.select(F.lit("mention").alias("kind"), F.col("doc").alias("source"), "section", "place", "name_key", "status", "candidates", "target")
