"""A stored index for full-text search: positional postings in term buckets, segments by generation.

A segment holds the postings of the documents that one update brought, in folders by a hash of the
term and sorted by term, and the ids that it replaces or deletes. A query reads the folders of its
terms alone and drops postings of documents that a later segment replaced. ``merge`` writes the
live postings of all segments as one. Generations are published as in ``ingest.Store``.

Words are runs of letters and digits, lower-cased and without marks. A character of a script
without spaces is a token of its own, and with the next one of its run a second one, a pair; a
query's word of such characters is a phrase of pairs, so it is found inside a longer run. A query
asks for all its words, each of them a phrase of its tokens at neighbouring places.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import BM25_B, BM25_K1, SEARCH_EXCERPT, SEARCH_WEIGHTS
from ..functions.text import WORD, fold_marks
from .ingest import Store
from .search import check_query, without_marks

#: Folders of a segment, and files of one that a frequent term's postings are dealt to.
BUCKETS, SPREAD = 64, 4

_DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_TOKEN = rf"[{_DENSE}](?=([{_DENSE}])?)|[[\p{{L}}\p{{N}}]&&[^{_DENSE}]]+"
_FIELDS = ("title", "body")
_SCHEMAS = {"postings": "term string, doc string, field int, size int, places array<int>, bucket int", "docs": "doc string, size int"}


def _bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(term.cast("binary")) % buckets).cast("int")


def query_phrases(query: str) -> list[list[tuple[int, str]]]:
    """For each word of a query its tokens, with their places in the word."""
    import regex

    dense = r"\p{Han}\p{Hiragana}\p{Katakana}"
    out = []
    for word in regex.findall(WORD, without_marks(query)):
        tokens = regex.findall(rf"[{dense}]|[[\p{{L}}\p{{N}}]--[{dense}]]+", word, flags=regex.V1)
        is_dense = [bool(regex.fullmatch(f"[{dense}]", t)) for t in tokens]
        phrase = []
        for i, t in enumerate(tokens):
            if i + 1 < len(tokens) and is_dense[i] and is_dense[i + 1]:
                phrase.append((i, t + tokens[i + 1]))
            elif not (is_dense[i] and i and is_dense[i - 1]):  # the last of a run is in the pair before it
                phrase.append((i, t))
        if phrase:
            out.append(phrase)
    return out


def tokens(documents: DataFrame) -> DataFrame:
    """doc, size, field, place, term of documents (doc, title, body); size: the places of both fields together."""
    found = [F.arrays_zip(F.regexp_extract_all(fold_marks(F.coalesce(F.col(c), F.lit(""))), F.lit(_TOKEN), F.lit(0)).alias("t"), F.regexp_extract_all(fold_marks(F.coalesce(F.col(c), F.lit(""))), F.lit(_TOKEN), F.lit(1)).alias("next")).alias(c) for c in _FIELDS]
    rows = documents.select("doc", *found)
    both = F.explode(F.array(*(F.struct(F.lit(k).alias("field"), F.col(c).alias("tokens")) for k, c in enumerate(_FIELDS)))).alias("f")
    each = rows.select("doc", sum((F.size(c) for c in _FIELDS), F.lit(0)).alias("size"), both).select("doc", "size", "f.field", F.posexplode("f.tokens").alias("place", "x"))
    pair = F.when(F.col("x.next") != "", F.array(F.col("x.t"), F.concat("x.t", "x.next"))).otherwise(F.array(F.col("x.t")))
    return each.select("doc", "size", "field", "place", F.explode(pair).alias("term"))


class SearchIndex:
    """An index in a folder; two writers of one generation cannot both publish (ingest.Conflict)."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, spread: int = SPREAD):
        self.spark, self.store, self.buckets, self.spread = spark, Store(spark, root), buckets, spread

    def generation(self) -> int:
        return self.store.generation()

    def _segments(self, kind: str) -> list[tuple[int, str]]:
        return sorted((int(t.split("-")[1]), t) for t in self.store.tables() if t.startswith(f"{kind}-"))

    def _stats(self) -> tuple[int, int]:
        if "stats" not in self.store.tables():
            return 0, 0
        row = self.store.read("stats").first()
        return row["n"], row["total"]

    def _live(self, kind: str, where: Column | None = None) -> DataFrame:
        """Rows of every segment whose documents no later segment replaced."""
        segments, gone = self._segments(kind), self._segments("gone")
        read = lambda t: self.store.read(t, _SCHEMAS[kind])  # noqa: E731  an empty table in folders has none of its own
        rows = reduce(DataFrame.unionByName, [(read(t) if where is None else read(t).where(where)).withColumn("segment", F.lit(k)) for k, t in segments])
        later = [self.store.read(t).select("doc", F.lit(k).alias("by")) for k, t in gone if k > segments[0][0]]
        if later:
            dead = reduce(DataFrame.unionByName, later)
            rows = rows.join(dead, (rows["doc"] == dead["doc"]) & (dead["by"] > rows["segment"]), "left_anti")
        return rows.drop("segment")

    def _grouped(self, documents: DataFrame) -> DataFrame:
        """bucket, term, doc, field, size, places, dealt by bucket and a part of it, sorted by term."""
        rows = tokens(documents).withColumns({"bucket": _bucket(F.col("term"), self.buckets), "part": F.pmod(F.xxhash64("doc"), F.lit(self.spread))})
        keys = ["bucket", "part", "term", "doc", "field", "size"]
        # One shuffle: the groups lie within the parts that are written.
        grouped = rows.repartition("bucket", "part").groupBy(*keys).agg(F.sort_array(F.collect_list("place")).alias("places"))
        return grouped.sortWithinPartitions("bucket", "term").drop("part")

    def update(self, documents: DataFrame, deleted: DataFrame | None = None, expected: int | None = None) -> int:
        """Add or replace documents (doc, title, body; one row each, null texts empty) and delete others (doc) in one segment; gives its generation."""
        expected = self.generation() if expected is None else expected
        k = expected + 1
        docs = documents.select("doc", "title", "body")
        size = sum((F.regexp_count(fold_marks(F.coalesce(F.col(c), F.lit(""))), F.lit(_TOKEN)) for c in _FIELDS), F.lit(0)).alias("size")
        sizes = docs.select("doc", size)
        gone = docs.select("doc") if deleted is None else docs.select("doc").unionByName(deleted.select("doc")).distinct()
        n, total = self._stats()
        if self._segments("docs"):
            old = self._live("docs").join(gone, "doc", "left_semi").agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
            n, total = n - old["n"], total - old["s"]
        new = sizes.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("s")).first()
        stats = self.spark.createDataFrame([(n + new["n"], total + new["s"])], "n long, total long")
        tables = {f"postings-{k}": self._grouped(docs), f"docs-{k}": sizes, f"gone-{k}": gone, "stats": stats}
        return self.store.commit(tables, expected, {f"postings-{k}": ["bucket"]})

    def merge(self, expected: int | None = None) -> int:
        """Write the live rows of all segments as one; what is found stays the same."""
        expected = self.generation() if expected is None else expected
        k = expected + 1
        old = [t for kind in ("postings", "docs", "gone") for _, t in self._segments(kind)]
        dealt = self._live("postings").withColumn("part", F.pmod(F.xxhash64("doc"), F.lit(self.spread))).repartition("bucket", "part").sortWithinPartitions("bucket", "term").drop("part")
        tables = {f"postings-{k}": dealt, f"docs-{k}": self._live("docs"), f"gone-{k}": self._live("docs").select("doc").limit(0)}
        return self.store.commit(tables, expected, {f"postings-{k}": ["bucket"]}, old)

    def matches(self, query: str) -> DataFrame:
        """doc, size, tf0, tf1, ...: how often each word of the query stands in a document that holds any, weighted by field."""
        phrases = query_phrases(query)
        terms = sorted({t for p in phrases for _, t in p})
        wanted = F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})) & F.col("term").isin(terms)
        rows = self._live("postings", wanted)
        fields = rows.groupBy("doc", "field").agg(F.max("size").alias("size"), *(F.max(F.when(F.col("term") == t, F.col("places"))).alias(f"p{i}") for i, t in enumerate(terms)))

        def count(phrase: list[tuple[int, str]]) -> Column:
            starts = [F.expr(f"transform(p{terms.index(t)}, x -> x - {at})") for at, t in phrase]
            return F.coalesce(F.size(reduce(F.array_intersect, starts)), F.lit(0)) if len(starts) > 1 else F.coalesce(F.array_size(starts[0]), F.lit(0))

        weight = F.when(F.col("field") == 0, SEARCH_WEIGHTS[0]).otherwise(SEARCH_WEIGHTS[1])
        counted = fields.select("doc", "size", weight.alias("w"), *(F.greatest(count(p), F.lit(0)).alias(f"c{i}") for i, p in enumerate(phrases)))
        return counted.groupBy("doc").agg(F.max("size").alias("size"), *(F.sum(F.col("w") * F.col(f"c{i}")).alias(f"tf{i}") for i in range(len(phrases))))

    def search(self, query: str, limit: int = 20) -> DataFrame:
        """doc, score: documents that hold every word of the query, by BM25 with field weights, ties by id; the limit is the feature.

        A word's weight is the logarithm of (n - df + 0.5) / (df + 0.5), and 1e-6 where that is not positive.
        """
        check_query(query, limit)
        phrases = query_phrases(query)
        n, total = self._stats()
        if not phrases or not n:
            return self.spark.createDataFrame([], "doc string, score double")
        found = self.matches(query)
        have = [F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(phrases))]
        hits = found.where(" AND ".join(f"tf{i} > 0" for i in range(len(phrases)))).crossJoin(F.broadcast(found.agg(*have)))  # one row

        def part(i: int) -> Column:
            idf = F.ln((F.lit(n) - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
            tf = F.col(f"tf{i}")
            return F.when(idf > 0, idf).otherwise(1e-6) * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * F.col("size") / (total / n)))

        score = sum((part(i) for i in range(len(phrases))), F.lit(0.0))
        return hits.select("doc", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "doc").limit(limit)

    def hits(self, documents: DataFrame, query: str, limit: int = 20) -> DataFrame:
        """The search with offset (in characters, -1 where folding hides it) and excerpt around the first word, of documents (doc, body)."""
        import regex

        first = next(iter(regex.findall(WORD, query.lower())), "")
        found = documents.join(F.broadcast(self.search(query, limit)), "doc")  # limit rows
        at = F.instr(F.lower("body"), first) - 1
        start = F.greatest(at - SEARCH_EXCERPT[0], F.lit(0))
        width = F.greatest(at, F.lit(0)) + len(first) + SEARCH_EXCERPT[1] - start
        return found.select("doc", "score", at.alias("offset"), F.substring("body", start + 1, width).alias("excerpt")).orderBy(F.desc("score"), "doc")
