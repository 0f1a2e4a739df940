"""Full-text search by scans: BM25, literal, exact and browser modes; ``postings`` has the stored index."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.policy import BM25_B, BM25_K1, SEARCH_EXCERPT, SEARCH_WEIGHTS
from ..functions.text import IDENTITY, WORD, fold_marks


def check_query(query: str, limit: int) -> None:
    if not query.strip() or len(query.encode("utf-16-le")) // 2 > 512:
        raise ValueError("a query must have 1 to 512 characters")
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be from 1 to 1000")


def without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


def search_terms(query: str) -> list[str]:
    """The different words of a query, lower case and without marks."""
    import regex

    return sorted(set(regex.findall(WORD, without_marks(query))))


def search_text(documents: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """doc, score: documents that hold every term, whatever its case and marks, by BM25 with field weights, ties by id.

    One scan: lengths are counted and query terms kept; the limit is the feature.
    """
    check_query(query, limit)
    terms = search_terms(query)
    if not terms:
        return documents.select("doc", F.lit(0.0).alias("score")).limit(0)
    fields = (("title", SEARCH_WEIGHTS[0]), ("body", SEARCH_WEIGHTS[1]))
    rows = documents.select("doc", fold_marks(F.col("title")).alias("title"), fold_marks(F.col("body")).alias("body"))

    def hits_of(c: str, t: str) -> Column:
        """How often a term is a whole word; most texts lack it, and are only looked through for its letters."""
        return F.when(F.col(c).contains(t), F.regexp_count(c, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(t)}(?![\p{{L}}\p{{N}}_])"))).otherwise(0)

    # Weighted frequencies and lengths of both fields together.
    tf = [sum((hits_of(c, t) * F.lit(w) for c, w in fields), F.lit(0.0)) for t in terms]
    length = sum((F.regexp_count(c, F.lit(WORD)) * F.lit(w) for c, w in fields), F.lit(0.0))
    counted = rows.select("doc", length.alias("length"), *(x.alias(f"tf{i}") for i, x in enumerate(tf)))
    totals = counted.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *(F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))))
    hits = counted.where(" AND ".join(f"tf{i} > 0" for i in range(len(terms)))).crossJoin(F.broadcast(totals))  # one row

    def part(i: int) -> Column:
        idf = F.ln(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        return idf * F.col(f"tf{i}") * (BM25_K1 + 1) / (F.col(f"tf{i}") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("length") / F.col("mean")))

    score = sum((part(i) for i in range(len(terms))), F.lit(0.0))
    return hits.select("doc", F.round(score, 9).alias("score")).orderBy(F.desc("score"), "doc").limit(limit)


def _shaped(hits: DataFrame, width: int, limit: int) -> DataFrame:
    first = F.greatest(F.col("offset") - SEARCH_EXCERPT[0], F.lit(0))
    return hits.select("doc", "offset", F.substring("body", first + 1, F.col("offset") + width + SEARCH_EXCERPT[1] - first).alias("excerpt")).orderBy("doc").limit(limit)


def search_literal(documents: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """doc, offset, excerpt of documents whose body holds the query, case-sensitive, by id."""
    check_query(query, limit)
    rows = documents.where(F.col("body").contains(query)).withColumn("offset", F.instr("body", query) - 1)
    return _shaped(rows, len(query), limit)


def search_exact(documents: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """As search_literal, for the first occurrence that touches no identity character on either side."""
    check_query(query, limit)
    pattern = f"(?<!{IDENTITY}){re.escape(query)}(?!{IDENTITY})"
    rows = documents.where(F.col("body").contains(query)).where(F.col("body").rlike(pattern))
    rows = rows.withColumn("offset", F.char_length(F.split("body", pattern, 2)[0]))
    return _shaped(rows, len(query), limit)


def search_browser(documents: DataFrame, query: str) -> DataFrame:
    """doc of documents that hold the query in title or body, whatever the case."""
    check_query(query, 1)
    return documents.where(F.lower(F.concat_ws("\n", "title", "body")).contains(query.lower())).select("doc")
