"""Corpora derived from the tables, each as DataFrame and as DuckDB SQL with one meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import GENERIC_NAMES
from ..functions.text import WORD


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt over all cores, if their files give fewer tasks than there are: a small file is one task, however costly its texts are to read.

    An input of as many tasks as cores or more, as any large one is, stays where it lies.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def padded(n: Column) -> Column:
    return F.lpad(n.cast("string"), 8, "0")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, doc_id, path, markdown, revision): documents as notes."""
    d = spread(table(spark, sf_dir, "documents").where("doc_id is not null"))
    doc = padded(F.col("doc_id"))
    return d.select(doc.alias("doc"), "doc_id", F.concat(F.coalesce("source", F.lit("none")), F.lit("/"), doc, F.lit(".md")).alias("path"), F.coalesce("text", F.lit("")).alias("markdown"), F.lit(1).cast("long").alias("revision"))


def note_lines(notes_: DataFrame) -> DataFrame:
    """(doc, section, text): each line is a section of its own."""
    return notes_.select("doc", F.posexplode(F.split("markdown", "\n", -1)).alias("section", "text"))


def note_names(notes_: DataFrame) -> DataFrame:
    """(doc, name, source): the first word of a note is its name."""
    first = F.regexp_extract(F.lower("markdown"), f"({WORD})", 1)
    return notes_.select("doc", first.alias("name"), F.lit("filename").alias("source")).where(F.char_length("name") >= 1)


def links(notes_: DataFrame) -> DataFrame:
    """(doc, raw): the one link of each note, [[source/id of doc_id * 7 + 3]]; beyond the last id it has no target."""
    return notes_.select("doc", F.concat(F.lit("["), F.lit("[n"), (F.col("doc_id") * 7 + 3).cast("string"), F.lit("|see]"), F.lit("]")).alias("markup"))


def parsed_links(markup: DataFrame) -> DataFrame:
    """(source, raw, label) of WikiLinks in markup."""
    found = F.explode(F.regexp_extract_all("markup", F.lit(r"\[\[([^\]|]+)(?:\|[^\]]*)?\]\]"), F.lit(1)))
    return markup.select(F.col("doc").alias("source"), found.alias("raw"))


def link_names(notes_: DataFrame) -> DataFrame:
    """(doc, name, source): the name ``n<doc_id>`` that links use."""
    return notes_.select("doc", F.concat(F.lit("n"), F.col("doc_id").cast("string")).alias("name"), F.lit("frontmatter").alias("source"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(unit, doc, section, revision, vector): five vectors a document, a section each."""
    e = table(spark, sf_dir, "embeddings").where("vec_id is not null")
    return e.select(padded(F.col("vec_id")).alias("unit"), padded(F.expr("vec_id div 5")).alias("doc"), (F.col("vec_id") % 5).cast("string").alias("section"), F.lit(1).cast("long").alias("revision"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), "label")


GENERIC = ", ".join(f"'{n}'" for n in GENERIC_NAMES)

#: DuckDB: the corpora above, as common table expressions in dependency order.
SQL = {
    "notes": "notes AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS doc, doc_id, coalesce(source, 'none') || '/' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || '.md' AS path, coalesce(text, '') AS markdown, CAST(1 AS BIGINT) AS revision FROM documents WHERE doc_id IS NOT NULL)",
    "lines": "lines AS (SELECT doc, unnest(range(len(parts))) AS section, unnest(parts) AS text FROM (SELECT doc, string_split(markdown, chr(10)) AS parts FROM notes))",
    "names": "names AS (SELECT doc, name FROM (SELECT doc, regexp_extract(lower(markdown), '([\\p{L}\\p{N}_]+)', 1) AS name FROM notes) WHERE length(name) >= 1)",
    "keys": f"keys AS (SELECT name AS name_key, CAST(count(DISTINCT doc) AS BIGINT) AS candidates, min(doc) AS target, CASE WHEN length(name) < 2 OR name IN ({GENERIC}) THEN 'suppressed' WHEN count(DISTINCT doc) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM names GROUP BY name)",
    "tokens": "tokens AS (SELECT doc, section, unnest(range(len(w))) AS place, unnest(w) AS token FROM (SELECT doc, section, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM lines))",
    "mentions": "mentions AS (SELECT t.doc AS source, section, place, name_key, status, candidates, CASE WHEN status = 'resolved' THEN target END AS target FROM tokens t JOIN keys ON token = name_key WHERE status <> 'suppressed')",
    "links": "links AS (SELECT a.doc AS source, 'n' || CAST(a.doc_id * 7 + 3 AS VARCHAR) AS raw, b.doc AS target FROM notes a LEFT JOIN notes b ON b.doc_id = a.doc_id * 7 + 3)",
    "evidence": "evidence AS (SELECT 'mention' AS kind, source, CAST(section AS VARCHAR) AS section, target FROM mentions WHERE status = 'resolved' UNION ALL SELECT 'explicit', source, 'links', target FROM links WHERE target IS NOT NULL)",
    "cands": "cands AS (SELECT least(source, target) AS node_a, greatest(source, target) AS node_b, count(DISTINCT CASE WHEN kind = 'mention' THEN source || '/' || section END) AS sections, count(*) FILTER (WHERE kind = 'mention') AS mentions, count(*) FILTER (WHERE kind = 'explicit') AS links FROM evidence WHERE source <> target GROUP BY ALL)",
    "rels": "rels AS (SELECT node_a, node_b, sections, mentions, links, m AS mention, e AS explicit, round(m + CAST(0.3 AS DOUBLE) * e * (1 - m), 12) AS score FROM (SELECT *, CASE WHEN sections > 0 THEN least(CAST(0.8 AS DOUBLE), CAST(0.5 AS DOUBLE) + (sections - 1) * CAST(0.1 AS DOUBLE)) ELSE CAST(0 AS DOUBLE) END AS m, CAST(links > 0 AS INTEGER) AS e FROM cands))",
    "marks": "marks AS (SELECT *, CAST(right(node_a, 1) AS INTEGER) = 7 AND CAST(right(node_b, 1) AS INTEGER) < 5 AS hidden, CAST(right(node_b, 1) AS INTEGER) = 3 AND NOT (CAST(right(node_a, 1) AS INTEGER) = 7 AND CAST(right(node_b, 1) AS INTEGER) < 5) AS pinned FROM rels)",
    "centered": "centered AS (SELECT node_a AS center, node_b AS neighbor, * FROM marks UNION ALL SELECT node_b, node_a, * FROM marks)",
    "mapped": "mapped AS (SELECT *, coalesce(min(CASE WHEN NOT hidden THEN score END) OVER (PARTITION BY center), 0) AS low, coalesce(max(CASE WHEN NOT hidden THEN score END) OVER (PARTITION BY center), 1) AS high FROM centered)",
    "units": "units AS (SELECT lpad(CAST(vec_id AS VARCHAR), 8, '0') AS unit, lpad(CAST(vec_id // 5 AS VARCHAR), 8, '0') AS doc, CAST(vec_id % 5 AS VARCHAR) AS section, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id IS NOT NULL)",
    "normed": "normed AS (SELECT unit, doc, section, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM units)",
    "cosines": "cosines AS (SELECT a.doc AS center, b.doc AS neighbor, max(greatest(-1, least(1, list_inner_product(a.v, b.v)))) AS similarity FROM normed a JOIN normed b ON a.doc <> b.doc GROUP BY ALL)",
    "pool": "pool AS (SELECT center, neighbor, similarity, rank, pool_size FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY similarity DESC, neighbor) AS rank, count(*) OVER (PARTITION BY center) AS pool_size FROM cosines) WHERE rank <= 100)",
    "gaps": "gaps AS (SELECT *, greatest(CAST(0 AS DOUBLE), similarity - lead(similarity) OVER (PARTITION BY center ORDER BY rank)) AS gap FROM (SELECT * FROM pool))",
    "middle": "middle AS (SELECT center, count(*) AS members, coalesce(median(gap), 0) AS median_gap FROM (SELECT center, rank, CASE WHEN rank < max(rank) OVER (PARTITION BY center) THEN gap END AS gap FROM gaps) GROUP BY center)",
    "spread": "spread AS (SELECT center, coalesce(median(abs(CASE WHEN rank < members THEN gap END - median_gap)), 0) AS mad FROM gaps JOIN middle USING (center) GROUP BY center)",
    "diag": "diag AS (SELECT m.center, members, median_gap, mad, median_gap + greatest(CAST(0.01 AS DOUBLE), CAST(3.5 AS DOUBLE) * CAST(1.4826 AS DOUBLE) * mad) AS threshold FROM middle m JOIN spread USING (center))",
    "cuts": "cuts AS (SELECT d.*, (SELECT min(rank) FROM gaps g WHERE g.center = d.center AND rank >= 2 AND rank < members AND gap > threshold + CAST(1e-12 AS DOUBLE) AND members >= 4) AS cut_rank FROM diag d)",
    "decided": "decided AS (SELECT p.*, similarity >= CAST(0.2 AS DOUBLE) AND (cut_rank IS NULL OR rank <= cut_rank) AS accepted, CASE WHEN similarity < CAST(0.2 AS DOUBLE) THEN 'quality-floor' WHEN cut_rank IS NULL OR rank <= cut_rank THEN 'accepted' ELSE 'strategy-boundary' END AS reason FROM pool p JOIN cuts USING (center))",
    "hybrid": "hybrid AS (SELECT center, neighbor, least(center, neighbor) AS node_a, greatest(center, neighbor) AS node_b, coalesce(m, 0) AS m, coalesce(e, 0) AS e, coalesce(s, 0) AS s FROM (SELECT center, neighbor, mention AS m, explicit AS e FROM centered) FULL JOIN (SELECT center, neighbor, least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (similarity - CAST(0.2 AS DOUBLE)) / CAST(0.9 - 0.2 AS DOUBLE))) AS s FROM decided WHERE accepted) USING (center, neighbor))",
    "graded": "graded AS (SELECT a.doc AS node_a, b.doc AS node_b, CASE WHEN a.label = b.label THEN 3 WHEN abs(a.label - b.label) = 1 THEN 2 WHEN abs(a.label - b.label) = 2 THEN 1 ELSE 0 END AS grade, CASE WHEN CAST(a.doc AS INTEGER) % 2 = 0 THEN 'dev' ELSE 'test' END AS split, (CAST(a.doc AS INTEGER) + CAST(b.doc AS INTEGER)) % 5 = 0 AND abs(a.label - b.label) > 2 AS hard_negative, CASE WHEN (CAST(a.doc AS INTEGER) + CAST(b.doc AS INTEGER)) % 3 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS mention, CAST((CAST(a.doc AS INTEGER) * CAST(b.doc AS INTEGER)) % 7 = 1 AS INTEGER) AS explicit, c.similarity AS cosine FROM (SELECT doc, min(label) AS label FROM units GROUP BY doc) a JOIN (SELECT doc, min(label) AS label FROM units GROUP BY doc) b ON a.doc < b.doc AND CAST(a.doc AS INTEGER) // 16 = CAST(b.doc AS INTEGER) // 16 JOIN cosines c ON c.center = a.doc AND c.neighbor = b.doc)",
}


def sql(*needed: str, then: str) -> str:
    """A query over the named expressions; every expression they stand on is added."""
    import re

    want = set(needed)
    while True:
        more = {k for n in want for k in SQL if k != n and re.search(rf"\b(?:FROM|JOIN)\s+{k}\b", SQL[n])}
        if more <= want:
            break
        want |= more
    return "WITH " + ",\n".join(v for k, v in SQL.items() if k in want) + "\n" + then
