"""The queries over the tables: each a Spark plan, and the DuckDB SQL that must give its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.policy import BoundaryPolicy, Retrieval
from ..functions.text import normal_path, path_key, round12
from ..operators import boundary, entities, evaluation, explore, ingest, mentions, panels, parse, relations, search, vectors
from ..sources import corpora, vault
from ..sources.corpora import sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _dictionary(notes: DataFrame) -> DataFrame:
    return entities.dictionary(corpora.note_names(notes))


def _mentions(notes: DataFrame, resolved: bool = False) -> DataFrame:
    return mentions.token_mentions(corpora.note_lines(notes), _dictionary(notes), resolved)


def _links(notes: DataFrame) -> DataFrame:
    return entities.resolve_links(corpora.parsed_links(corpora.links(notes)), entities.dictionary(corpora.link_names(notes)), notes.select("doc", "path"))


def _evidence(notes: DataFrame) -> DataFrame:
    m = _mentions(notes, True).select("kind", "source", F.col("section").cast("string").alias("section"), "status", "target")
    e = _links(notes).select(F.lit("explicit").alias("kind"), "source", F.lit("links").alias("section"), "status", "target")
    return m.unionByName(e)


def _relations(notes: DataFrame) -> DataFrame:
    return relations.score(relations.candidates(_evidence(notes)))


def _override_flags() -> tuple[Column, Column]:
    """Overrides by the last digits of the ids: some hidden, some pinned."""
    a, b = F.right("node_a", F.lit(1)).cast("int"), F.right("node_b", F.lit(1)).cast("int")
    return (a == 7) & (b < 5), b == 3


def _overrides(pairs: DataFrame) -> DataFrame:
    hidden, pinned = _override_flags()
    return pairs.select("node_a", "node_b", hidden.alias("hidden"), pinned.alias("pinned")).where("hidden or pinned")


def _centered(notes: DataFrame) -> DataFrame:
    """Relations from both ends with their flags, which here follow from the ids, so no join is needed."""
    hidden, pinned = _override_flags()
    return relations.by_center(_relations(notes).withColumn("hidden", hidden).withColumn("pinned", pinned & ~F.col("hidden")))


POOL = Retrieval()
FLOOR = BoundaryPolicy(quality_floor=0.2)


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.unit_vectors(corpora.units(spark, sf_dir), 64, False)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.semantic_pool(_units(spark, sf_dir), POOL)


# -- names, mentions, links -----------------------------------------------------


@query(sql("keys", then="SELECT name_key, status, candidates, CASE WHEN status = 'resolved' THEN target END AS target FROM keys"))
def names_dictionary(spark, d):
    return entities.resolutions(_dictionary(corpora.notes(spark, d)))


@query(sql("mentions", then="SELECT status, count(*) AS mentions, count(DISTINCT name_key) AS names FROM mentions GROUP BY status"))
def resolve_status_counts(spark, d):
    return _mentions(corpora.notes(spark, d)).groupBy("status").agg(F.count("*").alias("mentions"), F.countDistinct("name_key").alias("names"))


@query(sql("mentions", then="SELECT source, section, place, name_key, target FROM mentions WHERE status = 'resolved'"))
def mentions_resolved(spark, d):
    return _mentions(corpora.notes(spark, d)).where("status = 'resolved'").select("source", F.col("section").cast("long").alias("section"), F.col("place").cast("long").alias("place"), "name_key", "target")


@query(sql("mentions", then="SELECT source, section, target, min(place) AS place, count(*) AS hits FROM mentions WHERE status = 'resolved' GROUP BY ALL"))
def mentions_decorate(spark, d):
    rows = _mentions(corpora.notes(spark, d)).where("status = 'resolved'")
    named = rows.select("source", "section", "target", F.col("place").alias("start"), F.concat_ws("/", "source", F.col("section").cast("string")).alias("block"), F.col("name_key").alias("name"))
    marked = mentions.with_decoration(named)
    return marked.groupBy("source", F.col("section").cast("long").alias("section"), "target").agg(F.max(F.when(F.col("decorate"), F.col("start"))).cast("long").alias("place"), F.count("*").alias("hits"))


@query(sql("mentions", then="SELECT target, count(*) AS mentions, count(DISTINCT source) AS sources FROM mentions WHERE status = 'resolved' AND source <> target GROUP BY target"))
def mentions_by_target(spark, d):
    rows = _mentions(corpora.notes(spark, d)).where("status = 'resolved' and source <> target")
    return rows.groupBy("target").agg(F.count("*").alias("mentions"), F.countDistinct("source").alias("sources"))


@query(sql("links", then="SELECT source, raw, CASE WHEN target IS NULL THEN 'missing' ELSE 'resolved' END AS status, target FROM links"))
def wikilinks_resolved(spark, d):
    return _links(corpora.notes(spark, d)).select("source", "raw", "status", "target")


@query(
    r"""WITH raw AS (SELECT page_id, unnest(regexp_extract_all(coalesce(html, ''), '<a\s[^>]*href="([^"]*)"', 1)) AS href FROM pages)
SELECT r.page_id, href, CASE WHEN count(p.page_id) = 0 THEN 'missing' WHEN count(DISTINCT p.page_id) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, count(DISTINCT p.page_id) AS candidates
FROM (SELECT DISTINCT page_id, href FROM raw) r LEFT JOIN pages p ON p.url = r.href GROUP BY ALL"""
)
def wikilinks_missing(spark, d):
    pages = table(spark, d, "pages")
    hrefs = pages.select("page_id", F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    n = F.countDistinct("target")
    found = hrefs.join(pages.select(F.col("url").alias("href"), F.col("page_id").alias("target")), "href", "left").groupBy("page_id", "href").agg(n.alias("candidates"))
    return found.select("page_id", "href", F.when(F.col("candidates") == 0, "missing").when(F.col("candidates") == 1, "resolved").otherwise("ambiguous").alias("status"), "candidates")


@query(sql("notes", then="SELECT doc, path, regexp_replace(path, '\\.md$', '') AS key, CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN path ELSE doc || '.md' END AS normal FROM notes"))
def path_resolution(spark, d):
    n = corpora.notes(spark, d)
    odd = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("../"), "path")).when(F.col("doc_id") % 5 == 1, F.concat(F.lit("./x/..//"), "path")).otherwise(F.concat(F.lit("a\\b\\..\\..\\"), "doc", F.lit(".md")))
    return n.select("doc", "path", path_key(F.col("path")).alias("key"), normal_path(odd).alias("normal"))


# -- relations ------------------------------------------------------------------


@query(sql("cands", then="SELECT node_a, node_b, sections, mentions, links FROM cands"))
def relation_candidates(spark, d):
    return relations.candidates(_evidence(corpora.notes(spark, d)))


@query(sql("rels", then="SELECT node_a, node_b, mention, explicit, score FROM rels"))
def relation_scores(spark, d):
    return _relations(corpora.notes(spark, d)).select("node_a", "node_b", "mention", "explicit", "score")


@query(sql("marks", then="SELECT node_a, node_b, score, hidden, pinned FROM marks WHERE NOT hidden"))
def relations_with_overrides(spark, d):
    r = _relations(corpora.notes(spark, d))
    return relations.with_overrides(r, _overrides(r.select("node_a", "node_b"))).where(~F.col("hidden")).select("node_a", "node_b", "score", "hidden", "pinned")


@query(sql("centered", then="SELECT center, neighbor, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY score DESC, neighbor) AS rank FROM centered WHERE NOT hidden) WHERE rank <= 10"))
def neighborhood_topk(spark, d):
    shown = _centered(corpora.notes(spark, d)).where(~F.col("hidden"))
    from pyspark.sql import Window as W

    ranked = shown.withColumn("rank", F.row_number().over(W.partitionBy("center").orderBy(F.desc("score"), "neighbor")).cast("long"))
    return ranked.where("rank <= 10").select("center", "neighbor", "score", "rank")


@query(sql("centered", then="SELECT node_a, node_b, max(score) AS score FROM centered WHERE NOT hidden GROUP BY ALL"))
def global_graph_edges(spark, d):
    return relations.global_edges(_centered(corpora.notes(spark, d)))


@query(sql("centered", "notes", then="SELECT n.doc, count(c.center) AS degree FROM notes n LEFT JOIN (SELECT center FROM centered WHERE NOT hidden AND score >= 0.5) c ON c.center = n.doc GROUP BY n.doc"))
def global_graph_nodes(spark, d):
    n = corpora.notes(spark, d)
    edges = relations.global_edges(_centered(n)).where(F.col("score") >= 0.5)
    return relations.global_nodes(n.select("doc"), edges)


@query(sql("centered", "notes", then="SELECT doc, degree, label_rank FROM (SELECT doc, degree, row_number() OVER (ORDER BY degree DESC, doc) AS label_rank, count(*) OVER () AS n FROM (SELECT n.doc, count(c.center) AS degree FROM notes n LEFT JOIN (SELECT center FROM centered WHERE NOT hidden) c ON c.center = n.doc GROUP BY n.doc)) WHERE label_rank <= greatest(3, ceil(n * 0.3))"))
def degree_label_rank(spark, d):
    n = corpora.notes(spark, d)
    return relations.label_rank(relations.global_nodes(n.select("doc"), relations.global_edges(_centered(n))), 0.3)


@query()
def multi_turn_sections(spark, d):
    """Relations between conversations whose turns are sections and whose first word is their name."""
    return _conversation_relations(table(spark, d, "conversations"))


def _conversation_relations(conversations: DataFrame) -> DataFrame:
    rows = conversations.where("conv_id is not null and text is not null").select(corpora.padded(F.col("conv_id")).alias("doc"), F.col("turn").alias("section"), "text")
    first = rows.groupBy("doc").agg(F.min_by(F.regexp_extract(F.lower("text"), f"({corpora.WORD})", 1), "section").alias("name")).select("doc", "name", F.lit("filename").alias("source")).where(F.char_length("name") >= 1)
    met = mentions.token_mentions(rows, entities.dictionary(first)).select("kind", "source", F.col("section").cast("string").alias("section"), "status", "target")
    return relations.score(relations.candidates(met)).select("node_a", "node_b", "sections", "mentions", "score")


ORACLES["multi_turn_sections"] = f"""WITH r AS (SELECT lpad(CAST(conv_id AS VARCHAR), 8, '0') AS doc, turn AS section, text FROM conversations WHERE conv_id IS NOT NULL AND text IS NOT NULL),
nm AS (SELECT doc, arg_min(regexp_extract(lower(text), '([\\p{{L}}\\p{{N}}_]+)', 1), section) AS name FROM r GROUP BY doc),
k AS (SELECT name, count(*) AS n, min(doc) AS target FROM nm WHERE length(name) >= 2 AND name NOT IN ({corpora.GENERIC}) GROUP BY name),
t AS (SELECT doc, section, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS token FROM r),
m AS (SELECT doc AS source, section, target FROM t JOIN k ON token = name WHERE n = 1 AND doc <> target)
SELECT least(source, target) AS node_a, greatest(source, target) AS node_b, count(DISTINCT source || '/' || CAST(section AS VARCHAR)) AS sections, count(*) AS mentions,
  round(least(CAST(0.8 AS DOUBLE), CAST(0.5 AS DOUBLE) + (count(DISTINCT source || '/' || CAST(section AS VARCHAR)) - 1) * CAST(0.1 AS DOUBLE)), 12) AS score FROM m GROUP BY ALL"""


# -- vectors and the cut --------------------------------------------------------


@query("SELECT status, count(*) AS vectors FROM (SELECT CASE WHEN embedding IS NULL OR len(embedding) <> 64 THEN 'dimensions' WHEN sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) <= 1e-12 THEN 'zero' WHEN abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 0.03 THEN 'not-normalized' ELSE 'ok' END AS status FROM embeddings) GROUP BY status")
def vector_check(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, d, "embeddings").select(vectors.vector_status(v, 64, True).alias("status")).groupBy("status").agg(F.count("*").alias("vectors"))


@query(sql("normed", then="SELECT a.unit AS unit_a, b.unit AS unit_b, round(list_inner_product(a.v, b.v), 9) AS cosine FROM normed a JOIN normed b ON a.unit <> b.unit WHERE CAST(a.unit AS INTEGER) % 50 = 0 AND list_inner_product(a.v, b.v) >= 0.2"))
def cosine_pairs(spark, d):
    """Cosines of every fiftieth unit, the stated query set, with all others; from 0.2 on."""
    u = _units(spark, d)
    met = vectors.asked_cosines(u.where(F.col("unit").cast("long") % 50 == 0), u, least=0.2)
    return met.select("unit_a", "unit_b", F.round("cosine", 9).alias("cosine"))


@query(sql("pool", then="SELECT center, neighbor, round(similarity, 9) AS similarity, rank, pool_size FROM pool"))
def semantic_pool_max(spark, d):
    return _pool(spark, d).select("center", "neighbor", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("long").alias("rank"), "pool_size")


@query(
    sql(
        "normed",
        then=""", met AS (SELECT a.doc AS center, b.doc AS neighbor, a.section AS l, b.section AS r, greatest(-1, least(1, list_inner_product(a.v, b.v))) AS c, a.unit || b.unit AS tie FROM normed a JOIN normed b ON a.doc <> b.doc),
one AS (SELECT center, neighbor, l, r, c FROM met QUALIFY row_number() OVER (PARTITION BY center, neighbor ORDER BY c DESC, tie) = 1),
two AS (SELECT m.center, m.neighbor, m.l, m.r, m.c FROM met m JOIN one o USING (center, neighbor) WHERE m.l <> o.l AND m.r <> o.r QUALIFY row_number() OVER (PARTITION BY center, neighbor ORDER BY m.c DESC, tie) = 1),
three AS (SELECT m.center, m.neighbor, m.c FROM met m JOIN one o USING (center, neighbor) JOIN two t USING (center, neighbor) WHERE m.l NOT IN (o.l, t.l) AND m.r NOT IN (o.r, t.r) QUALIFY row_number() OVER (PARTITION BY center, neighbor ORDER BY m.c DESC, tie) = 1),
mean AS (SELECT center, neighbor, avg(c) AS similarity FROM (SELECT center, neighbor, c FROM one UNION ALL SELECT center, neighbor, c FROM two UNION ALL SELECT * FROM three) GROUP BY ALL)
SELECT center, neighbor, round(similarity, 9) AS similarity, rank, pool_size FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY similarity DESC, neighbor) AS rank, count(*) OVER (PARTITION BY center) AS pool_size FROM mean) WHERE rank <= 100""",
    )
)
def semantic_pool_topmean(spark, d):
    """Pools by the mean of three matches whose sections differ on both sides."""
    pool = vectors.semantic_pool(_units(spark, d), Retrieval(aggregation="top-mean"))
    return pool.select("center", "neighbor", F.round("similarity", 9).alias("similarity"), F.col("rank").cast("long").alias("rank"), "pool_size")


@query(sql("pool", then="SELECT center, neighbor, round(least(1, greatest(0, (similarity - 0.2) / 0.7)), 9) AS strength FROM pool"))
def semantic_strength(spark, d):
    return _pool(spark, d).select("center", "neighbor", F.round(vectors.strength(F.col("similarity"), "text-text"), 9).alias("strength"))


@query(sql("cuts", then="SELECT center, members, round(median_gap, 9) AS median_gap, round(mad, 9) AS mad, round(threshold, 9) AS threshold, cut_rank FROM cuts"))
def gap_diagnostics(spark, d):
    g = boundary.diagnostics(_pool(spark, d))
    return g.select("center", "members", *(F.round(c, 9).alias(c) for c in ("median_gap", "mad", "threshold")), F.col("cut_rank").cast("long").alias("cut_rank"))


@query(sql("decided", then="SELECT center, neighbor, rank, accepted, reason FROM decided"))
def boundary_decisions(spark, d):
    return boundary.decisions(_pool(spark, d), FLOOR).select("center", "neighbor", F.col("rank").cast("long").alias("rank"), "accepted", "reason")


@query(sql("hybrid", then="SELECT center, neighbor, round(greatest(m, s) + CAST(0.3 AS DOUBLE) * e * (1 - greatest(m, s)), 9) AS score FROM hybrid"))
def hybrid_relations(spark, d):
    pool = boundary.decisions(_pool(spark, d), FLOOR).where("accepted").withColumn("strength", vectors.strength(F.col("similarity"), "text-text"))
    both = relations.score(relations.merge_semantic(_centered(corpora.notes(spark, d)), pool))
    return both.select("center", "neighbor", F.round("score", 9).alias("score"))


@query(sql("units", "notes", then="SELECT count(*) AS documents, sum(units) AS units, sum(CASE WHEN status = 'ready' THEN units ELSE 0 END) AS ready, CASE WHEN min(CAST(status = 'ready' AS INTEGER)) = 1 THEN 'ready' ELSE 'partial' END AS status FROM (SELECT n.doc, coalesce(u.n, 0) AS units, CASE WHEN u.n IS NULL THEN 'pending' WHEN n.doc_id % 9 = 0 THEN 'stale' ELSE 'ready' END AS status FROM notes n LEFT JOIN (SELECT doc, count(*) AS n FROM units GROUP BY doc) u USING (doc))"))
def coverage_status(spark, d):
    n = corpora.notes(spark, d)
    u = corpora.units(spark, d).groupBy("doc").agg(F.count("*").alias("units"))
    old = F.when(F.col("doc").cast("int") % 9 == 0, 0).otherwise(1).cast("long")
    indexed = u.select("doc", old.alias("revision"), F.lit("ready").alias("status"), "units", F.when(old == 1, F.col("units")).otherwise(0).alias("ready"))
    return vectors.coverage(vectors.document_status(n.select("doc", "revision"), indexed))


@query(sql("units", then="SELECT unit, doc FROM units WHERE CAST(doc AS INTEGER) % 4 <> 0"))
def stale_vectors_antijoin(spark, d):
    u = corpora.units(spark, d)
    live = u.select("doc").distinct().withColumn("revision", F.when(F.col("doc").cast("int") % 4 == 0, 2).otherwise(1).cast("long"))
    return vectors.valid_units(u, live).select("unit", "doc")


@query("SELECT action, count(*) AS units FROM (SELECT CASE WHEN vec_id % 3 = 0 THEN 'encode' ELSE 'reuse' END AS action FROM embeddings WHERE vec_id IS NOT NULL) GROUP BY action")
def vector_reuse_split(spark, d):
    u = corpora.units(spark, d).select("doc", "unit", F.sha2("unit", 256).alias("content_hash"))
    new = u.withColumn("content_hash", F.when(F.col("unit").cast("int") % 3 == 0, F.sha2(F.concat("unit", F.lit("x")), 256)).otherwise(F.col("content_hash")))
    return vectors.reuse_split(u, new).groupBy("action").agg(F.count("*").alias("units"))


@query("""WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, 1 + event_id % 2 AS revision, 1 + user_id % 2 AS live FROM events WHERE user_id IS NOT NULL)
SELECT accepted, count(*) AS results FROM (SELECT revision = live AND sequence = max(sequence) OVER (PARTITION BY user_id) AS accepted FROM r) GROUP BY accepted""")
def late_results_guard(spark, d):
    from pyspark.sql import Window as W

    e = table(spark, d, "events").where("user_id is not null")
    rows = e.select(F.col("user_id").alias("doc"), (F.lit(1) + F.col("event_id") % 2).alias("revision"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("sequence"))
    live = e.select(F.col("user_id").alias("doc")).distinct().withColumn("revision", F.lit(1) + F.col("doc") % 2)
    return vectors.current_results(rows, live).groupBy("accepted").agg(F.count("*").alias("results"))


# -- exploration ----------------------------------------------------------------


@query(sql("mapped", then="SELECT center, neighbor, score, round(high - (high - low) * 50 / 100, 12) AS threshold, row_number() OVER (PARTITION BY center, pinned ORDER BY score DESC, neighbor) AS rank FROM mapped WHERE NOT hidden AND (score >= round(high - (high - low) * 50 / 100, 12) OR pinned)"))
def visible_relations(spark, d):
    """The flagship: every center's relations over its threshold at lens 50."""
    return explore.visible(_centered(corpora.notes(spark, d))).select("center", "neighbor", "score", "threshold", F.col("rank").cast("long").alias("rank"))


@query(sql("mapped", then="SELECT DISTINCT center, low, high, round(high - (high - low) * 70 / 100, 12) AS threshold FROM mapped"))
def lens_threshold(spark, d):
    m = explore.lens_mapping(_centered(corpora.notes(spark, d)))
    return m.withColumn("threshold", explore.threshold(F.lit(70), F.col("low"), F.col("high")))


@query(sql("mapped", then="SELECT lens, count(*) FILTER (WHERE score >= round(high - (high - low) * lens / 100, 12) OR pinned) AS eligible FROM (SELECT *, unnest([0, 25, 50, 75, 100]) AS lens FROM mapped WHERE NOT hidden) GROUP BY lens"))
def lens_grid_counts(spark, d):
    return explore.lens_grid(_centered(corpora.notes(spark, d)))


@query(sql("mapped", then="SELECT center, count(*) AS eligible, least(count(*) FILTER (WHERE NOT pinned), 5) + count(*) FILTER (WHERE pinned) AS visible, count(*) FILTER (WHERE NOT pinned) - least(count(*) FILTER (WHERE NOT pinned), 5) AS remaining, count(*) FILTER (WHERE pinned) AS pinned FROM mapped WHERE NOT hidden AND (score >= round(high - (high - low) * 80 / 100, 12) OR pinned) GROUP BY center"))
def visible_topk_pins(spark, d):
    return explore.counters(_centered(corpora.notes(spark, d)), 80, 5)


@query(sql("centered", then="SELECT f.center AS focus, m.node_a, m.node_b, m.score FROM marks m JOIN centered f ON f.neighbor = m.node_a AND NOT f.hidden JOIN centered g ON g.center = f.center AND g.neighbor = m.node_b AND NOT g.hidden WHERE NOT m.hidden"))
def snapshot_cross_edges(spark, d):
    """Relations among the neighbors of every note."""
    n = corpora.notes(spark, d)
    return explore.cross_relations(_centered(n), n.select("doc"))


@query("SELECT 'snap-' || CAST(doc_id AS VARCHAR) AS snapshot, CASE WHEN doc_id % 5 = 0 OR doc_id % 11 = 0 THEN 'invalid' WHEN doc_id % 3 = 0 OR doc_id % 2 = 0 THEN 'stale' ELSE 'current' END AS status, CASE WHEN doc_id % 11 = 0 THEN 'focus-removed' WHEN doc_id % 5 = 0 THEN 'focus-revision-changed' ELSE concat_ws(',', CASE WHEN doc_id % 3 = 0 THEN 'index-revision-changed' END, CASE WHEN doc_id % 2 = 0 THEN 'user-declarations-changed' END) END AS reasons, CAST(0 AS BIGINT) AS invalidated FROM documents WHERE doc_id IS NOT NULL")
def snapshot_validity(spark, d):
    n = corpora.notes(spark, d)
    k = F.col("doc_id")
    heads = n.select(F.concat(F.lit("snap-"), k.cast("string")).alias("snapshot"), F.col("doc").alias("focus"), F.lit(1).alias("focus_revision"), F.when(k % 3 == 0, 6).otherwise(7).alias("index_revision"), F.when(k % 2 == 0, 2).otherwise(3).alias("policy_revision"))
    live = n.where(k % 11 != 0).select("doc", F.when(k % 5 == 0, 2).otherwise(1).alias("revision"))
    return explore.snapshot_status(heads, live, 7, 3)


@query(sql("notes", then="SELECT doc, start, CASE WHEN doc_id % 6 = 0 THEN 'stale' WHEN start + 5 > length(markdown) THEN 'invalid' ELSE 'valid' END AS status, CASE WHEN doc_id % 6 <> 0 AND start + 5 <= length(markdown) THEN substring(markdown, start + 1, 5) END AS text, CASE WHEN doc_id % 6 <> 0 AND start + 5 <= length(markdown) THEN substring(markdown, greatest(start - 80, 0) + 1, start + 85 - greatest(start - 80, 0)) END AS excerpt FROM (SELECT *, (doc_id * 13) % 400 AS start FROM notes)"))
def evidence_lookup(spark, d):
    n = corpora.notes(spark, d)
    start = (F.col("doc_id") * 13 % 400).cast("int")
    loc = n.select("doc", F.when(F.col("doc_id") % 6 == 0, 2).otherwise(1).cast("long").alias("revision"), F.lit("root").alias("section"), start.alias("start"), (start + 5).alias("end"))
    whole = n.select("doc", F.lit("root").alias("section"), F.lit(0).alias("s"), F.char_length("markdown").alias("e"))
    return explore.read_evidence(loc, n, whole).select("doc", F.col("start").cast("long").alias("start"), "status", "text", "excerpt")


@query(sql("mapped", then="SELECT center, neighbor, ring, round((195 + 160 * ring) * cos(2 * pi() * (k - 3 * ring * (ring + 1)) / (6 + 6 * ring)), 6) + 0.0 AS x, round((195 + 160 * ring) * sin(2 * pi() * (k - 3 * ring * (ring + 1)) / (6 + 6 * ring)), 6) + 0.0 AS y FROM (SELECT *, CAST(floor((sqrt(9 + 12 * CAST(k AS DOUBLE)) - 3) / 6) AS INTEGER) AS ring FROM (SELECT center, neighbor, row_number() OVER (PARTITION BY center, pinned ORDER BY score DESC, neighbor) - 1 AS k FROM mapped WHERE NOT hidden AND NOT pinned AND score >= round(high - (high - low) * 50 / 100, 12)))"))
def ring_layout(spark, d):
    rows = explore.ring_layout(explore.visible(_centered(corpora.notes(spark, d))).where(~F.col("pinned")))
    return rows.select("center", "neighbor", "ring", (F.round("x", 6) + 0.0).alias("x"), (F.round("y", 6) + 0.0).alias("y"))


# -- sources and ingest ---------------------------------------------------------

RULES = "src1*\n!src10/\nsrc2/*7.md\n!src12/*1.md\nsrc3/*[05].md\n"
#: Of src12 no file comes back, as its folder is left out.
_KEPT = "CASE WHEN regexp_full_match(path, 'src2/[^/]*7\\.md|src3/[^/]*[05]\\.md') THEN false WHEN path LIKE 'src10/%' THEN true WHEN path LIKE 'src1%' THEN false ELSE true END"


@query(sql("notes", then=f"SELECT path, {_KEPT} AS kept FROM notes"))
def ignore_filter(spark, d):
    return corpora.notes(spark, d).select("path", vault.kept_by(F.col("path"), RULES).alias("kept"))


@query(sql("notes", then=f"SELECT regexp_extract(path, '^([^/]*)/', 1) AS folder, count(*) FILTER (WHERE {_KEPT}) AS included, count(*) FILTER (WHERE NOT ({_KEPT})) AS excluded FROM notes GROUP BY 1"))
def scope_rollup(spark, d):
    return vault.scope(corpora.notes(spark, d), RULES)


def _stored(n: DataFrame) -> DataFrame:
    """What was stored before: without every seventh note, and with other text in every third."""
    old = F.when(F.col("doc_id") % 3 == 0, F.lit("old")).otherwise(F.col("markdown"))
    return n.where("doc_id % 7 <> 0").select("doc", "path", ingest.content_hash(old).alias("content_hash"), F.lit("1").alias("parser_version"), F.lit(4).cast("long").alias("revision"), F.lit(9).cast("long").alias("epoch"))


@query(sql("notes", then="SELECT doc, CASE WHEN doc_id % 5 = 0 AND doc_id % 7 = 0 THEN 'gone' WHEN doc_id % 5 = 0 THEN 'kept' WHEN doc_id % 7 = 0 THEN 'added' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'unchanged' END AS action, CAST(CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 5 ELSE 4 END AS BIGINT) AS revision, CAST(CASE WHEN doc_id % 7 = 0 THEN 1 WHEN doc_id % 3 = 0 AND doc_id % 5 <> 0 THEN 10 ELSE 9 END AS BIGINT) AS epoch FROM notes WHERE NOT (doc_id % 5 = 0 AND doc_id % 7 = 0)"))
def ingest_classify(spark, d):
    n = corpora.notes(spark, d)
    return ingest.classify(_stored(n), n.where("doc_id % 5 <> 0")).select("doc", "action", "revision", "epoch")


@query(sql("notes", then="SELECT doc, path, CAST(4 AS BIGINT) AS revision, CAST(10 AS BIGINT) AS epoch FROM notes WHERE doc_id % 7 <> 0 AND doc_id % 5 = 0"))
def ingest_deletes(spark, d):
    n = corpora.notes(spark, d)
    return ingest.deletions(_stored(n), n.where("doc_id % 5 <> 0"))


@query(sql("notes", then="SELECT path, CASE WHEN k = 0 THEN 'same' WHEN k = 1 THEN 'update' WHEN k = 2 THEN 'keep-local' WHEN k = 3 THEN 'conflict' WHEN k = 4 THEN 'add' ELSE 'delete' END AS action FROM (SELECT path, doc_id % 6 AS k FROM notes)"))
def three_way_sync(spark, d):
    n = corpora.notes(spark, d)
    k = F.col("doc_id") % 6
    own = F.sha2("markdown", 256)
    local = n.where(k != 4).select("path", F.when(k.isin(2, 3), F.sha2("path", 256)).otherwise(own).alias("hash"))
    base = n.where(k != 4).select("path", own.alias("hash"))
    source = n.where(k != 5).select("path", F.when(k.isin(1, 3), F.sha2("doc", 256)).otherwise(own).alias("hash"))
    return ingest.three_way(local, base, source)


@query(r"""WITH dw AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS doc, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL), bw AS (SELECT item_id AS item, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
dr AS (SELECT DISTINCT doc, array_to_string(w[i:i+7], ' ') AS run FROM (SELECT doc, w, unnest(range(1, len(w) - 6)) AS i FROM dw WHERE len(w) >= 8)), br AS (SELECT DISTINCT item, array_to_string(w[i:i+7], ' ') AS run FROM (SELECT item, w, unnest(range(1, len(w) - 6)) AS i FROM bw WHERE len(w) >= 8))
SELECT DISTINCT doc, item FROM dr JOIN br USING (run)""")
def leak_check(spark, d):
    return ingest.leaks(corpora.notes(spark, d), table(spark, d, "benchmark").select(F.col("item_id").alias("item"), F.coalesce("text", F.lit("")).alias("text")))


@query(sql("notes", then="SELECT doc, unnest(range(pieces)) AS chunk, octet_length(encode(substring(markdown, unnest(range(pieces)) * 480 + 1, 480))) + 32 AS tokens FROM (SELECT doc, markdown, greatest(1, (length(markdown) + 479) // 480) AS pieces FROM notes WHERE length(markdown) > 0)"))
def chunk_charbudget(spark, d):
    from ..operators.chunks import fixed_chunks

    return fixed_chunks(corpora.notes(spark, d), 480).select("doc", "chunk", "tokens")


# -- search ---------------------------------------------------------------------


def _searched(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpora.notes(spark, sf_dir)
    return n.select("doc", F.regexp_extract("markdown", f"({corpora.WORD})", 1).alias("title"), F.col("markdown").alias("body"))


@query(sql("notes", then=r"""SELECT doc, round(s, 9) AS score FROM (SELECT doc, ln(1 + (n - df0 + 0.5) / (df0 + 0.5)) * tf0 * 2.2 / (tf0 + 1.2 * (0.25 + 0.75 * len / mean)) + ln(1 + (n - df1 + 0.5) / (df1 + 0.5)) * tf1 * 2.2 / (tf1 + 1.2 * (0.25 + 0.75 * len / mean)) AS s
FROM (SELECT *, count(*) OVER () AS n, avg(len) OVER () AS mean, count(*) FILTER (WHERE tf0 > 0) OVER () AS df0, count(*) FILTER (WHERE tf1 > 0) OVER () AS df1 FROM (SELECT doc, CAST(len(t) * 3 + len(b) AS DOUBLE) AS len, CAST(len(list_filter(t, lambda x: x = 'of')) * 3 + len(list_filter(b, lambda x: x = 'of')) AS DOUBLE) AS tf0, CAST(len(list_filter(t, lambda x: x = 'than')) * 3 + len(list_filter(b, lambda x: x = 'than')) AS DOUBLE) AS tf1
FROM (SELECT doc, regexp_extract_all(strip_accents(lower(regexp_extract(markdown, '([\p{L}\p{N}_]+)', 1))), '[\p{L}\p{N}_]+') AS t, regexp_extract_all(strip_accents(lower(markdown)), '[\p{L}\p{N}_]+') AS b FROM notes))) WHERE tf0 > 0 AND tf1 > 0) ORDER BY score DESC, doc LIMIT 20"""))
def search_text_bm25(spark, d):
    return search.search_text(_searched(spark, d), "Than of")


@query(sql("notes", then="SELECT doc, strpos(markdown, 'The ') - 1 AS offset_, substring(markdown, greatest(strpos(markdown, 'The ') - 81, 0) + 1, strpos(markdown, 'The ') - 1 + 124 - greatest(strpos(markdown, 'The ') - 81, 0)) AS excerpt FROM notes WHERE contains(markdown, 'The ') ORDER BY doc LIMIT 1000"))
def search_literal(spark, d):
    return search.search_literal(_searched(spark, d), "The ", 1000).select("doc", F.col("offset").cast("long").alias("offset_"), "excerpt")


@query(sql("notes", then=r"SELECT doc, length(regexp_extract(markdown, '^((?s:.*?)(?:^|[^\p{L}\p{N}_.$+/#:-]))with(?:[^\p{L}\p{N}_.$+/#:-]|$)', 1)) AS offset_ FROM notes WHERE regexp_matches(markdown, '(?:^|[^\p{L}\p{N}_.$+/#:-])with(?:[^\p{L}\p{N}_.$+/#:-]|$)') ORDER BY doc LIMIT 1000"))
def search_exact(spark, d):
    return search.search_exact(_searched(spark, d), "with", 1000).select("doc", F.col("offset").cast("long").alias("offset_"))


@query(sql("notes", then="SELECT doc FROM notes WHERE contains(lower(markdown), 'hand the')"))
def search_browser(spark, d):
    return search.search_browser(_searched(spark, d), "Hand THE")


# -- evaluation -----------------------------------------------------------------


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs inside slices of 16 documents, graded by their labels."""
    u = _units(spark, sf_dir)
    docs = u.groupBy("doc").agg(F.min("label").alias("label")).withColumn("k", F.col("doc").cast("int")).withColumn("slice", F.floor(F.col("k") / 16))
    a, b = docs.select("slice", *(F.col(c).alias(f"{c}_a") for c in ("doc", "label", "k"))), docs.select("slice", *(F.col(c).alias(f"{c}_b") for c in ("doc", "label", "k")))
    far = F.abs(F.col("label_a") - F.col("label_b"))
    rows = a.join(b, "slice").where("doc_a < doc_b").select(
        F.col("doc_a").alias("node_a"), F.col("doc_b").alias("node_b"), F.when(far == 0, 3).when(far == 1, 2).when(far == 2, 1).otherwise(0).alias("grade"), F.when(F.col("k_a") % 2 == 0, "dev").otherwise("test").alias("split"),
        (((F.col("k_a") + F.col("k_b")) % 5 == 0) & (far > 2)).alias("hard_negative"), F.when((F.col("k_a") + F.col("k_b")) % 3 == 0, 0.5).otherwise(0.0).alias("mention"), ((F.col("k_a") * F.col("k_b")) % 7 == 1).cast("int").alias("explicit"),
    )
    sims = u.select(F.col("doc").alias("node_a"), F.col("vector").alias("x")).join(rows.select("node_a", "node_b"), "node_a").join(u.select(F.col("doc").alias("node_b"), F.col("vector").alias("y")), "node_b")
    cos = sims.groupBy("node_a", "node_b").agg(F.max(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vectors.dot(F.col("x"), F.col("y"))))).alias("cosine"))
    return rows.join(cos, ["node_a", "node_b"])


_STRENGTH = "CASE WHEN cosine < low THEN CAST(0 AS DOUBLE) ELSE least(CAST(1 AS DOUBLE), greatest(CAST(0 AS DOUBLE), (cosine - low) / (CAST(0.9 AS DOUBLE) - low))) END"
_CENTERS = f"""ends AS (SELECT *, round(greatest(mention, st) + CAST(0.3 AS DOUBLE) * explicit * (1 - greatest(mention, st)), 12) AS score FROM (SELECT *, {_STRENGTH} AS st FROM base)),
both_ AS (SELECT low, node_a AS center, node_b AS other, grade, score FROM ends UNION ALL SELECT low, node_b, node_a, grade, score FROM ends),
ranked AS (SELECT *, CASE WHEN score > 0 THEN row_number() OVER (PARTITION BY low, center ORDER BY CASE WHEN score > 0 THEN score ELSE -1 END DESC, other) END AS rank, row_number() OVER (PARTITION BY low, center ORDER BY grade DESC, other) AS ideal FROM both_),
per AS (SELECT low, center, count(*) FILTER (WHERE grade >= 2) AS relevant, count(*) FILTER (WHERE grade >= 2 AND rank <= 3) / 3.0 AS p, least(count(*) FILTER (WHERE grade >= 2), 3) / 3.0 AS o, coalesce(sum(CASE WHEN rank <= 3 THEN (2 ** grade - 1) / log2(rank + 1.0) END), 0) AS dcg, sum(CASE WHEN ideal <= 3 THEN (2 ** grade - 1) / log2(ideal + 1.0) END) AS best, count(*) FILTER (WHERE score >= 0.5) AS shown FROM ranked GROUP BY low, center),
total AS (SELECT low, count(*) FILTER (WHERE relevant > 0) AS centers, round(avg(CASE WHEN relevant > 0 THEN p END), 9) AS p_at_k, round(avg(CASE WHEN relevant > 0 THEN o END), 9) AS oracle_p, round(avg(CASE WHEN relevant > 0 THEN CASE WHEN best > 0 THEN dcg / best ELSE 0 END END), 9) AS ndcg, coalesce(round(avg(CASE WHEN relevant = 0 THEN CAST(shown > 0 AS DOUBLE) END), 9), 0) AS zero_shown FROM per GROUP BY low)"""


@query(sql("graded", then=f", base AS (SELECT *, CAST(0.2 AS DOUBLE) AS low FROM graded), {_CENTERS} SELECT centers, CAST(p_at_k AS DOUBLE) AS p_at_k, CAST(oracle_p AS DOUBLE) AS oracle_p, ndcg, zero_shown FROM total"))
def eval_precision_ndcg(spark, d):
    score = evaluation.method_score("hybrid", F.lit(0.2), F.lit(0.9))
    return evaluation.summarize(evaluation.per_center(_graded(spark, d), score))


@query(sql("graded", then=f", base AS (SELECT *, unnest([CAST(0.2 AS DOUBLE), 0.35, 0.5, 0.65]) AS low FROM graded WHERE split = 'dev'), {_CENTERS}, hard AS (SELECT low, coalesce(avg(CASE WHEN hard_negative THEN CAST(score >= 0.5 AS DOUBLE) END), 0) AS h FROM ends GROUP BY low) SELECT low, ndcg, CAST(p_at_k AS DOUBLE) AS p_at_k, CAST(round(ndcg + 0.5 * p_at_k - 0.5 * h - 0.25 * zero_shown, 9) AS DOUBLE) AS objective FROM total JOIN hard USING (low)"))
def eval_calibration(spark, d):
    return evaluation.calibrate(_graded(spark, d).where("split = 'dev'"))


@query("SELECT CASE WHEN quality = 1 AND toxic = 0 THEN 'useful' WHEN quality = 1 THEN 'weak' WHEN toxic = 0 THEN 'wrong' ELSE 'invalid' END AS verdict, count(*) AS reviews, count(*) FILTER (WHERE doc_id % 2 = 0) AS notes FROM labels GROUP BY 1")
def review_summary(spark, d):
    q, t = F.col("quality") == 1, F.col("toxic") == 0
    verdict = F.when(q & t, "useful").when(q, "weak").when(t, "wrong").otherwise("odd")
    return evaluation.review_summary(table(spark, d, "labels").select(verdict.alias("verdict"), F.when(F.col("doc_id") % 2 == 0, "n").otherwise(" ").alias("note")))


@query()
def review_queue(spark, d):
    ends = F.least("center", "neighbor").alias("node_a"), F.greatest("center", "neighbor").alias("node_b")
    return evaluation.review_queue(_pool(spark, d).groupBy(*ends).agg(F.max("similarity").alias("score")))


@query("SELECT event_type, min(value) FILTER (WHERE r >= greatest(1, ceil(n * 0.5))) AS p50, min(value) FILTER (WHERE r >= greatest(1, ceil(n * 0.95))) AS p95, max(value) AS max FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type")
def latency_percentiles(spark, d):
    return evaluation.nearest_rank(table(spark, d, "events"), "event_type", "value")


# -- sessions -------------------------------------------------------------------


@query("""SELECT user_id, session_start, count(*) AS events FROM (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, min(ts) OVER (PARTITION BY user_id, s) AS session_start FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events))) GROUP BY ALL""")
def session_idle_windows(spark, d):
    from ..streaming.sessions import idle_windows

    return idle_windows(table(spark, d, "events"))


@query()
def session_state(spark, d):
    from ..streaming.sessions import replay

    return replay(table(spark, d, "events"))


# -- sections of generated Markdown ---------------------------------------------

_MD = "md AS (SELECT doc, '# n' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) AS a, markdown AS b, chr(10) || chr(10) || '## Links' || chr(10) || chr(10) AS c, '[[n' || CAST(doc_id * 7 + 3 AS VARCHAR) || '|see]]' AS d FROM notes)"


def _md_notes(notes: DataFrame) -> DataFrame:
    """Notes with a title, and their link under a heading of its own."""
    head = F.concat(F.lit("# n"), F.col("doc_id").cast("string"), F.lit("\n\n"))
    return corpora.links(notes).join(notes, "doc").select("doc", "path", F.concat(head, "markdown", F.lit("\n\n## Links\n\n"), "markup").alias("markdown"))


@query(sql("notes", then=f", {_MD} SELECT doc, title, depth, start, end_ FROM (SELECT doc, '' AS title, 0 AS depth, 0 AS start, length(a || b || c || d) AS end_ FROM md UNION ALL SELECT doc, substring(a, 3, length(a) - 4), 1, 0, length(a || b || c || d) FROM md UNION ALL SELECT doc, 'Links', 2, length(a || b) + 2, length(a || b || c || d) FROM md)"))
def sections_tree(spark, d):
    s = parse.child(parse.parse_notes(_md_notes(corpora.notes(spark, d)), ("sections",)), "sections")
    return s.select("doc", "title", "depth", "start", F.col("end").alias("end_"))


@query(sql("notes", then=f", {_MD} SELECT doc, length(a || b || c) AS at, doc || ':section:[\"' || substring(a, 3, length(a) - 4) || '\",\"Links\"]:0' AS section FROM md"))
def section_asof(spark, d):
    parsed = parse.parse_notes(_md_notes(corpora.notes(spark, d)), ("sections", "links"))
    return parse.assign_sections(parse.child(parsed, "links").select("doc", F.col("start").alias("at")), parse.child(parsed, "sections"))


# -- composed queries of the surfaces -------------------------------------------


@query(sql("mapped", then="SELECT center, neighbor, score FROM mapped WHERE NOT hidden AND (score >= round(high - (high - low) * 80 / 100, 12) OR pinned) AND NOT (score >= round(high - (high - low) * 30 / 100, 12) OR pinned)"))
def newly_visible(spark, d):
    return panels.newly_visible(_centered(corpora.notes(spark, d)), 30, 80)


@query(sql("evidence", then="SELECT node_a, node_b, string_agg(kind, ',' ORDER BY kind) AS kinds FROM (SELECT DISTINCT least(source, target) AS node_a, greatest(source, target) AS node_b, kind FROM evidence WHERE source <> target) GROUP BY ALL"))
def relation_kinds(spark, d):
    return panels.signal_kinds(relations.pairs(_evidence(corpora.notes(spark, d))))


@query(sql("mentions", "links", then="SELECT source, start, kind, target FROM (SELECT source, section * 100000 + place AS start, 'mention' AS kind, target FROM mentions WHERE status = 'resolved' UNION ALL SELECT source, -1, 'wiki', target FROM links WHERE target IS NOT NULL) ORDER BY source, start, kind LIMIT 500 OFFSET 250"))
def references_page(spark, d):
    n = corpora.notes(spark, d)
    m = _mentions(n).where("status = 'resolved'").select("source", (F.col("section").cast("long") * 100000 + F.col("place")).alias("start"), "target")
    w = _links(n).where("status = 'resolved'").select("source", F.lit(-1).cast("long").alias("start"), "target")
    return panels.page(panels.references(m, w), ["source", "start", "kind"], 250, 500)


@query(sql("mapped", "notes", then="SELECT center, rank, greatest(0, least(chars, 2000, 20000 - own - before)) AS taken FROM (SELECT *, coalesce(sum(least(chars, 2000)) OVER (PARTITION BY center ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT v.center, v.rank, length(b.markdown) AS chars, least(length(a.markdown), 6000) AS own FROM (SELECT center, neighbor, row_number() OVER (PARTITION BY center, pinned ORDER BY score DESC, neighbor) AS rank FROM mapped WHERE NOT hidden AND NOT pinned AND score >= round(high - (high - low) * 50 / 100, 12)) v JOIN notes a ON a.doc = v.center JOIN notes b ON b.doc = v.neighbor))"))
def evidence_packing(spark, d):
    n = corpora.notes(spark, d)
    chars = n.select("doc", F.char_length("markdown").alias("chars"))
    v = explore.visible(_centered(n)).where(~F.col("pinned")).select("center", F.col("neighbor").alias("doc"), "rank")
    packed = panels.pack_evidence(v.join(chars, "doc").select("center", "rank", "chars"), chars.withColumnRenamed("doc", "center"))
    return packed.select("center", F.col("rank").cast("long").alias("rank"), F.col("taken").cast("long").alias("taken"))


@query(sql("notes", then="SELECT path, parent, depth, folder, row_number() OVER (PARTITION BY parent ORDER BY folder DESC, path) AS place, count(*) OVER (PARTITION BY parent) AS siblings FROM (SELECT DISTINCT split_part(path, '/', 1) AS path, '' AS parent, 1 AS depth, true AS folder FROM notes UNION ALL SELECT path, split_part(path, '/', 1), 2, false FROM notes)"))
def path_tree(spark, d):
    t = panels.path_tree(corpora.notes(spark, d).select("path"))
    return t.withColumn("place", F.col("place").cast("long"))


@query(sql("notes", then="SELECT CASE doc_id % 4 WHEN 3 THEN 'discard' WHEN 0 THEN 'reuse' ELSE 'encode' END AS action, count(*) AS units, CAST(0 AS BIGINT) AS errors FROM notes GROUP BY 1"))
def embedding_index(spark, d):
    """Notes embedded by the stand-in provider: reused where the content is stored, encoded or discarded otherwise."""
    from ..operators.indexing import HashProvider, index

    n = corpora.notes(spark, d)
    k = F.col("doc_id") % 4
    u = n.select("doc", F.col("doc").alias("unit"), F.sha2("markdown", 256).alias("content_hash"), F.col("markdown").alias("text"), F.when(k == 3, 1).otherwise(2).cast("long").alias("revision"), F.lit(1).alias("sequence"))
    stored = u.where(F.col("doc").cast("int") % 4 == 0).select("doc", "content_hash", F.array_repeat(F.lit(0.25), 16).alias("vector"))
    live = n.select("doc", F.lit(2).cast("long").alias("revision"))
    return index(u, stored, live, HashProvider(16)).groupBy("action").agg(F.count("*").alias("units"), F.count("error").alias("errors"))
