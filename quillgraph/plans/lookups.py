"""Registered queries of upkeep, lookups and name matching, each with the DuckDB SQL that must give its rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions.policy import Chunking
from ..operators import bundle, chunks, entities, explore, mentions, panels, parse, relations, upkeep, vectors
from ..sources import corpora, vault
from ..sources.corpora import sql
from .queries import _KEPT, _MD, FLOOR, POOL, RULES, _centered, _links, _md_notes, _mentions, _override_flags, _pool, _relations, query

# -- names ----------------------------------------------------------------------

_FIRST = r"'^[^\p{L}\p{N}_]*([\p{L}\p{N}_]+(?: [\p{L}\p{N}_]+){%d})', 1"


#: DuckDB: names of three words, of two as aliases, and of links; and where they stand in the notes' lines, the longest at the leftmost place.
_NAMED = rf"""named AS (SELECT doc, regexp_extract(lower(markdown), {_FIRST % 2}) AS name FROM notes UNION SELECT doc, regexp_extract(lower(markdown), {_FIRST % 1}) FROM notes UNION SELECT doc, 'n' || CAST(doc_id AS VARCHAR) FROM notes),
known AS (SELECT name AS name_key, count(*) AS candidates, min(doc) AS target FROM named WHERE length(name) >= 2 GROUP BY name),
marked AS (SELECT string_agg(regexp_replace(name_key, '([\p{{L}}\p{{N}}_]+)', '<\1>', 'g'), '|' ORDER BY length(name_key) DESC, name_key) AS pattern FROM known)"""
_HITS = r"""found AS (SELECT doc AS source, regexp_extract_all(regexp_replace(regexp_replace(lower(markdown), '[<>]', '=', 'g'), '([\p{L}\p{N}_]+)', '<\1>', 'g'), pattern || '|' || chr(10)) AS h FROM notes, marked),
hits AS (SELECT source, count(*) FILTER (WHERE hit = chr(10)) OVER (PARTITION BY source ORDER BY k) AS section, hit FROM (SELECT source, unnest(h) AS hit, unnest(range(len(h))) AS k FROM found)),
pm AS (SELECT source, section, name_key, candidates, CASE WHEN candidates = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN candidates = 1 THEN target END AS target FROM (SELECT source, section, replace(replace(hit, '<', ''), '>', '') AS name_key FROM hits) JOIN known USING (name_key))"""


def _phrases(notes):
    """Names of three words and of links, and aliases of two words."""
    first = lambda more: F.regexp_extract(F.lower("markdown"), rf"^[^\p{{L}}\p{{N}}_]*([\p{{L}}\p{{N}}_]+(?: [\p{{L}}\p{{N}}_]+){{{more}}})", 1)
    names = corpora.link_names(notes).unionByName(notes.select("doc", first(2).alias("name"), F.lit("filename").alias("source")).where("name <> ''"))
    aliases = notes.select("doc", first(1).alias("name"), F.lit(None).cast("string").alias("section"), F.lit(False).alias("allow_short")).where("name <> ''")
    return entities.dictionary(names, aliases)


@query(sql("notes", then=f", {_NAMED}, {_HITS} SELECT source, name_key, status, target, count(*) AS hits FROM pm GROUP BY ALL"))
def phrase_mentions(spark, d):
    """Names of three and of two words, the longest at the leftmost place: how often each note holds each."""
    n = corpora.notes(spark, d)
    spans = n.select("doc", F.lit("root").alias("section"), F.col("doc").alias("block"), F.lit(0).alias("start"), F.col("markdown").alias("text"))
    met = mentions.dictionary_mentions(spans, _phrases(n))
    return met.groupBy(F.col("doc").alias("source"), entities.name_key(F.col("name")).alias("name_key"), "status", "target").agg(F.count("*").alias("hits"))


_AGAIN = lambda name: corpora.SQL[name].replace("FROM mentions", "FROM pm").replace("evidence", "evidence2").replace("cands", "cands2").replace("rels AS", "rels2 AS")


@query(sql("notes", "links", then=f", {_NAMED}, {_HITS}, {_AGAIN('evidence')}, {_AGAIN('cands')}, {_AGAIN('rels')} SELECT node_a, node_b, sections, mentions, links, mention, explicit, score FROM rels2"))
def phrase_relations(spark, d):
    """The relations that names of several words and aliases make, with the explicit links."""
    n = corpora.notes(spark, d)
    spans = corpora.note_lines(n).select("doc", F.col("section").cast("string").alias("section"), F.concat_ws("/", "doc", F.col("section").cast("string")).alias("block"), F.lit(0).alias("start"), "text")
    met = mentions.dictionary_mentions(spans, _phrases(n)).select(F.lit("mention").alias("kind"), F.col("doc").alias("source"), "section", "status", "target")
    links = _links(n).select(F.lit("explicit").alias("kind"), "source", F.lit("links").alias("section"), "status", "target")
    return relations.score(relations.candidates(met.unionByName(links))).select("node_a", "node_b", "sections", "mentions", "links", "mention", "explicit", "score")


@query(sql("notes", then="SELECT 'a' || CAST(doc_id // 2 AS VARCHAR) AS name_key, CASE WHEN count(DISTINCT doc) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CAST(count(DISTINCT doc) AS BIGINT) AS candidates, CASE WHEN count(DISTINCT doc) = 1 THEN min(doc) END AS target FROM notes WHERE doc_id % 3 <> 0 GROUP BY 1"))
def aliases_resolved(spark, d):
    """Aliases that two documents share; those of documents that are gone do not count."""
    n = corpora.notes(spark, d)
    here = corpora.link_names(n.where("doc_id % 3 <> 0"))
    aliases = n.select("doc", F.concat(F.lit("A"), F.expr("doc_id div 2").cast("string")).alias("name"), F.lit(None).cast("string").alias("section"), F.lit(False).alias("allow_short"))
    return entities.resolutions(entities.dictionary(here, aliases)).where(F.col("name_key").startswith("a"))


@query(sql("notes", then="SELECT a.doc AS source, CASE WHEN a.doc_id % 3 = 1 THEN a.doc WHEN a.doc_id % 3 = 2 THEN CASE WHEN b.path IS NOT NULL THEN b.doc END ELSE b.doc END AS target, CASE WHEN a.doc_id % 3 = 1 OR b.doc IS NOT NULL THEN 'resolved' ELSE 'missing' END AS status FROM notes a LEFT JOIN notes b ON b.doc_id = a.doc_id + 1 AND (a.doc_id % 3 = 0 OR (a.doc_id % 3 = 2 AND coalesce(split_part(a.path, '/', 1) = split_part(b.path, '/', 1), false)))"))
def links_by_path(spark, d):
    """Links by path from the root, to the note itself, and by a path relative to the note's folder."""
    n = corpora.notes(spark, d)
    after = n.select((F.col("doc_id") - 1).alias("doc_id"), F.col("path").alias("next"))
    k = F.col("doc_id") % 3
    own = F.lpad((F.col("doc_id") + 1).cast("string"), 8, "0")
    raw = F.when(k == 0, F.coalesce("next", F.lit("none/none.md"))).when(k == 1, "#").otherwise(F.concat(F.lit("./"), own, F.lit(".md")))
    rows = n.join(after, "doc_id", "left").select(F.col("doc").alias("source"), raw.alias("raw"))
    return entities.resolve_links(rows, entities.dictionary(corpora.link_names(n)), n.select("doc", "path")).select("source", "target", "status")


@query(sql("names", "keys", "notes", then="SELECT n.doc AS input_doc, CASE WHEN n.doc_id % 3 = 0 THEN 'resolved' WHEN n.doc_id % 3 = 1 THEN coalesce(k.status, 'missing') ELSE 'missing' END AS status, CASE WHEN n.doc_id % 3 = 0 THEN n.doc WHEN n.doc_id % 3 = 1 AND k.status = 'resolved' THEN k.target END AS doc FROM notes n LEFT JOIN names m ON m.doc = n.doc LEFT JOIN keys k ON k.name_key = m.name"))
def inputs_resolved(spark, d):
    """What a user types: an id in quotes, a name, and one that nothing has."""
    n = corpora.notes(spark, d)
    names = corpora.note_names(n)
    typed = n.join(names.select("doc", "name"), "doc", "left").select("doc", "doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), "doc", F.lit('"'))).when(F.col("doc_id") % 3 == 1, F.coalesce("name", F.lit("?"))).otherwise(F.concat(F.lit("no such note "), "doc")).alias("input"))
    found = upkeep.resolve_inputs(typed.select("input").distinct(), n.select("doc"), entities.dictionary(names))
    return typed.select(F.col("doc").alias("input_doc"), "input").join(found, "input").select("input_doc", "status", "doc")


# -- upkeep of derived data -----------------------------------------------------


def _redone(n):
    documents = n.select("doc", F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1).cast("long").alias("revision"))
    return documents, upkeep.rebuild_scope(documents, n.where("doc_id % 7 <> 0").select("doc", "revision"), True)


@query(sql("notes", then="SELECT doc FROM notes WHERE doc_id % 5 = 0 OR doc_id % 7 = 0"))
def rebuild_scope(spark, d):
    return _redone(corpora.notes(spark, d))[1]


@query(sql("links", "notes", then="SELECT source, raw, target FROM links JOIN notes ON doc = source WHERE doc_id % 5 <> 0 AND doc_id % 7 <> 0"))
def references_reused(spark, d):
    n = corpora.notes(spark, d)
    documents, redone = _redone(n)
    return upkeep.reused_references(_links(n), documents, redone).select("source", "raw", "target")


@query(sql("notes", then="SELECT space, doc, CASE WHEN doc_id % 3 = 0 THEN 'pending' ELSE 'ready' END AS status FROM (SELECT *, unnest(['one', 'two']) AS space FROM notes WHERE doc_id % 11 <> 0)"))
def vectors_invalidated(spark, d):
    n = corpora.notes(spark, d)
    states = n.select(F.explode(F.array(F.lit("one"), F.lit("two"))).alias("space"), "doc", "revision", F.lit("ready").alias("status"))
    live = n.where("doc_id % 11 <> 0").select("doc", F.when(F.col("doc_id") % 3 == 0, 2).otherwise(1).cast("long").alias("revision"))
    return upkeep.invalidate_vectors(states, live).select("space", "doc", "status")


@query(sql("units", "notes", then="SELECT space, unit FROM (SELECT *, unnest(['one', 'two']) AS space FROM units) JOIN notes USING (doc) WHERE doc_id % 3 <> 0"))
def vectors_purged(spark, d):
    records = corpora.units(spark, d).select(F.explode(F.array(F.lit("one"), F.lit("two"))).alias("space"), "unit", "doc")
    return upkeep.purge_vectors(records, corpora.notes(spark, d).where("doc_id % 3 <> 0")).select("space", "unit")


@query(sql("units", then="SELECT doc, CASE WHEN count(*) FILTER (WHERE CAST(unit AS INTEGER) % 7 = 0) > 0 THEN 'pending' ELSE 'ready' END AS status, count(*) FILTER (WHERE CAST(unit AS INTEGER) % 7 <> 0) AS ready FROM units GROUP BY doc"))
def bad_vectors_dropped(spark, d):
    u = corpora.units(spark, d).withColumn("space", F.lit("one"))
    cut = u.withColumn("vector", F.when(F.col("unit").cast("int") % 7 == 0, F.slice("vector", 1, 10)).otherwise(F.col("vector")))
    states = u.groupBy("space", "doc").agg(F.lit("ready").alias("status"), F.count("*").alias("ready"))
    return upkeep.drop_bad_vectors(cut, states, 64)[1].select("doc", "status", "ready")


@query(sql("notes", then=f"SELECT doc, path, CASE WHEN {_KEPT} THEN 'live' ELSE 'archive' END AS place FROM notes"))
def scope_change(spark, d):
    """New rules: live notes they leave out are archived, and archived ones they keep come back."""
    n = corpora.notes(spark, d)
    live, archive = upkeep.change_scope(n.where("doc_id % 4 <> 0"), n.where("doc_id % 4 = 0"), vault.kept_by(F.col("path"), RULES))
    return live.select("doc", "path", F.lit("live").alias("place")).unionByName(archive.select("doc", "path", F.lit("archive").alias("place")))


@query(sql("units", then="SELECT doc AS signal, count(*) FILTER (WHERE CAST(unit AS INTEGER) % 6 = 0) = 0 AS valid FROM units GROUP BY doc"))
def semantic_signals_valid(spark, d):
    u = corpora.units(spark, d).select("doc", "unit", F.sha2("unit", 256).alias("content_hash"))
    seen = u.select(F.col("doc").alias("signal"), F.lit("one").alias("space"), "unit", F.when(F.col("unit").cast("int") % 6 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"))
    return vectors.signals_valid(seen, u, "one")


@query(sql("units", then="SELECT CASE WHEN count(DISTINCT unit) FILTER (WHERE CAST(doc AS INTEGER) % 3 <> 0) > 0 THEN 'ready' ELSE 'stale' END AS status, count(DISTINCT unit) FILTER (WHERE CAST(doc AS INTEGER) % 3 <> 0) AS ready_units, count(DISTINCT unit) AS total_units FROM units"))
def coverage_frozen(spark, d):
    return upkeep.frozen_coverage(corpora.units(spark, d).select((F.col("doc").cast("int") % 3 != 0).alias("valid"), "unit"))


@query(sql("notes", then="SELECT a.doc AS node_a, b.doc AS node_b, CASE WHEN b.doc IS NULL OR a.doc_id % 4 = 0 OR b.doc_id % 4 = 0 THEN 'pending' WHEN a.doc_id % 4 = 1 OR b.doc_id % 4 = 1 THEN 'stale' WHEN a.doc_id % 4 = 2 OR b.doc_id % 4 = 2 THEN 'error' ELSE 'not-recalled' END AS state FROM notes a JOIN notes b ON b.doc_id = a.doc_id * 7 + 3"))
def semantic_pair_states(spark, d):
    n = corpora.notes(spark, d)
    k = F.col("doc_id") % 4
    indexed = n.where(k != 0).select("doc", F.when(k == 1, 0).otherwise(1).cast("long").alias("revision"), F.when(k == 2, "error").otherwise("ready").alias("status"), F.lit(1).alias("units"), F.lit(1).alias("ready"))
    status = vectors.document_status(n.select("doc", "revision"), indexed)
    met = n.select(F.col("doc").alias("node_a"), corpora.padded(F.col("doc_id") * 7 + 3).alias("node_b")).join(n.select(F.col("doc").alias("node_b")), "node_b", "left_semi")
    return vectors.pair_state(met, status, "one").select("node_a", "node_b", "state")


@query(sql("units", then="SELECT kind, count(*) AS pairs FROM (SELECT CASE CAST(a.unit AS INTEGER) % 3 = 0 WHEN true THEN CASE WHEN CAST(b.unit AS INTEGER) % 3 = 0 THEN 'image-image' ELSE 'text-image' END ELSE CASE WHEN CAST(b.unit AS INTEGER) % 3 = 0 THEN 'text-image' ELSE 'text-text' END END AS kind FROM units a JOIN units b ON a.doc = b.doc AND a.unit < b.unit) GROUP BY kind"))
def unit_modalities(spark, d):
    """The modality of each two units of a document, every third unit being an image's context."""
    u = corpora.units(spark, d).select("doc", "unit", F.when(F.col("unit").cast("int") % 3 == 0, "image-context").otherwise("text").alias("kind"))
    two = u.join(u.select("doc", F.col("unit").alias("other"), F.col("kind").alias("_kind")), "doc").where("unit < other")
    return two.groupBy(vectors.modality(F.col("kind"), F.col("_kind")).alias("kind")).agg(F.count("*").alias("pairs"))


# -- relations, snapshots and evidence ------------------------------------------


@query(sql("marks", then="SELECT node_a, node_b, hidden, pinned, note FROM (SELECT node_a, node_b, CASE WHEN CAST(right(node_a, 1) AS INTEGER) % 2 = 0 THEN NOT hidden ELSE hidden END AS hidden, pinned, CASE WHEN CAST(right(node_b, 1) AS INTEGER) = 1 THEN 'seen' END AS note FROM marks) WHERE hidden OR pinned OR note IS NOT NULL"))
def overrides_merged(spark, d):
    """Stored flags, and changes given from the other end: hidden turns round for even first ends, a note for some."""
    hidden, pinned = _override_flags()
    r = _relations(corpora.notes(spark, d)).select("node_a", "node_b", hidden.alias("hidden"), (pinned & ~hidden).alias("pinned"))
    even, seen = F.right("node_a", F.lit(1)).cast("int") % 2 == 0, F.right("node_b", F.lit(1)) == "1"
    changes = r.select(F.col("node_b").alias("node_a"), F.col("node_a").alias("node_b"), F.when(even, ~F.col("hidden")).alias("hidden"), F.lit(None).cast("boolean").alias("pinned"), F.when(seen, "seen").alias("note"))
    return relations.merge_overrides(r.where("hidden or pinned").withColumn("note", F.lit(None).cast("string")), changes).select("node_a", "node_b", F.coalesce("hidden", F.lit(False)).alias("hidden"), F.coalesce("pinned", F.lit(False)).alias("pinned"), "note")


@query(sql("mapped", then="SELECT center, neighbor, round(CASE WHEN high = low THEN 1 ELSE least(1, greatest(0, (score - low) / (high - low))) END, 9) AS local FROM mapped WHERE NOT hidden"))
def local_scores(spark, d):
    c = _centered(corpora.notes(spark, d)).where(~F.col("hidden"))
    return c.join(explore.lens_mapping(c), "center").select("center", "neighbor", F.round(explore.local_score(F.col("score"), F.col("low"), F.col("high")), 9).alias("local"))


@query(sql("marks", then="SELECT node_a, node_b, CAST(node_a AS INTEGER) % 5 <> 0 AND CAST(node_b AS INTEGER) % 5 <> 0 AND CAST(node_a AS INTEGER) % 7 <> 0 AND CAST(node_b AS INTEGER) % 7 <> 0 AS valid FROM marks"))
def frozen_still_valid(spark, d):
    """Frozen relations against live documents, of which some have another epoch and some are gone."""
    n = corpora.notes(spark, d)
    frozen = _relations(n).select("node_a", "node_b", F.lit(1).alias("epoch_a"), F.lit(1).alias("epoch_b"))
    live = n.where("doc_id % 7 <> 0").select("doc", F.when(F.col("doc_id") % 5 == 0, 2).otherwise(1).alias("epoch"))
    return explore.still_valid(frozen, live).select("node_a", "node_b", "valid")


@query(sql("mapped", then="SELECT center AS focus, CAST(count(*) AS BIGINT) AS budget, low, high FROM mapped GROUP BY center, low, high"))
def snapshot_headers(spark, d):
    n = corpora.notes(spark, d)
    live = n.select("doc", "revision", F.lit(1).alias("epoch"))
    return explore.freeze(_centered(n), n.select("doc"), live, 50, None, 7, 3, "v1")["snapshots"].select("focus", "budget", "low", "high")


@query(sql("centered", then="SELECT node_a, node_b, max(score) AS score, node_a <> '00000003' AND node_b <> '00000003' AS muted FROM centered WHERE NOT hidden GROUP BY node_a, node_b"))
def hover_muted(spark, d):
    return upkeep.hover(relations.global_edges(_centered(corpora.notes(spark, d))), "00000003")


@query(sql("centered", then="SELECT DISTINCT neighbor AS node FROM centered WHERE NOT hidden AND center = '00000003' UNION SELECT '00000003'"))
def hover_neighborhood(spark, d):
    return upkeep.hover_nodes(relations.global_edges(_centered(corpora.notes(spark, d))), "00000003")


@query(sql("centered", then="SELECT center, neighbor, rank FROM (SELECT center, neighbor, row_number() OVER (PARTITION BY center ORDER BY score DESC, neighbor) AS rank FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY center, pinned, passes ORDER BY score DESC, neighbor) AS r FROM (SELECT c.*, score >= round(high - (high - low) * 50 / 100, 12) OR pinned AS passes FROM centered c JOIN (SELECT center, min(score) AS low, max(score) AS high FROM centered WHERE NOT hidden GROUP BY center) USING (center) WHERE NOT hidden)) WHERE NOT (passes AND (pinned OR r <= 2)))) WHERE rank <= 3"))
def beyond_scope(spark, d):
    """The first three relations of each center that lens 50 and a budget of two leave out."""
    return panels.beyond(_centered(corpora.notes(spark, d)), 50, 2, 3).select("center", "neighbor", F.col("rank").cast("long").alias("rank"))


@query(sql("notes", then=f", {_MD} SELECT doc, length(a || b || c) AS start, doc || ':section:[\"' || substring(a, 3, length(a) - 4) || '\",\"Links\"]:0' AS section FROM md"))
def deepest_section(spark, d):
    parsed = parse.parse_notes(_md_notes(corpora.notes(spark, d)), ("sections", "links"))
    places = parse.child(parsed, "links").select("doc", F.col("start").cast("long").alias("start"), (F.col("start") + 1).alias("end"))
    sections = parse.child(parsed, "sections").select("doc", "section", F.col("start").alias("s"), F.col("end").alias("e"), "depth")
    return upkeep.deepest_sections(places, sections).select("doc", "start", "section")


def _locators(n):
    return _mentions(n).where("status = 'resolved'").select(
        F.concat_ws("-", F.least("source", "target"), F.greatest("source", "target")).alias("relation"), F.col("source").alias("doc"), F.lit(1).cast("long").alias("revision"), F.col("section").cast("string").alias("section"), F.col("place").cast("long").alias("start"), (F.col("place") + 1).cast("long").alias("end")
    )


_PLACES = "SELECT least(source, target) || '-' || greatest(source, target) AS relation, source AS doc, CAST(section AS VARCHAR) AS section, CAST(place AS BIGINT) AS start FROM mentions WHERE status = 'resolved'"


@query(sql("mentions", then=f"SELECT DISTINCT relation, doc, section, start FROM ({_PLACES})"))
def evidence_distinct(spark, d):
    """Each place once, though two signals name it."""
    places = _locators(corpora.notes(spark, d))
    return upkeep.distinct_locators(places.unionByName(places)).select("relation", "doc", "section", "start")


@query(sql("mentions", then=f"SELECT relation, doc, section, start FROM ({_PLACES}) WHERE CAST(doc AS INTEGER) % 3 <> 0 AND start % 2 = 0"))
def evidence_allowed(spark, d):
    n = corpora.notes(spark, d)
    places = _locators(n)
    return upkeep.allowed(places, n.where("doc_id % 3 <> 0"), places.where("start % 2 = 0")).select("relation", "doc", "section", "start")


_IMAGED = "md AS (SELECT doc, doc_id, 'n' || CAST(doc_id AS VARCHAR) AS name, '# n' || CAST(doc_id AS VARCHAR) || chr(10) || chr(10) || markdown || chr(10) || chr(10) AS a, '![alt ' || CAST(doc_id % 9 AS VARCHAR) || '](p' || CAST(doc_id % 7 AS VARCHAR) || '.png)' AS i, ' of n' || CAST(doc_id AS VARCHAR) || '. ' || repeat('tail ', 20 + CAST(doc_id % 60 AS INTEGER)) AS t FROM notes)"


@query(
    sql(
        "notes",
        then=f""", {_IMAGED},
tried AS (SELECT *, greatest(0, length(a) - w) AS s, least(length(a || i || t), length(a || i) + w) AS e FROM (SELECT *, CASE WHEN k = 9 THEN 0 ELSE 400 >> k END AS w FROM md, range(10) r(k))),
sized AS (SELECT *, octet_length(encode(name || chr(10) || chr(10) || substring(a, s + 1) || 'alt ' || CAST(doc_id % 9 AS VARCHAR) || substring(t, 1, e - length(a || i)))) + 32 AS tokens FROM tried),
best AS (SELECT doc, max(w) AS w FROM sized WHERE tokens <= 512 AND doc_id % 7 <> 5 GROUP BY doc)
SELECT md.doc, 'p' || CAST(doc_id % 7 AS VARCHAR) || '.png' AS source, CASE WHEN b.w IS NULL THEN length(a) ELSE z.s END AS start, CASE WHEN b.w IS NULL THEN length(a || i) ELSE z.e END AS end_, CASE WHEN b.w IS NULL THEN 0 ELSE z.tokens END AS tokens, CASE WHEN doc_id % 7 = 5 THEN 'MEDIA' WHEN b.w IS NULL THEN 'LIMIT' END AS code
FROM md LEFT JOIN best b ON b.doc = md.doc LEFT JOIN (SELECT doc, w, any_value(s) AS s, any_value(e) AS e, any_value(tokens) AS tokens FROM sized GROUP BY doc, w) z ON z.doc = b.doc AND z.w = b.w""",
    )
)
def image_context_units(spark, d):
    """The widest window of text around each note's image, under a budget in bytes; every seventh image is not found."""
    n = corpora.notes(spark, d)
    k = F.col("doc_id").cast("string")
    alt, source = (F.col("doc_id") % 9).cast("string"), F.concat(F.lit("p"), (F.col("doc_id") % 7).cast("string"), F.lit(".png"))
    image = F.concat(F.lit("![alt "), alt, F.lit("]("), source, F.lit(")"))
    tail = F.concat(F.lit(" of n"), k, F.lit(". "), F.repeat(F.lit("tail "), (20 + F.col("doc_id") % 60).cast("int")))
    notes = n.select("doc", "doc_id", "path", F.concat(F.lit("# n"), k, F.lit("\n\n"), "markdown", F.lit("\n\n"), image, tail).alias("markdown"))
    images = n.where("doc_id % 7 <> 5").select("doc", source.alias("source"), F.sha2(source, 256).alias("hash"), F.lit("image/png").alias("mime"))
    got = chunks.image_units(parse.parse_notes(notes, ("title", "sections", "media")), notes, images, Chunking(max_tokens=512, image_context=400))
    return got.select("doc", "source", "start", F.col("end").alias("end_"), "tokens", "code")


_POOLED = ("pool", "gaps", "middle", "spread", "diag", "cuts", "decided", "hybrid")


def _of_bundle(name: str) -> str:
    """A named expression over the bundle's pool instead of the table's."""
    text = corpora.SQL[name]
    for n in _POOLED:
        text = re.sub(rf"(?<=\bFROM )(\(SELECT \* FROM )?{n}\b|(?<=\bJOIN ){n}\b|^{n}\b", lambda m, n=n: m[0][: len(m[0]) - len(n)] + n + "2", text)
    return text


@query(
    sql(
        "pool", "centered",
        then=f""", signals AS (SELECT least(center, neighbor) AS a, greatest(center, neighbor) AS b, max(similarity) AS s FROM pool JOIN notes x ON x.doc = center JOIN notes y ON y.doc = neighbor WHERE length(x.markdown) >= 200 AND length(y.markdown) >= 200 GROUP BY ALL),
pool2 AS (SELECT center, neighbor, similarity, rank, pool_size FROM (SELECT *, row_number() OVER (PARTITION BY center ORDER BY similarity DESC, neighbor) AS rank, count(*) OVER (PARTITION BY center) AS pool_size FROM (SELECT a AS center, b AS neighbor, s AS similarity FROM signals UNION ALL SELECT b, a, s FROM signals)) WHERE rank <= 100),
{", ".join(_of_bundle(n) for n in _POOLED[1:])}
SELECT center, neighbor, round(greatest(m, s) + CAST(0.3 AS DOUBLE) * e * (1 - greatest(m, s)), 9) AS score FROM hybrid2""",
    )
)
def bundle_relations(spark, d):
    """Relations of a bundle read back: signals whose evidence, the first 200 characters of both notes, does not fit a text do not count."""
    n = corpora.notes(spark, d)
    span = lambda c: F.struct(F.col(c).alias("doc"), F.lit("root").alias("section"), F.lit(0).cast("long").alias("start"), F.lit(200).cast("long").alias("end"))
    signals = _pool(spark, d).select(F.concat_ws(":", "center", "neighbor").alias("id"), F.col("center").alias("doc_a"), F.col("neighbor").alias("doc_b"), "similarity", F.array(span("center"), span("neighbor")).alias("evidence"))
    fitting = signals.join(bundle.evidence_faults(signals, n), "id", "left_anti")
    return bundle.neighborhoods(bundle.pools(fitting, POOL), _centered(n), POOL, FLOOR).select("center", "neighbor", F.round("score", 9).alias("score"))


@query(sql("notes", then="SELECT path, parent, depth, folder, row_number() OVER (PARTITION BY parent ORDER BY folder DESC, regexp_replace(name, '[0-9]+', ''), CAST(coalesce(nullif(regexp_extract(name, '[0-9]+'), ''), '0') AS BIGINT)) AS place, count(*) OVER (PARTITION BY parent) AS siblings FROM (SELECT path, parent, depth, folder, split_part(path, '/', -1) AS name FROM (SELECT DISTINCT split_part(path, '/', 1) AS path, '' AS parent, 1 AS depth, true AS folder FROM notes UNION ALL SELECT split_part(path, '/', 1) || '/n' || CAST(doc_id AS VARCHAR) || '.md', split_part(path, '/', 1), 2, false FROM notes))"))
def path_tree_numeric(spark, d):
    """The tree of notes named by their numbers, in the order that a file tree shows: n2 before n10, src2 before src10."""
    n = corpora.notes(spark, d)
    named = n.select(F.concat(F.substring_index("path", "/", 1), F.lit("/n"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"))
    return panels.tree_order(panels.path_tree(named))
