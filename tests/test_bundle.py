"""A published bundle, out and in."""

import random

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.policy import BoundaryPolicy, Retrieval
from quillgraph.operators import bundle, entities, mentions, parse, relations
from quillgraph.operators.export import Leak

NOTE = "doc string, path string, markdown string"


def prepared(spark, rows):
    notes = spark.createDataFrame(rows, NOTE)
    parsed = parse.parse_notes(notes)
    return notes.join(parsed.select("doc", "title", "content_start", F.size("media").alias("media")), "doc"), parsed


def resolved(parsed, notes):
    names = parse.child(parsed, "names").select("doc", "name", "source")
    links = parse.child(parsed, "links").withColumn("raw", F.col("target"))
    met = entities.resolve_links(links.select(F.col("doc").alias("source"), "raw", "start", "end", "label"), entities.dictionary(names), notes.select("doc", "path"))
    heading = F.when(F.instr("raw", "#") > 0, F.substring_index("raw", "#", -1))
    return met.select(F.col("source").alias("doc"), "start", "end", F.col("target").alias("target_doc"), heading.alias("heading"), "label")


def test_slugs_are_plain_and_differ(spark):
    titles = ["Straße & Co", "strase co", "Über", "uber", "Uber!", "", "日本", None, "x" * 90, "note"] + ["same"] * 40
    rows = [(f"d{i}", t) for i, t in enumerate(titles)]
    got = {r.doc: r.slug for r in bundle.slugs(spark.createDataFrame(rows, "doc string, title string").repartition(4)).collect()}
    assert len(set(got.values())) == len(rows) and all(1 <= len(s) <= 80 and set(s) <= set("abcdefghijklmnopqrstuvwxyz0123456789-") and s[0] != "-" for s in got.values())
    assert got["d8"] == "x" * 60 and got["d2"].startswith("uber-") and got["d9"].startswith("note-")


def test_every_published_locator_reads_the_same_text(spark):
    rng = random.Random(5)
    rows = []
    for i in range(8):
        body = " ".join(rng.choice(["wörd", f"[[N{(i + 1) % 8}]]", f"[[N{(i + 3) % 8}#Sub|see it]]", "text\n", "😀"]) for _ in range(40))
        rows.append((f"id{i}", f"secret/N{i}.md", f"---\ntitle: T{i}\nx: secret\n---\n# Head {i}\n\n{body}\n\n## Sub\n\nmore words {body}\n"))
    notes, parsed = prepared(spark, rows)
    chosen = bundle.slugs(notes.select("doc", "title"))
    changes = bundle.link_changes(resolved(parsed, notes), chosen)
    out = bundle.rewritten(notes, chosen, changes).cache()
    texts = {r.slug: r.markdown for r in out.collect()}
    slug = {r.doc: r.slug for r in chosen.collect()}
    assert "secret" not in str(texts) and "title:" not in str(texts) and "[[" in str(texts)
    source = {r[0]: r[2] for r in rows}
    locators = []
    for k in range(400):
        doc = f"id{rng.randrange(8)}"
        a = rng.randrange(len(source[doc]))
        locators.append((k, doc, "old", a, min(len(source[doc]), a + rng.randint(1, 9))))
    got = {r.n: r for r in bundle.remapped(spark.createDataFrame(locators, "n long, doc string, section string, start long, end long"), notes, chosen, changes, out).collect()}
    start = {r.doc: r.content_start for r in notes.collect()}
    links = {d: [(x["start"], x["end"]) for x in parse.parse(d, p, t).links] for d, p, t in rows}
    for n, doc, _, a, z in locators:
        whole = a >= start[doc] and not any(x < z and y > a for x, y in links[doc])
        assert (n in got) == whole
        if whole:
            r = got[n]
            assert texts[r.doc][r.start : r.end] == source[doc][a:z] and r.doc == slug[doc] and r.section.startswith(f"{r.doc}:")
    again = parse.parse(slug["id0"], "p.md", texts[slug["id0"]])
    assert {x["target"].split("#")[0] for x in again.links} <= set(slug.values()) and any("#Sub" in x["target"] for x in again.links)
    out.unpersist()


@pytest.mark.parametrize("body", ["HiddenLedger is mentioned.", "[[HiddenLedger]]", "[[Missing]]", "/home/someone/notes.md", "sk-ABCdef0987654321zyxwv", "![map](coast.png)", "<video src='p'>"])
def test_what_must_not_get_out(spark, body):
    notes, parsed = prepared(spark, [("a", "Alpha.md", f"# Alpha\n{body}\n"), ("p", "HiddenLedger.md", "# HiddenLedger\nSecret")])
    chosen = bundle.slugs(notes.where("doc = 'a'").select("doc", "title"))
    private = spark.createDataFrame([("hiddenledger",)], "k string")
    with pytest.raises(Leak):
        bundle.rewritten(notes, chosen, bundle.link_changes(resolved(parsed, notes), chosen), private).collect()


def published(spark):
    docs = spark.createDataFrame([("alpha", "alpha.md", "# Alpha\nTides follow the old moon.\n"), ("beta", "beta.md", "# Beta\nSails dry on the long wall.\n"), ("gamma", "gamma.md", "# Gamma\nThird.\n")], NOTE)
    e = lambda d, t, a, z: (d, f'{d}:section:["{t}"]:0', a, z)
    rows = [("s1", "alpha", "beta", 0.7, "sp", [e("alpha", "Alpha", 8, 20), e("beta", "Beta", 0, 9)]), ("s2", "beta", "alpha", 0.9, "sp", [e("beta", "Beta", 7, 20)]), ("s3", "alpha", "gamma", 0.8, "sp", [e("gamma", "Gamma", 0, 5)]), ("s4", "gamma", "beta", 0.75, "sp", [e("gamma", "Gamma", 0, 5)])]
    return docs, spark.createDataFrame(rows, "id string, doc_a string, doc_b string, similarity double, space string, evidence array<struct<doc: string, section: string, start: long, end: long>>")


def deterministic(spark, docs):
    parsed = parse.parse_notes(docs)
    names = entities.dictionary(parse.child(parsed, "names").select("doc", "name", "source"))
    met = mentions.dictionary_mentions(parse.child(parsed, "spans"), names).select(F.lit("mention").alias("kind"), F.col("doc").alias("source"), "section", "status", "target")
    links = resolved(parsed, docs).select(F.lit("explicit").alias("kind"), F.col("doc").alias("source"), F.lit("l").alias("section"), F.when(F.col("target_doc").isNotNull(), "resolved").otherwise("missing").alias("status"), F.col("target_doc").alias("target"))
    return relations.by_center(relations.candidates(met.unionByName(links)))


def test_reading_back_and_editing(spark):
    docs, signals = published(spark)
    assert bundle.load(docs, signals, "sp").count() == 4
    pool = bundle.pools(signals, Retrieval())
    assert {(r.center, r.neighbor): (r.similarity, r.rank) for r in pool.collect()}["alpha", "beta"] == (0.9, 1)
    loose = BoundaryPolicy(quality_floor=0.2)
    around = bundle.neighborhoods(pool, deterministic(spark, docs), limits=loose)
    assert {(r.center, r.neighbor) for r in around.collect()} == {(a, b) for a in ("alpha", "beta", "gamma") for b in ("alpha", "beta", "gamma") if a != b}
    met = bundle.cross(around.select("center", "neighbor", "node_a", "node_b", "score"), docs.select("doc")).collect()
    assert {(r.focus, r.node_a, r.node_b) for r in met} == {("alpha", "beta", "gamma"), ("beta", "alpha", "gamma"), ("gamma", "alpha", "beta")}
    edited = spark.createDataFrame([("alpha", "alpha.md", "# Alpha\nTides follow the old moon.\n\n[[Beta]]\n")], NOTE).unionByName(docs.where("doc <> 'alpha'"))
    left = bundle.still_valid(signals, docs, edited)
    assert {r.id for r in left.collect()} == {"s4"}
    now = {(r.center, r.neighbor): r for r in bundle.neighborhoods(bundle.pools(left), deterministic(spark, edited), limits=loose).collect()}
    assert now["alpha", "beta"].links == 1 and now["alpha", "beta"].semantic == 0 and ("alpha", "gamma") not in now


def test_the_score_of_the_later_listed_end(spark):
    rows = [("f", "a", "a", "f", 0.9), ("f", "b", "b", "f", 0.4), ("a", "f", "a", "f", 0.9), ("b", "f", "b", "f", 0.4), ("a", "b", "a", "b", 0.6), ("b", "a", "a", "b", 0.2), ("a", "c", "a", "c", 0.5)]
    centered = spark.createDataFrame(rows, "center string, neighbor string, node_a string, node_b string, score double")
    got = bundle.cross(centered, spark.createDataFrame([("f",)], "doc string")).collect()
    assert [tuple(r) for r in got] == [("f", "a", "b", 0.2)]


@pytest.mark.parametrize(("change", "reason"), [({"space": "other"}, "space"), ({"evidence": [("alpha", 'alpha:section:["Alpha"]:0', 5, 999)]}, "range"), ({"evidence": [("alpha", "alpha:root", 9, 9)]}, "range"), ({"evidence": [("nobody", "x", 0, 1)]}, "unknown document"), ({"evidence": [("alpha", "x", 0, 1)]}, "unknown section"), ({"evidence": []}, "no evidence")])
def test_a_bundle_is_taken_whole_or_not(spark, change, reason):
    docs, signals = published(spark)
    row = signals.where("id = 's1'").first().asDict() | change
    with pytest.raises(ValueError, match=reason):
        bundle.load(docs, signals.where("id <> 's1'").unionByName(spark.createDataFrame([tuple(row[c] for c in signals.columns)], signals.schema)), "sp")
