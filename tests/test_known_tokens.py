"""Tokens that are no resolved name stay out of the shuffle; mentions are the same."""

from quillgraph.operators import entities, explore, mentions


def test_tokens_of_resolved_names_only(spark):
    lines = spark.createDataFrame([("a", 0, "Alpha beta été gamma " + " ".join(f"w{i}" for i in range(500))), ("b", 0, ""), ("b", 1, "beta, Été! 日本"), ("c", 0, None)], "doc string, section int, text string").repartition(3)
    names = entities.dictionary(spark.createDataFrame([("x", "beta", "filename"), ("y", "été", "filename"), ("y", "gamma", "filename"), ("z", "gamma", "filename")], "doc string, name string, source string"))
    found = entities.resolutions(names).where("status = 'resolved'")
    kept = mentions.known_tokens(lines, found)
    assert kept.count() < 20 and mentions.tokens(lines).count() == 507
    got = sorted(map(tuple, mentions.token_mentions(lines, names, resolved=True).collect()))
    assert got == sorted(map(tuple, mentions.token_mentions(lines, names).where("status = 'resolved'").collect())) and len(got) == 4


def test_a_hub_s_neighbors_are_not_paired(spark):
    """A star of 3,000 notes with one triangle: the step before the last makes few rows."""
    from pyspark.sql import functions as F

    star = spark.range(3000).select(F.lit("hub").alias("node_a"), F.format_string("n%05d", "id").alias("node_b"))
    pairs = star.unionByName(spark.createDataFrame([("n00001", "n00002")], "node_a string, node_b string")).withColumn("score", F.lit(0.5))
    ends = F.explode(F.array(F.struct(F.col("node_a").alias("center"), F.col("node_b").alias("neighbor")), F.struct(F.col("node_b").alias("center"), F.col("node_a").alias("neighbor"))))
    centered = pairs.withColumn("_e", ends).select("_e.*", "node_a", "node_b", "score", F.lit(False).alias("hidden"))
    docs = centered.select(F.col("center").alias("doc")).distinct()
    got = sorted(tuple(r) for r in explore.cross_relations(centered, docs).collect())
    assert got == [("hub", "n00001", "n00002", 0.5), ("n00001", "hub", "n00002", 0.5), ("n00002", "hub", "n00001", 0.5)]
    assert sorted(tuple(r) for r in explore.cross_relations(centered, docs.where("doc = 'n00002'")).collect()) == got[2:]
