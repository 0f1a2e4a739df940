"""Exploration: frozen snapshots of centers, thresholds, visibility, evidence, layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keep import kept
from ..functions.policy import CROSS_DEFAULT_LENS, EXCERPT
from ..functions.text import round12


def lens_mapping(centered: DataFrame) -> DataFrame:
    """(center, low, high): the range of scores that are not hidden; centers without any map 0..1."""
    shown = F.when(~F.col("hidden"), F.col("score"))
    return centered.groupBy("center").agg(F.coalesce(F.min(shown), F.lit(0.0)).alias("low"), F.coalesce(F.max(shown), F.lit(1.0)).alias("high"))


def threshold(lens: Column, low: Column, high: Column) -> Column:
    return round12(high - (high - low) * lens / 100)


def local_score(score: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (score - low) / (high - low))))


def revealing_lens(score: Column, low: Column, high: Column, lens: Column) -> Column:
    """The smallest whole lens at or over the given one that lets a score pass."""
    return F.greatest(lens, F.least(F.lit(100), F.ceil((1 - local_score(score, low, high)) * 100)))


def visible(centered: DataFrame, lens: Column | int = CROSS_DEFAULT_LENS, budget: int | None = None) -> DataFrame:
    """The visible relations of every center: all pinned ones, and the first ``budget`` others over the threshold.

    centered: center, neighbor, score, hidden, pinned, node_a, node_b. Adds threshold and rank.
    Mapping and ranks share one partitioning by center.
    """
    w = W.partitionBy("center")
    shown = F.when(~F.col("hidden"), F.col("score"))
    lens = F.lit(lens) if isinstance(lens, int) else lens
    rows = centered.withColumn("low", F.coalesce(F.min(shown).over(w), F.lit(0.0))).withColumn("high", F.coalesce(F.max(shown).over(w), F.lit(1.0)))
    rows = rows.withColumn("threshold", threshold(lens, F.col("low"), F.col("high")))
    rows = rows.where(~F.col("hidden") & ((F.col("score") >= F.col("threshold")) | F.col("pinned")))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("center", "pinned").orderBy(F.desc("score"), "neighbor")))
    return rows if budget is None else rows.where(F.col("pinned") | (F.col("rank") <= budget))


def counters(centered: DataFrame, lens: int, budget: int) -> DataFrame:
    """(center, eligible, visible, remaining, pinned) at a lens and a budget."""
    eligible = visible(centered, lens)
    own = F.count_if(~F.col("pinned"))
    return eligible.groupBy("center").agg(F.count("*").alias("eligible"), (F.least(own, F.lit(budget)) + F.count_if("pinned")).alias("visible"), (own - F.least(own, F.lit(budget))).alias("remaining"), F.count_if("pinned").alias("pinned"))


def lens_grid(centered: DataFrame, grid: tuple[int, ...] = (0, 25, 50, 75, 100)) -> DataFrame:
    """(lens, eligible): relations over the threshold at each lens, of all centers."""
    mapped = centered.join(lens_mapping(centered), "center").where(~F.col("hidden"))
    flat = mapped.withColumn("lens", F.explode(F.array(*map(F.lit, grid))))
    passes = (F.col("score") >= threshold(F.col("lens"), F.col("low"), F.col("high"))) | F.col("pinned")
    return flat.groupBy("lens").agg(F.count_if(passes).alias("eligible"))


def cross_relations(centered: DataFrame, focuses: DataFrame) -> DataFrame:
    """(focus, node_a, node_b, score): relations among the neighbors of each focus, confirmed from both ends, with the lower score.

    A relation's ends come from its own centers; hidden ones count for neither side. A row is a
    triangle, seen from one corner. Each pair points from its end of fewer pairs, so a note points
    to no more than the root of twice the pairs, and a hub's neighbors are not paired; two pairs
    from one note meet the pair of their ends, which finds each triangle once, for all its corners.
    """
    shown = centered.where(~F.col("hidden")).join(focuses.select(F.col("doc").alias("center"), F.lit(True).alias("_f")).distinct(), "center", "left")
    lists = lambda c: F.max((F.col("center") == F.col(c)) & F.coalesce("_f", F.lit(False)))
    pairs = kept(shown.groupBy("node_a", "node_b").agg(F.when(F.countDistinct("center") == 2, F.min("score")).alias("score"), lists("node_a").alias("_la"), lists("node_b").alias("_lb")))
    ends = F.explode(F.array(F.struct(F.col("node_a").alias("u"), F.col("node_b").alias("n"), F.col("_la").alias("ls"), F.col("_lb").alias("le"), "score"), F.struct(F.col("node_b").alias("u"), F.col("node_a").alias("n"), F.col("_lb").alias("ls"), F.col("_la").alias("le"), "score")))
    both = pairs.select(ends.alias("_e")).select("_e.*")
    degree = both.groupBy("u").agg(F.count("*").alias("d"))
    sized = both.join(degree, "u").join(degree.toDF("n", "_dn"), "n")
    out = sized.where((F.col("d") < F.col("_dn")) | ((F.col("d") == F.col("_dn")) & (F.col("u") < F.col("n")))).select("u", "n", "ls", "le", "score")
    named = lambda k: out.select("u", *(F.col(c).alias(f"{c}_{k}") for c in ("n", "ls", "le", "score")))
    wedges = named("a").join(named("b"), "u").where("n_a < n_b and (ls_a and ls_b or le_a or le_b)")
    met = wedges.withColumnsRenamed({"n_a": "node_a", "n_b": "node_b"}).join(pairs, ["node_a", "node_b"])
    seen = lambda focus, a, b, listed, score: F.when(listed & score.isNotNull(), F.struct(focus.alias("focus"), F.least(a, b).alias("node_a"), F.greatest(a, b).alias("node_b"), score.alias("score")))
    u, a, b = F.col("u"), F.col("node_a"), F.col("node_b")
    corners = F.array(
        seen(u, a, b, F.col("ls_a") & F.col("ls_b"), F.col("score")), seen(a, u, b, F.col("le_a") & F.col("_la"), F.col("score_b")), seen(b, u, a, F.col("le_b") & F.col("_lb"), F.col("score_a"))
    )
    return met.select(F.explode(F.array_compact(corners)).alias("_x")).select("_x.*")


def snapshot_status(headers: DataFrame, live: DataFrame, index_revision: int, policy_revision: int, score_version: str | None = None, space: str | None = None, relations: DataFrame | None = None) -> DataFrame:
    """(snapshot, status, reasons, invalidated): invalid if the focus is gone or changed, stale with the reasons, else current.

    headers: snapshot, focus, focus_revision, index_revision, policy_revision, and perhaps
    score_version (compared if the live one is given) and embedding_space (null: none); live: doc,
    revision. relations: snapshot, valid (see still_valid) of the frozen relations; one that is
    no longer valid makes its snapshot stale, and of an invalid snapshot all count as invalidated.
    """
    joined = headers.join(live.select(F.col("doc").alias("focus"), F.col("revision").alias("_live")), "focus", "left")
    if relations is None:
        joined = joined.withColumns({"_all": F.lit(0).cast("long"), "_bad": F.lit(0).cast("long")})
    else:
        counted = relations.groupBy("snapshot").agg(F.count("*").alias("_all"), F.count_if(~F.col("valid")).alias("_bad"))
        joined = joined.join(counted, "snapshot", "left").na.fill(0, ["_all", "_bad"])
    known = {"score_version": score_version is not None, "embedding_space": True}
    differs = lambda column, value: ~F.col(column).eqNullSafe(F.lit(value)) if known[column] and column in headers.columns else F.lit(False)
    gone = F.col("_live").isNull() | (F.col("_live") != F.col("focus_revision"))
    stale = F.array_compact(
        F.array(
            F.when(F.col("index_revision") != index_revision, "index-revision-changed"),
            F.when(differs("score_version", score_version), "score-policy-changed"),
            F.when(differs("embedding_space", space), "embedding-space-changed"),
            F.when(F.col("policy_revision") != policy_revision, "user-declarations-changed"),
            F.when(F.col("_bad") > 0, "candidate-evidence-invalidated"),
        )
    )
    reasons = F.when(gone, F.array(F.when(F.col("_live").isNull(), "focus-removed").otherwise("focus-revision-changed"))).otherwise(stale)
    status = F.when(gone, "invalid").when(F.size(stale) > 0, "stale").otherwise("current")
    return joined.select("snapshot", status.alias("status"), F.array_join(reasons, ",").alias("reasons"), F.when(gone, F.col("_all")).otherwise(F.col("_bad")).alias("invalidated"))


def still_valid(relations: DataFrame, live: DataFrame) -> DataFrame:
    """relations (node_a, node_b, epoch_a, epoch_b) with valid: both ends exist at their frozen epochs."""
    a, b = live.select(F.col("doc").alias("node_a"), F.col("epoch").alias("_a")), live.select(F.col("doc").alias("node_b"), F.col("epoch").alias("_b"))
    joined = relations.join(a, "node_a", "left").join(b, "node_b", "left")
    return joined.withColumn("valid", F.coalesce((F.col("_a") == F.col("epoch_a")) & (F.col("_b") == F.col("epoch_b")), F.lit(False))).drop("_a", "_b")


def read_evidence(locators: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """locators (doc, revision, section, start, end) with status, text and excerpt.

    missing: no such document; stale: another revision; invalid: outside the section; else valid.
    documents: doc, revision, markdown; sections: doc, section, s, e. Offsets in characters.
    """
    d = documents.select("doc", F.col("revision").alias("_r"), "markdown")
    rows = locators.join(d, "doc", "left").join(sections.select("doc", "section", "s", "e"), ["doc", "section"], "left")
    inside = (F.col("s") <= F.col("start")) & (F.col("e") >= F.col("end")) & (F.col("start") < F.col("end"))
    status = F.when(F.col("_r").isNull(), "missing").when(F.col("_r") != F.col("revision"), "stale").when(~F.coalesce(inside, F.lit(False)), "invalid").otherwise("valid")
    ok = status == "valid"
    first = F.greatest(F.col("start") - EXCERPT, F.lit(0))
    return rows.select(
        *locators.columns, status.alias("status"), F.when(ok, F.substring("markdown", F.col("start") + 1, F.col("end") - F.col("start"))).alias("text"), F.when(ok, F.substring("markdown", first + 1, F.col("end") + EXCERPT - first)).alias("excerpt")
    )


def ring_layout(visible_: DataFrame) -> DataFrame:
    """(center, neighbor, ring, x, y) by rank: ring r holds 6 + 6r places at radius 195 + 160r."""
    k = F.col("rank") - 1
    # Rings 0..r-1 hold 3r(r+1) places.
    ring = F.floor((F.sqrt(9 + 12 * k.cast("double")) - 3) / 6).cast("int")
    rows = visible_.withColumn("ring", ring).withColumn("_i", k - 3 * F.col("ring") * (F.col("ring") + 1))
    angle = 2 * F.pi() * F.col("_i") / (6 + 6 * F.col("ring"))
    radius = 195.0 + 160.0 * F.col("ring")
    return rows.select("center", "neighbor", "ring", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"))


SCHEMA_VERSION = 2


def freeze(centered: DataFrame, focuses: DataFrame, live: DataFrame, lens: int, budget: int | None, index_revision: int, policy_revision: int, score_version: str) -> dict[str, DataFrame]:
    """The tables of the focuses' snapshots, to be committed to a store: headers, relations with the ends' epochs, cross relations.

    live: doc, revision, epoch. A snapshot's budget is all its candidates unless one is given.
    """
    if not 0 <= lens <= 100:
        raise ValueError("lens must be from 0 to 100")
    own = centered.join(focuses.select(F.col("doc").alias("center")), "center", "left_semi")
    at = lambda side: live.select(F.col("doc").alias(f"node_{side}"), F.col("epoch").alias(f"epoch_{side}"))
    kept = own.join(at("a"), "node_a", "left").join(at("b"), "node_b", "left")
    size = own.groupBy("center").agg(F.count("*").alias("n"))
    heads = lens_mapping(own).join(size, "center").join(live.select(F.col("doc").alias("center"), F.col("revision").alias("focus_revision")), "center")
    heads = heads.select(
        F.sha2(F.concat_ws("|", "center", F.lit(str(index_revision)), F.lit(score_version)), 256).alias("snapshot"), F.col("center").alias("focus"), "focus_revision", F.lit(index_revision).alias("index_revision"), F.lit(policy_revision).alias("policy_revision"),
        F.lit(score_version).alias("score_version"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(lens).alias("lens"), (F.greatest("n", F.lit(1)) if budget is None else F.lit(budget)).cast("long").alias("budget"), "low", "high",
    )
    return {"snapshots": heads, "snapshot_relations": kept, "snapshot_cross": cross_relations(centered, focuses)}


def snapshot_faults(headers: DataFrame, relations_: DataFrame, cross: DataFrame) -> DataFrame:
    """(focus, fault) of snapshots that break an invariant; empty when all are sound."""
    head = headers.where((F.col("schema_version") != SCHEMA_VERSION) | ~F.col("lens").between(0, 100) | (F.col("budget") < 1) | (F.col("low") > F.col("high"))).select("focus", F.lit("header").alias("fault"))
    score = relations_.where(F.isnan("score") | ~F.col("score").between(0, 1)).select(F.col("center").alias("focus"), F.lit("score").alias("fault"))
    foreign = relations_.where((F.col("center") != F.col("node_a")) & (F.col("center") != F.col("node_b"))).select(F.col("center").alias("focus"), F.lit("relation without its focus").alias("fault"))
    near = relations_.select(F.col("center").alias("focus"), F.col("neighbor").alias("_n")).distinct()
    ends = cross.select("focus", F.explode(F.array("node_a", "node_b")).alias("_n")).join(near, ["focus", "_n"], "left_anti").select("focus", F.lit("cross relation outside the neighborhood").alias("fault"))
    return head.unionByName(score).unionByName(foreign).unionByName(ends).distinct()
