r"""Personal data by candidate gradient boosting, in DataFrame operations alone.

Base kinds are patterns with a check each; their spans always stay. Generators of high
recall propose further, overlapping candidates; boosted trees score each from its format
and its surroundings; a threshold per generator, calibrated on candidates kept from
training, selects what is added. Trees, cuts and thresholds rest on all candidates.

There are no labelled spans, so training is weakly supervised: a proposal counts as personal
if a word like ``token``, ``phone`` or ``mail`` introduces it, an address or number also if it
meets a base span. A generator of which all candidates have one label has no trees; it adds all
or none of them, by the smoothed share of label 1. Neither the words nor the marks by which the base patterns know their spans
(a number's + and country code, an address's ASCII letters and dotted domain) are features, so
the same forms are found without words and marks too.

Positions come from the pieces that a split leaves between the matches: no text is searched
from its start twice, and running sums over the matches of a text go in chunks, so that the
work of a row grows with its matches. No candidate is cut or bounded in length. Trees become
CASE expressions on the candidates of a row, so that scoring is a narrow step without join or
shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

ROUNDS, DEPTH = 8, 3
#: Cuts of a feature that trees may split at, at most; different examples of a task of the fit.
CUTS, EXAMPLES = 31, 20_000
#: Least share of positive labels among the calibration candidates over a threshold. What has neither word
#: nor mark is labelled 0 although it may be personal, and it is what a generator is to add, so shares are low.
PRECISION = {"address": 0.5, "number": 0.5, "secret": 0.75}
#: A threshold's least margin: over 0, a label of 1 is the likelier, so that clear cases do not carry doubtful ones.
LEAST = {"address": 0.0, "number": 0.0, "secret": float("-inf")}

#: Fixed patterns of the contract, in its order. Possessive parts and the start of a run keep the
#: search linear; they match as the plain patterns do. \G: right after the match before.
_RUN = "(?:\\G|(?<![{0}]))"
_LOCAL = "A-Za-z0-9._%+-"
BASE = {
    "email": _RUN.format(_LOCAL) + f"[{_LOCAL}]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": _RUN.format("0-9") + "[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: A cheap necessary sign of each.
_SIGN = {"email": "@", "ip": ".", "card": None, "phone": "+"}

#: Generators: what each proposes, and the kind it may add.
PROPOSED = {
    "address": _RUN.format("^\\s@<>\"") + "[^\\s@<>\"]++@[^\\s@<>\"]{3,}+",
    "number": "\\+?\\(?[0-9](?:[ ().-]{0,2}[0-9]){6,}+",
    "secret": "(?<![A-Za-z0-9_/+=-])[A-Za-z0-9_/+=-]{20,}+",
}
KINDS = ("email", "ip", "card", "phone", "secret")
_INTRODUCED = {
    "address": "(?i)(?:mail|contact|address|write to)(?: (?:is|me|us|at))?\\s*[:=]?\\s*[\"'(<]?$",
    "number": "(?i)(?:\\btel|phone|mobile|\\bcell|\\bfax|\\bcall|contact)(?:\\.|ephone)?(?: (?:is|no\\.?|number|me|us|at))?\\s*[:=]?\\s*[\"']?$",
    "secret": "(?i)(?:token|secret|passw(?:or)?d|api.?key|credential)[\"']?\\s*[:=]\\s*[\"']?$",
}
#: An address but for its marks, which is no example of text that is none.
_OPEN = "^[\\p{L}\\p{M}\\p{N}._%+-]+@[\\p{L}\\p{N}-]*\\p{L}[\\p{L}\\p{N}-]*(?:\\.[\\p{L}\\p{N}-]+)*[.,;:!?)]*$"
#: What is cut from a number before its features are taken: a +, a country code, an opening bracket.
_PREFIX = "^(?:\\+?[0-9]{1,3}[ .-]{0,2}(?=\\()|\\+[0-9]{1,3}[ .-]{1,2}(?=[0-9])|\\+)?\\(?"


#: Elements of an array that are folded, or searched, together.
CHUNK = 256


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _chunks(items: Column) -> Column:
    return _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.lit(0), F.size(x) - 1) / CHUNK).cast("int")), lambda c: F.slice(x, c * CHUNK + 1, CHUNK)))


def _running(items: Column, zero: Column, step, empty: str) -> Column:
    """The state after each item. The folds append to arrays of a chunk's length, not of all items."""
    none, nones = F.expr(f"CAST(array() AS array<{empty}>)"), F.expr(f"CAST(array() AS array<array<{empty}>>)")

    def inner(b: Column, x: Column) -> Column:
        return _let(step(b["state"], x), lambda s: F.struct(s.alias("state"), F.array_append(b["part"], s).alias("part")))

    def outer(a: Column, chunk: Column) -> Column:
        return _let(F.aggregate(chunk, F.struct(a["state"].alias("state"), none.alias("part")), inner), lambda r: F.struct(r["state"].alias("state"), F.array_append(a["out"], r["part"]).alias("out")))

    return F.aggregate(_chunks(items), F.struct(zero.alias("state"), nones.alias("out")), outer, lambda a: F.flatten(a["out"]))


def _matches(text: Column, pattern: str, around: int = 0) -> Column:
    """Matches with start and end in code points, and with ``around`` the text beside them."""

    def placed(x: Column) -> Column:
        pieces, found = x["pieces"], x["found"]
        gaps = F.slice(pieces, F.lit(1), F.size(found))
        ends = _running(F.zip_with(gaps, found, lambda p, m: F.length(p) + F.length(m)), F.lit(0), lambda s, n: s + n, "int")
        rows = F.zip_with(found, ends, lambda m, e: F.struct((e - F.length(m)).alias("s"), e.alias("e"), m.alias("m")))
        if not around:
            return rows
        beside = F.zip_with(gaps, F.slice(pieces, F.lit(2), F.size(found)), lambda a, b: F.struct(F.right(a, F.lit(around)).alias("before"), F.left(b, F.lit(1)).alias("after")))
        return F.zip_with(rows, beside, lambda r, b: F.struct(r["s"].alias("s"), r["e"].alias("e"), r["m"].alias("m"), b["before"].alias("before"), b["after"].alias("after")))

    return _let(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found")), placed)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?=.)"), value), F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_parts(m: Column) -> Column:
    return F.forall(F.split(m, "\\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})$"))


def _passes(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _small_parts(m)
    d = _digits(m)
    n = F.length(d)
    return n.between(16, 19) & luhn(d) if kind == "card" else n.between(8, 15)


_SPANS = "array<struct<s:int,e:int,m:string>>"


def _base(text: Column, kind: str) -> Column:
    found = F.filter(_matches(text, BASE[kind]), lambda x: _passes(kind, x["m"]))
    if kind == "card":
        return F.when(text.rlike("[0-9](?:[\\x20-]?[0-9]){15}"), found).otherwise(F.expr(f"CAST(array() AS {_SPANS})"))
    return F.when(text.contains(_SIGN[kind]), found).otherwise(F.expr(f"CAST(array() AS {_SPANS})"))


_CANDIDATES = "array<struct<s:int,e:int,m:string,before:string,after:string>>"


def _proposed(text: Column, name: str) -> Column:
    sign = {"address": text.contains("@"), "number": text.rlike("[0-9](?:[ ().-]{0,2}[0-9]){6}"), "secret": text.rlike("[A-Za-z0-9_/+=-]{20}")}[name]
    return F.when(sign, _matches(text, PROPOSED[name], 24)).otherwise(F.expr(f"CAST(array() AS {_CANDIDATES})"))


def _count(m: Column, keep: str) -> Column:
    return F.length(F.regexp_replace(m, f"[^{keep}]", "")).cast("double")


def _masked(name: str, m: Column) -> Column:
    """A candidate without the marks that the base patterns ask for."""
    if name == "number":
        return F.regexp_replace(m, _PREFIX, "")
    if name == "address":
        return F.regexp_replace(F.regexp_replace(m, "[\\p{L}\\p{M}&&[^A-Za-z]]", "a"), "(@[^.]*)\\..*$", "$1")
    return m


def _features(name: str, m: Column, before: Column, after: Column) -> list[Column]:
    """Format and surroundings of a candidate of a generator."""
    m = _masked(name, m)
    d = _digits(m)
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int").cast("double")
    return [
        F.length(m).cast("double"), F.length(d).cast("double"), _count(m, "a-z"), _count(m, "A-Z"), _count(m, "g-zG-Z"), _count(m, "."), _count(m, "@"), _count(m, " ()/+=_-"),
        flag(m.startswith("+")), flag(luhn(d)), flag(_small_parts(m)), flag(m.rlike("\\.[A-Za-z]{2,}$")), flag(before.rlike("[\"'`]$")), flag(before.rlike("[:=]\\s*[\"'`]?$")), flag(before.rlike("\\w$")), flag(after.rlike("^[\"'`]")), flag(after.rlike("^\\w")),
    ]


def _spread(spans: Column) -> Column:
    """Spans (s, e) in order and in chunks, with the reach of each chunk, for _meets."""
    return F.transform(_chunks(F.array_sort(spans)), lambda c: F.struct(F.get(c, F.lit(0))["s"].alias("low"), F.array_max(F.transform(c, lambda b: b["e"])).alias("high"), c.alias("spans")))


def _meets(spread: Column, x: Column) -> Column:
    """Whether a candidate overlaps any of the spread spans."""
    return F.exists(spread, lambda c: F.coalesce((c["low"] < x["e"]) & (x["s"] < c["high"]), F.lit(False)) & F.exists(c["spans"], lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))


def _places(*kinds: str) -> Column:
    return F.concat(*(F.transform(F.col(k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))) for k in kinds))


# -- trees as expressions -------------------------------------------------------


def _plain(node):
    """A tree as nested tuples: a leaf's value, or (feature, threshold, left, right)."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _plain(node.leftChild()), _plain(node.rightChild())


def _tree(node, f: list[Column]) -> Column:
    if not isinstance(node, tuple):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(f[feature] <= F.lit(threshold), _tree(left, f)).otherwise(_tree(right, f))


class Scorer:
    """Boosted trees of each generator, and its calibrated threshold; None adds nothing.

    counts: by generator the candidates that trees and threshold rest on, (fitted on, calibrated on).
    """

    def __init__(self):
        self.models: dict[str, tuple[list, list[float], float]] = {}
        self.counts: dict[str, tuple[int, int]] = {}

    def selects(self, name: str, f: list[Column]) -> Column:
        if name not in self.models:
            return F.lit(False)
        trees, weights, least = self.models[name]
        return self.margin(trees, weights, f) >= F.lit(least)

    @staticmethod
    def margin(trees: list, weights: list[float], f: list[Column]) -> Column:
        return reduce(lambda a, b: a + b, [_tree(t, f) * F.lit(w) for t, w in zip(trees, weights, strict=True)])


def _cuts(each: DataFrame) -> dict[str, list[list[float]]]:
    """By generator, the cuts of each feature: all its values if they are few, else quantiles of both labels, exact and by number."""
    values = each.select("name", "label", "c", F.posexplode("f").alias("i", "x")).groupBy("name", "label", "i", "x").agg(F.sum("c").alias("c"))
    some = CUTS // 2
    steps = F.array(*(F.lit(k / some) for k in range(some)))
    of = values.groupBy("name", "i", "label").agg(F.percentile("x", steps, F.col("c")).alias("q"), F.slice(F.array_sort(F.collect_set("x")), 1, CUTS + 1).alias("x"))
    both = of.groupBy("name", "i").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("q")))).alias("q"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("x")))).alias("x"))
    out: dict[str, list[list[float]]] = {}
    for r in both.orderBy("name", "i").collect():
        out.setdefault(r["name"], []).append(r["x"] if len(r["x"]) <= CUTS else r["q"])
    return out


def _uncut(node, cuts: list[list[float]]):
    """A tree over numbers of cuts below a value as one over values."""
    if not isinstance(node, tuple):
        return node
    feature, threshold, left, right = node
    return feature, cuts[feature][int(threshold)], _uncut(left, cuts), _uncut(right, cuts)


def fit(docs: DataFrame, sample: int | None = None) -> Scorer:
    """Learn from the candidates of docs (doc_id, text), weakly labelled as the module says.

    All candidates count. ``sample`` is for trials only: about so many of a generator and label, by a hash of their place.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *(_base(text, k).alias(k) for k in BASE), *(_proposed(text, n).alias(f"p_{n}") for n in PROPOSED)).withColumn("base", _spread(_places(*BASE)))

    def marked(name: str) -> Column:
        def of(x: Column) -> Column:
            label = x["before"].rlike(_INTRODUCED[name])
            label = label if name == "secret" else label | _meets(F.col("base"), x)
            if name == "address":
                label = F.when(label | ~x["m"].rlike(_OPEN), label)  # the others are of unknown label
            f = F.array(*_features(name, x["m"], x["before"], x["after"]))
            return F.struct(F.lit(name).alias("name"), x["s"].alias("s"), f.alias("f"), label.cast("double").alias("label"))

        return F.transform(F.col(f"p_{name}"), of)

    shared.ready(docs.sparkSession)
    all_ = rows.select("doc_id", F.explode(F.concat(*(marked(n) for n in PROPOSED))).alias("x")).select("doc_id", "x.*").where("label is not null")
    # Rows of one place stay together; every third place goes to calibration. Candidates alike in features count as one with their number.
    h = F.xxhash64("doc_id", "s", "name")
    each = all_.select("name", "label", "f", h.alias("h"), (F.pmod(F.xxhash64(h), F.lit(3)) == 1).alias("kept"))
    if sample is not None:
        sizes = {(r["name"], r["label"]): r["count"] for r in each.groupBy("name", "label").count().collect()}
        share = reduce(lambda a, k: F.when((F.col("name") == k[0]) & (F.col("label") == k[1]), min(1.0, sample / sizes[k])).otherwise(a), sizes, F.lit(0.0))
        each = each.where(F.pmod(F.xxhash64(F.xxhash64("h")), F.lit(1 << 30)) < share * (1 << 30))
    each = each.groupBy("name", "label", "kept", "f").agg(F.count("*").alias("c")).checkpoint()
    totals = {(r["name"], r["label"], r["kept"]): r["n"] for r in each.groupBy("name", "label", "kept").agg(F.sum("c").alias("n")).collect()}
    cuts = _cuts(each)
    out = Scorer()
    for name in PROPOSED:
        n = {(label, kept): totals.get((name, label, kept), 0) for label in (0.0, 1.0) for kept in (False, True)}
        ones, own = n[1.0, False] + n[1.0, True], sum(n.values())
        out.counts[name] = n[0.0, False] + n[1.0, False], n[0.0, True] + n[1.0, True]
        if ones in (0, own):
            # Without examples of both labels there is nothing to tell candidates by but the smoothed share of 1.
            if ones and (ones + 1) / (own + 2) >= PRECISION[name]:
                out.models[name] = ([], [], 0.0)
            continue
        # A label that is too rare for both sides has all its examples on both.
        rare = [label for label in (0.0, 1.0) if not n[label, False] or not n[label, True]]
        of = each.where((F.col("name") == name) & (~F.col("kept") | F.col("label").isin(rare)))
        below = lambda c, value: F.size(F.filter(F.array(*map(F.lit, c)), lambda x: x < value)).cast("double")
        places = F.array(*(below(c, F.col("f")[i]) for i, c in enumerate(cuts[name])))
        frame = of.select("label", places.alias("b"), "c").groupBy("label", "b").agg(F.sum("c").cast("double").alias("weight")).checkpoint()
        count = frame.count()
        parts = -(-count // EXAMPLES)
        dealt = frame.repartition(parts, "label", "b").sortWithinPartitions("b", "label").select("label", "weight", array_to_vector("b").alias("features"))
        # Spark looks for splits in max(10,000, maxBins squared) rows: in all of them, so; the values are as few as the cuts.
        bins = max(CUTS + 1, math.isqrt(count) + 1)
        model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=7, maxBins=bins, weightCol="weight").fit(dealt)  # the trees live as long as this
        java = model._java_obj
        trees, weights = [_uncut(_plain(t.rootNode()), cuts[name]) for t in java.trees()], list(java.treeWeights())
        # A row for each value that the trees can give.
        margin = Scorer.margin(trees, weights, [F.col("f")[i] for i in range(len(cuts[name]))])
        judged = each.where((F.col("name") == name) & (F.col("kept") | F.col("label").isin(rare)))
        scored = judged.groupBy(margin.alias("p")).agg(F.sum(F.col("label") * F.col("c")).alias("hits"), F.sum("c").alias("seen")).collect()
        hits, seen, best = 0.0, 0.0, None
        for r in sorted(scored, key=lambda r: -r["p"]):
            hits, seen = hits + r["hits"], seen + r["seen"]
            if r["p"] > LEAST[name] and hits >= PRECISION[name] * seen:
                best = r["p"]
        if best is not None:
            out.models[name] = (trees, weights, best)
    return out


# -- the operator ---------------------------------------------------------------


def find_personal(docs: DataFrame, scorer: Scorer | None = None, sample: int | None = None) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    docs: doc_id, text; other columns are ignored. Spans are kind:start:end in code points, end
    exclusive, by kind (email, ip, card, phone, secret) and start. A null text has none; an empty
    table gives no rows; repeated rows get equal results. scorer: fitted on docs by default.
    """
    docs = docs.select("doc_id", "text")
    scorer = scorer or fit(docs, sample)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", *(_base(text, k).alias(k) for k in BASE), *(_proposed(text, n).alias(f"p_{n}") for n in PROPOSED))
    rows = rows.withColumn("base", _spread(_places(*BASE)))

    def added(name: str) -> Column:
        def judged(x: Column) -> Column:
            f = _features(name, x["m"], x["before"], x["after"])
            chosen = scorer.selects(name, f) if name not in scorer.models or scorer.models[name][0] else F.lit(True)
            return chosen & ~_meets(F.col("base"), x)

        kind = {"address": lambda x: F.lit("email"), "secret": lambda x: F.lit("secret"), "number": lambda x: F.when(_small_parts(x["m"]) & x["m"].rlike("^[0-9]+(?:\\.[0-9]+){3}$"), "ip").when(F.length(_digits(x["m"])) >= 16, "card").otherwise("phone")}[name]
        return F.transform(F.filter(F.col(f"p_{name}"), judged), lambda x: F.struct(kind(x).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))

    rows = rows.withColumn("more", F.concat(*(added(n) for n in PROPOSED)))
    spell = lambda kind: lambda x: F.concat_ws(":", F.lit(kind), x["s"].cast("string"), x["e"].cast("string"))
    listed = {k: F.transform(F.col(k), spell(k)) for k in BASE}

    def everything(kind: str) -> Column:
        own = F.transform(F.filter(F.col("more"), lambda x: x["kind"] == kind), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e")))
        if kind in BASE:
            own = F.concat(_places(kind), own)
        return F.transform(F.array_sort(own), spell(kind))

    return rows.select(
        "doc_id",
        *(F.size(F.col(k)).cast("long").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(F.concat(*listed.values()), ","), 256).alias("base_sha256"),
        F.array_join(F.concat(*(everything(k) for k in KINDS)), ",").alias("spans"),
    )


def redact(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with each span of ``spans`` in the text replaced by its kind in brackets.

    Spans that overlap are replaced together, by the kind of the first. A null text stays null; rows
    without doc_id or without spans stay as they are. doc_id must be unique, or its rows repeat one text.
    """
    listed = F.transform(F.filter(F.split("spans", ","), lambda x: x != ""), lambda x: _let(F.split(x, ":"), lambda p: F.struct(p[1].cast("int").alias("s"), p[2].cast("int").alias("e"), p[0].alias("k"))))
    reach = _running(F.col("_x"), F.lit(0), lambda m, x: F.greatest(m, x["e"]), "int")
    # Runs of overlapping spans: heads, and where each run ends.
    before = F.concat(F.array(F.lit(0)), F.col("_r"))
    runs = F.filter(F.zip_with(F.zip_with("_x", F.slice(before, F.lit(1), F.size("_x")), lambda x, b: F.struct(x.alias("x"), b.alias("b"))), F.sequence(F.lit(1), F.size("_x")), lambda y, i: F.struct(y["x"]["s"].alias("s"), y["x"]["k"].alias("k"), i.alias("i"), y["b"].alias("b"))), lambda y: (y["i"] == 1) | (y["s"] >= y["b"]))

    def spliced(x: Column) -> Column:
        chars, heads, tops = x["chars"], x["heads"], x["reach"]
        # The text after each run, up to the next; a run reaches to the largest end before the next head.
        nexts = F.concat(F.slice(heads, F.lit(2), F.size(heads)), F.array(F.struct(F.size(chars).alias("s"), F.lit("").alias("k"), (F.size(tops) + 1).alias("i"), F.lit(0).alias("b"))))
        parts = F.zip_with(heads, nexts, lambda h, n: _let(F.element_at(tops, n["i"] - 1), lambda e: F.concat(F.lit("["), h["k"], F.lit("]"), F.array_join(F.slice(chars, e + 1, F.greatest(F.lit(0), n["s"] - e)), ""))))
        return F.concat(F.array_join(F.slice(chars, F.lit(1), heads[0]["s"]), ""), F.array_join(parts, ""))

    spans = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("spans").alias("_spans")).withColumnRenamed("_spans", "spans").where("spans <> ''")
    placed = spans.select("doc_id", F.array_sort(listed).alias("_x")).withColumn("_r", reach).select("doc_id", "_r", runs.alias("_h"))
    text = _let(F.struct(F.split("text", "").alias("chars"), F.col("_h").alias("heads"), F.col("_r").alias("reach")), spliced)
    return docs.join(placed, "doc_id", "left").withColumn("text", F.when(F.col("_h").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)
