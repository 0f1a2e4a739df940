"""URL filtering by association rules, in DataFrame operations alone.

A URL is the set of its tokens. FP-growth over the labelled pages mines the token
combinations that go with bad pages; rules are pruned by confidence and support, and by
a shorter rule that says as much. An inverted index from tokens to rules matches all
pages: a page meets a rule when it holds as many of its tokens as the rule has. Fixed
host and path rules come before mined ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least share of the labelled pages that a combination occurs in, and of bad pages among them.
SUPPORT, CONFIDENCE = 0.004, 0.6
#: Tokens of a rule at most.
LENGTH = 3

_BAD = "=bad"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool


#: Fixed rules of the contract.
RULES = (Rule("org", "/", True), Rule("example.org", "/es/", False), Rule("example.org", "/en/1", False), Rule("com", "/fr/", True), Rule("com", "/de/", False))


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(host: Column, path: Column) -> Column:
    """The different tokens of a URL: labels and words of the host, segments of the path without numbers."""
    labels = F.transform(F.filter(F.split(host, "[.:]"), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(host, "[^a-z0-9]+"), lambda x: F.length(x) > 2), lambda x: F.concat(F.lit("w:"), x))
    parts = F.transform(F.filter(F.split(F.lower(path), "[/._-]+"), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(labels, words, parts))


def fixed_rule(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """The longest fixed rule that fits (host and path as one string), and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host + r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, "allow" if r.allow else "block").otherwise(verdict)
    return name, verdict


def twins(labelled: DataFrame, support: float) -> DataFrame:
    """(token, first) of frequent tokens that stand in exactly the pages that a smaller token stands in.

    One of them is enough to mine: n such tokens alone would make 2 ** n combinations. Frequent
    tokens number at most the mean tokens of a page / support, so their list is bounded.
    """
    total = lambda seed: F.sum(F.xxhash64("bad", "tokens", F.lit(seed)).cast("decimal(38,0)"))
    rows = labelled.withColumn("token", F.explode("tokens"))
    where = rows.groupBy("token").agg(F.count("*").alias("n"), total(1).alias("x"), total(2).alias("y")).where(F.col("n") >= support * F.lit(labelled.count()))
    first = where.groupBy("n", "x", "y").agg(F.min("token").alias("first"), F.count("*").alias("c")).where("c > 1")
    return where.join(first, ["n", "x", "y"]).where("token <> first").select("token", "first")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, length: int = LENGTH) -> DataFrame:
    """Rules (rule long, tokens array, same array of arrays, confidence, n) for labelled pages (tokens array, bad boolean).

    A combination occurs in two labelled pages at least, however few there are. Token sets are
    compared as sorted arrays, so tokens may hold any character. Tokens that always stand together count as one, the smallest of them; ``same`` lists each
    token of a rule with those that stand for it.
    """
    from pyspark.ml.fpm import FPGrowth

    spark = labelled.sparkSession
    total = labelled.count()
    schema = "rule long, tokens array<string>, same array<array<string>>, confidence double, n long"
    if not total or labelled.where("bad").isEmpty():
        return spark.createDataFrame([], schema)
    one = twins(labelled, support)
    drop = [r["token"] for r in one.select("token").collect()]  # bounded as twins() says
    few = F.array_except("tokens", F.array(*map(F.lit, sorted(drop)))) if drop else F.col("tokens")
    baskets = labelled.select("bad", few.alias("tokens")).select(F.when(F.col("bad"), F.array_append("tokens", F.lit(_BAD))).otherwise(F.col("tokens")).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=max(support, 2 / total), numPartitions=max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))).fit(baskets).freqItemsets.where(F.size("items") <= length + 1)
    sets = sets.withColumn("bad", F.array_contains("items", _BAD)).withColumn("key", F.array_sort(F.array_remove("items", _BAD)))
    both = sets.where("bad and size(key) > 0").select("key", F.col("freq").alias("hits"))
    rules = both.join(sets.where("not bad").select("key", F.col("freq").alias("n")), "key").withColumn("confidence", F.col("hits") / F.col("n")).where(F.col("confidence") >= confidence)
    rules = rules.select("key", "n", "confidence", F.col("key").alias("tokens"))
    # A rule goes if a rule on fewer of its tokens is as confident: its subsets of one token less say so step by step.
    part = rules.where(F.size("tokens") > 1).select("key", "confidence", F.explode("tokens").alias("drop"), "tokens")
    part = part.select("key", "confidence", F.array_remove("tokens", F.col("drop")).alias("sub"))
    dull = part.join(rules.select(F.col("key").alias("sub"), F.col("confidence").alias("c")), "sub").where("c >= confidence").select("key").distinct()
    kept = rules.join(dull, "key", "left_anti").select(F.xxhash64("key").alias("rule"), "tokens", "confidence", "n")
    lists = one.groupBy(F.col("first").alias("token")).agg(F.array_prepend(F.array_sort(F.collect_list("token")), F.col("first")).alias("own"))
    each = kept.select("rule", F.explode("tokens").alias("token")).join(lists, "token", "left")
    same = each.groupBy("rule").agg(F.collect_list(F.coalesce("own", F.array("token"))).alias("same"))  # LENGTH tokens at most
    return kept.join(same, "rule").select("rule", "tokens", "same", "confidence", "n")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens) of the different token sets that meet some rule, by the inverted index from tokens, and their twins, to rules.

    sets: tokens, in one order for equal sets. They repeat a great deal, so each is matched once.
    """
    index = rules.select("rule", F.size("tokens").alias("need"), F.posexplode("same").alias("place", "any")).select("rule", "need", "place", F.explode("any").alias("token"))
    held = sets.distinct().select("tokens", F.explode("tokens").alias("token"))
    return held.join(index, "token").groupBy("tokens", "rule", "need").agg(F.count_distinct("place").alias("have")).where("have = need").select("tokens").distinct()


def filter_urls(pages: DataFrame, labels: DataFrame, rules: tuple[Rule, ...] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    pages: page_id, url; labels: doc_id (a page_id), quality, toxic; a page is bad if any label of
    it has quality 0 or toxic 1. The longest fixed rule that fits decides; else a page is blocked
    if it meets a mined rule. A null url, or one without ``://``, has an empty host and path and
    is allowed. Pages without labels, and labels without pages, train nothing; repeated rows get
    equal results; other columns are ignored. Paths may hold spaces, tabs and any other character.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    parsed = parsed.withColumn("tokens", F.array_sort(tokens_of(F.col("host"), F.col("path"))))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("page_id")).agg(F.coalesce(F.max((F.coalesce(F.col("quality"), F.lit(1)) == 0) | (F.coalesce(F.col("toxic"), F.lit(0)) == 1)), F.lit(False)).alias("bad"))
    labelled = parsed.where(F.size("tokens") > 0).join(marks, "page_id").select("tokens", "bad")
    mined = mine(labelled, support, confidence)
    met = match(parsed.select("tokens"), mined).withColumn("met", F.lit(True))
    name, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    joined = parsed.join(met, "tokens", "left")
    return joined.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.when(F.col("met"), "block").otherwise("allow")).alias("verdict"))
