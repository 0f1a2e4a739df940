import itertools
import math
import random
import re
from collections import Counter

from quillgraph.llm import op7_urls as op7


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in op7.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.host + r.path), default=None)
    return host, path, best and best.host + best.path, best and ("allow" if best.allow else "block")


def test_rules_and_mined_combinations(spark):
    urls = [f"http://{h}/{p}/{i}" for i in range(40) for h in ("good.site.net", "spam.site.net", "casino.site.net") for p in ("en", "win")]
    urls += ["https://A.Example.ORG/es/1", "http://example.org/en/12?x", "http://example.org/en/2", "http://x.com/fr/a", "http://com/de/", "http://xcom/de/", "no scheme", None, "", "://", "ftp://h#f", "http://b.org", "http://Ñ.net/é?q", "a://b://c"]
    pages = spark.createDataFrame([(i, u, "<p>", "x") for i, u in enumerate(urls)] + [(None, "http://x.com/fr/a", "", ""), (0, urls[0], "<p>", "x")], "page_id long, url string, html string, rule string")
    # Bad: spam everywhere, casino only together with win.
    labels = spark.createDataFrame([(i, int(not ("spam" in u or ("casino" in u and "/win" in u))), 0) for i, u in enumerate(urls[:120])] + [(99999, 0, 1), (None, 0, 0), (1, None, None)], "doc_id long, quality int, toxic int")
    got = op7.filter_urls(pages, labels, support=0.01, confidence=0.9).collect()
    assert len(got) == len(urls) + 2
    for r in got:
        u = "http://x.com/fr/a" if r.page_id is None else urls[r.page_id]
        host, path, rule, verdict = brute(u)
        mined = "spam" in host or ("casino" in host and path.startswith("/win"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or ("block" if mined else "allow")), u


def test_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x")], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert op7.filter_urls(pages, labels).first().verdict == "allow"
    assert op7.filter_urls(pages.limit(0), labels).collect() == []


def test_a_long_shared_path_is_one_token(spark):
    """Twenty segments that always stand together: over a million combinations, mined as one; each of them stands for the rule."""
    deep = "/".join(f"seg{chr(97 + k)}" for k in range(20))
    urls = [f"http://a.net/{deep}/{i}" for i in range(60)] + [f"http://a.net/ok{i % 7}/{i}" for i in range(200)] + ["http://b.net/segq/zz", "http://b.net/none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, int(i >= 60), 0) for i in range(260)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in op7.filter_urls(pages, labels).collect()}
    assert {i for i, v in got.items() if v == "block"} == {*range(60), 260}


def tokens(url):
    host, path, _, _ = brute(url)
    out = {f"h:{x}" for x in re.split("[.:]", host) if x} | {f"w:{x}" for x in re.split("[^a-z0-9]+", host) if len(x) > 2}
    return frozenset(out | {f"p:{x}" for x in re.split("[/._-]+", path.lower()) if x and not re.fullmatch("[0-9]+", x)})


def test_a_folder_with_a_space(spark):
    urls = [f"http://a.net/{'bad area' if i % 2 else 'ok area'}/x{i}" for i in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in op7.filter_urls(pages, labels).collect()}
    assert all(got[i] == ("block" if i % 2 else "allow") for i in range(400))


def test_mining_and_matching_against_brute_force(spark):
    """Segments with spaces, tabs, the tokens' own prefixes and separators of other kinds."""
    rng = random.Random(8)
    parts = ["a b", "a", "b", "a\tb", "p:a", "w:a", "h:net", "=bad", "\u0000", "a\u0000b", "é é", "x,y", "1 2", "12"]
    hosts = ["one.net", "two.net", "three.one.net"]
    urls = [f"http://{rng.choice(hosts)}/" + "/".join(rng.choice(parts) for _ in range(rng.randint(0, 4))) for _ in range(400)]
    bad = [("/a b" in u and "two" in u) or "\u0000" in u or rng.random() < 0.1 for u in urls]
    labelled = range(250)
    support, confidence = 0.02, 0.7
    least, n, hits = math.ceil(support * len(labelled)), Counter(), Counter()
    for i in labelled:
        for size in range(1, op7.LENGTH + 1):
            for combo in itertools.combinations(sorted(tokens(urls[i])), size):
                n[combo] += 1
                hits[combo] += bad[i]
    rules = [set(c) for c, k in hits.items() if k >= least and k / n[c] >= confidence]
    assert len(rules) > 5
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    labels = spark.createDataFrame([(i, int(not bad[i]), 0) for i in labelled], "doc_id long, quality int, toxic int")
    got = {r.page_id: r.verdict for r in op7.filter_urls(pages, labels, support=support, confidence=confidence).collect()}
    for i, u in enumerate(urls):
        assert got[i] == (brute(u)[3] or ("block" if any(r <= tokens(u) for r in rules) else "allow")), u
