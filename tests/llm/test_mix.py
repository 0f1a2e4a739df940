import random

import duckdb
import pytest

from quillgraph.llm import op9_mix as op9


def rows(n=600, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        source = rng.choice(["src0"] * 6 + [f"src{k}" for k in range(1, 12)] + [None, "web"])
        out.append((i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["en", "en", "fr", "de", None]), source, 1))
    return out + [(700, None, "en", "src1", 0), (None, "a b", "en", "src2", 0), (5, "x y z", "fr", "src3", 0), (5, "x y z", "fr", "src3", 0)]


SCHEMA = "doc_id long, text string, lang string, source string, place int"


@pytest.mark.parametrize("recipe", [op9.DEFAULT, op9.Recipe({"domain": {"d1": 9, "d2": 0}, "lang": {"fr": 7}}, 3, 2, 3), op9.Recipe(op9.DEFAULT.weights, 4, 5, 1, whole=True), op9.Recipe({}, 9, 1, 2)])
def test_against_sql(spark, recipe):
    data = rows()
    got = op9.choose(op9.counted(spark.createDataFrame(data, SCHEMA)), recipe)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, place INT)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", data)
    want = con.execute(op9.oracle(recipe)).fetchall()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want))


def test_shortage_stays_among_siblings_first(spark):
    # Domain a: one small and one large language; domain b has plenty.
    data = [("a", "x", "1", 10), ("a", "y", "1", 1000), ("b", "x", "1", 1000)]
    leaves = spark.createDataFrame(data, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang): r.target for r in op9.budgets(leaves, op9.Recipe({}, 1000, 2010, 1)).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 490, ("b", "x"): 500}


def test_empty_and_keep(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert op9.choose(op9.counted(none)).collect() == []
    d = spark.createDataFrame(rows(), SCHEMA)
    kept = op9.keep_mix(d, op9.Recipe({}, 1, 2, 1, whole=True))
    assert kept.columns == d.columns and 0 < kept.count() < d.count()
