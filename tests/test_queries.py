"""Registered queries against DuckDB, and the shape of the package."""

import math
import os
import re
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from quillgraph.plans import registry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = __spark_entry__.DATA
HELD = ("names_dictionary", "mentions_decorate", "relation_scores", "visible_relations", "boundary_decisions", "search_text_bm25", "ingest_classify", "eval_calibration", "session_idle_windows", "sections_tree", "phrase_mentions", "phrase_relations", "deepest_section", "semantic_pool_topmean", "overrides_merged", "beyond_scope", "embedding_index")
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(x):
    return round(x, 7) + 0.0 if isinstance(x, float) and not math.isnan(x) else x


@needs_tables
@pytest.mark.parametrize("name", HELD)
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    cursor = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    want = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in cursor.fetchall())
    assert got == want and got


@needs_tables
def test_entry_gives_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert registry.FLAGSHIP in registry.QUERIES


def test_nothing_but_the_entry_knows_the_training_data_part():
    for folder, _, files in os.walk(os.path.join(ROOT, "quillgraph")):
        if os.path.basename(folder) == "llm":
            continue
        for f in files:
            if f.endswith(".py"):
                assert not re.search(r"^\s*(?:from|import)\b.*\bllm\b", open(os.path.join(folder, f)).read(), re.M), f


def test_the_entry_imports_without_that_part(tmp_path):
    (tmp_path / "__spark_entry__.py").write_text(open(os.path.join(ROOT, "__spark_entry__.py")).read())
    subprocess.run(["cp", "-r", os.path.join(ROOT, "quillgraph"), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "quillgraph/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'visible_relations' in q and not any(k.startswith('op') or k == 'pipeline' for k in q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)})
