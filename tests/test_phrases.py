"""The names of dictionary mentions are computed once, whatever reads them."""

from quillgraph.operators import entities, mentions


def test_names_are_computed_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(parts):
        for p in parts:
            seen.add(len(p))
            yield p

    rows = [(f"d{i}", f"Name {i} \u00c9t\u00e9", "filename") for i in range(40)] + [("d0", "", "filename"), ("d1", "\u4e2d\u6587", "filename")]
    names = spark.createDataFrame(rows, "doc string, name string, source string").mapInPandas(count, "doc string, name string, source string")
    spans = spark.createDataFrame([("t", "s", "b", 0, "name 7 \u00e9t\u00e9, NAME 31 \u00c9T\u00c9; \u4e00\u4e2d\u6587 name 400 \u00e9t\u00e9")], "doc string, section string, block string, start long, text string")
    got = sorted((r.start, r.end, r.target) for r in mentions.dictionary_mentions(spans, entities.dictionary(names)).collect())
    assert got == [(0, 10, "d7"), (12, 23, "d31"), (26, 28, "d1")]
    assert seen.value == len(rows)
