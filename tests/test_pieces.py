"""Notes are parsed some at a time, so that what a task holds does not grow with its batch."""

import pyarrow as pa

from quillgraph.operators import parse


def test_a_large_batch_is_cut_by_characters_and_rows():
    texts = ["a" * 1000] * 700 + [None, ""] + ["é" * (parse.PIECE * 2)] + ["b"] * 1000
    batch = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "markdown": pa.array(texts, pa.string())})
    got = list(parse.pieces(iter([batch, batch.slice(0, 0)]), "markdown"))
    assert [d for b in got for d in b.column("doc").to_pylist()] == list(range(len(texts)))
    for b in got:
        sizes = [len(t or "") for t in b.column("markdown").to_pylist()]
        assert len(sizes) <= parse.NOTES and (len(sizes) == 1 or sum(sizes) <= parse.PIECE)


def test_only_wanted_columns_and_broken_notes(spark):
    notes = spark.createDataFrame([("a", "a.md", "# One\n\n![x](p.png) [[b]]\n\n## Two\n\nend"), ("b", "b.md", "---\nx: [\n---\nrest"), ("c", "c.md", "")], "doc string, path string, markdown string")
    whole = {r.doc: r for r in parse.parse_notes(notes).collect()}
    some = parse.parse_notes(notes, ("sections", "links"))
    assert some.columns == ["doc", "sections", "links"]
    assert {r.doc: (r.sections, r.links) for r in some.collect()} == {d: (r.sections, r.links) for d, r in whole.items()}
    assert whole["b"].error and not whole["b"].sections and whole["a"].error is None and len(whole["a"].media) == 1
