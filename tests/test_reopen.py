"""A vault that is opened again, on real files."""

import os

import pytest

from quillgraph.operators.ingest import Conflict
from quillgraph.sources import reopen, vault


@pytest.fixture
def place(tmp_path):
    root = tmp_path / "vault"
    os.makedirs(root / "sub")
    (root / "a.md").write_bytes("# A\r\ntext".encode())
    (root / "sub/b.md").write_text("# B")
    (root / "c.md").write_text("# C")
    return root, str(tmp_path / "state")


def opened(spark, place, parser="1", policy="p", declarations="d"):
    root, state = place
    return reopen.open_vault(spark, str(root), state, vault.scan(spark, str(root)), parser, policy, declarations)


def seen(o):
    ids = {r.doc: (r.revision, r.epoch) for r in o.epochs.collect()}
    return {r.path: (r.action, *ids[r.doc]) for r in o.changes.collect()}


def test_reopening_without_a_change_raises_nothing(spark, place):
    first = opened(spark, place)
    assert seen(first) == {p: ("added", 1, 1) for p in ("a.md", "sub/b.md", "c.md")} and (first.index_revision, first.policy_revision) == (1, 0)
    first.save()
    again = opened(spark, place)
    assert seen(again) == {p: ("unchanged", 1, 1) for p in ("a.md", "sub/b.md", "c.md")} and (again.index_revision, again.policy_revision) == (1, 0)
    assert {(r.doc, r.path) for r in again.documents.collect()} == {(r.doc, r.path) for r in first.documents.collect()}
    assert next(r.markdown for r in again.documents.collect() if r.path == "a.md") == "# A\r\ntext"


@pytest.mark.parametrize(("changed", "index", "policy"), [({"parser": "2"}, 2, 0), ({"policy": "q"}, 2, 0), ({"parser": "2", "policy": "q"}, 2, 0), ({"declarations": "e"}, 2, 1), ({"declarations": "e", "parser": "2"}, 3, 1)])
def test_each_signature_raises_its_counters(spark, place, changed, index, policy):
    opened(spark, place).save()
    o = opened(spark, place, **changed)
    assert (o.index_revision, o.policy_revision) == (index, policy) and all(v[1:] == (1, 1) for v in seen(o).values())
    o.save()
    o = opened(spark, place, **changed)
    assert (o.index_revision, o.policy_revision) == (index, policy)


def test_changed_missing_new_and_returned_files(spark, place):
    root, _ = place
    first = opened(spark, place)
    first.save()
    ids = {r.path: r.doc for r in first.documents.collect()}
    (root / "a.md").write_text("# A2")
    os.remove(root / "c.md")
    (root / "new.md").write_text("# N")
    second = opened(spark, place)
    assert seen(second) == {"a.md": ("changed", 2, 2), "c.md": ("missing", 1, 2), "new.md": ("added", 1, 1), "sub/b.md": ("unchanged", 1, 1)}
    assert second.index_revision == 3 and {r.path for r in second.documents.collect()} == {"a.md", "new.md", "sub/b.md"}
    second.save()
    (root / "c.md").write_text("# C")
    third = opened(spark, place)
    now = {r.path: r.doc for r in third.documents.collect()}
    assert now["a.md"] == ids["a.md"] and now["c.md"] != ids["c.md"] and third.index_revision == 4
    assert {r.doc: (r.revision, r.epoch) for r in third.epochs.collect()}[ids["c.md"]] == (1, 2)
    with pytest.raises(Conflict):
        third.save() and second.save()


def test_states_that_do_not_fit(spark, place, tmp_path):
    root, state = place
    with pytest.raises(ValueError):
        opened(spark, (root, str(root / "state")))
    opened(spark, place).save()
    other = tmp_path / "other"
    os.makedirs(other)
    (other / "x.md").write_text("x")
    with pytest.raises(ValueError):
        opened(spark, (other, state))


def test_declarations_digest_has_no_order(spark):
    rows = [("a", None, True), ("b", "s", False)]
    table = lambda r: spark.createDataFrame(r, "name string, section string, allow_short boolean")
    assert reopen.declarations_digest(table(rows)) == reopen.declarations_digest(table(rows[::-1]).repartition(2)) != reopen.declarations_digest(table(rows[:1]))
    assert reopen.declarations_digest(table(rows), table([])) != reopen.declarations_digest(table([]), table(rows))
