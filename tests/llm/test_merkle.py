import hashlib
import random
import zlib

import pytest

from quillgraph.llm import op12_merkle as m

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def trees(values):
    levels = [values]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        first = i - i % 3
        out.append((level[first:i], level[i + 1 : first + 3]))
        i //= 3
    return out


def brute(rows):
    found = []
    for doc_id, source, lang, n, text in rows:
        changed = text
        if text is not None and zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 2 == 0:
            changed = text.replace("\n", "")
        found.append((source, doc_id, leaf((doc_id, source, lang, n, text)), leaf((doc_id, source, lang, n, changed))))
    found.sort(key=lambda r: (r[0] is not None, (r[0] or "").encode(), r[1] is not None, r[1] or 0, r[2]))
    groups = {}
    for r in found:
        groups.setdefault(r[0], []).append(r)
    below = [trees([r[2] for r in g]) for g in groups.values()]
    top = trees([t[-1][0] for t in below]) if below else None
    out = []
    for k, g in enumerate(groups.values()):
        for i, r in enumerate(g):
            steps, value = path(below[k], i) + path(top, k), r[3]
            for left, right in steps:
                value = h(*left, value, *right)
            out.append((r[1], r[2], below[k][-1][0], top[-1][0], h(*[x for a, b in steps for x in a + b]), value, value == top[-1][0]))
    return sorted(out, key=str)


@pytest.mark.parametrize(("reach", "fan"), [(5, 2), (20_000, 64)])
def test_ranges_and_rounds_against_brute_force(spark, monkeypatch, reach, fan):
    monkeypatch.setattr(m, "RANGE", reach)
    monkeypatch.setattr(m, "FAN", fan)
    rng = random.Random(5)
    rows = [(i * 7 % 101, rng.choice(["hot"] * 9 + [None, "a", "ä", "one\nline", ""]), rng.choice([None, "en"]), rng.choice([None, 3]), rng.choice([None, "", "a\nb", "\n\n", "é\n"])) for i in range(101)]
    rows += [(None, "hot", None, None, "x\ny"), (None, None, None, None, None), (2**60 + 1, "hot", "en", 1, "q"), (3, "hot", "en", 1, "same"), (3, "hot", "en", 1, "same"), (3, "hot", "en", 1, "other\n"), (9, "lone", "en", 0, "z" * 300_000 + "\n")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", digest string, part int").repartition(3)
    assert sorted((tuple(r) for r in m.manifest(docs).collect()), key=str) == brute(rows)


def test_small_tables(spark):
    for rows in ([], [(1, None, None, None, "a")], [(1, "s", None, None, "a"), (2, "t", None, None, None)], [(i, "s", "l", 1, "a") for i in range(4)]):
        assert sorted((tuple(r) for r in m.manifest(spark.createDataFrame(rows, SCHEMA)).collect()), key=str) == brute(rows)


def test_stack_emits_peaks_of_unaligned_edges():
    tree = m.Range(11)
    for i in range(2, 11):
        tree.push(0, i, str(i).encode())
    assert [s[:2] for s in tree.stack] == [(0, 2), (1, 1), (1, 2), (2, 1)]
    whole = m.Range(11)
    for i in range(11):
        whole.push(0, i, str(i).encode())
    assert [s[:2] for s in whole.stack] == [(3, 0)] and m.sizes(11) == [11, 4, 2, 1]
