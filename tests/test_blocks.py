"""Block structure: nested containers, HTML blocks, tables, definitions, and what the parser makes of them."""

import random

import pytest

from quillgraph.operators.blocks import scan
from quillgraph.operators.parse import parse


def leaves(text):
    return [(b.kind if b.kind != "heading" else f"h{b.depth}", b.text(text)) for b in scan(text)[0]]


CASES = [
    ("> a\n> b\nlazy\n\nc", [("paragraph", "a\nb\nlazy"), ("paragraph", "c")]),
    ("> > deep\n> back\n\n> other", [("paragraph", "deep\nback"), ("paragraph", "other")]),
    ("> quote\n- item", [("paragraph", "quote"), ("paragraph", "item")]),
    ("- one\n  two\n\n  three\n- four", [("paragraph", "one\ntwo"), ("paragraph", "three"), ("paragraph", "four")]),
    ("- a\n  - b\n    - c\n      more\n", [("paragraph", "a"), ("paragraph", "b"), ("paragraph", "c\nmore")]),
    ("1. a\n\n       code\n\n   b", [("paragraph", "a"), ("paragraph", "b")]),
    ("text\n2. not a list\n1. a list", [("paragraph", "text\n2. not a list"), ("paragraph", "a list")]),
    ("- \n  late", [("paragraph", "late")]),
    ("-\n\n  not in it", [("paragraph", "not in it")]),
    ("> # Head\n> - ## Sub #\n>   text", [("h1", "Head"), ("h2", "Sub"), ("paragraph", "text")]),
    ("> ```\n> code\n> ```\n> after", [("paragraph", "after")]),
    ("> ```\n> code\nout", [("paragraph", "out")]),
    ("- ```\n  code\n\n  code\n  ```\n  after", [("paragraph", "after")]),
    ("```\n> # no\n", []),
    ("~~~ a`b\nx\n~~~\ny", [("paragraph", "y")]),
    ("``` a`b\nx", [("paragraph", "``` a`b\nx")]),
    ("para\n    still para", [("paragraph", "para\nstill para")]),
    ("\tcode\n\n\tcode\nout", [("paragraph", "out")]),
    ("-\tone\n\n\ttwo\n\n\t\tcode", [("paragraph", "one"), ("paragraph", "two")]),
    ("<div>\nhidden\n*x*\n\nshown", [("paragraph", "shown")]),
    ("<!-- a\n\nb -->\nshown", [("paragraph", "shown")]),
    ("<script>\n\nx\n</script>\nshown", [("paragraph", "shown")]),
    ("text\n<div>\nhidden", [("paragraph", "text")]),
    ("text\n<b>\nstill text", [("paragraph", "text\n<b>\nstill text")]),
    ("<b>\nhidden", []),
    ("> <div>\n> hidden\nshown", [("paragraph", "shown")]),
    ("Two\nlines\n===\nx\n---", [("h1", "Two\nlines"), ("h2", "x")]),
    ("> a\n---\nb", [("paragraph", "a"), ("paragraph", "b")]),
    ("- a\n***\nb", [("paragraph", "a"), ("paragraph", "b")]),
    ("* * *\n- - x", [("paragraph", "x")]),
    ("#no\n#\n####### no", [("paragraph", "#no"), ("h1", ""), ("paragraph", "####### no")]),
    ("| a | b\\|c |\n|---|:-:|\n| d | |\n\ne", [("cell", "a"), ("cell", "b\\|c"), ("cell", "d"), ("paragraph", "e")]),
    ("a | b\n--- | ---\nc | d\n> q", [("cell", "a"), ("cell", "b"), ("cell", "c"), ("cell", "d"), ("paragraph", "q")]),
    ("a | b\n---\nc", [("h2", "a | b"), ("paragraph", "c")]),
    ("[x]: u\n[Y  z]: <v w> 'title'\ntext", [("paragraph", "text")]),
    ("text\n[x]: u", [("paragraph", "text\n[x]: u")]),
    ("[^1]: note\n    more\n\n    last\n\nout", [("paragraph", "note\nmore"), ("paragraph", "last"), ("paragraph", "out")]),
    ("a\r\nb\r\n\r\n> c\r\n", [("paragraph", "a\nb"), ("paragraph", "c")]),
    ("", []),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_leaves(text, want):
    assert leaves(text) == want


def test_definitions():
    assert scan("[x]: u\n[Y  z]: <v w> 'title'\n\n> - [in]: deep\n")[1] == {"x": "u", "y z": "v w", "in": "deep"}


def test_pieces_are_ordered_and_lie_in_the_source():
    rng = random.Random(7)
    parts = ["> ", "- ", "1. ", "  ", "    ", "\t", "# ", "```", "~~~", "---", "===", "<div>", "<!--", "-->", "| a | b |", "|---|---|", "[x]: y", "word", "[^1]: ", "\n", "\n", "\n\n", "\r\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        last = 0
        for b in scan(text)[0]:
            for a, z in b.pieces:
                assert last <= a <= z <= len(text) and "\n" not in text[a:z], text
                last = z


def test_parser_on_nested_notes():
    text = "# Top &amp; \\*x\\*\n\n> - [[A|a]] word\n>   1. ![pic](p.png) tail\n>\n> ## In\n>\n> Lark `Lark`\n\n<div title='Lark'>\nLark\n</div>\n\n- [ref][r] [^1] Lark\n\n[r]: /Lark\n[^1]: foot [[B]]\n"
    p = parse("d", "d.md", text)
    assert [(s["title"], s["depth"]) for s in p.sections] == [("", 0), ("Top & *x*", 1), ("In", 2)]
    assert all(text[s["start"] : s["end"]] == s["text"] for s in p.spans)
    assert sum("Lark" in s["text"] for s in p.spans) == 2
    assert [(x["target"], x["label"], text[x["start"] : x["end"]]) for x in p.links] == [("A", "a", "[[A|a]]"), ("B", "B", "[[B]]")]
    assert [(m["source"], m["alt"]) for m in p.media] == [("p.png", "pic")]
    inside = next(s for s in p.spans if s["text"].startswith("Lark"))
    assert inside["section"].endswith('["Top & *x*","In"]:0') and inside["block"] == f"d:block:{text.index('Lark')}"


def test_image_units_against_every_width(spark):
    """The window is that of the first width of the halving series that fits; what a label or an alternative text stands for is counted."""
    from quillgraph.functions.policy import Chunking
    from quillgraph.operators.chunks import image_units, source_text
    from quillgraph.operators.parse import parse_notes

    rng = random.Random(3)
    word = lambda: rng.choice(["wé", "[[Alpha|a]]", "[[B]]", "![i](q.png)", "text", "中文", "\n"])
    rows = []
    for i in range(12):
        body = " ".join(word() for _ in range(rng.randint(5, 80)))
        rows.append((f"d{i}", f"d{i}.md", f"# T{i}\n\n{body}\n\n## S\n\n![x y](p.png) {body}\n\n![gone](none.png)\n"))
    notes = spark.createDataFrame(rows, "doc string, path string, markdown string").repartition(3)
    images = spark.createDataFrame([(r[0], s, s + h, "image/png") for r in rows for s in ("p.png", "q.png") for h in "ab"], "doc string, source string, hash string, mime string")
    for budget, width in ((90, 64), (40, 50), (36, 7), (5, 9)):
        chunking = Chunking(max_tokens=budget, image_context=width)
        got = {(r.doc, r.source, r.start, r.end): r for r in image_units(parse_notes(notes), notes, images, chunking, lambda t, n: len(t) + 8 * n).collect()}
        total = 0
        for doc, path, text in rows:
            p = parse(doc, path, text)
            for m in p.media:
                total += 1
                k = next(k for k, s in enumerate(p.sections) if s["section"] == m["section"])
                end = p.sections[k + 1]["start"] if k + 1 < len(p.sections) else len(text)
                prefix = " > ".join(dict.fromkeys([p.title, *p.sections[k]["path"]])) + "\n\n"
                if m["source"] == "none.png":
                    assert got[doc, "none.png", m["start"], m["end"]].code == "MEDIA"
                    continue
                tries, w = [], width
                while True:
                    a, z = max(p.sections[k]["start"], m["start"] - w), min(end, m["end"] + w)
                    if len(prefix + source_text(text, a, z, p.media)) + 8 <= budget:
                        tries.append((a, z))
                    if not w:
                        break
                    w //= 2
                if tries:
                    r = got[doc, m["source"], *tries[0]]
                    assert r.text == prefix + source_text(text, *tries[0], p.media) and r.tokens == len(r.text) + 8 <= budget and r.media_hash == m["source"] + "a"
                else:
                    assert got[doc, m["source"], m["start"], m["end"]].code == "LIMIT"
        assert total == len(got) or budget == 90
    assert image_units(parse_notes(notes.limit(0)), notes, images).collect() == []
