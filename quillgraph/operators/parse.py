"""Markdown notes to sections, text spans, links and media, with exact offsets.

``blocks`` gives the leaves of a note's nested blocks; within these inline code, links, images,
autolinks, HTML, footnote marks, WikiLinks, embeds and bare addresses are told from text. Offsets
are characters of the source; functions.text.utf16_length converts.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from . import blocks

VERSION = "1"

_CODE = re.compile(r"(`+)(?!`)(?:(?!\1(?!`)).|\n)*?(?<!`)\1(?!`)", re.S)
_WIKI = re.compile(r"(!?)\[\[([^\[\]\n|]+)(?:\|([^\[\]\n]*))?\]\]")
_IMAGE = re.compile(r"!\[([^\]]*)\](?:\(\s*<?([^\s)>]*)>?(?:\s+[\"'(][^)]*[\"')])?\s*\)|\[([^\]]*)\])")
_LINK = re.compile(r"\[(?:[^\[\]\n]|\[[^\[\]]*\])*\](?:\([^()\n]*(?:\([^()]*\)[^()\n]*)*\)|\[[^\]\n]*\])")
_AUTO = re.compile(r"<[A-Za-z][A-Za-z0-9+.-]*:[^\s<>]*>|<[^\s<>@]+@[^\s<>]+>")
_HTML = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_NOTE = re.compile(r"\[\^[^\]\s]+\]")
_URL = re.compile(r"(?:https?://|www\.)[^\s<>]+", re.I)


@dataclass
class Parsed:
    title: str = ""
    names: list[tuple[str, str]] = field(default_factory=list)
    sections: list[dict] = field(default_factory=list)
    spans: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    media: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    content_start: int = 0


def _frontmatter(text: str, at: int, out: Parsed) -> tuple[str | None, int]:
    m = re.compile(r"---[ \t]*\r?\n(.*?)(?:^|\r?\n)(?:---|\.\.\.)[ \t]*(?:\r?\n|$)", re.S | re.M).match(text, at)
    if not m:
        return None, at
    import yaml

    data = yaml.safe_load(m[1])
    title = None
    if isinstance(data, dict):
        if isinstance(data.get("title"), str) and data["title"].strip():
            title = data["title"].strip()
            out.names.append((title, "frontmatter"))
        aliases = data.get("aliases", [])
        for a in [aliases] if isinstance(aliases, str) else aliases if isinstance(aliases, list) else []:
            if isinstance(a, str) and a.strip():
                out.names.append((a.strip(), "alias"))
            else:
                out.warnings.append("alias is not text")
    return title, m.end()


def _subtract(start: int, end: int, holes: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    for a, b in sorted(holes):
        if b <= start or a >= end:
            continue
        if a > start:
            yield start, a
        start = max(start, b)
    if start < end:
        yield start, end


def _escaped(text: str, at: int) -> bool:
    n = 0
    while at - n - 1 >= 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


def parse(doc: str, path: str, text: str) -> Parsed:
    """Everything that a note holds. Sections: the root over all of it, then each heading until one of its depth or less."""
    out = Parsed()
    stem = re.sub(r"(?i)\.md$", "", path.rsplit("/", 1)[-1])
    out.names.append((stem, "filename"))
    at = 1 if text.startswith("﻿") else 0
    title, at = _frontmatter(text, at, out)
    out.content_start = at
    leaves, definitions = blocks.scan(text, at)
    heads = [(b.start, b.depth, b.text(text)) for b in leaves if b.kind == "heading"]

    out.sections.append({"section": f"{doc}:root", "title": "", "path": [], "depth": 0, "start": 0, "end": len(text)})
    stack: list[tuple[int, str]] = []
    seen: dict[str, int] = {}
    for start, depth, name in heads:
        while stack and stack[-1][0] >= depth:
            stack.pop()
        plain = _LINK.sub(lambda m: m[0][1 : m[0].index("]")], _WIKI.sub(lambda m: m[3] or m[2], name))
        plain = re.sub(r"\\([!-/:-@\[-`{-~])|[*_`]+", lambda m: m[1] or "", plain)
        plain = " ".join(html.unescape(re.sub(r"&(?![A-Za-z0-9#]+;)", "&amp;", plain)).split())
        stack.append((depth, plain))
        key = json.dumps([unicodedata.normalize("NFC", t) for _, t in stack], ensure_ascii=False, separators=(",", ":"))
        number = seen.get(key, 0)
        seen[key] = number + 1
        for s in out.sections[1:]:
            if s["end"] == len(text) and s["depth"] >= depth and s["start"] < start and not s.get("closed"):
                s["end"], s["closed"] = start, True
        out.sections.append({"section": f"{doc}:section:{key}:{number}", "title": plain, "path": [t for _, t in stack], "depth": depth, "start": start, "end": len(text)})
        if depth == 1 and not any(k == "heading" for _, k in out.names):
            out.names.append((plain, "heading"))
    for s in out.sections:
        s.pop("closed", None)
    h1 = next((n for n, k in out.names if k == "heading"), None)
    out.title = title or h1 or stem

    starts = [s["start"] for s in out.sections]

    def section_at(offset: int) -> str:
        import bisect

        return out.sections[bisect.bisect_right(starts, offset) - 1]["section"]

    for leaf in leaves:
        piece, block, place = leaf.text(text), f"{doc}:block:{leaf.start}", leaf.places()
        holes = [m.span() for m in _CODE.finditer(piece)]
        inside = lambda a: any(x <= a < y for x, y in holes)  # noqa: E731, B023
        for pattern in (_WIKI, _IMAGE, _LINK, _AUTO, _HTML, _NOTE, _URL):
            for m in pattern.finditer(piece):
                if inside(m.start()) or _escaped(piece, m.start()):
                    continue
                holes.append(m.span())
                a, b = place.of(m.start()), place.end(m.end())
                if pattern is _WIKI and not m[1]:
                    out.links.append({"start": a, "end": b, "target": m[2].strip(), "label": (m[3] or m[2]).strip(), "section": section_at(a), "block": block})
                elif pattern is _WIKI:
                    size = re.fullmatch(r"\d+(?:x\d+)?", (m[3] or "").strip())
                    out.media.append({"source": m[2].strip(), "alt": "" if size else (m[3] or "").strip(), "start": a, "end": b, "section": section_at(a)})
                elif pattern is _IMAGE:
                    source = m[2] or definitions.get(" ".join((m[3] or m[1]).lower().split()))
                    if source:
                        out.media.append({"source": source, "alt": m[1], "start": a, "end": b, "section": section_at(a)})
        for a, b in _subtract(0, len(piece), holes):
            # Emphasis marks split a block's text.
            for m in re.finditer(r"[^*~\n]+", piece[a:b]):
                if m[0].strip():
                    s = place.of(a + m.start())
                    out.spans.append({"start": s, "end": s + len(m[0]), "section": section_at(s), "block": block, "text": m[0]})
    out.spans.sort(key=lambda s: s["start"])
    out.links.sort(key=lambda s: s["start"])
    return out


_SCHEMA = (
    "doc string", "title string", "content_start long", "warnings array<string>", "names array<struct<name:string,source:string>>",
    "sections array<struct<section:string,title:string,path:array<string>,depth:int,start:long,end:long>>",
    "spans array<struct<start:long,end:long,section:string,block:string,text:string>>",
    "links array<struct<start:long,end:long,target:string,label:string,section:string,block:string>>",
    "media array<struct<source:string,alt:string,start:long,end:long,section:string>>", "error string",
)
#: Characters of notes, and notes, that a task parses before it hands their rows on.
PIECE, NOTES = 1 << 18, 256


def pieces(batches: Iterator[pa.RecordBatch], text: str, size: int = PIECE, rows: int = NOTES) -> Iterator[pa.RecordBatch]:
    """Slices of batches, of about ``size`` characters in the column ``text`` and of ``rows`` rows at most: what a task makes of them is as bounded."""
    for b in batches:
        if not len(b):
            continue
        ends = np.cumsum(pc.fill_null(pc.utf8_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < len(b):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
            to = min(max(at + 1, to), at + rows, len(b))
            yield b.slice(at, to - at)
            at = to


_NAMES = ("doc", "title", "content_start", "warnings", "names", "sections", "spans", "links", "media", "error")


def parse_notes(notes: DataFrame, columns: tuple[str, ...] = _NAMES) -> DataFrame:
    """notes (doc, path, markdown), parsed; a note whose frontmatter is broken has an error and nothing else.

    columns: those that are wanted; doc always comes. A task holds the rows of some notes at a time.
    """
    kept = tuple(c for c in _NAMES if c == "doc" or c in columns)
    fields = [f for f in _SCHEMA if f.split()[0] in kept]
    types = to_arrow_schema(_parse_datatype_string(", ".join(fields)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "markdown"):
            out = {c: [] for c in kept}
            for doc, path, markdown in zip(*(b.column(c).to_pylist() for c in ("doc", "path", "markdown")), strict=True):
                try:
                    x = parse(doc, path, markdown)
                    row = {"doc": doc, "title": x.title, "content_start": x.content_start, "warnings": x.warnings, "names": [{"name": n, "source": s} for n, s in x.names], "sections": x.sections, "spans": x.spans, "links": x.links, "media": x.media, "error": None}
                except Exception as e:  # of the YAML reader: the row says so
                    row = {"doc": doc, "title": None, "content_start": 0, "warnings": [], "names": [], "sections": [], "spans": [], "links": [], "media": [], "error": str(e)}
                for c in kept:
                    out[c].append(row[c])
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in types], schema=types)

    return notes.select("doc", "path", "markdown").mapInArrow(run, ", ".join(fields))


def child(parsed: DataFrame, column: str) -> DataFrame:
    """One of the nested tables of parsed notes: names, sections, spans, links or media."""
    return parsed.select("doc", F.explode(column).alias("_x")).select("doc", "_x.*")


def assign_sections(offsets: DataFrame, sections: DataFrame) -> DataFrame:
    """offsets (doc, at) with the last section that starts at or before them: an as-of join by one sort per document."""
    rows = offsets.select("doc", F.col("at"), F.lit(None).cast("string").alias("section"), F.lit(1).alias("_k")).unionByName(sections.select("doc", F.col("start").alias("at"), "section", F.lit(0).alias("_k")))
    order = W.partitionBy("doc").orderBy("at", "_k").rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.last("section", ignorenulls=True).over(order)).where("_k = 1").drop("_k")


def own_texts(notes: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections with the text from their start to the next section's start."""
    following = F.lead("start").over(W.partitionBy("doc").orderBy("start", "depth"))
    rows = sections.withColumn("_next", following).join(notes.select("doc", "markdown"), "doc")
    stop = F.coalesce("_next", F.char_length("markdown").cast("long"))
    return rows.withColumn("text", F.substring("markdown", (F.col("start") + 1).cast("int"), (stop - F.col("start")).cast("int"))).drop("_next", "markdown")
