"""Knowledge units: sections cut into chunks under a token budget."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..functions.policy import Chunking
from .parse import pieces


def upper_tokens(text: Column) -> Column:
    """An upper bound of a text's tokens: its UTF-8 bytes and 32."""
    return F.octet_length(text) + 32


def fixed_chunks(notes: DataFrame, size: int) -> DataFrame:
    """(doc, chunk, text, tokens): pieces of ``size`` characters; an empty note has none."""
    pieces = F.ceil(F.char_length("markdown") / F.lit(size)).cast("int")
    rows = notes.where(F.char_length("markdown") > 0).select("doc", "markdown", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("n"))
    rows = rows.select("doc", F.col("n").cast("long").alias("chunk"), F.substring("markdown", F.col("n") * size + 1, F.lit(size)).alias("text"))
    return rows.withColumn("tokens", upper_tokens(F.col("text")))


def cut_section(text: str, prefix: str, budget: int, count: Callable[[str], int]) -> list[tuple[int, int]]:
    """(start, end) of the chunks of a section's text, each with the prefix within the budget.

    The longest prefix of the rest is searched by halving; it ends at the last sentence or line
    break beyond 60 % of it, and shrinks by characters while the count is over the budget.
    """
    out, at = [], 0
    while at < len(text):
        if count(prefix + text[at:]) <= budget:
            out.append((at, len(text)))
            break
        low, high = 0, len(text) - at
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if count(prefix + text[at : at + middle]) <= budget else (low, middle - 1)
        end = low
        breaks = max((text.rfind(b, at, at + low) + len(b) - at for b in ("\n\n", "\n", "。", ". ", "! ", "? ") if text.rfind(b, at, at + low) >= 0), default=0)
        if breaks > 0.6 * low:
            end = breaks
        while end and count(prefix + text[at : at + end]) > budget:
            end -= 1
        if not end:
            raise ValueError("LIMIT: nothing fits the token budget")
        out.append((at, at + end))
        at += end
    return out


def knowledge_units(sections: DataFrame, chunking: Chunking = Chunking(), count: Callable[[str], int] = len) -> DataFrame:
    """(doc, section, unit, start, end, text, tokens, content_hash, error) of sections.

    sections: doc, title, section, path (titles from the root), start and own text (up to the
    next section's start). Blank sections give nothing; a section of which nothing fits gives a
    row with an error. ``count`` counts tokens of a text.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for r in p.itertuples():
                if not r.text.strip():
                    continue
                titles = list(dict.fromkeys([t for t in [r.title, *r.path] if t]))
                prefix = " > ".join(titles) + "\n\n" if titles else ""
                try:
                    cuts = cut_section(r.text, prefix, chunking.max_tokens, count)
                except ValueError as e:
                    out.append((r.doc, r.section, None, r.start, r.start, None, 0, None, str(e)))
                    continue
                for a, b in cuts:
                    text = prefix + r.text[a:b]
                    unit = hashlib.sha256(json.dumps([r.section, r.start + a, r.start + b, []], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
                    digest = hashlib.sha256(json.dumps([text, []], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
                    out.append((r.doc, r.section, f"{r.doc}:unit:{unit}", r.start + a, r.start + b, text, count(text), digest, None))
            yield pd.DataFrame(out, columns=["doc", "section", "unit", "start", "end", "text", "tokens", "content_hash", "error"])

    return sections.select("doc", "title", "section", "path", "start", "text").mapInPandas(run, "doc string, section string, unit string, start long, end long, text string, tokens long, content_hash string, error string")


def source_text(markdown: str, start: int, end: int, media: list[dict]) -> str:
    """A slice of a note as it is embedded: images inside it are their alternative texts, WikiLinks their labels."""
    text = markdown[start:end]
    for m in sorted((m for m in media if m["start"] >= start and m["end"] <= end), key=lambda m: -m["start"]):
        text = text[: m["start"] - start] + m["alt"] + text[m["end"] - start :]
    return re.sub(r"\[\[([^\]\n]+)\]\]", lambda m: m[1].split("|", 1)[1] if "|" in m[1] else m[1], text)


def image_window(markdown: str, image: dict, media: list[dict], bounds: tuple[int, int], prefix: str, chunking: Chunking, count: Callable[[str, int], int]) -> tuple[int, int, str, int]:
    """(start, end, text, tokens) of the widest window around an image that fits: the configured width, halved until it does, or none at last."""
    width = chunking.image_context
    while True:
        start, end = max(bounds[0], image["start"] - width), min(bounds[1], image["end"] + width)
        text = prefix + source_text(markdown, start, end, media)
        tokens = count(text, 1)
        if tokens <= chunking.max_tokens:
            return start, end, text, tokens
        if not width:
            raise ValueError("image and title exceed the token budget")
        width //= 2


def image_units(parsed: DataFrame, notes: DataFrame, images: DataFrame, chunking: Chunking = Chunking(), count: Callable[[str, int], int] = lambda text, images: len(text.encode()) + 32) -> DataFrame:
    """A row for each image of a note: doc, section, unit, start, end, text, tokens, content_hash, source, media_hash, code, error.

    parsed: as parse_notes gives; notes: doc, markdown; images: doc, source, hash, mime of those that
    were found. A unit is the image with the text of its section around it, within the token
    budget; ``count`` takes a text and a number of images. An image that was not found, or that
    fits with no context at all, has a code (MEDIA, LIMIT) and an error instead. A source that is
    found twice for a document counts once, with the smallest hash. A note's text travels once,
    however many images it has.
    """
    found = images.groupBy("doc", "source").agg(F.min(F.struct("hash", "mime")).alias("m")).groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("source", "m"))).alias("images"))
    rows = parsed.where(F.size("media") > 0).select("doc", "title", "sections", "media").join(notes.select("doc", "markdown"), "doc").join(found, "doc", "left")

    fields = "doc string, section string, unit string, start long, end long, text string, tokens long, content_hash string, source string, media_hash string, code string, error string"
    types = to_arrow_schema(_parse_datatype_string(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "markdown"):
            out = []
            for doc, title, sections, media, markdown, known in zip(*(b.column(c).to_pylist() for c in ("doc", "title", "sections", "media", "markdown", "images")), strict=True):
                place = {s["section"]: k for k, s in enumerate(sections)}
                for image in media:
                    k = place[image["section"]]
                    bounds = sections[k]["start"], sections[k + 1]["start"] if k + 1 < len(sections) else len(markdown)
                    prefix = " > ".join(dict.fromkeys([title, *sections[k]["path"]])) + "\n\n"
                    held = dict(known).get(image["source"]) if known is not None else None
                    base = (doc, image["section"])
                    if held is None:
                        out.append((*base, None, image["start"], image["end"], None, 0, None, image["source"], None, "MEDIA", "the image was not found"))
                        continue
                    try:
                        start, end, text, tokens = image_window(markdown, image, list(media), bounds, prefix, chunking, count)
                    except ValueError as e:
                        out.append((*base, None, image["start"], image["end"], None, 0, None, image["source"], held["hash"], "LIMIT", str(e)))
                        continue
                    unit = _digest([image["section"], int(start), int(end), [image["source"]]])
                    out.append((*base, f"{doc}:unit:{unit}", start, end, text, tokens, _digest([text, [[held["hash"], held["mime"]]]]), image["source"], held["hash"], None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [()] * len(types), types, strict=True)], schema=types)

    return rows.mapInArrow(run, fields)


def _digest(value: list) -> str:
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
