"""Sources: a folder of Markdown files, ignore rules, scopes, media."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scan(spark: SparkSession, root: str, rules: str = "") -> DataFrame:
    """(path, markdown, bytes, hash) of the Markdown files under root, read whole so that CRLF and BOM survive.

    Files under a dot folder, ``AGENTS.md``, ignored paths and invalid UTF-8 are left out; paths are
    relative to root.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/")) + "/"
    rel = F.substring_index(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), base, -1)
    rows = files.select(rel.alias("path"), "content", F.col("length").alias("bytes"))
    rows = rows.where(F.lower("path").endswith(".md") & ~F.col("path").rlike(r"(?:^|/)\.") & ~F.col("path").rlike(r"(?:^|/)AGENTS\.md$"))
    rows = rows.where(kept_by(F.col("path"), rules)) if rules.strip() else rows
    return rows.where(F.expr("is_valid_utf8(CAST(content AS STRING))")).select("path", F.col("content").cast("string").alias("markdown"), "bytes", F.sha2("content", 256).alias("hash"))


def _glob(body: str) -> str:
    """The regular expression of a pattern: ``*`` and ``?`` stay inside a name, ``**`` spans folders, classes and escapes are kept."""
    out, i = "", 0
    while i < len(body):
        rest = body[i:]
        if rest.startswith("**/") and (i == 0 or body[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif rest == "**" and i and body[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif rest[0] == "*":
            out, i = out + "[^/]*", i + len(rest) - len(rest.lstrip("*"))
        elif rest[0] == "?":
            out, i = out + "[^/]", i + 1
        elif (m := re.match(r"\[([!^]?)(\]?(?:\\.|[^\]\\])*)\]", rest)) and m[2]:
            inner = re.sub(r"\\(.)|([\[\]&^])", lambda x: re.escape(x[1] or x[2]), m[2])
            out, i = out + f"(?!/)[{'^' if m[1] else ''}{inner}]", i + m.end()
        elif rest[0] == "\\" and len(rest) > 1:
            out, i = out + re.escape(rest[1]), i + 2
        else:
            out, i = out + re.escape(rest[0]), i + 1
    return out


def compile_rules(rules: str) -> list[tuple[str, bool, bool]]:
    r"""Ignore rules as (regex, ignore, folders only) in order.

    ``!`` takes a path back, a leading or inner slash anchors, a trailing one means folders; ``\#``,
    ``\!`` and an escaped last space stand for themselves.
    """
    if len(rules) > 32_768 or "\0" in rules:
        raise ValueError("invalid ignore rules")
    out = []
    for line in rules.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line[keep:]
        body = line.strip("/")
        if body:
            anchored = "/" in line.rstrip("/")
            out.append((f"(?s)^{'' if anchored else '(?:.*/)?'}{_glob(body)}$", not keep, line.endswith("/")))
    return out


def kept_by(path: Column, rules: str, folder: bool = False) -> Column:
    """Whether the rules keep a path (``folder``: the path of a folder).

    A path is left out if the last rule that fits it says so, or any folder above it is left out:
    no rule takes a file back from an ignored folder. Null for paths that are absolute, empty or
    hold empty parts or ``..``; ``./`` in front and a slash at the end do not count.
    """
    clean = F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "^\\./", ""), "/$", "")
    compiled = compile_rules(rules)

    def ignored(place: Column, is_folder: Column) -> Column:
        out = F.lit(False)
        for pattern, ignore, folders in compiled:
            fits = place.rlike(pattern) & is_folder if folders else place.rlike(pattern)
            out = F.when(fits, F.lit(ignore)).otherwise(out)
        return out

    parts = F.split(clean, "/")
    size = F.size(parts)
    above = F.exists(F.sequence(F.lit(1), size), lambda i: ignored(F.array_join(F.slice(parts, F.lit(1), i), "/"), (i < size) | F.lit(folder)))
    return F.when((clean == "") | F.exists(parts, lambda x: x.isin("", "..")), None).otherwise(~above)


def scope(paths: DataFrame, rules: str) -> DataFrame:
    """(folder, included, excluded) for every folder and all above it; files at the root count under the empty name."""
    parts = F.split("path", "/")
    folders = F.when(F.size(parts) == 1, F.array(F.lit(""))).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")))
    rows = paths.select(F.explode(folders).alias("folder"), kept_by(F.col("path"), rules).alias("kept"))
    return rows.groupBy("folder").agg(F.count_if("kept").alias("included"), F.count_if(~F.col("kept")).alias("excluded"))


def _below(spark: SparkSession, root: str) -> tuple[DataFrame, Column]:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/")) + "/"
    return files, F.substring_index(F.url_decode(F.regexp_replace("path", r"\+", "%2B")), base, -1)


def list_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the Markdown files under root, sorted; no file is opened, the scan reads names alone."""
    files, rel = _below(spark, root)
    rows = files.select(rel.alias("path"))
    return rows.where(F.lower("path").endswith(".md") & ~F.col("path").rlike(r"(?:^|/)\.") & ~F.col("path").rlike(r"(?:^|/)AGENTS\.md$")).orderBy("path")


#: What a browser may open at once: files, bytes of one, bytes of all.
DIRECTORY_LIMITS = (1000, 4 << 20, 32 << 20)


def scan_directory(spark: SparkSession, root: str, rules: str = "", limits: tuple[int, int, int] = DIRECTORY_LIMITS) -> DataFrame:
    """As scan(), of ``.md`` and ``.markdown`` files; ValueError beyond the limits, which are found from the listing alone."""
    files, rel = _below(spark, root)
    rows = files.withColumn("file", rel).where(F.lower("file").rlike(r"\.(?:md|markdown)$") & ~F.col("file").rlike(r"(?:^|/)\."))
    rows = rows.where(kept_by(F.col("file"), rules)) if rules.strip() else rows
    n, largest, total = rows.agg(F.count("*"), F.coalesce(F.max("length"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0))).first()
    if n > limits[0] or largest > limits[1] or total > limits[2]:
        raise ValueError(f"{n} files, the largest of {largest} bytes and {total} in all, are over the limits {limits}")
    valid = rows.where(F.expr("is_valid_utf8(CAST(content AS STRING))"))
    return valid.select(F.col("file").alias("path"), F.col("content").cast("string").alias("markdown"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("hash"))


def media(spark: SparkSession, root: str, references: DataFrame, largest: int = 8 << 20) -> DataFrame:
    """references (doc, folder, source) with hash and data: the first of document-relative, root-relative and ``Attachments/`` that exists."""
    base = re.sub(r"^[a-z]+:/+", "/", root.rstrip("/")) + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).where(F.lower("path").rlike(r"\.(?:png|jpe?g|webp|gif)$") & (F.col("length") <= largest))
    files = files.select(F.substring_index(F.url_decode("path"), base, -1).alias("file"), "content")
    tries = F.posexplode(F.array(F.concat("folder", "source"), F.col("source"), F.concat(F.lit("Attachments/"), "source")))
    tried = references.select("doc", "folder", "source", tries.alias("priority", "file")).join(files, "file")
    return tried.groupBy("doc", "source").agg(F.min_by(F.struct(F.sha2("content", 256).alias("hash"), F.base64("content").alias("data")), "priority").alias("m")).select("doc", "source", "m.hash", "m.data")
