"""Text functions over columns: name and path keys, paths, UTF-16 offsets."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .policy import GENERIC_NAMES

#: Words of the regex tokeniser, and what may not touch an exact match.
WORD = r"[\p{L}\p{N}_]+"
IDENTITY = r"[\p{L}\p{N}_.$+/#:-]"


def _compositions() -> str:
    """Every letter that NFC composes of two: first, second, letter and a separator, by rule from the character database."""
    out = []
    for i in range(0xC0, 0x30000):
        c = chr(i)
        pair = unicodedata.decomposition(c)
        if pair and not pair.startswith("<") and len(pair.split()) == 2 and unicodedata.normalize("NFC", c) == c:
            out.append("".join(chr(int(x, 16)) for x in pair.split()) + c + "\0")
    return "".join(out)


def _folds() -> tuple[str, str]:
    """Lower-case letters with marks, and the letters that they are marked forms of."""
    marked, plain = [], []
    for i in range(0xC0, 0x2000):
        c = chr(i)
        base = "".join(x for x in unicodedata.normalize("NFD", c) if not unicodedata.combining(x))
        if c.lower() == c and len(base) == 1 and base != c:
            marked.append(c)
            plain.append(base)
    return "".join(marked), "".join(plain)


_COMPOSED, (_MARKED, _PLAIN) = _compositions(), _folds()


def _ascii(s: Column) -> Column:
    """Whether a text has a byte for each character."""
    return F.octet_length(s) == F.char_length(s)


def nfc(s: Column) -> Column:
    """Letters and the marks after them composed as NFC does, in the JVM. Only text with marks is taken apart.

    Marks are taken in the order they stand in; Hangul that is spelt in single jamo stays so.
    """

    def step(a: Column, c: Column) -> Column:
        at = F.instr(F.lit(_COMPOSED), F.concat(a["last"], c))
        joined = F.struct(a["done"].alias("done"), F.substring(F.lit(_COMPOSED), at + 2, F.lit(1)).alias("last"))
        return F.when((a["last"] != "") & (at > 0) & c.rlike(r"^\p{M}$"), joined).otherwise(F.struct(F.concat(a["done"], a["last"]).alias("done"), c.alias("last")))

    whole = F.aggregate(F.split(s, ""), F.struct(F.lit("").alias("done"), F.lit("").alias("last")), step, lambda a: F.concat(a["done"], a["last"]))
    return F.when(_ascii(s), s).when(s.rlike(r"\p{M}"), whole).otherwise(s)


def fold_marks(s: Column) -> Column:
    """Lower case without combining marks; ASCII text is only lowered."""
    low = F.lower(s)
    return F.when(_ascii(s), low).otherwise(F.regexp_replace(F.translate(low, _MARKED, _PLAIN), r"\p{M}", ""))


def name_key(name: Column) -> Column:
    """The key of a name: trimmed, NFC, lower case."""
    return F.lower(nfc(F.trim(name)))


def admissible(key: Column, allow_short: Column | None = None) -> Column:
    """Whether a name may be mentioned: none of the generic ones, and of two characters at least unless short names are allowed."""
    long = F.char_length(key) >= 2
    return ~key.isin(*GENERIC_NAMES) & (long if allow_short is None else long | allow_short)


def path_key(path: Column) -> Column:
    """A path without ``.md``; case matters."""
    return F.regexp_replace(path, r"(?i)\.md$", "")


def normal_path(path: Column) -> Column:
    """A path relative to the root, with ``/`` and without ``.`` and ``..``; null for absolute, empty or escaping ones."""
    p = F.translate(path, "\\", "/")
    step = lambda a, x: F.when(a.isNull() | x.isin("", "."), a).when(x == "..", F.when(F.size(a) == 0, F.lit(None)).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))).otherwise(F.array_append(a, x))
    parts = F.aggregate(F.split(p, "/"), F.expr("CAST(array() AS array<string>)"), step)
    return F.when(p.rlike(r"^(?:/|[A-Za-z]:)") | (F.size(parts) < 1), None).otherwise(F.array_join(parts, "/"))


def utf16_length(text: Column) -> Column:
    """UTF-16 units of a text: characters, and one more for each beyond U+FFFF."""
    return F.char_length(text) + F.regexp_count(text, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def round12(x: Column) -> Column:
    return F.round(x, 12)
