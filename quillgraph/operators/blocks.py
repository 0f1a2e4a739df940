"""The block structure of a Markdown note: a stack of open containers, advanced line by line.

Quotes, list items and footnotes hold other blocks; each line first continues the open ones that it
can, then opens new ones, and what is left goes to a leaf. A leaf keeps the pieces of its lines
without the containers' marks, as places in the source. A paragraph takes a line that continues
none of its containers, unless the line opens a block of its own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

# Fixed values of the format: names whose tags open an HTML block that ends at a blank line.
HTML_NAMES = (
    "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|"
    "h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|"
    "thead|title|tr|track|ul"
)
_TAG = r"<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>"
#: What opens an HTML block, and what ends it (None: a blank line).
_HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(rf"</?(?:{HTML_NAMES})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:{_TAG})\s*$"), None),
]
_FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
_ATX = re.compile(r"(#{1,6})(?:[ \t]+|$)")
_ATX_END = re.compile(r"(?:[ \t]+#+|^#+)?[ \t]*$")
_SETEXT = re.compile(r"(=+|-+)[ \t]*$")
_BREAK = re.compile(r"(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"([-*+]|(\d{1,9})[.)])(?=[ \t]|$)")
_NOTE = re.compile(r"\[\^[^\]\s]+\]:[ \t]*")
_ROW = re.compile(r"[ \t]*\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_DEFINITION = re.compile(r"\[((?:[^\[\]\\]|\\.)+)\]:\s*(?:<([^<>\n]*)>|(\S+))[ \t]*(?:\n?[ \t]*(?:\"[^\"]*\"|'[^']*'|\([^()]*\))[ \t]*)?(?:\n|$)")


@dataclass
class Block:
    """A leaf: paragraph, heading or cell, with the places of its lines' pieces in the source."""

    kind: str
    start: int
    pieces: list[tuple[int, int]]
    depth: int = 0

    def text(self, source: str) -> str:
        return "\n".join(source[a:b] for a, b in self.pieces)

    def places(self) -> Places:
        return Places(self.pieces)


class Places:
    """From offsets in a block's joined text to the source."""

    def __init__(self, pieces: list[tuple[int, int]]):
        self.pieces, self.heads = pieces, [0]
        for a, b in pieces[:-1]:
            self.heads.append(self.heads[-1] + b - a + 1)

    def of(self, at: int) -> int:
        k = bisect_right(self.heads, at) - 1
        return self.pieces[k][0] + at - self.heads[k]

    def end(self, at: int) -> int:
        """The source's place after the character before ``at``."""
        return self.of(at - 1) + 1 if at else self.of(0)


@dataclass
class _Container:
    kind: str  # quote or item
    indent: int = 0
    empty: bool = False


@dataclass
class _Line:
    """A cursor over a line: its place, its column, and columns of a tab that are not used up."""

    text: str
    base: int
    at: int = 0
    column: int = 0
    spare: int = 0

    def indent(self) -> int:
        n, column = self.spare, self.column + self.spare
        for c in self.text[self.at :]:
            if c not in " \t":
                break
            step = 4 - column % 4 if c == "\t" else 1
            n, column = n + step, column + step
        return n

    def skip(self, columns: int) -> None:
        while columns > 0 and (self.spare or self.text[self.at : self.at + 1] in (" ", "\t")):
            if not self.spare:
                self.spare = 4 - self.column % 4 if self.text[self.at] == "\t" else 1
                self.at += 1
            step = min(columns, self.spare)
            self.spare, self.column, columns = self.spare - step, self.column + step, columns - step

    def take(self, n: int) -> None:
        self.at, self.column = self.at + n, self.column + n

    def rest(self) -> str:
        return self.text[self.at :]


@dataclass
class Scanner:
    """Feed lines; ``blocks`` and ``definitions`` (label to address) are the result."""

    blocks: list[Block] = field(default_factory=list)
    definitions: dict[str, str] = field(default_factory=dict)
    stack: list[_Container] = field(default_factory=list)
    paragraph: list[tuple[int, int]] = field(default_factory=list)
    words: list[str] = field(default_factory=list)
    #: What holds lines until it ends: a fence, HTML or a table.
    fence: tuple[str, int] | None = None
    html: re.Pattern | str | None = None
    table: int = 0
    in_code: bool = False

    def _close_leaf(self) -> None:
        if self.paragraph:
            pieces, text = self.paragraph, "\n".join(self.words)
            at = 0
            while m := _DEFINITION.match(text, at):
                self.definitions.setdefault(" ".join(m[1].lower().split()), m[2] if m[2] is not None else m[3])
                at = m.end()
            gone = text.count("\n", 0, at) if at < len(text) else len(pieces)
            if pieces[gone:]:
                self.blocks.append(Block("paragraph", pieces[gone][0], pieces[gone:]))
        self.paragraph, self.words, self.fence, self.html, self.table, self.in_code = [], [], None, None, 0, False

    def _pop_to(self, n: int) -> None:
        if len(self.stack) > n:
            self._close_leaf()
            del self.stack[n:]

    def _continued(self, line: _Line) -> int:
        """How many open containers the line continues."""
        for n, c in enumerate(self.stack):
            blank = not line.rest().strip()
            if c.kind == "quote":
                if line.indent() > 3 or not line.rest().lstrip(" \t").startswith(">"):
                    return n
                line.skip(3)
                line.take(1)
                line.skip(1)
            elif blank:
                if c.empty:
                    return n
            elif line.indent() >= c.indent:
                line.skip(c.indent)
            else:
                return n
        return len(self.stack)

    def _opens(self, line: _Line, lazy: bool) -> bool:
        """Open a container at the cursor, if one starts here."""
        lead = line.indent()
        rest = line.rest().lstrip(" \t")
        if lead > 3:
            return False
        if rest.startswith(">"):
            self._close_leaf()
            line.skip(3)
            line.take(1)
            line.skip(1)
            self.stack.append(_Container("quote"))
            return True
        if m := _NOTE.match(rest):
            self._close_leaf()
            line.skip(lead)
            line.take(m.end())
            self.stack.append(_Container("item", 4))
            return True
        m = _ITEM.match(rest)
        if not m or _BREAK.match(rest):
            return False
        after = rest[m.end() :]
        if self.paragraph and not lazy and (not after.strip() or (m[2] and int(m[2]) != 1)):
            return False
        self._close_leaf()
        line.skip(lead)
        line.take(m.end())
        gap = line.indent()
        empty = not after.strip()
        width = 1 if empty or gap > 4 else gap
        line.skip(width)
        self.stack.append(_Container("item", lead + m.end() + width, empty))
        return True

    def _cells(self, line: _Line) -> None:
        for cell in re.finditer(r"(?:\\.|[^|\\])+", line.rest()):
            inner = cell[0].strip()
            if inner:
                a = line.base + line.at + cell.start() + cell[0].index(inner)
                self.blocks.append(Block("cell", a, [(a, a + len(inner))]))

    def feed(self, text: str, base: int) -> None:
        line = _Line(text, base)
        matched = self._continued(line)
        whole = matched == len(self.stack)
        blank = not line.rest().strip()
        if whole and self.fence:
            mark, size = self.fence
            if line.indent() < 4 and re.fullmatch(rf"{re.escape(mark)}{{{size},}}", line.rest().strip()):
                self._close_leaf()
            return
        if whole and self.html:
            if self.html == "blank":
                if blank:
                    self._close_leaf()
            elif self.html.search(line.rest()):
                self._close_leaf()
            return
        if not whole and not self.paragraph:
            self._pop_to(matched)
        lazy = not whole and bool(self.paragraph)
        if blank:
            self._pop_to(matched)
            if not self.in_code:
                self._close_leaf()
            return
        opened = False
        while True:
            if line.indent() > 3 and (not self.paragraph or opened):
                break
            before = len(self.stack)
            if lazy and not opened and self._starts(line):
                self._pop_to(matched)
                lazy = False
                before = len(self.stack)
            if not self._opens(line, lazy):
                break
            if len(self.stack) > before:
                opened, lazy = True, False
        for c in self.stack:
            c.empty = c.empty and not line.rest().strip()
        self._leaf(line, lazy)

    def _starts(self, line: _Line) -> bool:
        """Whether a block begins here that a paragraph cannot take as its own."""
        rest = line.rest().lstrip(" \t")
        if line.indent() > 3:
            return False
        item = _ITEM.match(rest)
        return bool(
            rest.startswith(">") or _NOTE.match(rest) or _ATX.match(rest) or _FENCE.match(rest) or _BREAK.match(rest)
            or (item and rest[item.end() :].strip() and (not item[2] or int(item[2]) == 1)) or any(p.match(rest) for p, _ in _HTML[:-1])
        )

    def _leaf(self, line: _Line, lazy: bool) -> None:
        lead, rest = line.indent(), line.rest().strip(" \t")
        start = line.base + len(line.text) - len(line.rest().lstrip(" \t"))
        if not rest:
            return
        if lead > 3 and not self.paragraph:
            self.in_code = True
            return
        if self.in_code:
            self._close_leaf()
        if lead <= 3 and not lazy:
            if m := _FENCE.match(rest):
                self._close_leaf()
                mark = m[1] or m[2]
                self.fence = (mark[0], len(mark))
                return
            if m := _ATX.match(rest):
                self._close_leaf()
                inner = rest[m.end() :]
                inner = inner[: _ATX_END.search(inner).start()].rstrip()
                a = start + m.end()
                self.blocks.append(Block("heading", start, [(a, a + len(inner))], len(m[1])))
                return
            if self.paragraph and not self.table and (m := _SETEXT.match(rest)):
                pieces = self.paragraph
                self._close_leaf()
                if self.blocks and self.blocks[-1].pieces[-1:] == pieces[-1:]:
                    block = self.blocks.pop()
                    self.blocks.append(Block("heading", block.start, block.pieces, 1 if m[1][0] == "=" else 2))
                return
            if _BREAK.match(rest):
                self._close_leaf()
                return
            for k, (opens, ends) in enumerate(_HTML):
                if opens.match(rest) and not (self.paragraph and k == len(_HTML) - 1):
                    self._close_leaf()
                    if ends is None or not ends.search(rest):
                        self.html = ends or "blank"
                    return
            if self.table:
                self._cells(_Line(line.text.rstrip(), line.base, len(line.text) - len(line.rest().lstrip(" \t"))))
                return
            if len(self.paragraph) == 1 and "|" in self.words[0] and _ROW.match(rest) and ("|" in rest or ":" in rest):
                width = lambda s: len(re.findall(r"(?:\\.|[^|\\])+", s.strip().strip("|")))
                if width(self.words[0]) == width(rest):
                    (a, b), head = self.paragraph[0], self.words[0]
                    self.paragraph, self.words = [], []
                    self._cells(_Line(head, a))
                    self.table = 1
                    return
        self.paragraph.append((start, start + len(rest)))
        self.words.append(rest)

    def close(self) -> None:
        self._close_leaf()
        self.stack = []


def scan(text: str, at: int = 0) -> tuple[list[Block], dict[str, str]]:
    """The leaves of a note from an offset on, in order, and its reference definitions."""
    scanner = Scanner()
    for m in re.compile(r"[^\r\n]*(?:\r\n|\r|\n|$)").finditer(text, at):
        if m[0]:
            scanner.feed(m[0].rstrip("\r\n"), m.start())
    scanner.close()
    return sorted(scanner.blocks, key=lambda b: b.start), scanner.definitions
