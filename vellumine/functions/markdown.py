"""CommonMark's structure, as far as chunks and plain text need it.

``leaves`` reads lines into leaf blocks (headings, paragraphs, code, HTML, rules),
inside block quotes and list items of any depth; ``texts`` reads a block's inlines
into the runs of text that a reader sees. Tables and other extensions count as
paragraphs.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))??(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}([-*_])[ \t]*(?:\1[ \t]*){2,}$")
_FENCE = re.compile(r"( {0,3})(`{3,}(?=[^`]*$)|~{3,})")
_QUOTE = re.compile(r" {0,3}> ?")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])([ \t]+|$)")
_HTML = re.compile(r" {0,3}<(?:!--|[?!]|/?[A-Za-z][A-Za-z0-9-]*(?:[\s/>]|$))")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
_SPECIAL = re.compile(r"[\\`*_\[\]<&!]")
_INLINE = re.compile(r"\\(?P<escape>[!-/:-@\[-`{-~])|(?P<ticks>`+)|<(?P<link>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w.-]+)>|(?P<tag><!--.*?-->|<[?].*?[?]>|</?[A-Za-z][^<>]*>)|(?P<entity>&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)|(?P<run>\*+|_+)|(?P<open>!?\[)|(?P<close>\])", re.DOTALL)
_TARGET = re.compile(r"\(\s*(?:<[^<>\n]*>|(?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*)(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_LABEL = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")


@dataclass(slots=True)
class Leaf:
    """A block without blocks in it; ``level`` is a heading's, else 0."""

    kind: str
    start: int
    level: int = 0
    lines: list[str] = field(default_factory=list)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def leaves(text: str) -> list[Leaf]:
    """The leaf blocks of a text in order, with where their first lines begin."""
    out: list[Leaf] = []
    stack: list[int] = []  # open containers: -1 for a quote, else an item's indent
    open_: Leaf | None = None  # a paragraph, code or HTML that may go on
    fence = ""
    at = 0
    for raw in text.split("\n"):
        start, at = at, at + len(raw) + 1
        line = raw.rstrip("\r").expandtabs(4)
        depth = 0
        for own in stack:
            if own < 0:
                m = _QUOTE.match(line)
                if not m:
                    break
                line = line[m.end() :]
            elif not line.strip():
                line = ""
            elif _indent(line) >= own:
                line = line[own:]
            else:
                break
            depth += 1
        blank = not line.strip()
        if fence:
            if depth == len(stack):
                m = _FENCE.match(line)
                if m and m[2][0] == fence[0] and len(m[2]) >= len(fence) and not line[m.end() :].strip():
                    fence, open_ = "", None
                elif open_ is not None:
                    open_.lines.append(line)
                continue
            fence, open_ = "", None
        if open_ is not None and open_.kind == "html":
            if blank or depth < len(stack):
                open_ = None
            else:
                continue
        paragraph = open_ if open_ is not None and open_.kind == "text" else None
        # containers that begin on this line
        opened = False
        rest, kept = line, depth
        while not blank and _indent(rest) < 4:
            if m := _QUOTE.match(rest):
                stack[kept:], rest = [-1], rest[m.end() :]
            elif (m := _ITEM.match(rest)) and not _RULE.match(rest) and not (paragraph and not opened and depth == len(stack) and (not rest[m.end() :].strip() or m[2][:-1] not in ("", "1"))):
                wide = len(m[3]) if 0 < len(m[3]) < 5 and rest[m.end() :].strip() else 1
                width = len(m[1]) + len(m[2]) + wide
                stack[kept:], rest = [width], rest[width:]
            else:
                break
            kept, opened = kept + 1, True
            blank = not rest.strip()
        if opened:
            open_ = paragraph = None
        elif depth < len(stack) and not (paragraph and not blank and not _starts(rest)):
            # not a line that goes on with a paragraph further in
            stack, open_, paragraph = stack[:depth], None, None
        line = rest
        if blank:
            if open_ is not None and open_.kind == "code":
                open_.lines.append("")
            else:
                open_ = None
        elif paragraph and (m := _SETEXT.match(line)) and depth == len(stack):
            paragraph.kind, paragraph.level, open_ = "heading", 1 if m[1][0] == "=" else 2, None
        elif _RULE.match(line):
            out.append(Leaf("rule", start))
            open_ = None
        elif m := _ATX.match(line):
            out.append(Leaf("heading", start, len(m[1]), [m[2] or ""]))
            open_ = None
        elif m := _FENCE.match(line):
            fence, open_ = m[2], Leaf("code", start)
            out.append(open_)
        elif paragraph:
            paragraph.lines.append(line)
        elif open_ is not None and open_.kind == "code" and _indent(line) >= 4:
            open_.lines.append(line[4:])
        elif _indent(line) >= 4:
            open_ = Leaf("code", start, lines=[line[4:]])
            out.append(open_)
        elif _HTML.match(line):
            open_ = Leaf("html", start)
            out.append(open_)
        else:
            open_ = Leaf("text", start, lines=[line])
            out.append(open_)
    return out


def _starts(line: str) -> bool:
    """Whether a line would begin a block that ends a paragraph."""
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line))


def definitions(blocks: list[Leaf]) -> set[str]:
    """Labels that paragraphs define as links; the lines that do so are taken away."""
    found = set()
    for x in blocks:
        while x.kind == "text" and x.lines and (m := _DEFINITION.match(x.lines[0])):
            found.add(_folded(m[1]))
            del x.lines[0]
    return found


def _folded(label: str) -> str:
    return " ".join(label.split()).casefold()


def _space(c: str) -> bool:
    return c == "" or c.isspace()


def _mark(c: str) -> bool:
    return c != "" and not c.isalnum() and not c.isspace()


def texts(source: str, known: set[str] = frozenset()) -> list[str]:
    """Runs of visible text between marks; code spans and HTML have none."""
    if not _SPECIAL.search(source):
        return [source]
    # pieces: text, or None for a mark that separates texts
    pieces: list[str | None] = []
    runs: list[list] = []  # [piece, character, length left, opens, closes, length]
    brackets: list[tuple[int, int, int]] = []  # (piece, runs before, where its text begins)
    at, end = 0, len(source)
    while at < end:
        m = _INLINE.search(source, at)
        if not m:
            break
        if m.start() > at:
            pieces.append(source[at : m.start()])
        at, kind = m.end(), m.lastgroup
        if kind == "escape":
            pieces.append(m["escape"])
        elif kind == "ticks":
            close = next((x for x in re.finditer(r"`+", source[at:]) if len(x[0]) == len(m[0])), None)
            if close:
                pieces.append(None)
                at += close.end()
            else:
                pieces.append(m[0])
        elif kind == "link":
            pieces += [None, m["link"], None]
        elif kind == "tag":
            pieces.append(None)
        elif kind == "entity":
            pieces.append(html.unescape(m[0]))
        elif kind == "run":
            before, after = source[m.start() - 1 : m.start()] if m.start() else "", source[at : at + 1]
            left = not _space(after) and (not _mark(after) or _space(before) or _mark(before))
            right = not _space(before) and (not _mark(before) or _space(after) or _mark(after))
            under = m[0][0] == "_"
            opens, closes = left and (not under or not right or _mark(before)), right and (not under or not left or _mark(after))
            runs.append([len(pieces), m[0][0], len(m[0]), opens, closes, len(m[0])])
            pieces.append(m[0])
        elif kind == "open":
            brackets.append((len(pieces), len(runs), at))
            pieces.append(m[0])
        elif not brackets:
            pieces.append("]")
        else:
            piece, first, begin = brackets.pop()
            target = _TARGET.match(source, at)
            label = None if target else _LABEL.match(source, at)
            name = _folded(label[1] if label and label[1] else source[begin : m.start()])
            if target or name in known:
                at = (target or label or m).end()
                _emphasis(pieces, runs, first)
                if pieces[piece] == "[":  # no link holds another
                    brackets = [x for x in brackets if pieces[x[0]] == "!["]
                pieces[piece] = None
                pieces.append(None)
            else:
                pieces.append("]")
    if at < end:
        pieces.append(source[at:])
    _emphasis(pieces, runs, 0)
    return [x for x in "".join("\0" if x is None else x for x in pieces).split("\0") if x]


def _emphasis(pieces: list[str | None], runs: list[list], first: int) -> None:
    """Match runs of stars and underscores from ``first`` on; matched marks go."""
    at = first
    while at < len(runs):
        close = runs[at]
        found = None
        if close[4] and close[2]:
            for k in range(at - 1, first - 1, -1):
                own = runs[k]
                odd = (own[4] or close[3]) and (own[5] + close[5]) % 3 == 0 and (own[5] % 3 or close[5] % 3)
                if own[1] == close[1] and own[3] and own[2] and not odd:
                    found = k
                    break
        if found is None:
            at += 1
            continue
        own = runs[found]
        used = 2 if own[2] > 1 and close[2] > 1 else 1
        for x in (own, close):
            x[2] -= used
        for x in runs[found + 1 : at]:
            x[3] = x[4] = False
        if not close[2]:
            at += 1
    for piece, mark, left, _, _, whole in runs[first:]:
        if left < whole:
            pieces[piece] = f"\0{mark * left}\0"
    del runs[first:]


def visible(text: str) -> str:
    """What a reader sees, texts apart by a space."""
    if "\n" not in text and not _SPECIAL.search(text) and text[:1].isalpha():
        return text.strip()
    blocks = leaves(text)
    known = definitions(blocks) if "]:" in text else frozenset()
    out: list[str] = []
    for x in blocks:
        if x.kind == "code":
            out += [y.strip() for y in x.lines]
        elif x.lines:
            lines = [y.strip() for y in x.lines]
            source = "\n".join(lines)
            if _SPECIAL.search(source):
                out += [y.strip("\n") for run in texts(source, known) for y in run.split("\n")]
            else:
                out += lines
    return " ".join(x for x in out if x).strip()
