"""Markdown bodies as chunks of bounded length, cut where the text has seams."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass

from vellumine.functions.markdown import leaves, visible
from vellumine.functions.text import strip_wikilinks

DEFAULT_CHARS = 1024
#: Seams inside a block, from the widest to the narrowest; each ends where a new part begins.
_SEAMS = (re.compile(r"\n"), re.compile(r"(?<=[.!?])\s+"), re.compile(r"\s+"))
#: Levels of seams between blocks: headings of each level, rules, all blocks.
_RULES, _BLOCKS = 6, 7


@dataclass
class Chunk:
    index: int
    start_line: int
    end_line: int
    plain_text: str


def plain_text(markdown: str) -> str:
    """The words a reader sees, without marks, code spans and HTML."""
    return strip_wikilinks(visible(markdown))


def _seams(text: str) -> list[list[int]]:
    """Where blocks begin, by level."""
    out: list[list[int]] = [[] for _ in range(_BLOCKS + 1)]
    for x in leaves(text):
        out[_BLOCKS].append(x.start)
        if x.kind == "heading":
            out[x.level - 1].append(x.start)
        elif x.kind == "rule":
            out[_RULES].append(x.start)
    return out


def _spans(text: str, seams: list[list[int]], start: int, end: int, most: int, level: int) -> list[tuple[int, int]]:
    """Spans of at most ``most`` characters that cover what isn't blank."""
    if end - start <= most:
        return [(start, end)] if text[start:end].strip() else []
    if level <= _BLOCKS:
        own = seams[level]
        cuts = [start, *own[bisect.bisect_right(own, start) : bisect.bisect_left(own, end)], end]
    elif level - _BLOCKS - 1 < len(_SEAMS):
        cuts = [start, *(m.end() for m in _SEAMS[level - _BLOCKS - 1].finditer(text, start, end) if start < m.end() < end), end]
    else:
        return [(i, min(i + most, end)) for i in range(start, end, most)]
    if len(cuts) == 2:
        return _spans(text, seams, start, end, most, level + 1)
    out: list[tuple[int, int]] = []
    held: tuple[int, int] | None = None
    for a, b in zip(cuts, cuts[1:], strict=False):
        if held and b - held[0] <= most:
            held = (held[0], b)
            continue
        if held:
            out += _spans(text, seams, *held, most, level + 1)
        held = (a, b)
    return out + (_spans(text, seams, *held, most, level + 1) if held else [])


def chunk_spans(body: str, most: int = DEFAULT_CHARS) -> list[tuple[int, int]]:
    """Where chunks begin and end in a body, blanks around them left out."""
    out = []
    for start, end in _spans(body, _seams(body) if len(body) > most else [], 0, len(body), most, 0):
        part = body[start:end]
        out.append((start + len(part) - len(part.lstrip()), start + len(part.rstrip())))
    return out


def chunks(body: str, most: int = DEFAULT_CHARS) -> list[Chunk]:
    """Chunks in order, with 1-based lines of the body."""
    out, line, at = [], 1, 0
    for start, end in chunk_spans(body, most):
        line, at = line + body.count("\n", at, start), start
        out.append(Chunk(len(out), line, line + body.count("\n", start, end - 1), plain_text(body[start:end])))
    return out
