"""Results as text for people, as Markdown, or as JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

FORMS = ("pretty", "markdown", "json")


def _cells(rows: Sequence[Any], columns: Sequence[str]) -> list[list[str]]:
    return [["" if r[c] is None else f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]).replace("\n", " ") for c in columns] for r in rows]


def table(rows: Sequence[Any], columns: Sequence[str], form: str = "pretty") -> str:
    """Rows that were collected, in their order."""
    if form not in FORMS:
        raise ValueError(f"unknown form '{form}'")
    if form == "json":
        return json.dumps([{c: r[c] for c in columns} for r in rows], ensure_ascii=False, indent=2, default=str)
    cells = _cells(rows, columns)
    if form == "markdown":
        quoted = [[x.replace("|", "\\|") for x in r] for r in cells]
        return "\n".join(["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns), *("| " + " | ".join(r) + " |" for r in quoted)])
    widths = [max([len(c), *(len(r[i]) for r in cells)]) for i, c in enumerate(columns)]
    line = lambda r: "  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip()
    return "\n".join([line(columns), line(["-" * w for w in widths]), *map(line, cells)])


def violations_text(groups: Sequence[Any], form: str = "pretty", verbose: bool = False) -> str:
    """Grouped violations: a line each, and the first of their files if ``verbose``."""
    if form == "json":
        return json.dumps([{"field": g["field"], "kind": g["kind"], "rule": g["rule"], "n": g["n"], "files": [{"path": f["path"], "detail": f["detail"]} for f in g["files"]]} for g in groups], ensure_ascii=False, indent=2)
    if not verbose:
        return table([{"field": g["field"], "kind": g["kind"], "rule": g["rule"], "files": g["n"]} for g in groups], ["field", "kind", "rule", "files"], form)
    rows = []
    for g in groups:
        own = {"field": g["field"], "kind": g["kind"], "rule": g["rule"]}
        rows += [own | {"path": f["path"], "detail": f["detail"]} for f in g["files"]]
        if g["n"] > len(g["files"]):
            rows.append(own | {"path": f"({g['n'] - len(g['files'])} more)", "detail": None})
    return table(rows, ["field", "kind", "rule", "path", "detail"], form)


def steps_text(steps: Sequence[Any], form: str = "pretty") -> str:
    """What a command did, a line per step with its time and whether it failed."""
    return table([{"step": x.name, "seconds": round(x.seconds, 3), "outcome": "failed" if x.failed else "done"} for x in steps], ["step", "seconds", "outcome"], form)
