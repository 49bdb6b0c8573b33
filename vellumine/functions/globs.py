"""Path globs: matching, coverage, and their shape in configurations.

As a single star crosses directory separators by default, ``dir/*`` and
``dir/**`` match the same paths; ``literal_separator=True`` gives the strict
reading.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


class GlobError(ValueError):
    """A pattern that isn't a glob."""


@lru_cache(maxsize=4096)
def glob_regex(glob: str, literal_separator: bool = False) -> str:
    """An anchored regular expression in the syntax that Java and Python share."""
    any_character = "[^/]" if literal_separator else "."
    out, i, braces = ["^"], 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            at_start = i == 0 or glob[i - 1] == "/"
            if at_start and glob.startswith("**/", i):
                out.append("(?:.*/)?")
                i += 3
                continue
            out.append(".*")
            i += 2
            continue
        if c == "*":
            out.append(f"{any_character}*")
        elif c == "?":
            out.append(any_character)
        elif c == "[":
            end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] in ("!", "^")))
            if end < 0:
                raise GlobError(f"invalid glob pattern '{glob}': unclosed character class")
            inner = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]")
            i = end
        elif c == "{":
            braces += 1
            out.append("(?:")
        elif c == "}" and braces:
            braces -= 1
            out.append(")")
        elif c == "," and braces:
            out.append("|")
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if braces:
        raise GlobError(f"invalid glob pattern '{glob}': unclosed alternates")
    return "".join(out) + "$"


def glob_matches(glob: str, path: str, literal_separator: bool = False) -> bool:
    return re.match(glob_regex(glob, literal_separator), path, re.DOTALL) is not None


def path_in(path: Column, globs: list[str]) -> Column:
    """Whether a path matches one of the globs, as one expression."""
    if not globs:
        return F.lit(False)
    if any(x in ("*", "**") for x in globs):
        return F.lit(True)
    return path.rlike("|".join(f"(?:{glob_regex(x)})" for x in globs))


def well_formed(glob: str) -> bool:
    return glob in ("*", "**") or glob.endswith(("/*", "/**"))


def directory(glob: str) -> str:
    if glob in ("*", "**"):
        return ""
    return glob.removesuffix("/**").removesuffix("/*")


def covered(required: str, allowed: list[str]) -> bool:
    """Whether paths that need a field are all allowed to have it."""
    own = directory(required)
    return any(x in ("**", required) or (own != "" and glob_matches(x, own)) for x in allowed)
