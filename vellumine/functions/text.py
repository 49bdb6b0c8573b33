"""Text and vector functions over columns."""

from __future__ import annotations

import math
import re

import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

def strip_wikilinks(text: str) -> str:
    """Links in double brackets as the text they show: their label, or else their target."""
    out, done, at = [], 0, text.find("[[")
    while at >= 0:
        end = text.find("]", at + 2)
        if end < 0:
            break
        if not text.startswith("]]", end):  # nor does a link begin anywhere before
            at = text.find("[[", end)
            continue
        target, bar, label = text[at + 2 : end].partition("|")
        if target and (label or not bar):
            out += [text[done : at - text[done:at].endswith("!")], label or target]
            done = end + 2
            at = text.find("[[", done)
        else:
            at = text.find("[[", at + 1)
    return "".join(out) + text[done:]


def wikilinks_stripped(text: Column) -> Column:
    """The same inside the JVM, in one pass: what stands before the first bar is skipped."""
    shown = r"(?!\|)(?:[^\]|]++\|)?+([^\]]++)"
    return F.regexp_replace(text, rf"!?+\[\[{shown}\]\]", "$1")


@F.pandas_udf(T.StringType())
def content_hash(text: pd.Series) -> pd.Series:
    """XXH3 with 64 bits, as 16 hexadecimal digits."""
    return text.map(lambda x: None if x is None else xxhash.xxh3_64_hexdigest(x.encode("utf-8")))


def cosine_similarity(a: Column, b: Column) -> Column:
    """In double precision; 0 if either vector has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, F.lit(0.0)).otherwise(dot(a, b) / norms)


#: Dimensions up to which products are unrolled into generated code.
UNROLLED = 512


def cosine_with(vector: str, query: list[float], norm: str | None = None) -> Column:
    """Cosine similarity of a column with one given vector, whose norm is taken once.

    In double precision; 0 if either has no length, null if lengths differ.
    """
    length = math.sqrt(math.fsum(x * x for x in query))
    if not 0 < len(query) <= UNROLLED:
        return cosine_similarity(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    part = [f"CAST(get({vector}, {i}) AS DOUBLE)" for i in range(len(query))]
    dot = F.expr(" + ".join(f"{x} * CAST({float(q)!r} AS DOUBLE)" for x, q in zip(part, query, strict=True)))
    own = F.col(norm) if norm else F.sqrt(F.expr(" + ".join(f"{x} * {x}" for x in part)))
    return F.when(F.size(vector) == len(query), F.when((own == 0) | F.lit(length == 0), F.lit(0.0)).otherwise(dot / (own * F.lit(length))))


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


_TERM = re.compile(r"[^\W_]+")
#: For ASCII, the same by a table: what is no letter or digit is a blank.
_ASCII_WORDS = bytes(c if chr(c).isalnum() and c < 128 else 32 for c in range(256))


def text_terms(text: str) -> list[str]:
    """The same outside the JVM: what postings hold, and what a query asks for."""
    if text.isascii():
        return text.lower().encode().translate(_ASCII_WORDS).decode().split()
    return _TERM.findall(text.lower())
