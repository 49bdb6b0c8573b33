"""License scans by conditional compression.

Lines that hold a license cue form candidate blocks. A block's words are
compressed on their own and once more with each template as a zstandard raw
dictionary; templates are ranked by how much smaller that makes the block. In that
order every template that the block has words enough for is aligned with it, and
confirmed if its words are nearly all there; the differing words are returned. The
rank decides where templates fit the wording equally well; it rejects none. Of
licenses that match the same words, the one whose wording differs least stays.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import arrow_type, small_batches, text_input

_MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = f"{_BSD} 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = f"{_BSD_2} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_AS_IS = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES"


def _gnu(name: str, version: str, dated: str, sign: str, what: str = "program") -> tuple[str, ...]:
    return (
        f"This work is licensed under the GNU {name}, version {version}.",
        f"This {what} is free software{sign[0]} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{sign[1]} either version {version} of the License, or (at your option) any later version.",
        f"GNU {name} Version {version}, {dated}",
    )


def _cc(short: str, long: str) -> tuple[str, ...]:
    return f"Licensed under CC {short} 4.0.", f"This work is licensed under a Creative Commons {long} 4.0 International License."


def _spdx(*names: str) -> tuple[str, ...]:
    return tuple(f"SPDX-License-Identifier: {x}" for x in names)


def _spdx_gnu(name: str) -> tuple[str, ...]:
    return _spdx(name, f"{name}-only", f"{name}-or-later")


#: Notices by license, in the wording that their publishers ask for; the texts of
#: short licenses, and the titles of long ones. BSD is the sentence that opens
#: several licenses, without what tells them apart.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", _MIT, f"{_MIT} The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}", *_spdx("MIT")),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Apache License Version 2.0, January 2004",
        *_spdx("Apache-2.0"),
    ),
    "GPL-3.0": (*_gnu("General Public License", "3", "29 June 2007", ":,"), *_spdx_gnu("GPL-3.0")),
    "GPL-2.0": (*_gnu("General Public License", "2", "June 1991", ";;"), *_spdx_gnu("GPL-2.0")),
    "LGPL-3.0": (*_gnu("Lesser General Public License", "3", "29 June 2007", ":,"), *_spdx_gnu("LGPL-3.0")),
    "LGPL-2.1": (*_gnu("Lesser General Public License", "2.1", "February 1999", ";;", "library"), *_spdx_gnu("LGPL-2.1")),
    "LGPL-2.0": (*_gnu("Library General Public License", "2", "June 1991", ";;", "library"), *_spdx_gnu("LGPL-2.0")),
    "AGPL-3.0": (*_gnu("Affero General Public License", "3", "19 November 2007", ":,"), *_spdx_gnu("AGPL-3.0")),
    "BSD": (_BSD,),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", f"{_BSD_3} {_BSD_AS_IS}", *_spdx("BSD-3-Clause")),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", f"{_BSD_2} {_BSD_AS_IS}", *_spdx("BSD-2-Clause")),
    "ISC": ("Licensed under the ISC License.", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies.", *_spdx("ISC")),
    "0BSD": (f"{_ISC}.", *_spdx("0BSD")),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License Version 2.0", *_spdx("MPL-2.0")),
    "CC-BY-4.0": (*_cc("BY", "Attribution"), *_spdx("CC-BY-4.0")),
    "CC-BY-SA-4.0": (*_cc("BY-SA", "Attribution-ShareAlike"), *_spdx("CC-BY-SA-4.0")),
    "CC-BY-NC-4.0": (*_cc("BY-NC", "Attribution-NonCommercial"), *_spdx("CC-BY-NC-4.0")),
    "CC-BY-ND-4.0": (*_cc("BY-ND", "Attribution-NoDerivatives"), *_spdx("CC-BY-ND-4.0")),
    "CC-BY-NC-SA-4.0": (*_cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), *_spdx("CC-BY-NC-SA-4.0")),
    "CC-BY-NC-ND-4.0": (*_cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"), *_spdx("CC-BY-NC-ND-4.0")),
    "Proprietary": ("All rights reserved.", "All rights reserved. No part of this publication may be reproduced without prior written permission."),
}
#: Words that make another license of one when they alone stand in between.
TELLING = ("lesser", "library", "affero")
CUES = ("licens", "licenc", "copyright", "spdx", "hereby granted", "rights reserved", "redistribut", "free software", "creative commons", "public license", "without warranty")
#: Lines without a cue that a block may hold between two with one.
GAP_LINES = 3
#: A block holds so many characters of a long line around its cues, and no more lie
#: between two cues; words of a notice are looked for as far beyond a block.
AROUND = 600
#: So many words are ranked together, and so many beside them or beside a notice
#: are compressed with them.
RANKED, BESIDE = 512, 64
#: The share of a template's words that a block must hold, in order.
LEAST_SHARE = 0.85
#: So many words between count as much as one that is missing.
APART = 16
_SCALE = 1 << 20

_CUE = re.compile("|".join(CUES))
_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")


@dataclass(frozen=True)
class Template:
    license: str
    words: tuple[str, ...]
    counts: Counter
    dictionary: zstandard.ZstdCompressionDict


def _words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@lru_cache(maxsize=1)
def _templates() -> list[Template]:
    return [Template(name, tuple(_words(x)), Counter(_words(x)), zstandard.ZstdCompressionDict(" ".join(_words(x)).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for name, texts in TEMPLATES.items() for x in texts]


@lru_cache(maxsize=1)
def _compressors() -> tuple[zstandard.ZstdCompressor, list[zstandard.ZstdCompressor]]:
    bare = {"level": 19, "write_checksum": False, "write_content_size": False}
    return zstandard.ZstdCompressor(**bare), [zstandard.ZstdCompressor(dict_data=t.dictionary, **bare) for t in _templates()]


def blocks(text: str) -> list[tuple[int, int]]:
    """Where candidate blocks begin and end in a text.

    Cues are in one block if at most GAP_LINES line ends and AROUND characters
    lie between them, so lines of any length fall into blocks about cues.
    """
    low = text.lower() if len(text.lower()) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    spans: list[list[int]] = []
    reached = 0
    for cue in _CUE.finditer(low):
        first, last = low.rfind("\n", 0, cue.start()) + 1, low.find("\n", cue.end())
        last = len(low) if last < 0 else last
        first, last = max(first, cue.start() - AROUND), min(last, cue.end() + AROUND)
        if spans and cue.start() - reached <= AROUND and (first <= spans[-1][1] or low.count("\n", spans[-1][1], first) <= GAP_LINES):
            spans[-1][1] = max(last, spans[-1][1])
        else:
            spans.append([max(first, (spans[-1][1] + cue.start()) // 2) if spans and first < spans[-1][1] else first, last])
            if len(spans) > 1:
                spans[-2][1] = min(spans[-2][1], spans[-1][0])
        reached = cue.end()
    return [(a, b) for a, b in spans]


def regions(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Where the words of notices with cues in these blocks can lie: whole words of AROUND characters about them, as one where they meet."""
    begin, end = -1, -1
    for a, b in spans:
        first, last = max(0, a - AROUND), max(end, min(len(text), b + AROUND))
        while first > max(0, end) and not text[first - 1].isspace():
            first -= 1
        while last < len(text) and not text[last].isspace():
            last += 1
        if begin >= 0 and first > end:
            yield begin, end
            begin = first
        begin, end = (first if begin < 0 else begin), max(last, end)
    if begin >= 0:
        yield begin, end


def reduction(i: int, words: list[str]) -> float:
    """By how much of its own compressed size a template shrinks these words."""
    raw = " ".join(words).encode()
    alone, given = _compressors()
    size = len(alone.compress(raw))
    return (size - len(given[i].compress(raw))) / size


def ranked(words: list[str], candidates: list[int]) -> list[tuple[int, float]]:
    """(template, reduction) from the largest reduction of the words to the smallest.

    A block is compressed ``RANKED`` words at a time, each part with its neighbours'
    ends, and a template counts by the part that it shrinks most.
    """
    alone, given = _compressors()
    best = dict.fromkeys(candidates, -1.0)
    for i in range(0, max(len(words), 1), RANKED):
        raw = " ".join(words[max(0, i - BESIDE) : i + RANKED + BESIDE]).encode()
        size = len(alone.compress(raw))
        for k in candidates:
            best[k] = max(best[k], (size - len(given[k].compress(raw))) / size)
    return sorted(best.items(), key=lambda x: (-x[1], x[0]))


def places(template: tuple[str, ...], words: list[str]) -> Iterator[tuple[float, list[int], list[str]]]:
    """Where a block holds a template: share of its words, their places, and what differs.

    An alignment costs APART for a word of the template that is missing and one
    for a word of the block in between, so it has at most APART words in between
    for each that it holds, and the cheapest of all are found. Words of the block
    before the first and after the last common word are not the notice's. Places
    share no words; they are found until none holds LEAST_SHARE.
    """
    n, number = len(template), {x: i for i, x in enumerate(dict.fromkeys(template))}
    ids = np.array([number.get(x, -1) for x in words])
    held = [number[x] for x in template]
    missing, between = APART * _SCALE, 1 + _SCALE  # a cost is told apart from the words in between that it counts

    def step(row: np.ndarray, hits: np.ndarray) -> np.ndarray:
        new = row + missing
        new[hits + 1] = np.minimum(new[hits + 1], row[hits])
        ramp = np.arange(len(row), dtype=np.int64) * between
        return np.minimum.accumulate(new - ramp) + ramp

    while True:
        row, hits = np.zeros(len(ids) + 1, np.int64), [np.flatnonzero(ids == i) for i in range(len(number))]
        if sum(min(len(hits[number[x]]), k) for x, k in Counter(template).items()) < LEAST_SHARE * n:
            return
        for i in held:
            row = step(row, hits[i])
        shares = 1 - (row // _SCALE - row % _SCALE) / APART / n
        ends = np.flatnonzero((shares >= LEAST_SHARE) & (np.diff(row, prepend=row[0] + 1) < between))
        taken = np.zeros(len(ids) + 1, bool)
        for end in ends[np.argsort(row[ends], kind="stable")].tolist():
            if taken[end]:
                continue
            first = max(0, end - (APART + 1) * n)
            near = ids[first:end]
            rows = [np.zeros(len(near) + 1, np.int64)]
            for i in held:
                rows.append(step(rows[-1], np.flatnonzero(near == i)))
            i, j, pairs = n, len(near), []
            while i and j:
                if near[j - 1] == held[i - 1] and rows[i][j] == rows[i - 1][j - 1]:
                    i, j = i - 1, j - 1
                    pairs.append((i, first + j))
                elif rows[i][j] == rows[i - 1][j] + missing:
                    i -= 1
                else:
                    j -= 1
            pairs.reverse()
            at = [y for _, y in pairs]
            if taken[np.array(at) + 1].any():
                continue
            taken[at[0] + 1 : at[-1] + 2] = True
            ids[at] = -1
            out = ["-" + x for x in template[: pairs[0][0]]]
            for (a, c), (b, d) in zip(pairs, [*pairs[1:], (n, at[-1] + 1)], strict=True):
                out += ["-" + x for x in template[a + 1 : b]] + ["+" + x for x in words[c + 1 : d]]
            yield len(pairs) / n, at, out
        if not taken.any():
            return


def another(template: Template, changed: list[str]) -> bool:
    """Whether the words in between tell that it is another license."""
    if template.words[0].startswith("spdx-") and changed and changed[-1] not in ("+or", "+and"):
        return True
    apart = ["", *changed, ""]
    return any(x[1:] in TELLING and x[0] == "+" and not before.startswith("+") and not after.startswith("+") for before, x, after in zip(apart, apart[1:-1], apart[2:], strict=False))


def find_licenses(text: str) -> list[tuple]:
    """(license, start, end, reduction, share, differing words) of each notice.

    A block may hold several licenses; each is reported once, by its best
    template and place: the one with the largest share, then the fewest
    differences, then the longest wording, then the larger reduction of the block.
    A place whose matched words all lie
    within another license's is no notice of its own if the other matches more
    words, or the same words better. Start and end are those of the block, or of
    the notice where it goes beyond; the reduction is that of the notice's words
    and of up to BESIDE on each side.
    """
    out, spans = [], blocks(text)
    for start, end in regions(text, spans):
        tokens = [(x.group().lower(), x.start(), x.end()) for x in _WORD.finditer(text, start, end)]
        words = [x for x, _, _ in tokens]
        found, owners, there = [], defaultdict(set), Counter(words)
        templates = _templates()
        # a count of words bounds exactly what an alignment can hold
        candidates = [i for i, t in enumerate(templates) if sum(min(k, there[x]) for x, k in t.counts.items()) >= LEAST_SHARE * len(t.words)]
        for i, _ in ranked(words, candidates) if candidates else ():
            template = templates[i]
            for share, at, changed in places(template.words, words):
                if another(template, changed):
                    continue
                for k in at:
                    owners[k].add(len(found))
                found.append(((-share, len(changed), -len(template.words)), template.license, frozenset(at), i, share, changed))
        inside = [k for k, span in enumerate(spans) if start <= span[0] < end]
        best: dict[tuple[int, str], tuple] = {}
        for x in sorted(found, key=lambda x: x[0]):
            others = [found[k] for k in set.intersection(*(owners[k] for k in x[2]))]
            if any(y[1] != x[1] and (len(x[2]) < len(y[2]) or y[0][:2] < x[0][:2]) for y in others):
                continue
            first, last = min(x[2]), max(x[2])
            begin, stop = tokens[first][1], tokens[last][2]
            block = min(inside, key=lambda k: max(spans[k][0] - stop, begin - spans[k][1], 0))
            if (block, x[1]) not in best:
                near = words[max(0, first - BESIDE) : last + 1 + BESIDE]
                best[block, x[1]] = (x[1], min(spans[block][0], begin), max(spans[block][1], stop), reduction(x[3], near), x[4], x[5])
        out += [best[k] for k in sorted(best)]
    return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per notice found in whole texts.

    Returns the id, ``license``, ``start`` and ``end`` of the block in
    characters, ``reduction``, ``matched`` (share of the template's words),
    ``n_differences``, ``exact`` and ``wording`` (the differing words, those of
    the template with a minus sign). Null and empty texts hold none, and an empty
    table gives an empty result; texts and lines of any length are read whole, in
    blocks about their cues. Repeated rows give repeated results; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    rows = text_input(docs, id_col, text_col)
    kind = rows.schema["id"].dataType
    arrow_kind = arrow_type(kind)
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("license", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("reduction", T.DoubleType()), T.StructField("matched", T.DoubleType()), T.StructField("wording", T.ArrayType(T.StringType()))])
    kinds = [arrow_kind, pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string())]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(at, *x) for at, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True) if text for x in find_licenses(text)]
            columns = zip(*found, strict=True) if found else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, kinds, strict=True)], schema.names)

    found = rows.mapInArrow(step, schema)
    return found.select(id_col, "license", "start", "end", "reduction", "matched", F.size("wording").cast("long").alias("n_differences"), (F.size("wording") == 0).alias("exact"), F.array_join("wording", " ").alias("wording"))
