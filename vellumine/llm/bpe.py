"""Byte-pair encoding by contiguous rank arrays, and decoding.

A word's parts stand in one array and the merge ranks of adjacent parts in
another. The least rank is looked for by a scan, its boundary is deleted, and
the two ranks beside it are looked up again, until no adjacent pair can merge.
All distinct words of one length are done side by side, a row each. Words of
more than ``SCAN_PARTS`` parts, for which scans would cost the square of the
length, take the same merges from a heap.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellumine.llm.common import arrow_type, small_batches, text_input
from vellumine.llm.vocabulary import CACHE_UNITS, UNIT_CHARS, byte_alphabet, collect_less, word_units

SCAN_PARTS = 48
#: Marks that no pattern joins to the letters before them.
MARKS = (".", ",", ";", ":", "!", "?")
_NONE = np.int64(1 << 40)
_SPACE = r"\t-\r \x85\xa0  -     　"
_KEPT: dict[str, "WordBpe"] = {}


class WordBpe:
    """A vocabulary with word ends: lower case, white space dropped."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            given = json.load(file)
        model = given["model"]
        self.end = model["end_of_word_suffix"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in given["added_tokens"]}
        self.tokens = {i: x for x, i in self.vocabulary.items()} | {i: x for x, i in self.special.items()}
        pattern = next(x["pattern"]["Regex"] for x in given["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        self.pattern = regex.compile(pattern.replace(r"\s", _SPACE))
        self.library = Tokenizer.from_file(path)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        merges = [tuple(x.split(" ")) if isinstance(x, str) else tuple(x) for x in model["merges"]]
        self.size = max(self.tokens) + 1
        keys, made = [], []
        for left, right in merges:
            keys.append(self.vocabulary[left] * self.size + self.vocabulary[right])
            made.append(self.vocabulary[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        self.keys = np.array(keys, np.int64)[order]
        self.rank = np.arange(len(keys), dtype=np.int64)[order]
        self.made = np.array(made, np.int64)  # by rank
        self.pairs = dict(zip(keys, range(len(keys)), strict=True))
        letters = byte_alphabet()
        self.inner = np.array([self.vocabulary[x] for x in letters], np.int64)
        self.last = np.array([self.vocabulary[x + self.end] for x in letters], np.int64)
        self.shown = [str(i) for i in range(self.size)]
        self.spelled = [self.tokens.get(i, "") for i in range(self.size)]
        self.marks = {x: self._entry(ids) for x, ids in zip(MARKS, self.units(list(MARKS)), strict=True)}
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.old: dict[str, tuple[str, int, str]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.rank[at], _NONE)

    def _scan(self, parts: np.ndarray) -> list[list[int]]:
        """Ids of words that have the same number of parts, a word a row."""
        rows, width = parts.shape
        done: list[list[int]] = [[]] * rows
        alive = np.arange(rows)
        ranks = self._ranks(parts[:, :-1], parts[:, 1:])
        while len(alive):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(alive), np.int64)
            least = ranks[np.arange(len(alive)), at] if ranks.shape[1] else np.full(len(alive), _NONE)
            over = least == _NONE
            if over.any():
                for i, x in zip(alive[over].tolist(), parts[over].tolist(), strict=True):
                    done[i] = x
                keep = ~over
                alive, parts, ranks, at, least = alive[keep], parts[keep], ranks[keep], at[keep], least[keep]
                if not len(alive):
                    break
            here = np.arange(len(alive))
            parts[here, at] = self.made[least]
            columns = np.arange(parts.shape[1] - 1)
            parts = np.take_along_axis(parts, columns + (columns > at[:, None]), axis=1)
            columns = columns[:-1]
            ranks = np.take_along_axis(ranks, columns + (columns >= at[:, None]), axis=1)
            before, after = at > 0, at < parts.shape[1] - 1
            ranks[here[before], at[before] - 1] = self._ranks(parts[here[before], at[before] - 1], parts[here[before], at[before]])
            ranks[here[after], at[after]] = self._ranks(parts[here[after], at[after]], parts[here[after], at[after] + 1])
        return done

    def _heap(self, parts: list[int]) -> list[int]:
        """The same merges for a long word: least rank first, leftmost of equals."""
        n = len(parts)
        after, before, ids = [*range(1, n), -1], [*range(-1, n - 1)], [*parts]
        pair = lambda i: self.pairs.get(ids[i] * self.size + ids[after[i]]) if after[i] >= 0 else None
        queue = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(queue)
        while queue:
            rank, i = heapq.heappop(queue)
            if ids[i] < 0 or pair(i) != rank:
                continue
            gone = after[i]
            ids[i], ids[gone], after[i] = int(self.made[rank]), -1, after[gone]
            if after[i] >= 0:
                before[after[i]] = i
            for j in (before[i], i):
                if j >= 0 and (r := pair(j)) is not None:
                    heapq.heappush(queue, (r, j))
        return [x for x in ids if x >= 0]

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word, which is one match of the pattern in UTF-8."""
        out: list[list[int]] = [[]] * len(words)
        by_length = defaultdict(list)
        for i, x in enumerate(words):
            by_length[len(x)].append(i)
        for length, own in by_length.items():
            raw = np.frombuffer(b"".join(words[i] for i in own), np.uint8).reshape(len(own), length)
            parts = self.inner[raw]
            parts[:, -1] = self.last[raw[:, -1]]
            found = self._scan(parts) if length <= SCAN_PARTS else map(self._heap, parts.tolist())
            for i, x in zip(own, found, strict=True):
                out[i] = x
        return out

    def split(self, text: str) -> list[str]:
        """A text's units, in lower case already where that can't change what else is done."""
        if "<" not in text:
            try:
                text.encode("latin-1")
                return word_units(text.lower())
            except UnicodeEncodeError:
                pass
        return word_units(text)

    def matches(self, text: str) -> list[bytes]:
        """A unit's matches of the pattern, normalised, in UTF-8.

        Beyond Latin-1, what is a letter differs between versions of Unicode, so
        there the library's normalizer and pattern decide.
        """
        try:
            text.encode("latin-1")
            return [x.encode("utf-8") for x in self.pattern.findall(text.lower())]
        except UnicodeEncodeError:
            normal = self.library.normalizer.normalize_str(text)
            return [normal[a:b].encode("utf-8") for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def units(self, units: list[str]) -> list[list[int]]:
        """Ids of texts without white space."""
        pieces: list[list[bytes | int]] = []
        for unit in units:
            own: list[bytes | int] = []
            for x in self.cut.split(unit) if self.cut and "<" in unit else (unit,):
                if x in self.special:
                    own.append(self.special[x])
                elif x:
                    own += self.matches(x)
            pieces.append(own)
        distinct = list({x for own in pieces for x in own if isinstance(x, bytes)})
        ids = dict(zip(distinct, self.words(distinct), strict=True))
        return [[i for x in own for i in (ids[x] if isinstance(x, bytes) else (x,))] for own in pieces]

    def encode(self, text: str) -> list[int]:
        return [i for x in self.units(word_units(text)) for i in x]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as the vocabulary names no decoder."""
        return " ".join(self.tokens[i] for i in ids if i in self.tokens)

    def _entry(self, ids: list[int]) -> tuple[str, int, str]:
        shown, spelled = self.shown, self.spelled
        return " ".join([shown[i] for i in ids]), len(ids), " ".join([spelled[i] for i in ids])

    def learn(self, units: set[str]) -> None:
        """Put units' ids, their number and their decoded form into the cache.

        A unit of ASCII letters is one match of the pattern, and one with a mark
        behind them two; others are cut by it.
        """
        cache, marks = self.cache, self.marks
        known = units & self.old.keys()
        cache.update(zip(known, map(self.old.__getitem__, known), strict=True))
        new = units - cache.keys()
        marked = [x for x in new if x[-1] in marks and x.isascii() and x[:-1].isalpha()]
        need = new.difference(marked)
        need.update({x[:-1] for x in marked} - cache.keys())
        words, others = [], []
        for x in need:
            (words if x.isascii() and x.isalpha() else others).append(x)
        entry = self._entry
        for x, ids in zip(words, self.words([x.lower().encode() for x in words]), strict=True):
            cache[x] = entry(ids)
        for x, ids in zip(others, self.units(others), strict=True):
            cache[x] = entry(ids)
        for x in marked:
            (ids, n, back), (mark_ids, m, mark_back) = cache[x[:-1]], marks[x[-1]]
            cache[x] = (f"{ids} {mark_ids}", n + m, f"{back} {mark_back}")


def bpe_of(path: str) -> WordBpe:
    if path not in _KEPT:
        collect_less()
        _KEPT[path] = WordBpe(path)
    return _KEPT[path]


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every whole text.

    Returns per row: the id, ``n_tokens``, ``ids_sha256`` (of the decimal ids
    joined by one space) and ``decoded_sha256``. A null or empty text has no ids
    and an empty decoding. Each row stands for itself, so repeated rows and ids
    give repeated results; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = text_input(docs, id_col, text_col)
    kind = rows.schema["id"].dataType
    arrow_kind = arrow_type(kind)
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe_of(vocabulary)
        for batch in batches:
            texts = [model.split(x or "") for x in batch.column("text").to_pylist()]
            if len(model.cache) > CACHE_UNITS:
                model.old, model.cache = model.cache, {}
            model.learn(set().union(*texts))
            counts, ids, back = [], [], []
            get = model.cache.__getitem__
            for words in texts:
                found = [x for x in map(get, words) if x[1]]
                ids.append(hashlib.sha256(" ".join([x[0] for x in found]).encode()).hexdigest())
                back.append(hashlib.sha256(" ".join([x[2] for x in found]).encode()).hexdigest())
                counts.append(sum([x[1] for x in found]))
            for x in [x for words in texts for x in words if len(x) > UNIT_CHARS]:
                model.cache.pop(x, None)
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(arrow_kind), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], schema.names)

    return rows.mapInArrow(step, schema)
