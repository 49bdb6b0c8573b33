"""Language-model scores from a subword lattice.

The pieces and their scores are an existing vocabulary's. A vocabulary of merges
scores a piece by minus its rank, which is no log probability, so scores enter as
a prior: a piece of rank r is expected in proportion to 1 / (r + RANK_OFFSET), by
Zipf's law, with the weight of ``PRIOR`` counts in all. Training texts refine it:
pieces are counted first as the vocabulary itself cuts their words, then ROUNDS
times as expected over all segmentations. A text's probability is the sum over all
its segmentations into pieces: a forward recursion in log space over positions, for
all words of a length side by side; words beyond ``LONG`` characters one by one,
in scaled numbers and bounded memory. No piece reaches over white space, so a
text's lattice falls into its words' lattices, and each distinct word is done once.

Word counts are a distributed table. Words that are frequent enough to be among
the ``FREQUENT`` most frequent, a bounded number, are broadcast (a word of more
than ``KEY_BYTES`` as its hash); all others of a text are joined with the table. So
scores are exact at every size, and only the rare part of the texts is shuffled.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import Scratch, arrow_type, byte_texts, crc_of_id, lower_ascii, partition_id, small_batches, text_input

#: Words that are broadcast at most, and bytes of a word beyond which its hash is: in
#: all at most 32 MB of keys, about 80 MB in a Python worker.
FREQUENT, KEY_BYTES = 250_000, 128
#: Distinct words that a task counts before it passes counts on.
COUNTED_WORDS = 300_000
#: Counts that the vocabulary's scores stand for, and what ranks are shifted by.
PRIOR, RANK_OFFSET = 1000.0, 50
#: Counts that the end has beside the training texts.
END_PRIOR = 0.1
#: Times that weights are counted again, over all segmentations. Held-out log10 a
#: token of sf0.01 after 0 to 4 rounds: -5.578, -5.422, -5.362, -5.336, -5.328.
ROUNDS = 2
#: Characters of a word beyond which it is done alone, and positions at a time.
LONG, POSITIONS = 256, 1 << 14
#: Words that are done together at least.
SIDE_BY_SIDE = 20_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 18
_SHIFT = np.uint64(64 - 18)
_SPREAD = np.uint64(0xD1342543DE82EF95)

_LIBRARY: dict[str, object] = {}


def library(path: str):
    if path not in _LIBRARY:
        import sentencepiece

        _LIBRARY[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _LIBRARY[path]


def piece_names(path: str) -> list[str]:
    model = library(path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size())]


def is_byte(name: str) -> bool:
    return len(name) == 6 and name.startswith("<0x") and name.endswith(">")


def prior_counts(path: str) -> np.ndarray:
    """``PRIOR`` counts dealt to pieces by the vocabulary's scores.

    Scores that are merge ranks give a Zipfian prior, scores that are log
    probabilities are used as such. Control pieces get none; bytes, whose scores
    say nothing, as much as the last rank.
    """
    model, names = library(path), piece_names(path)
    scores = np.array([model.get_score(i) for i in range(len(names))])
    spelled = np.array([is_byte(x) for x in names])
    usable = np.array([x not in ("<unk>", "<s>", "</s>") for x in names])
    ordinary = scores[usable & ~spelled]
    if len(ordinary) and (ordinary == np.round(ordinary)).all():
        shares = 1 / (RANK_OFFSET + np.where(spelled, max(len(names), -ordinary.min()), -scores))
    else:
        shares = np.exp(np.where(spelled, ordinary.min(initial=0.0), scores))
    shares = np.where(usable, shares, 0)
    return PRIOR * shares / shares.sum()


def _points(word: str) -> np.ndarray:
    return np.frombuffer(("▁" + word).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _hash(points: np.ndarray) -> np.uint64:
    h = np.uint64(0)
    with np.errstate(over="ignore"):
        for x in points:
            h = h * _BASE + x + np.uint64(1)
    return h


class Lattice:
    """Marginal log probability of words under piece weights.

    Pieces are found by the hash of their characters in a table with linear
    probing. A character that is no piece of its own is spelled in bytes.
    """

    def __init__(self, names: list[str], logs: np.ndarray, end_log: float) -> None:
        self.end_log = end_log
        self.count = len(names)
        self.bytes, self.byte_ids = np.full(256, -np.inf), np.zeros(256, np.int64)
        self.ids = np.zeros(_SLOTS, np.int64)
        self.single_ids: dict[int, int] = {}
        self.keys, self.logs = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -np.inf)
        self.used = np.zeros(_SLOTS, bool)
        self.single: dict[int, float] = {}
        self.longest = self.probes = 1
        for i, (name, log) in enumerate(zip(names, logs.tolist(), strict=True)):
            if is_byte(name):
                self.bytes[int(name[3:5], 16)], self.byte_ids[int(name[3:5], 16)] = log, i
            elif not (name.startswith("<") and name.endswith(">") and len(name) > 2):
                self._insert(_hash(np.frombuffer(name.encode("utf-32-le"), "<u4").astype(np.uint64)), log, i)
                self.longest = max(self.longest, len(name))
                if len(name) == 1:
                    self.single[ord(name)], self.single_ids[ord(name)] = log, i

    def _insert(self, key: np.uint64, log: float, number: int) -> None:
        with np.errstate(over="ignore"):
            at = int((key * _SPREAD) >> _SHIFT)
        tries = 1
        while self.used[at]:
            at, tries = (at + 1) % _SLOTS, tries + 1
        self.used[at], self.keys[at], self.logs[at], self.ids[at] = True, key, log, number
        self.probes = max(self.probes, tries)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log weight of each key, and the slot it was found in."""
        flat = keys.ravel()
        at = ((flat * _SPREAD) >> _SHIFT).astype(np.int64)
        out = np.where(self.keys[at] == flat, self.logs[at], -np.inf)
        open_ = np.flatnonzero(self.used[at] & (self.keys[at] != flat))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) % _SLOTS
            here = at[open_]
            hit = self.used[here] & (self.keys[here] == flat[open_])
            out[open_[hit]] = self.logs[here[hit]]
            open_ = open_[self.used[here] & ~hit]
        return out.reshape(keys.shape), at.reshape(keys.shape)

    def _character(self, point: int) -> float:
        """A character on its own: its piece, or else its bytes."""
        found = self.single.get(point)
        if found is None:
            found = float(self.bytes[list(chr(point).encode("utf-8", "surrogatepass"))].sum())
        return found

    def _rows(self, points: np.ndarray, counts: np.ndarray | None = None, gathered: np.ndarray | None = None) -> np.ndarray:
        """Words of one length, a word a row of characters: their marginals.

        With ``counts``, how often each piece is expected in so many of each word
        is added to ``gathered``.
        """
        n, length = points.shape
        edges: list[tuple[np.ndarray, np.ndarray]] = []
        with np.errstate(over="ignore", invalid="ignore"):
            ahead = np.zeros((n, length + 1), np.uint64)
            for j in range(length):
                ahead[:, j + 1] = ahead[:, j] * _BASE + points[:, j] + np.uint64(1)
            powers = [np.uint64(1)]
            for _ in range(self.longest):
                powers.append(powers[-1] * _BASE)
            distinct, back = np.unique(points, return_inverse=True)
            back = back.reshape(points.shape)
            alone = np.array([self._character(int(x)) for x in distinct])[back]
            alpha = np.full((n, length + 1), -np.inf)
            alpha[:, 0] = 0
            for j in range(1, length + 1):
                most = min(self.longest, j)
                logs, slots = np.empty((n, most)), np.zeros((n, most), np.int64)
                logs[:, 0] = alone[:, j - 1]
                if most > 1:
                    keys = np.stack([ahead[:, j] - ahead[:, j - k] * powers[k] for k in range(2, most + 1)], axis=1)
                    logs[:, 1:], slots[:, 1:] = self._find(keys)
                if counts is not None:
                    edges.append((logs, slots))
                parts = logs + alpha[:, j - most : j][:, ::-1]
                top = parts.max(axis=1)
                alpha[:, j] = top + np.log(np.exp(parts - top[:, None]).sum(axis=1))
            if counts is None:
                return alpha[:, length]
            beta = np.full((n, length + 1), -np.inf)
            beta[:, length] = 0
            for j in range(length, 0, -1):
                logs, slots = edges[j - 1]
                most = logs.shape[1]
                before = beta[:, j - most : j][:, ::-1]
                beta[:, j - most : j] = np.logaddexp(before, logs + beta[:, j : j + 1])[:, ::-1]
                share = np.exp(logs + alpha[:, j - most : j][:, ::-1] + beta[:, j : j + 1] - alpha[:, length :]) * counts[:, None]
                hit = np.flatnonzero(share[:, 1:] > 0)
                gathered += np.bincount(self.ids[slots[:, 1:].ravel()[hit]], share[:, 1:].ravel()[hit], self.count)
                self._spell(points[:, j - 1], share[:, 0], gathered)
        return alpha[:, length]

    def _matches(self, points: np.ndarray, ahead: np.ndarray, powers: list[np.uint64], first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces that end at positions first to last - 1: (end, length, log, number; -1 for a spelled character)."""
        ends = np.arange(first, last)
        parts = [(ends, np.ones(len(ends), np.int64), np.array([self._character(int(x)) for x in points[ends - 1]]), np.full(len(ends), -1))]
        with np.errstate(over="ignore"):
            for k in range(2, self.longest + 1):
                at = ends[ends >= k]
                logs, slots = self._find(ahead[at] - ahead[at - k] * powers[k])
                hit = np.flatnonzero(logs > -np.inf)
                parts.append((at[hit], np.full(len(hit), k), logs[hit], self.ids[slots[hit]]))
        found = [np.concatenate(x) for x in zip(*parts, strict=True)]
        order = np.argsort(found[0], kind="stable")
        return tuple(x[order] for x in found)

    def _long(self, points: np.ndarray, count: float = 0.0, gathered: np.ndarray | None = None) -> float:
        """The marginal of one long word, some ``POSITIONS`` at a time.

        Probabilities are scaled numbers; a position keeps its log, 8 bytes. With
        ``gathered``, pieces are counted as ``_rows`` does.
        """
        n = len(points)
        ahead = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            h = 0
            for i, x in enumerate(points.tolist()):
                h = (h * int(_BASE) + x + 1) & 0xFFFFFFFFFFFFFFFF
                ahead[i + 1] = h
            powers = [np.uint64(1)]
            for _ in range(self.longest):
                powers.append(powers[-1] * _BASE)

        def passes(blocks, forward: bool) -> np.ndarray:
            logs = np.full(n + 1, -np.inf)
            window, scale = {0 if forward else n: 1.0}, 0.0
            logs[0 if forward else n] = 0.0
            for first, last in blocks:
                ends, lengths, weights, _ = self._matches(points, ahead, powers, first, last)
                begins = ends - lengths
                froms, tos = (begins, ends) if forward else (ends, begins)
                if not forward:
                    order = np.argsort(-ends, kind="stable")
                    froms, tos, weights = froms[order], tos[order], weights[order]
                at = None
                for a, b, w in zip(froms.tolist(), tos.tolist(), np.exp(weights).tolist(), strict=True):
                    step = b if forward else a
                    if step != at:  # a position's own sum is known once all others lie beyond
                        at = step
                        done = at - 1 if forward else at
                        own = window.get(done, 0.0)
                        logs[done] = math.log(own) + scale if own > 0 else logs[done]
                        if len(window) > 4 * self.longest:
                            window = {k: v for k, v in window.items() if (k >= at - self.longest if forward else k <= at)}
                        if own and not 1e-120 < own < 1e120:
                            scale += math.log(own)
                            window = {k: v / own for k, v in window.items()}
                    window[b] = window.get(b, 0.0) + window.get(a, 0.0) * w
            last_one = n if forward else 0
            logs[last_one] = math.log(window[last_one]) + scale
            return logs

        blocks = [(i, min(i + POSITIONS, n + 1)) for i in range(1, n + 1, POSITIONS)]
        alpha = passes(blocks, True)
        if gathered is None:
            return float(alpha[n])
        beta = passes(blocks[::-1], False)
        for first, last in blocks:
            ends, lengths, weights, numbers = self._matches(points, ahead, powers, first, last)
            share = np.exp(weights + alpha[ends - lengths] + beta[ends] - alpha[n]) * count
            whole = numbers >= 0
            gathered += np.bincount(numbers[whole], share[whole], self.count)
            self._spell(points[ends[~whole] - 1], share[~whole], gathered)
        return float(alpha[n])

    def _spell(self, points: np.ndarray, shares: np.ndarray, gathered: np.ndarray) -> None:
        """Count characters on their own: by their pieces, or else their bytes."""
        distinct, back = np.unique(points, return_inverse=True)
        for x, share in zip(distinct.tolist(), np.bincount(back.ravel(), shares, len(distinct)).tolist(), strict=True):
            if share:
                own = [self.single_ids[x]] if x in self.single_ids else self.byte_ids[list(chr(x).encode("utf-8", "surrogatepass"))]
                np.add.at(gathered, own, share)

    def expected(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is expected in so many of each word."""
        gathered = np.zeros(self.count)
        counts = counts.astype(np.float64)
        self._each(words, lambda points, at: self._rows(points, counts[at], gathered), lambda points, at: self._long(points, float(counts[at]), gathered))
        return gathered

    def words(self, words: list[bytes]) -> np.ndarray:
        """Log10 of each word's marginal probability."""
        return self._each(words, lambda points, at: self._rows(points), lambda points, at: self._long(points)) / math.log(10)

    def _each(self, words: list[bytes], rows, long) -> np.ndarray:
        """What ``rows`` makes of words of one length, block by block, and ``long`` of each long one."""
        own = [_points(x.decode("utf-8", "replace")) for x in words]
        sizes = np.array([len(x) for x in own], np.int64)
        out = np.zeros(len(words))
        for length in np.unique(sizes[sizes <= LONG]).tolist():
            at = np.flatnonzero(sizes == length)
            block = max(1, 2_000_000 // int(length * self.longest))
            for i in range(0, len(at), block):
                chosen = at[i : i + block]
                out[chosen] = rows(np.stack([own[k] for k in chosen]), chosen)
        for k in np.flatnonzero(sizes > LONG).tolist():
            out[k] = long(own[k], k)
        return out


def _larger(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of words joined, as words of a length are done side by side."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= SIDE_BY_SIDE or sum(x.nbytes for x in held) >= 1 << 23:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _counts(docs: DataFrame) -> DataFrame:
    """(word, c) of each task's training texts, and (null, number of texts)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[bytes] = Counter()
        texts = 0

        def give() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "c"])

        for batch in batches:
            for x in byte_texts(batch.column("text")):
                seen.update(lower_ascii(x).split())
                texts += 1
            if len(seen) > COUNTED_WORDS:
                yield give()
                seen.clear()
        yield give()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.binary()), pa.array([texts], pa.int64())], ["word", "c"])

    return docs.select("text").mapInArrow(step, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _summed(words: DataFrame, size: int, count) -> np.ndarray:
    """Sum over tasks of ``count()(words, their counts)``, a number per piece."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(size), count()
        for batch in _larger(batches):
            total += own(batch.column("word").to_pylist(), batch.column("c").to_numpy())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["piece", "n"])

    out = np.zeros(size)
    for r in words.select("word", "c").mapInArrow(step, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
        out[r.piece] = r.n
    return out


def _cut_counts(vocabulary: str, size: int):
    """How often words, as the vocabulary cuts them, hold each piece."""

    def begin():
        model = library(vocabulary)

        def count(words: list[bytes], times: np.ndarray) -> np.ndarray:
            found = model.encode([x.decode("utf-8", "replace") for x in words], num_threads=1)
            each = np.repeat(times, [len(x) for x in found])
            return np.bincount(np.fromiter((i for x in found for i in x), np.int64, len(each)), each, size)

        return count

    return begin


def _expected_counts(names: list[str], logs: np.ndarray):
    """How often words, summed over all their segmentations, hold each piece."""
    return lambda: Lattice(names, logs, 0.0).expected


@dataclass
class Model:
    """Training totals, the table (word, c, lattice), and piece weights."""

    tokens: int
    distinct: int
    texts: int
    words: DataFrame
    piece_logs: np.ndarray
    end_log: float


def learn(rows: DataFrame, vocabulary: str, scratch: Scratch) -> Model:
    """From ``rows`` (text): all of them are training texts."""
    counted = scratch.write(_counts(rows), "counts")
    words = counted.where(F.col("word").isNotNull())
    totals = counted.agg(F.sum("c").alias("n"), F.sum(F.when(F.col("word").isNull(), F.col("c"))).alias("texts"), F.count("word").alias("words")).first()
    texts = totals.texts or 0
    names, prior = piece_names(vocabulary), prior_counts(vocabulary)

    def logs_of(counts: np.ndarray) -> tuple[np.ndarray, float]:
        weights = np.where(prior > 0, counts + prior, 0)
        whole = weights.sum() + texts + END_PRIOR
        with np.errstate(divide="ignore"):
            return np.log(weights / whole), whole

    logs, whole = logs_of(_summed(words, len(names), _cut_counts(vocabulary, len(names))))
    for _ in range(ROUNDS):
        logs, whole = logs_of(_summed(words, len(names), _expected_counts(names, logs)))
    end_log = math.log((texts + END_PRIOR) / whole)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(names, logs, end_log)
        for batch in _larger(batches):
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(lattice.words(batch.column("word").to_pylist()))], ["word", "c", "lattice"])

    table = scratch.write(words.select("word", "c").mapInArrow(step, "word binary, c long, lattice double"), "words")
    return Model(totals.n or 0, totals.words + (texts > 0), texts, table, logs, end_log)


def _key(word: bytes) -> bytes:
    """A word, or the hash of a long one, which is longer than any word that stands for itself."""
    return word if len(word) <= KEY_BYTES else xxhash.xxh3_128_digest(word) * (KEY_BYTES // 16 + 1)


def _frequent(words: DataFrame, most: int) -> pa.Table:
    """All words of at least the least power-of-two count that no more than ``most`` reach, by their keys."""
    levels = words.groupBy(F.floor(F.log2("c")).alias("level")).count().collect()
    held, least = 0, None
    for r in sorted(levels, key=lambda r: -r.level):
        if held + r["count"] > most:
            break
        held, least = held + r["count"], r.level
    chosen = words.where(F.lit(False) if least is None else F.floor(F.log2("c")) >= least)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([_key(x) for x in batch.column("word").to_pylist()], pa.binary()), batch.column("c"), batch.column("lattice")], ["word", "c", "lattice"])

    return chosen.select("word", "c", "lattice").mapInArrow(keyed, "word binary, c long, lattice double").toArrow()


def score_texts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score every whole text; learn from those whose crc32(id) mod 7 is not 2.

    Returns per row: the id, ``held_out``, ``n_tokens`` (with the end),
    ``n_known``, ``train_tokens``, ``base_score`` (add-one unigram) and ``score``
    (the lattice), both log10. A null text counts as empty: its only token is the
    end. A row with a null id is learned from. Repeated rows count as often as
    they occur. Without training texts all counts are zero and every piece and
    the end weigh the same. Other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "lattice")
    held = F.coalesce(crc_of_id("id") % 7 == 2, F.lit(False))
    rows = text_input(docs, id_col, text_col)
    model = learn(rows.where(~held), vocabulary, scratch)
    frequent = spark.sparkContext.broadcast(_frequent(model.words, FREQUENT))
    kind = rows.schema["id"].dataType
    arrow_kind = arrow_type(kind)
    kinds = [pa.int64(), arrow_kind, pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary()]
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base", T.DoubleType()), T.StructField("lattice", T.DoubleType()), T.StructField("word", T.BinaryType()), T.StructField("kind", T.IntegerType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = frequent.value
        n = given.num_rows
        number = dict(zip(given.column("word").to_pylist(), range(n), strict=True))
        base = np.append(np.log10(given.column("c").to_numpy() + 1.0), 0)
        lattice = np.append(given.column("lattice").to_numpy(), 0)
        rid = partition_id() << 36
        for batch in batches:
            texts = [lower_ascii(x).split() for x in byte_texts(batch.column("text"))]
            codes = [np.fromiter(map(number.get, x if max(map(len, x), default=0) <= KEY_BYTES else map(_key, x), (n,) * len(x)), np.int64, len(x)) for x in texts]
            rids = np.arange(rid, rid + len(texts))
            rid += len(texts)
            sums = [(len(x) + 1, int((x < n).sum()), float(base[x].sum()), float(lattice[x].sum())) for x in codes]
            own = [rids, batch.column("id").cast(arrow_kind), *zip(*sums, strict=True), pa.nulls(len(texts), pa.binary())]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, y) if not isinstance(x, pa.Array) else x for x, y in zip(own, kinds, strict=True)), pa.array(np.zeros(len(texts), np.int32))], schema.names)
            at, times, rare = [], [], []
            for r, x, words in zip(rids.tolist(), codes, texts, strict=True):
                found = Counter([words[i] for i in np.flatnonzero(x == n).tolist()])
                at += [r] * len(found)
                rare += found.keys()
                times += found.values()
            nothing = pa.nulls(len(at), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.nulls(len(at), arrow_kind), pa.array(times, pa.int64()), nothing.cast(pa.int64()), nothing, nothing, pa.array(rare, pa.binary()), pa.array(np.ones(len(at), np.int32))], schema.names)

    scored = scratch.write(rows.mapInArrow(step, schema), "texts", "kind")
    scratch.keep("texts", "words")
    rare = scored.where("kind = 1").select("word", "rid", F.col("n_tokens").alias("times"))
    piece_logs, end_log, pieces = model.piece_logs, model.end_log, piece_names(vocabulary)

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, piece_logs, end_log)
        for batch in _larger(batches):
            values = batch.column("lattice").to_numpy(zero_copy_only=False).copy()
            new = np.flatnonzero(np.isnan(values))
            if len(new):
                values[new] = lattice.words([batch.column("word")[i].as_py() for i in new.tolist()])
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("times"), batch.column("c"), pa.array(values)], ["rid", "times", "c", "lattice"])

    joined = rare.join(model.words, "word", "left").select("word", "rid", "times", F.coalesce("c", F.lit(0)).alias("c"), "lattice")
    added = (
        joined.mapInArrow(unseen, "rid long, times long, c long, lattice double")
        .groupBy("rid")
        .agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more_base"), F.sum(F.col("times") * F.col("lattice")).alias("more_lattice"))
    )
    end_known, per_token = int(model.texts > 0), math.log10(model.tokens + model.distinct + 1)
    end_base, end_lattice = math.log10(model.texts + 1), model.end_log / math.log(10)
    return (
        scored.where("kind = 0")
        .join(added, "rid", "left")
        .select(
            F.col("id").alias(id_col),
            held.alias("held_out"),
            "n_tokens",
            (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + end_known).cast("long").alias("n_known"),
            F.lit(model.tokens).cast("long").alias("train_tokens"),
            (F.col("base") + F.coalesce("more_base", F.lit(0.0)) + end_base - F.col("n_tokens") * per_token).alias("base_score"),
            (F.col("lattice") + F.coalesce("more_lattice", F.lit(0.0)) + end_lattice).alias("score"),
        )
    )
