"""Quality classification by histogram gradient-boosted trees.

A text becomes a row of statistics over its bytes, words and lines. Trees are
grown in numpy on binned statistics of a bounded sample of labelled rows, level
by level, from histograms of gradients. They are complete, so their nodes lie
in flat arrays and all rows walk all trees by index arithmetic.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import Scratch, arrow_type, byte_texts, crc_of_id, keyed_side, small_batches, text_input

#: Labelled rows that training takes at most, by expectation.
TRAINING_ROWS = 40_000
THRESHOLD = 0.7
BINS = 64

_CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "space": (9, 10, 11, 12, 13, 32), "wide": range(128, 256), "control": (*range(9), *range(14, 32), 127), "stop": b".", "comma": b",;:", "bar": b"|", "bang": b"!?", "symbol": b"#$%&*@^~<>{}[]\\=+_`", "slash": b"/-", "quote": b"\"'()"}
_MEMBERS = np.array([[byte in members for members in _CLASSES.values()] for byte in range(256)], np.float64)
FEATURES = [*_CLASSES, "bytes", "words", "word_length", "longest_word", "distinct_words", "top_word", "lines", "line_words", "distinct_lines", "longest_line", "entropy", "wordless", "capitals"]


def statistics(text: bytes) -> list[float]:
    """``FEATURES`` of one text; all finite, also of an empty one."""
    n = len(text)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = (counts @ _MEMBERS) / max(n, 1)
    words, lines = text.split(), text.split(b"\n")
    distinct = Counter(words)
    some = counts[counts > 0] / max(n, 1)
    longest = max(map(len, words), default=0)
    count = max(len(words), 1)
    return [
        *shares.tolist(),
        math.log1p(n),
        math.log1p(len(words)),
        sum(map(len, words)) / count,
        math.log1p(longest),
        len(distinct) / count**0.8,
        max(distinct.values(), default=0) / count,
        math.log1p(len(lines)),
        math.log1p(len(words) / len(lines)),
        len(set(lines)) / len(lines),
        max(map(len, lines)) / max(n, 1),
        float(-(some * np.log2(some)).sum()) if n else 0.0,
        sum(1 for x in distinct if not x.isalpha() and len(x) < 4) / count,
        sum(c for x, c in distinct.items() if len(x) > 2 and x.isupper()) / count,
    ]


@dataclass
class Forest:
    """Complete trees of one depth: node ``i`` has children ``2i+1`` and ``2i+2``."""

    edges: np.ndarray  # (features, BINS - 1): upper ends of the bins
    feature: np.ndarray  # (trees, inner nodes)
    split: np.ndarray  # (trees, inner nodes): bins up to this one go left
    value: np.ndarray  # (trees, leaves)
    start: float

    def bins(self, rows: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x, side="left") for e, x in zip(self.edges, rows.T, strict=True)], axis=1).astype(np.uint8) if len(rows) else np.zeros(rows.shape, np.uint8)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of statistics."""
        binned = self.bins(rows)
        total, here = np.full(len(rows), self.start), np.arange(len(rows))
        inner = self.feature.shape[1] if len(self.feature) else 0
        for feature, split, value in zip(self.feature, self.split, self.value, strict=True):
            node = np.zeros(len(rows), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (binned[here, feature[node]] > split[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(rows: np.ndarray, labels: np.ndarray, times: np.ndarray | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, ridge: float = 2.0) -> Forest:
    """Boost logistic loss; a row counts ``times``. Equal gains go to the first feature and the lowest bin."""
    n, width = rows.shape
    times = np.ones(n) if times is None else times.astype(np.float64)
    edges = np.quantile(rows, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if n else np.zeros((width, BINS - 1))
    share = ((labels * times).sum() + 1) / (times.sum() + 2)
    forest = Forest(edges, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth)), math.log(share / (1 - share)))
    if not n or labels.min() == labels.max():
        return forest
    binned = forest.bins(rows).astype(np.int64)
    total = np.full(n, forest.start)
    features, splits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = (labels - p) * times, p * (1 - p) * times
        feature, split = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, BINS, np.int64)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 2**level, 2**level - 1
            best, gains = np.full(nodes, 1e-6), np.zeros((nodes, 2), np.int64) + [0, BINS]
            for f in range(width):
                key = (node - first) * BINS + binned[:, f]
                g = np.bincount(key, gradient, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                h = np.bincount(key, weight, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                gain = g**2 / (h + ridge) + gr**2 / (hr + ridge) - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                at = gain.argmax(axis=1)
                value = gain[np.arange(nodes), at]
                better = value > best
                best[better], gains[better, 0], gains[better, 1] = value[better], f, at[better]
            feature[first : first + nodes], split[first : first + nodes] = gains[:, 0], gains[:, 1]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > split[node])
        leaf = node - (2**depth - 1)
        value = rate * np.bincount(leaf, gradient, 2**depth) / (np.bincount(leaf, weight, 2**depth) + ridge)
        total += value[leaf]
        features.append(feature)
        splits.append(split)
        values.append(value)
    forest.feature, forest.split, forest.value = np.stack(features), np.stack(splits), np.stack(values)
    return forest


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, len(FEATURES))


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and the statistics of each text as binary doubles."""
    rows = text_input(docs, id_col, text_col)
    kind = rows.schema["id"].dataType
    arrow_kind = arrow_type(kind)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(statistics(x)).tobytes() for x in byte_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(arrow_kind), pa.array(found, pa.binary())], ["id", "features"])

    return rows.mapInArrow(step, T.StructType([T.StructField("id", kind), T.StructField("features", T.BinaryType())]))


def _drawn(labels: DataFrame, id_col: str, label_col: str, scratch: Scratch) -> DataFrame:
    """(id, label, times) of labelled ids to learn from: at most about ``TRAINING_ROWS``."""
    marked = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("label")).where(F.col("label").isNotNull() & F.col("id").isNotNull() & (crc_of_id("id") % 4 != 2))
    share = min(1.0, TRAINING_ROWS / max(marked.count(), 1))
    in_share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < share * (1 << 30)
    return scratch.write(marked.where(in_share).groupBy("id", "label").agg(F.count(F.lit(1)).alias("times")), "labels")


def _trained(described: DataFrame, scratch: Scratch) -> Forest:
    """From (label, times, features): equal rows are one with their times, and a hash bounds the others."""
    rows = scratch.write(described.groupBy("label", "features").agg(F.sum("times").alias("times")), "examples")
    share = min(1.0, TRAINING_ROWS / max(rows.count(), 1))
    found = sorted((bytes(r.features), r.label, r.times) for r in rows.where(F.pmod(F.xxhash64("features", "label"), F.lit(1 << 30)) < share * (1 << 30)).collect())
    features = np.frombuffer(b"".join(x for x, _, _ in found), np.float64).reshape(-1, len(FEATURES))
    return grow(features, np.array([float(y > 0) for _, y, _ in found]), np.array([float(t) for _, _, t in found]))


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Forest:
    """Grow trees from labelled rows whose crc32(id) mod 4 is not 2.

    Only rows whose labels are drawn have their statistics computed.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality-model")
    drawn = _drawn(labels, id_col, label_col, scratch)
    ids = scratch.write(drawn.select("id").distinct(), "ids")
    texts = text_input(docs, id_col, text_col).join(keyed_side(ids), "id", "left_semi")
    forest = _trained(_described(texts, "id", "text").join(keyed_side(drawn), "id"), scratch)
    scratch.drop()
    return forest


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Per row: id, ``held_out`` (crc32(id) mod 4 is 2), ``score``, ``predicted``.

    Statistics are computed once and written; training and scoring read them.
    Null and empty texts have statistics too, and equal ones. Without labels, or
    with labels of one kind only, all texts get the labels' smoothed share. A
    null id isn't held out. Null labels are left out, repeated ones count as
    often as they occur. A text of any length is read whole, and has its own
    statistics only in memory. Repeated rows give repeated results, an empty table
    an empty one; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "quality")
    described = scratch.write(_described(docs, id_col, text_col), "statistics")
    drawn = _drawn(labels, id_col, label_col, scratch)
    forest = _trained(described.join(keyed_side(drawn), "id"), scratch)
    scratch.keep("statistics")
    kind = described.schema["id"].dataType
    arrow_kind = arrow_type(kind)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(arrow_kind), pa.array(forest.scores(_matrix(batch.column("features"))))], ["id", "score"])

    scored = described.mapInArrow(step, T.StructType([T.StructField("id", kind), T.StructField("score", T.DoubleType())]))
    return scored.select(F.col("id").alias(id_col), F.coalesce(crc_of_id("id") % 4 == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, forest: Forest, text_col: str = "text", least: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score ``least`` or more, with all their columns.

    Null texts are judged as empty ones, texts of any length whole; repeated rows
    all stay or all go. A forest that had nothing to tell apart rejects nothing.
    """
    if not len(forest.feature):
        return docs
    small_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([statistics(x) for x in byte_texts(batch.column(text_col))], np.float64).reshape(-1, len(FEATURES))
            yield batch.filter(pa.array(forest.scores(rows) >= least))

    return docs.mapInArrow(step, docs.schema)
