"""Language identification by a byte convolutional network.

Bytes are embedded, filters of several widths slide over a window, the largest
response of each filter is kept, and a softmax layer names the language. The
network is trained in numpy on a bounded sample of labelled texts, all windows of
each. When it is applied, every text is cut into fixed-length windows that cover all its bytes;
filters are looked up in tables of byte pairs, a block of windows at a time, and
a text's probabilities are the mean of its windows', weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import Scratch, arrow_type, byte_texts, crc_of_id, keyed_side, lower_ascii, small_batches, text_input

#: The training sample: about so many texts of each language, and of all together.
TEXTS_PER_LANGUAGE, TEXTS = 1200, 24_000
WINDOW = 256
UNKNOWN = "und"
_WORDLIKE = re.compile(r"[^\W\d_]")
_BLOCK = 48


def has_letter(text: str) -> bool:
    """Whether a text holds a character of a category that begins with L."""
    return any(x[0].isalpha() for x in _WORDLIKE.finditer(text))


@dataclass
class ByteCnn:
    """Embedding (256, d), filters by width (width, d, filters), and a softmax layer."""

    languages: list[str]
    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def tables(self) -> dict[int, list[tuple[int, np.ndarray]]]:
        """For each width: (offset, table) of byte pairs, and a single byte if it is odd."""
        if "_tables" not in self.__dict__:
            found = {}
            for width, weights in self.filters.items():
                single = [(self.embedding @ weights[k]).astype(np.float32) for k in range(width)]
                single[0] = single[0] + self.bias[width].astype(np.float32)
                own = [(k, (single[k][:, None] + single[k + 1][None]).reshape(65536, -1)) for k in range(0, width - 1, 2)]
                if width % 2:
                    own.append((width - 1, single[-1]))
                found[width] = own
            self._tables = found
        return self._tables

    def window_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Class probabilities of each row of bytes."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        tables = self.tables()
        for first in range(0, len(windows), _BLOCK):
            rows = windows[first : first + _BLOCK]
            wide = rows.astype(np.int32)
            pairs = (wide[:, :-1] << 8) | wide[:, 1:]
            pooled = []
            for width, own in tables.items():
                length = rows.shape[1] - width + 1
                total = None
                for offset, table in own:
                    codes = pairs if len(table) == 65536 else wide
                    part = table.take(codes[:, offset : offset + length], axis=0)
                    total = part if total is None else np.add(total, part, out=total)
                pooled.append(total.max(axis=1))
            hidden = np.maximum(np.concatenate(pooled, axis=1), 0)
            logits = hidden @ self.dense.astype(np.float32) + self.dense_bias.astype(np.float32)
            logits -= logits.max(axis=1, keepdims=True)
            np.exp(logits, out=logits)
            out[first : first + _BLOCK] = logits / logits.sum(axis=1, keepdims=True)
        return out

    def text_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the probabilities of the windows that cover each text."""
        sizes = np.array([len(x) for x in texts], np.int64)
        counts = np.maximum(1, -(-sizes // WINDOW))
        ends = np.cumsum(counts)
        out = np.zeros((len(texts), len(self.languages)), np.float64)
        first = 0
        while first < len(texts):  # about 4 MB of windows at a time, or one text
            last = max(first + 1, int(np.searchsorted(ends, ends[first] - counts[first] + 16384, side="right")))
            n = int(counts[first:last].sum())
            windows = np.frombuffer(b"".join(x.ljust(int(c) * WINDOW, b"\0") for x, c in zip(texts[first:last], counts[first:last], strict=True)), np.uint8).reshape(n, WINDOW)
            starts = np.cumsum(counts[first:last]) - counts[first:last]
            weights = np.full(n, WINDOW, np.float64)
            weights[starts + counts[first:last] - 1] = np.maximum(1, sizes[first:last] - (counts[first:last] - 1) * WINDOW)
            sums = np.add.reduceat(self.window_probabilities(windows) * weights[:, None], starts, axis=0)
            out[first:last] = sums / np.add.reduceat(weights, starts)[:, None]
            first = last
        return out


def train(windows: np.ndarray, labels: list[str], texts: np.ndarray | None = None, widths: tuple[int, ...] = (2, 3, 4), depth: int = 8, filters: int = 16, steps: int = 320, batch: int = 64, rate: float = 0.01, seed: int = 7) -> ByteCnn:
    """Adam on the cross entropy; the gradient of a maximum goes to its place.

    A language is drawn, then one of its texts, then one of the text's windows, so
    long texts weigh as much as short ones. ``texts`` (ascending) says which window
    is whose. The order of rows decides the result, so give them in a fixed order.
    """
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    texts = np.arange(len(labels)) if texts is None else texts
    begins = np.flatnonzero(np.concatenate([[True], np.diff(texts) > 0]))
    ends = np.append(begins[1:], len(texts))
    target = np.searchsorted(languages, labels)[begins]
    own = [np.flatnonzero(target == i) for i in range(len(languages))]
    hidden = filters * len(widths)
    names = ["embedding", *(f"filter{w}" for w in widths), *(f"bias{w}" for w in widths), "dense", "dense_bias"]
    shapes = [(256, depth), *((w * depth, filters) for w in widths), *((filters,) for _ in widths), (hidden, len(languages)), (len(languages),)]
    p = {k: np.zeros(s) if k.startswith(("bias", "dense_b")) else rng.normal(0, 0.3 if k == "embedding" else (2 / s[0]) ** 0.5, s) for k, s in zip(names, shapes, strict=True)}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    for t in range(1, steps + 1):
        classes = rng.integers(0, len(languages), batch)
        chosen = np.array([rng.choice(own[c]) for c in classes])
        x = windows[rng.integers(begins[chosen], ends[chosen])].astype(np.int64)
        embedded = p["embedding"][x]
        kept, responses = [], []
        for w in widths:
            patches = np.lib.stride_tricks.sliding_window_view(embedded, w, axis=1).transpose(0, 1, 3, 2).reshape(batch, -1, w * depth)
            z = patches @ p[f"filter{w}"] + p[f"bias{w}"]
            at = z.argmax(axis=1)
            kept.append((w, patches, at))
            responses.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0])
        raw = np.concatenate(responses, axis=1)
        h = np.maximum(raw, 0)
        logits = h @ p["dense"] + p["dense_bias"]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        d = e / e.sum(axis=1, keepdims=True)
        d[np.arange(batch), classes] -= 1
        d /= batch
        g = {"dense": h.T @ d, "dense_bias": d.sum(axis=0), "embedding": np.zeros_like(p["embedding"])}
        dh = (d @ p["dense"].T) * (raw > 0)
        for i, (w, patches, at) in enumerate(kept):
            own_d = dh[:, i * filters : (i + 1) * filters]
            chosen = np.take_along_axis(patches, at[:, :, None], axis=1)  # batch, filters, w * depth
            g[f"filter{w}"] = np.einsum("bfk,bf->kf", chosen, own_d)
            g[f"bias{w}"] = own_d.sum(axis=0)
            back = (own_d[:, :, None] * p[f"filter{w}"].T[None]).reshape(batch, filters, w, depth)
            places = at[:, :, None] + np.arange(w)
            np.add.at(g["embedding"], x[np.arange(batch)[:, None, None], places], back)
        for k in p:
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
            p[k] -= rate * (1 - 0.9 * (t > steps * 0.7)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return ByteCnn(languages, p["embedding"], {w: p[f"filter{w}"].reshape(w, depth, filters) for w in widths}, {w: p[f"bias{w}"] for w in widths}, p["dense"], p["dense_bias"])


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Windows, labels, and texts of the training sample, in a fixed order.

    A language's share is chosen from its count, so that about
    ``TEXTS_PER_LANGUAGE`` texts are taken wherever there are more, fewer where very
    many languages share ``TEXTS``; a text is in if its hash falls into that share.
    """
    rows = text_input(docs, id_col, text_col, docs[lang_col].cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.coalesce(crc_of_id("id"), F.lit(0)) % 4 != 2))
    scratch = Scratch(docs.sparkSession, "languages")
    # equal texts are drawn together, so each is taken once
    counts = scratch.write(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "counts")
    languages = counts.count()
    each = min(TEXTS_PER_LANGUAGE, max(1, TEXTS // max(languages, 1)))
    drawn = rows.join(keyed_side(counts), "lang").where(F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30)) < F.lit(each) / F.col("n") * (1 << 30)).select("lang", "text").distinct()
    drawn = drawn.withColumn("key", F.xxhash64("text")).toArrow()
    scratch.drop()
    windows, labels, texts = [], [], []
    found = sorted(zip(drawn.column("lang").to_pylist(), drawn.column("key").to_pylist(), byte_texts(drawn.column("text").combine_chunks()), strict=True))
    for number, (lang, _, text) in enumerate(found):
        low = lower_ascii(text)
        for at in range(0, max(len(low), 1), WINDOW):
            window = low[at : at + WINDOW]
            if has_letter(window.decode("utf-8", "ignore")):
                windows.append(window.ljust(WINDOW, b"\0"))
                labels.append(lang)
                texts.append(number)
    return np.frombuffer(b"".join(windows), np.uint8).reshape(-1, WINDOW), labels, np.array(texts, np.int64)


def language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteCnn | None:
    """Train on rows of ``docs`` whose crc32(id) mod 4 is not 2; None without any label.

    The sample of at most about ``TEXTS`` whole texts goes to the driver; texts that
    repeat under one language are one of it.
    """
    small_batches(docs.sparkSession)
    windows, labels, texts = _sample(docs, id_col, text_col, lang_col)
    return train(windows, labels, texts) if labels else None


def _predict(model: ByteCnn | None, column: pa.Array) -> tuple[list[str], list[float]]:
    raw = byte_texts(column)
    named = [i for i, x in enumerate(raw) if model is not None and has_letter(x.decode("utf-8", "replace"))]
    langs, scores = [UNKNOWN] * len(raw), [0.0] * len(raw)
    if named:
        found = model.text_probabilities([lower_ascii(raw[i]) for i in named])
        for i, row in zip(named, found, strict=True):
            best = int(row.argmax())
            langs[i], scores[i] = model.languages[best], min(1.0, float(row[best]))
    return langs, scores


def identify_languages(docs: DataFrame, model: ByteCnn | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``held_out`` (crc32(id) mod 4 is 2), ``lang_pred``, ``score``.

    A null text, and one without a letter, gets ``und`` and score 0, as does
    every text if there was nothing to learn from. A null id isn't held out.
    Ties between languages go to the first by name. Texts of any length are read
    whole, some 4 MB at a time. Repeated rows give repeated results, an empty table
    an empty one. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = text_input(docs, id_col, text_col)
    kind = rows.schema["id"].dataType
    arrow_kind = arrow_type(kind)
    schema = T.StructType([T.StructField("id", kind), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predict(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(arrow_kind), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return rows.mapInArrow(step, schema).select(F.col("id").alias(id_col), F.coalesce(crc_of_id("id") % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, model: ByteCnn | None, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text has a language with a score of ``least`` or more.

    Null texts and those without letters go, at any length texts are judged whole,
    repeated rows all stay or all go, and all columns are returned as they are.
    Without a model nothing is rejected.
    """
    if model is None:
        return docs
    small_batches(docs.sparkSession)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = _predict(model, batch.column(text_col))
            yield batch.filter(pa.array([x != UNKNOWN and y >= least for x, y in zip(langs, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(step, docs.schema)
