"""Retrieval over the chunk table: by vector, by words, or both.

The predicate filters before ranking. The best chunks are taken with some to
spare, reduced to the best of each file, and cut to the limit; each step is a
top-k or a window over what the step before kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumine.functions.text import cosine_with, terms, text_terms
from vellumine.functions.where import Names, Predicate, compile_where
from vellumine.plans.inference import kept

MODES = ("semantic", "fulltext", "hybrid")
#: Chunks taken for each file asked for; None takes all, for exact results per file.
OVERFETCH = 3
#: Okapi BM25 (Robertson and Zaragoza 2009); reciprocal rank fusion (Cormack et al. 2009).
BM25_K1, BM25_B, RRF_K = 1.2, 0.75, 60
HIT = ["filename", "score", "start_line", "end_line", "chunk_text"]


def semantic_scores(rows: DataFrame, query: list[float]) -> DataFrame:
    """Rows with ``score``: cosine similarity with the query; ``norm`` is used where rows have it."""
    return rows.withColumn("score", cosine_with("embedding", query, "norm" if "norm" in rows.columns else None))


def _weight(tf: Column, length: Column, mean_length: Column) -> Column:
    return tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * length / F.greatest(mean_length, F.lit(1e-9))))


def _idf(chunks: Column, df: Column) -> Column:
    return F.log(1 + (chunks - df + 0.5) / (df + 0.5))


def bm25_scores(postings: DataFrame, words: list[str], chunks: int, mean_length: float) -> DataFrame:
    """(chunk_id, score) of chunks that hold a word of the query, from the postings of its words.

    Counts are those of the whole index, whatever the predicate.
    """
    if not words:
        return postings.select("chunk_id", F.lit(0.0).alias("score")).where(F.lit(False))
    frequency = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighted = postings.join(F.broadcast(frequency), "term").withColumn("part", _idf(F.lit(chunks), F.col("df")) * _weight(F.col("tf"), F.col("length"), F.lit(mean_length)))
    return weighted.groupBy("chunk_id").agg(F.sum("part").alias("score"))


def term_counts(rows: DataFrame, words: list[str]) -> DataFrame:
    """(chunk_id, length, tfs) of (chunk_id, chunk_text): how often each word occurs, counted in the row."""
    cut = rows.select("chunk_id", terms(F.col("chunk_text")).alias("terms"))

    def times(word: str) -> Column:
        return F.size(F.filter("terms", lambda x: x == word))

    return cut.select("chunk_id", F.size("terms").alias("length"), F.array(*map(times, words)).alias("tfs"))


def best_by_words(rows: DataFrame, text: str, count: int) -> DataFrame:
    """The ``count`` best of (chunk_id, chunk_text) by BM25, without an index.

    Texts are cut into terms once, where they are; only counts are kept.
    """
    words = sorted(set(text_terms(text)))
    if not words:
        return rows.select("chunk_id", F.lit(0.0).alias("score")).limit(0)
    numbers = range(len(words))
    with kept(term_counts(rows, words)) as (counted,):
        sums = counted.agg(F.count(F.lit(1)).alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col("tfs")[i] > 0).alias(f"df{i}") for i in numbers]).first()
        score = F.lit(0.0)
        for i in numbers:
            score = score + _idf(F.lit(sums.n), F.lit(sums[f"df{i}"])) * _weight(F.col("tfs")[i], F.col("length"), F.lit(sums["mean"] or 0.0))
        found = top(counted.where(F.exists("tfs", lambda x: x > 0)).select("chunk_id", score.alias("score")), count).collect()
    return rows.sparkSession.createDataFrame(found, "chunk_id string, score double")


def top(rows: DataFrame, count: int | None) -> DataFrame:
    return rows if count is None else rows.orderBy(F.col("score").desc(), "chunk_id").limit(count)


def fused(legs: list[DataFrame], *more: str) -> DataFrame:
    """(chunk_id, more, score): the sum of reciprocal ranks. Legs are top lists; each is read once."""
    tagged = [x.select("chunk_id", *more, "score", F.lit(i).alias("leg")) for i, x in enumerate(legs)]
    rows = tagged[0]
    for x in tagged[1:]:
        rows = rows.unionByName(x)
    place = F.row_number().over(Window.partitionBy("leg").orderBy(F.col("score").desc(), "chunk_id"))
    ranked = rows.withColumn("part", 1.0 / (RRF_K + place))
    return ranked.groupBy("chunk_id").agg(*[F.first(x).alias(x) for x in more], F.sum("part").alias("score"))


def best_per_file(rows: DataFrame, key: str = "file_id", order: Column | None = None) -> DataFrame:
    """The highest scoring row of each file; the first chunk of equals."""
    window = Window.partitionBy(key).orderBy(F.col("score").desc(), order if order is not None else F.col("chunk_index"))
    return rows.withColumn("place", F.row_number().over(window)).where("place = 1").drop("place")


def _few(scores: DataFrame, cut: bool, take: int) -> DataFrame:
    return F.broadcast(scores) if cut and take <= 100_000 else scores


def search(index, text: str | None, mode: str = "hybrid", where: str | None = None, limit: int = 10, query: list[float] | None = None, internal_prefix: str = "", aliases: dict[str, str] | None = None, overfetch: int | None = OVERFETCH, strict: bool = True, probes: int | None = None) -> tuple[DataFrame, Predicate]:
    """The best chunk of each of the best files, and the predicate as it was read.

    ``probes`` reads only so many vector lists of a large index, for speed; None
    compares all vectors.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode '{mode}'")
    meta = index.metadata()
    predicate = compile_where(where, Names(meta["fields"], internal_prefix, aliases or {}, strict))
    rows = index.scored_rows(meta)
    if predicate.column is not None:
        rows = rows.where(predicate.column)
    if overfetch is None and mode == "hybrid":
        raise ValueError("ranks are fused over top lists: hybrid needs an overfetch")
    take = None if overfetch is None else limit * overfetch
    light = ["chunk_id", "file_id", "filepath", "chunk_index", "start_line", "end_line", "chunk_text"]

    def semantic() -> DataFrame:
        near = index.probed(query, probes, meta) if probes else None
        own = rows if near is None else rows.join(near, "chunk_id", "left_semi")
        return top(semantic_scores(own, query).select(*light, "score"), take)

    def fulltext() -> DataFrame:
        words = sorted(set(text_terms(text or "")))
        scores = bm25_scores(index.postings(words, meta), words, meta["chunks"], meta["mean_length"])
        if predicate.column is None:  # the best are known before their rows are read
            scores = top(scores, take)
        return top(rows.select(*light).join(scores if take is None else _few(scores, predicate.column is None, take), "chunk_id"), take)

    if mode == "semantic":
        found = semantic()
    elif mode == "fulltext":
        found = fulltext()
    else:
        found = top(fused([semantic(), fulltext()], *light[1:]), take)
    best = best_per_file(found)
    hits = best.orderBy(F.col("score").desc(), "filepath").limit(limit)
    return hits.select(F.col("filepath").alias("filename"), "score", "start_line", "end_line", "chunk_text"), predicate
