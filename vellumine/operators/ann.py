"""Approximate nearest neighbours by an inverted file of vector lists.

Centroids are fitted on a bounded sample; every vector is assigned to its
nearest one and written in the order of lists, so a query reads only the lists it
probes: neighbouring lists share a shard of bounded size, shards are Parquet
partitions that Spark prunes, and statistics of pages skip the other lists of a
shard. A list beyond a shard's size is dealt to several files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.operators.search import semantic_scores, top

#: Vectors that centroids are fitted on, by expectation.
SAMPLE = 20_000
#: Bytes of vectors in a file of lists, about.
FILE_BYTES = 1 << 26
#: Tables of fewer vectors are searched exactly.
LEAST_VECTORS = 10_000


def _units(column: pa.Array) -> np.ndarray:
    found = np.array(column.to_pylist(), np.float32).reshape(len(column), -1)
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)


def fit_centroids(rows: DataFrame, lists: int, count: int, rounds: int = 12, seed: int = 11) -> np.ndarray:
    """Spherical k-means on a sample that is chosen by hash of ``chunk_id``."""
    share = min(1.0, SAMPLE / max(count, 1))
    drawn = rows.where("embedding is not null").where(F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30)) < share * (1 << 30))
    table = drawn.select("chunk_id", "embedding").toArrow().sort_by("chunk_id")
    vectors = _units(table.column("embedding"))
    rng = np.random.default_rng(seed)
    centroids = vectors[rng.choice(len(vectors), min(lists, len(vectors)), replace=False)]
    for _ in range(rounds):
        near = (vectors @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, vectors)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
    return centroids


def centroids_of(table: DataFrame) -> np.ndarray:
    """Centroids from their table (list, centroid), about the square root of the vectors in number."""
    found = table.orderBy("list").toArrow()
    return np.array(found.column("centroid").to_pylist(), np.float32).reshape(found.num_rows, -1)


def nearest_lists(table: DataFrame, query: list[float], probes: int) -> list[int]:
    """The lists whose centroids are nearest to a query, from their table."""
    scored = semantic_scores(table.withColumnRenamed("centroid", "embedding"), query)
    return [r.list for r in scored.orderBy(F.col("score").desc(), "list").limit(probes).collect()]


def assigned(rows: DataFrame, centroids: np.ndarray, shards: np.ndarray | None = None, files: np.ndarray | None = None) -> DataFrame:
    """(chunk_id, embedding, list, shard, file): each vector's nearest centroid, and where it goes."""
    shards = np.zeros(len(centroids), np.int32) if shards is None else shards
    files = np.ones(len(centroids), np.int64) if files is None else files

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = (_units(batch.column("embedding")) @ centroids.T).argmax(axis=1) if batch.num_rows else np.zeros(0, np.int64)
            spread = np.array([zlib.crc32(x.encode()) for x in batch.column("chunk_id").to_pylist()], np.int64)
            more = [pa.array(near.astype(np.int32)), pa.array(shards[near]), pa.array((spread % files[near]).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "list", "shard", "file"])

    kept = rows.select("chunk_id", "embedding").where("embedding is not null")
    return kept.mapInArrow(step, T.StructType([*kept.schema.fields, *(T.StructField(x, T.IntegerType()) for x in ("list", "shard", "file"))]))


def write_lists(rows: DataFrame, path: str, centroids: np.ndarray, count: int) -> None:
    """Write vectors in the order of the lists of their nearest centroids."""
    most = max(1, FILE_BYTES // (4 * centroids.shape[1]))
    shards = files = None
    if count > most:
        sizes = np.zeros(len(centroids), np.int64)
        for r in assigned(rows, centroids).groupBy("list").count().collect():  # a row a list
            sizes[r.list] = r["count"]
        shards = ((np.cumsum(sizes) - sizes) // most).astype(np.int32)
        files = np.maximum(1, -(-np.bincount(shards, sizes) // most)).astype(np.int64)[shards]
    dealt = assigned(rows, centroids, shards, files).repartition("shard", "file").sortWithinPartitions("shard", "list")
    dealt.drop("file").write.partitionBy("shard").parquet(path)
    of = np.zeros(len(centroids), np.int32) if shards is None else shards
    rows.sparkSession.createDataFrame([(i, int(x)) for i, x in enumerate(of.tolist())], "list int, shard int").coalesce(1).write.parquet(f"{path}-shards")


def read_lists(spark: SparkSession, path: str, lists: list[int]) -> DataFrame:
    """Vectors of some lists; others are pruned by shard, or skipped by a page's statistics."""
    shards = [r.shard for r in spark.read.parquet(f"{path}-shards").where(F.col("list").isin(lists)).select("shard").distinct().collect()]
    return spark.read.parquet(path).where(F.col("shard").isin(shards) & F.col("list").isin(lists))


def probed(spark: SparkSession, path: str, centroids: np.ndarray, query: list[float], probes: int) -> DataFrame:
    """Vectors of the lists nearest to the query; only these are read."""
    near = np.argsort(-(centroids @ np.asarray(query, np.float32)), kind="stable")[:probes]
    return read_lists(spark, path, [int(x) for x in near])


def nearest(spark: SparkSession, path: str, centroids: np.ndarray, query: list[float], count: int, probes: int) -> DataFrame:
    """(chunk_id, score) of the best in the probed lists."""
    return top(semantic_scores(probed(spark, path, centroids, query, probes), query), count).select("chunk_id", "score")
