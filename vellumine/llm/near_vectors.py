"""Near-duplicate vectors by random hyperplanes.

Equal vectors are one class with a weight. A class is hashed in several tables
by the signs of its products with random hyperplanes. Tables grow in bits with
the number of vectors and in number with the bits, for the same recall at every
size. Buckets move 48 bytes a member, not vectors: a sketch of 256 signs rules
out members that are far apart, and a bucket gives no more links than it has
members. A bucket beyond ``BLOCK`` is hashed again by further bits, in as many
copies as keep the recall.

Connected candidates are a cluster. A cluster's vectors go to cells of two
blocks, once for each block of the cluster, and are compared there exactly, as
matrix products in double precision, so links are summed where they are found
and no pair is ever shuffled. Clusters of more than ``WHOLE`` classes are hashed
in tables of their own first; a pair then counts in the first table in which it
meets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.blocks import cells, forest, runs, whole_runs
from vellumine.llm.common import Scratch, arrow_type, hot_join, keyed_side, partition_id
from vellumine.llm.components import connected_components

#: Chance that a pair exactly at the threshold meets in some table, and that one
#: in a bucket that is hashed again meets in one of its copies.
RECALL, AGAIN = 0.998, 0.999
#: Members of a block; a task holds two blocks.
BLOCK = 1024
#: Classes of a cluster that are all compared with one another.
WHOLE = 16 * BLOCK
#: Signs of a sketch, and standard deviations that a pair at the threshold is allowed.
SIGNS, SPARE = 256, 4.0
#: Members up to which buckets of a size are done side by side, and pairs at a time.
SMALL, PAIRS = 48, 1 << 19
_SEED = 20240607
_WORDS = [f"s{i}" for i in range(SIGNS // 64)]


def _agree(threshold: float) -> float:
    """Chance that one hyperplane leaves a pair at the threshold on one side."""
    return 1 - math.acos(threshold) / math.pi


def _copies(bits: int, threshold: float, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - min(_agree(threshold) ** bits, 1 - 1e-9)))


def tables_for(count: int, threshold: float) -> tuple[int, int]:
    """(bits, tables): buckets of some ten vectors, and ``RECALL`` at the threshold."""
    bits = min(60, max(6, math.ceil(math.log2(max(count, 2))) - 4))
    return bits, _copies(bits, threshold, RECALL)


def most_signs(threshold: float) -> int:
    """Signs of the sketch in which candidates may differ."""
    p = 1 - _agree(threshold)
    return math.ceil(SIGNS * p + SPARE * math.sqrt(SIGNS * p * (1 - p)))


def _vectors(rows: DataFrame) -> DataFrame:
    """(rid, id, key, vec): the numbers in bytes and their 128-bit hash, or nulls where they can't link."""
    kind = arrow_type(rows.schema["id"].dataType)
    number = np.dtype(np.float32 if rows.schema["vec"].dataType.elementType == T.FloatType() else np.float64)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = partition_id() << 36
        for batch in batches:
            column, n = batch.column("vec"), batch.num_rows
            numbers = np.ascontiguousarray(column.values.to_numpy(zero_copy_only=False), number)  # nulls are not numbers
            bounds, given = column.offsets.to_numpy().astype(np.int64), column.is_valid().to_numpy(zero_copy_only=False)
            odd, some = (np.concatenate([[0], np.cumsum(x)]) for x in (~np.isfinite(numbers), numbers != 0))
            sound = given & (odd[bounds[1:]] == odd[bounds[:-1]]) & (some[bounds[1:]] > some[bounds[:-1]])
            out = [numbers[a:b].tobytes() if ok else None for a, b, ok in zip(bounds[:-1].tolist(), bounds[1:].tolist(), sound.tolist(), strict=True)]
            keys = [None if x is None else xxhash.xxh3_128_digest(x) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + n)), batch.column("id").cast(kind), pa.array(keys, pa.binary()), pa.array(out, pa.binary())], ["rid", "id", "key", "vec"])
            rid += n

    return rows.mapInArrow(step, T.StructType([T.StructField("rid", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("key", T.BinaryType()), T.StructField("vec", T.BinaryType())]))


def _units(raw: list[bytes], number: np.dtype) -> np.ndarray:
    """Vectors of one dimension, scaled to length 1; first by their largest number, as squares may overflow."""
    found = np.frombuffer(b"".join(raw), number).reshape(len(raw), -1).astype(np.float64)
    found /= np.abs(found).max(axis=1)[:, None]
    return found / np.sqrt(np.einsum("ij,ij->i", found, found))[:, None]


def _sides(units: np.ndarray, count: int) -> np.ndarray:
    """On which side of ``count`` hyperplanes each vector lies; more planes begin with the same ones."""
    rng, dim = np.random.default_rng([_SEED, units.shape[1]]), units.shape[1]
    return units @ rng.normal(size=(count, dim)).T > 0


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return x ^ (x >> np.uint64(31))


def _of_dimension(batches: Iterator[pa.RecordBatch], number: np.dtype) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        raw = batch.column("vec").to_pylist()
        sizes = np.array([len(x) for x in raw])
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            yield batch.take(pa.array(at)), _units([raw[i] for i in at.tolist()], number)


def _sketched(bits: int, tables: int, number: np.dtype):
    """A row per class and table: (bucket, cid, and the sketch's words)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, units in _of_dimension(batches, number):
            n, dim = units.shape
            sides = _sides(units, max(SIGNS, bits * tables))
            words = np.packbits(sides[:, :SIGNS], axis=1).view(np.int64)
            sigs = sides[:, : bits * tables].reshape(n, tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
            places = _mixed(np.arange(tables) * 4099 + dim * 1_000_003)
            buckets = _mixed(sigs.astype(np.uint64) + places).view(np.int64)
            cid = own.column("cid").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(buckets.ravel()), pa.array(np.repeat(cid, tables)), *(pa.array(np.repeat(words[:, i], tables)) for i in range(len(_WORDS)))], ["bucket", "cid", *_WORDS])

    return step


def _hashed_again(threshold: float):
    """Members of large buckets by further signs of their sketch, a row per copy."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, cid, total = (batch.column(x).to_numpy() for x in ("bucket", "cid", "total"))
            words = np.stack([batch.column(x).to_numpy() for x in _WORDS], axis=1)
            more = np.clip(np.ceil(np.log2(total / (BLOCK / 16))), 1, 24).astype(np.int64)
            for bits in np.unique(more).tolist():
                at = np.flatnonzero(more == bits)
                signs = np.unpackbits(words[at].view(np.uint8), axis=1)
                for copy in range(_copies(bits, threshold, AGAIN)):
                    chosen = np.random.default_rng([_SEED, bits, copy]).choice(SIGNS, bits, replace=False)
                    own = signs[:, chosen].astype(np.int64) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
                    again = _mixed(bucket[at].view(np.uint64) + _mixed(own * 64 + copy)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(again), pa.array(cid[at]), *(pa.array(words[at, i]) for i in range(len(_WORDS)))], ["bucket", "cid", *_WORDS])

    return step


def _side_by_side(starts: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(first rows, size) of runs of at least two rows: small ones of a size together, others alone."""
    lengths = ends - starts
    for length in np.unique(lengths[lengths > 1]).tolist():
        own = starts[lengths == length]
        step = max(1, PAIRS // (length * length)) if length <= SMALL else 1
        for i in range(0, len(own), step):
            yield own[i : i + step], length


def _candidates(most: int):
    """Links (a, b) that connect the members of each cell whose sketches are near."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "cell"):
            words = np.stack([table.column(x).to_numpy() for x in _WORDS], axis=1).view(np.uint64)
            cid, left, right = table.column("cid").to_numpy(), [], []
            for first, length in _side_by_side(*runs(table.column("cell").to_numpy())):
                if length <= SMALL:
                    i, j = np.triu_indices(length, 1)
                    a, b = (first[:, None] + i).ravel(), (first[:, None] + j).ravel()
                    near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1) <= most
                    left.append(a[near])
                    right.append(b[near])
                    continue
                start = int(first[0])
                signs = np.unpackbits(words[start : start + length].view(np.uint8), axis=1).astype(np.float32) * 2 - 1
                for k in range(0, length, BLOCK):
                    a, b = np.nonzero(signs[k : k + BLOCK] @ signs.T >= SIGNS - 2 * most)
                    after = a + k < b
                    left.append(start + k + a[after])
                    right.append(start + b[after])
            none = [np.zeros(0, np.int64)]
            u, v = forest(len(cid), np.concatenate(left + none), np.concatenate(right + none))
            yield pa.RecordBatch.from_arrays([pa.array(cid[u]), pa.array(cid[v])], ["a", "b"])

    return step


def _signed(bits: int, tables: int, number: np.dtype):
    """A row per class and table: (tab, dim, bucket, cid, w, vec, sigs)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, units in _of_dimension(batches, number):
            n, dim = units.shape
            sigs = _sides(units, bits * tables).reshape(n, tables, bits) @ (np.int64(1) << np.arange(bits, dtype=np.int64))
            raw = pa.array([x.tobytes() for x in sigs], pa.binary())
            for t in range(tables):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(np.full(n, dim, np.int32)), pa.array(sigs[:, t]), own.column("cid"), own.column("w"), own.column("vec"), raw], ["tab", "dim", "bucket", "cid", "w", "vec", "sigs"])

    return step


_CELL = ["cell", "tab", "dim", "bucket", "low", "high"]


def _meets_first(sigs: list[bytes], tab: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether no table before a pair's own has put the two in one bucket."""
    out = np.ones(len(a), bool)
    later = np.flatnonzero(tab[a] > 0)
    for i in range(0, len(later), 1 << 16):
        some = later[i : i + (1 << 16)]
        same = np.equal(*(np.frombuffer(b"".join([sigs[r] for r in x[some].tolist()]), np.int64).reshape(len(some), -1) for x in (a, b)))
        out[some] = ~(same & (np.arange(same.shape[1]) < tab[a[some]][:, None])).any(axis=1)
    return out


def _compared(threshold: float, number: np.dtype):
    """From rows sorted by ``_CELL``: sums of linked weights (a, null, n) and links of a spanning forest (a, b, null)."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "cell"):
            tab, dim, own, low, high, cid, weight = (table.column(x).to_numpy() for x in ("tab", "dim", "own", "low", "high", "cid", "w"))
            raw, sigs = table.column("vec").to_pylist(), table.column("sigs").to_pylist()
            # a hash of cells may put two buckets together; they are told apart here
            changes = np.any([np.diff(table.column(x).to_numpy()) != 0 for x in _CELL], axis=0)
            starts, ends = runs(np.concatenate([[0], np.cumsum(changes)]))
            total, left, right = np.zeros(len(cid)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for size in np.unique(dim[starts]).tolist():
                of_size = dim[starts] == size
                for first, length in _side_by_side(starts[of_size], ends[of_size]):
                    rows = (first[:, None] + np.arange(length)).ravel().tolist()
                    x = _units([raw[i] for i in rows], number).reshape(len(first), length, -1)
                    for k in range(0, length, BLOCK):
                        run, a, b = np.nonzero(x[:, k : k + BLOCK] @ x.transpose(0, 2, 1) >= threshold)
                        once = a + k < b
                        a, b = first[run[once]] + a[once] + k, first[run[once]] + b[once]
                        counts = (low[a] == high[a]) | (own[a] != own[b])
                        counts &= _meets_first(sigs, tab, a, b)
                        a, b = a[counts], b[counts]
                        total += np.bincount(a, weight[b], len(cid)) + np.bincount(b, weight[a], len(cid))
                        left.append(a)
                        right.append(b)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cid[at]), pa.nulls(len(at), pa.int64()), pa.array(total[at].astype(np.int64))], ["a", "b", "n"])
            u, v = forest(len(cid), np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_arrays([pa.array(cid[u]), pa.array(cid[v]), pa.nulls(len(u), pa.int64())], ["a", "b", "n"])

    return step


def _clusters(classes: DataFrame, count: int, threshold: float, number: np.dtype, scratch: Scratch) -> DataFrame:
    """(id, component): classes that a chain of candidates connects."""
    entries = classes.select("cid", "vec").mapInArrow(_sketched(*tables_for(count, threshold), number), ", ".join(["bucket long", "cid long", *(f"{x} long" for x in _WORDS)]))
    large = scratch.write(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("total")).where(F.col("total") > BLOCK), "large")
    dealt = entries.withColumnRenamed("bucket", "cell")
    if not large.isEmpty():
        kept = keyed_side(large)
        again = entries.join(kept, "bucket").mapInArrow(_hashed_again(threshold), entries.schema)
        dealt = entries.join(kept, "bucket", "left_anti").withColumnRenamed("bucket", "cell").unionByName(cells(again, ["bucket"], "cid", BLOCK, scratch, "larger").select("cell", "cid", *_WORDS))
    links = dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(_candidates(most_signs(threshold)), "a long, b long")
    return scratch.write(connected_components(links, scratch, "candidates"), "clusters")


def _entries(classes: DataFrame, clusters: DataFrame, threshold: float, number: np.dtype, scratch: Scratch) -> DataFrame:
    """Vectors that have candidates, in the cells where they are compared."""
    sizes = clusters.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    huge = scratch.write(sizes.where(F.col("size") > WHOLE), "huge")
    in_huge = 0 if huge.isEmpty() else huge.agg(F.sum("size")).first()[0]
    # vectors are what is large: only those of clusters move
    found = scratch.write(classes.select("cid", "w", "vec").join(keyed_side(clusters.withColumnRenamed("id", "cid")), "cid"), "clustered")
    found = found.withColumn("dim", F.floor(F.octet_length("vec") / F.lit(number.itemsize)).cast("int"))
    common = ["tab", "dim", "bucket", "cid", "w", "vec", "sigs"]
    whole = found.select(F.lit(0).alias("tab"), "dim", F.col("component").alias("bucket"), "cid", "w", "vec", F.lit(None).cast("binary").alias("sigs"))
    dealt = cells(whole if not in_huge else whole.join(keyed_side(huge.withColumnRenamed("component", "bucket")), "bucket", "left_anti").select(*common), ["tab", "dim", "bucket"], "cid", BLOCK, scratch, "whole")
    if in_huge:
        apart = found.join(keyed_side(huge), "component").select("cid", "w", "vec").mapInArrow(_signed(*tables_for(in_huge, threshold), number), "tab int, dim int, bucket long, cid long, w long, vec binary, sigs binary")
        dealt = dealt.unionByName(cells(apart, ["tab", "dim", "bucket"], "cid", BLOCK, scratch, "apart"))
    return dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")).select(*_CELL, "own", "cid", "w", "vec", "sigs")


def near_vectors(table: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per row: id, ``n_links``, ``component_id``, ``kept``.

    Vectors that are null, empty, zero, or hold a null or a number that isn't
    finite link with nothing, as do vectors of different lengths. Rows that
    repeat an id and a vector link with one another like any equal vectors. A
    null id is never the smallest. An empty table gives an empty result. Vectors
    may be of any length; numbers other than floats are compared as doubles, and
    squares may overflow. Other columns are ignored.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "vectors")
    given = table.select(table[id_col].alias("id"), table[vector_col].alias("vec"))
    if given.schema["vec"].dataType.elementType != T.FloatType():
        given = given.withColumn("vec", F.col("vec").cast("array<double>"))
    number = np.dtype(np.float32 if given.schema["vec"].dataType.elementType == T.FloatType() else np.float64)
    rows = scratch.write(_vectors(given), "rows")
    classes = scratch.write(rows.where("key is not null").groupBy("key").agg(F.min("rid").alias("cid"), F.count(F.lit(1)).alias("w"), F.min("id").alias("least"), F.min_by("vec", "rid").alias("vec")), "classes")
    clusters = _clusters(classes, classes.count(), threshold, number, scratch)
    dealt = _entries(classes, clusters, threshold, number, scratch).repartition("cell").sortWithinPartitions(*_CELL)
    found = scratch.write(dealt.mapInArrow(_compared(threshold, number), "a long, b long, n long"), "found")
    linked = found.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.sum("n").alias("others"))
    groups = scratch.write(connected_components(found.where("b is not null").select("a", "b"), scratch).withColumnRenamed("id", "cid"), "groups")
    ids = classes.select("key", "cid", "w", "least")
    least = scratch.write(ids.join(keyed_side(groups), "cid").groupBy("component").agg(F.min("least").alias("smallest")), "least")
    placed = scratch.write(hot_join(groups, least, "component", "cid", scratch, "hot-components").join(linked, "cid", "left"), "placed")
    # what differs from a class of one row without links
    known = scratch.write(ids.join(keyed_side(placed), "cid", "left").where("w > 1 or component is not null").select("key", (F.col("w") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("smallest", "least").alias("component_id")), "known")
    scratch.keep("rows", "known")
    out = hot_join(rows.select("rid", "id", "key"), known, "key", "rid", scratch, "hot-keys", "left")
    own = F.col("n_links").isNull()
    out = out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(own, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
