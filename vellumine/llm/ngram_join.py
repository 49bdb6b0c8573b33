"""Exact Jaccard join of word n-gram sets: a grouped prefix join.

Any fixed order of the n-grams lets two similar sets share one of their first
few; here common n-grams come last, so that these prefixes are rare. Documents
with equal sets are one class, and classes with the same size and prefix one
group, which goes into the index once. Pairs of groups that share prefix entries
are filtered by size and by how many they would have to share; what is left is
expanded to members and compared in full.

A very common prefix entry would pair all documents that have it. Such documents
are compared in blocks by counts of their n-grams' hash classes, which bound what
two sets can share; only pairs that this can't rule out are candidates. As the
result is components, each document is first compared with one candidate; only
pairs that are then still in different components are compared at all. First comparisons stream: a document is followed by those it
is compared with, in salted parts, and nothing is held but its own set. Later
ones, which may be dense, go to cells of two blocks of documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.blocks import cells, runs, whole_runs
from vellumine.llm.common import Scratch, arrow_type, bounded_side, byte_texts, hot_join, keyed_side, lower_ascii, partition_id, signed, small_batches, text_input
from vellumine.llm.components import connected_components
from vellumine.llm.shingles import shingle_sets

#: N-grams that go last in the order at most (their number only steers how much
#: work there is), and from which count on.
COMMON, COMMON_FROM = 1_000_000, 16
#: Level from which an n-gram's documents never meet in one task: 2 ** HOT_LEVEL.
HOT_LEVEL = 12
#: How much more of a document than its prefix is counted, as common n-grams that
#: leave a prefix make room for others.
AHEAD = 1.25
#: N-grams that a task counts at a time.
COUNTED = 2_000_000
#: Members of a bucket that are paired directly.
PAIRED = 32
#: Documents that follow one they are compared with in a part.
FOLLOWERS = 256
#: Documents of a block where pairs may be dense; a task holds two blocks' sets.
BLOCK = 512
#: Classes of n-grams by hash that are counted where all of a block's documents
#: may be similar, and n-grams of such a block (16 MB are two blocks).
COUNTERS, DENSE_BLOCK = 256, 1_000_000
#: A smaller cluster is dealt to so many blocks of so many n-grams, for tasks to share.
SPREAD, FINE = 4, 64_000
#: Working columns beside an input's own.
_FP, _KEEP = "__vellumine_fp", "__vellumine_keep"


def _sets(batch: pa.RecordBatch, column: str, n: int) -> list[np.ndarray]:
    return shingle_sets([lower_ascii(x) for x in byte_texts(batch.column(column))], n)


def _needed(size: np.ndarray, least: Fraction) -> np.ndarray:
    """How many n-grams of a set of ``size`` a similar set has at least."""
    return -(-size * least.numerator // least.denominator)


def _up(size: Column, share: Fraction) -> Column:
    """``size * share``, rounded up."""
    return F.floor((size * F.lit(share.numerator) + F.lit(share.denominator - 1)) / F.lit(share.denominator)).cast("long")


def _common(rows: DataFrame, n: int, least: Fraction, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, DataFrame]:
    """N-grams of many documents, ascending, their level (log2 of the count), and a table of very common ones.

    Every n-gram that can come first in some document is counted in all of those;
    of others, those that occur twice or more among some two million of a task.
    Kept are those of at least ``COMMON_FROM`` and of the highest levels that
    together are at most ``COMMON``. The join is exact with any such list.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, later, size = [], [], 0

        def give() -> Iterator[pa.RecordBatch]:
            for held, from_count in ((first, 1), (later, 2)):
                values, counts = np.unique(np.concatenate([*held, np.zeros(0, np.uint64)]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(values[counts >= from_count])), pa.array(counts[counts >= from_count])], ["token", "c"])

        for batch in batches:
            for x in _sets(batch, "text", n):
                if len(x):
                    cut = int((len(x) - int(_needed(np.int64(len(x)), least)) + 1) * AHEAD)
                    first.append(x[:cut])
                    later.append(x[cut:])
                    size += len(x)
                if size > COUNTED:
                    yield from give()
                    first, later, size = [], [], 0
        yield from give()

    counted = rows.select("text").mapInArrow(step, "token long, c long").groupBy("token").agg(F.sum("c").alias("c")).where(F.col("c") >= COMMON_FROM)
    table = scratch.write(counted.select("token", F.floor(F.log2("c")).cast("int").alias("level")), "common")
    hot = table.where(F.col("level") >= HOT_LEVEL).select("token")
    total, from_level = 0, None
    for r in sorted(table.groupBy("level").count().collect(), key=lambda r: -r.level):
        if total + r["count"] > COMMON:
            break
        total, from_level = total + r["count"], r.level
    if from_level is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), hot
    found = table.where(F.col("level") >= from_level).toArrow()
    tokens = found.column("token").to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found.column("level").to_numpy().astype(np.int64)[order], hot


def _prefixes(rows: DataFrame, n: int, least: Fraction, common) -> DataFrame:
    """(rid, id, n, fp, gkey, prefix) of each document."""
    id_kind = rows.schema["id"].dataType
    kind = arrow_type(id_kind)
    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("id", id_kind), T.StructField("n", T.LongType()), T.StructField("fp", T.BinaryType()), T.StructField("gkey", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, levels = common.value
        rid = partition_id() << 36
        for batch in batches:
            sets = _sets(batch, "text", n)
            sizes = np.array([len(x) for x in sets], np.int64)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            at = np.minimum(np.searchsorted(tokens, flat), max(len(tokens) - 1, 0))
            level = np.where(tokens[at] == flat, levels[at], 0) if len(tokens) else np.zeros(len(flat), np.int64)
            ends = np.cumsum(sizes)
            prefixes, fps, keys = [], [], []
            for x, start, end in zip(sets, (ends - sizes).tolist(), ends.tolist(), strict=True):
                if not len(x):
                    prefixes.append(x)
                    fps.append(None)
                    keys.append(None)
                    continue
                own = level[start:end]
                p = len(x) - int(_needed(np.int64(len(x)), least)) + 1
                prefix = x[np.lexsort((x, own))[:p]] if own.any() else x[:p]
                prefixes.append(prefix)
                fps.append(xxhash.xxh3_128_digest(x.tobytes()))
                keys.append(xxhash.xxh3_128_digest(prefix.tobytes(), seed=len(x)))
            offsets = np.cumsum([0, *map(len, prefixes)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate([*prefixes, np.zeros(0, np.uint64)]))))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rid, rid + len(sets))), batch.column("id").cast(kind), pa.array(sizes), pa.array(fps, pa.binary()), pa.array(keys, pa.binary()), lists], schema.names)
            rid += len(sets)

    return rows.mapInArrow(step, schema)


def _bucket_pairs(least: Fraction):
    """From rows sorted by token, hot ones last: pairs of small buckets (kind 0), rows of large and hot ones (kind 1)."""
    names = ["kind", "a", "b", "na", "nb"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        large: int | None = None  # the token whose bucket is being passed on

        def passed(token, gid, size) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), np.int32)), pa.array(token), pa.array(gid), pa.array(size), pa.nulls(len(token), pa.int64())], names)

        def paired(token, gid, size) -> Iterator[pa.RecordBatch]:
            starts, ends = runs(token)
            lengths = ends - starts
            for length in np.unique(lengths).tolist():
                own = starts[lengths == length]
                if length == 1:
                    continue
                if length > PAIRED:
                    at = (own[:, None] + np.arange(length)).ravel()
                    yield passed(token[at], gid[at], size[at])
                    continue
                i, j = np.triu_indices(length, 1)
                a, b = (own[:, None] + i).ravel(), (own[:, None] + j).ravel()
                low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
                ok = low * least.denominator >= high * least.numerator
                a, b = a[ok], b[ok]
                swap = gid[a] > gid[b]
                a, b = np.where(swap, b, a), np.where(swap, a, b)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int32)), pa.array(gid[a]), pa.array(gid[b]), pa.array(size[a]), pa.array(size[b])], names)

        for batch in batches:
            hot = batch.column("is_hot").to_numpy(zero_copy_only=False).astype(bool)
            if hot.any():
                yield passed(*(batch.column(c).to_numpy()[hot] for c in ("token", "gid", "n")))
            rows = [np.concatenate([x, batch.column(c).to_numpy()[~hot]]) for x, c in zip(held, ("token", "gid", "n"), strict=True)]
            if large is not None:
                cut = int(np.searchsorted(rows[0], large, side="right"))
                if cut:
                    yield passed(*(x[:cut] for x in rows))
                rows = [x[cut:] for x in rows]
            if not len(rows[0]):
                held = rows
                continue
            large = None
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            yield from paired(*(x[:cut] for x in rows))
            rows = [x[cut:] for x in rows]
            if len(rows[0]) > PAIRED:
                large = int(rows[0][0])
                yield passed(*rows)
                rows = [x[:0] for x in rows]
            held = rows
        yield from paired(*held)

    return step


def _least_shared(na: str, nb: str, least: Fraction) -> Column:
    """Prefix entries that two similar sets of these sizes share at least."""
    a, b = F.col(na), F.col(nb)
    overlap = _up(a + b, Fraction(least.numerator, least.numerator + least.denominator))
    return F.greatest(F.lit(1), overlap - F.greatest(_up(a, least), _up(b, least)) + 1)


def _similar(a: np.ndarray, b: np.ndarray, least: Fraction) -> bool:
    if len(a) < len(b):
        a, b = b, a
    if len(b) * least.denominator < len(a) * least.numerator:
        return False
    at = np.searchsorted(a, b)
    shared = int((a[np.minimum(at, len(a) - 1)] == b).sum())
    return shared * least.denominator >= (len(a) + len(b) - shared) * least.numerator


def _compared(least: Fraction):
    """From rows sorted by (x, salt, follows): pairs that are similar."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            left, right = [], []
            tokens = batch.column("tokens")
            for i, (leader, y, follows) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), batch.column("follows").to_pylist(), strict=True)):
                values = np.frombuffer(tokens[i].as_py(), np.uint64)
                if not follows:
                    x, own = leader, values
                    continue
                assert leader == x
                if _similar(own, values, least):
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return step


def _verified(pairs: DataFrame, sets: DataFrame, least: Fraction, scratch: Scratch, label: str) -> DataFrame:
    """Of ``pairs`` (x, y), those whose sets (cid, tokens) are similar, as (a, b)."""
    pairs = scratch.write(pairs.distinct(), f"{label}-pairs")
    count = pairs.count()
    many = pairs.groupBy("x").count().where(F.col("count") > FOLLOWERS).select("x", F.ceil(F.col("count") / FOLLOWERS).alias("parts"))
    parted = pairs.join(many, "x", "left").select("x", "y", F.pmod(F.xxhash64("y"), F.coalesce("parts", F.lit(1))).alias("salt"))
    # the sets are large and the pairs small: only rows that are compared move
    followers = sets.withColumnRenamed("cid", "y").join(bounded_side(parted, count), "y").select("x", "salt", "y", F.lit(True).alias("follows"), "tokens")
    leaders = sets.withColumnRenamed("cid", "x").join(bounded_side(parted.select("x", "salt").distinct(), count), "x").select("x", "salt", F.col("x").alias("y"), F.lit(False).alias("follows"), "tokens")
    dealt = followers.unionByName(leaders).repartition("x", "salt").sortWithinPartitions("x", "salt", "follows").select("x", "y", "follows", "tokens")
    return scratch.write(dealt.mapInArrow(_compared(least), "a long, b long"), f"{label}-links")


def _dense(least: Fraction):
    """From rows sorted by cell: links that connect what is similar in the cell.

    What two sets share is at most the sum of the smaller counts of each class of
    hashes; pairs that this rules out, and those already connected (by ``comp`` or
    in the cell), aren't compared.
    """

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_runs(batches, "cell"):
            block, other, cid, comp = (table.column(x).to_numpy() for x in ("own", "other", "cid", "comp"))
            raw, left, right = table.column("tokens"), [], []
            for start, end in zip(*runs(table.column("cell").to_numpy()), strict=True):
                root = np.unique(comp[start:end], return_inverse=True)[1].ravel()
                if not root.any():
                    continue
                sets = [np.frombuffer(x, np.uint64) for x in raw.slice(start, end - start).to_pylist()]
                n = np.array([len(x) for x in sets], np.int64)
                counts = np.stack([np.bincount((x % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS) for x in sets])
                counts = counts.astype(np.uint8 if counts.max() < 256 else np.uint32)
                own, cross = block[start:end], (block[start:end] != other[start:end]).any()
                for k in range(len(sets) - 1):
                    after = slice(k + 1, None)
                    ok = (root[after] != root[k]) & (np.minimum(n[after], n[k]) * least.denominator >= np.maximum(n[after], n[k]) * least.numerator)
                    if cross:
                        ok &= own[after] != own[k]
                    at = k + 1 + np.flatnonzero(ok)
                    if not len(at):
                        continue
                    most = np.minimum(counts[at], counts[k]).sum(axis=1, dtype=np.uint32).astype(np.int64)
                    for i in at[most * (least.numerator + least.denominator) >= (n[at] + n[k]) * least.numerator].tolist():
                        if root[i] != root[k] and _similar(sets[i], sets[k], least):
                            root[root == root[i]] = root[k]
                            left.append(cid[start + i])
                            right.append(cid[start + k])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return step


def _dense_links(edges: DataFrame, members: DataFrame, tokens: DataFrame, least: Fraction, scratch: Scratch, label: str) -> DataFrame:
    """Links (a, b) among members (gid, cid, n, comp) of groups that edges (a, b) connect.

    A group alone is an edge to itself. Connected groups are a cluster; clusters are
    dealt to cells of two blocks, and a cell gives no more links than it has members.
    """
    joined = connected_components(edges, scratch, label).select(F.col("id").alias("gid"), F.col("component").alias("cluster"))
    alone = edges.where("a = b").select(F.col("a").alias("gid")).distinct().join(joined, "gid", "left_anti").withColumn("cluster", F.col("gid"))
    clusters = scratch.write(joined.unionByName(alone), f"{label}-clusters")
    entries = scratch.write(hot_join(members, clusters, "gid", "cid", scratch, f"{label}-hot").select("cluster", "cid", "n", "comp"), f"{label}-members")
    placed = scratch.write(cells(entries, ["cluster"], "cid", DENSE_BLOCK, scratch, f"{label}-blocks", "n", SPREAD, FINE), f"{label}-cells")
    dealt = tokens.join(keyed_side(placed), "cid").repartition("cell").sortWithinPartitions("cell")
    return scratch.write(dealt.select("cell", "own", "other", "cid", "comp", "tokens").mapInArrow(_dense(least), "a long, b long"), f"{label}-links")


def _compared_in_cells(least: Fraction):
    """From rows sorted by (cell, is_pair): similar pairs, without those already connected in their cell."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, sets, root = None, {}, {}

        def top(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for batch in batches:
            left, right = [], []
            tokens = batch.column("tokens")
            for i, (at, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "x", "y")), strict=True)):
                if at != cell:
                    cell, sets, root = at, {}, {}
                if y is None:
                    sets[x], root[x] = np.frombuffer(tokens[i].as_py(), np.uint64), x
                    continue
                a, b = top(x), top(y)
                if a != b and _similar(sets[x], sets[y], least):
                    root[a] = b
                    left.append(x)
                    right.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return step


def _verified_in_cells(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, least: Fraction, scratch: Scratch, label: str) -> DataFrame:
    """As ``_verified``, for pairs that may be dense; ``sizes`` (cid, n) weigh them.

    Pairs fall into clusters, clusters into blocks of so many documents and
    n-grams, and two blocks make a cell. A set goes to the cells of its pairs, so it
    moves as often as its cluster has blocks, however many pairs it is in; a task
    holds two blocks.
    """
    pairs = scratch.write(pairs.distinct(), f"{label}-pairs")
    clusters = connected_components(pairs.select(F.col("x").alias("a"), F.col("y").alias("b")), scratch, f"{label}-clusters")
    clusters = scratch.write(clusters, f"{label}-clusters")
    weighed = sizes.withColumnRenamed("cid", "id").join(keyed_side(clusters), "id")
    blocks = scratch.write(weighed.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / DENSE_BLOCK)).alias("blocks")), f"{label}-sizes")
    dealt = scratch.write(hot_join(clusters, blocks, "component", "id", scratch, f"{label}-hot").select("id", "component", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block")), f"{label}-blocks")
    ends = pairs.join(dealt.select(F.col("id").alias("x"), "component", F.col("block").alias("bx")), "x").join(dealt.select(F.col("id").alias("y"), F.col("block").alias("by")), "y")
    celled = scratch.write(ends.select(F.xxhash64("component", F.least("bx", "by"), F.greatest("bx", "by")).alias("cell"), "x", "y"), f"{label}-cells")
    ends = celled.select("cell", "x").unionByName(celled.select("cell", F.col("y").alias("x"))).distinct()
    members = sets.withColumnRenamed("cid", "x").join(bounded_side(ends, 2 * celled.count()), "x")
    rows = members.select("cell", "x", F.lit(None).cast("long").alias("y"), "tokens").unionByName(celled.select("cell", "x", "y", F.lit(None).cast("binary").alias("tokens")))
    rows = rows.withColumn("is_pair", F.col("y").isNotNull()).repartition("cell").sortWithinPartitions("cell", "is_pair").select("cell", "x", "y", "tokens")
    return scratch.write(rows.mapInArrow(_compared_in_cells(least), "a long, b long"), f"{label}-links")


def _apart(rows: DataFrame, keys: list[str], least: Fraction) -> DataFrame:
    """Pairs (x, y, nx, ny) of rows (keys, cid, n, comp) of a key and different components.

    Most rows of a key are of one component; only the others are joined, so keys
    of one component cost nothing and the rest as many pairs as have to be seen.
    """
    sums = rows.groupBy(*keys, "comp").count()
    main = sums.groupBy(*keys).agg(F.max(F.struct("count", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select(*keys, F.col("top.comp").alias("main"))
    mixed = rows.join(main, keys)
    others = mixed.where("comp <> main").select(*keys, F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"))
    every = mixed.select(*keys, F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), "main")
    near = F.least("nx", "ny") * least.denominator >= F.greatest("nx", "ny") * least.numerator
    return others.join(every, keys).where((F.col("cx") != F.col("cy")) & ((F.col("cy") == F.col("main")) | (F.col("x") < F.col("y"))) & near).select(*keys, "x", "y", "nx", "ny")


def _joined(docs: DataFrame, n: int, least: Fraction, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, Scratch]:
    """All rows (rid, id, n, fp), classes (fp, cid, w, comp, smallest, least), and where both are written."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngrams")
    rows = text_input(docs, id_col, text_col)
    *known, hot = _common(rows, n, least, scratch)
    common = spark.sparkContext.broadcast(tuple(known))
    sets = scratch.write(_prefixes(rows, n, least, common), "prefixes")
    filled = sets.where("n > 0")
    classes = filled.groupBy("n", "fp", "gkey").agg(F.min("rid").alias("cid"), F.count(F.lit(1)).alias("w"), F.min("id").alias("least"))
    classes = scratch.write(classes, "classes")
    groups = scratch.write(classes.groupBy("gkey").agg(F.min("cid").alias("gid"), F.count(F.lit(1)).alias("members")), "groups")
    members = scratch.write(hot_join(classes, groups, "gkey", "cid", scratch, "hot-groups", counts=groups.select("gkey", F.col("members").alias("rows"))).select("cid", "gid", "members", "n", "fp", F.col("cid").alias("comp")), "members")

    index = sets.select(F.col("rid").alias("gid"), "n", "prefix").join(members.where("cid = gid").select("gid"), "gid").select("gid", "n", F.explode("prefix").alias("token"))
    # entries of very common n-grams make large buckets in any case: they are dealt out, not gathered
    marked = index.join(keyed_side(hot.withColumn("is_hot", F.lit(True))), "token", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False)))
    last = F.lit((1 << 63) - 1)  # hot entries come after the others
    placed = marked.select("token", "gid", "n", "is_hot", F.when(F.col("is_hot"), last).otherwise(F.col("token")).alias("at"), F.when(F.col("is_hot"), F.xxhash64("token", "gid")).otherwise(F.col("token")).alias("place"))
    dealt = placed.repartition("place").sortWithinPartitions("at")
    met = scratch.write(dealt.select("token", "gid", "n", "is_hot").mapInArrow(_bucket_pairs(least), "kind int, a long, b long, na long, nb long"), "met", "kind")
    large = met.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("gid"))
    in_large = scratch.write(large.groupBy("gid").agg(F.count(F.lit(1)).alias("large")), "in-large")
    shared = met.where("kind = 0").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("c"))
    for x in ("a", "b"):
        shared = shared.join(in_large.select(F.col("gid").alias(x), F.col("large").alias(f"large_{x}")), x, "left")
    shared = shared.where(F.col("c") + F.least(F.coalesce("large_a", F.lit(0)), F.coalesce("large_b", F.lit(0))) >= _least_shared("na", "nb", least)).select("a", "b")
    pairs = scratch.write(shared, "group-pairs")

    used = pairs.select(F.col("a").alias("gid")).unionByName(pairs.select(F.col("b").alias("gid"))).unionByName(in_large.select("gid")).unionByName(members.where("members > 1").select("gid")).distinct()
    needed = scratch.write(members.join(used, "gid", "left_semi").select("fp", "cid"), "needed")

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            fps, values = [], []
            for x in _sets(batch, "text", n):
                if len(x) and (fp := xxhash.xxh3_128_digest(x.tobytes())) not in seen:
                    seen.add(fp)
                    fps.append(fp)
                    values.append(x.tobytes())
            if len(seen) > 500_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array(values, pa.binary())], ["fp", "tokens"])

    tokens = rows.select("text").mapInArrow(told, "fp binary, tokens binary").join(keyed_side(needed), "fp").select("cid", "tokens").dropDuplicates(["cid"])
    tokens = scratch.write(tokens, "tokens")

    star = pairs.groupBy(F.col("b").alias("y")).agg(F.min("a").alias("x")).select("x", "y")
    inside = members.where("cid <> gid").select(F.col("gid").alias("x"), F.col("cid").alias("y"))
    firsts = scratch.write(large.groupBy("token").agg(F.min("gid").alias("b")), "large-firsts")
    edges = hot_join(large, firsts, "token", "gid", scratch, "hot-tokens").select(F.col("gid").alias("a"), "b").distinct()
    dense = _dense_links(scratch.write(edges, "dense-edges"), members, tokens, least, scratch, "dense")
    links = _verified(star.unionByName(inside), tokens, least, scratch, "first").unionByName(dense)
    found = connected_components(links, scratch, "first")
    placed = scratch.write(members.drop("comp").join(found.withColumnRenamed("id", "cid"), "cid", "left").select("cid", "gid", "members", "n", "fp", F.coalesce("component", "cid").alias("comp")), "placed")

    where = scratch.write(placed.groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count(F.lit(1)).alias("members")), "group-comps")
    ends = lambda x, y: where.select(F.col("gid").alias(x), F.col("lo").alias(f"lo{y}"), F.col("hi").alias(f"hi{y}"), F.col("members").alias(f"m{y}"))
    open_pairs = scratch.write(pairs.join(ends("a", 1), "a").join(ends("b", 2), "b").where("not (lo1 = hi1 and lo1 = lo2 and lo1 = hi2)").select("a", "b", (F.col("m1") * F.col("m2") > PAIRED * PAIRED).alias("many")), "open-pairs")
    few = open_pairs.where("not many")
    expanded = few.join(placed.select(F.col("gid").alias("a"), F.col("cid").alias("x"), F.col("comp").alias("cx")), "a").join(placed.select(F.col("gid").alias("b"), F.col("cid").alias("y"), F.col("comp").alias("cy")), "b").where("cx <> cy").select("x", "y")
    in_groups = _apart(placed.where(F.col("members").between(2, PAIRED)).select("gid", "cid", "n", "comp"), ["gid"], least).select("x", "y")
    rest = expanded.unionByName(in_groups).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    more = _verified_in_cells(rest, placed.select("cid", "n"), tokens, least, scratch, "second")
    # groups of many members are compared in cells, without a row for each pair
    big = open_pairs.where("many").select("a", "b").unionByName(where.where((F.col("members") > PAIRED) & (F.col("lo") != F.col("hi"))).select(F.col("gid").alias("a"), F.col("gid").alias("b")))
    big = scratch.write(big, "big-edges")
    if not big.isEmpty():
        more = more.unionByName(_dense_links(big, placed.select("gid", "cid", "n", "comp"), tokens, least, scratch, "big"))
    at = placed.select("cid", "comp")
    between = more.join(at.select(F.col("cid").alias("a"), F.col("comp").alias("ca")), "a").join(at.select(F.col("cid").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    last = scratch.write(connected_components(between, scratch, "second").select(F.col("id").alias("comp"), "component"), "last")
    final = hot_join(placed, last, "comp", "cid", scratch, "hot-last", "left").select("cid", "fp", F.coalesce("component", "comp").alias("comp")).join(classes.select("cid", "w", "least"), "cid")
    final = scratch.write(final, "components")
    ends = scratch.write(final.groupBy("comp").agg(F.min("least").alias("smallest"), F.min(F.struct(F.col("least").isNull(), "least", "cid")).alias("first"), F.count(F.lit(1)).alias("classes")), "ends")
    final = scratch.write(hot_join(final, ends, "comp", "cid", scratch, "hot-ends", counts=ends.select("comp", F.col("classes").alias("rows"))).where("classes > 1 or w > 1"), "final")
    scratch.keep("prefixes", "final")
    return sets.select("rid", "id", "n", "fp"), final, scratch


def jaccard_components(docs: DataFrame, n: int = 5, least: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``n_shingles``, ``component_id``.

    A null text, or one without words, has no n-grams and is linked with nothing;
    it is its own component. Rows with equal sets are linked, also if they repeat
    an id. A null id is never the smallest unless all of its component are null.
    An empty table gives an empty result; other columns are ignored.
    """
    rows, classes, scratch = _joined(docs, n, least, id_col, text_col)
    found = hot_join(rows, classes.select("fp", "smallest"), "fp", "rid", scratch, "hot-sets", "left", classes.select("fp", F.col("w").alias("rows")))
    alone = (F.col("n") == 0) | F.col("smallest").isNull()
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(alone, F.col("id")).otherwise(F.col("smallest")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, n: int = 5, least: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one left of each component: that with the smallest id.

    Texts without words all stay. Of rows that share the smallest id and the
    set, one stays.
    """
    rows, classes, scratch = _joined(docs, n, least, id_col, text_col)
    several = classes.select(F.col("fp").alias(_FP), F.struct((F.col("cid") == F.col("first.cid")).alias("stays"), F.col("first.least").alias("id")).alias(_KEEP))
    several = scratch.write(several, "several")
    stays = F.col(_KEEP).isNull() | (F.col(f"{_KEEP}.stays") & F.col(id_col).eqNullSafe(F.col(f"{_KEEP}.id")))
    staying = scratch.write(several.where(F.col(f"{_KEEP}.stays")).withColumnRenamed(_FP, "fp"), "staying")
    tied = hot_join(rows, staying, "fp", "rid", scratch, "hot-staying", counts=classes.select("fp", F.col("w").alias("rows"))).where(F.col("id").eqNullSafe(F.col(f"{_KEEP}.id"))).groupBy("fp").count().where("count > 1")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in _sets(batch, text_col, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.binary())], [*batch.schema.names, _FP])

    marked = docs.mapInArrow(step, T.StructType([*docs.schema.fields, T.StructField(_FP, T.BinaryType())]))
    copies = classes.select(F.col("fp").alias(_FP), F.col("w").alias("rows"))
    held = hot_join(marked, several, _FP, id_col, scratch, "hot-several", "left", copies).where(stays)
    if not tied.isEmpty():
        held = held.where(F.col(_KEEP).isNull()).unionByName(held.where(F.col(_KEEP).isNotNull()).dropDuplicates([_FP]))
    return held.select(*docs.columns)
