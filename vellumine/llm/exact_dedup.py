"""Exact duplicates by Golomb-coded fingerprint exchange.

1. Each input partition hashes its normalised texts to 64 bits, sorts the
   distinct hashes and sends them to the owners of the hash ranges as
   Golomb-Rice coded gaps, with a bit for those it holds several times.
   Where a partition's hashes would make too short a list for each owner, it
   sends fewer lists for wider ranges to routers, which merge those of many
   partitions and send longer lists on.
2. An owner decodes the lists of its range and answers every list with a
   bitmap of the hashes that occur more than once anywhere.
3. A list and its bitmap give the suspect hashes. Only suspects' texts are
   shuffled, grouped by all their bytes (counted per task first, so that copies
   of one text meet as one row per task), which settles equality.
4. Rows then learn their group's size and keeper by (hash, SHA-256).

The exchange moves a few bytes a document; a text that occurs once never
leaves its task.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import Scratch, arrow_type, byte_texts, hot_join, keyed_side, lower_ascii, partition_id, signed, small_batches, text_input

#: Hashes that an owner receives on average at most.
OWNER_HASHES = 1 << 17
LEAST_OWNER_BITS = 8
#: Hashes that a list holds on average at least, or else lists are merged on the way.
LIST_HASHES = 16

_HEAD = struct.Struct("<IBI")
#: Working columns beside an input's own.
_SHA, _TOP, _IN = "__vellumine_sha", "__vellumine_top", "__vellumine_in"


def golomb_encode(values: np.ndarray, width: int, repeated: np.ndarray) -> bytes:
    """Sorted distinct numbers below ``2**width`` and a flag for each, as bytes.

    Gaps are split at ``k`` bits: quotients in unary, then all remainders, then
    the flags. ``k`` follows from the mean gap, so quotients take at most three
    bits a value on average.
    """
    n = len(values)
    if not n:
        return _HEAD.pack(0, 0, 0)
    k = max(0, width - int(n).bit_length())
    gaps = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    ends = np.cumsum(quotients + 1) - 1
    unary = np.ones(int(ends[-1]) + 1, np.uint8)
    unary[ends] = 0
    rest = bytes()
    if k:
        shifts = np.arange(k - 1, -1, -1, dtype=np.uint64)
        rest = np.packbits(((gaps[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)).tobytes()
    packed = np.packbits(unary).tobytes()
    return _HEAD.pack(n, k, len(packed)) + packed + rest + np.packbits(repeated.astype(np.uint8)).tobytes()


def golomb_decode(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The values and flags that ``golomb_encode`` was given."""
    n, k, size = _HEAD.unpack_from(payload)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    at = _HEAD.size
    unary = np.unpackbits(np.frombuffer(payload, np.uint8, size, at))
    ends = np.flatnonzero(unary == 0)[:n]
    gaps = (np.diff(ends, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    at += size
    size = (n * k + 7) // 8
    if k:
        bits = np.unpackbits(np.frombuffer(payload, np.uint8, size, at), count=n * k).reshape(n, k)
        for column in range(k):
            gaps |= bits[:, column].astype(np.uint64) << np.uint64(k - 1 - column)
    flags = np.unpackbits(np.frombuffer(payload, np.uint8, offset=at + size), count=n).astype(bool)
    return np.cumsum(gaps, dtype=np.uint64), flags


def _messages(found: list[np.ndarray], bits: int) -> Iterator[tuple[int, bytes]]:
    """For each owner with hashes: its number and the coded list."""
    values, counts = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
    owners = (values >> np.uint64(64 - bits)).astype(np.int64)
    for part in np.split(np.arange(len(values)), np.flatnonzero(np.diff(owners)) + 1):
        if len(part):
            owner = int(owners[part[0]])
            yield owner, golomb_encode(values[part] - np.uint64(owner << (64 - bits)), 64 - bits, counts[part] > 1)


def _hashes(batch: pa.RecordBatch) -> tuple[list[bytes], np.ndarray]:
    texts = [lower_ascii(x) for x in byte_texts(batch.column("text"))]
    return texts, np.fromiter(map(xxhash.xxh3_64_intdigest, texts), np.uint64, len(texts))


def _fingerprints(rows: DataFrame, bits: int) -> DataFrame:
    """A row per document and a row per message (kind 0 and 1)."""
    kind = arrow_type(rows.schema["id"].dataType)
    names = ["kind", "rid", "id", "fp", "sha", "owner", "payload"]
    kinds = [pa.int32(), pa.int64(), kind, pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("rid", T.LongType()), T.StructField("id", rows.schema["id"].dataType), T.StructField("fp", T.LongType()), T.StructField("sha", T.BinaryType()), T.StructField("owner", T.LongType()), T.StructField("payload", T.BinaryType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = partition_id() << 36
        seen: list[np.ndarray] = []
        first = at
        for batch in batches:
            texts, fps = _hashes(batch)
            n = len(texts)
            seen.append(fps)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(n, np.int32)), pa.array(np.arange(at, at + n)), batch.column("id").cast(kind), pa.array(signed(fps)), pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                names,
            )
            at += n
        sent = list(_messages(seen, bits))
        n = len(sent)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(n, np.int32)), pa.array(np.full(n, first)), pa.nulls(n, kind), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([x for x, _ in sent], pa.int64()), pa.array([x for _, x in sent], pa.binary())],
            names,
        )

    return rows.mapInArrow(step, schema)


def _routed(wide: int, bits: int):
    """Lists of ``2 ** wide`` ranges, of some partitions each, as one list for each owner in the range."""

    def merge(table: pa.Table) -> pa.Table:
        router = table.column("owner")[0].as_py()
        low, shift = np.uint64(router << (64 - wide)), 64 - wide
        lists = [golomb_decode(x) for x in table.column("payload").to_pylist()]
        values = np.concatenate([x for x, _ in lists])
        distinct, back, counts = np.unique(values, return_inverse=True, return_counts=True)
        repeated = counts > 1
        repeated[back[np.concatenate([x for _, x in lists])]] = True
        owners = ((distinct | low if shift < 64 else distinct) >> np.uint64(64 - bits)).astype(np.int64)
        out = []
        for part in np.split(np.arange(len(distinct)), np.flatnonzero(np.diff(owners)) + 1):
            owner = int(owners[part[0]])
            own = (distinct[part] | low if shift < 64 else distinct[part]) - np.uint64(owner << (64 - bits))
            out.append((owner, golomb_encode(own, 64 - bits, repeated[part])))
        rid = min(table.column("rid").to_pylist())
        return pa.table({"rid": pa.array([rid] * len(out), pa.int64()), "owner": pa.array([x for x, _ in out], pa.int64()), "payload": pa.array([x for _, x in out], pa.binary())})

    return merge


def _answer(table: pa.Table) -> pa.Table:
    """An owner's bitmaps: which hashes of each list occur more than once."""
    lists = [golomb_decode(x) for x in table.column("payload").to_pylist()]
    every = np.concatenate([x for x, _ in lists])
    _, back, counts = np.unique(every, return_inverse=True, return_counts=True)
    hit = (counts > 1)[back] | np.concatenate([x for _, x in lists])
    maps = [np.packbits(x.astype(np.uint8)).tobytes() for x in np.split(hit, np.cumsum([len(x) for x, _ in lists])[:-1])]
    return pa.table({"owner": table.column("owner"), "rid": table.column("rid"), "bitmap": pa.array(maps, pa.binary())})


def _suspects(bits: int):
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for owner, payload, bitmap in zip(*(batch.column(x).to_pylist() for x in ("owner", "payload", "bitmap")), strict=True):
                values, _ = golomb_decode(payload)
                hit = np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(values)).astype(bool)
                if hit.any():
                    yield pa.RecordBatch.from_arrays([pa.array(signed(values[hit] + np.uint64(owner << (64 - bits))))], ["fp"])

    return step


def _normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, fps = _hashes(batch)
        yield pa.RecordBatch.from_arrays([pa.array(signed(fps)), pa.array(texts, pa.binary())], ["fp", "norm"])


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, Scratch]:
    """All rows (rid, id, fp, sha), the confirmed groups (fp, sha, n, top), and where both are written."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "exact")
    rows = text_input(docs, id_col, text_col)
    count, parts = rows.count(), max(1, rows.rdd.getNumPartitions())
    owners = max(1, count // OWNER_HASHES)
    bits = min(24, max(LEAST_OWNER_BITS, owners.bit_length()))
    wide = min(bits, max(0, (count // (parts * LIST_HASHES)).bit_length() - 1))
    table = scratch.write(_fingerprints(rows, wide), "fingerprints", "kind")
    seen, sent = table.where("kind = 0").select("rid", "id", "fp", "sha"), table.where("kind = 1").select("rid", "owner", "payload")
    if wide < bits:
        # a router takes lists of so many partitions that what it sends on is long enough
        routers = -(-parts // (1 << (bits - wide)))
        routed = sent.withColumn("turn", F.pmod(F.shiftright("rid", 36), F.lit(routers))).groupBy("owner", "turn").applyInArrow(_routed(wide, bits), "rid long, owner long, payload binary")
        sent = scratch.write(routed, "routed")
    bitmaps = sent.groupBy("owner").applyInArrow(_answer, "owner long, rid long, bitmap binary")
    suspects = scratch.write(sent.join(bitmaps, ["owner", "rid"]).select("owner", "payload", "bitmap").mapInArrow(_suspects(bits), "fp long").distinct(), "suspects")
    suspects = keyed_side(suspects)
    equal = rows.select("text").mapInArrow(_normalised, "fp long, norm binary").join(suspects, "fp", "left_semi").groupBy("fp", "norm").agg(F.count(F.lit(1)).alias("n"))
    equal = equal.select("fp", F.unhex(F.sha2("norm", 256)).alias("sha"), "n").where("n > 1")
    claimed = seen.join(suspects, "fp", "left_semi").groupBy("fp", "sha").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("id", "rid")).alias("top"))
    groups = scratch.write(claimed.join(equal, ["fp", "sha", "n"]), "groups")
    scratch.keep("fingerprints", "groups")
    return seen, groups, scratch


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row with the group of texts equal to its own after lower-casing A-Z.

    Returns one row per input row: the id under its own name, ``keep_id`` (the
    largest id of the group), ``group_size``, ``kept`` and ``text_sha256``.

    A null text counts as empty, so null and empty texts form one group. A null
    id sorts below all others. Of rows that repeat the largest id with an equal
    text, one stays. An empty table gives an empty result; other columns, even
    ones named like those of the result, are ignored.
    """
    seen, groups, scratch = _groups(docs, id_col, text_col)
    found = hot_join(seen, groups.select("sha", "n", "top"), "sha", "rid", scratch, "hot", "left", groups.select("sha", F.col("n").alias("rows")))
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("top.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("rid") == F.col("top.rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_duplicates`` keeps, with their columns.

    Groups are joined back by SHA-256, broadcast only if they are few enough.
    Rows that repeat id and text are told apart last, among themselves.
    """
    seen, groups, scratch = _groups(docs, id_col, text_col)
    keep = scratch.write(groups.select(F.col("sha").alias(_SHA), F.col("top.id").alias(_TOP), F.lit(True).alias(_IN)), "keep")
    sizes = groups.select("sha", F.col("n").alias("rows"))
    tied = hot_join(seen, groups.select("sha", "top"), "sha", "rid", scratch, "hot", "inner", sizes).where(F.col("id").eqNullSafe(F.col("top.id"))).groupBy("sha").count().where("count > 1")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = [hashlib.sha256(lower_ascii(x)).digest() for x in byte_texts(batch.column(text_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, _SHA])

    marked = docs.mapInArrow(step, T.StructType([*docs.schema.fields, T.StructField(_SHA, T.BinaryType())]))
    held = hot_join(marked, keep, _SHA, id_col, scratch, "hot-kept", "left", sizes.withColumnRenamed("sha", _SHA)).where(F.col(_IN).isNull() | F.col(id_col).eqNullSafe(F.col(_TOP)))
    if not tied.isEmpty():
        held = held.where(F.col(_IN).isNull()).unionByName(held.where(F.col(_IN)).dropDuplicates([_SHA]))
    return held.select(*docs.columns)
