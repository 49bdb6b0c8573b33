"""Token ids in directly addressable codes.

An id is split into chunks of eight bits. Level 0 holds the lowest chunk of every
id, level 1 the next chunk of those ids that have more, and so on. A bitmap
beside each level says which entries go on, and a rank directory counts its
ones up to every 512th entry, so the place of any id in the next level, and with
it the id, is found without decoding others.

A file is a Parquet table of segments in document order; each holds the codes
of about a million ids in one binary value, and where its documents begin.
Spark's own writer commits it, so a lost executor leaves no half of a segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.llm.common import Scratch, arrow_type, partition_id, small_batches, text_input
from vellumine.llm.vocabulary import ByteEncoder, encoder

SEGMENT_IDS = 1 << 20
RANK_STEP = 512
_MAGIC = b"DAC1"
_HEAD = struct.Struct("<4sB")
_LEVEL = struct.Struct("<I?")


def dac_encode(ids: np.ndarray) -> bytes:
    """The codes of unsigned 32-bit ids."""
    rest, out, levels = np.ascontiguousarray(ids, "<u4"), [], 0
    while True:
        chunk, more = rest.view(np.uint8)[::4].copy(), rest > 255
        rest = rest[more] >> np.uint32(8)
        levels += 1
        out += [_LEVEL.pack(len(chunk), not len(rest)), chunk.data]
        if not len(rest):
            return b"".join([_HEAD.pack(_MAGIC, levels), *out])
        sums = np.add.reduceat(more, np.arange(0, len(more), RANK_STEP), dtype=np.uint32)
        out += [np.packbits(more).data, (np.cumsum(sums, dtype=np.uint32) - sums).astype("<u4").tobytes()]


class DacReader:
    """Access to ids in ``dac_encode``'s bytes."""

    def __init__(self, payload: bytes) -> None:
        magic, levels = _HEAD.unpack_from(payload)
        if magic != _MAGIC:
            raise ValueError("not a token segment")
        at, self.levels = _HEAD.size, []
        for _ in range(levels):
            n, last = _LEVEL.unpack_from(payload, at)
            at += _LEVEL.size
            chunk, at = np.frombuffer(payload, np.uint8, n, at), at + n
            bits = ranks = None
            if not last:
                bits, at = np.frombuffer(payload, np.uint8, (n + 7) // 8, at), at + (n + 7) // 8
                size = -(-n // RANK_STEP)
                ranks, at = np.frombuffer(payload, "<u4", size, at), at + 4 * size
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        found = 0
        for level, (chunk, bits, ranks) in enumerate(self.levels):
            found |= int(chunk[i]) << (8 * level)
            if bits is None or not bits[i >> 3] >> (7 - (i & 7)) & 1:
                break
            block = i // RANK_STEP
            before = np.unpackbits(bits[block * RANK_STEP // 8 : i // 8 + 1])[: i - block * RANK_STEP]
            i = int(ranks[block]) + int(before.sum())
        return found

    def all(self) -> np.ndarray:
        out = None
        for chunk, bits, _ in reversed(self.levels):
            values = chunk.astype(np.uint32)
            if bits is not None:
                values[np.unpackbits(bits, count=len(chunk)).astype(bool)] |= out << np.uint32(8)
            out = values
        return out


def write_token_store(docs: DataFrame, vocabulary: str, end_id: int, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", label: str = "tokens") -> DataFrame:
    """Encode every whole text, add ``end_id``, and write segments by ascending id.

    Rows are dealt by ranges of (id, hash of the text's size and head), so even an
    id that very many rows share spreads. Returns the written table.
    """
    small_batches(docs.sparkSession)
    rows = text_input(docs, id_col, text_col).withColumn("tie", F.xxhash64(F.octet_length("text"), F.substring("text", 1, 64)))
    dealt = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    kind = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("base", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("payload", T.BinaryType())])
    arrow_kind, end = arrow_type(kind), np.array([end_id], "<u4").tobytes()

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, base = encoder(ByteEncoder, vocabulary), partition_id(), 0
        ids, lengths, held, size = [], [], [], 0

        def segment() -> pa.RecordBatch:
            values = np.frombuffer(b"".join(held), "<u4")
            columns = [[part], [base], [len(values)], [ids], [lengths], [dac_encode(values)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(arrow_kind), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, y) for x, y in zip(columns, kinds, strict=True)], schema.names)

        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for at, found in zip(batch.column("id").to_pylist(), encode.ids(texts), strict=True):
                if held and size + len(found) // 4 >= SEGMENT_IDS:
                    yield segment()
                    base += size
                    ids, lengths, held, size = [], [], [], 0
                ids.append(at)
                lengths.append(len(found) // 4 + 1)
                held += (found, end)
                size += lengths[-1]
        if held:
            yield segment()

    return scratch.write(dealt.mapInArrow(step, schema), label)


def read_token_store(spark: SparkSession, store: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per document of a written store: id, ``start``, ``n_tokens``, ``ids_crc32``.

    Where each partition of the writer begins follows from one sum per
    partition; nothing per document or segment goes to the driver.
    """
    sums = sorted((r.part, r.n) for r in store.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    starts, total = {}, 0
    for part, n in sums:
        starts[part], total = total, total + n
    kind = store.schema["ids"].dataType.elementType
    arrow_kind = arrow_type(kind)
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                values = DacReader(batch.column("payload")[i].as_py()).all().astype("<u4", copy=False)
                lengths = np.array(batch.column("lengths")[i].as_py(), np.int64)
                ends = np.cumsum(lengths)
                sums32 = [zlib.crc32(values[b - n : b]) for b, n in zip(ends, lengths, strict=True)]
                first = starts[batch.column("part")[i].as_py()] + batch.column("base")[i].as_py()
                yield pa.RecordBatch.from_arrays([batch.column("ids")[i].values.cast(arrow_kind), pa.array(first + ends - lengths), pa.array(lengths), pa.array(sums32, pa.int64())], schema.names)

    return store.select("part", "base", "ids", "lengths", "payload").mapInArrow(step, schema)


def token_store(docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids and return what the written files say of them.

    A null text counts as empty and holds the end id only. Rows with a null id
    come first; rows that share an id stand side by side, in the order of a
    hash. Columns other than id and text are ignored. An empty table
    gives an empty store.
    """
    spark = docs.sparkSession
    return read_token_store(spark, write_token_store(docs, vocabulary, end_id, Scratch(spark, "tokens"), id_col, text_col), id_col)
