"""Helpers that the operators of this subpackage share.

Intermediate tables go to the folder that the session names in
``spark.checkpoint.dir`` (shared by driver and executors), so a lost executor
costs a reread, never a wrong or missing row.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumine.functions.batches import small_batches  # noqa: F401  operators take it from here

#: Rows of one long key that a join side may have to be broadcast: about 100 MB
#: in an executor. Beyond it the same join is dealt out by key.
BROADCAST_ROWS = 1_000_000
#: Rows of one key that a task of a join may get; a hotter key is dealt out. Rows of
#: a side up to which such a join broadcasts it instead: a few MB.
HOT_ROWS, HOT_SIDE = 100_000, 50_000

_ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; a temporary one only where none is set."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="vellumine-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Tables of one operator run, written as Parquet below the shared folder.

    ``keep`` deletes what a result no longer reads; what it reads lives until
    ``temporary`` ends or its folder is deleted.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{shared_dir(spark)}/vellumine/{name}-{uuid.uuid4().hex}"
        self.labels: set[str] = set()
        for opened in _OPENED:
            opened.append(self)

    def write(self, df: DataFrame, label: str, *partition_by: str) -> DataFrame:
        path = f"{self.root}/{label}"
        writer = df.write.mode("overwrite")
        self.labels.add(label)
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
        return self.read(label, df.schema)

    def read(self, label: str, schema: T.StructType) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{label}")

    def drop(self, label: str = "") -> None:
        """Delete a table that no later plan reads, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{label}" if label else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.labels -= {label} if label else self.labels

    def keep(self, *labels: str) -> None:
        """Delete all tables but these."""
        for label in sorted(self.labels - set(labels)):
            self.drop(label)


_OPENED: list[list[Scratch]] = []


@contextmanager
def temporary() -> Iterator[None]:
    """Delete, at the end, all tables that operators wrote meanwhile and still have."""
    opened: list[Scratch] = []
    _OPENED.append(opened)
    try:
        yield
    finally:
        _OPENED.remove(opened)
        for x in opened:
            x.drop()


def keyed_side(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``BROADCAST_ROWS`` rows, else as it is.

    ``df`` should be a written table: it is counted.
    """
    return bounded_side(df, df.count())


def bounded_side(df: DataFrame, rows: int) -> DataFrame:
    """As ``keyed_side``, where ``df`` is known to have at most ``rows`` rows."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def hot_join(rows: DataFrame, side: DataFrame, key: str, member: str, scratch: Scratch, label: str, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``side``, a written table of one row a ``key``.

    A side beyond ``HOT_SIDE`` rows is joined by key. Keys of more than
    ``HOT_ROWS`` rows are dealt out by ``member`` to as many parts as they need,
    so that no task gets all rows of one. ``counts`` (key, rows) saves counting.
    """
    if side.count() <= min(HOT_SIDE, BROADCAST_ROWS):
        return rows.join(F.broadcast(side), key, how)
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows")) if counts is None else counts
    counted = counted.withColumnRenamed("rows", "__parts").where(F.col("__parts") > HOT_ROWS)
    hot = keyed_side(scratch.write(counted.select(key, F.ceil(F.col("__parts") / HOT_ROWS).cast("int").alias("__parts")), label))
    # a null key meets nothing, so its rows may go anywhere
    parts = F.when(F.col(key).isNull(), F.lit(1 << 16)).otherwise(F.coalesce("__parts", F.lit(1)))
    dealt = rows.join(hot, key, "left").withColumn("__part", F.pmod(F.xxhash64(member), parts).cast("int")).drop("__parts")
    copied = side.where(F.col(key).isNotNull()).join(hot, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts.cast("int") - 1))).drop("__parts")
    return dealt.join(copied, [key, "__part"], how).drop("__part")


def crc_of_id(doc_id: str | Column) -> Column:
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"))


def text_input(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """Only the columns an operator reads, under fixed names ``id`` and ``text``.

    Other columns of the input, whatever their names, play no part.
    """
    return docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), *more)


def byte_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def lower_ascii(text: bytes) -> bytes:
    """A-Z to a-z and nothing else."""
    return text.translate(_ASCII_LOWER)


def arrow_schema(fields: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema(fields)


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def map_arrow(df: DataFrame, step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    return df.mapInArrow(step, schema)


def partition_id() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context is not None else 0


def signed(values: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return values.astype(np.uint64, copy=False).view(np.int64)
