"""Keeping an index up to date from a stream of raw documents.

An extension: a micro-batch of (path, raw, ts) rows is parsed and appended to the
index, which classifies the batch's paths only, so neither documents nor chunks of
other files are read or written. When a path was last seen is kept in a table that
each batch appends to; older rows that come late are left out. Batches are
numbered, and one that is replayed finds its own work done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellumine.operators.index import Index
from vellumine.plans.config import Config
from vellumine.plans.inference import kept
from vellumine.sources.files import Files
from vellumine.sources.frontmatter import documents


def latest(rows: DataFrame) -> DataFrame:
    """One row per path: the last by ``ts``, or any of equals by its text."""
    window = Window.partitionBy("path").orderBy(F.col("ts").desc(), F.col("raw").desc())
    return rows.withColumn("place", F.row_number().over(window)).where("place = 1").drop("place")


def upsert(batch: DataFrame, number: int, store: str, index: Index, config: Config) -> None:
    """Bring the index up to date with (path, raw, ts); a null text deletes."""
    spark = batch.sparkSession
    files = Files(spark, store)
    seen = [f"{store}/seen/{x}" for x in files.names("seen") if x.isdigit() and int(x) != number and files.exists(f"seen/{x}/_SUCCESS")]
    rows = batch.select("path", "raw", "ts")
    if seen:
        before = spark.read.schema("path string, ts long").parquet(*seen).groupBy("path").agg(F.max("ts").alias("last"))
        rows = rows.join(before, "path", "left").where(F.col("last").isNull() | (F.col("ts") > F.col("last"))).drop("last")
    with kept(latest(rows)) as (fresh,):
        docs = documents(fresh.where("raw is not null").select("path", "raw"))
        index.build(docs, config, removed=fresh.where("raw is null").select("path"))
        fresh.select("path", F.col("ts").cast("long").alias("ts")).write.mode("overwrite").parquet(f"{store}/seen/{number}")


def keep_up(stream: DataFrame, store: str, index: Index, config: Config, checkpoint: str, **trigger) -> StreamingQuery:
    """Start a query over a stream of (path, raw, ts)."""
    return stream.writeStream.foreachBatch(lambda batch, number: upsert(batch, number, store, index, config)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
