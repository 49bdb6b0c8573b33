"""The chunk table: one row per chunk, its file's metadata beside it.

A build appends a segment: chunks of new and edited files, copies of chunks whose
file's metadata changed (without embedding them again), and which files' earlier
chunks are dead. Nothing else is rewritten, until segments are many or half of
their chunks dead; then a build compacts what is left into one. A snapshot is a
numbered file that lists segments; it appears in one rename and is never changed,
so readers see the table before a build or after it, and a build that dies leaves
nothing but a segment that no snapshot names. The last snapshots are kept for
queries that run on.

Full-text postings lie beside the chunks, dealt to buckets by term, so a query
reads the buckets of its words; vectors lie in lists by nearest centroid.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellumine.functions.batches import small_batches
from vellumine.functions.text import text_terms
from vellumine.operators.ann import LEAST_VECTORS, centroids_of, fit_centroids, nearest_lists, read_lists, write_lists
from vellumine.operators.chunking import DEFAULT_CHARS, chunks, plain_text
from vellumine.operators.embedding import load_embedder
from vellumine.plans.config import Config, EmbeddingModel
from vellumine.sources.files import Files
from vellumine.types import storage_struct, stored_row

LOG = "log"
#: Snapshots that are kept, segments that a table has at most, and rows of a side
#: that a join may broadcast.
KEPT_SNAPSHOTS, MOST_SEGMENTS, BROADCAST_ROWS = 2, 12, 1_000_000
#: Chunks for each bucket of postings, and buckets at most; beyond, a bucket is
#: dealt to parts of so many chunks.
BUCKET_CHUNKS, MOST_BUCKETS, PART_CHUNKS = 4000, 2048, 2_000_000
_NAMESPACE = uuid.UUID("6f1c2a54-3a63-5d0c-9e42-9f5a1c0f7b11")
PUBLIC = ["chunk_id", "file_id", "chunk_index", "start_line", "end_line", "chunk_text", "embedding", "filepath", "content_hash", "data", "built_at"]
_FILE = "filepath string, file_id string, content_hash string, meta_hash string"
_POSTING = "bucket int, part int, term string, id binary, tf int, length int"


class IndexError_(RuntimeError):
    """An index that is missing or doesn't fit the configuration."""


@dataclass
class BuildResult:
    snapshot: str | None
    new: int
    edited: int
    unchanged: int
    removed: int
    chunks_embedded: int
    chunks_total: int
    full: bool


def schema_hash(fields: dict[str, str]) -> str:
    return xxhash.xxh3_64_hexdigest(json.dumps(dict(sorted(fields.items())), separators=(",", ":")).encode())


def index_fields(config: Config) -> dict[str, str]:
    return {x.name: x.type for x in config.fields}


def bucket_of(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) % buckets


def _bounded(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class Index:
    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    # reading
    def _versions(self) -> list[int]:
        return [int(x.removesuffix(".json")) for x in self.files.names(LOG) if re.fullmatch(r"\d+\.json", x)]

    def exists(self) -> bool:
        return bool(self._versions())

    def metadata(self) -> dict:
        """What the newest snapshot says: settings, counts, and segments."""
        versions = self._versions()
        if not versions:
            raise IndexError_("no index: build it first")
        return json.loads(self.files.read(f"{LOG}/{max(versions):010d}.json"))

    def _paths(self, meta: dict, name: str, has: str | None = None) -> list[str]:
        return [f"{self.root}/{x['name']}/{name}" for x in meta["segments"] if has is None or x[has]]

    def _table(self, meta: dict, name: str, schema: T.StructType | str, has: str | None = None) -> DataFrame:
        paths = self._paths(meta, name, has)
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _live(self, meta: dict, name: str, schema: T.StructType | str) -> DataFrame:
        """Rows of all segments whose file no later segment has replaced."""
        rows = self._table(meta, name, schema)
        dead = sum(x["dead_files"] for x in meta["segments"])
        if not dead:
            return rows
        gone = self._table(meta, "dead", "file_id string, before int", "dead_files").groupBy("file_id").agg(F.max("before").alias("before")).withColumnRenamed("file_id", "gone")
        return rows.join(_bounded(gone, dead), (F.col("file_id") == F.col("gone")) & (F.col("seg") < F.col("before")), "left_anti")

    def _chunks(self, meta: dict) -> DataFrame:
        return self._live(meta, "chunks", _chunk_schema(meta["fields"]))

    def rows(self, meta: dict | None = None) -> DataFrame:
        return self._chunks(meta or self.metadata()).select(*PUBLIC)

    def scored_rows(self, meta: dict) -> DataFrame:
        """The rows with ``norm``, their vectors' lengths."""
        return self._chunks(meta).select(*PUBLIC, "norm")

    def postings(self, words: list[str] | None = None, meta: dict | None = None) -> DataFrame:
        """(term, chunk_id, tf, length) of live chunks: all, or those of some words, whose buckets alone are read."""
        meta = meta or self.metadata()
        found = None
        for x in meta["segments"]:
            if not x["buckets"]:
                continue
            own = self.spark.read.schema(_POSTING).option("basePath", f"{self.root}/{x['name']}/postings").parquet(f"{self.root}/{x['name']}/postings")
            if words is not None:
                own = own.where(F.col("bucket").isin(sorted({bucket_of(w, x["buckets"]) for w in words})) & F.col("term").isin(words))
            own = own.select("term", "id", "tf", "length", F.lit(x["number"]).alias("seg"))
            found = own if found is None else found.unionByName(own)
        if found is None:
            return self.spark.createDataFrame([], "term string, chunk_id string, tf int, length int")
        dead = sum(x["dead_chunks"] for x in meta["segments"])
        if dead:
            gone = self._table(meta, "dead-chunks", "id binary, length int, before int", "dead_chunks").groupBy(F.col("id").alias("gone")).agg(F.max("before").alias("before"))
            found = found.join(_bounded(gone, dead), (F.col("id") == F.col("gone")) & (F.col("seg") < F.col("before")), "left_anti")
        return found.select("term", _chunk_id("id").alias("chunk_id"), "tf", "length")

    def probed(self, query: list[float], probes: int, meta: dict | None = None) -> DataFrame | None:
        """(chunk_id) of the vector lists nearest to a query; None if there are no lists."""
        meta = meta or self.metadata()
        if not meta.get("centroids"):
            return None
        near = nearest_lists(self.spark.read.parquet(f"{self.root}/{meta['centroids']}/centroids"), query, probes)
        found = [read_lists(self.spark, x, near).select("chunk_id") for x in self._paths(meta, "lists", "lists")]
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out.distinct()

    def file_index(self, meta: dict | None = None) -> DataFrame:
        """One row per file: filepath, file_id, content_hash, meta_hash."""
        return self._live(meta or self.metadata(), "files", f"{_FILE}, seg int").drop("seg")

    def stats(self) -> dict[str, int]:
        return chunk_stats(self.rows())

    def embedding_dimension(self) -> int | None:
        return self.metadata().get("dimension") if self.exists() else None

    def clean(self) -> dict[str, int]:
        """Delete the index; refuse if it is a link."""
        if not self.files.exists():
            return {"files": 0, "bytes": 0}
        if self.files.is_link():
            raise IndexError_(f"{self.root} is a symbolic link")
        count, size = self.files.size()
        self.files.remove()
        return {"files": count, "bytes": size}

    # building
    def drift(self, config: Config) -> list[str]:
        """Settings that differ from those the index was built with."""
        if not self.exists():
            return []
        built, model = self.metadata(), config.embedding_model or EmbeddingModel()
        now = {"provider": model.provider, "model": model.name, "revision": model.revision, "chunk_size": config.max_chunk_size or DEFAULT_CHARS, "schema_hash": schema_hash(index_fields(config))}
        return [f"{k}: {built.get(k)!r} became {v!r}" for k, v in now.items() if built.get(k) != v]

    def classify(self, docs: DataFrame) -> DataFrame:
        """(path, status, file_id): new, edited, unchanged or removed, by the body's hash."""
        now = file_rows(docs).select(F.col("filepath").alias("path"), F.col("content_hash").alias("hash"))
        if not self.exists():
            return now.select("path", F.lit("new").alias("status"), F.lit(None).cast("string").alias("file_id"), "hash")
        return classified(now, self.file_index())

    def build(self, docs: DataFrame, config: Config, force: bool = False, removed: DataFrame | None = None) -> BuildResult:
        """Bring the index up to date with ``docs``.

        These are all documents; indexed files that aren't among them are gone. With
        ``removed`` (path), ``docs`` are changes only, and those paths are gone.
        """
        drift = self.drift(config)
        if drift and not force:
            raise IndexError_("the configuration changed since the index was built (" + "; ".join(drift) + "): build with force")
        full = force or not self.exists()
        model = config.embedding_model or EmbeddingModel()
        dimension = load_embedder(model).dimension
        before = None if full else self.metadata()
        if before and before["dimension"] not in (None, dimension):
            raise IndexError_(f"the model has {dimension} dimensions, the index {before['dimension']}: build with force")
        fields = index_fields(config)
        meta = {"provider": model.provider, "model": model.name, "revision": model.revision, "dimension": dimension, "chunk_size": config.max_chunk_size or DEFAULT_CHARS, "glob": config.scan.glob, "schema_hash": schema_hash(fields), "fields": fields, "segments": [] if full else before["segments"], "chunks": 0 if full else before["chunks"], "terms": 0 if full else before["terms"], "centroids": None if full else before["centroids"]}
        now = file_rows(docs)
        if full:
            return self._full(docs, now, meta, model)
        return self._append(docs, now, meta, model, removed)

    def _full(self, docs: DataFrame, now: DataFrame, meta: dict, model: EmbeddingModel) -> BuildResult:
        name = self._name()
        parallel = self.spark.sparkContext.defaultParallelism
        if docs.rdd.getNumPartitions() < parallel:  # few large partitions would leave cores idle
            docs = docs.repartition(2 * parallel)
        rows = embed_chunks(docs.withColumn("file_id", F.lit(None).cast("string")), model, meta["chunk_size"], meta["fields"])
        found = self._segment(name, 0, rows, now, meta)
        count = self.spark.read.parquet(f"{self.root}/{name}/files").count()
        return BuildResult(self._publish(meta), count, 0, 0, 0, found, meta["chunks"], True)

    def _append(self, docs: DataFrame, now: DataFrame, meta: dict, model: EmbeddingModel, removed: DataFrame | None) -> BuildResult:
        held = self.file_index(meta)
        if removed is not None:
            paths = now.select("filepath").unionByName(removed.select(F.col("path").alias("filepath")))
            held = held.join(paths, "filepath", "left_semi")
        old = held.select(F.col("filepath").alias("old_path"), F.col("file_id").alias("old_id"), F.col("content_hash").alias("old_hash"), F.col("meta_hash").alias("old_meta"))
        status = F.when(F.col("old_path").isNull(), "new").when(F.col("filepath").isNull(), "removed").when(F.col("content_hash") != F.col("old_hash"), "edited").when(~F.col("meta_hash").eqNullSafe(F.col("old_meta")), "refreshed").otherwise("unchanged")
        joined = now.join(old, now["filepath"] == old["old_path"], "full_outer")
        changes = joined.select("filepath", F.coalesce("old_id", "file_id").alias("file_id"), "content_hash", "meta_hash", status.alias("status")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counts = {r.status: r["count"] for r in changes.groupBy("status").count().collect()}
            get = lambda k: counts.get(k, 0)
            unchanged = get("unchanged") + get("refreshed")
            if not sum(get(k) for k in ("new", "edited", "removed", "refreshed")):
                newest = self.metadata()
                return BuildResult(newest["snapshot"], 0, 0, unchanged, 0, 0, newest["chunks"], False)
            name, number = self._name(), max(x["number"] for x in meta["segments"]) + 1
            of = lambda *kinds: changes.where(F.col("status").isin(*kinds))
            todo = docs.join(_bounded(of("new", "edited").select(F.col("filepath").alias("path"), "file_id"), get("new") + get("edited")), "path")
            rows = embed_chunks(todo, model, meta["chunk_size"], meta["fields"])
            if get("refreshed"):
                moved = _bounded(of("refreshed").select("filepath"), get("refreshed"))
                again = metadata_structs(docs.join(moved.withColumnRenamed("filepath", "path"), "path", "left_semi"), meta["fields"])
                copies = self._chunks(meta).drop("data", "built_at", "seg", "copied").join(_bounded(again, get("refreshed")), "filepath")
                rows = rows.withColumn("copied", F.lit(False)).unionByName(copies.withColumn("copied", F.lit(True)).select(*rows.columns, "copied"))
            dead_files = get("edited") + get("removed") + get("refreshed")
            if dead_files:
                self._write(of("edited", "removed", "refreshed").select("file_id", F.lit(number).alias("before")), name, "dead")
            lost = 0
            if get("edited") + get("removed"):
                ended = _bounded(of("edited", "removed").select("file_id"), get("edited") + get("removed"))
                self._write(self._chunks(meta).join(ended, "file_id", "left_semi").select(_chunk_bytes("chunk_id").alias("id"), "length", F.lit(number).alias("before")), name, "dead-chunks")
                ends = self.spark.read.parquet(f"{self.root}/{name}/dead-chunks").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("terms")).first()
                lost = ends.n
                meta["chunks"] -= lost
                meta["terms"] -= ends.terms or 0
            embedded = self._segment(name, number, rows, of("new", "edited", "refreshed").select("filepath", "file_id", "content_hash", "meta_hash"), meta, dead_files, lost)
        finally:
            changes.unpersist()
        stored = sum(x["chunks"] for x in meta["segments"])
        if len(meta["segments"]) > MOST_SEGMENTS or stored > 2 * max(meta["chunks"], LEAST_VECTORS):
            self._compact(meta)
        return BuildResult(self._publish(meta), get("new"), get("edited"), unchanged, get("removed"), embedded, meta["chunks"], False)

    def _compact(self, meta: dict) -> None:
        """Live rows of all segments as one; nothing is embedded again."""
        name, rows, held = self._name(), self._chunks(meta).drop("seg", "copied", "built_at"), self.file_index(meta)
        meta |= {"segments": [], "chunks": 0, "terms": 0, "centroids": None}
        self._segment(name, 0, rows, held, meta)

    def _name(self) -> str:
        return f"segment-{uuid.uuid4().hex}"

    def _write(self, df: DataFrame, segment: str, name: str) -> None:
        df.write.parquet(f"{self.root}/{segment}/{name}")

    def _segment(self, name: str, number: int, rows: DataFrame, held: DataFrame, meta: dict, dead_files: int = 0, dead_chunks: int = 0) -> int:
        """Write a segment, add it to ``meta``; returns its chunks that aren't copies."""
        schema = _chunk_schema(meta["fields"])
        rows = rows if "copied" in rows.columns else rows.withColumn("copied", F.lit(False))
        built_at = dt.datetime.now(dt.timezone.utc)
        rows = rows.withColumn("built_at", F.lit(built_at)).withColumn("seg", F.lit(number))
        self._write(held.withColumn("seg", F.lit(number)), name, "files")
        self._write(rows.select(*schema.fieldNames()), name, "chunks")
        written = self.spark.read.schema(schema).parquet(f"{self.root}/{name}/chunks")
        sums = written.agg(F.count(F.lit(1)).alias("n"), F.count_if("copied").alias("copied"), F.sum(F.when(~F.col("copied"), F.col("length"))).alias("terms")).first()
        fresh = written.where(~F.col("copied"))
        new = sums.n - sums.copied
        own = {"name": name, "number": number, "chunks": sums.n, "dead_files": dead_files, "dead_chunks": dead_chunks, "buckets": 0, "lists": False}
        meta["chunks"] += new
        meta["terms"] += sums.terms or 0
        if new:
            own["buckets"] = min(MOST_BUCKETS, max(1, new // BUCKET_CHUNKS))
            parts = max(1, min(256, new // PART_CHUNKS))
            dealt = posting_rows(fresh, own["buckets"], parts).repartition("bucket", "part").sortWithinPartitions("bucket", "term", "id")
            dealt.write.partitionBy("bucket", "part").parquet(f"{self.root}/{name}/postings")
        meta["segments"] = [*meta["segments"], own]
        if meta["centroids"] and new:
            write_lists(fresh, f"{self.root}/{name}/lists", centroids_of(self.spark.read.parquet(f"{self.root}/{meta['centroids']}/centroids")), new)
            own["lists"] = True
        elif meta["chunks"] >= LEAST_VECTORS and not meta["centroids"]:
            live = self._chunks(meta)
            centroids = fit_centroids(live, max(1, int(meta["chunks"] ** 0.5)), meta["chunks"])
            write_lists(live, f"{self.root}/{name}/lists", centroids, meta["chunks"])
            self._write(self.spark.createDataFrame([(i, x) for i, x in enumerate(centroids.tolist())], "list int, centroid array<float>").coalesce(1), name, "centroids")
            meta["centroids"], own["lists"] = name, True
        return new

    def _publish(self, meta: dict) -> str:
        """Make ``meta`` the newest snapshot, and delete what no kept snapshot names."""
        versions = self._versions()
        version = max(versions, default=0) + 1
        meta |= {"snapshot": f"{version:010d}", "built_at": dt.datetime.now(dt.timezone.utc).isoformat(), "mean_length": meta["terms"] / meta["chunks"] if meta["chunks"] else 0.0}
        if not self.files.create(f"{LOG}/{version:010d}.json", json.dumps(meta, indent=2)):
            raise IndexError_("another build has finished first: build again")
        kept = sorted([*versions, version])[-KEPT_SNAPSHOTS:]
        named = {x["name"] for v in kept for x in json.loads(self.files.read(f"{LOG}/{v:010d}.json"))["segments"]}
        for v in versions:
            if v not in kept:
                self.files.remove(f"{LOG}/{v:010d}.json")
        for x in self.files.names():
            if x.startswith("segment-") and x not in named:
                self.files.remove(x)
        return meta["snapshot"]


def chunk_stats(rows: DataFrame) -> dict[str, int]:
    """How many chunks, and files that have any."""
    found = chunks_per(rows).first()
    return {"chunks": found.chunks, "files_indexed": found.files}


def chunks_per(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, chunks, files): counts of a chunk table."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunks"), F.countDistinct("file_id").alias("files"))


def chunks_of_removed(rows: DataFrame, status: DataFrame) -> DataFrame:
    """(file_id, chunks): what goes with files that ``classified`` calls removed."""
    return rows.join(status.where("status = 'removed'").select("file_id"), "file_id", "left_semi").groupBy("file_id").agg(F.count(F.lit(1)).alias("chunks"))


def _chunk_bytes(column: str):
    return F.unhex(F.replace(F.col(column), F.lit("-"), F.lit("")))


def _chunk_id(column: str):
    return F.regexp_replace(F.lower(F.hex(column)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _data_type(fields: dict[str, str]) -> T.DataType:
    return storage_struct(fields) if fields else T.StringType()


def _chunk_schema(fields: dict[str, str]) -> T.StructType:
    head = T._parse_datatype_string("chunk_id string, file_id string, chunk_index int, start_line int, end_line int, chunk_text string, embedding array<float>, filepath string, content_hash string")
    return T.StructType([*head.fields, T.StructField("data", _data_type(fields)), *T._parse_datatype_string("built_at timestamp, norm double, length int, seg int, copied boolean").fields])


def posting_rows(rows: DataFrame, buckets: int, parts: int = 1) -> DataFrame:
    """(bucket, part, term, id, tf, length) of (chunk_id, chunk_text); a chunk is counted where it is."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [text_terms(x or "") for x in batch.column("chunk_text").to_pylist()]
            lengths = np.fromiter(map(len, found), np.int64, len(found))
            told = pa.array([y for x in found for y in x], pa.string()).dictionary_encode()
            names, codes = told.dictionary, told.indices.to_numpy().astype(np.int64)
            pairs, counts = np.unique(np.repeat(np.arange(len(found)), lengths) * max(len(names), 1) + codes, return_counts=True)
            at, codes = pairs // max(len(names), 1), pairs % max(len(names), 1)
            ids = [uuid.UUID(x).bytes for x in batch.column("chunk_id").to_pylist()]
            bucket = np.array([bucket_of(x, buckets) for x in names.to_pylist()], np.int32)
            part = np.array([x[0] % parts for x in ids], np.int32)
            where = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[codes]), pa.array(part[at]), names.take(pa.array(codes)), pa.array(ids, pa.binary()).take(where), pa.array(counts.astype(np.int32)), pa.array(lengths[at].astype(np.int32))], ["bucket", "part", "term", "id", "tf", "length"])

    small_batches(rows.sparkSession)
    return rows.select("chunk_id", "chunk_text").mapInArrow(step, _POSTING)


def file_rows(docs: DataFrame) -> DataFrame:
    """(filepath, file_id, content_hash, meta_hash) of each document; ids follow from paths."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column("path").to_pylist()
            hashed = [[None if x is None else xxhash.xxh3_64_hexdigest(x.encode("utf-8", "surrogatepass")) for x in batch.column(c).to_pylist()] for c in ("content", "data")]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (paths, [file_id_of(x) for x in paths], *hashed)], ["filepath", "file_id", "content_hash", "meta_hash"])

    small_batches(docs.sparkSession)
    return docs.select("path", "content", "data").mapInArrow(step, _FILE)


def file_id_of(path: str) -> str:
    return str(uuid.uuid5(_NAMESPACE, path))


def classified(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, hash) against (filepath, file_id, content_hash): what became of each file."""
    old = before.withColumnRenamed("filepath", "old_path")
    status = F.when(F.col("old_path").isNull(), "new").when(F.col("path").isNull(), "removed").when(F.col("hash") == F.col("content_hash"), "unchanged").otherwise("edited")
    return now.join(old, now["path"] == old["old_path"], "full_outer").select(F.coalesce("path", "old_path").alias("path"), status.alias("status"), "file_id", "hash")


def embed_chunks(files: DataFrame, model: EmbeddingModel, most: int, fields: dict[str, str] | None = None, every: bool = False) -> DataFrame:
    """Chunk and embed (path, content, body_line_offset, file_id, data), a batch at a time.

    Gives the columns of the chunk table but for those that a build adds, and each
    vector's ``norm`` and the text's ``length`` in terms. A file's metadata goes beside its chunks in the same pass.
    With ``every``, a file that has no chunks gives one row whose chunk is null.
    """
    fields = fields or {}
    struct = _data_type(fields)
    schema = T.StructType([*_chunk_schema(fields).fields[:10], T.StructField("norm", T.DoubleType()), T.StructField("length", T.IntegerType())])
    arrow = to_arrow_schema(schema)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        embedder = load_embedder(model)
        for batch in batches:
            rows, numbers = [], []
            for x in batch.to_pylist():
                file_id, content = x["file_id"] or file_id_of(x["path"]), x["content"] or ""
                digest = xxhash.xxh3_64_hexdigest(content.encode("utf-8", "surrogatepass"))
                data = stored_row(json.loads(x["data"]), struct, fields) if fields and x["data"] is not None else None
                found = chunks(content, most)
                for c in found:
                    rows.append([str(uuid.uuid5(_NAMESPACE, f"{file_id}/{digest}/{c.index}")), file_id, c.index, c.start_line + x["body_line_offset"], c.end_line + x["body_line_offset"], plain_text(c.plain_text), x["path"], digest, data])
                if every and not found:
                    rows.append([None, file_id, None, None, None, None, x["path"], digest, data])
            bare = np.array([r[5] is None for r in rows], bool)
            vectors = np.asarray(embedder.encode([r[5] or "" for r in rows]), np.float32) if rows else np.zeros((0, embedder.dimension), np.float32)
            numbers = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * vectors.shape[1]), pa.array(vectors.ravel()), mask=pa.array(bare))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 9
            norms = pa.array(np.sqrt(np.square(vectors.astype(np.float64)).sum(axis=1)), mask=bare)
            given = [*columns[:6], numbers, *columns[6:], norms, [None if r[5] is None else len(text_terms(r[5])) for r in rows]]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(given, arrow, strict=True)], schema=arrow)

    small_batches(files.sparkSession)
    return files.select("path", "content", "body_line_offset", "file_id", "data").mapInArrow(step, schema)


def metadata_structs(docs: DataFrame, fields: dict[str, str]) -> DataFrame:
    """(filepath, data): frontmatter in its storage types."""
    schema = T.StructType([T.StructField("filepath", T.StringType()), T.StructField("data", _data_type(fields))])
    if not fields:
        return docs.select(F.col("path").alias("filepath"), F.lit(None).cast("string").alias("data"))
    arrow = to_arrow_schema(schema)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if x is None else stored_row(json.loads(x), schema["data"].dataType, fields) for x in batch.column("data").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path").cast(pa.string()), pa.array(rows, arrow.field("data").type)], schema=arrow)

    small_batches(docs.sparkSession)
    return docs.select("path", "data").mapInArrow(step, schema)
