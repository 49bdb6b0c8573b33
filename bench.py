"""Headline timings, as one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS``
the threads. The session starts before the clock; every query runs once to warm
up and once for its time, which ends when all rows are made.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
QUERIES = ("field_types_widened", "path_globs", "categorical_fields", "violations_all", "violation_report", "where_scalar", "where_interval", "where_array_in", "classify_incremental", "content_hash_dedupe", "chunk_documents", "cosine_topk", "semantic_filtered", "best_chunk_per_file", "bm25_topk", "rrf_hybrid")


def main() -> None:
    from pyspark.sql import SparkSession

    from vellumine import queries
    from vellumine.operators.embedding import load_embedder
    from vellumine.operators.index import Index
    from vellumine.operators.search import search
    from vellumine.plans.config import Config, EmbeddingModel, Field

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            run()
            best = time.perf_counter() - began
        times[name] = round(best, 4)

    known = queries.queries()
    for name in QUERIES:
        timed(name, lambda f=known[name]: f(spark, SF_DIR).write.format("noop").mode("overwrite").save())

    folder = tempfile.mkdtemp(prefix="vellumine-bench-")
    try:
        config = Config(fields=[Field("lang"), Field("source"), Field("n_chars", "Integer"), Field("quality", "Integer"), Field("toxic", "Integer")])
        docs = queries.corpus(spark, SF_DIR, body=True).cache()
        documents = docs.count()
        index = Index(spark, f"file://{folder}/index")
        timed("index_build_full", lambda: index.build(docs, config, force=True))
        timed("index_build_unchanged", lambda: index.build(docs, config))
        query = load_embedder(EmbeddingModel()).encode(["the license of this"])[0].tolist()
        for name, mode, where in (("search_semantic", "semantic", None), ("search_fulltext", "fulltext", None), ("search_hybrid_filtered", "hybrid", "lang = 'en' AND quality = 1"), ("search_hybrid", "hybrid", None)):
            timed(name, lambda m=mode, w=where: search(index, "the license of this", m, w, 10, query)[0].collect())
        chunks = index.metadata()["chunks"]
    finally:
        shutil.rmtree(folder, ignore_errors=True)
    print(json.dumps({"metric": "sum of warm query times", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "documents": documents, "chunks": chunks, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
