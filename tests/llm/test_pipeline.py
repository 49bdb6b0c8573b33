import os
from fractions import Fraction

import duckdb
import pytest

from tests.conftest import DATA
from tests.llm.test_dedup import brute
from tests.llm.test_tokens import check_packed, ids, WORDS

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        seen[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = seen[name][1]
    for name in ("language", "quality", "exact_dedup", "near_dedup"):
        before, after = seen[name]
        assert after.columns == COLUMNS and after.join(before, COLUMNS, "left_anti").count() == 0
    assert seen["quality"][1].count() < seen["quality"][0].count()
    before, after = seen["exact_dedup"]
    assert after.count() == len({r.text.lower() for r in before.collect()}) and after.count() < before.count()
    before, after = seen["near_dedup"]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {c for _, c in brute(rows, 5, Fraction(4, 5))}
    before, after = seen["packing"]
    check_packed(after.collect(), [[*ids(WORDS, r.text), 2] for r in before.collect()])
    assert corpus_pipeline.run(spark, DATA).count() == after.count()


def test_registered_queries(spark):
    import __spark_entry__ as entry

    names = [x for x in entry.queries() if x.startswith("op")]
    assert sorted(int(x[2:].split("_")[0]) for x in names) == list(range(1, 11)) and "pipeline" in entry.queries()
    rows = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in names:
        found = entry.queries()[name](spark, DATA)
        assert name.startswith(("op1_", "op7_", "op8_")) or found.count() == rows
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(entry.oracle_sql()["op9_exact_dedup"]).fetchall()
    assert sorted(map(tuple, entry.queries()["op9_exact_dedup"](spark, DATA).collect())) == sorted(want)
