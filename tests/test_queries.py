import os

import duckdb
import pandas as pd
import pytest

from tests.conftest import DATA
from vellumine import queries

QUERIES, SQL = queries.queries(), queries.oracle_sql()


@pytest.fixture(scope="module")
def database():
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def plain(frame):
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        frame[c] = (frame[c].round(6) if frame[c].dtype.kind == "f" else frame[c]).astype(str)
    return frame.sort_values(list(frame.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, database, name):
    found = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        pd.testing.assert_frame_equal(plain(found), plain(database.execute(SQL[name]).df()))


def test_tags_are_all_words_of_a_text(spark, tmp_path):
    many = " ".join(f"{a}{b}" for a in "bcdfghjk" for b in "lmnprstv")
    texts = [(1, "en", f"{many} the of be is"), (2, "en", many), (3, "de", f"{many} DER"), (4, "en", "the of")]
    spark.createDataFrame([(i, text, lang, "src1", len(text)) for i, lang, text in texts], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = {"where_array_eq": {1, 4}, "where_array_neq": {2, 3}, "where_array_in": {1, 4}, "where_array_not_in": {2, 3}, "where_array_functions": {1}, "where_array_any": {1, 3}}
    assert {name: {r.id for r in QUERIES[name](spark, str(tmp_path)).collect()} for name in want} == want


def test_links_are_stripped_in_whole_texts(spark, tmp_path):
    text = "word " * 20 + "and [[a|the first]], ![[b]] and the rest"
    spark.createDataFrame([(7, text, "en", "src1", len(text))], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    (row,) = QUERIES["wikilink_strip"](spark, str(tmp_path)).collect()
    assert row.text == "see en, the source and 7 " + "word " * 20 + "and the first, b and the rest"


def test_chunks_that_lose_text_are_told():
    text = "# One\n\n" + "Some words of *this*. " * 80 + "\n\n# Two\n\nand the last"
    found = queries.chunks(text, 1024)
    assert len(found) > 1 and queries.holds_words(text, found)
    assert not queries.holds_words(text, found[:1]) and not queries.holds_words(text, found[::-1])


def odd_texts(spark, folder, texts):
    """The driver's tables with some texts, and a database over them."""
    rows = [(i, text, "de" if i else "en", "src1", len(text)) for i, text in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def test_files_without_chunks_count(spark, tmp_path):
    con = odd_texts(spark, tmp_path, [" \n", "word", "", "\u3000", "more words"])
    found = QUERIES["denormalise_index"](spark, str(tmp_path)).toPandas()
    pd.testing.assert_frame_equal(plain(found), plain(con.execute(SQL["denormalise_index"]).df()))


CODE = ["one  \n\n      two   words  \n\n        three \n\nfour", "a\n\n    **** x", " \n", "word\n \n\t\t....... end\n"]


@pytest.mark.parametrize("name", ["index_rows", "index_incremental"])
def test_indented_lines_are_stripped_as_others(spark, tmp_path, name):
    con = odd_texts(spark, tmp_path, CODE)
    found = QUERIES[name](spark, str(tmp_path)).toPandas()
    pd.testing.assert_frame_equal(plain(found), plain(con.execute(SQL[name]).df()))


def test_texts_are_cut_and_embedded_once(spark):
    from vellumine import vault_queries

    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "regexp_replace(" not in plan(vault_queries._plain(spark, DATA))
    assert plan(QUERIES["removed_chunks"](spark, DATA)).count("mapinarrow") <= 2


def test_entry_imports_without_the_optional_part(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
