import pytest
from hypothesis import given
from hypothesis import strategies as st

from vellumine.functions.globs import GlobError, covered, glob_matches
from vellumine.sources import toml_codec as codec
from vellumine.sources.frontmatter import count_lines, documents, flatten, leaves, parse_document, skipped
from vellumine.sources.listing import list_files, read_files

YAML = "---\ntitle: A\nyear: 2024\nshare: 1.0\nday: 2024-01-15\ndraft: yes\ntags: [a, b]\nn: null\nmeta:\n  x: 1\n---\nBody\n"
TOML = '+++\ntitle = "A"\nyear = 2024\nbuilt = 2024-01-15T10:00:00Z\n[meta]\nx = 1.5\n+++\n\nBody'
JSON = '{"title": "A", "tags": [1, 2.5], "e": {}}\nBody'


def fields(row):
    return {x["field"]: x["type"] for x in row["leaves"] if x["type"] != "Object"}


def test_formats():
    row = parse_document("a.md", YAML)
    assert fields(row) == {"title": "String", "year": "Integer", "share": "Float", "day": "Date", "draft": "String", "tags": "Array(String)", "n": "Null", "meta.x": "Integer"}
    assert (row["content"], row["body_line_offset"]) == ("Body", 11)
    assert fields(parse_document("b.md", TOML)) == {"title": "String", "year": "Integer", "built": "DateTime", "meta.x": "Float"}
    assert fields(parse_document("c.md", JSON)) == {"title": "String", "tags": "Array(Float)"}
    bare = parse_document("d.md", "just text")
    assert bare["data"] is None and bare["frontmatter_error"] is None


@pytest.mark.parametrize("raw", ["---\na: [1\n---\n", "+++\na = \n+++\n", '{"a": ', "---\n- 1\n---\n", "---\na: .nan\n---\n", "---\n1: x\n---\n"])
def test_unreadable_frontmatter(raw):
    row = parse_document("x.md", raw)
    assert row["data"] is None and row["frontmatter_error"]


def test_lines_and_repeated_names():
    assert [count_lines(x) for x in ("", "a", "a\n", "a\nb", "\n\n", "a\u2028b\x0bc")] == [0, 1, 1, 2, 2, 1]
    row = parse_document("a.md", '{"a.b": 1, "a": {"b": 2}}\n\nx\n\n')
    assert [(x["field"], x["first"]) for x in row["leaves"]] == [("a.b", True), ("a", True), ("a.b", False)] and row["body_line_offset"] == 3
    assert parse_document("b.md", "\n\n--- \na: 1\n---\r\nx")["data"] == '{"a":1}' and parse_document("c.md", "---\na: 1\n--\n")["data"] is None


def test_forced_format():
    assert "asked for" in parse_document("x.md", YAML, "toml")["frontmatter_error"]
    assert parse_document("x.md", TOML, "toml")["frontmatter_error"] is None


def test_limits():
    many = "---\n" + "".join(f"k{i}: 1\n" for i in range(1001)) + "---\n"
    assert parse_document("x.md", many)["skip_reason"]
    assert parse_document("x.md", '{"a":' * 60 + "1" + "}" * 60)["skip_reason"]


@given(st.recursive(st.none() | st.booleans() | st.integers(), lambda x: st.dictionaries(st.text("abc", min_size=1, max_size=3), x, max_size=3), max_leaves=12).filter(lambda x: isinstance(x, dict)))
def test_flatten_keeps_every_leaf(data):
    def count(x):
        return sum(map(count, x.values())) if isinstance(x, dict) else 1

    assert len(flatten(data)) == count(data)


def test_listing(spark, tmp_path):
    for name, text in {"a.md": YAML, "_index.md": JSON, ".hid.md": "x", "b.txt": "x", "sub/c.markdown": TOML, "sub/skip.md": "x", "out/d.md": "x", "keep.md": "x"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / ".gitignore").write_text("skip.md\nout/\n*.tmp\n")
    (tmp_path / ".vaultignore").write_text("keep*\n!keep.md\n")
    assert list_files(str(tmp_path)) == [".hid.md", "_index.md", "a.md", "keep.md", "sub/c.markdown"]
    assert "out/d.md" in list_files(str(tmp_path), skip_gitignore=True)
    assert list_files(str(tmp_path), "sub/**") == ["sub/c.markdown"]
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe")
    docs = documents(read_files(spark, str(tmp_path), list_files(str(tmp_path))))
    assert docs.count() == 5
    (tmp_path / "deep.md").write_text('{"a":' * 60 + "1" + "}" * 60)
    left_out = skipped(read_files(spark, str(tmp_path), [*list_files(str(tmp_path)), "gone.md"])).collect()
    assert sorted((r.path, r.reason.split(":")[0]) for r in left_out) == [("bad.md", "not UTF-8"), ("deep.md", "nested deeper than 50"), ("gone.md", "unreadable")]
    assert documents(read_files(spark, str(tmp_path), [".hid.md", "a.md"]), include_bare_files=False).count() == 1
    assert {r.field for r in leaves(docs).where("path = 'sub/c.markdown'").collect()} == {"title", "year", "built", "meta.x"}


@pytest.mark.parametrize(("glob", "path", "yes"), [("**", "a/b.md", True), ("*", "a/b.md", True), ("blog/*", "blog/x/y.md", True), ("blog/**", "blogs/x.md", False), ("**/a.md", "a.md", True), ("[ab].md", "b.md", True), ("{x,y}/*.md", "y/q.md", True), ("a?c", "abc", True)])
def test_globs(glob, path, yes):
    assert glob_matches(glob, path) is yes


def test_glob_errors_and_coverage():
    with pytest.raises(GlobError):
        glob_matches("[a", "a")
    assert not glob_matches("a/*", "a/b/c", literal_separator=True)
    assert covered("blog/x/**", ["blog/**"]) and covered("*", ["**"]) and not covered("notes/**", ["blog/**"])


VALUES = st.recursive(st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text().filter(lambda x: x != codec.NULL and "\ud800" > max(x, default="a")), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("ab./\" ", min_size=1, max_size=4), x, max_size=3), max_leaves=10)


@given(VALUES)
def test_toml_round_trip(value):
    assert codec.from_toml(codec.to_toml(value)) == value


def test_toml_errors():
    for wrong in ({"a": [1 << 63]}, {"a": float("inf")}, {"a": codec.NULL}, {codec.ROOT: 1}):
        with pytest.raises(codec.CodecError, match="at '"):
            codec.to_toml(wrong)
    with pytest.raises(codec.CodecError, match="/a/0"):
        codec.from_toml("a = [nan]")
    assert codec.from_toml("d = 2024-01-15\nt = 2024-01-15T10:00:00Z") == {"d": "2024-01-15", "t": "2024-01-15T10:00:00Z"}


def test_texts_go_to_python_in_small_batches(spark):
    from vellumine import queries, vault_queries
    from vellumine.operators.index import embed_chunks, file_rows, metadata_structs, posting_rows
    from vellumine.plans.config import EmbeddingModel
    from vellumine.sources.frontmatter import documents
    from tests.conftest import DATA

    docs = documents(spark.createDataFrame([(f"{i}.md", "text") for i in range(2500)], "path string, raw string").coalesce(1))
    files = docs.selectExpr("*", "cast(null as string) as file_id")
    rows, key = docs.selectExpr("path as chunk_id", "content as chunk_text"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    steps = [lambda: documents(docs.selectExpr("path", "content as raw")), lambda: embed_chunks(files, EmbeddingModel("mock", "mock-8"), 100), lambda: file_rows(docs), lambda: metadata_structs(docs, {"a": "String"}), lambda: posting_rows(rows, 1)]
    steps += [lambda f=f: f(spark, DATA) for f in (queries.chunk_documents, vault_queries.visible_text, vault_queries.chunk_lines)]
    for step in steps:
        spark.conf.set(key, "10000")
        step()
        assert int(spark.conf.get(key)) <= 1000
    sizes = docs.select("path").mapInArrow(lambda batches: (x.from_pydict({"n": [x.num_rows]}) for x in batches), "n long")
    assert max(r.n for r in sizes.collect()) <= 1000


def test_terms_of_ascii_are_those_of_any_text():
    from vellumine.functions.text import _TERM, text_terms

    for text in ("", "a_b c-D 9\x1c\x00e", "".join(map(chr, range(128))), "É a_B ß"):
        assert text_terms(text) == _TERM.findall(text.lower())
