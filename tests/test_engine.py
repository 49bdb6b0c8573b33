import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vellumine.functions.text import cosine_similarity, strip_wikilinks, wikilinks_stripped
from vellumine.operators import report
from vellumine.operators.chunking import chunks, plain_text
from vellumine.operators.embedding import MockEmbedder
from vellumine.operators.index import Index, IndexError_
from vellumine.plans import config as cfg
from vellumine.plans import validation
from vellumine.sources.frontmatter import documents
from vellumine.streaming.upserts import keep_up
from vellumine.vault import Vault, VaultError, main

VAULT = {
    "blog/rust.md": ("active", 5, "false", "2024-01-15", "[rust, systems]", "Rust book", "# Rust\n\nOwnership. " + "The borrow checker is strict. " * 100),
    "blog/cooking.md": ("archived", 2, "true", "2023-06-15", "[food]", "Cooking", "Pasta and sauce."),
    "notes/photonics.md": ("active", 4, "false", "2024-03-10", "[optics]", "Photonics", "The wavelength of [[light|Light]]."),
    "notes/draftpost.md": ("draft", 3, "true", "2024-05-01", "[misc]", "Draft", "Nothing yet."),
    "notes/review.md": ("active", 4, "false", "2024-02-20", "[meta]", "Review", "A review."),
    "blog/archive.md": ("archived", 1, "true", "2022-11-05", "[old]", "Archive", "Old stuff."),
}


def write(root, path, text):
    (root / path).parent.mkdir(parents=True, exist_ok=True)
    (root / path).write_text(text)


@pytest.fixture
def vault(spark, tmp_path):
    for path, (status, rating, draft, day, tags, title, body) in VAULT.items():
        extra = "calibration:\n  baseline:\n    wavelength: 850.0\n" if "photonics" in path else ""
        write(tmp_path, path, f"---\ntitle: {title}\nstatus: {status}\nrating: {rating}\ndraft: {draft}\npublished: {day}\ntags: {tags}\n{extra}---\n{body}\n")
    return Vault(spark, str(tmp_path))


def names(outcome):
    return [r.filename for r in outcome.result["hits"].collect()]


def test_search(vault):
    vault.init()
    with pytest.raises(VaultError):
        vault.init()
    assert vault.check().result.violations.count() == 0
    built = vault.build().result
    assert (built.new, built.full) == (6, True) and built.chunks_total > 6
    find = lambda mode, where=None, **more: names(vault.search("wavelength", mode, where, auto_build=False, **more))
    assert find("fulltext") == ["notes/photonics.md"]
    for mode in ("semantic", "hybrid", "fulltext"):
        assert find(mode, "rating > 1000") == [] and find(mode, limit=0) == []
    for clause, want in {"array_has(tags, 'rust')": ["blog/rust.md"], "title LIKE 'Rust%'": ["blog/rust.md"], "calibration.baseline.wavelength > 800": ["notes/photonics.md"], "status = 'active' AND rating >= 5": ["blog/rust.md"], "rating BETWEEN 1 AND 2": ["blog/archive.md", "blog/cooking.md"], "published - DATE '2024-01-01' > 100": ["notes/draftpost.md"]}.items():
        assert sorted(find("semantic", clause)) == want
    assert find("semantic", limit=10).count("blog/rust.md") == 1 and len(find("semantic", overfetch=None)) == 6
    columns = vault.index.rows().columns
    assert columns == ["chunk_id", "file_id", "chunk_index", "start_line", "end_line", "chunk_text", "embedding", "filepath", "content_hash", "data", "built_at"]
    assert vault.info().result["index"]["files_indexed"] == 6


def test_incremental_equals_full(vault, tmp_path):
    vault.init()
    vault.build()
    key = lambda: sorted((r.filepath, r.chunk_index, r.chunk_text, r.data.rating) for r in vault.index.rows().collect())
    ids = {r.filepath: r.file_id for r in vault.index.file_index().collect()}
    again = vault.build().result
    assert (again.new, again.edited, again.unchanged, again.chunks_embedded) == (0, 0, 6, 0)
    (tmp_path / "blog/archive.md").unlink()
    text = (tmp_path / "blog/cooking.md").read_text()
    write(tmp_path, "blog/cooking.md", text.replace("Pasta", "Rice"))
    write(tmp_path, "notes/review.md", (tmp_path / "notes/review.md").read_text().replace("rating: 4", "rating: 9"))
    write(tmp_path, "notes/new.md", (tmp_path / "notes/review.md").read_text())
    done = vault.build().result
    assert (done.new, done.edited, done.unchanged, done.removed) == (1, 1, 4, 1) and not done.full
    partial = key()
    assert ("notes/review.md", 0, "A review.", 9) in partial
    assert {r.filepath: r.file_id for r in vault.index.file_index().collect()}["blog/cooking.md"] == ids["blog/cooking.md"]
    assert vault.build(force=True).result.full and key() == partial
    config = vault.config()
    config.max_chunk_size = 200
    cfg.write_config(config, vault.config_path)
    with pytest.raises(IndexError_, match="chunk_size"):
        vault.build()
    assert vault.clean().result["files"] > 0 and not vault.index.exists()
    with pytest.raises(VaultError):
        vault.search("x", auto_build=False)


def test_violations_stop_a_build(vault, tmp_path, capsys):
    vault.init()
    write(tmp_path, "notes/bad.md", "---\nrating: many\n---\nx")
    write(tmp_path, "notes/torn.md", "---\na: [\n---\nx")
    with pytest.raises(VaultError, match="violations"):
        vault.build(auto_update=False)
    assert main(["check", str(tmp_path)]) == 1
    assert "FrontmatterUnrepresentable" in capsys.readouterr().out
    assert main(["init", str(tmp_path)]) == 2 and main(["--output", "json", "info", str(tmp_path)]) == 0
    assert "2020-12" in vault.export()


def test_command_line(vault, tmp_path, capsys):
    path = str(tmp_path)
    run = lambda *args: (main([*args]), capsys.readouterr())
    assert run("init", path, "--dry-run")[0] == 0 and not (tmp_path / "vault.toml").exists()
    assert run("--output", "json", "init", path, "--glob", "blog/**")[0] == 0 and vault.config().scan.glob == "blog/**"
    assert run("init", path)[0] == 2 and run("init", path, "--force")[0] == 0
    code, said = run("-v", "build", path, "--set-model", "mock-16", "--set-chunk-size", "300", "--force")
    assert code == 0 and "build" in said.err and "done" in said.err and vault.index.metadata()["dimension"] == 16
    assert run("build", path, "--set-chunk-size", "400")[0] == 2
    code, said = run("--output", "json", "search", "wavelength", path, "--mode", "fulltext", "-n", "1", "--no-build")
    assert code == 0 and [x["filename"] for x in json.loads(said.out)] == ["notes/photonics.md"]
    assert "read as" in run("search", "book", path, "--where", "tags = 'rust'", "--no-build")[1].out
    write(tmp_path, "notes/more.md", "---\ntitle: T\nstatus: odd\nrating: 7\ndraft: true\npublished: 2024-01-01\ntags: [a]\nextra: 1\n---\nx")
    assert run("check", path, "--no-update")[0] == 0
    assert "extra" in run("update", path, "--dry-run")[1].out and run("update", path, "--reinfer", "rating", "--with", "range")[0] == 0
    assert {x.name: x.constraints.max for x in vault.config().fields if x.name == "rating"} == {"rating": 7}
    assert run("update", path, "--reinfer", "nothing")[0] == 2
    assert run("export-jsonschema", path, "--format", "toml", "--output-file", str(tmp_path / "s.toml"))[0] == 0 and (tmp_path / "s.toml").exists()
    assert run("check", path, "--jsonschema", str(tmp_path / "s.toml"))[0] in (0, 1) and run("info", path)[0] == 0
    (tmp_path / "notes" / "odd.md").write_bytes(b"\xff")
    assert [(r.path, r.reason) for r in vault.check(auto_update=False).result.skipped.collect()] == [("notes/odd.md", "not UTF-8")]
    assert run("--output", "json", "clean", path)[0] == 0 and not vault.index.exists()


def test_cached_revision(tmp_path):
    from vellumine.operators.embedding import cached_revision

    assert cached_revision("a/b", str(tmp_path)) is None
    for name in ("one", "two"):
        (tmp_path / "models--a--b" / "snapshots" / name).mkdir(parents=True)
    assert cached_revision("a/b", str(tmp_path)) in ("one", "two")
    (tmp_path / "models--a--b" / "refs").mkdir()
    (tmp_path / "models--a--b" / "refs" / "main").write_text("one\n")
    assert cached_revision("a/b", str(tmp_path)) == "one"


def rows(spark, **files):
    return documents(spark.createDataFrame([(k.replace("__", "/") + ".md", json.dumps(v) if not isinstance(v, str) else v) for k, v in files.items()], "path string, raw string"))


def kinds(spark, field, **files):
    found = validation.violations(rows(spark, **files), cfg.Config(fields=[field])).collect()
    return sorted((r.path[:-3], r.kind, r.rule, r.detail) for r in found)


def test_each_kind_of_violation(spark):
    f, c = cfg.Field, cfg.Constraints
    assert kinds(spark, f("x", "Integer", nullable=False), a={"x": "s"}, b={"x": None}, c={"x": 5.0}, d={"x": 5.5}, e={"x": {"y": 1}}, f={"x": True}) == [("a", "WrongType", "type Integer", "got String"), ("b", "NullNotAllowed", "not nullable", None), ("d", "WrongType", "type Integer", "got Float"), ("e", "WrongType", "type Integer", "got Object"), ("f", "WrongType", "type Integer", "got Boolean")]
    assert kinds(spark, f("x", "Float"), a={"x": 1}, b={"x": 1.5}) == [("a", "WrongType", "type Float", "got Integer")]
    assert kinds(spark, f("x", "Float", preprocess=["widen-int-to-float"], constraints=c(max=3)), a={"x": 5}, b={"x": 2}) == [("a", "OutOfRange", "maximum 3", "got 5.0")]
    assert kinds(spark, f("x", "Array(Float)"), a={"x": [1.5, 2]}) == [("a", "WrongType", "type Array(Float)", "got Integer at index 1")]
    assert kinds(spark, f("x", "Array(String)", constraints=c(max_length=2)), a={"x": ["ok", "long"]}, b={"x": "s"}, c={"x": [None]}, d={"x": None}) == [("a", "OutOfRange", "maxLength 2", 'got "long"'), ("b", "WrongType", "type Array(String)", "got String"), ("c", "NullNotAllowed", "not nullable", None)]
    assert kinds(spark, f("x", "String", preprocess=["coerce-to-string"], constraints=c(categories=["1", "[2]"])), a={"x": 1}, b={"x": [2]}, c={"x": 3}, d={"x": None}) == [("c", "InvalidCategory", 'enum ["1","[2]",null]', 'got "3"')]
    assert kinds(spark, f("x", "Date"), a={"x": "2024-02-30"}, b={"x": "2024-02-29"}) == [("a", "WrongType", "format date", 'got "2024-02-30"')]
    assert kinds(spark, f("x", "DateTime"), a={"x": "2024-02-20"}, b={"x": "2024-02-20T00:00:00Z"}) == [("a", "WrongType", "format date-time", 'got "2024-02-20"')]
    assert kinds(spark, f("x", "String", constraints=c(pattern="^a+$", min_length=2)), a={"x": "b"}) == [("a", "OutOfRange", "minLength 2", 'got "b"'), ("a", "WrongType", "pattern ^a+$", 'got "b"')]
    assert kinds(spark, f("x.y", "Integer", allowed=["p/**"], required=["p/**"]), p__a={"x": 1}, q__b={"x": {"y": 1}}, p__c="bare") == [("p/a", "MissingRequired", 'required in ["p/**"]', None), ("p/c", "MissingRequired", 'required in ["p/**"]', None), ("q/b", "Disallowed", 'allowed in ["p/**"]', None)]
    assert kinds(spark, f("x", "Integer", constraints=c(min=1)), a={"x": "s"}, b={"x": 0}) == [("a", "WrongType", "type Integer", "got String"), ("b", "OutOfRange", "minimum 1", "got 0")]


def test_report(spark):
    found = validation.violations(rows(spark, b={"x": 1, "y": None}, a={"x": 2}, c="---\n- 1\n---\n"), cfg.Config(fields=[cfg.Field("x"), cfg.Field("y", nullable=False, required=["**"])]))
    groups = validation.report(found).collect()
    assert [(g.field, g.kind, [x.path for x in g.files]) for g in groups] == [("<frontmatter>", "FrontmatterUnrepresentable", ["c.md"]), ("x", "WrongType", ["a.md", "b.md"]), ("y", "MissingRequired", ["a.md", "c.md"]), ("y", "NullNotAllowed", ["b.md"])]
    assert json.loads(report.violations_text(groups, "json"))[1]["files"][0] == {"path": "a.md", "detail": "got Integer"}
    for form in report.FORMS:
        assert "WrongType" in report.violations_text(groups, form, verbose=True)
    (short,) = [g for g in validation.report(found, 1).collect() if g.kind == "WrongType"]
    assert ([x.path for x in short.files], short.n) == (["a.md"], 2) and "(1 more)" in report.violations_text([short], verbose=True)


def test_documents_are_parsed_once(spark):
    docs = rows(spark, a={"x": 1, "y": None}, b={"z": "q"})
    plan = validation.violations(docs, cfg.Config(fields=[cfg.Field("x", required=["**"], constraints=cfg.Constraints(pattern="^a")), cfg.Field("y", allowed=["p/**"], nullable=False)]))
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("MapInArrow") == 1 and "Union" not in text


def test_chunks():
    body = "# One\n\n" + "Word of mouth. " * 40 + "\n\n## Two\n\n- item **bold** `code` [link](u)\n" + "x" * 500 + "\n"
    found = chunks(body, 200)
    assert [c.index for c in found] == list(range(len(found))) and all(c.start_line <= c.end_line for c in found)
    assert all(a.start_line <= b.start_line for a, b in zip(found, found[1:], strict=False)) and all(len(c.plain_text) <= 200 for c in found)
    assert chunks("") == [] and chunks(" \n ") == []
    assert chunks("```\n# no heading\n" + "x\n" * 60 + "```\n# One\n" + "word " * 20, 160)[1].plain_text.startswith("One word")


@pytest.mark.parametrize(
    ("markdown", "seen"),
    [
        ("# A *b* <i>c</i> [d](e) `f` [[g|h]]", "A  b   c   d   h"),
        ("Title\n=====\n\n> quoted *words*\n> and more\n\n- one\n- two\n  still two\n\n1. three", "Title quoted  words and more one two still two three"),
        ("```rust\n# let x = **1**;\n```\nafter", "# let x = **1**; after"),
        ("- item\n\n  ~~~\n  a\n   b\n  ~~~\n\ntail", "item a  b tail"),
        ("a\n\n    indented *code*\n\nb", "a indented *code* b"),
        ("[x](<u v> \"ti)tle\") and ![alt](p(1).png) end", "x  and  alt  end"),
        ("[x][ref] [ref] [none]\n\n[ref]: http://a 'T'", "x   ref  [none]"),
        ("2 * 3 * 4, snake_case_name, **bold*", "2 * 3 * 4, snake_case_name,  * bold"),
        ("***both*** and **a *b* c**", "both  and  a  b  c"),
        ("\\*no\\* &amp; &lt; <https://a.b/c> x<br/>y", "*no* & <  https://a.b/c  x y"),
        ("<div>\nhidden\n</div>\n\nshown <!-- not --> this", "shown   this"),
        ("---\n***\nafter [[note]] ![[pic|a]]", "after note a"),
        ("`` a ` b `` c ` d", "c ` d"),
        ("", ""),
    ],
)
def test_visible_text(markdown, seen):
    assert plain_text(markdown).split() == seen.split()


def test_text_functions(spark):
    text = "see [[a]] and ![[b|c]]"
    assert strip_wikilinks(text) == "see a and c"
    row = spark.createDataFrame([(text, [1.0, 0.0], [0.0, 0.0], [2.0, 2.0])], "t string, a array<float>, z array<float>, b array<float>").select(wikilinks_stripped(F.col("t")).alias("t"), cosine_similarity(F.col("a"), F.col("b")).alias("c"), cosine_similarity(F.col("a"), F.col("z")).alias("z")).first()
    assert row.t == "see a and c" and abs(row.c - 0.5**0.5) < 1e-12 and row.z == 0.0
    a, b = MockEmbedder(7), MockEmbedder(7)
    assert np.array_equal(a.encode(["x"]), b.encode(["x"])) and a.encode(["x", "y"]).shape == (2, 7) and not np.array_equal(*a.encode(["x", "y"]))


def test_stream_keeps_index_up(spark, tmp_path):
    source, index = tmp_path / "in", Index(spark, f"file://{tmp_path}/index")
    config = cfg.Config(fields=[cfg.Field("n", "Integer")])
    schema = "path string, raw string, ts long"

    def send(*items):
        spark.createDataFrame(items, schema).coalesce(1).write.mode("append").parquet(str(source))
        keep_up(spark.readStream.schema(schema).parquet(str(source)), f"file://{tmp_path}/store", index, config, str(tmp_path / "check")).awaitTermination()

    send(("a.md", '{"n": 1}\nfirst', 1), ("b.md", '{"n": 2}\nsecond', 1))
    assert index.stats() == {"chunks": 2, "files_indexed": 2}
    send(("a.md", '{"n": 5}\nchanged', 2), ("b.md", None, 2), ("c.md", "third", 1))
    assert sorted((r.filepath, r.chunk_text) for r in index.rows().collect()) == [("a.md", "changed"), ("c.md", "third")]


def test_vector_lists(spark, tmp_path, monkeypatch):
    from vellumine.operators import ann, index
    from vellumine.operators.search import search, semantic_scores, top

    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    rows = spark.createDataFrame([(f"{i:05d}", [float(x) for x in centres[i % 20] + 0.3 * rng.normal(size=16)]) for i in range(2000)], "chunk_id string, embedding array<float>")
    path = f"file://{tmp_path}/lists"
    centroids = ann.fit_centroids(rows, 40, 2000)
    ann.write_lists(rows, path, centroids, 2000)
    assert spark.read.parquet(path).count() == 2000
    hits = wanted = 0
    for i in range(0, 2000, 50):
        query = list(rows.where(f"chunk_id = '{i:05d}'").first().embedding)
        exact = {r.chunk_id for r in top(semantic_scores(rows, query), 10).collect()}
        hits += len(exact & {r.chunk_id for r in ann.nearest(spark, path, centroids, query, 10, 8).collect()})
        wanted += 10
    assert hits / wanted >= 0.9
    plan = ann.probed(spark, path, centroids, query, 2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan or "PartitionFilters: [shard" in plan
    assert "In(list" in plan
    monkeypatch.setattr(ann, "FILE_BYTES", 4 * 16 * 300)
    ann.write_lists(rows, f"{path}-sharded", centroids, 2000)
    sharded = spark.read.parquet(f"{path}-sharded")
    assert sharded.count() == 2000 and 5 <= sharded.select("shard").distinct().count() <= 8
    both = [sorted(r.chunk_id for r in ann.probed(spark, x, centroids, query, 3).collect()) for x in (path, f"{path}-sharded")]
    assert both[0] == both[1]
    monkeypatch.setattr(index, "LEAST_VECTORS", 3)
    own = Index(spark, f"file://{tmp_path}/index")
    own.build(rows_of(spark, 12), cfg.Config())
    query = MockEmbedder().encode(["text number 3"])[0].tolist()
    found = search(own, "x", "semantic", None, 1, query, probes=3)[0].collect()
    assert found[0].filename == "3.md" and found[0].score > 0.999


def rows_of(spark, count):
    return documents(spark.createDataFrame([(f"{i}.md", f"text number {i}") for i in range(count)], "path string, raw string"))


def index_files(root):
    return {str(p.relative_to(root)): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def texts_of(spark, files):
    return documents(spark.createDataFrame(sorted(files.items()), "path string, raw string"))


def found_by(index, words):
    from vellumine.operators.search import search

    return [(r.filename, round(r.score, 9)) for r in search(index, words, "fulltext", limit=50)[0].collect()]


def test_a_build_rewrites_nothing_that_stays(spark, tmp_path):
    config, index = cfg.Config(fields=[cfg.Field("n", "Integer")]), Index(spark, f"file://{tmp_path}/a")
    files = {f"{i}.md": json.dumps({"n": i}) + f"\nnote {i} about the sea and word{i % 3}" for i in range(9)}
    index.build(texts_of(spark, files), config)
    before = index_files(tmp_path / "a")
    files |= {"new.md": '{"n": 1}\nthe new sea', "2.md": '{"n": 2}\nedited', "3.md": files["3.md"].replace("3}", "33}")}
    del files["4.md"]
    done = index.build(texts_of(spark, files), config)
    assert (done.new, done.edited, done.removed, done.unchanged, done.chunks_embedded, done.chunks_total) == (1, 1, 1, 7, 2, 9)
    after = index_files(tmp_path / "a")
    assert {k: after.get(k) for k in before} == before
    assert {r.filepath: r.data.n for r in index.rows().collect()}["3.md"] == 33

    def equals_a_new_one():
        other = Index(spark, f"file://{tmp_path}/b")
        other.build(texts_of(spark, files), config, force=True)
        key = lambda x: sorted((r.filepath, r.chunk_id, r.chunk_text, r.data.n) for r in x.rows().collect())
        assert key(index) == key(other) and index.stats() == other.stats()
        assert index.metadata()["mean_length"] == other.metadata()["mean_length"]
        assert all(found_by(index, x) == found_by(other, x) for x in ("sea", "edited word1", "new note about"))

    equals_a_new_one()
    first = files["2.md"]
    for text in ('{"n": 2}\nanother sea', first):  # there and back again
        files["2.md"] = text
        index.build(texts_of(spark, files), config)
    equals_a_new_one()


def test_segments_are_compacted(spark, tmp_path, monkeypatch):
    from vellumine.operators import index as module

    for name, value in (("MOST_SEGMENTS", 2), ("LEAST_VECTORS", 3), ("BUCKET_CHUNKS", 2)):
        monkeypatch.setattr(module, name, value)
    index, files = Index(spark, f"file://{tmp_path}/a"), {}
    for i in range(4):
        files[f"{i}.md"] = f"text number {i} of the sea"
        index.build(texts_of(spark, files), cfg.Config())
    meta = index.metadata()
    assert len(meta["segments"]) <= 2 and meta["chunks"] == 4 and index.rows().count() == 4
    assert [x for x, _ in found_by(index, "number 3")][0] == "3.md" and index.postings().where("term = 'sea'").count() == 4
    named = {x["name"] for x in meta["segments"]}
    assert named <= {p.name for p in (tmp_path / "a").iterdir()} and len(list((tmp_path / "a" / "log").glob("*.json"))) == 2


@pytest.mark.parametrize("step", ["files", "chunks", "postings", "log"])
def test_a_build_that_dies_changes_nothing(spark, tmp_path, monkeypatch, step):
    from vellumine.operators import index as module

    index = Index(spark, f"file://{tmp_path}/a")
    index.build(texts_of(spark, {"a.md": "first sea"}), cfg.Config())

    def die(*_, **__):
        raise RuntimeError("killed")

    with monkeypatch.context() as patch:
        if step == "postings":
            patch.setattr(module, "posting_rows", die)
        elif step == "log":
            patch.setattr(index.files, "create", die)
        else:
            write = index._write
            patch.setattr(index, "_write", lambda df, segment, name: die() if name == step else write(df, segment, name))
        with pytest.raises(RuntimeError, match="killed"):
            index.build(texts_of(spark, {"a.md": "second lake", "b.md": "third sea"}), cfg.Config())
    assert found_by(index, "sea lake")[0][0] == "a.md" and index.rows().count() == 1
    index.build(texts_of(spark, {"a.md": "second lake", "b.md": "third sea"}), cfg.Config())
    assert sorted(x for x, _ in found_by(index, "sea lake")) == ["a.md", "b.md"]
    assert len(index.files.names()) == 1 + len({x["name"] for v in index._versions() for x in json.loads(index.files.read(f"log/{v:010d}.json"))["segments"]})


def test_update_and_reinfer(vault, tmp_path):
    vault.init()
    write(tmp_path, "notes/more.md", "---\ntitle: T\nstatus: odd\nrating: 7\ndraft: true\npublished: 2024-01-01\ntags: [a]\nextra: 1.5\n---\nx")
    assert vault.update(dry_run=True).result["added"] == ["extra"] and "extra" not in {x.name for x in vault.config().fields}
    vault.update()
    assert {x.name: x.type for x in vault.config().fields}["extra"] == "Float"
    vault.update(["rating"], constraints="range")
    limits = {x.name: x.constraints for x in vault.config().fields}["rating"]
    assert (limits.min, limits.max) == (1, 7)
    vault.update(["status"], constraints="categories")
    assert {x.name: x.constraints for x in vault.config().fields}["status"].categories == ["active", "archived", "draft", "odd"]
    write(tmp_path, "notes/more.md", "---\ntitle: 5\n---\nx")
    assert "rating" in vault.update(everything=True).result["changed"]
    with pytest.raises(cfg.ConfigError):
        vault.update(["nothing"])
