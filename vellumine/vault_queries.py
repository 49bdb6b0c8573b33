"""Queries that reach formats, typing, validation, predicates, the index and retrieval, and their SQL.

``mixed`` projects the driver's documents to files with YAML, TOML or JSON
frontmatter, or none, by number; fields hold nested, null, array, date and
widening values. The same is spelled in SQL.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumine.functions.batches import small_batches
from vellumine.functions.globs import covered
from vellumine.functions.where import Names, WhereError, compile_where
from vellumine.operators.chunking import chunks, plain_text
from vellumine.operators.index import Index, IndexError_, chunks_of_removed, chunks_per, classified, embed_chunks
from vellumine.operators.search import search
from vellumine.plans import config as cfg
from vellumine.plans import jsonschema, validation
from vellumine.plans.config import Config, Constraints, EmbeddingModel, Field
from vellumine.plans.inference import COERCE, WIDEN, infer, prevalence
from vellumine.sources.frontmatter import documents, leaves, skipped
from vellumine.sources.listing import list_files
from vellumine.types import json_text, widen

Query = Callable[[SparkSession, str], DataFrame]
#: A chunk size that no text reaches, so that a document is one chunk.
WHOLE = 1 << 30


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(F.col("doc_id").alias("i"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("xx")).alias("lang"), F.coalesce("source", F.lit("src")).alias("source"), F.concat_ws("/", F.coalesce("source", F.lit("src")), F.coalesce("lang", F.lit("xx")), F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("path"))


_DOCS_SQL = "d AS (SELECT doc_id AS i, coalesce(text, '') AS text, coalesce(lang, 'xx') AS lang, coalesce(source, 'src') AS source, coalesce(source, 'src') || '/' || coalesce(lang, 'xx') || '/' || doc_id || '.md' AS path FROM documents)"
_LINE = r"' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _header() -> Column:
    i = F.col("i")
    day = F.concat(F.lit("2024-01-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"))
    due = F.when(i % 3 == 0, day).otherwise(F.concat(day, F.lit("T10:00:00Z")))
    rank = F.when(i % 2 == 0, (i % 200).cast("string")).otherwise(F.concat((i % 200).cast("string"), F.lit(".5")))
    sizes = F.format_string("[%s, %d]", F.when(i % 2 == 0, (i % 7).cast("string")).otherwise("0.5"), i % 3)
    flag = F.when(i % 5 == 0, "true").otherwise("false")
    note = i % 6 == 0
    yaml = F.concat(F.format_string("---\ntitle: Doc %d\nrank: %s\nday: %s\ndue: %s\ntags: [%s, %s]\nsizes: %s\nmeta:\n  lang: %s\n  deep:\n    n: %d\n", i, rank, day, due, "lang", "source", sizes, "lang", i), F.when(note, "note: null\n").otherwise(""), F.format_string("flag: %s\n---\n", flag))
    toml = F.format_string('+++\ntitle = "Doc %d"\nrank = %s\nday = %s\ndue = %s\ntags = ["%s", "%s"]\nsizes = %s\nflag = %s\n[meta]\nlang = "%s"\n[meta.deep]\nn = %d\n+++\n', i, rank, day, due, "lang", "source", sizes, flag, "lang", i)
    as_json = F.concat(F.format_string('{"title": "Doc %d", "rank": %s, "day": "%s", "due": "%s", "tags": ["%s", "%s"], "sizes": %s, "meta": {"lang": "%s", "deep": {"n": %d}}', i, rank, day, due, "lang", "source", sizes, "lang", i), F.when(note, ', "note": null').otherwise(""), F.format_string(', "flag": %s}\n', flag))
    return F.when(i % 4 == 0, yaml).when(i % 4 == 1, toml).when(i % 4 == 2, as_json).otherwise("")


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, raw) of files in three formats, and bare ones."""
    return _docs(spark, sf_dir).select("path", F.concat(_header(), F.lit("Text "), "text").alias("raw"))


_MIXED_SQL = f"""{_DOCS_SQL}, m AS (SELECT *, i % 4 AS kind, '2024-01-' || lpad(CAST(i % 28 + 1 AS VARCHAR), 2, '0') AS day, i % 200 || CASE WHEN i % 2 = 0 THEN '' ELSE '.5' END AS rank,
CASE WHEN i % 2 = 0 THEN '[' || i % 7 ELSE '[0.5' END || ',' || i % 3 || ']' AS sizes, i % 6 = 0 AND i % 4 IN (0, 2) AS noted FROM d),
f AS (SELECT * FROM m WHERE kind <> 3),
leaves AS (SELECT path, i, 'title' AS field, 'String' AS type, '"Doc ' || i || '"' AS value FROM f
UNION ALL SELECT path, i, 'rank', CASE WHEN i % 2 = 0 THEN 'Integer' ELSE 'Float' END, rank FROM f
UNION ALL SELECT path, i, 'day', 'Date', '"' || day || '"' FROM f
UNION ALL SELECT path, i, 'due', CASE WHEN i % 3 = 0 THEN 'Date' ELSE 'DateTime' END, '"' || day || CASE WHEN i % 3 = 0 THEN '' ELSE 'T10:00:00Z' END || '"' FROM f
UNION ALL SELECT path, i, 'tags', 'Array(String)', '["' || lang || '","' || source || '"]' FROM f
UNION ALL SELECT path, i, 'sizes', CASE WHEN i % 2 = 0 THEN 'Array(Integer)' ELSE 'Array(Float)' END, sizes FROM f
UNION ALL SELECT path, i, 'meta.lang', 'String', '"' || lang || '"' FROM f
UNION ALL SELECT path, i, 'meta.deep.n', 'Integer', CAST(i AS VARCHAR) FROM f
UNION ALL SELECT path, i, 'note', 'Null', 'null' FROM f WHERE noted
UNION ALL SELECT path, i, 'flag', 'Boolean', CASE WHEN i % 5 = 0 THEN 'true' ELSE 'false' END FROM f)"""


def _sql(rest: str) -> str:
    return f"WITH {_MIXED_SQL} {rest}"


# formats, typing and inference
def mixed_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves of all formats: nested names, arrays, nulls, dates, numbers."""
    return leaves(documents(mixed(spark, sf_dir), body=False)).select("path", "field", "type", "value")


def mixed_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that widen, nullability, observed types, and what preprocessing they need."""
    found = infer(documents(mixed(spark, sf_dir), body=False)).fields
    rows = [(x.name, x.type, x.nullable, x.files, json_text(x.observed), json_text(x.preprocess)) for x in found]
    return spark.createDataFrame(rows, "field string, type string, nullable boolean, files long, observed string, preprocess string")


def mixed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct values and occurrences; an array's elements are counted over distinct arrays."""
    found = infer(documents(mixed(spark, sf_dir), body=False)).fields
    return spark.createDataFrame([(x.name, x.n_distinct, x.occurrences) for x in found], "field string, n_distinct long, occurrences long")


def widening_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["Boolean", "Integer", "Float", "String", "Date", "DateTime"]
    kinds += [f"Array({x})" for x in kinds]
    return spark.createDataFrame([(a, b, widen(a, b)) for a in kinds for b in kinds], "a string, b string, wide string")


def arrays_of_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that hold objects inside arrays are left out, and told."""
    rows = _docs(spark, sf_dir).select("path", F.format_string('{"items": [{"n": %d}], "n": %d}', "i", "i").alias("raw"))
    found = infer(documents(rows, body=False))
    return spark.createDataFrame([(x, True) for x in found.dropped] + [(x.name, False) for x in found.fields], "field string, dropped boolean")


def body_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where bodies begin, and bare files among those with frontmatter."""
    found = documents(mixed(spark, sf_dir))
    return found.select("path", F.col("data").isNotNull().alias("has_data"), F.col("body_line_offset").cast("long").alias("body_line_offset"), F.length("content").cast("long").alias("length"))


def bare_files_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(mixed(spark, sf_dir), include_bare_files=False, body=False).select("path")


def forced_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = documents(mixed(spark, sf_dir), "yaml", body=False)
    return found.select("path", F.col("frontmatter_error").isNotNull().alias("mismatched"), F.col("data").isNotNull().alias("parsed"))


def torn_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose frontmatter can't be read, or is no mapping, as violations."""
    i = F.col("i")
    torn = F.when(i % 4 == 0, "---\na: [1\n---\n").when(i % 4 == 1, "+++\na = \n+++\n").when(i % 4 == 2, '{"a": ').otherwise("---\n- 1\n---\n")
    rows = _docs(spark, sf_dir).select("path", F.when(i % 3 == 0, torn).otherwise(_header()).alias("raw"))
    return validation.violations(documents(rows, body=False), Config()).select("field", "kind", "rule", "path", (F.length("detail") > 0).alias("explained"))


def skipped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are too deep or have too many fields are left out, with a reason."""
    i = F.col("i")
    deep = F.concat(F.repeat(F.lit('{"a":'), F.lit(60)), F.lit("1"), F.repeat(F.lit("}"), F.lit(60)))
    many = F.concat(F.lit("{"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(1000)), lambda x: F.concat(F.lit('"k'), x.cast("string"), F.lit('":1'))), ","), F.lit("}"))
    return skipped(_docs(spark, sf_dir).select("path", F.when(i % 10 == 0, deep).when(i % 10 == 5, many).otherwise(_header()).alias("raw")))


def listed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directory's files after ignore rules and a glob; names only, the files are empty."""
    root = os.path.join(_folder(spark), "listed")
    for r in _docs(spark, sf_dir).select("path").toLocalIterator():
        os.makedirs(os.path.dirname(os.path.join(root, r.path)), exist_ok=True)
        with open(os.path.join(root, r.path), "w", encoding="utf-8"):
            pass
    for name, text in ((".gitignore", "src2/\n*7.md\n!17.md\n"), (".vaultignore", "/src3/en\n"), ("notes.txt", "x")):
        with open(os.path.join(root, name), "w", encoding="utf-8") as file:
            file.write(text)
    return spark.createDataFrame([(x,) for x in list_files(root, "src[1-4]/**")], "path string")


def _folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; a local one only in local mode."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if given is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    base = (given or tempfile.gettempdir()).removeprefix("file://")
    return f"{base.rstrip('/')}/vellumine-{uuid.uuid4().hex}"


# validation
MIXED_RULES = Config(
    fields=[
        Field("title", constraints=Constraints(pattern="^Doc [0-9]*[05]$")),
        Field("rank", "Float", preprocess=[WIDEN], constraints=Constraints(max=100)),
        Field("sizes", "Array(Float)"),
        Field("due", "Date"),
        Field("tags", "Array(String)", constraints=Constraints(max_length=4)),
        Field("flag", "String", preprocess=[COERCE], constraints=Constraints(categories=["true"])),
        Field("note", "String", nullable=False),
        Field("day", "Integer", constraints=Constraints(min=1)),
        Field("meta.deep", "Integer"),
        Field("meta.lang", required=["src1/**"]),
    ]
)
_MIXED_VIOLATIONS = r"""SELECT 'title' AS field, 'WrongType' AS kind, 'pattern ^Doc [0-9]*[05]$' AS rule, path, 'got "Doc ' || i || '"' AS detail FROM f WHERE i % 5 <> 0
UNION ALL SELECT 'rank', 'OutOfRange', 'maximum 100', path, 'got ' || i % 200 || CASE WHEN i % 2 = 0 THEN '.0' ELSE '.5' END FROM f WHERE i % 200 > 100
UNION ALL SELECT 'sizes', 'WrongType', 'type Array(Float)', path, 'got Integer at index ' || i % 2 FROM f
UNION ALL SELECT 'due', 'WrongType', 'format date', path, 'got "' || day || 'T10:00:00Z"' FROM f WHERE i % 3 <> 0
UNION ALL SELECT 'tags', 'OutOfRange', 'maxLength 4', path, 'got "' || tag || '"' FROM (SELECT path, unnest([lang, source]) AS tag FROM f) WHERE length(tag) > 4
UNION ALL SELECT 'flag', 'InvalidCategory', 'enum ["true",null]', path, 'got "false"' FROM f WHERE i % 5 <> 0
UNION ALL SELECT 'note', 'NullNotAllowed', 'not nullable', path, NULL FROM f WHERE noted
UNION ALL SELECT 'day', 'WrongType', 'type Integer', path, 'got Date' FROM f
UNION ALL SELECT 'meta.deep', 'WrongType', 'type Integer', path, 'got Object' FROM f
UNION ALL SELECT 'meta.lang', 'MissingRequired', 'required in ["src1/**"]', path, NULL FROM m WHERE kind = 3 AND source = 'src1'"""


def _mixed_violations(*kinds: str, config: Callable[[], Config] = lambda: MIXED_RULES) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = validation.violations(documents(mixed(spark, sf_dir), body=False), config())
        return found.where(F.col("field").isin(*kinds)) if kinds else found

    return query


def _through_schema(form: str) -> Config:
    """The rules after a way through an exported JSON Schema."""
    text = jsonschema.export_schema(MIXED_RULES, form)
    with tempfile.TemporaryDirectory() as folder:  # read on the driver alone
        path = os.path.join(folder, f"schema.{form}")
        with open(path, "w", encoding="utf-8") as file:
            file.write(text)
        return jsonschema.from_json_schema(jsonschema.load_schema(path))[0]


def mixed_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups in the report's order, with their number and first three files."""
    found = validation.report(validation.violations(documents(mixed(spark, sf_dir), body=False), MIXED_RULES), 3)
    return found.select("field", "kind", "rule", "n", F.array_join(F.transform("files", lambda x: x["path"]), " ").alias("first"))


# changes of a schema
_DECLARED = Config(fields=[Field("title", "String", nullable=False), Field("rank", "Integer", nullable=False), Field("gone", "String")], ignore=["flag"])


def schema_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What inferring anew would add, change, remove and leave."""
    diff = cfg.schema_diff(_DECLARED, infer(documents(mixed(spark, sf_dir).where(F.substring("raw", 1, 5) != "Text "), body=False)))
    rows = [(name, kind, json_text(sorted(diff["changed"][name])) if kind == "changed" else None) for kind in ("added", "changed", "removed", "unchanged") for name in diff[kind]]
    return spark.createDataFrame(rows, "field string, change string, parts string")


def fields_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inferred fields that are neither declared nor ignored, without constraints."""
    config = Config(fields=list(_DECLARED.fields), ignore=list(_DECLARED.ignore))
    names = cfg.add_new_fields(config, infer(documents(mixed(spark, sf_dir), body=False)))
    by = {x.name: x for x in config.fields}
    return spark.createDataFrame([(x, by[x].type, by[x].constraints is not None) for x in names], "field string, type string, constrained boolean")


def forced_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct values of fields that are declared categorical by force."""
    names = ["meta.deep.n", "title", "tags"]
    found = infer(documents(mixed(spark, sf_dir), body=False), every=names)
    again = cfg.reinfer(Config(fields=[Field(x) for x in names]), found, names, "categories")
    return spark.createDataFrame([(x.name, len(x.constraints.categories), str(max(x.constraints.categories))) for x in again.fields], "field string, n long, greatest string")


def field_prevalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files have each key at the top."""
    return prevalence(documents(mixed(spark, sf_dir), body=False))


def name_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x, len(cfg.name_hints(x))) for x in ("plain", "a b", "it's", 'x"y', "it's \"a b\"")], "field string, hints long")


def glob_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [("blog/x/**", "blog/**"), ("blog/**", "blog/x/**"), ("*", "**"), ("notes/**", "blog/**"), ("a/*", "a/*"), ("a/b/*", "a/*"), ("**", "*")]
    return spark.createDataFrame([(a, b, covered(a, [b])) for a, b in pairs], "required string, allowed string, covered boolean")


# predicates
_FIELDS = {"order state": "String", "content_hash": "String", "price": "Float", "date": "Date", "urgent": "Boolean", "scores": "Array(Float)", "parts": "Array(Integer)", "filepath": "String"}


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with index columns, some of which their fields are named like."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    key = F.col("o_orderkey")
    urgent = F.when(key % 4 != 0, F.col("o_orderpriority") == "1-URGENT")
    parts = F.array((key % 10).cast("long"), F.when(key % 3 != 0, key % 7).cast("long"))
    data = F.struct(F.col("o_orderstatus").alias("order state"), F.concat(F.lit("own-"), "o_orderstatus").alias("content_hash"), F.col("o_totalprice").alias("price"), F.to_date("o_orderdate").alias("date"), urgent.alias("urgent"), F.array(F.lit(0.5)).alias("scores"), parts.alias("parts"), F.lit("field").alias("filepath"))
    return o.select(key.alias("id"), F.concat(F.lit("h"), key.cast("string")).alias("content_hash"), F.concat(F.lit("p/"), key.cast("string")).alias("filepath"), data.alias("data"))


_ORDERED_SQL = "SELECT o_orderkey AS id, 'h' || o_orderkey AS content_hash, o_orderstatus AS state, o_totalprice AS price, CAST(o_orderdate AS DATE) AS day, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority = '1-URGENT' END AS urgent, [o_orderkey % 10, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 7 END] AS parts FROM orders"
#: name: (clause, options of names, condition in SQL)
WHERE = {
    "where_prefix": ("content_hash = 'own-F' AND _content_hash LIKE 'h1%'", {"internal_prefix": "_"}, "state = 'F' AND content_hash LIKE 'h1%'"),
    "where_alias": ("digest LIKE 'h2%' AND content_hash <> 'own-O'", {"aliases": {"content_hash": "digest", "filepath": "place"}}, "content_hash LIKE 'h2%' AND state <> 'O'"),
    "where_quoted_name": ("\"order state\" = 'F' AND data.\"order state\" <> 'it''s'", {"internal_prefix": "_"}, "state = 'F'"),
    "where_keyword_name": ("date >= DATE '1996-01-01' AND EXTRACT(year FROM date) < 1998", {"internal_prefix": "_"}, "day >= DATE '1996-01-01' AND extract(year FROM day) < 1998"),
    "where_truth": ("urgent IS TRUE OR urgent IS UNKNOWN AND price > 200000", {"internal_prefix": "_"}, "urgent IS TRUE OR urgent IS NULL AND price > 200000"),
    "where_not_truth": ("urgent IS NOT FALSE AND NOT urgent IS NULL", {"internal_prefix": "_"}, "urgent IS NOT FALSE AND urgent IS NOT NULL"),
    "where_case": ("CASE WHEN price > 200000 THEN 'dear' WHEN urgent THEN 'now' ELSE 'other' END <> 'other'", {"internal_prefix": "_"}, "CASE WHEN price > 200000 THEN 'dear' WHEN urgent THEN 'now' ELSE 'other' END <> 'other'"),
    "where_array_has": ("array_has(parts, 3) OR NOT array_has(parts, 5) AND price < 3000", {"internal_prefix": "_"}, "list_contains(parts, 3) OR NOT list_contains(parts, 5) AND price < 3000"),
    "where_string_literal_dates": ("date BETWEEN '1995-03-01' AND '1995-03-31'", {"internal_prefix": "_"}, "day BETWEEN DATE '1995-03-01' AND DATE '1995-03-31'"),
    "where_concat": ("\"order state\" || 'x' = 'Px' AND price % 2 >= 1", {"internal_prefix": "_"}, "state || 'x' = 'Px' AND price % 2 >= 1"),
}


def _where(clause: str, options: dict) -> Query:
    return lambda spark, sf_dir: _ordered(spark, sf_dir).where(compile_where(clause, Names(_FIELDS, **options)).column).select("id")


def where_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank clause filters nothing."""
    rows = _ordered(spark, sf_dir)
    column = compile_where(" \n ", Names(_FIELDS)).column
    return (rows if column is None else rows.where(column)).select("id")


def where_refused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses that are refused: a clash of names, float arrays, torn quotes, more than one statement."""

    def refused(clause: str, **options) -> bool:
        try:
            compile_where(clause, Names(_FIELDS, **options))
        except WhereError:
            return True
        return False

    clauses = {"collision": ("content_hash = 'x'", {}), "no collision": ("content_hash = 'x'", {"internal_prefix": "_"}), "float array": ("scores = 0.5", {}), "float array, not strict": ("scores = 0.5", {"strict": False}), "torn quote": ("date = 'x", {}), "statements": ("price = 1; DROP TABLE x", {}), "unknown": ("nothing = 1", {})}
    return spark.createDataFrame([(name, refused(clause, **options)) for name, (clause, options) in clauses.items()], "what string, refused boolean")


def where_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How rewritten parts of a clause were read."""
    found = compile_where("parts IN (1, 2) AND parts <> 3 AND price > 5", Names(_FIELDS)).notes
    return spark.createDataFrame(found, "written string, read_as string")


# chunks
def visible_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markdown's marks, code spans, HTML and link targets go, also around whole words of each text."""
    import pandas as pd

    words = F.array_join(F.regexp_extract_all("text", F.lit("([A-Za-z]+)"), 1), " ")
    markdown = F.concat(F.lit("# *"), "lang", F.lit("*\n\n> [**"), "source", F.lit('**](http://x.y "t") `gone` <b>bold</b> [[to|shown]]\n\n```\n'), words, F.lit("\n```\n\n<div>\nhidden\n</div>\n\n- end"))

    def step(batches):
        for batch in batches:
            yield pd.DataFrame({"i": batch["i"], "seen": [" ".join(plain_text(x).split()) for x in batch["markdown"]]})

    small_batches(spark)
    return _docs(spark, sf_dir).select("i", markdown.alias("markdown")).mapInPandas(step, "i long, seen string")


def chunk_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections become chunks with their lines; a fence's marks begin none."""
    import pandas as pd

    words = F.repeat(F.concat("source", F.lit(" ")), F.lit(20))
    fenced = F.concat(F.lit("```\n# no heading\n"), words, F.lit("\n```"))
    body = F.concat(F.lit("# One\n\n"), words, F.lit("\n\n## Two\n\n"), fenced, F.lit("\n\n# Three\n\n"), words, F.lit("\n"))

    def step(batches):
        for batch in batches:
            rows = [(i, c.index, c.start_line, c.end_line, c.plain_text.split()[0]) for i, text in zip(batch["i"], batch["body"], strict=True) for c in chunks(text, 20 * len(text.split("\n")[2].split()[0]) + 60)]
            yield pd.DataFrame(rows, columns=["i", "chunk", "first_line", "last_line", "first_word"])

    small_batches(spark)
    return _docs(spark, sf_dir).select("i", body.alias("body")).mapInPandas(step, "i long, chunk long, first_line long, last_line long, first_word string")


def _plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of letters, digits and blanks, with JSON frontmatter."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def step(batches):
        for batch in batches:  # RE2, as in SQL; the JVM takes ten times as long for this pattern
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pc.replace_substring_regex(batch.columns[-1], "[^A-Za-z0-9 \n]", " ")], batch.schema.names)

    small_batches(spark)
    d = _docs(spark, sf_dir).select("i", "lang", "source", "path", "text").mapInArrow(step, "i long, lang string, source string, path string, text string")
    front = F.format_string('{"lang": "%s", "source": "%s", "number": %d}\n\n', "lang", "source", "i")
    return documents(d.select("path", F.concat(front, "text").alias("raw")))


_PLAIN_SQL = f"{_DOCS_SQL}, p AS (SELECT i, lang, source, path, regexp_replace(text, '[^A-Za-z0-9 \n]', ' ', 'g') AS body FROM d), q AS (SELECT *, trim(body, {_LINE}) AS content FROM p)"
_PLAIN_FIELDS = {"lang": "String", "source": "String", "number": "Integer"}
_PLAIN_CONFIG = Config(fields=[Field(k, v) for k, v in _PLAIN_FIELDS.items()], embedding_model=EmbeddingModel("mock", "mock-8"), max_chunk_size=WHOLE)


def _embedded(docs: DataFrame) -> DataFrame:
    return embed_chunks(docs.withColumn("file_id", F.lit(None).cast("string")), EmbeddingModel("mock", "mock-8"), WHOLE, _PLAIN_FIELDS)


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks and files by source, counted by the index's own function."""
    rows = _embedded(_plain(spark, sf_dir)).withColumn("source", F.col("data.source"))
    return chunks_per(rows, "source")


def removed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that go with files that are gone."""
    docs = _plain(spark, sf_dir)
    table = f"file://{_folder(spark)}/held"  # written once, as chunks are made anew each time that a plan reads them
    _embedded(docs).select("filepath", "file_id", "content_hash").write.parquet(table)
    held = spark.read.schema("filepath string, file_id string, content_hash string").parquet(table)
    now = docs.where(~F.col("path").rlike("[05].md$")).select("path", F.lit("any").alias("hash"))
    gone = chunks_of_removed(held, classified(now, held.distinct()))
    return gone.join(held.select("file_id", "filepath").distinct(), "file_id").select("filepath", "chunks")


# the index
def _built(spark: SparkSession, docs: DataFrame) -> Index:
    index = Index(spark, f"file://{_folder(spark)}")
    index.build(docs, _PLAIN_CONFIG)
    return index


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that is written and read back: lines, metadata, and vectors of a dimension."""
    rows = _built(spark, _plain(spark, sf_dir)).rows()
    return rows.select("filepath", "chunk_index", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "data.lang", F.col("data.number").alias("number"), F.size("embedding").cast("long").alias("dimension"), F.length("chunk_text").cast("long").alias("length"))


def index_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are new, edited, removed and refreshed become a segment; its result as a table."""
    docs, number = _plain(spark, sf_dir), F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long")
    before = docs.where(number % 5 != 0).withColumn("content", F.when(number % 7 == 0, F.concat("content", F.lit(" before"))).otherwise(F.col("content")))
    before = before.withColumn("data", F.when(number % 9 == 0, F.regexp_replace("data", '"number":', '"number":1')).otherwise(F.col("data")))
    index = _built(spark, before)
    index.build(docs.where(number % 11 != 0), _PLAIN_CONFIG)
    return index.rows().select("filepath", F.col("data.number").alias("number"), F.length("chunk_text").cast("long").alias("length"))


def index_build_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, number = _plain(spark, sf_dir), F.regexp_extract("path", r"(\d+)\.md$", 1).cast("long")
    index = _built(spark, docs.where(number % 5 != 0).withColumn("content", F.when(number % 7 == 0, F.concat("content", F.lit(" before"))).otherwise(F.col("content"))))
    done = index.build(docs.where(number % 11 != 0), _PLAIN_CONFIG)
    again = index.build(docs.where(number % 11 != 0), _PLAIN_CONFIG)
    rows = [(done.new, done.edited, done.unchanged, done.removed, done.chunks_total, again.chunks_embedded, again.snapshot == done.snapshot)]
    return spark.createDataFrame(rows, "new long, edited long, unchanged long, removed long, chunks long, embedded_again long, same_snapshot boolean")


def index_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stops a build or a search: settings that drifted, other dimensions, no index."""
    docs = _plain(spark, sf_dir)
    index = _built(spark, docs)

    def stops(run) -> bool:
        try:
            run()
        except (IndexError_, ValueError):
            return True
        return False

    def changed(**settings) -> Config:
        return Config(**{**_PLAIN_CONFIG.__dict__, **settings})

    found = {
        "same settings": stops(lambda: index.build(docs, _PLAIN_CONFIG)),
        "chunk size": stops(lambda: index.build(docs, changed(max_chunk_size=7))),
        "model": stops(lambda: index.build(docs, changed(embedding_model=EmbeddingModel("mock", "mock-16")))),
        "fields": stops(lambda: index.build(docs, changed(fields=[Field("lang")]))),
        "no index": stops(lambda: search(Index(spark, f"file://{_folder(spark)}"), "x", "fulltext")),
        "unknown mode": stops(lambda: search(index, "x", "guess")),
        "hybrid without a limit of legs": stops(lambda: search(index, "x", "hybrid", query=[0.1] * 8, overfetch=None)),
    }
    return spark.createDataFrame(list(found.items()), "guard string, stops boolean")


def _found(where: str | None, limit: int, overfetch: int | None = 3) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        hits, _ = search(_built(spark, _plain(spark, sf_dir)), "the of license", "fulltext", where, limit, overfetch=overfetch)
        return hits.select("filename", F.round("score", 6).alias("score"), F.col("start_line").cast("long").alias("start_line"), F.length("chunk_text").cast("long").alias("length"))

    return query


def search_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document found by its own vector and words, in each mode; limit 0 finds nothing."""
    from vellumine.operators.embedding import load_embedder

    index = _built(spark, _plain(spark, sf_dir))
    row = index.rows().where("length(chunk_text) > 40").orderBy("filepath").first()
    query = load_embedder(_PLAIN_CONFIG.embedding_model).encode([row.chunk_text])[0].tolist()
    out = []
    for mode in ("semantic", "fulltext", "hybrid"):
        clause = f"number = {row.data.number}"
        (hit,) = search(index, row.chunk_text, mode, clause, 3, query)[0].collect()
        out.append((mode, hit.filename == row.filepath, hit.chunk_text == row.chunk_text, search(index, row.chunk_text, mode, None, 0, query)[0].count() == 0))
    return spark.createDataFrame(out, "mode string, found boolean, same_text boolean, none_at_0 boolean")


def queries() -> dict[str, Query]:
    plain = [mixed_leaves, mixed_types, mixed_values, widening_matrix, arrays_of_objects, body_offsets, bare_files_left_out, forced_format, torn_frontmatter, skipped_documents, listed_files, mixed_report, schema_changes, fields_added, forced_categories, field_prevalence, name_hints, glob_coverage, where_empty, where_refused, where_notes, visible_text, chunk_lines, index_stats, removed_chunks, index_rows, index_incremental, index_build_counts, index_guards, search_modes]
    found: dict[str, Query] = {x.__name__: x for x in plain}
    found |= {"mixed_violations": _mixed_violations(), "coerced_and_widened": _mixed_violations("rank", "flag"), "strict_floats": _mixed_violations("sizes"), "date_formats": _mixed_violations("due"), "type_hides_others": _mixed_violations("day"), "dotted_fields": _mixed_violations("meta.deep", "meta.lang")}
    found |= {"violations_by_json_schema": _mixed_violations(config=lambda: _through_schema("json")), "violations_by_toml_schema": _mixed_violations(config=lambda: _through_schema("toml")), "violations_by_config_file": _mixed_violations(config=lambda: cfg.parse_config(cfg.config_text(MIXED_RULES)))}
    found |= {name: _where(clause, options) for name, (clause, options, _) in WHERE.items()}
    return found | {"index_fulltext": _found(None, 20), "index_fulltext_filtered": _found("lang = 'en' AND number % 2 = 0", 10), "index_fulltext_exact": _found("source IN ('src1', 'src2')", 15, None)}


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) t({names})"


_LINES = "length({0}) - length(replace({0}, chr(10), '')) + CASE WHEN {0} = '' OR {0} LIKE '%' || chr(10) THEN 0 ELSE 1 END"


def _bm25(condition: str, limit: int) -> str:
    return f"""WITH {_PLAIN_SQL}, w AS (SELECT path, i, lang, source, content, list_filter(string_split_regex(lower(content), '[^a-z0-9]+'), lambda x: x <> '') AS words FROM q WHERE content <> ''),
    n AS (SELECT count(*) AS n, sum(len(words)) / count(*) AS mean FROM w),
    t AS (SELECT path, term, len(list_filter(words, lambda x: x = term)) AS tf, len(words) AS length FROM w, (VALUES ('the'), ('of'), ('license')) k(term)),
    g AS (SELECT term, count(*) AS df FROM t WHERE tf > 0 GROUP BY term),
    s AS (SELECT path, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))) AS score FROM t JOIN g USING (term), n WHERE tf > 0 GROUP BY path)
    SELECT path AS filename, round(score, 6) AS score, 3 AS start_line, length(regexp_replace(content, '[ \n]*\n[ \n]*', ' ', 'g')) AS length FROM s JOIN w USING (path) WHERE {condition} ORDER BY s.score DESC, path LIMIT {limit}"""


def oracle_sql() -> dict[str, str]:
    files = "(SELECT count(*) FROM f)"
    violations = lambda *fields: _sql(f"SELECT * FROM ({_MIXED_VIOLATIONS})" + (f" WHERE field IN ({', '.join(repr(x) for x in fields)})" if fields else ""))
    kinds = {"title": ("String", '["String"]', "[]"), "rank": ("Float", '["Float","Integer"]', '["widen-int-to-float"]'), "day": ("Date", '["Date"]', "[]"), "due": ("String", '["Date","DateTime"]', '["coerce-to-string"]'), "tags": ("Array(String)", '["Array(String)"]', "[]"), "sizes": ("Array(Float)", '["Array(Float)","Array(Integer)"]', '["widen-int-to-float"]'), "meta.lang": ("String", '["String"]', "[]"), "meta.deep.n": ("Integer", '["Integer"]', "[]"), "note": ("String", "[]", "[]"), "flag": ("Boolean", '["Boolean"]', "[]")}
    types = " UNION ALL ".join(f"SELECT '{k}' AS field, '{t}' AS type, {str(k == 'note').upper()} AS nullable, {'(SELECT count(*) FROM f WHERE noted)' if k == 'note' else files} AS files, '{o}' AS observed, '{p}' AS preprocess" for k, (t, o, p) in kinds.items())
    found = {
        "mixed_leaves": _sql("SELECT path, field, type, value FROM leaves"),
        "mixed_types": _sql(types),
        "mixed_values": _sql("""SELECT field, count(*) AS n_distinct, CAST(sum(n) AS BIGINT) AS occurrences FROM (SELECT field, value, count(*) AS n FROM leaves WHERE field NOT IN ('tags', 'sizes', 'note') GROUP BY ALL) GROUP BY field
            UNION ALL SELECT field, count(DISTINCT x), count(*) FROM (SELECT field, unnest(CAST(json_extract_string(value, '$[*]') AS VARCHAR[])) AS x FROM (SELECT DISTINCT field, value FROM leaves WHERE field IN ('tags', 'sizes'))) GROUP BY field
            UNION ALL SELECT 'note', 0, 0 WHERE EXISTS (SELECT 1 FROM f WHERE noted)"""),
        "widening_matrix": """WITH s AS (SELECT unnest(['Boolean', 'Integer', 'Float', 'String', 'Date', 'DateTime']) AS x), k AS (SELECT x AS name, x, FALSE AS a FROM s UNION ALL SELECT 'Array(' || x || ')', x, TRUE FROM s),
            w AS (SELECT p.name AS a, q.name AS b, p.a AS pa, q.a AS qa, CASE WHEN p.x = q.x THEN p.x WHEN p.x IN ('Integer', 'Float') AND q.x IN ('Integer', 'Float') THEN 'Float' ELSE 'String' END AS x FROM k p, k q)
            SELECT a, b, CASE WHEN pa AND qa THEN 'Array(' || x || ')' WHEN pa <> qa THEN 'String' ELSE x END AS wide FROM w""",
        "arrays_of_objects": _values([("items", True), ("n", False)], "field, dropped"),
        "body_offsets": f"WITH {_MIXED_SQL}, b AS (SELECT *, 'Text ' || text AS body FROM m), c AS (SELECT *, trim(body, {_LINE}) AS content FROM b) SELECT path, kind <> 3 AS has_data, CASE kind WHEN 0 THEN 13 + CAST(noted AS INTEGER) WHEN 1 THEN 13 WHEN 2 THEN 1 ELSE 0 END + {_LINES.format('body')} - ({_LINES.format('content')}) AS body_line_offset, length(content) AS length FROM c",
        "bare_files_left_out": _sql("SELECT path FROM f"),
        "forced_format": _sql("SELECT path, kind IN (1, 2) AS mismatched, kind = 0 AS parsed FROM m"),
        "torn_frontmatter": _sql("SELECT '<frontmatter>' AS field, 'FrontmatterUnrepresentable' AS kind, 'frontmatter must be representable as JSON' AS rule, path, TRUE AS explained FROM m WHERE i % 3 = 0"),
        "skipped_documents": _sql("SELECT path, CASE i % 10 WHEN 0 THEN 'nested deeper than 50' ELSE 'more than 1000 fields' END AS reason FROM m WHERE i % 10 IN (0, 5)"),
        "listed_files": _sql("SELECT path FROM m WHERE source IN ('src1', 'src3', 'src4') AND (i % 10 <> 7 OR i = 17) AND NOT (source = 'src3' AND lang = 'en')"),
        "mixed_report": _sql(f"SELECT field, kind, rule, count(*) AS n, array_to_string((list(path ORDER BY path, detail))[1:3], ' ') AS first FROM ({_MIXED_VIOLATIONS}) GROUP BY field, kind, rule"),
        "schema_changes": _values([("rank", "changed", '["required","type"]'), ("title", "changed", '["required"]'), ("gone", "removed", None), *((x, "added", None) for x in ("day", "due", "meta.deep.n", "meta.lang", "note", "sizes", "tags"))], "field, change, parts"),
        "fields_added": _values([(k, kinds[k][0], False) for k in ("day", "due", "meta.deep.n", "meta.lang", "note", "sizes", "tags")], "field, type, constrained"),
        "forced_categories": _sql("SELECT 'meta.deep.n' AS field, count(*) AS n, CAST(max(i) AS VARCHAR) AS greatest FROM f UNION ALL SELECT 'title', count(*), max('Doc ' || i) FROM f UNION ALL SELECT 'tags', count(DISTINCT t), max(t) FROM (SELECT unnest([lang, source]) AS t FROM f)"),
        "field_prevalence": _sql("SELECT split_part(field, '.', 1) AS field, count(DISTINCT path) AS files FROM leaves GROUP BY ALL"),
        "name_hints": _values([("plain", 0), ("a b", 1), ("it's", 1), ('x"y', 1), ("it's \"a b\"", 3)], "field, hints"),
        "glob_coverage": _values([("blog/x/**", "blog/**", True), ("blog/**", "blog/x/**", False), ("*", "**", True), ("notes/**", "blog/**", False), ("a/*", "a/*", True), ("a/b/*", "a/*", True), ("**", "*", False)], "required, allowed, covered"),
        "where_empty": "SELECT o_orderkey AS id FROM orders",
        "where_refused": _values([("collision", True), ("no collision", False), ("float array", True), ("float array, not strict", False), ("torn quote", True), ("statements", True), ("unknown", True)], "what, refused"),
        "where_notes": _values([("data.parts IN (1, 2)", "array_has(data.parts, 1) OR array_has(data.parts, 2)"), ("data.parts <> 3", "NOT array_has(data.parts, 3)")], "written, read_as"),
        "visible_text": f"WITH {_DOCS_SQL} SELECT i, trim(regexp_replace(lang || ' ' || source || ' bold shown ' || array_to_string(regexp_extract_all(text, '[A-Za-z]+'), ' ') || ' end', ' +', ' ', 'g')) AS seen FROM d",
        "chunk_lines": f"WITH {_DOCS_SQL} SELECT i, chunk, first_line, last_line, first_word FROM d, (VALUES (0, 1, 3, 'One'), (1, 5, 10, 'Two'), (2, 12, 14, 'Three')) c(chunk, first_line, last_line, first_word)",
        "index_stats": f"WITH {_PLAIN_SQL} SELECT source, count(*) AS chunks, count(*) AS files FROM q WHERE content <> '' GROUP BY source",
        "removed_chunks": f"WITH {_PLAIN_SQL} SELECT path AS filepath, 1 AS chunks FROM q WHERE content <> '' AND i % 5 = 0",
        "index_rows": f"WITH {_PLAIN_SQL} SELECT path AS filepath, 0 AS chunk_index, 2 + {_LINES.format('body')} - ({_LINES.format('content')}) + 1 AS start_line, 2 + {_LINES.format('body')} AS end_line, lang, i AS number, 8 AS dimension, length(regexp_replace(content, '[ \n]*\n[ \n]*', ' ', 'g')) AS length FROM q WHERE content <> ''",
        "index_incremental": f"WITH {_PLAIN_SQL} SELECT path AS filepath, i AS number, length(regexp_replace(content, '[ \n]*\n[ \n]*', ' ', 'g')) AS length FROM q WHERE content <> '' AND i % 11 <> 0",
        "index_build_counts": f"WITH {_PLAIN_SQL} SELECT count(*) FILTER (i % 11 <> 0 AND i % 5 = 0) AS new, count(*) FILTER (i % 11 <> 0 AND i % 5 <> 0 AND i % 7 = 0) AS edited, count(*) FILTER (i % 11 <> 0 AND i % 5 <> 0 AND i % 7 <> 0) AS unchanged, count(*) FILTER (i % 11 = 0 AND i % 5 <> 0) AS removed, count(*) FILTER (i % 11 <> 0 AND content <> '') AS chunks, 0 AS embedded_again, TRUE AS same_snapshot FROM q",
        "index_guards": _values([("same settings", False), ("chunk size", True), ("model", True), ("fields", True), ("no index", True), ("unknown mode", True), ("hybrid without a limit of legs", True)], "guard, stops"),
        "search_modes": _values([(x, True, True, True) for x in ("semantic", "fulltext", "hybrid")], "mode, found, same_text, none_at_0"),
        "mixed_violations": violations(),
        "coerced_and_widened": violations("rank", "flag"),
        "strict_floats": violations("sizes"),
        "date_formats": violations("due"),
        "type_hides_others": violations("day"),
        "dotted_fields": violations("meta.deep", "meta.lang"),
        "index_fulltext": _bm25("TRUE", 20),
        "index_fulltext_filtered": _bm25("lang = 'en' AND i % 2 = 0", 10),
        "index_fulltext_exact": _bm25("source IN ('src1', 'src2')", 15),
    }
    found |= dict.fromkeys(("violations_by_json_schema", "violations_by_toml_schema", "violations_by_config_file"), violations())
    return found | {name: f"SELECT id FROM ({_ORDERED_SQL}) WHERE {condition}" for name, (_, _, condition) in WHERE.items()}
