"""Validation of documents against declared fields, in one pass over them.

Declared fields become a small broadcast table of rules. A document becomes one
item per leaf and one of its own; each item meets its rule by an equality join,
and all its problems are one expression over the item and the rule, so documents
are parsed and read once. Globs and patterns are literals of the plan: a
document is told once which sets of globs it lies in, and a rule names its set
by number.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellumine.functions.globs import path_in
from vellumine.plans.config import Config, Field
from vellumine.plans.inference import COERCE, WIDEN
from vellumine.sources.frontmatter import leaves
from vellumine.types import element, json_text

#: In the order in which reports list them.
KINDS = ("MissingRequired", "WrongType", "Disallowed", "NullNotAllowed", "InvalidCategory", "OutOfRange", "FrontmatterUnrepresentable")
FRONTMATTER = "<frontmatter>"
#: Files of a group that a report lists.
SHOWN_FILES = 100
#: Parts that a report deals the files of a group to.
REPORT_PARTS = 256
VIOLATION = "field string, kind string, rule string, path string, detail string"
_PROBLEM = "struct<field: string, kind: string, rule: string, detail: string>"
_RULE = "field string, type string, base string, is_array boolean, nullable boolean, coerce boolean, widen boolean, place int, allowed_rule string, options array<string>, enum_rule string, lo double, lo_rule string, hi double, hi_rule string, min_length int, max_length int, pattern string, pattern_number int"
_NUMBERS = ("Integer", "Float")
_STRINGS = ("String", "Date", "DateTime")
_DATE_TIME = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?(Z|[+-]([01]\d|2[0-3]):[0-5]\d)$"


def _rule(x: Field, places: list[tuple[str, ...]], patterns: list[str]) -> tuple:
    base, limits = element(x.type) or x.type, x.constraints.given() if x.constraints else {}
    options, pattern = limits.get("categories"), limits.get("pattern")
    shown = None if options is None else [*options, *([None] if x.nullable and element(x.type) is None else [])]
    number = lambda k: None if k not in limits else float(limits[k])
    return (
        x.name, x.type, base, element(x.type) is not None, x.nullable, COERCE in x.preprocess, WIDEN in x.preprocess,
        places.index(tuple(x.allowed)), f"allowed in {json.dumps(x.allowed, ensure_ascii=False)}",
        None if options is None else [json_text(v) for v in options], None if shown is None else f"enum {json_text(shown)}",
        number("min"), f"minimum {json_text(limits.get('min'))}", number("max"), f"maximum {json_text(limits.get('max'))}",
        limits.get("min_length"), limits.get("max_length"), pattern, None if pattern is None else patterns.index(pattern),
    )


def _places(config: Config) -> list[tuple[str, ...]]:
    """The distinct lists of globs that fields are allowed in."""
    return sorted({tuple(x.allowed) for x in config.fields})


def _patterns(config: Config) -> list[str]:
    return sorted({x.constraints.pattern for x in config.fields if x.constraints is not None and x.constraints.pattern is not None})


def rules(spark: SparkSession, config: Config) -> DataFrame:
    """A row per declared field; as large as the configuration file."""
    places, patterns = _places(config), _patterns(config)
    return spark.createDataFrame([_rule(x, places, patterns) for x in config.fields], _RULE)


def _problem(when: Column, kind: str, rule: Column, detail: Column, is_type: bool) -> Column:
    return F.when(when, F.struct(F.lit(kind).alias("kind"), rule.alias("rule"), detail.alias("detail"), F.lit(is_type).alias("is_type")))


def _matches(text: Column, patterns: list[str]) -> Column:
    """Whether a text matches the rule's pattern, all of them compiled once."""
    out = F.lit(True)
    for i, pattern in enumerate(patterns):
        out = F.when(F.col("pattern_number") == i, text.rlike(pattern)).otherwise(out)
    return out


def _typed(kind: Column, value: Column) -> Column:
    """Whether one JSON value has the rule's base type."""
    base = F.col("base")
    return (
        F.when(base == "Boolean", kind == "Boolean")
        .when(base == "Integer", (kind == "Integer") | ((kind == "Float") & (F.when(kind == "Float", value.cast("double")) % 1 == 0)))
        .when(base == "Float", kind.isin(*_NUMBERS))
        .when(base == "String", kind.isin(*_STRINGS) | F.col("coerce"))
        .otherwise(kind.isin(*_STRINGS))
    )


def _quoted(text: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.struct(text.alias("t"))), r'^\{"t":|\}$', "")


@dataclass(frozen=True)
class _Uses:
    """What a configuration declares at all; checks of other things are left out of the plan."""

    bases: frozenset[str]
    limits: frozenset[str]
    steps: frozenset[str]
    arrays: bool
    patterns: tuple[str, ...]


def _uses(config: Config) -> _Uses:
    return _Uses(
        frozenset(element(x.type) or x.type for x in config.fields),
        frozenset(k for x in config.fields if x.constraints for k in x.constraints.given()),
        frozenset(step for x in config.fields for step in x.preprocess),
        any(element(x.type) is not None for x in config.fields),
        tuple(_patterns(config)),
    )


def _instance_problems(x: Column, nullable: Column, uses: _Uses) -> Column:
    """Problems of one value, a scalar or an array's element."""
    kind, value, text = x["type"], x["value"], x["text"]
    is_null = kind == "Null"
    wrong = ~is_null & ~_typed(kind, value)
    as_text = F.col("coerce") & ~kind.isin(*_STRINGS) & (F.col("base") == "String")
    shown = value
    if WIDEN in uses.steps:
        shown = F.when(F.col("widen") & (kind == "Integer") & (F.col("base") == "Float"), F.concat(value, F.lit(".0"))).otherwise(shown)
    if COERCE in uses.steps:
        shown = F.when(as_text, _quoted(text)).otherwise(shown)
    got = F.concat(F.lit("got "), shown)
    number = F.when(kind.isin(*_NUMBERS) & F.col("base").isin(*_NUMBERS), value.cast("double"))
    string = F.when(kind.isin(*_STRINGS) | (as_text if COERCE in uses.steps else F.lit(False)), text)
    checked = ~is_null & ~wrong
    is_day = F.try_to_date(F.substring(string, 1, 10), "yyyy-MM-dd").isNotNull()
    found = [
        _problem(is_null & ~nullable, "NullNotAllowed", F.lit("not nullable"), F.lit(None).cast("string"), True),
        _problem(wrong, "WrongType", F.concat(F.lit("type "), F.col("type")), F.concat(F.lit("got "), kind), True),
    ]
    for base, shape, rule in (("Date", r"^\d{4}-\d{2}-\d{2}$", "format date"), ("DateTime", _DATE_TIME, "format date-time")):
        if base in uses.bases:
            found.append(_problem(checked & (F.col("base") == base) & ~F.coalesce(string.rlike(shape) & is_day, F.lit(False)), "WrongType", F.lit(rule), got, False))
    if "categories" in uses.limits:
        found.append(_problem(F.col("options").isNotNull() & ~(is_null & nullable) & ~F.array_contains("options", shown), "InvalidCategory", F.col("enum_rule"), got, False))
    for key, bad, rule in (
        ("min", number < F.col("lo"), F.col("lo_rule")),
        ("max", number > F.col("hi"), F.col("hi_rule")),
        ("min_length", F.char_length(string) < F.col("min_length"), F.concat(F.lit("minLength "), F.col("min_length"))),
        ("max_length", F.char_length(string) > F.col("max_length"), F.concat(F.lit("maxLength "), F.col("max_length"))),
    ):
        if key in uses.limits:
            found.append(_problem(bad, "OutOfRange", rule, got, False))
    if "pattern" in uses.limits:
        found.append(_problem(string.isNotNull() & F.col("pattern").isNotNull() & ~_matches(string, list(uses.patterns)), "WrongType", F.concat(F.lit("pattern "), F.col("pattern")), got, False))
    return F.array_compact(F.array(*found))


def _leaf_problems(uses: _Uses) -> Column:
    """Problems of a present value: place, type, null and constraints, as an array."""
    value = F.struct(F.when(F.col("is_null"), F.lit("Null")).otherwise(F.col("actual")).alias("type"), "value", "text")
    nothing, type_rule = F.lit(None).cast("string"), F.concat(F.lit("type "), F.col("type"))
    of_value = _instance_problems(value, F.col("nullable"), uses)
    if uses.arrays:
        no_array = F.array_compact(F.array(_problem(F.col("is_null") & ~F.col("nullable"), "NullNotAllowed", F.lit("not nullable"), nothing, True), _problem(~F.col("is_null"), "WrongType", type_rule, F.concat(F.lit("got "), F.col("actual")), True)))
        of_value = F.when(F.col("is_array") & F.col("items").isNull(), no_array).when(F.col("is_array"), F.flatten(F.transform("items", lambda x: _instance_problems(x, F.lit(False), uses)))).otherwise(of_value)
    if "Float" in uses.bases:
        at = F.when(F.col("is_array"), F.array_position(F.transform("items", lambda x: x["type"]), "Integer") - 1)
        is_strict = (F.col("base") == "Float") & ~F.col("widen") & ((~F.col("is_array") & (F.col("actual") == "Integer")) | (at >= 0))
        detail = F.when(F.col("is_array"), F.concat(F.lit("got Integer at index "), at)).otherwise(F.lit("got Integer"))
        of_value = F.when(F.coalesce(is_strict, F.lit(False)), F.array(_problem(F.lit(True), "WrongType", type_rule, detail, True))).otherwise(of_value)
    misplaced = _problem(~F.element_at("in_place", F.col("place") + 1), "Disallowed", F.col("allowed_rule"), nothing, True)
    return F.concat(F.array_compact(F.array(misplaced)), of_value)


def _due(config: Config) -> Column:
    """What a document lacks: fields whose required globs match its path."""
    names = F.transform("leaves", lambda x: x["field"])
    needed = [x for x in config.fields if x.required]
    wanted = F.array(*[F.when(path_in(F.col("path"), x.required), F.struct(F.lit(x.name).alias("field"), F.lit("MissingRequired").alias("kind"), F.lit(f"required in {json.dumps(x.required, ensure_ascii=False)}").alias("rule"), F.lit(None).cast("string").alias("detail"))) for x in needed])
    return F.filter(F.array_compact(wanted), lambda x: ~F.array_contains(F.coalesce(names, F.array().cast("array<string>")), x["field"])) if needed else F.array().cast(f"array<{_PROBLEM}>")


def violations(docs: DataFrame, config: Config) -> DataFrame:
    """All violations, a row each: field, kind, rule, path, detail.

    Documents are read once, whatever is declared.
    """
    unread = F.struct(F.lit(FRONTMATTER).alias("field"), F.lit("FrontmatterUnrepresentable").alias("kind"), F.lit("frontmatter must be representable as JSON").alias("rule"), F.col("frontmatter_error").alias("detail"))
    own = F.concat(F.when(F.col("frontmatter_error").isNotNull(), F.array(unread)).otherwise(F.array().cast(f"array<{_PROBLEM}>")), _due(config)).cast(f"array<{_PROBLEM}>")
    places = F.array(*[path_in(F.col("path"), list(x)) for x in _places(config)]).cast("array<boolean>")
    known = F.array(*[F.lit(x.name) for x in config.fields]).cast("array<string>")
    items = F.concat(
        F.transform(F.filter("leaves", lambda x: F.array_contains(known, x["field"])), lambda x: F.struct(x.alias("leaf"), F.lit(None).cast(f"array<{_PROBLEM}>").alias("own"))),
        F.array(F.struct(F.get("leaves", F.lit(-1)).alias("leaf"), F.col("own").alias("own"))),
    )
    split = docs.select("path", "leaves", own.alias("own"), places.alias("in_place")).select("path", "in_place", F.explode(items).alias("item"))
    split = split.where("item.leaf is not null or size(item.own) > 0")
    leaf = split.select("path", "in_place", "item.own", "item.leaf.field", F.col("item.leaf.type").alias("actual"), "item.leaf.value", "item.leaf.text", "item.leaf.is_null", "item.leaf.items")
    ruled = leaf.join(F.broadcast(rules(docs.sparkSession, config)), "field", "left").withColumn("found", _leaf_problems(_uses(config)))
    # a type that is wrong makes other findings about the value moot; where it stands is told all the same
    wrong = F.exists("found", lambda x: x["is_type"] & (x["kind"] != "Disallowed"))
    kept = F.filter("found", lambda x: x["is_type"] | ~wrong)
    told = F.transform(kept, lambda x: F.struct(F.col("field").alias("field"), x["kind"].alias("kind"), x["rule"].alias("rule"), x["detail"].alias("detail")))
    return ruled.select("path", F.explode(F.coalesce("own", told)).alias("problem")).select("problem.field", "problem.kind", "problem.rule", "path", "problem.detail")


def report(found: DataFrame, most_files: int = SHOWN_FILES) -> DataFrame:
    """Violations grouped by field, kind and rule, with their number and first files by path.

    ``files`` holds at most ``most_files`` of a group, ``n`` counts all; ``violations``
    has every one as a row. A group is dealt to parts by path, so that one rule that
    all documents break doesn't meet in one task; it is read in one pass.
    """
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])[F.col("kind")]
    group = ["field", "kind", "rule"]
    dealt = found.withColumn("part", F.pmod(F.xxhash64("path"), F.lit(REPORT_PARTS)))
    placed = dealt.withColumn("place", F.row_number().over(Window.partitionBy(*group, "part").orderBy("path", "detail")))
    parts = placed.groupBy(*group, "part").agg(F.count(F.lit(1)).alias("n"), F.collect_list(F.when(F.col("place") <= most_files, F.struct("path", "detail"))).alias("files"))
    whole = parts.groupBy(*group).agg(F.slice(F.array_sort(F.flatten(F.collect_list("files"))), 1, most_files).alias("files"), F.sum("n").alias("n"))
    return whole.orderBy("field", rank, "rule")


def new_fields(docs: DataFrame, config: Config) -> DataFrame:
    """(field, files): leaves that are neither declared nor ignored."""
    known = docs.sparkSession.createDataFrame([(x,) for x in {x.name for x in config.fields} | set(config.ignore)], "field string")
    return leaves(docs).join(F.broadcast(known), "field", "left_anti").groupBy("field").agg(F.countDistinct("path").alias("files"))
