"""Schema inference as aggregations over leaves.

Types form a semilattice, so a field's type is the widening of the set of its
types, whatever the partitioning. Values are counted per distinct value first;
only fields with few values bring them to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine.plans.paths import directory_counts, field_globs
from vellumine.sources.frontmatter import leaves
from vellumine.types import element, widen_all

COERCE, WIDEN = "coerce-to-string", "widen-int-to-float"
CATEGORICAL = ("String", "Integer", "Array(String)", "Array(Integer)")


@dataclass
class InferredField:
    name: str
    type: str
    files: int
    allowed: list[str] = field(default_factory=list)
    required: list[str] = field(default_factory=list)
    nullable: bool = False
    n_distinct: int = 0
    occurrences: int = 0
    values: list[Any] = field(default_factory=list)
    observed: list[str] = field(default_factory=list)
    preprocess: list[str] = field(default_factory=list)


@dataclass
class InferredSchema:
    fields: list[InferredField]
    dropped: list[str]


def field_types(found: DataFrame) -> DataFrame:
    """Per field: its observed types (nulls aside), nullability, and files."""
    return found.groupBy("field").agg(
        F.sort_array(F.collect_set(F.when(~F.col("is_null"), F.col("type")))).alias("observed"),
        F.max("is_null").alias("nullable"),
        F.count_if("first").alias("files"),
    )


def preprocess_for(observed: Iterable[str], final: str) -> list[str]:
    """What brings the observed types to the final one."""
    out, inner = [], element(final)
    if (final == "String" and any(x != "String" for x in observed)) or (inner == "String" and any(element(x) != "String" for x in observed)):
        out.append(COERCE)
    if (final == "Float" and "Integer" in observed) or (inner == "Float" and "Array(Integer)" in observed):
        out.append(WIDEN)
    return out


def _final_type(kinds: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("field")]


def distinct_values(found: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(field, value, occurrences): distinct values as the final type has them.

    Of arrays, elements are counted over distinct arrays; a String field's other
    values are their JSON text. Nulls don't count.
    """
    final = _final_type(kinds)
    raw = found.where("not is_null").groupBy("field", "type", "value", "text", "items").agg(F.count(F.lit(1)).alias("n")).withColumn("final", final)
    arrays = raw.where(F.col("final").startswith("Array")).select("field", F.explode(F.coalesce("items", F.array(F.struct("type", "value", "text")))).alias("item")).where("item.type <> 'Null'").groupBy("field", F.col("item.value").alias("value")).agg(F.count(F.lit(1)).alias("occurrences"))
    json_string = F.when(F.col("type").isin("String", "Date", "DateTime"), F.col("value")).otherwise(F.regexp_replace(F.to_json(F.struct(F.col("text").alias("t"))), r'^\{"t":|\}$', ""))
    others = raw.where(~F.col("final").startswith("Array")).groupBy("field", F.when(F.col("final") == "String", json_string).otherwise(F.col("value")).alias("value")).agg(F.sum("n").alias("occurrences"))
    return arrays.unionByName(others)


@contextmanager
def kept(*tables: DataFrame) -> Iterator[list[DataFrame]]:
    """Tables that several jobs read, computed once."""
    held = [x.persist(StorageLevel.MEMORY_AND_DISK) for x in tables]
    try:
        yield held
    finally:
        for x in held:
            x.unpersist()


def inferred_globs(docs: DataFrame) -> dict[str, tuple[list[str], list[str]]]:
    """Per field its (allowed, required) globs; only these are collected."""
    # dealt out anew, as a small table read by one task would take all steps of the plan there, with the memory of each
    parts = max(2, docs.sparkSession.sparkContext.defaultParallelism)
    with kept(directory_counts(docs).repartition(parts)) as (counts,):
        return {r.field: (r.allowed, r.required) for r in field_globs(counts).collect()}


def inferred_values(found: DataFrame, kinds: dict[str, str], most_values: int = 10, every: Iterable[str] = ()) -> dict[str, tuple[int, int, list[Any]]]:
    """Per field: distinct values, occurrences, and the values where there are few.

    Fields of ``every`` have all their values collected, however many: a list of
    categories that a caller asks for holds all of them.
    """
    if not kinds:
        return {}
    with kept(distinct_values(found, kinds)) as (counted,):
        sums = {r.field: (r.n, r.occurrences) for r in counted.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("occurrences").alias("occurrences")).collect()}
        few = [name for name, (n, _) in sums.items() if n <= most_values or name in set(every)]
        values: dict[str, list[Any]] = {}
        for r in counted.where(F.col("field").isin(few)).select("field", "value").collect() if few else []:
            values.setdefault(r.field, []).append(json.loads(r.value))
    order = lambda x: (str(type(x)), x if isinstance(x, int | float | str) else str(x))
    return {name: (*counts, sorted(values.get(name, []), key=order)) for name, counts in sums.items()}


def inferred_kinds(rows: Iterable[Any]) -> dict[str, str]:
    """Final types from rows of ``field_types``."""
    return {r.field: widen_all(r.observed) or "String" for r in rows}


def infer(docs: DataFrame, most_values: int = 10, every: Iterable[str] = ()) -> InferredSchema:
    """Infer all fields of a document relation.

    Values are kept for fields of at most ``most_values`` distinct ones, and for
    those of ``every``.
    """
    with kept(docs.select("path", "leaves")) as (parsed,):
        found = leaves(parsed)
        rows = sorted(field_types(found).collect(), key=lambda r: r.field)
        kinds = inferred_kinds(rows)
        dropped = sorted(name for name, kind in kinds.items() if "Object" in kind)
        values, globs = inferred_values(found, kinds, most_values, every), inferred_globs(parsed)
    fields = []
    for r in rows:
        if r.field not in dropped:
            n, occurrences, own = values.get(r.field, (0, 0, []))
            fields.append(InferredField(r.field, kinds[r.field], r.files, *globs[r.field], r.nullable, n, occurrences, own, list(r.observed), preprocess_for(r.observed, kinds[r.field])))
    return InferredSchema(fields, dropped)


def prevalence(docs: DataFrame) -> DataFrame:
    """(field, files): how many documents have each key at the top."""
    return docs.select(F.explode(F.json_object_keys("data")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("files"))


def categories(found: InferredField, most: int = 10, repetition: int = 3) -> list[Any] | None:
    """The values of a field that looks categorical, sorted; else None."""
    if found.type not in CATEGORICAL or not 0 < found.n_distinct <= most or found.occurrences // found.n_distinct < repetition:
        return None
    return sorted(x for x in found.values if isinstance(x, str) or (isinstance(x, int) and not isinstance(x, bool)))


def value_ranges(found: DataFrame) -> DataFrame:
    """(field, min, max) over numbers and the elements of number arrays."""
    numbers = found.where("not is_null").select("field", F.explode(F.coalesce("items", F.array(F.struct("type", "value", "text")))).alias("item")).where(F.col("item.type").isin("Integer", "Float"))
    return numbers.groupBy("field").agg(F.min(F.col("item.value").cast("double")).alias("min"), F.max(F.col("item.value").cast("double")).alias("max"))
