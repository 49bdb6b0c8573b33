"""Markdown files as frontmatter and body.

``documents`` turns raw texts into the document relation; parsing runs in
Arrow batches on the executors, and each value's type is told in the same pass,
so whole numbers and fractions stay apart.
"""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vellumine.functions.batches import small_batches
from vellumine.types import finite, json_text, type_of

FORMATS = ("auto", "yaml", "toml", "json")
MOST_BYTES, MOST_FIELDS, MOST_DEPTH = 100 * 1024 * 1024, 1000, 50
_VALUE = "type: string, value: string, text: string"
DOCUMENT = f"path string, data string, frontmatter_error string, content string, body_line_offset int, skip_reason string, leaves array<struct<field: string, {_VALUE}, is_null: boolean, items: array<struct<{_VALUE}>>, first: boolean>>"
_FENCES = {"---": "yaml", "+++": "toml"}


def _yaml_loader():
    try:
        import yaml
    except ImportError as error:  # an optional dependency
        raise RuntimeError("YAML frontmatter needs PyYAML") from error

    class Loader(getattr(yaml, "CSafeLoader", yaml.SafeLoader)):
        """JSON's scalar types only: dates stay text, and so do yes, no, on and off."""

    kept = {}
    for first, rules in yaml.SafeLoader.yaml_implicit_resolvers.items():
        kept[first] = [(tag, rule) for tag, rule in rules if tag not in ("tag:yaml.org,2002:timestamp", "tag:yaml.org,2002:bool", "tag:yaml.org,2002:int", "tag:yaml.org,2002:float")]
    Loader.yaml_implicit_resolvers = kept
    Loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:int", re.compile(r"^[-+]?(?:0|[1-9][0-9]*)$|^0x[0-9a-fA-F]+$|^0o[0-7]+$"), list("-+0123456789"))
    Loader.add_implicit_resolver("tag:yaml.org,2002:float", re.compile(r"^[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?$|^[-+]?\.(?:inf|Inf|INF)$|^\.(?:nan|NaN|NAN)$"), list("-+.0123456789"))

    def whole(loader, node):
        text = loader.construct_scalar(node)
        return int(text, 0) if text[:2] in ("0x", "0o") else int(text)

    def fraction(loader, node):
        return float(loader.construct_scalar(node).lower().replace(".inf", "inf").replace(".nan", "nan"))

    Loader.add_constructor("tag:yaml.org,2002:int", whole)
    Loader.add_constructor("tag:yaml.org,2002:float", fraction)
    return lambda text: yaml.load(text, Loader)  # noqa: S506  a safe loader


_LOAD: dict[str, Any] = {}


def _load_yaml(text: str) -> Any:
    if "yaml" not in _LOAD:
        _LOAD["yaml"] = _yaml_loader()
    return _LOAD["yaml"](text)


def _lines(text: str, at: int = 0) -> Iterator[tuple[int, int]]:
    """Where lines begin and end, line feeds included, read only as far as asked for."""
    while at < len(text):
        end = text.find("\n", at) + 1 or len(text)
        yield at, end
        at = end


def _first_line(raw: str) -> tuple[int, int]:
    """The first line that isn't blank."""
    return next(((a, b) for a, b in _lines(raw) if not raw[a:b].isspace()), (0, 0))


def count_lines(text: str) -> int:
    return text.count("\n") + (text[-1:] not in ("", "\n"))


def detect_format(raw: str) -> str | None:
    """By the first line that isn't blank; None for a bare file."""
    a, b = _first_line(raw)
    return _FENCES.get(raw[a:b].rstrip()) if b - a < 100 and raw[a : a + 1] in "-+" else "json" if raw[a:b].lstrip().startswith("{") else None


def _fenced(raw: str, fence: str) -> tuple[str, str] | None:
    """What stands between two fence lines, and what follows."""
    a, b = _first_line(raw)
    if raw[a:b].rstrip() != fence:
        return None
    return next(((raw[b:start], raw[end:]) for start, end in _lines(raw, b) if raw.startswith(fence, start) and raw[start:end].rstrip() == fence), None)


def _plain(value: Any) -> Any:
    """TOML's dates and times as the text that JSON has for them."""
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [_plain(x) for x in value]
    return value.isoformat().replace("+00:00", "Z") if hasattr(value, "isoformat") else value


def parse_frontmatter(raw: str, kind: str) -> tuple[dict | None, str, str | None]:
    """(data, body, error) of a file in a known format."""
    try:
        if kind == "json":
            value, end = json.JSONDecoder().raw_decode(raw, len(raw) - len(raw.lstrip()))
            body = raw[end:]
        else:
            found = _fenced(raw, "---" if kind == "yaml" else "+++")
            if found is None:
                return None, raw, None
            text, body = found
            value = (_load_yaml(text) if text.strip() else None) if kind == "yaml" else _plain(tomllib.loads(text))
            if value is None:
                return None, body, None
    except Exception as error:  # parsers raise kinds of their own
        return None, raw, f"{kind.upper()} that can't be read: {' '.join(str(error).split())}"
    if not isinstance(value, dict):
        name = {"Boolean": "boolean", "Integer": "number", "Float": "number"}.get(type_of(value), "array" if isinstance(value, list) else "string")
        return None, body, f"names with values are expected, and here is a {name}"
    if not finite(value):
        return None, body, "JSON has no names but texts, and no numbers that aren't finite"
    return value, body, None


def _deeper(value: Any, most: int) -> bool:
    if most < 0:
        return True
    own = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return any(_deeper(x, most - 1) for x in own)


def flatten(data: Any, prefix: str = "", objects: bool = False) -> list[tuple[str, Any]]:
    """Leaves under dotted names; arrays and nulls are leaves, an empty object has none.

    ``objects`` adds the objects on the way.
    """
    out = []
    for key, value in data.items():
        name = f"{prefix}{key}"
        if not isinstance(value, dict) or objects:
            out.append((name, value))
        if isinstance(value, dict):
            out += flatten(value, f"{name}.", objects)
    return out


def _told(value: Any) -> dict:
    return {"type": "Null" if value is None else type_of(value), "value": json_text(value), "text": value if isinstance(value, str) else json_text(value)}


def leaf_row(name: str, value: Any, first: bool = True) -> dict:
    """A leaf with its type told, and its elements if it is an array."""
    return {"field": name, **_told(value), "is_null": value is None, "items": [_told(x) for x in value] if isinstance(value, list) else None, "first": first}


def parse_document(path: str, raw: str, frontmatter_format: str = "auto") -> dict:
    """One row of the document relation.

    ``first`` is false for leaves that share their dotted name with one before.
    """
    found = detect_format(raw)
    row: dict[str, Any] = {"path": path, "data": None, "frontmatter_error": None, "skip_reason": None, "leaves": []}
    data, body, error = None, raw, None
    if frontmatter_format != "auto" and found not in (None, frontmatter_format):
        error = f"{frontmatter_format} frontmatter was asked for, and this is {found}"
    elif (kind := found if frontmatter_format == "auto" else frontmatter_format) and not (found is None and kind == "json" and not raw.strip()):
        data, body, error = parse_frontmatter(raw, kind)
    if data is not None and len(data) > MOST_FIELDS:
        row["skip_reason"] = f"more than {MOST_FIELDS} fields"
    elif data is not None and _deeper(data, MOST_DEPTH):
        row["skip_reason"] = f"nested deeper than {MOST_DEPTH}"
    content = body.strip()
    row |= {"frontmatter_error": error, "content": content, "body_line_offset": count_lines(raw) - count_lines(content)}
    if data is not None and row["skip_reason"] is None:
        row["data"] = json_text(data)
        seen: set[str] = set()
        for name, value in flatten(data, objects=True):
            row["leaves"].append(leaf_row(name, value, name not in seen))
            seen.add(name)
    return row


def parsed(raw: DataFrame, frontmatter_format: str = "auto", body: bool = True) -> DataFrame:
    """Every row of ``raw`` (path, raw, and maybe skip_reason), also those that ``documents`` skips."""
    if frontmatter_format not in FORMATS:
        raise ValueError(f"unknown frontmatter format '{frontmatter_format}'")
    schema = T._parse_datatype_string(DOCUMENT)
    arrow = to_arrow_schema(schema)
    columns = ["path", "raw", "skip_reason"] if "skip_reason" in raw.columns else ["path", "raw"]

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [parse_document(p, r or "", frontmatter_format) for p, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            if len(columns) > 2:
                for row, reason in zip(rows, batch.column(2).to_pylist(), strict=True):
                    row["skip_reason"] = reason or row["skip_reason"]
            if not body:
                for row in rows:
                    row["content"] = None
            yield pa.RecordBatch.from_arrays([pa.array([row[f.name] for row in rows], f.type) for f in arrow], schema=arrow)

    small_batches(raw.sparkSession)
    return raw.select(*columns).mapInArrow(step, schema)


def documents(raw: DataFrame, frontmatter_format: str = "auto", include_bare_files: bool = True, body: bool = True) -> DataFrame:
    """``raw`` (path, raw) as the document relation, without skipped rows.

    A null text counts as empty. Rows that repeat a path stay as they are. Without
    ``body`` the content is null, for callers that need frontmatter only.
    """
    found = parsed(raw, frontmatter_format, body).where("skip_reason is null").drop("skip_reason")
    if include_bare_files:
        return found
    return found.where(F.col("data").isNotNull() | F.col("frontmatter_error").isNotNull())


def skipped(raw: DataFrame, frontmatter_format: str = "auto") -> DataFrame:
    """(path, reason) of the rows that ``documents`` leaves out, for warnings."""
    return parsed(raw, frontmatter_format, body=False).where("skip_reason is not null").select("path", F.col("skip_reason").alias("reason"))


def leaves(docs: DataFrame) -> DataFrame:
    """(path, field, type, value, text, is_null, items, first): a row per leaf of each document."""
    return nodes(docs).where("type <> 'Object'")


def nodes(docs: DataFrame) -> DataFrame:
    """Leaves, and the objects above them."""
    return docs.select("path", F.explode("leaves").alias("leaf")).select("path", "leaf.*")
