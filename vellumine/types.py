"""The field types, their join-semilattice, and their Spark storage types.

A type is written in the grammar of configuration files: a scalar name or
``Array(<scalar>)``. Inside the engine arrays nest, and objects are ``Object``.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
from collections.abc import Iterable
from typing import Any

from pyspark.sql import types as T

SCALARS = ("Boolean", "Integer", "Float", "String", "Date", "DateTime")
_STORED = {"Boolean": T.BooleanType(), "Integer": T.LongType(), "Float": T.DoubleType(), "String": T.StringType(), "Date": T.DateType(), "DateTime": T.TimestampType()}
_DATE = re.compile(r"\d{4}-\d{2}-\d{2}")
_DATE_TIME = re.compile(r"(\d{4}-\d{2}-\d{2})T(\d{2}):(\d{2}):(\d{2})(\.\d+)?(?:Z|([+-])(\d{2}):(\d{2}))")


class FieldTypeError(ValueError):
    """A type that can't be declared."""


def array_of(inner: str) -> str:
    return f"Array({inner})"


def element(kind: str) -> str | None:
    """What an array holds; None for other types."""
    return kind[6:-1] if kind.startswith("Array(") and kind.endswith(")") else None


def widen(a: str, b: str) -> str:
    """Least type that holds both. Commutative, associative, idempotent."""
    if a == b:
        return a
    if {a, b} == {"Integer", "Float"}:
        return "Float"
    left, right = element(a), element(b)
    if left is not None and right is not None:
        return array_of(widen(left, right))
    return "String"


def widen_all(kinds: Iterable[str]) -> str | None:
    out = None
    for kind in kinds:
        out = kind if out is None else widen(out, kind)
    return out


def is_date(text: str) -> bool:
    if not _DATE.fullmatch(text):
        return False
    try:
        dt.date.fromisoformat(text)
    except ValueError:
        return False
    return True


def is_date_time(text: str) -> bool:
    """RFC 3339 with seconds and an offset."""
    m = _DATE_TIME.fullmatch(text)
    if not m or not is_date(m[1]):
        return False
    hour, minute, second = int(m[2]), int(m[3]), int(m[4])
    return hour < 24 and minute < 60 and second <= 60 and (m[6] is None or (int(m[7]) < 24 and int(m[8]) < 60))


def type_of(value: Any) -> str:
    """The type of a JSON value. Null is String, an empty array Array(String)."""
    if isinstance(value, bool):
        return "Boolean"
    if isinstance(value, int):
        return "Integer" if -(1 << 63) <= value < 1 << 64 else "Float"
    if isinstance(value, float):
        return "Float"
    if isinstance(value, str):
        return "DateTime" if is_date_time(value) else "Date" if is_date(value) else "String"
    if isinstance(value, list):
        return array_of(widen_all(map(type_of, value)) or "String")
    return "Object" if isinstance(value, dict) else "String"


def json_text(value: Any) -> str:
    """Compact JSON; keys keep their order."""
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def parse_type(text: str) -> str:
    """Check a declared type; errors name the column where reading stopped."""
    rest, column = text.strip(), 1
    if rest.startswith("Array(") and rest.endswith(")"):
        inner, column = rest[6:-1].strip(), 7
        if inner in SCALARS:
            return array_of(inner)
        if inner.startswith(("Array", "Object")):
            raise FieldTypeError(f"column {column}: arrays hold scalars only, not {inner}")
        raise FieldTypeError(f"column {column}: unknown type '{inner}'")
    if rest in SCALARS:
        return rest
    if rest.startswith("Object"):
        raise FieldTypeError(f"column {column}: declare the leaves of an object under dotted names")
    if rest.startswith("@"):
        raise FieldTypeError(f"column {column}: named types aren't supported")
    raise FieldTypeError(f"column {column}: unknown type '{rest}'")


def spark_type(kind: str) -> T.DataType:
    inner = element(kind)
    return T.ArrayType(spark_type(inner), True) if inner is not None else _STORED[kind]


def storage_struct(fields: dict[str, str]) -> T.StructType:
    """Dotted leaf names and their types as nested structs, children sorted."""
    tree: dict[str, Any] = {}
    for name, kind in fields.items():
        node = tree
        *parents, leaf = name.split(".")
        for part in parents:
            node = node.setdefault(part, {})
        node[leaf] = kind

    def build(node: dict[str, Any]) -> T.StructType:
        return T.StructType([T.StructField(k, build(v) if isinstance(v, dict) else spark_type(v)) for k, v in sorted(node.items())])

    return build(tree)


def stored_value(value: Any, kind: str) -> Any:
    """A JSON value as the storage type takes it; what doesn't fit is null."""
    if value is None:
        return None
    inner = element(kind)
    if inner is not None:
        return [stored_value(x, inner) for x in value] if isinstance(value, list) else None
    if kind == "Boolean":
        return value if isinstance(value, bool) else None
    if kind == "Integer":
        return value if isinstance(value, int) and not isinstance(value, bool) and -(1 << 63) <= value < 1 << 63 else None
    if kind == "Float":
        return float(value) if isinstance(value, int | float) and not isinstance(value, bool) else None
    if kind == "String":
        return value if isinstance(value, str) else json_text(value)
    if not isinstance(value, str):
        return None
    if kind == "Date":
        return dt.date.fromisoformat(value) if is_date(value) else None
    if not is_date_time(value):
        return None
    m = _DATE_TIME.fullmatch(value)
    base = dt.datetime.fromisoformat(f"{m[1]}T{m[2]}:{m[3]}:{'59' if m[4] == '60' else m[4]}")
    millis = int(((m[5] or ".0")[1:] + "000")[:3])
    offset = dt.timedelta(hours=int(m[7]), minutes=int(m[8])) * (1 if m[6] == "+" else -1) if m[6] else dt.timedelta()
    return (base - offset + dt.timedelta(milliseconds=millis)).replace(tzinfo=dt.timezone.utc)


def stored_row(data: Any, struct: T.StructType, fields: dict[str, str], prefix: str = "") -> dict | None:
    """Frontmatter as nested dicts for ``struct``; a parent that isn't an object is null."""
    if not isinstance(data, dict):
        return None
    out = {}
    for child in struct.fields:
        name = f"{prefix}{child.name}"
        value = data.get(child.name)
        out[child.name] = stored_row(value, child.dataType, fields, f"{name}.") if isinstance(child.dataType, T.StructType) else stored_value(value, fields[name])
    return out


def finite(value: Any) -> bool:
    """Whether JSON can hold the value."""
    if isinstance(value, float):
        return math.isfinite(value)
    if isinstance(value, dict):
        return all(isinstance(k, str) and finite(v) for k, v in value.items())
    return all(map(finite, value)) if isinstance(value, list) else True
