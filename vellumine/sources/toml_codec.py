"""JSON values as TOML text and back, without loss.

TOML has no null and needs a table at the top: nulls are written as a
placeholder, and a value that isn't an object under a root key.
"""

from __future__ import annotations

import math
import re
import tomllib
from dataclasses import dataclass
from typing import Any

NULL, ROOT = "__null__", "__root__"
_BARE = re.compile(r"[A-Za-z0-9_-]+")
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r"}


class CodecError(ValueError):
    """A value or text that can't be converted; names the place as a JSON pointer."""


@dataclass
class Options:
    null_placeholder: str = NULL
    root_key: str = ROOT


def toml_string(text: str) -> str:
    return '"' + "".join(_ESCAPES.get(c) or (f"\\u{ord(c):04X}" if ord(c) < 32 or ord(c) == 127 else c) for c in text) + '"'


def toml_key(key: str) -> str:
    return key if _BARE.fullmatch(key) else toml_string(key)


def toml_value(value: Any, options: Options = Options(), at: str = "") -> str:  # noqa: B008  a constant
    """One value, inline."""
    if value is None:
        return toml_string(options.null_placeholder)
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        if not -(1 << 63) <= value < 1 << 63:
            raise CodecError(f"at '{at}': {value} is beyond 64 bits")
        return str(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            raise CodecError(f"at '{at}': {value} has no JSON form")
        text = repr(value)
        return text if any(c in text for c in ".e") else f"{text}.0"
    if isinstance(value, str):
        if value == options.null_placeholder:
            raise CodecError(f"at '{at}': the text {value!r} is the placeholder for null")
        return toml_string(value)
    if isinstance(value, list | tuple):
        return "[" + ", ".join(toml_value(x, options, f"{at}/{i}") for i, x in enumerate(value)) + "]"
    if isinstance(value, dict):
        return "{ " + ", ".join(f"{toml_key(k)} = {toml_value(v, options, f'{at}/{_pointer(k)}')}" for k, v in value.items()) + " }" if value else "{}"
    raise CodecError(f"at '{at}': {type(value).__name__} is no JSON value")


def _pointer(key: str) -> str:
    return key.replace("~", "~0").replace("/", "~1")


def to_toml(value: Any, options: Options = Options()) -> str:  # noqa: B008  a constant
    """A document: plain values first, then sub-tables, then arrays of tables."""
    if not isinstance(value, dict):
        return f"{toml_key(options.root_key)} = {toml_value(value, options)}\n"
    if options.root_key in value:
        raise CodecError(f"at '': the key {options.root_key!r} marks a value that isn't an object")
    out: list[str] = []

    def table(found: dict, path: tuple[str, ...], at: str) -> None:
        later = []
        for key, x in found.items():
            here = f"{at}/{_pointer(key)}"
            if isinstance(x, dict) and x:
                later.append((key, [x], False, here))
            elif isinstance(x, list) and x and all(isinstance(y, dict) for y in x):
                later.append((key, x, True, here))
            else:
                out.append(f"{toml_key(key)} = {toml_value(x, options, here)}")
        for key, tables, many, here in later:
            name = ".".join(map(toml_key, (*path, key)))
            for i, x in enumerate(tables):
                out.extend(["", f"[[{name}]]" if many else f"[{name}]"])
                table(x, (*path, key), f"{here}/{i}" if many else here)

    table(value, (), "")
    return "\n".join(out).lstrip("\n") + "\n"


def from_toml(text: str, options: Options = Options()) -> Any:  # noqa: B008  a constant
    """The value that a text stands for; dates and times become text."""
    try:
        found = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise CodecError(f"not TOML: {error}") from error

    def plain(value: Any, at: str) -> Any:
        if isinstance(value, dict):
            return {k: plain(v, f"{at}/{_pointer(k)}") for k, v in value.items()}
        if isinstance(value, list):
            return [plain(x, f"{at}/{i}") for i, x in enumerate(value)]
        if isinstance(value, float) and not math.isfinite(value):
            raise CodecError(f"at '{at}': {value} has no JSON form")
        if hasattr(value, "isoformat"):
            return value.isoformat().replace("+00:00", "Z")
        return None if value == options.null_placeholder and isinstance(value, str) else value

    out = plain(found, "")
    return out[options.root_key] if set(out) == {options.root_key} else out
