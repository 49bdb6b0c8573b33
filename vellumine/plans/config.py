"""The declared schema and settings of a vault, and their TOML file."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from vellumine.functions.globs import covered, well_formed
from vellumine.plans.inference import COERCE, WIDEN, InferredField, InferredSchema, categories
from vellumine.sources.toml_codec import toml_key, toml_value
from vellumine.types import FieldTypeError, element, parse_type

CONFIG_NAME = "vault.toml"


class ConfigError(ValueError):
    """A configuration that breaks a rule."""


@dataclass
class Constraints:
    categories: list[Any] | None = None
    min: int | float | None = None
    max: int | float | None = None
    min_length: int | None = None
    max_length: int | None = None
    pattern: str | None = None

    def given(self) -> dict[str, Any]:
        return {k: v for k, v in self.__dict__.items() if v is not None}


@dataclass
class Field:
    name: str
    type: str = "String"
    allowed: list[str] = field(default_factory=lambda: ["**"])
    required: list[str] = field(default_factory=list)
    nullable: bool = True
    constraints: Constraints | None = None
    preprocess: list[str] = field(default_factory=list)


@dataclass
class Scan:
    glob: str = "**"
    include_bare_files: bool = False
    skip_gitignore: bool = False
    frontmatter_format: str = "auto"


@dataclass
class EmbeddingModel:
    provider: str = "mock"
    name: str = "mock"
    revision: str | None = None


@dataclass
class Search:
    default_limit: int = 10
    auto_update: bool = False
    auto_build: bool = False
    internal_prefix: str = ""
    aliases: dict[str, str] = field(default_factory=dict)


@dataclass
class Config:
    scan: Scan = field(default_factory=Scan)
    check_auto_update: bool | None = None
    embedding_model: EmbeddingModel | None = None
    max_chunk_size: int | None = None
    build_auto_update: bool | None = None
    search: Search | None = None
    ignore: list[str] = field(default_factory=list)
    fields: list[Field] = field(default_factory=list)
    max_categories: int = 10
    min_category_repetition: int = 3
    default_output_format: str | None = None


#: Sections and keys of the file; others are refused.
SECTIONS = {
    "scan": ("glob", "include_bare_files", "skip_gitignore", "frontmatter_format"),
    "check": ("auto_update",),
    "update": (),
    "embedding_model": ("provider", "name", "revision"),
    "chunking": ("max_chunk_size",),
    "build": ("auto_update",),
    "search": ("default_limit", "auto_update", "auto_build", "internal_prefix", "aliases"),
    "fields": ("ignore", "field", "max_categories", "min_category_repetition"),
}
FIELD_KEYS = ("name", "type", "allowed", "required", "nullable", "constraints", "preprocess")


def _known(found: dict[str, Any], keys: tuple[str, ...], where: str) -> dict[str, Any]:
    for key in found:
        if key not in keys:
            raise ConfigError(f"{where} has no setting '{key}'")
    return found


def parse_config(text: str) -> Config:
    try:
        given = tomllib.loads(text)
    except tomllib.TOMLDecodeError as error:
        raise ConfigError(f"{CONFIG_NAME} isn't TOML: {error}") from error
    _known(given, (*SECTIONS, "default_output_format"), "the configuration")
    part = {k: _known(given.get(k, {}), keys, f"[{k}]") for k, keys in SECTIONS.items()}
    for needed in ("scan", "fields"):
        if needed not in given:
            raise ConfigError(f"{CONFIG_NAME} needs a section [{needed}]")
    fields = []
    for x in part["fields"].get("field", []):
        own = dict(_known(x, FIELD_KEYS, "[[fields.field]]"))
        if "name" not in own:
            raise ConfigError("a field needs a name")
        if (limits := own.get("constraints")) is not None:
            own["constraints"] = Constraints(**_known(limits, tuple(Constraints().__dict__), "constraints"))
        fields.append(Field(**own))
    config = Config(
        Scan(**part["scan"]),
        part["check"].get("auto_update", False) if "check" in given else None,
        EmbeddingModel(**part["embedding_model"]) if "embedding_model" in given else None,
        part["chunking"].get("max_chunk_size"),
        part["build"].get("auto_update", False) if "build" in given else None,
        Search(**part["search"]) if "search" in given else None,
        part["fields"].get("ignore", []),
        fields,
        part["fields"].get("max_categories", 10),
        part["fields"].get("min_category_repetition", 3),
        given.get("default_output_format"),
    )
    for x in config.fields:
        try:
            x.type = parse_type(x.type)
        except FieldTypeError as error:
            raise ConfigError(f"field '{x.name}': its type can't be read: {error}") from error
    return config


def config_text(config: Config) -> str:
    """The file's text: sections in fixed order, fields by name."""
    out: list[str] = []

    def section(name: str, values: dict[str, Any]) -> None:
        out.extend([f"[{name}]", *(f"{toml_key(k)} = {toml_value(v)}" for k, v in values.items() if v is not None), ""])

    if config.default_output_format:
        out += [f"default_output_format = {toml_value(config.default_output_format)}", ""]
    section("scan", config.scan.__dict__)
    if config.check_auto_update is not None:
        section("check", {"auto_update": config.check_auto_update})
    if config.embedding_model is not None:
        section("embedding_model", config.embedding_model.__dict__)
    if config.max_chunk_size is not None:
        section("chunking", {"max_chunk_size": config.max_chunk_size})
    if config.build_auto_update is not None:
        section("build", {"auto_update": config.build_auto_update})
    if config.search is not None:
        s = config.search
        section("search", {"default_limit": s.default_limit, "auto_update": s.auto_update, "auto_build": s.auto_build, "internal_prefix": s.internal_prefix or None, "aliases": s.aliases or None})
    section("fields", {"ignore": config.ignore, "max_categories": config.max_categories if config.max_categories != 10 else None, "min_category_repetition": config.min_category_repetition if config.min_category_repetition != 3 else None})
    for x in sorted(config.fields, key=lambda x: x.name):
        own = {"name": x.name, "type": x.type, "allowed": x.allowed, "required": x.required, "nullable": x.nullable, "preprocess": x.preprocess or None}
        out += ["[[fields.field]]", *(f"{k} = {toml_value(v)}" for k, v in own.items() if v is not None)]
        if x.constraints is not None:
            out += ["", "[fields.field.constraints]", *(f"{k} = {toml_value(v)}" for k, v in x.constraints.given().items())]
        out.append("")
    return "\n".join(out)


def read_config(path: str | Path) -> Config:
    path = Path(path)
    if not path.parent.exists():
        raise ConfigError(f"there is no directory '{path.parent}'")
    if not path.exists():
        raise ConfigError(f"'{path.parent}' holds no {path.name} yet: init writes one")
    return parse_config(path.read_text(encoding="utf-8"))


def write_config(config: Config, path: str | Path) -> None:
    config.fields.sort(key=lambda x: x.name)
    Path(path).write_text(config_text(config), encoding="utf-8")


_NUMBERS, _TEXTS = ("Integer", "Float"), ("String",)
#: The types, or element types, that each constraint is made for.
_MADE_FOR = {"categories": ("String", "Integer", "Date", "DateTime"), "min": _NUMBERS, "max": _NUMBERS, "min_length": _TEXTS, "max_length": _TEXTS, "pattern": _TEXTS}
_STEP_TYPES = {COERCE: "String", WIDEN: "Float"}


def _name_faults(name: str) -> Iterator[str]:
    if not name:
        yield "a field needs a name"
    elif not all(name.split(".")):
        yield f"'{name}' is no dotted name: each of its parts needs a letter at least"


def _constraint_faults(kind: str, limits: Constraints) -> Iterator[str]:
    base, given = element(kind) or kind, limits.given()
    for key in given:
        if base not in _MADE_FOR[key]:
            yield f"'{key}' can't limit {kind} values"
    if limits.categories is not None:
        if len(given) > 1:
            yield "a list of categories leaves nothing for other constraints to limit"
        if not limits.categories:
            yield "'categories' lists no value"
        whole = base == "Integer"
        for x in limits.categories:
            if isinstance(x, bool) or not isinstance(x, int if whole else str):
                yield f"{x!r} among the categories is no {'whole number' if whole else 'text'}"
    for key in ("min", "max"):
        x = given.get(key)
        if isinstance(x, bool) or not isinstance(x, int | float | None):
            yield f"'{key}' takes a number"
        elif base == "Integer" and isinstance(x, float):
            yield f"'{key}' of whole numbers can't be {x}"
    for low, high in (("min", "max"), ("min_length", "max_length")):
        if low in given and high in given and all(isinstance(given[k], int | float) for k in (low, high)) and given[low] > given[high]:
            yield f"no value lies between '{low}' {given[low]} and '{high}' {given[high]}"
    if limits.pattern is not None:
        if re.search(r"\(\?[=!<]|\\[1-9]", limits.pattern):
            yield "'pattern' may look neither around nor back"
        try:
            re.compile(limits.pattern)
        except re.error as error:
            yield f"'pattern' doesn't compile ({error})"


def _field_faults(x: Field) -> Iterator[str]:
    try:
        parse_type(x.type)
    except FieldTypeError as error:
        yield f"its type can't be read: {error}"
        return
    for glob in (*x.allowed, *x.required):
        if not well_formed(glob):
            yield f"'{glob}' should be *, ** or a directory with /* or /** behind it"
    for glob in x.required:
        if not covered(glob, x.allowed):
            yield f"it is due in '{glob}', where it isn't allowed"
    if x.constraints is not None:
        yield from _constraint_faults(x.type, x.constraints)
    for i, step in enumerate(x.preprocess):
        if step in x.preprocess[:i]:
            yield f"'{step}' is listed twice"
        elif step not in _STEP_TYPES:
            yield f"there is no preprocessing '{step}' (there are {', '.join(_STEP_TYPES)})"
        elif (element(x.type) or x.type) != _STEP_TYPES[step]:
            yield f"'{step}' makes {_STEP_TYPES[step]} values, which {x.type} doesn't hold"


def faults(config: Config) -> Iterator[str]:
    """Every rule that a configuration breaks, as a sentence."""
    names = {x.name for x in config.fields}
    yield from (f"'{name}' can't be declared and ignored at once" for name in config.ignore if name in names)
    for x in config.fields:
        yield from _name_faults(x.name)
        yield from (f"field '{x.name}': {said}" for said in _field_faults(x))
        parts = x.name.split(".")
        above = next((y for i in range(1, len(parts)) if (y := ".".join(parts[:i])) in names), None)
        if above:
            yield f"'{above}' can't hold values of its own and '{x.name}' too"


def check_config(config: Config) -> None:
    """Raise for the first rule that is broken."""
    for said in faults(config):
        raise ConfigError(said)


def from_inferred(schema: InferredSchema, scan: Scan | None = None) -> Config:
    """A first configuration, with categories where values repeat enough."""
    config = Config(scan or Scan(), check_auto_update=True, build_auto_update=True, search=Search(10, True, True))
    for x in schema.fields:
        found = categories(x, config.max_categories, config.min_category_repetition)
        config.fields.append(Field(x.name, x.type, x.allowed, x.required, x.nullable, Constraints(categories=found) if found else None, x.preprocess))
    return config


def add_new_fields(config: Config, schema: InferredSchema) -> list[str]:
    """Declare inferred fields that are neither declared nor ignored; no constraints."""
    known = {x.name for x in config.fields} | set(config.ignore)
    new = [x for x in schema.fields if x.name not in known]
    config.fields += [Field(x.name, x.type, x.allowed, x.required, x.nullable, None, x.preprocess) for x in new]
    config.fields.sort(key=lambda x: x.name)
    return [x.name for x in new]


def schema_diff(config: Config, schema: InferredSchema, targets: list[str] | None = None) -> dict[str, Any]:
    """What inferring anew would add, change and remove among the target fields."""
    declared, inferred = {x.name: x for x in config.fields}, {x.name: x for x in schema.fields}
    chosen = set(declared) | set(inferred) if targets is None else set(targets)
    changed = {}
    for name in sorted(chosen & declared.keys() & inferred.keys()):
        a, b = declared[name], inferred[name]
        parts = {k: (getattr(a, k), getattr(b, k)) for k in ("type", "allowed", "required", "nullable") if getattr(a, k) != getattr(b, k)}
        if parts:
            changed[name] = parts
    return {
        "added": sorted(chosen & (inferred.keys() - declared.keys() - set(config.ignore))),
        "changed": changed,
        "removed": sorted(chosen & (declared.keys() - inferred.keys())),
        "unchanged": sorted((chosen & declared.keys() & inferred.keys()) - changed.keys()),
    }


def _limits(found: InferredField, config: Config, how: str | None, ranges: dict[str, tuple[float, float]]) -> Constraints | None:
    if how == "range":
        if found.name not in ranges or (element(found.type) or found.type) not in ("Integer", "Float"):
            return None
        low, high = ranges[found.name]
        return Constraints(min=int(low), max=int(high)) if (element(found.type) or found.type) == "Integer" else Constraints(min=low, max=high)
    values = categories(found, config.max_categories, config.min_category_repetition) if how == "categorical" else found.values if how == "categories" else None
    return Constraints(categories=values) if values else None


def reinfer(config: Config, schema: InferredSchema, targets: list[str] | None = None, constraints: str | None = "categorical", ranges: dict[str, tuple[float, float]] | None = None) -> Config:
    """The configuration with target fields inferred anew; others stay.

    ``constraints``: ``categorical`` by the usual rule, ``categories`` for all
    values, ``range`` for the least and the greatest number, or None.
    """
    inferred = {x.name: x for x in schema.fields}
    declared = {x.name: x for x in config.fields}
    for name in targets or ():
        if name not in declared:
            raise ConfigError(f"no field '{name}' is declared")
    chosen = set(declared) | set(inferred) if targets is None else set(targets)
    fields = [x for x in config.fields if x.name not in chosen]
    for name in sorted(chosen & inferred.keys() - set(config.ignore)):
        x = inferred[name]
        fields.append(Field(x.name, x.type, x.allowed, x.required, x.nullable, _limits(x, config, constraints, ranges or {}), x.preprocess))
    out = Config(**{**config.__dict__, "fields": sorted(fields, key=lambda x: x.name)})
    return out


def name_hints(name: str) -> list[str]:
    """What in a name needs care in a predicate, and which."""
    out = []
    if "'" in name:
        out.append("an apostrophe: only inside double quotes")
    if '"' in name:
        out.append('a quotation mark: doubled, inside double quotes')
    if " " in name:
        out.append("a blank: only inside double quotes")
    return out
