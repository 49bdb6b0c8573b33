"""Commands over a vault: a directory of Markdown files and its configuration."""

from __future__ import annotations

import argparse
import os
import sys
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from vellumine.operators import report
from vellumine.operators.embedding import load_embedder
from vellumine.operators.index import BuildResult, Index, IndexError_
from vellumine.operators.search import search
from vellumine.plans import config as cfg
from vellumine.plans import jsonschema, validation
from vellumine.plans.inference import field_types, infer, prevalence, value_ranges
from vellumine.sources.frontmatter import documents, leaves, skipped
from vellumine.sources.listing import list_files, read_files

INDEX_FOLDER = ".vault"
#: Exit codes of the command line.
DONE, FOUND_VIOLATIONS, FAILED = 0, 1, 2


class VaultError(RuntimeError):
    """A command that can't be carried out."""


@dataclass
class Step:
    name: str
    seconds: float = 0.0
    failed: bool = False


@dataclass
class Outcome:
    """What a command found, and how long its steps took."""

    result: Any = None
    steps: list[Step] = field(default_factory=list)

    @contextmanager
    def step(self, name: str):
        own, began = Step(name), time.perf_counter()
        self.steps.append(own)
        try:
            yield
        except BaseException:
            own.failed = True
            raise
        finally:
            own.seconds = time.perf_counter() - began


@dataclass
class CheckResult:
    violations: DataFrame
    new_fields: DataFrame
    files: int
    skipped: DataFrame | None = None


class Vault:
    """``root`` is a directory that driver and executors see."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, os.path.abspath(root)
        # settings that meaning depends on, in a session of the vault's own
        spark = self.spark = spark.newSession()
        for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.caseSensitive", "true")):
            spark.conf.set(key, value)
        self.index = Index(spark, f"file://{self.root}/{INDEX_FOLDER}")

    @property
    def config_path(self) -> str:
        return os.path.join(self.root, cfg.CONFIG_NAME)

    def config(self) -> cfg.Config:
        found = cfg.read_config(self.config_path)
        cfg.check_config(found)
        return found

    def scan(self, scan: cfg.Scan) -> DataFrame:
        paths = list_files(self.root, scan.glob, scan.skip_gitignore)
        return documents(read_files(self.spark, self.root, paths), scan.frontmatter_format, scan.include_bare_files)

    def skipped(self, scan: cfg.Scan) -> DataFrame:
        """(path, reason) of files that a scan leaves out."""
        paths = list_files(self.root, scan.glob, scan.skip_gitignore)
        return skipped(read_files(self.spark, self.root, paths), scan.frontmatter_format)

    def init(self, scan: cfg.Scan | None = None, force: bool = False, dry_run: bool = False, schema: str | None = None) -> Outcome:
        """Infer a configuration, or take it from a JSON Schema, and write it."""
        if not os.path.isdir(self.root):
            raise VaultError(f"'{self.root}' is not a directory")
        if os.path.exists(self.config_path) and not force:
            raise VaultError(f"{cfg.CONFIG_NAME} exists already: use force to replace it")
        out, scan, warnings = Outcome(), scan or cfg.Scan(), []
        if schema is not None:
            with out.step("import"):
                config, warnings = jsonschema.from_json_schema(jsonschema.load_schema(schema))
                config.scan = scan
        else:
            with out.step("scan"):
                docs = self.scan(scan).cache()
                if docs.isEmpty():
                    raise VaultError("no Markdown files found")
            with out.step("infer"):
                found = infer(docs)
                config = cfg.from_inferred(found, scan)
                warnings = [f"field '{x}' holds objects inside arrays and was left out" for x in found.dropped]
                docs.unpersist()
        cfg.check_config(config)
        if not dry_run:
            with out.step("write"):
                if force and self.index.exists():
                    self.index.clean()
                cfg.write_config(config, self.config_path)
        out.result = {"config": config, "warnings": warnings, "hints": {x.name: cfg.name_hints(x.name) for x in config.fields if cfg.name_hints(x.name)}}
        return out

    def check(self, auto_update: bool | None = None, schema: str | None = None, out: Outcome | None = None, docs: DataFrame | None = None, config: cfg.Config | None = None) -> Outcome:
        """Validate every document. A schema file replaces the declared fields."""
        out, config = out or Outcome(), config or self.config()
        if schema is not None:
            given, _ = jsonschema.from_json_schema(jsonschema.load_schema(schema))
            config.fields, config.ignore = given.fields, given.ignore
        with out.step("scan"):
            docs = (self.scan(config.scan) if docs is None else docs).cache()
            files = docs.count()
        wanted = config.check_auto_update if auto_update is None else auto_update
        if wanted and schema is None:
            with out.step("update"):
                if cfg.add_new_fields(config, infer(docs)):
                    cfg.write_config(config, self.config_path)
        with out.step("validate"):
            out.result = CheckResult(validation.violations(docs, config), validation.new_fields(docs, config), files, self.skipped(config.scan))
        return out

    def update(self, reinfer: list[str] | None = None, everything: bool = False, constraints: str | None = "categorical", dry_run: bool = False) -> Outcome:
        """Add new fields, or infer the named ones (or all) anew; tells the difference."""
        out, config, ranges = Outcome(), self.config(), {}
        with out.step("infer"):
            docs = self.scan(config.scan)
            every = [x.name for x in config.fields] if everything else reinfer or []
            found = infer(docs, config.max_categories, every if constraints == "categories" else ())
            if constraints == "range":
                ranges = {r.field: (r.min, r.max) for r in value_ranges(leaves(docs)).collect()}
        targets = None if everything else reinfer
        diff = cfg.schema_diff(config, found, [x.name for x in found.fields if x.name not in {y.name for y in config.fields}] if not everything and reinfer is None else targets)
        if everything or reinfer is not None:
            config = cfg.reinfer(config, found, targets, constraints, ranges)
        else:
            cfg.add_new_fields(config, found)
        cfg.check_config(config)
        if not dry_run:
            with out.step("write"):
                cfg.write_config(config, self.config_path)
        out.result = diff
        return out

    def build(self, force: bool = False, auto_update: bool | None = None, model: cfg.EmbeddingModel | None = None, chunk_size: int | None = None) -> Outcome:
        """Bring the index up to date; documents with violations stop it."""
        out, config = Outcome(), self.config()
        for name, new in (("embedding_model", model), ("max_chunk_size", chunk_size)):
            if new is not None and getattr(config, name) not in (None, new) and not force:
                raise VaultError(f"changing {name} needs force: the index has to be built anew")
            if new is not None:
                setattr(config, name, new)
        if model is not None or chunk_size is not None:
            cfg.write_config(config, self.config_path)
        wanted = config.build_auto_update if auto_update is None else auto_update
        docs = self.scan(config.scan).cache()
        self.check(bool(wanted), out=out, docs=docs, config=config)
        if not out.result.files:
            raise VaultError("no Markdown files found")
        if not out.result.violations.isEmpty():
            raise VaultError("documents have violations: check and mend them first")
        with out.step("build"):
            out.result = self.index.build(docs, config, force)
        docs.unpersist()
        return out

    def search(self, text: str, mode: str = "hybrid", where: str | None = None, limit: int | None = None, auto_build: bool | None = None, overfetch: int | None = 3, auto_update: bool | None = None) -> Outcome:
        out, config = Outcome(), self.config()
        settings = config.search or cfg.Search()
        if settings.auto_build if auto_build is None else auto_build:
            out.steps += self.build(auto_update=settings.auto_update if auto_update is None else auto_update).steps
        if not self.index.exists():
            raise VaultError("no index: build it first")
        model = config.embedding_model or cfg.EmbeddingModel()
        built = self.index.metadata()
        if (built["provider"], built["model"], built["revision"]) != (model.provider, model.name, model.revision):
            raise VaultError(f"the index was built with model '{built['model']}', the configuration says '{model.name}': build with force")
        query = None
        if mode != "fulltext":
            with out.step("embed"):
                query = load_embedder(model).encode([text])[0].tolist()
        with out.step("search"):
            hits, predicate = search(self.index, text, mode, where, settings.default_limit if limit is None else limit, query, settings.internal_prefix, settings.aliases, overfetch)
        out.result = {"hits": hits, "notes": predicate.notes}
        return out

    def info(self) -> Outcome:
        """Declared fields with how many files have each, and the index's state."""
        out, config = Outcome(), self.config()
        docs = self.scan(config.scan)
        counts = {r.field: r.files for r in field_types(leaves(docs)).collect()} | {r.field: r.files for r in prevalence(docs).collect()}
        built = self.index.metadata() | self.index.stats() if self.index.exists() else None
        out.result = {"files": docs.count(), "fields": [{"field": x.name, "type": x.type, "files": counts.get(x.name, 0), "hints": cfg.name_hints(x.name)} for x in config.fields], "index": built}
        return out

    def clean(self) -> Outcome:
        return Outcome(self.index.clean())

    def export(self, form: str = "json", path: str | None = None) -> str:
        text = jsonschema.export_schema(self.config(), form)
        if path is not None:
            with open(path, "w", encoding="utf-8") as file:
                file.write(text)
        return text


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="vellumine")
    parser.add_argument("--output", choices=report.FORMS, help="form of results (default: the configuration's, or pretty)")
    parser.add_argument("-v", "--verbose", action="store_true", help="list files, and what each step took")
    sub = parser.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, **more: Any) -> argparse.ArgumentParser:
        own = sub.add_parser(name, **more)
        if name == "search":
            own.add_argument("query")
        own.add_argument("path", nargs="?", default=".")
        for x in options:
            own.add_argument(f"--{x}", action="store_true")
        return own

    own = command("init", "force", "dry-run", "ignore-bare-files", "skip-gitignore")
    own.add_argument("--glob", default="**")
    own.add_argument("--from-jsonschema")
    command("check", "no-update").add_argument("--jsonschema")
    own = command("update", "dry-run")
    own.add_argument("--reinfer", nargs="*", metavar="FIELD", help="infer these fields anew, or all")
    own.add_argument("--with", dest="constraints", choices=("categories", "categorical", "range", "none"), default="categorical")
    own = command("build", "force", "no-update")
    own.add_argument("--set-model")
    own.add_argument("--set-provider")
    own.add_argument("--set-revision")
    own.add_argument("--set-chunk-size", type=int)
    own = command("search", "no-update", "no-build")
    own.add_argument("--mode", default="hybrid", choices=("semantic", "fulltext", "hybrid"))
    own.add_argument("--where")
    own.add_argument("-n", "--limit", type=int)
    command("info")
    command("clean")
    own = command("export-jsonschema")
    own.add_argument("--format", default="json", choices=("json", "toml"))
    own.add_argument("--output-file")
    return parser


def _run(vault: Vault, given: argparse.Namespace, form: str) -> tuple[int, Outcome, str]:
    """(exit code, outcome, text) of a command."""
    if given.command == "init":
        scan = cfg.Scan(given.glob, not given.ignore_bare_files, given.skip_gitignore)
        out = vault.init(scan, given.force, given.dry_run, given.from_jsonschema)
        rows = [{"field": x.name, "type": x.type, "nullable": x.nullable} for x in out.result["config"].fields]
        return DONE, out, "\n".join([report.table(rows, ["field", "type", "nullable"], form), *(() if form == "json" else (f"warning: {x}" for x in out.result["warnings"]))])
    if given.command == "check":
        out = vault.check(False if given.no_update else None, given.jsonschema)
        groups = validation.report(out.result.violations).collect()
        return FOUND_VIOLATIONS if groups else DONE, out, report.violations_text(groups, form, given.verbose)
    if given.command == "update":
        constraints = {"none": None}.get(given.constraints, given.constraints)
        out = vault.update(given.reinfer or None, given.reinfer == [], constraints, given.dry_run)
        rows = [{"field": x, "change": kind} for kind in ("added", "changed", "removed") for x in out.result[kind]]
        return DONE, out, report.table(rows, ["field", "change"], form)
    if given.command == "build":
        model = None
        if given.set_model or given.set_provider or given.set_revision:
            held = vault.config().embedding_model or cfg.EmbeddingModel()
            model = cfg.EmbeddingModel(given.set_provider or held.provider, given.set_model or held.name, given.set_revision or held.revision)
        out = vault.build(given.force, False if given.no_update else None, model, given.set_chunk_size)
        return DONE, out, report.table([out.result.__dict__], list(out.result.__dict__), form)
    if given.command == "search":
        out = vault.search(given.query, given.mode, given.where, given.limit, False if given.no_build else None, auto_update=False if given.no_update else None)
        notes = [] if form == "json" else [f"read as: {after}" for _, after in out.result["notes"]]
        return DONE, out, "\n".join([*notes, report.table(out.result["hits"].collect(), out.result["hits"].columns, form)])
    if given.command == "info":
        out = vault.info()
        return DONE, out, report.table(out.result["fields"], ["field", "type", "files"], form)
    if given.command == "clean":
        out = vault.clean()
        return DONE, out, report.table([out.result], ["files", "bytes"], form)
    return DONE, Outcome(), vault.export(given.format, given.output_file) if given.output_file is None else f"written to {given.output_file}" if vault.export(given.format, given.output_file) else ""


def main(args: list[str] | None = None) -> int:
    """The command line; 1 for violations, 2 for failures."""
    given = _parser().parse_args(args)
    spark = SparkSession.builder.appName("vellumine").getOrCreate()
    vault = Vault(spark, given.path)
    try:
        form = given.output or (vault.config().default_output_format if os.path.exists(vault.config_path) else None) or "pretty"
        code, out, text = _run(vault, given, form)
    except (VaultError, IndexError_, ValueError) as error:
        print(f"error: {error}", file=sys.stderr)
        return FAILED
    print(text)
    if given.verbose and out.steps:
        print(report.steps_text(out.steps, form), file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
