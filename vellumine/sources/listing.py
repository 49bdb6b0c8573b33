"""Vaults in a directory: which files belong, and their text as a DataFrame.

Spark's file sources skip names that begin with an underscore or a dot, which
a vault may have, so files are listed on the driver and read by the executors.
The list holds paths only. For collections too large for one directory, give
``frontmatter.documents`` a table of (path, raw) instead.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from vellumine.functions.globs import glob_matches, glob_regex
from vellumine.sources.frontmatter import MOST_BYTES

SUFFIXES = (".md", ".markdown")
IGNORE_FILE = ".vaultignore"


class IgnoreRules:
    """The rules of one ignore file; paths are relative to its directory."""

    def __init__(self, text: str) -> None:
        self.rules: list[tuple[bool, bool, re.Pattern]] = []
        for line in text.splitlines():
            line = line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
            only_directories, line = line.endswith("/"), line.rstrip("/")
            anchored = "/" in line
            line = line.lstrip("/")
            self.rules.append((negated, only_directories, re.compile(glob_regex(line if anchored else f"**/{line}", literal_separator=True), re.DOTALL)))

    def verdict(self, path: str, is_directory: bool) -> bool | None:
        """True: ignored, False: taken back, None: no rule applies."""
        out = None
        for negated, only_directories, pattern in self.rules:
            if (is_directory or not only_directories) and pattern.match(path):
                out = not negated
        return out


def list_files(root: str, glob: str = "**", skip_gitignore: bool = False, ignore_file: str = IGNORE_FILE) -> list[str]:
    """Relative paths of the vault's Markdown files, sorted."""
    glob_regex(glob)  # a wrong pattern fails here
    names = [ignore_file] + ([] if skip_gitignore else [".gitignore"])
    found: list[str] = []

    def walk(at: str, rules: list[tuple[str, IgnoreRules]]) -> None:
        for name in names:
            path = os.path.join(root, at, name)
            if os.path.isfile(path):
                with open(path, encoding="utf-8", errors="replace") as file:
                    rules = [*rules, (at, IgnoreRules(file.read()))]
        for entry in sorted(os.scandir(os.path.join(root, at)), key=lambda x: x.name):
            relative = f"{at}/{entry.name}" if at else entry.name
            is_directory = entry.is_dir(follow_symlinks=False)
            verdict = None
            for base, own in rules:
                said = own.verdict(relative[len(base) + 1 :] if base else relative, is_directory)
                verdict = said if said is not None else verdict
            if verdict or (is_directory and entry.name == ".git"):
                continue
            if is_directory:
                walk(relative, rules)
            elif entry.is_file(follow_symlinks=False) and entry.name.endswith(SUFFIXES) and glob_matches(glob, relative):
                found.append(relative)

    walk("", [])
    return sorted(found)


def read_files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(path, raw, skip_reason): texts, or why a file can't be read as UTF-8 of at most 100 MB."""
    files = spark.createDataFrame(pd.DataFrame({"path": pd.Series(paths, dtype=str)}), "path string")
    files = files.repartition(max(1, min(len(paths) // 64, 10_000)))

    def read(path: str) -> tuple[str, str | None, str | None]:
        whole = os.path.join(root, path)
        try:
            if os.path.getsize(whole) > MOST_BYTES:
                return path, None, f"larger than {MOST_BYTES} bytes"
            with open(whole, encoding="utf-8", newline="") as file:
                return path, file.read(), None
        except UnicodeDecodeError:
            return path, None, "not UTF-8"
        except OSError as error:
            return path, None, f"unreadable: {error.strerror}"

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = zip(*map(read, batch.column("path").to_pylist()), strict=True) if batch.num_rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in columns], ["path", "raw", "skip_reason"])

    return files.mapInArrow(step, "path string, raw string, skip_reason string")
