"""A source tree as a table, walked and read by the executors.

Registered as the format `source_tree`. The driver opens the upper folders only, breadth first, until there are enough subtrees for
the tasks; each task walks its subtree and reads bounded regular files. Filters on path (equal, starts with, in) leave out the subtrees that they
cannot be in. Options: excludes (comma-separated), gitignore (true/false), max_file_bytes, max_entries (of one task's subtree), subtrees.

Defined results: every entry gives a row but ignored folders, which are not entered; links are rows without content; a file that can't be
read, a folder that can't be listed, an ignore file that is too large or not valid, and a subtree with more than max_entries entries (of
which the rest is left out) give a row with an error, so that a scan knows that it is incomplete; lines of an ignore file that are not
supported give a row with a note.
"""

from __future__ import annotations

import os
import stat
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from glintsieve.functions.globs import matches
from glintsieve.sources.gitignore import Rule, is_ignored, parse
from glintsieve.sources.languages import IGNORED_DIRECTORIES

SCHEMA = "path string, size long, is_symlink boolean, excluded boolean, content binary, error string, note string"
MAX_FILE = 2 << 20
MAX_ENTRIES = 100_000
MAX_IGNORE = 64 << 10
SUBTREES = 256


@dataclass(frozen=True)
class Folder(InputPartition):
    """A folder with the ignore rules from above it; deep: with all below."""

    path: str
    rules: tuple[Rule, ...]
    deep: bool
    only: str | None = None  # a single file


def excluded_by(path: str, patterns: list[str]) -> bool:
    """A pattern with a slash matches the path or a folder above it, another one the name."""
    for p in patterns:
        if "/" in p:
            if matches(p, path) or path.startswith(p.rstrip("/") + "/"):
                return True
        elif matches(p, path.rsplit("/", 1)[-1]):
            return True
    return False


def _row(path: str, size=None, link=False, excluded=False, content=None, error=None, note=None) -> tuple:
    return path, size, link, excluded, content, error, note


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.realpath(options["path"].removeprefix("file://"))
        self.patterns = [p for p in options.get("excludes", "").split(",") if p]
        self.use_ignore = options.get("gitignore", "true").lower() == "true"
        self.limit, self.most = int(options.get("max_file_bytes", MAX_FILE)), int(options.get("max_entries", MAX_ENTRIES))
        self.subtrees = int(options.get("subtrees", SUBTREES))
        self.prefixes: list[list[str]] = []  # of each filter, one of which a path has

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if getattr(f, "attribute", None) == ("path",):
                if isinstance(f, (EqualTo, StringStartsWith)):
                    self.prefixes.append([f.value])
                elif isinstance(f, In):
                    self.prefixes.append(list(f.value))
            yield f  # Spark applies them to rows, too

    def _may_hold(self, folder: str) -> bool:
        here = f"{folder}/" if folder else ""
        return all(any(p.startswith(here) or here.startswith(p) for p in some) for some in self.prefixes)

    def _rules(self, folder: str, rules: tuple[Rule, ...]) -> tuple[tuple[Rule, ...], list[tuple]]:
        """The rules of a folder, its own ignore file's added, and rows on what is wrong with that."""
        ignore, path = os.path.join(self.root, folder, ".gitignore"), f"{folder}/.gitignore" if folder else ".gitignore"
        if not self.use_ignore or not os.path.isfile(ignore) or os.path.islink(ignore):
            return rules, []
        if os.path.getsize(ignore) > MAX_IGNORE:
            return rules, [_row(path, error="ignore file too large")]
        try:
            with open(ignore, encoding="utf-8", errors="replace") as f:
                own, notes = parse(folder, f.read())
        except ValueError as e:
            return rules, [_row(path, error=f"ignore file: {e}")]
        return (*rules, *own), [_row(path, note=x) for x in notes]

    def _below(self, folder: str, rules: tuple[Rule, ...], entries: list) -> list[str]:
        """Folders to enter, in order of their names."""
        out = []
        for entry in entries:
            path = f"{folder}/{entry.name}" if folder else entry.name
            if not entry.is_symlink() and entry.is_dir(follow_symlinks=False) and entry.name not in IGNORED_DIRECTORIES:
                if not excluded_by(path, self.patterns) and not is_ignored(list(rules), path, True) and self._may_hold(path):
                    out.append(path)
        return out

    def _listed(self, folder: str) -> list:
        return sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)

    def partitions(self) -> list[Folder]:
        if os.path.isfile(self.root):
            return [Folder("", (), False, os.path.basename(self.root))]
        flat, waiting = [], deque([Folder("", (), True)])
        while waiting and len(flat) + len(waiting) < self.subtrees:
            f = waiting.popleft()
            flat.append(Folder(f.path, f.rules, False))
            try:
                rules, _ = self._rules(f.path, f.rules)
                waiting.extend(Folder(path, rules, True) for path in self._below(f.path, rules, self._listed(f.path)))
            except OSError:  # the task that reads the folder tells
                continue
        return [*flat, *waiting]

    def read(self, part: Folder) -> Iterator[tuple]:
        if part.only is not None:
            self.root = os.path.dirname(self.root)
            yield self._file(part.only, False, excluded_by(part.only, self.patterns))
            return
        count, stack = 0, [(part.path, part.rules)]
        while stack:
            folder, rules = stack.pop()
            try:
                rules, wrong = self._rules(folder, rules)
                entries = self._listed(folder)
            except OSError as e:
                yield _row(folder, error=str(e))
                continue
            yield from wrong
            for entry in entries:
                count += 1
                path = f"{folder}/{entry.name}" if folder else entry.name
                if count > self.most:
                    yield _row(path, error=f"more than {self.most} entries; this one and those behind it are left out")
                    return
                if entry.is_symlink():
                    yield _row(path, link=True)
                elif not entry.is_dir(follow_symlinks=False):
                    yield self._file(path, False, excluded_by(path, self.patterns) or is_ignored(list(rules), path, False))
            if part.deep:
                stack += [(path, rules) for path in reversed(self._below(folder, rules, entries))]

    def _file(self, path: str, link: bool, excluded: bool) -> tuple:
        if excluded:
            return _row(path, excluded=True)
        full = os.path.join(self.root, path)
        try:
            if not os.path.realpath(full).startswith(os.path.join(self.root, "")):
                raise ValueError("outside of the root")
            handle = os.open(full, os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
            with os.fdopen(handle, "rb") as f:
                state = os.fstat(f.fileno())
                if not stat.S_ISREG(state.st_mode):
                    raise ValueError("no regular file")
                if state.st_size > self.limit:
                    raise ValueError("too large")
                content = f.read(self.limit + 1)
                if len(content) > self.limit:
                    raise ValueError("grew while it was read")
            return _row(path, len(content), content=content)
        except (OSError, ValueError) as e:
            return _row(path, error=str(e))


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def load(spark: SparkSession, path: str, **options: object) -> DataFrame:
    register(spark)
    return spark.read.format("source_tree").options(**{k: str(v) for k, v in options.items()}).load(path)


def texts(tree: DataFrame) -> DataFrame:
    """path, content and error of the files to scan: what is no UTF-8 is an error, too."""
    read = tree.filter("not excluded and not is_symlink").select("path", F.col("content").cast("string").alias("content"), "error")
    valid = F.is_valid_utf8("content")
    return read.select("path", F.when(valid, F.col("content")).alias("content"), F.coalesce("error", F.when(~valid, F.lit("no UTF-8"))).alias("error"))


def first_errors(errors: DataFrame, most: int = 1000) -> DataFrame:
    """The first distinct messages in their order, and how many are left out: the limit is the feature."""
    distinct = errors.select("message").distinct()
    total = distinct.agg(F.count(F.lit(1)).alias("n"))
    return distinct.orderBy("message").limit(most).crossJoin(F.broadcast(total)).select("message", F.greatest(F.col("n") - most, F.lit(0)).alias("left_out"))  # total is one row


def summary(tree: DataFrame, most_errors: int = 1000) -> DataFrame:
    """The one-row account of a tree: files read, links and excluded files left out, bytes, errors (the first ones and their number), notes and whether it is complete."""
    rows = texts(tree)
    first = first_errors(rows.filter("error is not null").select(F.concat("path", F.lit(": "), "error").alias("message")), most_errors)
    counts = tree.agg(
        F.count("content").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_bytes"), F.count_if("is_symlink").alias("skipped_symlinks"),
        F.count_if("excluded").alias("excluded_files"), F.count("note").alias("notes"),
    )
    errors = rows.agg(F.count("error").alias("n_errors")).crossJoin(first.agg(F.sort_array(F.collect_list("message")).alias("errors")))
    return counts.crossJoin(errors).withColumn("complete", F.col("n_errors") == 0)  # one row each
