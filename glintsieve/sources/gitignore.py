"""Ignore files: parsing, and evaluation where the last matching rule wins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from glintsieve.functions.globs import matches


_ROWS = pa.schema([("base", pa.string()), ("ord", pa.int32()), ("pattern", pa.string()), ("negate", pa.bool_()), ("directory", pa.bool_()), ("anchored", pa.bool_()), ("note", pa.string()), ("error", pa.string())])


@dataclass(frozen=True)
class Rule:
    base: str
    pattern: str
    negate: bool
    directory: bool
    anchored: bool


def parse(base: str, text: str) -> tuple[list[Rule], list[str]]:
    """The rules of an ignore file in a folder, and notes on lines that are not supported."""
    rules, notes = [], []
    for number, raw in enumerate(text.split("\n"), 1):
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        if len(line.encode()) > 1024 or "\\" in line:
            if line.startswith("!"):
                raise ValueError(f"line {number}: an exception that is not supported may hide files")
            notes.append(f"line {number}: not supported; files that match stay in the scan")
            continue
        negate = line.startswith("!")
        line = line[1:] if negate else line
        pattern = line.strip("/")
        if not pattern or {".", ".."} & set(pattern.split("/")):
            raise ValueError(f"line {number}: no valid path")
        rules.append(Rule(base, pattern, negate, line.endswith("/"), line.startswith("/")))
    if len(rules) > 1000:
        raise ValueError("more than 1000 rules")
    return rules, notes


def rule_rows(texts: DataFrame) -> DataFrame:
    """base, ord, pattern, negate, directory and anchored of the rules of ignore files (base, content), with notes and errors as rows of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, content in zip(batch.column("base").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rules, notes = parse(base or "", content or "")
                except ValueError as e:
                    rows.append({"base": base, "error": str(e)})
                    continue
                rows += [{"base": base, "ord": k, "pattern": r.pattern, "negate": r.negate, "directory": r.directory, "anchored": r.anchored} for k, r in enumerate(rules)]
                rows += [{"base": base, "note": x} for x in notes]
            yield pa.RecordBatch.from_pylist(rows, schema=_ROWS)

    return texts.select("base", "content").mapInArrow(run, "base string, ord int, pattern string, negate boolean, directory boolean, anchored boolean, note string, error string")


def _local(rule: Rule, path: str) -> str | None:
    if not rule.base:
        return path
    return path[len(rule.base) + 1 :] if path.startswith(rule.base + "/") else None


def is_ignored(rules: list[Rule], path: str, directory: bool) -> bool:
    out = False
    for rule in rules:
        local = None if rule.directory and not directory else _local(rule, path)
        if local is not None and matches(rule.pattern, local if rule.anchored or "/" in rule.pattern else local.rsplit("/", 1)[-1]):
            out = not rule.negate
    return out
