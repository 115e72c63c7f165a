"""Settings from a configuration file, changed-file lists and version control, read on the driver with strict checks."""

from __future__ import annotations

import os
import subprocess
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glintsieve.operators.rules import BY_ID, RANKS
from glintsieve.plans.scan import Override, Settings

NAME = ".glintsieve.toml"
MOST_BYTES = 64 << 10
_KEYS = {"exclude", "enabled", "disabled", "severity", "overrides", "fail_on", "max_findings", "between_functions"}
_LIMITS = {"max_findings": 1_000_000}


def bounded(value: object, name: str) -> int:
    if not isinstance(value, int) or isinstance(value, bool) or not 1 <= value <= _LIMITS[name]:
        raise ValueError(f"{name} must be between 1 and {_LIMITS[name]}")
    return value


def _severity(value: object) -> str | None:
    if value == "never":
        return None
    if value not in RANKS:
        raise ValueError(f"no severity: {value}")
    return value


def _rules(values: object) -> tuple[str, ...]:
    if not isinstance(values, list) or any(v not in BY_ID for v in values):
        raise ValueError(f"unknown rule in {values}")
    return tuple(values)


def parse(text: str) -> Settings:
    """Settings from TOML; unknown keys, rules and severities are errors."""
    data = tomllib.loads(text)
    if unknown := set(data) - _KEYS:
        raise ValueError(f"unknown keys: {sorted(unknown)}")
    severity = {_rules([k])[0]: _severity(v) for k, v in data.get("severity", {}).items()}
    overrides = data.get("overrides", [])
    if len(overrides) > 128 or any(set(o) - {"path", "disabled", "fail_on"} or "path" not in o for o in overrides):
        raise ValueError("invalid overrides")
    return Settings(
        enabled=_rules(data.get("enabled", [])), disabled=_rules(data.get("disabled", [])), severity=severity,
        overrides=tuple(Override(o["path"], _rules(o.get("disabled", [])), _severity(o["fail_on"]) if "fail_on" in o else None) for o in overrides),
        fail_on=_severity(data["fail_on"]) if "fail_on" in data else None,
        max_findings=bounded(data.get("max_findings", 10_000), "max_findings"), between_functions=bool(data.get("between_functions", False)),
    )


def rows(texts: DataFrame) -> DataFrame:
    """The settings of many texts (path, content), or the error of a text that has none."""
    names = ["path", "fail_on", "enabled", "disabled", "max_findings", "overrides", "error"]
    schema = pa.schema([(n, pa.int32() if n == "max_findings" else pa.list_(pa.string()) if n in ("enabled", "disabled", "overrides") else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    s = parse(content or "")
                    out.append(dict(zip(names, (path, s.fail_on, list(s.enabled), list(s.disabled), s.max_findings, [o.pattern for o in s.overrides], None))))
                except ValueError as e:  # TOML's errors are such
                    out.append({"path": path, "error": str(e)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return texts.select("path", "content").mapInArrow(run, "path string, fail_on string, enabled array<string>, disabled array<string>, max_findings int, overrides array<string>, error string")


def load(root: str) -> Settings:
    """The settings file of a root, the defaults where there is none."""
    path = os.path.join(root, NAME)
    if not os.path.lexists(path):
        return Settings()
    if os.path.islink(path) or os.path.getsize(path) > MOST_BYTES:
        raise ValueError("the settings file is no regular file of at most 64 KiB")
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def find_baseline(root: str) -> str | None:
    """The baseline beside a root, if there is one."""
    path = os.path.join(root if os.path.isdir(root) else os.path.dirname(root), "glintsieve.baseline.json")
    return path if os.path.isfile(path) else None


def relative(path: str) -> str:
    """A path below the root with forward slashes; others are errors."""
    path = path.replace("\\", "/").removeprefix("./")
    if not path or path.startswith("/") or ":" in path or ".." in path.split("/"):
        raise ValueError(f"no relative path: {path}")
    return path


def changed(root: str, reference: str, seconds: int = 10, most: int = 2 << 20) -> list[str]:
    """Paths that differ from a commit, by version control; bounded in time and size."""
    if reference.startswith("-"):
        raise ValueError("no reference")
    out = subprocess.run(["git", "-C", root, "-c", "core.fsmonitor=", "diff", "--name-only", "-z", "--no-ext-diff", "--diff-filter=ACMR", reference, "--"], capture_output=True, timeout=seconds, check=True).stdout
    if len(out) > most:
        raise ValueError("too many changed files")
    return sorted(relative(x.decode()) for x in out.split(b"\0") if x)
