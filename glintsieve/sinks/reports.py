"""Reports of findings: JSON, SARIF, text, code quality and baselines as ordered fragments; rows of Markdown, annotations and diagnostics; exit codes.

Each `write_` function writes a report of any size to a new folder of the shared file system (see fragments); nothing collects all findings.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintsieve.functions import text as T
from glintsieve.operators.rules import SARIF_LEVELS
from glintsieve.sinks import fragments

FINDINGS_SCHEMA = "findings/2"
BASELINE_SCHEMA = "baseline/1"
DEPENDENCY_SCHEMA = "dependencies/1"
RESULTS_SCHEMA = "results/1"
SHOWN = ["rule_id", "severity", "engine", "confidence", "file_class", "path", "line", "snippet", "fingerprint", "trace_depth", "trace"]
_ORDER = ["path", "line", "emit_ord"]


def _summary(report: DataFrame) -> str:
    """The one row of a coverage report as JSON."""
    return report.select(F.to_json(F.struct(*report.columns))).first()[0]


def write_json(findings: DataFrame, report: DataFrame, path: str, root: str = ".") -> None:
    header = f'{{"schema":{json.dumps(FINDINGS_SCHEMA)},"root":{json.dumps(root)},"summary":{_summary(report)},"findings":['
    fragments.write(findings, F.to_json(F.struct(*SHOWN)), _ORDER, path, header, ",\n", "]}\n")


def write_sarif(findings: DataFrame, rules: DataFrame, path: str) -> None:
    level = F.create_map(*[F.lit(v) for pair in SARIF_LEVELS.items() for v in pair])
    place = F.struct(F.struct(F.struct(T.uri(F.col("path")).alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region")).alias("physicalLocation"))
    result = F.struct(F.col("rule_id").alias("ruleId"), F.element_at(level, F.col("severity")).alias("level"), F.struct(F.concat(F.col("rule_id"), F.lit(" at "), "path").alias("text")).alias("message"), F.array(place).alias("locations"), F.struct(F.col("fingerprint").alias("primary")).alias("partialFingerprints"))
    dimension = [{"id": r.rule_id, "name": r.name, "shortDescription": {"text": r.message}} for r in rules.orderBy("rule_id").collect()]  # the fixed rules
    driver = json.dumps({"name": "glintsieve", "rules": dimension})
    fragments.write(findings, F.to_json(result), _ORDER, path, f'{{"version":"2.1.0","runs":[{{"tool":{{"driver":{driver}}},"results":[', ",\n", "]}]}\n")


def write_text(findings: DataFrame, report: DataFrame, path: str) -> None:
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "rule_id", F.lit(" "), T.terminal_safe(F.col("path")), F.lit(":"), F.col("line").cast("string"), F.lit(" ("), "engine", F.lit("/"), "confidence", F.lit(")"), F.concat_ws("", F.transform("trace", lambda s: F.concat(F.lit("\n    "), s["kind"], F.lit(" line "), s["line"].cast("string")))))
    head = report.select(F.format_string("%d finding(s), %d file(s) scanned, complete: %s\n", "new", "scanned_files", F.col("complete").cast("string"))).first()[0]
    fragments.write(findings, line, _ORDER, path, head, "\n", "\n")


def write_code_quality(findings: DataFrame, path: str) -> None:
    entry = F.struct(F.col("rule_id").alias("check_name"), "fingerprint", F.when(F.col("severity") == "high", "critical").otherwise("minor").alias("severity"), F.struct("path", F.struct(F.col("line").alias("begin")).alias("lines")).alias("location"))
    fragments.write(findings, F.to_json(entry), _ORDER, path, "[", ",\n", "]\n")


def write_baseline(findings: DataFrame, path: str) -> None:
    """The sorted distinct fingerprints."""
    known = findings.select("fingerprint").distinct()
    fragments.write(known, F.concat(F.lit('"'), "fingerprint", F.lit('"')), ["fingerprint"], path, f'{{"schema":{json.dumps(BASELINE_SCHEMA)},"fingerprints":[', ",\n", "]}\n")


def write_dependencies(found: DataFrame, errors: DataFrame, path: str) -> None:
    """Vulnerable packages; errors are the distinct messages of the readers, a fixed set."""
    messages = [r[0] for r in errors.distinct().orderBy("error").collect()]
    footer = f'],"errors":{json.dumps(messages)},"complete":{json.dumps(not messages)}}}\n'
    fragments.write(found, F.to_json(F.struct("id", "ecosystem", "package", "version", "summary", "status")), ["id", "ecosystem", "package", "version"], path, f'{{"schema":{json.dumps(DEPENDENCY_SCHEMA)},"findings":[', ",\n", footer)


def write_results(metrics: DataFrame, path: str, order: list[str]) -> None:
    fragments.write(metrics, F.to_json(F.struct(*metrics.columns), {"ignoreNullFields": "false"}), order, path, f'{{"schema":{json.dumps(RESULTS_SCHEMA)},"metrics":[', ",\n", "]}\n")


def read_items(spark, path: str, kind: str) -> DataFrame:
    """position and the fields of every item of a JSON report."""
    return fragments.read(spark, path).select("position", F.from_json("item", kind, {"mode": "FAILFAST"}).alias("x")).select("position", "x.*")


def read_fingerprints(spark, path: str) -> DataFrame:
    """position and fingerprint of a baseline; other schemas and other texts are errors."""
    if json.loads(fragments.manifest(path)["header"] + "]}").get("schema") != BASELINE_SCHEMA:
        raise ValueError("no baseline")
    text = F.regexp_extract("item", '^"([0-9a-f]{64})"$', 1)
    return fragments.read(spark, path).select("position", F.when(text != "", text).otherwise(F.raise_error(F.lit("no valid baseline"))).alias("fingerprint"))


def quiet(report: DataFrame) -> DataFrame:
    return report.select(F.format_string("%d new of %d; complete: %s", "new", "total", F.col("complete").cast("string")).alias("body"))


def markdown_rows(findings: DataFrame) -> DataFrame:
    cells = F.concat(F.lit("| "), F.array_join(F.array(F.col("severity"), F.col("rule_id"), T.markdown(F.concat("path", F.lit(":"), F.col("line").cast("string"))), F.col("confidence")), " | "), F.lit(" |"))
    return findings.select("path", "line", "rule_id", cells.alias("body"))


def annotation_rows(findings: DataFrame) -> DataFrame:
    command = F.when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("notice")
    body = F.concat(F.lit("::"), command, F.lit(" file="), T.annotation(F.col("path")), F.lit(",line="), F.col("line").cast("string"), F.lit("::"), "rule_id")
    return findings.select("path", "line", "rule_id", body.alias("body"))


def read_baseline(body: Column) -> Column:
    """The fingerprints of a baseline; other schemas and other texts are errors."""
    x = F.from_json(body, "struct<schema:string,fingerprints:array<string>>")
    ok = (x["schema"] == BASELINE_SCHEMA) & F.forall(x["fingerprints"], lambda f: f.rlike("^[0-9a-f]{64}$"))
    return F.when(F.coalesce(ok, F.lit(False)), x["fingerprints"]).otherwise(F.raise_error(F.lit("no valid baseline")))


def diagnostics(findings: DataFrame) -> DataFrame:
    """Findings of each file together, as an editor shows them; a file's findings are bounded by its size limit."""
    return findings.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct("line", "rule_id"))).alias("items"))


def exit_code(report: Column, threshold_met: Column) -> Column:
    """2 for errors of use, 3 for an incomplete scan, 1 for a threshold met, 0 otherwise."""
    return F.when(report["usage_error"], 2).when(~report["complete"], 3).when(threshold_met, 1).otherwise(0)
