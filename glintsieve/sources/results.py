"""Readers of result files: SARIF documents, findings reports, labels and pinned manifests."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.sinks import fragments

SARIF = "struct<version:string,runs:array<struct<results:array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int>>>>>>>>>"


def safe_uri(uri: Column) -> Column:
    """The path of a URI that stays inside a workspace, null for any other."""
    path = F.try_url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))
    bad = uri.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:|^/|\\\\") | path.rlike("^/|\\\\|\u0000") | F.exists(F.split(path, "/"), lambda p: p.isin("", ".", ".."))
    return F.when(~F.coalesce(bad, F.lit(True)), path)


def sarif_results(documents: DataFrame) -> DataFrame:
    """path, line, rule_id, level and message of every result of SARIF 2.1.0 documents (column body)."""
    x = documents.select(F.from_json("body", SARIF).alias("d")).filter("d.version = '2.1.0'").select(F.explode("d.runs").alias("r")).select(F.explode("r.results").alias("x"))
    place = F.get("x.locations", F.lit(0))["physicalLocation"]
    out = x.select(safe_uri(place["artifactLocation"]["uri"]).alias("path"), place["region"]["startLine"].alias("line"), F.col("x.ruleId").alias("rule_id"), F.coalesce("x.level", F.lit("warning")).alias("level"), F.col("x.message.text").alias("message"))
    return out.filter("path is not null and line >= 1")


def findings_report(documents: DataFrame, schema: str) -> DataFrame:
    """rule_id, path and line of the findings of complete reports without snippets; others are errors."""
    kind = "struct<schema:string,summary:struct<complete:boolean>,findings:array<struct<rule_id:string,path:string,line:int,snippet:string>>>"
    d = F.from_json("body", kind)
    ok = (d["schema"] == schema) & d["summary"]["complete"] & F.forall(d["findings"], lambda f: f["snippet"].isNull())
    return documents.select(F.when(F.coalesce(ok, F.lit(False)), d["findings"]).otherwise(F.raise_error(F.lit("no complete report without snippets"))).alias("f")).select(F.inline("f")).select("rule_id", "path", "line")


def findings_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """findings_report for a report in fragments."""
    head = json.loads(fragments.manifest(path)["header"] + "]}")
    if head.get("schema") != schema or not head.get("summary", {}).get("complete"):
        raise ValueError("no complete report of this schema")
    x = fragments.read(spark, path).select(F.from_json("item", "rule_id string, path string, line int, snippet string", {"mode": "FAILFAST"}).alias("f"))
    shown = F.col("f.snippet").isNotNull()
    return x.select(F.when(shown, F.raise_error(F.lit("a report with snippets"))).otherwise(F.col("f.rule_id")).alias("rule_id"), "f.path", "f.line")


def sarif_parts(spark: SparkSession, path: str) -> DataFrame:
    """sarif_results for a report in fragments: each result as a document of its own."""
    body = F.concat(F.lit('{"version":"2.1.0","runs":[{"results":['), F.col("item"), F.lit("]}]}"))
    return sarif_results(fragments.read(spark, path).select(body.alias("body")))


def csv_labels(spark: SparkSession, path: str) -> DataFrame:
    """test_name, category, positive and cwe of a CSV file with # comments."""
    return spark.read.csv(path, comment="#", schema="test_name string, category string, positive boolean, cwe int", mode="FAILFAST")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """rule_id, path, line and positive of labels, a JSON object a line; others are errors."""
    return spark.read.json(path, schema="rule_id string, path string, line int, positive boolean", mode="FAILFAST")


def pinned(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and whether the content has the manifest's SHA-256."""
    return manifest.join(files, "path", "left").select("path", F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False)).alias("intact"))
