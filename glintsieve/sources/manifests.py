"""Package manifests as tables (ecosystem, name, version, error)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def _package(ecosystem: str, name: Column, version: Column, ok: Column, error: str) -> list[Column]:
    return [F.when(ok, F.lit(ecosystem)).alias("ecosystem"), F.when(ok, name).alias("name"), F.when(ok, version).alias("version"), F.when(~ok, F.lit(error)).alias("error")]


def trimmed(text: Column) -> Column:
    """Without white space at both ends; trim() knows only the space."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def numbered(files: DataFrame) -> DataFrame:
    """path, number and text of the lines of files (path, content)."""
    return files.select("path", F.posexplode(F.split("content", "\n")).alias("number", "text")).withColumn("text", F.regexp_replace("text", "\r$", ""))


def npm(files: DataFrame) -> DataFrame:
    """package-lock.json of versions 2 and 3."""
    entry = "struct<name:string,version:string,link:boolean>"
    x = files.select("path", F.explode(F.from_json("content", f"struct<packages:map<string,{entry}>>")["packages"]).alias("key", "p")).filter("key <> ''")
    inner = F.regexp_extract("key", r"(?s).*node_modules/(.*)$", 1)
    name = F.coalesce(F.col("p.name"), F.when(F.col("key").contains("node_modules/"), inner))
    ok = ~F.coalesce(F.col("p.link"), F.lit(False)) & F.col("p.version").isNotNull() & name.isNotNull()
    return x.select("path", *_package("npm", name, F.col("p.version"), ok, "not resolved"))


def requirements(files: DataFrame) -> DataFrame:
    """requirements.txt: exact pins only."""
    x = numbered(files).withColumn("line", trimmed(F.regexp_replace("text", "#.*$", ""))).filter("line <> ''")
    parts = F.split("line", "==", 2)
    name, version = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    ok = F.coalesce((F.size(parts) == 2) & ~version.rlike("[*; ]") & (name != ""), F.lit(False))
    return x.select("path", *_package("PyPI", F.replace(F.lower(F.trim(name)), F.lit("_"), F.lit("-")), version, ok, "no exact pin"))


def cargo(files: DataFrame) -> DataFrame:
    """Cargo.lock: a block a package."""
    blocks = files.select("path", F.posexplode(F.split("content", r"\[\[package\]\]")).alias("number", "block")).filter("number > 0")
    field = lambda key: F.regexp_extract("block", rf'(?m)^\s*{key}\s*=\s*"?([^"\n]*)"?\s*$', 1)
    ok = (field("name") != "") & (field("version") != "")
    return blocks.select("path", *_package("crates.io", field("name"), field("version"), ok, "incomplete block"))


def go(files: DataFrame) -> DataFrame:
    """go.mod: require lines and blocks; replace lines are errors."""
    x = numbered(files).withColumn("line", trimmed(F.regexp_replace("text", "//.*$", "")))
    toggled = F.when(F.col("line") == "require (", True).when(F.col("line") == ")", False)
    x = x.withColumn("group", F.coalesce(F.last(toggled, ignorenulls=True).over(Window.partitionBy("path").orderBy("number")), F.lit(False)))
    spec = F.when(F.col("line").isin("require (", ")"), None).when(F.col("group"), F.col("line")).when(F.col("line").startswith("require "), F.substring("line", 9, 1 << 20))
    x = x.withColumn("spec", trimmed(spec)).withColumn("replaced", F.col("line").startswith("replace ")).filter("spec <> '' or replaced")
    parts = F.split("spec", r"\s+")
    return x.select("path", *_package("Go", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.coalesce(F.size(parts) == 2, F.lit(False)), "not supported"))
