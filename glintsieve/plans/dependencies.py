"""Packages against advisories: versions in ranges by stabbing, listed versions by equality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.functions.versions import in_ranges, intervals, key, parsed, readable
from glintsieve.operators.stabbing import stabbed

ADVISORY = (
    "id string, summary string, withdrawn string, affected array<struct<package:struct<ecosystem:string,name:string>,versions:array<string>,"
    "ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string,`limit`:string>>>>>>"
)
MOST_ADVISORIES = 10_000


def advisories(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file: an array, or an object with records."""
    raw = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"array<struct<{_typed(ADVISORY)}>>")
    inside = F.from_json("value", f"struct<records:array<struct<{_typed(ADVISORY)}>>>")["records"]
    return raw.select(F.inline(F.when(F.ltrim("value").startswith("["), listed).otherwise(inside)))


def _typed(columns: str) -> str:
    """`name type` as `name:type` at the top level."""
    out, depth = [], 0
    for part in columns.split(" "):
        out.append(part)
        depth += part.count("<") - part.count(">")
    return " ".join(out).replace("id string", "id:string").replace("summary string", "summary:string").replace("withdrawn string", "withdrawn:string").replace("affected array", "affected:array")


_KEYS = ["ecosystem", "name"]


def inventory(*packages: DataFrame) -> DataFrame:
    """The distinct packages that readers of several systems found."""
    out = packages[0]
    for more in packages[1:]:
        out = out.unionByName(more)
    return out.filter("error is null").select(*_KEYS, "version").distinct()


def vulnerable(packages: DataFrame, records: DataFrame) -> DataFrame:
    """id, ecosystem, package, version, summary and status (affected or unknown) of every hit; withdrawn records hit nothing.

    Versions and ranges become whole numbers, and versions meet the ranges that hold them by stabbing, so a package with many versions and many
    advisories costs its hits, not all pairs. Listed versions meet by equality. Only versions and ranges that have no
    key (other syntax, very large numbers) are compared pair by pair."""
    stock = inventory(packages).withColumn("at", key(F.col("version")))
    items = records.filter("withdrawn is null").select("id", "summary", F.explode("affected").alias("a"))
    items = items.select("id", "summary", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"), F.col("a.versions").alias("versions"), F.col("a.ranges").alias("ranges"))
    listed = items.select("id", "summary", *_KEYS, F.explode("versions").alias("version")).join(stock, [*_KEYS, "version"])
    ranges = items.select("id", "summary", *_KEYS, F.explode("ranges").alias("r")).filter(F.col("r.type").isin("SEMVER", "ECOSYSTEM"))
    ranges = ranges.select("id", "summary", *_KEYS, F.col("r.events").alias("events")).withColumn("bounds", intervals(F.col("events")))
    bounds = ranges.filter("bounds is not null").select("id", "summary", *_KEYS, F.explode("bounds").alias("b")).select("id", "summary", *_KEYS, "b.lo", "b.hi")
    inside = stabbed(stock.filter("at is not null"), bounds, _KEYS, "at", "lo", "hi")
    # a version or an event that can't be read leaves open whether it is a hit; only large numbers are compared by pairs
    versions = stock.withColumn("readable", parsed(F.col("version")).isNotNull())
    ranges = ranges.withColumn("clear", readable(F.col("events")))
    by_pair = versions.filter("at is null").join(ranges.drop("bounds"), _KEYS)
    odd = versions.filter("at is not null").join(ranges.filter("bounds is null").drop("bounds"), _KEYS)
    hit = F.when(F.col("readable") & F.col("clear"), in_ranges(F.col("version"), F.col("events")))
    judged = by_pair.unionByName(odd).withColumn("hit", hit).filter("hit is null or hit")
    columns = ["id", *_KEYS, "version", "summary"]
    found = listed.select(*columns).unionByName(inside.select(*columns)).withColumn("known", F.lit(True)).unionByName(judged.select(*columns, F.col("hit").isNotNull().alias("known")))
    status = F.when(F.bool_or("known"), "affected").otherwise("unknown").alias("status")
    return found.groupBy(*columns).agg(status).select("id", "ecosystem", F.col("name").alias("package"), "version", "summary", "status")
