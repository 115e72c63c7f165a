"""Findings against a baseline of fingerprints: new, known and fixed.

Both sides are dealt by fingerprint, which spreads evenly, so neither is gathered: a baseline may be as large as the findings. A kept
baseline is a table with a bucket for each leading hexadecimal digit; findings ask only the buckets that they are in.

Defined results: a fingerprint is known if the baseline holds it, once or more often; only new and truncated findings turn known; fixed are those
of the baseline that no finding has, whatever its state; null fingerprints are never known.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(findings: DataFrame, path: str) -> None:
    """The distinct fingerprints of findings as a new table by buckets."""
    known = findings.filter("fingerprint is not null").select("fingerprint").distinct()
    known.withColumn("bucket", F.substring("fingerprint", 1, 1)).write.partitionBy("bucket").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("fingerprint string, bucket string").parquet(path)


def told_apart(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Judged matches, those of the baseline in state known."""
    known = baseline.select("fingerprint").distinct().withColumn("_known", F.lit(True))
    state = F.when(F.col("_known") & F.col("state").isin("new", "truncated"), "known").otherwise(F.col("state"))
    return found.join(known, "fingerprint", "left").withColumn("state", state).drop("_known")


def fixed(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Fingerprints of the baseline that no finding has."""
    return baseline.select("fingerprint").distinct().join(found.select("fingerprint"), "fingerprint", "left_anti")
