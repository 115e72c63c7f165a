"""Evidence cases: records of findings with evidence, and the status machine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.functions import text as T

#: status -> statuses that may follow (fixed values)
TRANSITIONS = {"candidate": ["validated", "inconclusive"], "validated": ["remediated", "inconclusive"], "remediated": ["verified", "inconclusive"], "verified": [], "inconclusive": []}


def records(findings: DataFrame, repository: str, revision: str) -> DataFrame:
    """case_id and JSON record of every finding that is more than a candidate."""
    x = findings.filter("confidence <> 'candidate'").withColumn("case_id", T.case_id(F.col("fingerprint")))
    claim = F.struct("rule_id", "path", "line", "severity", "confidence", "trace")
    record = F.struct(F.lit("case/1").alias("schema"), "case_id", F.lit("candidate").alias("status"), F.array(F.lit("candidate")).alias("transitions"), F.struct(F.lit(repository).alias("repository"), F.lit(revision).alias("revision")).alias("scope"), claim.alias("claim"))
    return x.select("case_id", "path", "line", "rule_id", F.to_json(record).alias("record"))


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, to in TRANSITIONS.items() for b in to], "before string, after string")


def illegal(history: DataFrame) -> DataFrame:
    """Steps of histories (case_id, number, before, after) that the machine does not have."""
    return history.join(F.broadcast(transition_table(history.sparkSession)), ["before", "after"], "left_anti")


def admitted(record: Column) -> Column:
    """Whether a case record may go on: a dynamic evaluation with evidence, its path inside the root."""
    path = F.get_json_object(record, "$.claim.path")
    return (F.get_json_object(record, "$.claim.rule_id") == "SR004") & F.get_json_object(record, "$.claim.confidence").isin("tainted", "reachable") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")
