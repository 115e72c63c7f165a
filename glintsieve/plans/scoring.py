"""Predictions against labels: confusion counts and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """Rounded to six decimals, null where nothing is counted."""
    return F.round(F.try_divide(top, bottom), 6)


def metrics(labels: DataFrame, predictions: DataFrame, unit: list[str], by: list[str]) -> DataFrame:
    """tp, fp, tn, fn, precision, recall and false_positive_rate by group; labels have the unit's columns, `by` and positive, predictions the unit's columns."""
    hits = predictions.select(*unit).distinct().withColumn("predicted", F.lit(True))
    x = labels.join(hits, unit, "left").withColumn("predicted", F.coalesce("predicted", F.lit(False)))
    p, q = F.col("positive"), F.col("predicted")
    out = x.groupBy(*by).agg(F.count_if(p & q).alias("tp"), F.count_if(~p & q).alias("fp"), F.count_if(~p & ~q).alias("tn"), F.count_if(p & ~q).alias("fn"))
    return out.select("*", ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("false_positive_rate"))


def unscored(labels: DataFrame, predictions: DataFrame, place: list[str], rule: str, rules: str) -> DataFrame:
    """Predictions (place, rule) that no label speaks of. labels: rows of a place with the array of the rules that it was judged for.

    Labels are many and look small before they are read (an array of fixed values counts for nothing in Spark's estimate), so both sides
    are dealt and sorted; they never go to the driver or to one task as a whole."""
    judged = labels.select(*place, F.col(rules).alias("_rules")).hint("merge")
    own = predictions.select(*place, rule).distinct()
    met = [own[c] == judged[c] for c in place]
    return own.join(judged, [*met, F.array_contains(judged["_rules"], own[rule])], "left_anti")
