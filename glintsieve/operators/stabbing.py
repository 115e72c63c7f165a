"""Points in intervals of whole numbers, without comparing all of a key's points with all of its intervals.

An interval of up to 2**l numbers lies in one or two neighbouring cells of width 2**l; it is kept at level l under those cells. A point asks one cell
at each level that some interval has. So intervals are doubled at most, points are multiplied by the number of levels
(64 at most, few in practice), and what meets is an equi-join on key, level and cell, where at most a few misses stand beside each
hit, however long an interval is. The join can be split by Spark where a cell is hot.

Defined results: bounds are inclusive; intervals with lo > hi, and rows with a null key, point or bound, meet nothing; equal rows
meet each for themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintsieve.sinks.shared import written


def _level(lo: str, hi: str) -> str:
    """The binary logarithm of the interval's length, rounded up."""
    return f"case when `{hi}` = `{lo}` then 0 else length(bin(`{hi}` - `{lo}`)) end"


def stabbed(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, lo: str, hi: str) -> DataFrame:
    """Every pair of a point and an interval of its keys that holds it: the columns of both. Column names beside the keys must differ."""
    i = intervals.filter(f"`{lo}` <= `{hi}`").withColumns({lo: F.col(lo).cast("long"), hi: F.col(hi).cast("long")}).withColumn("_level", F.expr(_level(lo, hi)))
    i = written(i, "intervals")  # read twice, and what makes them may be work
    levels = sorted(r[0] for r in i.select("_level").distinct().collect())  # 64 at most
    i = i.withColumn("_cell", F.explode(F.expr(f"array_distinct(array(shiftright(`{lo}`, _level), shiftright(`{hi}`, _level)))")))
    asked = F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))
    p = points.withColumn("_level", asked).withColumn("_cell", F.expr(f"shiftright(cast(`{point}` as long), _level)"))
    return p.join(i, [*keys, "_level", "_cell"]).filter(F.col(point).between(F.col(lo), F.col(hi))).drop("_level", "_cell")


def innermost(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, lo: str, hi: str) -> DataFrame:
    """Every point with lo and hi of the shortest interval that holds it, the first one of several; null without one."""
    places = points.select(*keys, point).distinct()
    bounds = intervals.select(*keys, lo, hi).distinct()
    inner = F.min(F.struct((F.col(hi) - F.col(lo)).alias("size"), F.col(lo), F.col(hi))).alias("_inner")  # combined before the shuffle
    found = stabbed(places, bounds, keys, point, lo, hi).groupBy(*keys, point).agg(inner)
    return points.join(found, [*keys, point], "left").withColumns({lo: F.col("_inner")[lo], hi: F.col("_inner")[hi]}).drop("_inner")
