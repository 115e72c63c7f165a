"""Running totals in a global order, without a window that all rows pass through.

Rows are dealt by range of the order and sorted; each partition sums its own, and the sums of the partitions before it, one number a
partition, are added. The dealt rows are written first, so that a rerun of a lost task can't draw other borders.

Defined results: rows that tie in the order get their totals in any order (give it tie-breakers); null values count as 0; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from glintsieve.sinks.shared import written

#: Bits of a partition's own row numbers in Spark's increasing ids.
_OWN = 33


def _free(df: DataFrame, label: str) -> str:
    name = f"_{label}"
    while name.lower() in {n.lower() for n in df.columns}:
        name = f"_{name}"
    return name


def _dealt(df: DataFrame, order: list[Column]) -> DataFrame:
    return df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)


def _with_offsets(rows: DataFrame, part: str, own: str, name: str) -> DataFrame:
    """own plus the totals of all partitions before."""
    spark, before = rows.sparkSession, _free(rows, "before")
    totals = sorted(tuple(r) for r in rows.groupBy(part).agg(F.max(own)).collect())  # a row a partition
    sums, offsets = 0, []
    for k, total in totals:
        offsets.append((k, sums))
        sums += total
    kind = rows.schema[part].dataType.simpleString()
    found = rows.join(F.broadcast(spark.createDataFrame(offsets, f"`{part}` {kind}, `{before}` long")), part)
    return found.withColumn(name, F.col(own) + F.col(before)).drop(part, own, before)


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with the number of each row in the order, from 1."""
    part, own = _free(df, "part"), _free(df, "own")
    at = F.monotonically_increasing_id()
    rows = _dealt(df, order).withColumn(own, at).withColumn(part, F.shiftright(own, _OWN)).withColumn(own, F.col(own).bitwiseAND((1 << _OWN) - 1) + 1)
    return _with_offsets(written(rows, "numbered"), part, own, name)


def running(df: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """df with the sum of a long column over all rows up to each, itself included, in the order. Values must not be negative."""
    part, own = _free(df, "part"), _free(df, "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            if batch.num_rows:
                sums = pc.add(pc.cumulative_sum(pc.fill_null(batch.column(value).cast(pa.int64()), 0)), total)
                total = sums[-1].as_py()
                yield pa.RecordBatch.from_arrays([*batch.columns, sums, pa.array([number] * batch.num_rows, pa.int32())], [*batch.schema.names, own, part])

    schema = t.StructType([*df.schema.fields, t.StructField(own, t.LongType()), t.StructField(part, t.IntegerType())])
    return _with_offsets(written(_dealt(df, order).mapInArrow(run, schema), "running"), part, own, name)
