"""Connected components of an edge table, by alternating stars; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintsieve.llm.common import written


#: Edges (16 bytes each) that one task may finish; a chunk of _thinned() is as large.
ONE_TASK = 1_000_000


def forest_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node with the smallest node of its component, for the edges of one chunk; the smallest nodes are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        rx, ry = root[x], root[y]
        differ = rx != ry
        if not differ.any():
            break
        low, high = np.minimum(rx, ry)[differ], np.maximum(rx, ry)[differ]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    some = root != np.arange(len(nodes))
    return nodes[some], nodes[root[some]]


def _thinned(edges: DataFrame) -> DataFrame:
    """A forest of each chunk of a partition's edges: as connected, and fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            v, root = forest_of(*(np.concatenate(x) for x in zip(*held)))
            return pa.RecordBatch.from_arrays([pa.array(v), pa.array(root)], ["a", "b"])

        for batch in batches:
            held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
            rows += batch.num_rows
            if rows > ONE_TASK:
                yield flush()
                held, rows = [], 0
        if held:
            yield flush()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def labels(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """node and label, the smallest node of its component, for every node of an edge (columns a and b, long).

    Up to one_task edges are finished by a single task; more of them are thinned to a forest of each chunk first, and
    those by alternating stars if they are still more.
    """
    e = written(edges.filter("a <> b").select("a", "b"), "edges")
    few = e.count() <= one_task
    if not few:
        e = written(_thinned(e), "thinned")
        few = e.count() <= one_task
    if few:
        e = written(_thinned(e.coalesce(1)), "stars")
    done = few
    for _ in range(0 if few else 64):
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large star: each node's larger neighbours go to the smallest node around it
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = written(large.distinct(), "large")
        # small star: a node's smaller neighbours and itself go to the smallest of these
        small_least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        split = large.join(small_least.filter("n > 1"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = small_least.select("a", F.col("m").alias("b"))
        e = written(stars.unionByName(split).distinct(), "small")
        # done when every node has one edge and no centre is itself a leaf
        if e.groupBy("a").count().filter("count > 1").isEmpty() and e.join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").isEmpty():
            done = True
            break
    if not done:
        raise RuntimeError("the components have not settled after 64 rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return nodes.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
