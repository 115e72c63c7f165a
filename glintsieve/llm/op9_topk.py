"""Operator 9: exact top-k search by exhaustive term-at-a-time accumulation.

A term is a vector's dimension, its weight the integer component. Queries are written to files of QUERIES rows in the shared folder; candidates stay where
they are. A task takes CANDIDATES of its rows at a time and builds their postings (for each term the rows with a nonzero weight). It
reads the query files one after the other and, term by term, the sparse query rows with that term scatter their weights times the postings into dense
score arrays. Partition selection keeps the k best of each array, and a window over the tasks' winners merges them. Memory of a task is bounded by
CANDIDATES and QUERIES; every pair of a query and a row is scored, and no row is copied or shuffled for it.

Equal rows (id and vector) are one with a number, so a vector that a third of the rows repeat is scored once a query.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows without id; an
empty vector scores 0; missing dimensions count as 0; rows that repeat an id are rows of their own, each a candidate and, if
the id is divisible, a query of its own, that leaves out itself alone; ties go to the smaller id; other columns are ignored.
Products that may pass 64 bits are summed as Python integers: ranks are exact for any finite component; a score
beyond a long is given as the nearest long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glintsieve.llm.common import fresh_path, local_file, only, table, written

SCALE = 256
K = 5
EVERY = 50
CANDIDATES = 16384
QUERIES = 2048
#: Integer components under NARROW in vectors of up to LONGEST dimensions have products whose sums fit 64 bits.
NARROW, LONGEST = 1 << 24, 1 << 14
#: Digits of the largest product sum of doubles.
DIGITS = 640
_COMPLEMENT = str.maketrans("0123456789", "9876543210")


def ragged(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, dimension and value of the nonzero components."""
    lengths = np.fromiter(map(len, vectors), np.int64, len(vectors))
    values = np.concatenate([np.asarray(v, np.int64) for v in vectors]) if len(vectors) and lengths.sum() else np.zeros(0, np.int64)
    rows = np.repeat(np.arange(len(vectors)), lengths)
    dims = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    some = values != 0
    return rows[some], dims[some], values[some]


def postings(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ragged, sorted by dimension."""
    found = ragged(vectors)
    order = np.argsort(found[1], kind="stable")
    return tuple(x[order] for x in found)


def accumulate(queries: pd.Series, c: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """Scores of all queries and the candidates (rows of them) of the postings, term at a time; sums must fit 64 bits."""
    scores = np.zeros((len(queries), rows), np.int64)
    q = postings(queries)
    for term in np.intersect1d(q[1], c[1]):
        qa, qb = np.searchsorted(q[1], [term, term + 1])
        ca, cb = np.searchsorted(c[1], [term, term + 1])
        ids, weights = c[0][ca:cb], c[2][ca:cb]
        full = len(ids) == rows
        for row, weight in zip(q[0][qa:qb], q[2][qa:qb]):
            if full:
                scores[row] += weight * weights
            else:
                scores[row, ids] += weight * weights
    return scores


def scaled(vector: np.ndarray) -> list[int]:
    """floor(SCALE * x) of each component, for any finite double."""
    return [math.floor(x) * SCALE if abs(x) >= 1 << 53 else math.floor(SCALE * x) for x in map(float, vector)]


def split(vectors: pd.Series) -> tuple[pd.Series, dict[int, list[int]]]:
    """The integer vectors, those with large components empty, and the latter by their place as Python integers."""
    narrow, large = [], {}
    for k, v in enumerate(vectors):
        v = np.asarray(v, np.float64)
        if len(v) and (np.abs(v).max() * SCALE >= NARROW or len(v) > LONGEST):
            large[k] = scaled(v)
            narrow.append(np.zeros(0, np.int64))
        else:
            narrow.append(np.floor(SCALE * v).astype(np.int64))
    return pd.Series(narrow, dtype=object), large


def exact(x: list[int], y: list[int]) -> int:
    return sum(a * b for a, b in zip(x, y))


def best(scores: np.ndarray, ids: np.ndarray, numbers: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best candidates in order, each as often as its number says; ties to the smaller id."""
    at = np.flatnonzero(numbers > 0)
    if len(at) > k:
        least = np.partition(scores[at], len(at) - k)[len(at) - k]
        at = at[scores[at] >= least]
    if scores.dtype == object:
        order = at[sorted(range(len(at)), key=lambda i: (-scores[at[i]], ids[at[i]]))]
    else:
        order = at[np.lexsort((ids[at], -scores[at]))]
    return np.repeat(order[:k], numbers[order[:k]])[:k]


def as_long(score: int) -> tuple[int, str]:
    """A score as a long, and for one beyond a text that orders such scores as their values."""
    if -(1 << 63) < score < 1 << 63:
        return score, ""
    text = str(abs(score)).zfill(DIGITS)
    return ((1 << 63) - 1, text) if score > 0 else (-(1 << 63), text.translate(_COMPLEMENT))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector v of the rows that take part, equal rows as one with their number m."""
    finite = "forall(v, x -> x is not null and not isnan(x) and abs(cast(x as double)) < double('infinity'))"
    v = only(vectors, id_col, vector_col).toDF("vec_id", "v").filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.expr(finite))
    return v.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("m"))


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    v = written(usable(vectors, id_col, vector_col).withColumn("key", F.xxhash64("v")), "vectors")
    folder = fresh_path(spark, "queries")
    v.filter(F.col("vec_id") % every == 0).write.option("maxRecordsPerFile", QUERIES).parquet(folder)
    columns = ["query_id", "key", "m", "vec_id", "score", "beyond"]
    schema = pa.schema([(n, pa.string() if n == "beyond" else pa.int64()) for n in columns])

    def against(q: pd.DataFrame, c: pd.DataFrame, terms: tuple, large: dict[int, list[int]], narrow: pd.Series) -> Iterator[tuple]:
        """The k best candidates of each query of a file."""
        ids, keys, numbers = (c[n].to_numpy() for n in ("vec_id", "key", "m"))
        for at in range(0, len(q), 128):
            part = q.iloc[at : at + 128]
            own_narrow, own_large = split(part["v"])
            table_of_scores = accumulate(own_narrow, terms, len(c))
            for row, (own_id, own_key, m) in enumerate(zip(part["vec_id"], part["key"], part["m"])):
                scores = table_of_scores[row]
                if large or row in own_large:
                    scores = scores.astype(object)
                    mine = own_large.get(row) or [int(x) for x in own_narrow.iloc[row]]
                    for i in range(len(ids)) if row in own_large else large:
                        scores[i] = exact(mine, large[i] if i in large else [int(x) for x in narrow.iloc[i]])
                left = numbers - ((ids == own_id) & (keys == own_key))
                for i in best(scores, ids, left, k):
                    yield (own_id, own_key, m, ids[i], *as_long(int(scores[i])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, root = local_file(folder)
        files = sorted(x.path for x in filesystem.get_file_info(fs.FileSelector(root)) if x.base_name.startswith("part-"))

        def solved(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c = pa.Table.from_batches(held).to_pandas()
            narrow, large = split(c["v"])
            terms = postings(narrow)
            for file in files:
                with filesystem.open_input_file(file) as f:
                    q = pq.read_table(f).to_pandas()
                found = list(against(q, c, terms, large, narrow))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), schema.types)], schema=schema)

        held: list[pa.RecordBatch] = []
        for whole in batches:
            for at in range(0, whole.num_rows, CANDIDATES):
                held.append(whole.slice(at, CANDIDATES))
                if sum(x.num_rows for x in held) >= CANDIDATES:
                    yield from solved(held)
                    held = []
        if held:
            yield from solved(held)

    partial = v.mapInArrow(run, "query_id long, key long, m long, vec_id long, score long, beyond string")
    order = Window.partitionBy("query_id", "key").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id")
    found = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    each = F.explode(F.expr("sequence(1L, m)"))  # equal queries have equal results
    return found.withColumn("copy", each).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows of embeddings for each row whose vec_id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, c.w), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
