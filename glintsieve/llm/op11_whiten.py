"""Operator 11: whitening of embeddings by a randomised range finder.

Entries c become integers x = floor(SCALE * c) + SHIFT. The fit list is each distinct x vector once: n vectors with sums S. Its covariance V
(centred before multiplying, divisor n) is never formed from uncentred moments:

1. A random orthonormal basis Q of COMPONENTS + OVERSAMPLE columns. A pass over all centred rows gives V Q; the next basis is its
   orthonormalisation (a power pass).
2. Rayleigh-Ritz: the eigenvectors of Q' V Q give the components. Their residuals ||V u - e u|| are measured against the largest eigenvalue.
3. If after POWER passes a residual is over TOLERANCE, the basis is expanded by random columns, twice as many, up to the full dimension,
   where the result is exact to rounding.
4. One more pass over the fit list measures the covariance of the whitened vectors.

A pass sums blocks of rows in the task and the tasks' sums by row of the matrix; only the d x columns result reaches the driver (d the
number of dimensions). Centring is exact: n * x - S is an integer.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; a null vec_id and repeated rows stay; vectors shorter
than the longest are filled with 0 (empty ones too); SCALE * c is kept within +-2**40, far beyond any embedding; components whose eigenvalue is under
RANK times the largest have no direction of their own and are left out, so n = 1, no rows or equal rows give no result; equal eigenvalues are
numbered in any order; a component's sign makes its largest entry positive; a deviation beyond a long is null; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintsieve.llm.common import only, table, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
OVERSAMPLE = 16
POWER = 2
TOLERANCE = 1e-12
RANK = 1e-13
SEED = 11
#: Largest |SCALE * c|.
LIMIT = 1 << 40
#: Bits of the lower half of a sum.
HALF = 24
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """The fitted model: n vectors with sums S, components as columns, their eigenvalues, and the trace of V."""

    n: int
    sums: np.ndarray  # Python integers
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that take part."""
    v = only(vectors, id_col, vector_col).toDF("vec_id", "v").filter("v is not null and forall(v, c -> c is not null and not isnan(c) and abs(cast(c as double)) < double('infinity'))")
    return v.select("vec_id", F.expr(f"transform(v, c -> cast(greatest(least(floor({SCALE}D * greatest(least(cast(c as double), {LIMIT}D), -{LIMIT}D)), {LIMIT}L), -{LIMIT}L) as long) + {SHIFT}L)").alias("x"))


def matrix(column: pa.Array, d: int) -> np.ndarray:
    """Rows of integers, short ones filled up with the integer of 0."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lengths) and (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.full((len(lengths), d), SHIFT, np.int64)
    out[np.arange(d) < lengths[:, None]] = flat
    return out


def blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            yield part, matrix(part.column("x"), d)


def exact(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * x - S: longs where they fit, Python integers otherwise."""
    if n * (2 * LIMIT) < 1 << 62 or (len(x) and n * (int(np.abs(x).max()) + 1) < 1 << 61 and max(map(abs, sums.tolist()), default=0) < 1 << 61):
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return (exact(x, n, sums) / n).astype(np.float64)


def moments(fit: DataFrame, d: int) -> tuple[int, np.ndarray]:
    """Number of vectors and exact sums by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in blocks(batches, d):
            n += len(x)
            high += (x >> HALF).sum(axis=0)
            low += (x & (1 << HALF) - 1).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(high), pa.array(low), pa.array(np.full(d, n))], ["dim", "high", "low", "n"])

    rows = fit.mapInArrow(run, "dim long, high long, low long, n long").groupBy("dim").agg(F.sum("high"), F.sum("low"), F.sum("n")).collect()  # a row a dimension
    sums = np.zeros(d, object)
    for dim, high, low, _ in rows:
        sums[dim] = (high << HALF) + low
    return (rows[0][3] if rows else 0), sums


def multiplied(fit: DataFrame, n: int, sums: np.ndarray, right: np.ndarray, left: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """V right (or left' V right) and the trace of V, by one pass over all centred rows."""
    d, k = right.shape
    rows = d if left is None else left.shape[1]
    shared = fit.sparkSession.sparkContext.broadcast((sums, right, left))  # d x columns numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_sums, own_right, own_left = shared.value
        total, trace, some = np.zeros((rows, k)), 0.0, False
        for _, x in blocks(batches, d):
            z = centred(x, n, own_sums)
            total += (z if own_left is None else z @ own_left).T @ (z @ own_right)
            trace += float((z * z).sum())
            some = True
        if some:
            flat = pa.array(total.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows + 1)), pa.ListArray.from_arrays(pa.array(np.append(np.arange(rows + 1) * k, rows * k + k).astype(np.int32)), pa.concat_arrays([flat, pa.array(np.full(k, trace))]))], ["i", "y"])

    parts = fit.mapInArrow(run, "i long, y array<double>")
    found = parts.groupBy("i").agg(*[F.sum(F.col("y")[j]).alias(f"y{j}") for j in range(k)]).collect()  # rows + 1 rows
    out = np.zeros((rows + 1, k))
    for r in found:
        out[r[0]] = r[1:]
    return out[:rows] / n, float(out[rows, 0]) / n


def fitted(fit: DataFrame, d: int, components: int = COMPONENTS, oversample: int = OVERSAMPLE, power: int = POWER, tolerance: float = TOLERANCE) -> Whitening:
    """Components of the fit list (distinct vectors in column x, a written table)."""
    n, sums = moments(fit, d) if d else (0, np.zeros(0, object))
    none = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    if n < 2 or not d:
        return none
    rng = np.random.default_rng(SEED)
    width, wanted = min(d, components + oversample), min(d, components)
    basis, passes = np.linalg.qr(rng.standard_normal((d, width)))[0], 0
    while True:
        image, trace = multiplied(fit, n, sums, basis)
        passes += 1
        if trace <= 0:
            return none
        small = basis.T @ image
        values, turned = np.linalg.eigh((small + small.T) / 2)
        order = np.argsort(-values)[:wanted]
        values, turned = values[order], turned[:, order]
        vectors = basis @ turned
        residuals = np.linalg.norm(image @ turned - vectors * values, axis=0)
        if width == d or (passes > 1 and residuals.max() <= tolerance * values[0]):
            break
        if passes <= power:
            basis = np.linalg.qr(image)[0]
            continue
        width = min(d, 2 * width)  # the residuals fail: more columns, at last all
        basis = np.linalg.qr(np.concatenate([basis, rng.standard_normal((d, width - basis.shape[1]))], axis=1))[0]
    some = values > RANK * max(values[0], 0.0)
    vectors, values = vectors[:, some], values[some]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.where(vectors[largest, np.arange(len(values))] < 0, -1.0, 1.0)
    return Whitening(n, sums, vectors, values, trace)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity, by a pass over it."""
    if not len(model.values):
        return 0.0
    scaled = model.vectors / np.sqrt(model.values)
    found, _ = multiplied(fit, model.n, model.sums, scaled, scaled)
    return float(np.abs(found - np.eye(len(model.values))).max())


def whitened(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of every row that takes part and each component."""
    x = integers(vectors, id_col, vector_col)
    fit = written(x.select("x").distinct(), "fit-list")
    d = fit.agg(F.max(F.size("x"))).first()[0] or 0
    model = fitted(fit, d, components, **options)
    error, k = identity_error(fit, model), len(model.values)
    kind = x.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    shared = vectors.sparkSession.sparkContext.broadcast(model)  # d x components numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch, rows in blocks(batches if k else iter(()), d):
            off = exact(rows, m.n, m.sums)
            small = off.dtype != object and (not off.size or d * int(np.abs(off).max()) ** 2 < 1 << 62)
            deviation = (off * off).sum(axis=1) if small else [v if v < 1 << 63 else None for v in (off.astype(object) ** 2).sum(axis=1).tolist()]
            out = ((off / m.n).astype(np.float64) @ m.vectors) / np.sqrt(m.values)
            each = np.repeat(np.arange(len(rows)), k)
            yield pa.RecordBatch.from_arrays([
                batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(each), m.n)),
                pa.array(deviation, pa.int64()).take(pa.array(each)), pa.array(out.ravel()), pa.array(np.tile(m.values / m.trace, len(rows))), pa.array(np.full(len(each), error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return x.mapInArrow(run, schema)


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 whitened components of every embedding."""
    return whitened(table(spark, sf_dir, "embeddings"))
