"""Whitening of embeddings from streamed moments.

Each task goes through its rows once with Welford's rank-one updates and hands on one partial
(count, exact sums, mean, centred products).  Partials are merged pairwise-exactly in a tree
of small groups, never all in one task.  The covariance, a square of the dimension, is
solved on the driver by Householder reduction and implicit symmetric QR steps.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Partials that one task merges at a time.
FAN_IN = 16
#: A component counts if its variance is at least this part of the largest.
LEAST_VARIANCE = 1e-12
LONG = 2**63 - 1


@dataclass
class Moments:
    """``n`` vectors, their exact sums by dimension (integers only), mean and covariance (divisor n)."""

    n: int
    sums: list[int]
    mean: np.ndarray
    covariance: np.ndarray


@dataclass
class Whitening:
    """Moments of the fit list, and unit eigenvectors (columns) by falling eigenvalue."""

    moments: Moments
    values: np.ndarray
    vectors: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        """Rows of vectors, whitened."""
        m = self.moments
        # centred in integers as far as these go, so that a large common offset costs no digits
        origin = np.array([s // m.n for s in m.sums], np.int64)
        rest = np.array([(s % m.n) / m.n for s in m.sums])
        return ((x - origin) - rest) @ self.vectors / np.sqrt(self.values)


def lattice(vector: Column, scale: int, offset: int) -> Column:
    """The entries as integers ``floor(scale * c) + offset``."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(offset).cast("long"))


def usable(vector: Column, scale: int) -> Column:
    """True for vectors without null or non-finite entries, all of them within reach of a long."""
    reach = float(2**62) / scale
    return vector.isNotNull() & F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) < reach, F.lit(False)))


def matrix(column, dims: int) -> np.ndarray:
    """An Arrow column of lists of one length as rows of a matrix."""
    return np.asarray(column.flatten()).reshape(-1, dims)


def _merge(a, b):
    """Two partials as one: the parallel update formula."""
    (na, sa, ma, pa_), (nb, sb, mb, pb) = a, b
    n, delta = na + nb, mb - ma
    return n, sa + sb, ma + delta * (nb / n), pa_ + pb + np.outer(delta, delta) * (na * nb / n)


def moments(rows: DataFrame, x: str, dims: int, project=None) -> Moments | None:
    """Moments of the vectors in column ``x`` (lists of ``dims`` longs), or of what
    ``project`` makes of them; None of an empty table."""

    def streamed(batches):
        n, sums, origin = 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = matrix(batch.column(0), dims)
            if project is not None:
                got = project(got)
            if origin is None:  # the task's first vector, so that deltas are small numbers
                origin = got[0].copy()
                width = len(origin)
                mean, products, step = np.zeros(width), np.zeros((width, width)), np.empty((width, width))
                sums = np.zeros(width, np.int64)
            if project is None:
                sums += got.sum(0)
            for row in (got - origin).astype(float):
                n += 1
                delta = row - mean
                mean += delta / n
                np.multiply(delta[:, None], delta * ((n - 1) / n), out=step)
                products += step
        if n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int64()), "n": pa.array([n], pa.int64()), "sums": pa.array([sums.tolist()], pa.list_(pa.int64())), "mean": pa.array([(origin + mean).tolist()], pa.list_(pa.float64())), "products": pa.array([products.ravel().tolist()], pa.list_(pa.float64()))})

    def merged(partials: pd.DataFrame) -> pd.DataFrame:
        state = None
        for r in partials.sort_values("part").itertuples():
            width = len(r.mean)
            one = r.n, np.asarray(r.sums, np.int64), np.asarray(r.mean), np.asarray(r.products).reshape(width, width)
            state = one if state is None else _merge(state, one)
        n, sums, mean, products = state
        return pd.DataFrame({"part": [int(partials.part.min()) // FAN_IN], "n": [n], "sums": [sums.tolist()], "mean": [mean.tolist()], "products": [products.ravel().tolist()]})

    ddl = "part long, n long, sums array<long>, mean array<double>, products array<double>"
    parts = staged(rows.select(x).mapInArrow(streamed, ddl), "moments")
    last = parts.agg(F.max("part")).first()[0]
    if last is None:
        return None
    for _ in range(max(1, math.ceil(math.log(last + 1, FAN_IN) - 1e-9))):
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN).alias("of")).applyInPandas(merged, ddl)
    n, sums, mean, products = parts.select("n", "sums", "mean", "products").first()
    products = np.array(products).reshape(len(mean), len(mean))
    return Moments(n, sums, np.array(mean), (products + products.T) / 2 / n)


def symmetric_qr(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a, n = np.array(a, float), len(a)
    q = np.eye(n)  # rows are eigenvectors in the making
    for k in range(n - 2):  # Householder: zeros beyond the first off-diagonal
        v = a[k + 1 :, k].copy()
        length = -math.copysign(np.linalg.norm(v), v[0])
        if not length:
            continue
        v[0] -= length
        v /= np.linalg.norm(v)
        w = a[k + 1 :, k + 1 :] @ v
        w = 2 * (w - v * (v @ w))
        a[k + 1 :, k + 1 :] -= np.outer(v, w) + np.outer(w, v)
        a[k + 1, k] = length
        q[k + 1 :] -= 2 * np.outer(v, v @ q[k + 1 :])
    d, e = np.diag(a).tolist(), np.diag(a, -1).tolist()
    high, eps, left = n - 1, np.finfo(float).eps, 60 * n
    while high > 0:
        if abs(e[high - 1]) <= eps * (abs(d[high - 1]) + abs(d[high])) or abs(e[high - 1]) < 1e-300:
            e[high - 1] = 0.0
            high -= 1
            continue
        low = high - 1
        while low > 0 and abs(e[low - 1]) > eps * (abs(d[low - 1]) + abs(d[low])):
            low -= 1
        left -= 1
        if left < 0:
            raise ArithmeticError("the QR steps did not converge")
        half = (d[high - 1] - d[high]) / 2  # Wilkinson's shift
        shift = d[high] - e[high - 1] ** 2 / (half + math.copysign(math.hypot(half, e[high - 1]), half))
        x, z = d[low] - shift, e[low]
        for k in range(low, high):  # chase the bulge down with Givens rotations
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > low:
                e[k - 1] = r
            d0, d1, e0 = d[k], d[k + 1], e[k]
            d[k] = c * c * d0 + 2 * c * s * e0 + s * s * d1
            d[k + 1] = s * s * d0 - 2 * c * s * e0 + c * c * d1
            e[k] = c * s * (d1 - d0) + (c * c - s * s) * e0
            x = e[k]
            if k < high - 1:
                z, e[k + 1] = s * e[k + 1], c * e[k + 1]
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(d)[::-1]
    vectors = q[order].T
    at = np.abs(vectors).argmax(0)  # the largest entry of each is positive
    return np.array(d)[order], vectors * np.where(vectors[at, range(n)] < 0, -1.0, 1.0)


def fit(rows: DataFrame, x: str, dims: int, components: int) -> Whitening | None:
    """The whitening of all vectors of column ``x``; None without a vector or variance."""
    m = moments(rows, x, dims)
    if m is None:
        return None
    values, vectors = symmetric_qr(m.covariance)
    keep = min(components, int((values > max(0.0, values[0]) * LEAST_VARIANCE).sum())) if values[0] > 0 else 0
    return Whitening(m, values[:keep], vectors[:, :keep]) if keep else None


def whiten(table: DataFrame, key: str, vector: str, components: int = 32, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """One row for each usable vector and component: ``key``, ``component`` (from 1, by
    falling variance), ``n``, ``deviation`` (the exact sum of squares of ``n * x - sums``),
    ``whitened``, ``explained`` (the component's share of the variance) and
    ``identity_error`` (how far the covariance of all whitened rows is from the identity).

    Vectors that are null or hold null or non-finite entries have no rows and take no part,
    nor those with entries beyond 2**62 / scale or whose length isn't the most common one
    (of several the greatest).  Components without variance are left out, so a table of
    one vector, of equal vectors or of none has no rows.  A deviation that no long holds is
    null.  Repeated vectors and null or repeated keys are rows like any other; further
    columns are ignored.  The table is read four times; nothing of its size is kept."""
    spark = table.sparkSession
    rows = table.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("v")).filter(usable(F.col("v"), scale))
    kind = dict(rows.dtypes)["key"]
    ddl = f"key {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("v").alias("dims")).count().filter("dims > 0").orderBy(F.desc("count"), F.desc("dims")).first()
    named = lambda df: df.withColumnRenamed("key", key)
    if common is None:
        return named(spark.createDataFrame([], ddl))
    dims = common["dims"]
    rows = rows.filter(F.size("v") == dims).select("key", lattice(F.col("v"), scale, offset).alias("x"))
    model = fit(rows, "x", dims, components)
    if model is None:
        return named(spark.createDataFrame([], ddl))
    m, keep = model.moments, len(model.values)
    error = float(np.abs(moments(rows, "x", dims, model.project).covariance - np.eye(keep)).max())
    explained = model.values / np.trace(m.covariance)

    def out(batches):
        sums = np.array(m.sums, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                x = matrix(part.column(1), dims)
                n, white = len(x), model.project(x)
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array(np.repeat(np.arange(n), keep))),
                    pa.array(np.tile(np.arange(1, keep + 1, dtype=np.int32), n)),
                    pa.array(np.full(n * keep, m.n)),
                    pa.array(deviations(x, m.n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(n), keep))),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, n)),
                    pa.array(np.full(n * keep, error)),
                ], names=["key", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return named(rows.mapInArrow(out, ddl))


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """For each row the sum over dimensions of ``(n * x - sums)**2``, exactly; None beyond a long."""
    rough = (np.abs(x.astype(float) * n - sums).max(1) + 1) ** 2 * x.shape[1]
    near = (rough < LONG / 4) & (np.abs(x).max(1).astype(float) * n < LONG / 4)
    out: list[int | None] = ((np.where(near[:, None], x, 0) * n - sums) ** 2).sum(1).tolist()
    for i in np.flatnonzero(~near):
        exact = sum((n * int(v) - int(s)) ** 2 for v, s in zip(x[i], sums))
        out[i] = exact if exact <= LONG else None
    return out
