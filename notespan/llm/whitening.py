"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows.

Vectors become whole numbers, x = floor(64 c) + 1000000, so that sums of them are exact. The fit list
has each different x once. With X the fit list less its means, each step makes one pass over it: a task
works out its rows of p = X q and of the earlier left vectors U = X W, and adds up X'p, U'p and p'p.
From these sums the driver, which holds nothing longer than a few vectors of the dimension, takes the
earlier left vectors out of p, gets X'u from the same sums, and takes all earlier right vectors out of
that (twice). Left vectors are as long as the fit list and are never stored: each is X times a short
vector w. The singular values of the small bidiagonal matrix give the deviations, its right vectors the
components. All dimensions are stepped through up to FULL, which finds repeated values as well; for
longer vectors steps end when the wanted components have settled.

A pass is a stateless job over a written table, so a lost executor costs its tasks alone; sums of
tasks are put together by Spark by place.

Rows whose vector is null, empty, or holds null or non-finite entries drop out, as do vectors of another
length than most (of two lengths equally frequent, the longer stays). A null vec_id is kept, and repeated
rows are each returned. Entries of over 2^40 count as 2^40. Components without variance have no rows, so
one different vector, or none, gives none. A deviation that a long can't hold is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.llm.common import table, work_folder

SCALE, SHIFT, LARGEST = 64.0, 1_000_000, float(1 << 40)
COMPONENTS = 16
#: So many dimensions are stepped through in any case; a longer vector's steps end when the wanted components have settled to SETTLED.
FULL, SETTLED = 256, 1e-13
#: Variance below this share of the largest is none.
NONE = 1e-12


def whole_numbers(vector: Column) -> Column:
    """x of a vector."""
    return F.transform(vector, lambda c: F.floor(F.greatest(F.least(F.lit(SCALE) * c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))).cast("long") + SHIFT)


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and x of the rows that take part."""
    inf = float("inf")
    fine = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < inf)
    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("embedding").alias("_v")).where(F.col("_v").isNotNull() & (F.size("_v") > 0) & F.forall("_v", fine))
    rows = rows.select("vec_id", whole_numbers(F.col("_v")).alias("x"))
    size = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return rows.where(F.size("x") == (size["d"] if size else 0))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    own = batch.column("x")
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)


def added(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
    """part of every batch of rows, added up over all: within a task, then by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            if batch.num_rows:
                new = part(matrix(batch)).ravel()
                own = new if own is None else own + new
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], names=["place", "value"])

    rows = fit.select("x").mapInArrow(run, f"place int, value {kind}").groupBy("place").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(len(rows), np.int64 if kind == "long" else np.float64)
    for r in rows:
        out[r["place"]] = r["value"]
    return out


@dataclass
class Fit:
    """n different vectors with sums s; values and vectors: variances, falling, and components as columns; trace: of the covariance; error: see identity_error."""

    n: int
    s: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0


def bidiagonal(fit: DataFrame, mean: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of the centred rows, falling, and right singular vectors as columns."""
    d = len(mean)
    random = np.random.default_rng(13)

    def apart(r: np.ndarray, v: np.ndarray) -> np.ndarray:
        """r without what it has of the columns of v; twice, as the first time leaves a remainder."""
        for _ in range(2):
            r = r - v @ (v.T @ r)
        return r

    def fresh(v: np.ndarray) -> np.ndarray:
        r = apart(random.standard_normal(d), v)
        return r / np.linalg.norm(r)

    v, w, g = np.empty((d, 0)), np.empty((d, 0)), np.empty((d, 0))  # right vectors, left ones as X w, and X' of the left ones
    alphas, betas, top = [], [], 0.0
    new = fresh(v)
    while True:
        v = np.column_stack([v, new])
        k = v.shape[1]
        q = new - betas[-1] * w[:, -1] if betas else new

        def sums(x: np.ndarray, short: np.ndarray = np.column_stack([w, q])) -> np.ndarray:
            own = x - mean
            left = own @ short
            p = left[:, -1]
            return np.concatenate([own.T @ p, left.T @ p])

        got = added(fit, sums)
        c, square = got[d : d + k - 1], got[-1]
        alpha = float(np.sqrt(max(square - c @ c, 0.0)))
        top = max(top, alpha, betas[-1] if betas else 0.0)
        if alpha <= 1e-10 * top or alpha == 0:  # nothing new that X can see this way
            alpha, u, back = 0.0, np.zeros(d), np.zeros(d)
        else:
            u, back = (q - w @ c) / alpha, (got[:d] - g @ c) / alpha
        w, g = np.column_stack([w, u]), np.column_stack([g, back])
        alphas.append(alpha)
        if k == d:
            break
        r = apart(back - alpha * new, v)
        beta = float(np.linalg.norm(r))
        if beta <= 1e-10 * top or beta == 0:  # these vectors are closed: go on with one that is apart from all
            beta, new = 0.0, fresh(v)
        else:
            new = r / beta
        if d > FULL and k >= wanted and beta > 0:
            left, values, _ = np.linalg.svd(np.diag(alphas) + np.diag(betas, 1))
            if (beta * np.abs(left[-1, :wanted]) <= SETTLED * values[0]).all():
                break
        betas.append(beta)
    _, values, right = np.linalg.svd(np.diag(alphas) + np.diag(betas[: len(alphas) - 1], 1))
    return values, v @ right.T


def fitted(rows: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Means, components and deviations of the different vectors of rows (x); null if there are none. The fit list is written once."""
    spark, path = rows.sparkSession, work_folder(rows.sparkSession)
    rows.select("x").distinct().write.mode("overwrite").parquet(path)
    fit = spark.read.schema("x array<long>").parquet(path)
    sums = added(fit, lambda x: np.append(x.sum(axis=0), len(x)), "long")
    if not len(sums):
        return None
    s, n = sums[:-1], int(sums[-1])
    mean = s / n
    trace = float(added(fit, lambda x: np.array([((x - mean) ** 2).sum()]))[0]) / n
    values, vectors = bidiagonal(fit, mean, components)
    values = values**2 / n
    keep = np.flatnonzero(values > max(NONE * values[0], 0))[:components]
    out = Fit(n, s, values[keep], vectors[:, keep], trace)
    out.error = identity_error(fit, out)
    return out


def identity_error(fit: DataFrame, f: Fit) -> float:
    """The largest absolute entry of the covariance of the whitened fit list less the identity."""
    k = len(f.values)
    if not k:
        return 0.0
    mean, short = f.s / f.n, f.vectors / np.sqrt(f.values)

    def sums(x: np.ndarray) -> np.ndarray:
        y = (x - mean) @ short
        return np.concatenate([(y.T @ y).ravel(), y.sum(axis=0)])

    got = added(fit, sums) / f.n
    return float(np.abs(got[: k * k].reshape(k, k) - np.outer(got[k * k :], got[k * k :]) - np.eye(k)).max())


def deviations(x: np.ndarray, f: Fit) -> list[int | None]:
    """For each row, the exact sum of (n x - s)^2; whole numbers of any length where a long could overflow."""
    bound = int(np.abs(x).max(initial=0)) * f.n + int(np.abs(f.s).max(initial=0))
    if bound < 1 << 62:
        far = x * f.n - f.s
        if int(np.abs(far).max(initial=0)) ** 2 * x.shape[1] < 1 << 62:
            return (far * far).sum(axis=1).tolist()
    s = [int(v) for v in f.s]
    out = [sum((f.n * a - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in out]


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """One row for each remaining vector and component: how far it lies along it, in standard deviations; how much the component explains."""
    rows = usable(embeddings)
    f = fitted(rows, components)
    if f is None or not len(f.values):
        return embeddings.sparkSession.createDataFrame([], WHITENED)
    k = len(f.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, short = f.s / f.n, f.vectors / np.sqrt(f.values)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch)
            m = len(x)
            every = np.repeat(np.arange(m), k)
            ids = batch.column("vec_id").take(pa.array(every))
            far = pa.array(deviations(x, f), pa.int64()).take(pa.array(every))
            along = np.einsum("ij,jk->ik", x - mean, short)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, f.n, np.int64)), far, pa.array(along.ravel()), pa.array(np.tile(f.values / f.trace, m)), pa.array(np.full(m * k, f.error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, WHITENED)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings"))
