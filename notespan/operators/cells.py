"""Search by cosine over rows that a coarse quantiser deals into cells: only cells that can hold a query's best rows are read.

The quantiser is fitted on a bounded sample. Each cell keeps how far its rows lie from its centre at
most, so a bound on the cosine of anything in a cell is known: with probes unset, a query first meets its
PROBES nearest cells, and then every other cell that could still beat the n-th best that it has; nothing
is lost. With probes set it meets so many cells alone, and what it may lose is measured (see tests).

Queries are a stated set. They go in blocks of a checked size; a task keeps the n best of its rows for
each query of a block, so what is shuffled is n rows a query and task, whatever the table's size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notespan.sources.work import written

#: Rows that the quantiser is fitted on, by hash; most cells; steps of the fit; cells that a query meets first.
SAMPLE, CELLS, STEPS, PROBES = 10_000, 256, 6, 4
#: Bytes of queries that are sent to every task; more go in blocks of so many. Rows that a worker compares at once.
QUERY_BYTES, ROWS = 8 << 20, 1024


def in_steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in steps of ROWS rows at most: what a worker holds follows these."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), ROWS):
            yield batch.slice(at, ROWS)


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows; null or of another length: zeros."""
    if not len(column):
        return np.empty((0, 0))
    lens = np.array([0 if x is None else len(x) for x in column.to_pylist()]) if column.null_count else np.diff(column.offsets.to_numpy())
    if column.null_count or (lens != lens[0]).any():
        d = int(lens.max())
        return np.array([x if x is not None and len(x) == d else [0.0] * d for x in column.to_pylist()], np.float64).reshape(len(column), d)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


@dataclass
class Cells:
    """centres: unit vectors; least: for each cell the smallest cosine of a row of it with its centre (1 without rows)."""

    centres: np.ndarray
    least: dict[int, float] = field(default_factory=dict)

    def dealt(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest cell of each row, and the cosine with its centre."""
        near = unit(x) @ self.centres.T
        cell = near.argmax(axis=1)
        return cell, near[np.arange(len(x)), cell]

    def most(self, queries: np.ndarray) -> np.ndarray:
        """For each query and cell, no less than the largest cosine with any row there; below -1 where there are none. Vectors of zeros have cosine 0 with all."""
        angle = np.arccos(np.clip(unit(queries) @ self.centres.T, -1, 1))
        known = np.array([self.least.get(c, np.nan) for c in range(len(self.centres))])
        reach = np.arccos(np.clip(np.nan_to_num(known, nan=1.0), -1, 1))
        out = np.cos(np.maximum(angle - reach, 0)) + 1e-9
        out[:, np.isnan(known)] = -2
        return out


def fitted(rows: DataFrame, cells: int | None = None) -> Cells:
    """Cells for a table with embedding: as many as a quarter of the root of its rows, CELLS at most."""
    n = rows.count()
    some = rows.select("embedding").where("embedding is not null").orderBy(F.xxhash64("embedding")).limit(SAMPLE).toArrow()
    x = unit(matrix(some.column("embedding").combine_chunks())) if some.num_rows else np.zeros((1, 1))
    x = np.unique(x[np.abs(x).sum(axis=1) > 0], axis=0)
    k = max(1, min(cells or round(n**0.5 / 4), CELLS, len(x)))
    if not len(x):
        return Cells(np.zeros((1, some.num_rows and matrix(some.column("embedding").combine_chunks()).shape[1] or 1)))
    centres = x[np.random.default_rng(5).permutation(len(x))[:k]]
    for _ in range(STEPS):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, unit(sums), centres)
    return Cells(centres)


def dealt(rows: DataFrame, cells: Cells) -> DataFrame:
    """rows with cell and near, the cosine with the cell's centre."""
    schema, names = rows.schema.simpleString()[len("struct<") : -1], rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_steps(batches):
            cell, near = cells.dealt(matrix(batch.column("embedding"))) if batch.num_rows else (np.empty(0), np.empty(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(near.astype(np.float64))], names=[*names, "cell", "near"])

    return rows.mapInArrow(run, f"{schema}, cell int, near double")


def reaches(rows: DataFrame) -> dict[int, float]:
    """The smallest cosine with its centre of each cell's rows: at most CELLS numbers."""
    return {r["cell"]: r["near"] for r in rows.groupBy("cell").agg(F.min("near").alias("near")).collect()}


FOUND = "q int, similarity double, page string, block_id string, document string"


def nearest(rows: DataFrame, queries: np.ndarray, wanted: np.ndarray | None, n: int) -> DataFrame:
    """The n best rows of each task for each query (by its place q): by similarity, then page and block_id. wanted: which cells (columns) each query meets; null: all rows."""
    norms = np.linalg.norm(queries, axis=1)
    if wanted is not None:
        rows = rows.where(F.col("cell").isin([int(c) for c in np.flatnonzero(wanted.any(axis=0))]))
    columns = [c for c in ("page", "block_id", "document", "embedding", "cell") if c in rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list] = {}
        for batch in in_steps(batches):
            if not batch.num_rows:
                continue
            x = matrix(batch.column("embedding"))
            long = np.linalg.norm(x, axis=1)
            cell = batch.column("cell").to_numpy(zero_copy_only=False) if wanted is not None else np.zeros(len(x), int)
            for c in np.unique(cell):
                asked = np.flatnonzero(wanted[:, c]) if wanted is not None else np.arange(len(queries))
                at = np.flatnonzero(cell == c)
                if not len(asked):
                    continue
                scale = long[at][:, None] * norms[asked][None]
                value = np.divide(x[at] @ queries[asked].T, scale, out=np.zeros(scale.shape), where=scale > 0)
                least = np.partition(value, len(at) - n, axis=0)[len(at) - n] if len(at) > n else np.full(len(asked), -np.inf)
                for j, q in enumerate(asked):
                    own = at[value[:, j] >= least[j]]
                    names = zip(*(batch.column(k).take(pa.array(own)).to_pylist() for k in ("page", "block_id", "document")), strict=True)
                    pool = best.setdefault(int(q), [])
                    pool += [(-v, p or "", b or "", d) for v, (p, b, d) in zip(value[value[:, j] >= least[j], j].tolist(), names, strict=True)]
                    if len(pool) > n:
                        best[int(q)] = heapq.nsmallest(n, pool, key=lambda r: r[:3])
        for q, pool in best.items():
            pool = heapq.nsmallest(n, pool, key=lambda r: r[:3])
            cols = list(zip(*pool, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([q] * len(pool), pa.int32()), pa.array([-v for v in cols[0]], pa.float64()), *(pa.array(c, pa.string()) for c in cols[1:])], names=["q", "similarity", "page", "block_id", "document"])

    return rows.select(*columns).mapInArrow(run, FOUND)


def best_of(found: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("similarity"), "page", "block_id")
    return found.withColumn("fetched", F.row_number().over(w)).where(F.col("fetched") <= n)


def searched(rows: DataFrame, asked: DataFrame, n: int, cells: Cells | None = None, probes: int | None = None) -> DataFrame:
    """query_id, links, page, block_id, document, similarity and fetched (from 1) of the n best rows for each query (query_id, links, embedding).

    rows: page, block_id, document, embedding and, with cells, cell.
    """
    spark = asked.sparkSession
    asked = written(asked)
    size = asked.agg(F.coalesce(F.sum(F.size("embedding") * 8 + 64), F.lit(0)).alias("n")).first()["n"]
    parts, out = max(1, -(-size // QUERY_BYTES)), []
    for part in range(parts):
        block = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == part).toArrow()
        if not block.num_rows:
            continue
        vectors = matrix(block.column("embedding").combine_chunks())
        if cells is None:
            found = nearest(rows, vectors, None, n)
        else:
            most = cells.most(vectors)
            first = np.argsort(-most, axis=1, kind="stable")[:, : probes or PROBES]
            wanted = np.zeros(most.shape, bool)
            np.put_along_axis(wanted, first, True, axis=1)
            wanted &= most >= -1
            found = written(nearest(rows, vectors, wanted, n))
            if probes is None:
                have = best_of(found, n).groupBy("q").agg(F.count("*").alias("n"), F.min("similarity").alias("least")).where(F.col("n") == n).collect()
                least = np.full(len(vectors), -1.0)
                for r in have:
                    least[r["q"]] = r["least"]
                rest = (most >= least[:, None]) & (most >= -1) & ~wanted
                if rest.any():
                    found = found.union(nearest(rows, vectors, rest, n))
        names = block.drop_columns(["embedding"]).append_column("q", pa.array(range(block.num_rows), pa.int32()))
        out.append(written(best_of(found, n).join(F.broadcast(spark.createDataFrame(names)), "q").drop("q")))
    if not out:
        return asked.join(spark.createDataFrame([], FOUND).withColumn("fetched", F.lit(1)), F.lit(False)).drop("q", "embedding")
    return reduce(DataFrame.unionByName, out)
