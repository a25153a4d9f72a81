"""Approximate nearest neighbours with a permutation index.

Each vector is represented by the order in which it sees the pivots, nearest first, and posted in the
inverted files of its nearest pivots. A query reads the files of its own nearest pivots, ranks what
is posted there by footrule distance (the sum of how far apart the two orders place each pivot), and
ranks the best of each file again by cosine, in double precision, on the vectors themselves.

The pivots come from a bounded sample of the rows, by hash of the id; every row is posted. A file of
many rows is split into blocks, and its queries are sent to each, so one vector that a third of all
rows share fills many small blocks; equal vectors in a block count once, with their smallest ids.

Vectors that are null, zero, of another length than most, or that hold nulls or non-finite numbers
take no part. An empty table, or one vector alone, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notespan.llm.common import table

#: Pivots, and rows that they are chosen from.
PIVOTS, SAMPLE = 128, 4096
#: Files that a row is posted in, and files that a query reads.
POSTED, READ = 8, 20
#: Rows of a block of a file, and rows of a block that are ranked again.
BLOCK, AGAIN = 8192, 256
NEAREST = 5


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    own = vectors.select(F.col("vec_id").cast("long"), v.alias("embedding")).where("vec_id is not null and embedding is not null")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    own = own.where(~F.exists("embedding", bad) & F.exists("embedding", lambda x: x != 0))
    lens = own.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return own.where(F.size("embedding") == (lens["n"] if lens else 0))


def matrix(batch: pa.RecordBatch) -> np.ndarray:
    flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, 1))


def unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def pivots(vectors: DataFrame) -> np.ndarray:
    few = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not few:
        return np.empty((0, 1))
    v = np.array([r["embedding"] for r in few])
    _, first = np.unique(v, axis=0, return_index=True)
    return unit(v[np.sort(first)[:PIVOTS]])


def seen_from(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The pivots in order, nearest first, of each vector."""
    return np.argsort(-(unit(v) @ at.T), axis=1, kind="stable")


GROUP = "file int, ids binary, orders binary, vectors binary, query_ids binary, query_orders binary, query_vectors binary"


def search(vectors: DataFrame, is_query: Column, k: int = NEAREST) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest rows found for each row that is_query picks, without itself."""
    own = valid(vectors).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    at = pivots(own)
    n_pivots = len(at)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_pivots, np.int64)
        for batch in batches:
            total += np.bincount(seen_from(matrix(batch), at)[:, :POSTED].ravel(), minlength=n_pivots)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_pivots)), pa.array(total)], names=["pivot", "n"])

    filled = {r["pivot"]: r["n"] for r in own.select("embedding").mapInArrow(counts, "pivot long, n long").groupBy("pivot").agg(F.sum("n").alias("n")).collect()} if n_pivots else {}
    blocks = np.array([max(1, -(-filled.get(p, 0) // BLOCK)) for p in range(n_pivots)], np.int64)
    first = np.concatenate([[0], np.cumsum(blocks)])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v, ids = matrix(batch), batch.column("vec_id").to_numpy()
            order = seen_from(v, at)
            place = np.empty_like(order, dtype=np.uint8)
            np.put_along_axis(place, order, np.arange(n_pivots, dtype=np.uint8)[None, :], axis=1)
            near = order[:, :POSTED]
            salt = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            files = first[near] + (salt[:, None].astype(np.int64) % blocks[near])
            rows = np.repeat(np.arange(len(ids)), near.shape[1])
            files = files.ravel()
            out: dict[int, list[np.ndarray]] = {}
            by = np.argsort(files, kind="stable")
            cuts = np.flatnonzero(np.diff(files[by], prepend=-1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(by)], strict=True):
                out[int(files[by[a]])] = [rows[by[a:b]], np.empty(0, np.int64)]
            asks: dict[int, list[int]] = {}
            for q in np.flatnonzero(batch.column("is_query").to_numpy(zero_copy_only=False)).tolist():
                for p in order[q, :READ].tolist():
                    for f in range(first[p], first[p + 1]):
                        asks.setdefault(f, []).append(q)
            for f, qs in asks.items():
                out.setdefault(f, [np.empty(0, np.int64)] * 2)[1] = np.array(qs)
            parts = [[x for r in (m, q) for x in (ids[r].astype(np.int64).tobytes(), place[r].tobytes(), v[r].tobytes())] for m, q in out.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int32()), *(pa.array([p[c] for p in parts], pa.binary()) for c in range(6))], names=["file", "ids", "orders", "vectors", "query_ids", "query_orders", "query_vectors"])

    def rank(group: pa.Table) -> pa.Table:
        load = lambda name, kind, width: np.frombuffer(b"".join(group.column(name).to_pylist()), kind).reshape(-1, width) if width else np.frombuffer(b"".join(group.column(name).to_pylist()), kind)
        ids, queries, width = load("ids", np.int64, 0), load("query_ids", np.int64, 0), at.shape[1]
        v, places = load("vectors", np.float64, width), load("orders", np.uint8, n_pivots).astype(np.int16)
        asked, asked_places = load("query_vectors", np.float64, width), load("query_orders", np.uint8, n_pivots).astype(np.int16)
        found: list[tuple[int, int, float]] = []
        if len(ids) and len(queries):
            by = np.argsort(ids, kind="stable")
            ids, v, places = ids[by], v[by], places[by]
            _, lead, same = np.unique(v, axis=0, return_index=True, return_inverse=True)
            same = same.ravel()
            copies: list[list[int]] = [[] for _ in lead]
            for i, c in zip(ids.tolist(), same.tolist(), strict=True):
                if len(copies[c]) <= k:
                    copies[c].append(i)
            by = np.argsort(lead)
            lead, copies = lead[by], [copies[i] for i in by]
            v, places = v[lead], places[lead]
            norm = np.sqrt((v * v).sum(axis=1))
            for q, x, p in zip(queries.tolist(), asked, asked_places, strict=True):
                apart = np.abs(places - p).sum(axis=1, dtype=np.int32)
                best = np.argsort(apart, kind="stable")[:AGAIN]
                score = (v[best] * x).sum(axis=1) / (norm[best] * np.sqrt((x * x).sum()))
                rows = []
                for j in np.argsort(-score, kind="stable"):
                    if len(rows) >= k and -score[j] > rows[k - 1][0]:
                        break
                    rows = sorted(rows + [(-score[j], i) for i in copies[best[j]] if i != q])
                found += [(q, i, -s) for s, i in rows[:k]]
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    if not n_pivots:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    near = own.select("vec_id", "embedding", "is_query").mapInArrow(post, GROUP).groupBy("file").applyInArrow(rank, "query_id long, vec_id long, score double")
    by_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
