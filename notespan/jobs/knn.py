"""Cosine search over stored vectors: each query's nearest rows, over-fetched, boosted by links and cut."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notespan.functions.columns import relevance

#: Rows fetched for each row wanted, and what a link to the query's page multiplies a similarity by.
OVERFETCH, LINK_BOOST = 3, 1.5
#: The queries of the registered searches: the vectors whose id this divides.
EVERY = 20
#: Bytes of rows and of queries in a block: a task compares two blocks.
ROW_BYTES, QUERY_BYTES = 4 << 20, 8 << 20
#: Pairs of a query and a row whose similarity is held at once.
PAIRS = 1 << 20
#: What stands for the similarity of a pair without one, which comes last, and for one that is no number, which comes first.
NONE, NO_NUMBER = -1e300, 1e300


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    return v.withColumn("norm", F.sqrt(dot(F.col("embedding"), F.col("embedding"))))


def millionths(x: np.ndarray) -> np.ndarray:
    """Numbers in millionths, rounded as Spark rounds them: halves, of the shortest decimal, away from 0."""
    size = np.abs(x) * 1e6
    out = np.floor(size + 0.5)
    for i in np.flatnonzero(np.abs(size - np.floor(size) - 0.5) < 1e-4):
        out[i] = int(Decimal(repr(float(abs(x[i])))).scaleb(6).to_integral_value(ROUND_HALF_UP))
    return np.copysign(out, x)


def by_length(vectors: pa.ChunkedArray, norms: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length, which vectors have it and the vectors. Those without a norm (null, or with a null inside) are left out."""
    known = np.flatnonzero(~np.isnan(norms))
    own = vectors.take(pa.array(known)).combine_chunks()
    lens = np.diff(own.offsets.to_numpy())
    flat, first = own.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(lens) - lens
    return {int(n): (known[lens == n], flat[first[lens == n][:, None] + np.arange(n)]) for n in np.unique(lens)}


def without_copies(ids: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    """Which rows, of each vector, have one of the n smallest ids; ids are sorted."""
    _, kind = np.unique(x, axis=0, return_inverse=True)
    order = np.argsort(kind.ravel(), kind="stable")
    kind, own = kind.ravel()[order], ids[order]
    begins = np.diff(kind, prepend=-1) != 0
    place = np.cumsum(begins | (np.diff(own, prepend=own[:1]) != 0))
    return np.sort(order[place - np.maximum.accumulate(np.where(begins, place, 0)) < n])


FOUND = "query_id long, q_label int, vec_id long, label int, similarity double"


def best_pairs(queries: pa.Table, rows: pa.Table, n: int) -> pa.Table:
    """The n nearest of some rows for each of some queries: by similarity in millionths, then vec_id. Similarities are Spark's own: sums in the order of the numbers."""
    rows = rows.combine_chunks().sort_by("vec_id")
    q_ids, ids = (t.column(c).to_numpy() for t, c in ((queries, "query_id"), (rows, "vec_id")))
    q_norms, norms = (np.where(c.is_null(), np.nan, np.nan_to_num(c.to_pandas(), nan=np.inf)) for c in (queries.column("q_norm"), rows.column("norm")))
    asked, given = by_length(queries.column("q"), q_norms), by_length(rows.column("embedding"), norms)
    without = np.isnan(norms)
    out: list[tuple] = []

    def chosen(q: np.ndarray, r: np.ndarray, value: np.ndarray) -> None:
        """Of pairs those with the n best values of each query."""
        key = np.where(np.abs(value) < NO_NUMBER, millionths(value), value)
        order = np.lexsort((r, -key, q))
        q, r, value = q[order], r[order], value[order]
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        fine = np.arange(len(q)) - np.repeat(begin, np.diff(np.append(begin, len(q)))) < n
        out.append((q[fine], r[fine], value[fine]))

    for length, (at, x) in given.items():
        if length not in asked:
            continue
        kept = without_copies(ids[at], x, n + 1)
        at, x = at[kept], x[kept]
        whole = np.isfinite(x).all(axis=1) & (norms[at] > 0)
        unit = np.divide(x, norms[at][:, None], out=np.zeros_like(x), where=whole[:, None])
        q_at, y = asked[length]
        for part in range(0, len(q_at), step := max(1, PAIRS // len(at))):
            own, v = q_at[part : part + step], y[part : part + step]
            q_whole = np.isfinite(v).all(axis=1) & (q_norms[own] > 0)
            near = np.divide(v, q_norms[own][:, None], out=np.zeros_like(v), where=q_whole[:, None]) @ unit.T
            near[~q_whole] = NO_NUMBER
            near[:, ~whole] = NO_NUMBER
            low, high = np.searchsorted(ids[at], q_ids[own]), np.searchsorted(ids[at], q_ids[own], "right")
            for i in np.flatnonzero(high > low):
                near[i, low[i] : high[i]] = -np.inf
            least = np.partition(near, len(at) - n, axis=1)[:, len(at) - n] if len(at) > n else np.full(len(own), -np.inf)
            i, j = np.nonzero((near >= least[:, None] - 2e-6) & (near > -np.inf))
            total = np.zeros(len(i))
            with np.errstate(all="ignore"):
                for k in range(length):
                    total += v[i, k] * x[j, k]
                value = total / (q_norms[own[i]] * norms[at[j]])
            chosen(own[i], at[j], np.where(np.isnan(value), NO_NUMBER, value))
    # Pairs without a similarity come last: the n smallest ids that a query has none with.
    for length, (own, _) in [*asked.items(), (None, (np.flatnonzero(np.isnan(q_norms)), None))]:
        other = np.ones(len(ids), bool) if length is None else without.copy()
        for size, (at, _) in given.items():
            other[at] = length is None or size != length
        first = np.flatnonzero(other)
        first = first[: np.searchsorted(ids[first], np.unique(ids[first])[: n + 1][-1], "right")] if len(first) else first
        q, r = np.repeat(own, len(first)), np.tile(first, len(own))
        fine = q_ids[q] != ids[r]
        if fine.any():
            chosen(q[fine], r[fine], np.full(fine.sum(), NONE))
    q, r, value = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))
    similarity = pa.array(np.where(value == NO_NUMBER, np.nan, value), pa.float64(), mask=value == NONE, from_pandas=False)
    named = lambda t, c, k: t.column(c).take(pa.array(k)).combine_chunks()
    return pa.table({"query_id": named(queries, "query_id", q), "q_label": named(queries, "q_label", q), "vec_id": named(rows, "vec_id", r), "label": named(rows, "label", r), "similarity": similarity})


def nearest(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """query_id, q_label, vec_id, label, similarity and rank (1 to k) of each query's nearest rows but itself.

    All queries meet all rows, so the time grows with the product; a task compares a block of either and
    keeps k rows for each query, so what is shuffled grows with the blocks alone.
    """
    size = lambda df, v: df.agg(F.coalesce(F.sum(F.coalesce(F.size(v), F.lit(0)) * 4 + 32), F.lit(0)).alias("n")).first()["n"]
    rows = rows.where("vec_id is not null").select(F.col("vec_id").cast("long"), "embedding", F.col("label").cast("int"), "norm")
    queries = queries.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("query_id"), F.col("embedding").alias("q"), F.col("label").cast("int").alias("q_label"), F.col("norm").alias("q_norm"))
    n_rows, n_queries = max(1, -(-size(rows, "embedding") // ROW_BYTES)), max(1, -(-size(queries, "q") // QUERY_BYTES))
    other = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("a", F.pmod(F.xxhash64("query_id"), F.lit(n_queries))).withColumn("b", other(n_rows))
    right = rows.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(n_rows))).withColumn("a", other(n_queries))
    pair = (F.col("a") * n_rows + F.col("b")).cast("long").alias("pair")
    left, right = left.select(pair, "query_id", "q", "q_label", "q_norm"), right.select(pair, "vec_id", "embedding", "label", "norm")

    none = pa.schema([("query_id", pa.int64()), ("q_label", pa.int32()), ("vec_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]).empty_table()

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        return best_pairs(queries, rows, k) if queries.num_rows and rows.num_rows else none

    found = left.groupBy("pair").cogroup(right.groupBy("pair")).applyInArrow(run, FOUND).withColumn("similarity", F.round("similarity", 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def asked(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("vec_id") % EVERY == 0)


def knn_topk(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    rows = vectors(spark, sf_dir)
    return nearest(asked(rows), rows, k).select("query_id", F.col("rank").cast("long"), "vec_id", "similarity")


SCORED = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, label FROM embeddings),
q AS (SELECT * FROM v WHERE vec_id % {EVERY} = 0),
s AS (SELECT q.vec_id AS query_id, q.label AS q_label, v.vec_id, v.label, round(list_cosine_similarity(q.e, v.e), 6) AS similarity FROM q JOIN v ON q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS rank FROM s)
"""
KNN_TOPK = SCORED + "SELECT query_id, rank, vec_id, similarity FROM r WHERE rank <= 10"


def boosted(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Three times as many rows as wanted; those with the query's label count as linked; then the best k by the raised score."""
    rows = vectors(spark, sf_dir)
    near = nearest(asked(rows), rows, k * OVERFETCH)
    micro = F.round(F.col("similarity") * 1e6).cast("long")  # whole numbers, so that raised scores and their sums are exact
    boost = F.when(F.col("label") == F.col("q_label"), F.lit(int(LINK_BOOST * 10))).otherwise(F.lit(10))
    return near.withColumnRenamed("rank", "fetched").withColumn("score", micro * boost)


BOOSTED = SCORED + f"""
, f AS (SELECT *, CAST(round(similarity * 1e6) AS BIGINT) * CASE WHEN label = q_label THEN {int(LINK_BOOST * 10)} ELSE 10 END AS score FROM r WHERE rank <= {10 * OVERFETCH}),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS place FROM f)
"""


def reranked(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "fetched")
    return boosted(spark, sf_dir, k).withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def knn_overfetch_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir).select("query_id", "rank", "vec_id", (F.col("score") / 1e7).alias("score"))


KNN_OVERFETCH_RERANK = BOOSTED + "SELECT query_id, place AS rank, vec_id, score / 1e7 AS score FROM t WHERE place <= 10"


def knn_label_score_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages (labels) by the sum of their rows' scores."""
    return boosted(spark, sf_dir).groupBy("query_id", "label").agg((F.sum("score") / 1e7).alias("score"), F.count("*").alias("n"))


KNN_LABEL_SCORE_SUM = BOOSTED + "SELECT query_id, label, CAST(sum(score) AS BIGINT) / 1e7 AS score, count(*) AS n FROM f GROUP BY query_id, label"


def rank_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = reranked(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    return best.select("query_id", "rank", relevance(F.col("rank") - 1, F.col("n")).alias("percent"))


RANK_RELEVANCE = BOOSTED + "SELECT query_id, place AS rank, greatest(50, 100 - (place - 1) * (50 // count(*) OVER (PARTITION BY query_id))) AS percent FROM t WHERE place <= 10"


def reverse_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shown worst first, so that the best stands last as number 1."""
    best = reranked(spark, sf_dir)
    w = Window.partitionBy("query_id").orderBy(F.desc("rank"))
    return best.select("query_id", "vec_id", F.row_number().over(w).cast("long").alias("line"), F.col("rank").alias("number"))


REVERSE_NUMBERING = BOOSTED + "SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id ORDER BY place DESC) AS line, place AS number FROM t WHERE place <= 10"
