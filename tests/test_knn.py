"""The nearest rows by blocks, held against all pairs by Spark's own expressions."""

import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from notespan.jobs import knn


def all_pairs(queries, rows, k):
    q = queries.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.col("norm").alias("q_norm"), F.col("label").alias("q_label"))
    length = F.col("q_norm") * F.col("norm")
    dot = knn.dot(F.col("q"), F.col("embedding"))  # null where lengths differ
    similarity = F.round(F.when(dot.isNotNull() & (length == 0), float("nan")).otherwise(dot / F.nullif(length, F.lit(0.0))), 6)
    both = rows.crossJoin(q).where("vec_id != query_id").select("query_id", "q_label", "vec_id", "label", similarity.alias("similarity"))
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return both.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shown(df):
    return sorted(str(tuple(r[c] for c in ("query_id", "q_label", "vec_id", "label", "similarity", "rank"))) for r in df.collect())


def with_norms(spark, rows):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1)
    return v.withColumn("norm", F.sqrt(knn.dot(F.col("embedding"), F.col("embedding"))))


def test_blocks_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROW_BYTES", 3000)
    monkeypatch.setattr(knn, "QUERY_BYTES", 500)
    monkeypatch.setattr(knn, "PAIRS", 200)
    own = random.Random(4)
    rows = [(i, [float(own.randint(-3, 3)) for _ in range(4)], i % 3) for i in range(400)]  # few values: many ties and copies, some zeros
    odd = [(401, None, 1), (420, None, 1), (440, [1.0, None, 2.0, 0.0], None), (403, [1.0, 2.0], 0), (460, [2.0, 1.0], 0), (480, [float("nan"), 1.0, 0.0, 0.0], 2), (500, [], 2), (20, [1.0, 1.0, 0.0, 0.0], 5), (None, [1.0, 0.0, 0.0, 0.0], 1)]
    table = with_norms(spark, rows + odd).persist()
    assert knn.asked(table).count() == 26
    for k in (3, 12):
        assert shown(knn.nearest(knn.asked(table), table, k)) == shown(all_pairs(knn.asked(table), table, k))
    few = table.where("vec_id >= 440")
    assert shown(knn.nearest(knn.asked(few), few, 10)) == shown(all_pairs(knn.asked(few), few, 10))
    assert knn.nearest(knn.asked(table.limit(0)), table.limit(0), 3).count() == 0


def test_a_block_keeps_k_rows_of_a_query_whatever_it_holds(spark):
    import pyarrow as pa

    x = np.random.default_rng(1).normal(size=(3000, 8)).astype(np.float32)
    x[1000:] = x[0]  # copies
    t = pa.table({"vec_id": np.arange(3000), "embedding": pa.array(list(x)), "label": np.zeros(3000, np.int32), "norm": np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))})
    q = t.slice(0, 40).rename_columns(["query_id", "q", "q_label", "q_norm"])
    got = knn.best_pairs(q, t, 5)
    assert got.num_rows == 40 * 5
    assert got.filter(pa.compute.equal(got.column("query_id"), 0)).column("vec_id").to_pylist() == [1000, 1001, 1002, 1003, 1004]


def test_millionths_round_as_spark(spark):
    x = [0.1234565, 0.1234575, -0.1234565, 0.0000005, 0.9999995, 0.123456499999, 1.0, -0.0000004, 0.3333335, 0.6666665]
    got = spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("r")).collect()
    assert [r["r"] for r in got] == (knn.millionths(np.array(x)) / 1e6).tolist()
