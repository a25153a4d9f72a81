"""Connected components of a graph given as a table of links, in a number of rounds that grows with the logarithm of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notespan.llm.common import remove, work_folder


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root from a, b: the smallest node that each linked node is connected with.

    Alternates two steps until nothing changes: each node's larger neighbours are linked to its
    smallest neighbour, then each node and its smaller neighbours are. Nodes with many neighbours
    cost a partial aggregate and a join, no group in one task. Every round is written to the shared
    folder, so a lost executor costs one round at most. No links: no rows.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before, path = None, ""
    for _ in range(most_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        new = work_folder(spark)
        small.write.parquet(new)
        if path:
            remove(spark, path)
        path = new
        edges = spark.read.schema("u long, v long").parquet(path)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("s")).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", F.col("v").alias("root"))).distinct()
