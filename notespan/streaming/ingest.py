"""New files of a growing folder, as a stream. Rewritten and deleted files are no part of it; the batch job in jobs/index.py finds those."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notespan.functions import columns as C
from notespan.operators import chunks, outline

FILES = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    raw = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.md").load(folder)
    return raw.select(C.display_name(F.regexp_extract("path", r"([^/]+)\.md$", 1)).alias("page"), F.regexp_replace(F.decode("content", "utf-8"), "\r\n?", "\n").alias("text"), F.col("modificationTime").alias("mtime"))


def ingest(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Appends the blocks of new files to a table, each batch to a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        chunks.block_chunks(outline.contexts(outline.parsed(batch))).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return new_files(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
