"""Tables that follow a stream: the blocks of a folder as files are written, rewritten and deleted, and the list of decisions that all blocks share.

Each micro-batch becomes one version of a Store, with the batch's number among its facts, so a batch that
is run again after a failure adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notespan.operators import chunks, outline
from notespan.operators.store import Store
from notespan.sources import folder as notes
from notespan.sources.work import work_folder, written


def replaced(store: Store, number: int, rows: DataFrame, keys: DataFrame) -> None:
    """Commits a micro-batch, unless an earlier run of it did."""
    while True:
        old = store.version()
        if old is not None and old.facts["batch"] >= number:
            return
        if store.commit(store.after(old, 1, rows, keys, {"batch": number})):
            return


BLOCKS = "chunk_id string, page string, block_id string, chunk_seq int, document string"


def blocks_of(spark: SparkSession, table: str) -> Store:
    return Store(spark, table, "page", BLOCKS)


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str) -> StreamingQuery:
    """Brings the blocks of a folder's files, kept as a Store, up to date with it, then ends. Rewritten files replace their blocks, deleted ones lose them."""
    notes.register(spark)
    files = spark.readStream.format("notes").option("path", folder).option("state", f"{checkpoint}/listings").load()

    def write(batch: DataFrame, number: int) -> None:
        batch = written(batch.select("page", "text", "state"))
        rows = chunks.block_chunks(outline.contexts(outline.parsed(batch.where("state != 'deleted'"))))
        replaced(blocks_of(spark, table), number, rows, batch)

    return files.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/query").trigger(availableNow=True).start()


DECISION = "seq long, knowledge_block_id string, target_page string, action string, target_block_id string"
KEY = ["target_page", "action", "target_block_id"]


def key_digest() -> Column:
    """One name for a page, an action and a target; a missing one differs from an empty one."""
    return F.md5(F.to_json(F.struct(*KEY), {"ignoreNullFields": "false"}))


def shared_decisions(spark: SparkSession, folder: str, out: str, checkpoint: str, files: int = 1) -> None:
    """Follows decisions that arrive as Parquet files (DECISION and done: whether its block has no more), so many files a batch, until there are no more.

    The first decision for each page, action and target is kept, by seq, whichever block it is of and in
    whatever batch it comes; how many decisions each block has given and whether it is done, beside them. Both are
    streaming aggregates: their state is in the state store, and a batch is aggregated before it is shuffled, so
    a decision that very many blocks make costs one row a task.
    """
    events = lambda: spark.readStream.schema(f"{DECISION}, done boolean").option("maxFilesPerTrigger", files).parquet(folder)
    first = events().groupBy(key_digest().alias("key")).agg(F.min_by(F.struct("seq", "knowledge_block_id", *KEY), F.struct("seq", "knowledge_block_id")).alias("d")).select("key", "d.*")
    ready = events().groupBy("knowledge_block_id").agg(F.count("*").alias("n"), F.bool_or(F.coalesce("done", F.lit(False))).alias("ready"))
    for name, rows, store in (("first", first, decisions_of(spark, out)), ("ready", ready, blocks_ready(spark, out))):

        def write(batch: DataFrame, number: int, store: Store = store) -> None:
            batch = written(batch)
            replaced(store, number, batch, batch)

        rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start().awaitTermination()


def decisions_of(spark: SparkSession, out: str) -> Store:
    return Store(spark, f"{out}/decisions", "key", f"key string, {DECISION}")


def blocks_ready(spark: SparkSession, out: str) -> Store:
    return Store(spark, f"{out}/blocks", "knowledge_block_id", "knowledge_block_id string, n long, ready boolean")


def shared_list(spark: SparkSession, out: str) -> DataFrame:
    """DECISION and ready of the shared list as it is now."""
    stores = decisions_of(spark, out), blocks_ready(spark, out)
    decisions, blocks = (s.read(s.version()) for s in stores)
    return decisions.drop("key").join(blocks.select("knowledge_block_id", "ready"), "knowledge_block_id", "left").withColumn("ready", F.coalesce("ready", F.lit(False)))


def stream_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared list after all events have streamed by, in four batches that they fall into by hash; every seventh event says that its block is done."""
    from notespan.jobs.reviews import decided

    base = work_folder(spark)
    own = decided(spark, sf_dir).select(F.col("seq").cast("long").alias("seq"), "knowledge_block_id", *KEY, (F.col("seq") % 7 == 0).alias("done"))
    written(own.repartition(4, F.xxhash64("seq") % 64), f"{base}/events")
    shared_decisions(spark, f"{base}/events", f"{base}/out", f"{base}/checkpoint")
    return shared_list(spark, f"{base}/out").select("target_page", "action", "target_block_id", "seq", "knowledge_block_id", "ready")


STREAM_DECISIONS = """
WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events),
a AS (SELECT *, CASE WHEN k < 25 THEN 'add_section' WHEN k < 50 THEN 'add_under' WHEN k < 75 THEN 'replace' ELSE 'skip_exists' END AS action FROM e),
d AS (SELECT event_id AS seq, 'b' || user_id AS knowledge_block_id, event_type AS target_page, action, CASE WHEN action <> 'add_section' THEN 't' || (k % 7) END AS target_block_id FROM a),
f AS (SELECT target_page, action, target_block_id, min(seq) AS seq, arg_min(knowledge_block_id, seq) AS knowledge_block_id FROM d GROUP BY 1, 2, 3),
r AS (SELECT knowledge_block_id, bool_or(seq % 7 = 0) AS ready FROM d GROUP BY 1)
SELECT target_page, action, target_block_id, seq, knowledge_block_id, ready FROM f JOIN r USING (knowledge_block_id)
"""
