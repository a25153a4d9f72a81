"""Model output and decisions about it: decoding, validation, review states and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The actions of decisions.
ACTIONS = ["add_section", "add_under", "replace", "skip_exists"]
THRESHOLD = 0.8
RECORD = "knowledge_block_id string, target_page string, action string, target_block_id string, confidence double"


def stream_record(line: Column) -> Column:
    """The JSON text in a line of a model's stream: server-sent events lose their prefix; blank lines and the end mark are null."""
    own = F.regexp_replace(F.trim(line), r"^data:\s*", "")
    return F.when((own != "") & (own != "[DONE]"), own)


def delta(record: Column) -> Column:
    """The piece of text in a streamed record of either kind of server."""
    return F.coalesce(F.get_json_object(record, "$.choices[0].delta.content"), F.get_json_object(record, "$.message.content"))


def decoded(lines: DataFrame, line: str = "line") -> DataFrame:
    """lines with the fields of RECORD; lines that are no record of it are dropped."""
    rec = F.from_json(stream_record(F.col(line)), RECORD, {"mode": "PERMISSIVE"})
    return valid(lines.withColumn("_r", rec).select(*lines.columns, "_r.*"))


def valid(records: DataFrame) -> DataFrame:
    """Those with a known action and a confidence from 0 to 1; replace and skip_exists also need a target."""
    needs = F.col("action").isin("replace", "skip_exists")
    return records.where(F.col("action").isin(*ACTIONS) & F.col("confidence").between(0, 1) & F.col("target_page").isNotNull() & (~needs | F.col("target_block_id").isNotNull()))


def suggested(threshold: float = THRESHOLD) -> Column:
    return (F.col("llm_classification") == "knowledge") & (F.col("llm_confidence") >= threshold)


def with_suggestions(states: DataFrame, suggestions: DataFrame) -> DataFrame:
    """states with llm_classification, llm_confidence and reason of each block's last suggestion; those of unknown blocks are dropped."""
    last = suggestions.groupBy("block_id").agg(F.max_by(F.struct("llm_classification", "llm_confidence", "reason"), "seq").alias("_s")).select("block_id", "_s.*")
    return states.join(last, "block_id", "left")


def accept_all(states: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Blocks not selected yet take suggestions that reach the threshold."""
    take = (F.col("classification") != "knowledge") & F.coalesce(suggested(threshold), F.lit(False))
    return states.withColumns({"classification": F.when(take, "knowledge").otherwise(F.col("classification")), "source": F.when(take, "llm").otherwise(F.col("source")), "confidence": F.when(take, F.col("llm_confidence")).otherwise(F.col("confidence"))})


def toggled(states: DataFrame, picked: Column) -> DataFrame:
    """The picked blocks change between pending and knowledge, by the user."""
    to = F.when(F.col("classification") == "pending", "knowledge").otherwise("pending")
    sure = F.when(F.col("classification") == "pending", 1.0).otherwise(F.col("confidence"))
    return states.withColumns({"classification": F.when(picked, to).otherwise(F.col("classification")), "source": F.when(picked, "user").otherwise(F.col("source")), "confidence": F.when(picked, sure).otherwise(F.col("confidence"))})


def cleared(states: DataFrame) -> DataFrame:
    """All blocks pending again; confidences stay."""
    return states.withColumns({"classification": F.lit("pending"), "source": F.lit("user")})


def reset(states: DataFrame) -> DataFrame:
    """Blocks that the model suggested go back to what it said."""
    back = F.col("llm_classification").isNotNull()
    return states.withColumns({"classification": F.when(back, F.col("llm_classification")).otherwise(F.col("classification")), "source": F.when(back, "llm").otherwise(F.col("source")), "confidence": F.when(back, F.col("llm_confidence")).otherwise(F.col("confidence"))})


def label(threshold: float = THRESHOLD, processed: Column | None = None) -> Column:
    """What a block is shown as: selected, processed, suggested or none, the first that holds."""
    selected = F.col("classification") == "knowledge"
    return F.when(selected, "selected").when(F.lit(False) if processed is None else processed, "processed").when(suggested(threshold), "suggested").otherwise("none")


def best_for_each_page(decisions: DataFrame, most: int = 2) -> DataFrame:
    """Of each block and page the decisions with the highest confidence."""
    w = Window.partitionBy("knowledge_block_id", "target_page").orderBy(F.desc("confidence"), "seq")
    return decisions.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= most)


def by_block(decisions: DataFrame) -> DataFrame:
    """How many decisions each block has, in how many pages, and whether all say that it is there already."""
    return decisions.groupBy("knowledge_block_id").agg(F.count("*").alias("n_decisions"), F.countDistinct("target_page").alias("n_pages"), F.bool_and(F.col("action") == "skip_exists").alias("all_skipped"))


def summary(decisions: DataFrame) -> DataFrame:
    """One row: totals by write status."""
    return decisions.agg(F.count("*").alias("n_decisions"), *(F.count_if(F.col("write_status") == s).alias(f"n_{s}") for s in ("pending", "completed", "failed")))


def listed_by_block(decisions: DataFrame) -> DataFrame:
    """Each block's decisions (page, action, target) in order, and whether all say that it is there already."""
    one = F.struct("seq", "target_page", "action", "target_block_id")
    return decisions.groupBy("knowledge_block_id").agg(F.array_sort(F.collect_list(one)).alias("decisions"), F.bool_and(F.col("action") == "skip_exists").alias("all_skipped"))


def recorded_already(decisions: DataFrame) -> DataFrame:
    """One row: in how many blocks all decisions say that it is there already."""
    return by_block(decisions).agg(F.count_if("all_skipped").alias("n_recorded"))


def with_outcome(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pending decisions take the outcome of their write (seq, error): completed without an error, else failed with its message."""
    tried = outcomes.select("seq", "error", F.lit(True).alias("_tried"))
    rows = decisions.join(tried, "seq", "left")
    now = F.when((F.col("write_status") == "pending") & F.col("_tried"), F.when(F.col("error").isNull(), "completed").otherwise("failed")).otherwise(F.col("write_status"))
    return rows.withColumn("write_status", now).drop("_tried")


def accepted_rewording(edited: DataFrame) -> DataFrame:
    """Complete rewordings that aren't blank become the current text."""
    take = F.coalesce(F.col("rewording_complete"), F.lit(False)) & (F.coalesce("reworded_content", F.lit("")) != "")
    return edited.withColumn("current_content", F.when(take, F.col("reworded_content")).otherwise(F.col("current_content")))


def reverted(edited: DataFrame) -> DataFrame:
    return edited.withColumn("current_content", F.col("original_content"))


def with_manual_edits(edited: DataFrame, edits: DataFrame) -> DataFrame:
    """The last text that was typed for each block (block_id, seq, text) becomes the current one."""
    last = edits.groupBy("block_id").agg(F.max_by("text", "seq").alias("_text"))
    return edited.join(last, "block_id", "left").withColumn("current_content", F.coalesce("_text", "current_content")).drop("_text")


def late_bound(decisions: DataFrame, edited: DataFrame) -> DataFrame:
    """Decisions of known blocks with refined_text: the block's text as it is now, when it is written."""
    return decisions.join(edited.select(F.col("block_id").alias("knowledge_block_id"), F.col("current_content").alias("refined_text")), "knowledge_block_id")


def with_titles(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Decisions with the title of their target, from the candidates' contexts (block_id, document, seq); the last candidate wins, null without one."""
    from notespan.functions import columns as C

    last = candidates.groupBy(F.col("block_id").alias("target_block_id")).agg(F.max_by("document", "seq").alias("_document"))
    return decisions.join(last, "target_block_id", "left").withColumn("target_block_title", C.block_title(F.col("_document"))).drop("_document")


def journal_dates(blocks: DataFrame) -> DataFrame:
    """hybrid_id and day of each block: of several journals the last."""
    return blocks.groupBy("hybrid_id").agg(F.max("day").alias("day"))


def dated(decisions: DataFrame, days: DataFrame) -> DataFrame:
    """Decisions with the day of their block's journal; the earliest of all days where that isn't known."""
    first = days.agg(F.min("day").alias("_first"))
    found = decisions.join(days.withColumnRenamed("hybrid_id", "knowledge_block_id"), "knowledge_block_id", "left")
    return found.join(F.broadcast(first)).withColumn("day", F.coalesce("day", "_first")).drop("_first")


def selected_blocks(states: DataFrame, blocks: DataFrame) -> DataFrame:
    """The selected states with their block of the first journal that has it (day, then seq)."""
    first = blocks.groupBy(F.col("hybrid_id").alias("block_id")).agg(F.min_by(F.struct("day", "seq", "context"), F.struct("day", "seq")).alias("b"))
    return states.where("classification = 'knowledge'").join(first.select("block_id", "b.*"), "block_id")


def restored_ids(replies: DataFrame, short_ids: DataFrame, strict: bool = False) -> DataFrame:
    """replies (request, short) with the item that each number stands for; null for an unknown one, or with strict an error."""
    found = replies.join(short_ids, ["request", "short"], "left")
    if not strict:
        return found
    return found.withColumn("item", F.coalesce("item", F.raise_error(F.concat(F.lit("unknown id "), F.col("short").cast("string"))).cast("string")))


def distinct_pages(candidates: DataFrame) -> DataFrame:
    return candidates.select("page").distinct().orderBy("page")


def with_candidates(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """The blocks for which a plan is asked: those that have candidates."""
    return blocks.join(candidates.select("block_id"), "block_id", "left_semi")
