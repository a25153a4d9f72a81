"""What models are asked about journals, and what their answers say: classification, rewording, plans. Long ids travel as short numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.functions import columns as C
from notespan.operators import chunks, models, outline
from notespan.operators import decisions as D
from notespan.operators.merge import PAGE
from notespan.streaming import answers


def blocks_xml(blocks: DataFrame) -> DataFrame:
    """request and prompt: its blocks (short, text, seq) as XML in order, without id lines."""
    one = F.concat(F.lit('<block id="'), F.col("short").cast("string"), F.lit('">'), C.xml_escape(C.without_id_lines(F.col("text"))), F.lit("</block>"))
    own = blocks.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("seq", one.alias("x")))).alias("xs"))
    return own.select("request", F.concat(F.lit("<blocks>"), F.array_join(F.transform("xs", lambda x: x["x"]), "\n"), F.lit("</blocks>")).alias("prompt"))


def contexts_xml(blocks: DataFrame) -> DataFrame:
    """request and prompt for rewording: each block (short, context, seq) with all that stands above it, without id lines, as XML."""
    lines = F.filter(F.split("context", "\n"), lambda x: ~C.strip(x).startswith("id::"))
    one = F.concat(F.lit('  <block id="'), F.col("short").cast("string"), F.lit('">\n'), F.array_join(lines, "\n"), F.lit("\n  </block>\n"))
    own = blocks.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("seq", one.alias("x")))).alias("xs"))
    return own.select("request", F.concat(F.lit("<blocks>\n"), F.array_join(F.transform("xs", lambda x: x["x"]), "\n"), F.lit("\n</blocks>")).alias("prompt"))


def answer_texts(lines: DataFrame) -> DataFrame:
    """request and text of the lines (request, seq, line) that a model streamed, whole. One request's answer is one row: what a model says at once."""
    own = answers.pieces(lines).groupBy("request").agg(F.array_sort(F.collect_list(F.struct("seq", "piece"))).alias("ps"))
    return own.select("request", F.array_join(F.transform("ps", lambda x: x["piece"]), "").alias("text"))


def records(texts: DataFrame, schema: str) -> DataFrame:
    """request, place and the fields of schema of every outermost JSON object in a text, whatever is nested in it."""
    return answers.objects(texts).withColumn("_r", F.from_json("json", schema, {"mode": "PERMISSIVE"})).select("request", "place", "_r.*")


def asked(requests: DataFrame, model, schema: str, log: str | None = None) -> DataFrame:
    """records() of a model's answers to request and prompt. log: a folder that keeps answers, so that no prompt is asked twice."""
    lines = models.asked_once(requests, model, log) if log else models.answered(requests, model, "prompt")
    return records(answer_texts(lines), schema)


def classified(journals: DataFrame, model, log: str | None = None) -> DataFrame:
    """block_id, llm_classification, llm_confidence (0.8 if not given), reason and seq of the blocks that a model takes for knowledge.

    journals: request, block_id, text, seq; one call for each request. Answers about unknown numbers are dropped.
    """
    short = chunks.numbered(journals, "request", "block_id", "seq")
    own = journals.join(short, ["request", "block_id"])
    said = asked(blocks_xml(own), model, "block_id string, reasoning string, confidence double", log)
    confidence = F.coalesce("confidence", F.lit(0.8))
    said = said.withColumn("short", F.col("block_id").cast("long")).where(confidence.between(0, 1) & F.col("reasoning").isNotNull()).drop("block_id")
    return said.join(short, ["request", "short"]).select("block_id", F.lit("knowledge").alias("llm_classification"), confidence.alias("llm_confidence"), F.col("reasoning").alias("reason"), F.struct("request", "place").alias("seq"))


def reworded(blocks: DataFrame, model, log: str | None = None) -> DataFrame:
    """block_id and reworded_content: one call for all selected blocks of a request; of several answers about a block the last.

    blocks: request, block_id, text, seq and, if it is to be shown what stands above a block, context.
    """
    short = chunks.numbered(blocks, "request", "block_id", "seq")
    own = blocks.join(short, ["request", "block_id"])
    said = asked(contexts_xml(own) if "context" in blocks.columns else blocks_xml(own), model, "block_id string, reworded_content string", log)
    said = said.withColumn("short", F.col("block_id").cast("long")).where("reworded_content is not null").drop("block_id").join(short, ["request", "short"])
    return chunks.last_wins(said.select("block_id", "place", "reworded_content"), ["block_id"], ["place"]).drop("place")


def request_name(block: Column) -> Column:
    """The short name of a block's request."""
    return F.substring(block, 1, 8)


def planned(blocks: DataFrame, candidates: DataFrame, model, log: str | None = None) -> DataFrame:
    """Decisions about each block (block_id, text) that has candidates (block_id, page, target, document, seq and, if known, frontmatter): one call for each.

    Numbers of targets become ids again; a target that is the page itself becomes add_section without one;
    unknown numbers and records that aren't valid are dropped.
    """
    own = D.with_candidates(blocks, candidates)
    rows = candidates.withColumnRenamed("block_id", "request")
    short = chunks.numbered(rows, "request", "target", "seq")
    front = F.col("frontmatter") if "frontmatter" in candidates.columns else F.lit(None).cast("string")
    listed = rows.join(short, ["request", "target"]).select("request", "page", "seq", "document", F.col("short").cast("string").alias("block_id"), front.alias("frontmatter"), F.col("target").isin(PAGE, "__page__").alias("of_page"))
    prompts = outline.pages_xml(listed).join(own.select(F.col("block_id").alias("request"), "text"), "request").select("request", F.concat(F.lit("<note>"), C.xml_escape(C.without_id_lines(F.col("text"))), F.lit("</note>\n"), "xml").alias("prompt"))
    said = asked(prompts, model, "target_page string, action string, target_block_id string, confidence double, reasoning string", log)
    said = said.withColumn("short", F.col("target_block_id").cast("long")).drop("target_block_id")
    found = said.join(short, ["request", "short"], "left").where("short is null or target is not null")
    page = F.col("target").isin(PAGE, "__page__")
    found = found.select(F.col("request").alias("knowledge_block_id"), "place", "target_page", F.when(page, "add_section").otherwise(F.col("action")).alias("action"), F.when(~page, F.col("target")).alias("target_block_id"), "confidence", "reasoning")
    return D.valid(found)


def says_odd_blocks(prompt: str):
    """A model for tests: what it says about blocks with odd numbers, streamed as a preamble, an array over several lines, and one number that no block has."""
    import re

    numbers = [int(n) for n in re.findall(r'<block id="(\d+)">', prompt) if int(n) % 2]
    yield "Here is {what I found}:"
    yield "["
    for n in [*numbers, 999_999]:
        yield f'{{"block_id": "{n}", "reasoning": "a {{b}} \\"c\\"",'
        yield f'  "confidence": 0.{n % 10}}},'
    yield "]"


def classify_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as journals, their different texts as blocks, classified by a model that takes every other one for knowledge."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    own = c.groupBy(F.col("conv_id").cast("string").alias("request"), F.md5("text").alias("block_id")).agg(F.first("text").alias("text"), F.min("turn").alias("seq"))
    said = classified(own, says_odd_blocks)
    return said.select(F.col("seq.request").alias("request"), "block_id", "llm_classification", "llm_confidence", "reason")


CLASSIFY_TURNS = """
WITH c AS (SELECT conv_id, md5(text) AS block_id, min(turn) AS place FROM conversations GROUP BY 1, 2),
s AS (SELECT conv_id, block_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, block_id) AS short FROM c)
SELECT CAST(conv_id AS VARCHAR) AS request, block_id, 'knowledge' AS llm_classification, (short % 10) / 10.0::DOUBLE AS llm_confidence, 'a {b} "c"' AS reason FROM s WHERE short % 2 = 1
"""
