"""Decisions written into a folder of notes: pages first, then the journals' links to them; only files that change, and none that somebody else changed meanwhile."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.operators import merge, outline
from notespan.sources import graph as G
from notespan.sources.folder import place
from notespan.sources.work import written


def with_digest(files: DataFrame) -> DataFrame:
    """files with digest, that of the text as it was read: what a write is held against."""
    return files.withColumn("digest", F.sha2("text", 256))


def modified(before: DataFrame, now: DataFrame) -> DataFrame:
    """path of the files whose text isn't that of before (path, digest) any more, or that weren't there then."""
    old = before.select("path", F.col("digest").alias("_digest"))
    return now.join(old, "path", "left").where(~F.col("digest").eqNullSafe(F.col("_digest"))).select("path")


def replace_file(uri: str, text: str, digest: str) -> str | None:
    """Writes a file beside the old one and renames it, if the old one still has the digest; else, or on failure, the reason. A repeat that finds its own text is done."""
    try:
        system, path = place(uri)
        with system.open_input_stream(path) as f:
            found = f.read().decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
        if found == text:
            return None
        if hashlib.sha256(found.encode()).hexdigest() != digest:
            return "changed by somebody else"
        aside = f"{path}.{uuid.uuid4().hex}"
        with system.open_output_stream(aside) as f:
            f.write(text.encode())
        system.move(aside, path)
    except OSError as e:
        return str(e)
    return None


def written_files(texts: DataFrame, outcomes: str) -> DataFrame:
    """path and error (null if it went well) of each file of texts (path, text, digest). Written once: the outcomes are kept in a folder and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [batch.column(c).to_pylist() for c in ("path", "text", "digest")]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array([replace_file(*r) for r in zip(*rows, strict=True)], pa.string())], names=["path", "error"])

    texts.select("path", "text", "digest").mapInArrow(run, "path string, error string").write.mode("overwrite").parquet(outcomes)
    return texts.sparkSession.read.schema("path string, error string").parquet(outcomes)


def changed(files: DataFrame, texts: DataFrame) -> DataFrame:
    """Of new texts (page, text) those that differ from the files', with path and digest."""
    own = files.select("page", "path", "digest", F.col("text").alias("_old"))
    return texts.join(own, "page").where(~F.col("text").eqNullSafe(F.col("_old"))).drop("_old")


def integrate(spark: SparkSession, graph: str, decisions: DataFrame, work: str) -> DataFrame:
    """seq and error of every decision, after it was written. work: a folder on shared storage for what was read and what was done.

    A page that wasn't written, or a decision without its target, leaves its journal as it was, as does a
    replacement that an earlier one of the same block beat. Decisions that an earlier run wrote give their
    links again, which adds none. The files are read once, into work, and so is what becomes of each decision:
    what is computed again after an executor was lost sees neither the pages that this run has changed
    nor other ids.
    """
    pages = written(with_digest(G.pages(spark, graph)), f"{work}/read")
    outlines = outline.parsed(pages, strict=True)
    tree = merge.tree(outlines)
    found = written(merge.resolved(decisions, tree), f"{work}/resolved")
    texts = outline.rendered(merge.regrouped(outlines, merge.merged(tree, found)))
    failed = written_files(changed(pages, texts), f"{work}/pages").where("error is not null").join(pages.select("path", F.col("page").alias("target_page")), "path").select("target_page", F.col("error").alias("page_error"))
    ids = tree.select(F.col("page").alias("target_page"), F.col("seq").alias("target_seq"), F.col("block_id").alias("own_id"))
    known = found.join(pages.select(F.col("page").alias("target_page"), F.lit(True).alias("there")), "target_page", "left").join(failed, "target_page", "left").join(ids, ["target_page", "target_seq"], "left")
    reason = F.when(F.col("there").isNull(), F.concat(F.lit("no page "), "target_page")).when(F.col("beaten"), F.concat(F.lit("an earlier decision changed "), "target_block_id")).when(F.col("done_as") == "invalid", F.lit("no such target")).otherwise(F.col("page_error"))
    kept_id = F.when(F.col("done_as").isin("replace", "skip_exists"), F.coalesce("own_id", "new_id")).otherwise(F.col("new_id"))
    done = written(known.select("seq", "knowledge_block_id", "target_page", kept_id.alias("new_id"), reason.alias("error")), f"{work}/done")
    journals = written(with_digest(G.journals(spark, graph).withColumn("page", F.col("stem"))), f"{work}/read_journals")
    linked = outline.rendered(merge.with_provenance(outline.parsed(journals, strict=True), done.where("error is null")))
    lost = written_files(changed(journals, linked), f"{work}/journals").where("error is not null").join(journals.select("path", F.col("page").alias("journal")), "path").select("journal", F.col("error").alias("journal_error"))
    of = merge.tree(outline.parsed(journals, strict=True), hash_pages=False).select(F.col("hybrid_id").alias("knowledge_block_id"), F.col("page").alias("journal")).join(lost, "journal").groupBy("knowledge_block_id").agg(F.first("journal_error").alias("journal_error"))
    return done.join(of, "knowledge_block_id", "left").select("seq", F.coalesce("error", "journal_error").alias("error"))
