"""Rows of the search index: one for each page, one for each block, and how they are kept up to date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespan.functions import columns as C
from notespan.operators.outline import trimmed
from notespan.operators.runs import ranked


def page_context(page: Column, title: Column, frontmatter: Column) -> Column:
    """Name, title if it differs, and the frontmatter."""
    front = trimmed(frontmatter)
    return F.concat_ws("\n", F.concat(F.lit("Page: "), page), F.when(title != page, F.concat(F.lit("Title: "), title)), F.when(F.size(front) > 0, F.array_join(front, "\n")))


def page_title(frontmatter: Column) -> Column:
    line = F.get(F.filter(frontmatter, lambda x: C.strip(x).startswith("title::")), F.lit(0))
    value = C.strip(F.regexp_replace(C.strip(line), "^title::", ""))
    return F.when(value != "", value)


def page_chunks(outlines: DataFrame) -> DataFrame:
    """chunk_id, page, block_id, chunk_seq and document of each page itself."""
    return outlines.select(F.concat(F.col("page"), F.lit("::__page__")).alias("chunk_id"), "page", F.lit("__page__").alias("block_id"), F.lit(-1).alias("chunk_seq"), page_context(F.col("page"), page_title(F.col("frontmatter")), F.col("frontmatter")).alias("document"))


def block_chunks(blocks: DataFrame) -> DataFrame:
    """The same of each block of contexts(); the document leaves out id lines and the frontmatter, which a page has once."""
    return blocks.select(F.concat_ws("::", "page", "hybrid_id").alias("chunk_id"), "page", F.col("hybrid_id").alias("block_id"), F.col("seq").alias("chunk_seq"), F.col("clean").alias("document"))


def last_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows with one key the last. The others go by a partial aggregate, so a key of many rows costs no large group."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*key, *(F.col(f"_last.{c}").alias(c) for c in rest))


def first_wins(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows with one key the first; null keys are equal."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*key, *(F.col(f"_first.{c}").alias(c) for c in rest))


#: Seconds by which two times of one file may differ.
SAME_TIME = 1e-6


def changes(files: DataFrame, index: DataFrame) -> DataFrame:
    """page and state (new, modified, unchanged, deleted) from page and mtime (seconds) of both; of several index rows the latest counts."""
    known = index.groupBy(F.col("page").alias("_page")).agg(F.max("mtime").alias("known"))
    both = files.select("page", "mtime").join(known, F.col("page") == F.col("_page"), "full")
    state = F.when(F.col("page").isNull(), "deleted").when(F.col("_page").isNull(), "new").when(F.abs(F.col("mtime") - F.col("known")) < SAME_TIME, "unchanged").otherwise("modified")
    return both.select(F.coalesce("page", "_page").alias("page"), state.alias("state"))


def updated(index: DataFrame, plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index without rows of deleted and modified pages, with fresh rows of new and modified ones."""
    gone = plan.where(F.col("state").isin("deleted", "modified")).select("page")
    come = plan.where(F.col("state").isin("new", "modified")).select("page")
    return index.join(gone, "page", "left_anti").unionByName(fresh.join(come, "page", "left_semi"))


def numbered(rows: DataFrame, request: str, item: str, position: str) -> DataFrame:
    """request, item and short (from 1, by first appearance in the request): ids that are cheap to send to a model. position is a whole number."""
    first = rows.groupBy(request, item).agg(F.min(position).alias("_first"))
    return ranked(first, "_first", item, [request], "short").select(request, item, "short")
