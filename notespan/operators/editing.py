"""Edits of blocks and lines, as Column expressions over a block's lines (array of string) and rows of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespan.functions import columns as C
from notespan.operators.outline import unmarked


def with_property(lines: Column, key: str, value: Column) -> Column:
    """The lines with a property: the first line that has the key is changed, white space before it stays; else a line is added."""
    has = lambda x: F.contains(x, F.lit("::")) & (C.strip(F.get(F.split(x, "::", 2), F.lit(0))) == key)
    at = F.array_min(F.transform(lines, lambda x, i: F.when(has(x), i)))
    line = F.concat(F.lit(f"{key}:: "), value)
    return F.when(at.isNull(), F.concat(lines, F.array(line))).otherwise(F.transform(lines, lambda x, i: F.when(i == at, F.concat(F.regexp_extract(x, r"^(\s*)", 1), line)).otherwise(x)))


def full_content(lines: Column, stripped: bool = False) -> Column:
    return F.array_join(F.transform(lines, C.strip) if stripped else lines, "\n")


def user_lines(lines: Column) -> Column:
    """Without marks of indents, and without id lines."""
    return F.filter(F.transform(lines, unmarked), lambda x: ~C.strip(x).startswith("id::"))


def user_content(lines: Column) -> Column:
    return F.array_join(user_lines(lines), "\n")


def for_display(context: Column) -> Column:
    """A context without lines that begin with id::."""
    return F.array_join(F.filter(F.split(context, "\n"), lambda x: ~C.strip(x).startswith("id::")), "\n")


def as_bullets(text: Column) -> Column:
    """Lines that are neither blank nor bullets become bullets, at their indent."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^(\s*)(?!- )(?!\s)(.)", "$1- $2")), "\n")


def property_line(line: Column) -> Column:
    """indent, key and value of a line that is a property, else null."""
    pattern = r"(?U)^(\s*)([\w-]+)::\s*(.*)\z"
    part = lambda k: F.regexp_extract(line, pattern, k)
    return F.when(line.rlike(pattern), F.struct(part(1).alias("indent"), part(2).alias("key"), part(3).alias("value")))


# Inline marks, in the order in which they are tried at a place.
INLINE = {
    "tag link": r"#\[\[[^\]]+\]\]",
    "link": r"\[\[[^\]]+\]\]",
    "code": r"`[^`]+`",
    "bold": r"\*\*[^*]+\*\*",
    "italic": r"\*[^*]+\*",
    "url": r"https?://[^\s]+",
    "tag": r"(?<!\S)#[^\s#\[\]]+",
}


def inline_tokens(text: Column) -> Column:
    """kind and text of the marked parts of a line, in order."""
    whole = F.regexp_extract_all(text, F.lit("|".join(INLINE.values())), F.lit(0))
    kind = lambda x: F.coalesce(*(F.when(x.rlike(f"^(?:{p})\\z"), k) for k, p in INLINE.items()))
    return F.transform(whole, lambda x: F.struct(kind(x).alias("kind"), x.alias("text")))


def with_child(blocks: DataFrame, parent_seq: Column, content: Column) -> DataFrame:
    """Rows of one child more below a block of each page: blocks has page, seq, level, last. The child comes after all that is below its parent."""
    at = blocks.where(F.col("seq") == parent_seq)
    return at.select("page", (F.col("last") + 0.5).alias("place"), (F.col("level") + 1).alias("level"), content.alias("content"))


def heading(blocks: DataFrame, text: str) -> DataFrame:
    """page and seq of the first block of each page whose first line contains a text, whatever its case."""
    hit = F.contains(F.lower(F.get("content", F.lit(0))), F.lit(text.lower()))
    return blocks.where(hit).groupBy("page").agg(F.min("seq").alias("seq"))


def by_content(blocks: DataFrame, wanted: DataFrame) -> DataFrame:
    """page, wanted, seq and hybrid_id of the first block whose first line contains a wanted text (page, wanted)."""
    both = blocks.join(wanted, "page").where(F.contains(F.get("content", F.lit(0)), F.col("wanted")))
    return both.groupBy("page", "wanted").agg(F.min(F.struct("seq", "hybrid_id")).alias("b")).select("page", "wanted", "b.*")


def with_ids(outlines: DataFrame) -> DataFrame:
    """Outlines whose blocks all have an id line: their own, or the hash of their context as it was before any line was added."""
    from notespan.operators.merge import regrouped
    from notespan.operators.outline import contexts

    rows = contexts(outlines, hash_pages=False)
    lines = F.when(F.col("block_id").isNull(), F.concat("content", F.array(F.concat(F.lit("id:: "), "hybrid_id")))).otherwise(F.col("content"))
    return regrouped(outlines, rows.select("page", "seq", "level", lines.alias("content")))


def lineage(outlines: DataFrame) -> DataFrame:
    """page, seq and shown: the first lines of the blocks above and of the block itself, from the root on."""
    first = lambda s: F.get(F.get("blocks", s)["content"], F.lit(0))
    rows = outlines.select("page", "blocks", F.explode("blocks").alias("b"))
    return rows.select("page", "b.seq", F.transform(F.concat("b.above", F.array("b.seq")), first).alias("shown"))


def preview(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of merged() as a preview: a replaced block stays (state old), with the new one after it, which its children move to; additions are new."""
    from notespan.operators.merge import merged

    rows = merged(blocks, found).withColumn("state", F.when(F.col("was").isNull(), "new").otherwise("kept"))
    swapped = found.where("done_as = 'replace'").select(F.col("target_page").alias("page"), F.col("target_seq").alias("was")).distinct().withColumn("swapped", F.lit(True))
    own = rows.join(swapped, ["page", "was"], "left")
    old = own.where("swapped").join(blocks.select("page", F.col("seq").alias("was"), F.col("content").alias("_content"), F.col("block_id").alias("_id")), ["page", "was"])
    old = old.select("page", "seq", F.lit(0).alias("turn"), "level", F.col("_content").alias("content"), F.col("_id").alias("block_id"), F.lit("old").alias("state"))
    new = own.select("page", "seq", F.lit(1).alias("turn"), "level", "content", "block_id", F.when(F.col("swapped"), "new").otherwise(F.col("state")).alias("state"))
    return old.union(new)
