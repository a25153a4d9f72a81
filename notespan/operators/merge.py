"""Decisions merged into pages: blocks added, put under others, replaced or made linkable, with ids that make a repeat find its own work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notespan.functions import columns as C
from notespan.operators.outline import unmarked

#: The target that stands for the page itself.
PAGE = "__PAGE__"


def resolved(decisions: DataFrame, blocks: DataFrame) -> DataFrame:
    """decisions with new_id, the first target block found (target_seq), what is to be done (done_as) and whether an earlier decision stands in the way (beaten).

    decisions: knowledge_block_id, seq, target_page, action, target_block_id, refined_text. blocks: page,
    seq, hybrid_id and, of pages that were merged before, block_id. A decision whose id a block has is done,
    as is one that repeats an earlier one. Without its target, add_under becomes add_section; replace and
    skip_exists become invalid. The first change of a block without an id of its own gives it one, so the
    block isn't found any more by what the later ones call it: they are invalid, and beaten. The id is of the
    action as decided, so a repeat finds it whatever the action became.
    """
    known = F.col("block_id") if "block_id" in blocks.columns else F.lit(None).cast("string")
    at = blocks.groupBy(F.col("page").alias("_page"), F.col("hybrid_id").alias("_id")).agg(F.min(F.struct(F.col("seq").alias("seq"), known.alias("id"))).alias("_at"))
    named = decisions.withColumn("new_id", C.integration_id(F.col("knowledge_block_id"), F.col("target_page"), F.col("action"), F.col("target_block_id")))
    found = named.join(at, (F.col("target_page") == F.col("_page")) & (F.col("target_block_id") == F.col("_id")), "left").withColumns({"target_seq": F.col("_at.seq"), "_own": F.col("_at.id")}).drop("_page", "_id", "_at")
    if "block_id" in blocks.columns:
        own = blocks.where("block_id is not null").select(F.col("page").alias("target_page"), F.col("block_id").alias("new_id"), F.lit(True).alias("_done")).distinct()
        found = found.join(own, ["target_page", "new_id"], "left")
    else:
        found = found.withColumn("_done", F.lit(None).cast("boolean"))
    missing = F.col("target_seq").isNull()
    act = F.when(F.col("_done"), "done").when((F.col("action") == "add_under") & missing, "add_section").when(F.col("action").isin("replace", "skip_exists") & missing, "invalid").otherwise(F.col("action"))
    found = found.withColumn("done_as", act)
    gives = F.col("done_as").isin("add_under", "add_section") | (F.col("done_as").isin("replace", "skip_exists") & F.col("_own").isNull())
    repeats = found.where(gives).groupBy("target_page", "new_id").agg(F.min("seq").alias("_earliest"))
    changed = found.where(gives & F.col("done_as").isin("replace", "skip_exists")).groupBy("target_page", "target_seq").agg(F.min_by("new_id", F.struct("seq", "new_id")).alias("_winner"))
    found = found.join(repeats, ["target_page", "new_id"], "left").join(changed, ["target_page", "target_seq"], "left")
    beaten = gives & F.col("done_as").isin("replace", "skip_exists") & (F.col("_winner") != F.col("new_id"))
    done_as = F.when(beaten, "invalid").when(gives & (F.col("seq") > F.col("_earliest")), "done").otherwise(F.col("done_as"))
    return found.withColumn("beaten", F.coalesce(beaten, F.lit(False))).withColumn("done_as", done_as).drop("_done", "_own", "_earliest", "_winner")


def why_invalid(found: DataFrame) -> DataFrame:
    """The decisions of resolved() that can't be done, with a reason."""
    missing = F.concat(F.lit("no block "), "target_block_id", F.lit(" in "), "target_page")
    beaten = F.concat(F.lit("an earlier decision changed "), "target_block_id", F.lit(" in "), "target_page")
    reason = F.when(F.col("target_block_id").isNull(), F.concat("action", F.lit(" needs a target"))).when(F.col("beaten"), beaten).otherwise(missing)
    return found.where("done_as = 'invalid'").withColumn("reason", reason)


def id_line(block: Column) -> Column:
    return F.concat(F.lit("id:: "), block)


def is_property(line: Column) -> Column:
    """Whether a replacement keeps a line: any that has two colons and is no bullet."""
    return F.contains(line, F.lit("::")) & ~C.strip(line).startswith("-")


def edited(content: Column, block_id: Column, new: Column) -> Column:
    """A block's lines after a decision: new text and its own properties, or its own lines; either with an id."""
    own = F.filter(content, lambda x: is_property(unmarked(x)))
    lines = F.when(new["lines"].isNotNull(), F.concat(new["lines"], own)).otherwise(content)
    return F.when(block_id.isNull(), F.concat(lines, F.array(id_line(new["new_id"])))).otherwise(lines)


def merged(blocks: DataFrame, found: DataFrame) -> DataFrame:
    """page, seq (from 0), level, content, block_id, was (the seq before, null for new blocks) of the pages after the decisions of resolved().

    blocks: page, seq, level, content (array), block_id and last (the seq of the last block below each). Ids
    stand in the content as id:: lines, so they are found again after rendering and parsing. A block without
    an id of its own has one change (see resolved); of several replacements of one with an id the last wins;
    additions stand in the order of their seq.
    """
    text = F.split("refined_text", "\n")
    lines = F.when(F.col("done_as") == "replace", text)
    change = found.where("done_as in ('replace', 'skip_exists')")
    swap = change.groupBy(F.col("target_page").alias("page"), F.col("target_seq").alias("seq")).agg(F.max_by(F.struct(lines.alias("lines"), "new_id"), F.struct(F.col("done_as") == "replace", "seq")).alias("new"))
    old = blocks.join(swap, ["page", "seq"], "left")
    kept = F.when(F.col("new").isNotNull(), edited(F.col("content"), F.col("block_id"), F.col("new"))).otherwise(F.col("content"))
    old = old.select("page", F.col("seq").cast("double").alias("place"), F.lit(0).cast("long").alias("turn"), "level", kept.alias("content"), F.coalesce("block_id", "new.new_id").alias("block_id"), F.col("seq").alias("was"))
    new = F.concat(text, F.array(id_line(F.col("new_id"))))
    ends = blocks.select(F.col("page").alias("target_page"), F.col("seq").alias("target_seq"), F.col("last"), F.col("level").alias("_level"))
    under = found.where("done_as = 'add_under'").join(ends, ["target_page", "target_seq"]).select(F.col("target_page").alias("page"), (F.col("last") + 0.5).alias("place"), F.col("seq").cast("long").alias("turn"), (F.col("_level") + 1).alias("level"), new.alias("content"), F.col("new_id").alias("block_id"), F.lit(None).cast("int").alias("was"))
    section = found.where("done_as = 'add_section'").select(F.col("target_page").alias("page"), F.lit(float("inf")).alias("place"), F.col("seq").cast("long").alias("turn"), F.lit(0).alias("level"), new.alias("content"), F.col("new_id").alias("block_id"), F.lit(None).cast("int").alias("was"))
    order = Window.partitionBy("page").orderBy("place", "turn", "block_id")
    return old.union(under).union(section).select("page", (F.row_number().over(order) - 1).cast("int").alias("seq"), "level", "content", "block_id", "was")


def tree(outlines: DataFrame, hash_pages: bool = True) -> DataFrame:
    """The blocks of outlines as merged() and resolved() take them."""
    from notespan.operators.outline import contexts

    return contexts(outlines, hash_pages).select("page", "seq", "depth", "level", "content", "block_id", "hybrid_id", "last")


def regrouped(outlines: DataFrame, rows: DataFrame) -> DataFrame:
    """The outlines with the rows of merged() as their blocks, to be rendered."""
    new = rows.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", "level", "content"))).alias("_blocks"))
    return outlines.join(new, "page", "left").select("page", "indent", "frontmatter", F.coalesce("_blocks", F.array().cast("array<struct<seq:int,level:int,content:array<string>>>")).alias("blocks"))


def applied(outlines: DataFrame, found: DataFrame) -> DataFrame:
    """The outlines of the pages that the decisions of resolved() name, after them: page, indent, frontmatter, blocks as regrouped() has them, and before, the blocks as they were.

    The blocks are those of merged(), but a page's stay in its row and its decisions come to them: pages travel once, and their blocks never as rows. A
    decision stands among the blocks at its place: a change just before what it changes, an addition after what it is added to.
    """
    edit = F.struct("done_as", "target_seq", F.col("seq").cast("long").alias("turn"), F.col("new_id").alias("id"), F.split("refined_text", "\n").alias("lines"))
    edits = found.groupBy(F.col("target_page").alias("page")).agg(F.collect_list(F.when(F.col("done_as").isin("replace", "skip_exists", "add_under", "add_section"), edit)).alias("_edits"))
    # The second field puts what has the same place in order: changes that keep the text, replacements, the block itself, additions.
    fields = lambda place, kind, turn, id, level, lines: F.struct(place.cast("double").alias("place"), kind.alias("kind"), turn.alias("turn"), id.alias("id"), level.alias("level"), lines.alias("lines"))
    old = F.transform("before", lambda b, i: fields(i, F.lit(2), F.lit(0).cast("long"), b["block_id"], b["level"], b["content"]))

    def placed(e: Column) -> Column:
        at, is_new, under = F.get("before", e["target_seq"]), e["done_as"].startswith("add_"), e["done_as"] == "add_under"
        place = F.when(under, at["last"] + 0.5).when(is_new, F.lit(float("inf"))).otherwise(e["target_seq"])
        kind = F.when(is_new, 3).when(e["done_as"] == "replace", 1).otherwise(0)
        lines = F.when(is_new, F.concat(e["lines"], F.array(id_line(e["id"])))).when(kind == 1, e["lines"])
        return fields(place, kind, e["turn"], e["id"], F.when(under, at["level"] + 1).otherwise(0), lines)

    short = F.transform("blocks", lambda b: F.struct(b["level"].alias("level"), b["content"].alias("content"), b["block_id"].alias("block_id"), b["last"].alias("last")))
    rows = outlines.select("page", "indent", "frontmatter", short.alias("before")).join(edits, "page")
    rows = rows.withColumn("_all", F.array_sort(F.concat(old, F.transform("_edits", placed))))

    def after(x: Column, i: Column) -> Column:
        change = F.get("_all", i - 1)
        content = F.when((x["kind"] == 2) & (change["kind"] < 2), edited(x["lines"], x["id"], F.struct(change["lines"].alias("lines"), change["id"].alias("new_id")))).otherwise(x["lines"])
        return F.when(x["kind"] >= 2, F.struct(x["level"].alias("level"), content.alias("content")))

    kept = F.filter(F.transform("_all", after), lambda x: x.isNotNull())
    return rows.select("page", "indent", "frontmatter", F.transform(kept, lambda x, i: F.struct(i.alias("seq"), x["level"].alias("level"), x["content"].alias("content"))).alias("blocks"), "before")


def with_provenance(outlines: DataFrame, written: DataFrame) -> DataFrame:
    """Journals with links to what their blocks became: written has knowledge_block_id, target_page, new_id and seq. A link that is there isn't added again.

    Blocks are found by explicit id or by the hash without a page's name; of several the first is taken.
    """
    from notespan.operators.editing import with_property

    links = written.groupBy("knowledge_block_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "target_page", "new_id"))), lambda x: F.struct(x["target_page"].alias("page"), x["new_id"].alias("id"))).alias("links"))
    rows = tree(outlines, hash_pages=False)
    first = rows.groupBy("page", "hybrid_id").agg(F.min("seq").alias("seq")).join(links, F.col("hybrid_id") == F.col("knowledge_block_id")).select("page", "seq", "links")
    old = C.property_value(F.col("content"), "extracted-to")
    value = F.aggregate("links", F.coalesce(old, F.lit("")), lambda v, x: C.provenance(v, C.display_name(x["page"]), x["id"]))
    done = rows.join(first, ["page", "seq"], "left").withColumn("content", F.when(F.col("links").isNotNull(), with_property(F.col("content"), "extracted-to", value)).otherwise(F.col("content")))
    return regrouped(outlines, done)
