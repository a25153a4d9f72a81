"""Places of blocks as keys that sort in reading order, with room between any two: blocks come in and subtrees move without numbering a page anew.

A key is the path from the root: each step is the number of a block, eight digits, and steps are joined by
"/". What comes right after a block and all that is below it has that block's key, "m" and its turn; what comes
before a parent's first child, or a page's first block, has "#" and its turn as its step; what comes after the last one, "~".
As "#" sorts before "/", that before digits and those before "m" and "~", keys sort as blocks are read, and a
subtree is all keys that begin with its root's and "/".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notespan.operators import outline
from notespan.operators.merge import resolved, tree

DIGITS = 8


def number(n: Column) -> Column:
    return F.lpad(n.cast("string"), DIGITS, "0")


def key_of(block: Column) -> Column:
    """The key of a block of an outline, from the numbers of the blocks above and its own."""
    return F.array_join(F.transform(F.concat(block["above"], F.array(block["seq"])), number), "/")


def keyed(outlines: DataFrame) -> DataFrame:
    """page, key, parent (the key above, empty for roots), level and content of every block."""
    rows = outlines.select("page", F.explode("blocks").alias("b")).select("page", key_of(F.col("b")).alias("key"), "b.level", "b.content")
    return rows.withColumn("parent", above(F.col("key"))).select("page", "key", "parent", "level", "content")


def above(key: Column) -> Column:
    return F.regexp_replace(key, "/?[^/]*$", "")


def step(parent: Column, own: Column) -> Column:
    return F.when(parent == "", own).otherwise(F.concat(parent, F.lit("/"), own))


def after(key: Column, turn: Column) -> Column:
    """A key behind a block and all that is below it."""
    return F.concat(key, F.lit("m"), number(turn))


def before_first(parent: Column, turn: Column) -> Column:
    return step(parent, F.concat(F.lit("#"), number(turn)))


def behind_last(parent: Column, turn: Column) -> Column:
    return step(parent, F.concat(F.lit("~"), number(turn)))


def inserted(blocks: DataFrame, children: DataFrame) -> DataFrame:
    """blocks with children (page, parent, position, turn, content) put in: parent is a key, empty for roots.

    position counts the siblings before the new one as they are now; negative ones count from the end, null and
    larger ones mean the end. Several at one place stand in order of turn. Children whose parent isn't there are left out.
    """
    asked = children.select("page", "parent").distinct()
    order = Window.partitionBy("page", "parent").orderBy("key")
    siblings = blocks.join(asked, ["page", "parent"], "left_semi").select("page", "parent", "key", F.row_number().over(order).alias("at"))
    n = siblings.groupBy("page", "parent").agg(F.count("*").alias("n"))
    levels = blocks.select("page", F.col("key").alias("parent"), (F.col("level") + 1).alias("_level"))
    own = children.join(n, ["page", "parent"], "left").join(levels, ["page", "parent"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    at = F.when(F.col("position").isNull(), F.col("n")).when(F.col("position") < 0, F.greatest(F.col("n") + F.col("position"), F.lit(0))).otherwise(F.least("position", "n"))
    own = own.where("_level is not null or parent = ''").withColumn("at", at.cast("int"))
    own = own.join(siblings.withColumnRenamed("key", "_before"), ["page", "parent", "at"], "left")
    key = F.when(F.col("_before").isNull(), before_first(F.col("parent"), F.col("turn"))).otherwise(after(F.col("_before"), F.col("turn")))
    return blocks.unionByName(own.select("page", key.alias("key"), "parent", F.coalesce("_level", F.lit(0)).alias("level"), "content"))


def moved(blocks: DataFrame, moves: DataFrame) -> DataFrame:
    """blocks with subtrees (page, key) at other keys (page, to): the root, and all below it by its prefix. A page's moves are of subtrees apart from each other."""
    levels = blocks.select("page", F.col("key").alias("_parent"), F.col("level").alias("_above"))
    own = moves.select("page", F.col("key").alias("_from"), F.col("to").alias("_to"), above(F.col("to")).alias("_parent")).join(levels, ["page", "_parent"], "left")
    own = own.join(blocks.select("page", F.col("key").alias("_from"), F.col("level").alias("_was")), ["page", "_from"])
    inside = (F.col("key") == F.col("_from")) | F.startswith("key", F.concat("_from", F.lit("/")))
    rows = blocks.join(own, (blocks["page"] == own["page"]) & inside, "left").select(blocks["page"], "key", "level", "content", "_from", "_to", "_was", "_above")
    key = F.when(F.col("_from").isNull(), F.col("key")).otherwise(F.concat("_to", F.substring("key", F.length("_from") + 1, F.length("key"))))
    level = F.when(F.col("_from").isNull(), F.col("level")).otherwise(F.col("level") - F.col("_was") + F.coalesce(F.col("_above") + 1, F.lit(0)))
    return rows.select("page", key.alias("key"), level.alias("level"), "content").withColumn("parent", above(F.col("key"))).select("page", "key", "parent", "level", "content")


def rendered(outlines: DataFrame, blocks: DataFrame) -> DataFrame:
    """page and text of the outlines with these blocks, sorted by key; a page without blocks keeps its frontmatter."""
    own = blocks.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("key", "level", "content"))).alias("_blocks"))
    none = F.array().cast("array<struct<key:string,level:int,content:array<string>>>")
    return outline.rendered(outlines.join(own, "page", "left").select("page", "indent", "frontmatter", F.coalesce("_blocks", none).alias("blocks")))


def previewed(outlines: DataFrame, decisions: DataFrame) -> DataFrame:
    """seq, page, text, new_at, old_at, highlight_id and old_id: each decision's page as it would be, on a copy of its own.

    A replaced block stays, with the new one after it, which its children move to. highlight_id is the new block's
    id in that text, old_id the replaced one's; new_at and old_at are their numbers. A decision that
    can't be done shows the page as it is, one whose block is there already with it as its highlight.
    """
    found = resolved(decisions, tree(outlines)).select(F.col("seq").alias("decision"), F.col("target_page").alias("page"), "target_seq", "done_as", "refined_text")
    alone = found.withColumn("done_as", F.when(F.col("done_as") == "done", "invalid").otherwise(F.col("done_as")))
    rows = alone.join(outlines, "page")
    target = F.get(F.filter("blocks", lambda b: b["seq"] == F.col("target_seq")), F.lit(0))
    rows = rows.withColumn("_at", key_of(target)).withColumn("_level", target["level"])
    act = F.col("done_as")
    swap = act == "replace"
    new_key = F.when(swap, after(F.col("_at"), F.lit(0))).when(act == "add_under", behind_last(F.col("_at"), F.lit(0))).when(act == "add_section", behind_last(F.lit(""), F.lit(0)))
    new_level = F.when(swap, F.col("_level")).when(act == "add_under", F.col("_level") + 1).otherwise(F.lit(0))
    rows = rows.withColumn("_new", new_key)
    below = lambda k: swap & k.startswith(F.concat("_at", F.lit("/")))
    place = lambda k: F.when(below(k), F.concat("_new", F.substring(k, F.length("_at") + 1, F.length(k)))).otherwise(k)
    own = F.transform("blocks", lambda b: F.struct(place(key_of(b)).alias("key"), b["level"].alias("level"), b["content"].alias("content")))
    more = F.array(F.struct(F.col("_new").alias("key"), new_level.alias("level"), F.split("refined_text", "\n").alias("content")))
    rows = rows.withColumn("blocks", F.array_sort(F.when(F.col("_new").isNotNull(), F.concat(own, more)).otherwise(own)))
    number_of = lambda k: F.when(k.isNotNull(), (F.array_position(F.transform("blocks", lambda b: b["key"]), k) - 1).cast("int"))
    shown = rows.select(F.col("decision"), F.col("page").alias("_page"), number_of(F.col("_new")).alias("new_at"), F.when(swap, number_of(F.col("_at"))).alias("old_at"), F.struct("decision", "page").alias("_k"), "indent", "frontmatter", "blocks")
    texts = outline.rendered(shown.withColumn("page", F.to_json("_k"))).withColumnRenamed("page", "_k")
    shown = shown.select(F.to_json("_k").alias("_k"), "decision", "_page", "new_at", "old_at").join(texts, "_k")
    ids = lambda of, name: _ids(shown, of).withColumnRenamed("id", name)
    out = shown.join(ids("new_at", "highlight_id"), "_k", "left").join(ids("old_at", "old_id"), "_k", "left")
    return out.select(F.col("decision").alias("seq"), F.col("_page").alias("page"), "text", "new_at", "old_at", "highlight_id", "old_id")


def _ids(shown: DataFrame, at: str) -> DataFrame:
    """_k and the id, by the page's name, of the block with a number in each text."""
    from notespan.functions import columns as C

    rows = outline.contexts(outline.parsed(shown.where(F.col(at).isNotNull()), page="_k")).select("page", "seq", "block_id", "context")
    own = rows.join(shown.select(F.col("_k").alias("page"), F.col(at).alias("seq"), "_page"), ["page", "seq"])
    return own.select(F.col("page").alias("_k"), C.hybrid_id(F.col("block_id"), F.col("context"), F.col("_page")).alias("id"))
