"""Outlines: Markdown bullets to ordered block rows and back.

A file is a row; its blocks are an array in reading order, each with the number of its parent and of
all blocks above it. Parsing is a state machine over lines, so it runs in Arrow batches; everything
after it is expressions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notespan.functions import columns as C

FENCE = "```"
BLOCK = pa.struct([("seq", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()), ("level", pa.int32()), ("content", pa.list_(pa.string())), ("block_id", pa.string()), ("above", pa.list_(pa.int32())), ("last", pa.int32())])
SCHEMA = "page string, indent string, frontmatter array<string>, blocks array<struct<seq: int, parent: int, depth: int, level: int, content: array<string>, block_id: string, above: array<int>, last: int>>"


def is_bullet(line: str) -> bool:
    own = line.lstrip()
    return own == "-" or own.startswith("- ")


def indent_unit(lines: list[str]) -> str:
    """The shortest white space before a line that begins with a dash, or two spaces."""
    found = [x[: len(x) - len(x.lstrip())] for x in lines if x.lstrip().startswith("-")]
    return min((x for x in found if x), key=len, default="  ")


#: Marks a line that stands further left than its bullet's text, with how far, when indents are kept.
MARK = "\0"


def parse(text: str | None, strict: bool = False) -> dict:
    """indent, frontmatter and blocks of one text. Null and blank texts have none.

    A fence lasts within the lines before the first bullet, or within one bullet, whose own text may open
    it. strict keeps how far lines stand left of their bullet's text, behind MARK; else they lose their indent.
    """
    if not text or not text.strip():
        return {"indent": "  ", "frontmatter": [], "blocks": []}
    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    unit, fenced, base = indent_unit(lines), False, ""
    front: list[str] = []
    blocks: list[dict] = []
    stack: list[dict] = []  # the blocks above the next one
    for line in lines:
        own = line.lstrip()
        space = line[: len(line) - len(own)]
        if own.startswith(FENCE):
            fenced = not fenced
        level = space.count(unit)
        bullet = not fenced and is_bullet(line)
        if bullet and blocks and space != unit * level and level <= blocks[-1]["level"]:
            bullet = False  # misaligned: more text of the block before
        if not bullet:
            if not blocks:
                front.append(line)
            elif line.startswith(base):
                blocks[-1]["content"].append(line[len(base) :])
            else:
                blocks[-1]["content"].append(f"{MARK}{len(base) - len(space)}{MARK}{own}" if strict else own)
            continue
        del stack[level:]
        if level == 0 or not stack or stack[-1]["level"] != level - 1:
            stack = []
        for b in stack:
            b["last"] = len(blocks)
        block = {"seq": len(blocks), "last": len(blocks), "parent": stack[-1]["seq"] if stack else None, "depth": len(stack), "level": level, "content": [own[2:] if own != "-" else ""], "above": [b["seq"] for b in stack]}
        blocks.append(block)
        stack.append(block)
        base, fenced = space + "  ", block["content"][0].startswith(FENCE)
    for b in blocks:
        b["block_id"] = next((value.strip() for key, sep, value in (x.partition("::") for x in b["content"]) if sep and key.strip() == "id"), None)
    return {"indent": unit, "frontmatter": front, "blocks": blocks}


#: Characters of text that are parsed at once: what a worker holds follows these, not the rows of a batch.
PIECE = 1 << 18


def in_pieces(batch: pa.RecordBatch, column: str, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """A batch's rows in pieces of about so many bytes of a text column, of one row at least; an empty batch as it is."""
    if not batch.num_rows:
        yield batch
    ends = pc.cumulative_sum(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64())).to_numpy()
    row = 0
    while row < batch.num_rows:
        before = ends[row - 1] if row else 0
        to = max(row + 1, int(ends.searchsorted(before + size, "right")))
        yield batch.slice(row, to - row)
        row = to


def parsed(pages: DataFrame, page: str = "page", text: str = "text", strict: bool = False) -> DataFrame:
    """page, indent, frontmatter, blocks: one row for each row of pages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in in_pieces(batch, "text"):
                out = [parse(t, strict) for t in own.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([own.column("page"), pa.array([o["indent"] for o in out], pa.string()), pa.array([o["frontmatter"] for o in out], pa.list_(pa.string())), pa.array([o["blocks"] for o in out], pa.list_(BLOCK))], names=["page", "indent", "frontmatter", "blocks"])

    return pages.select(F.col(page).cast("string").alias("page"), F.col(text).cast("string").alias("text")).mapInArrow(run, SCHEMA)


def unmarked(line: Column) -> Column:
    """A line without the mark of its indent: what is hashed and shown."""
    return F.regexp_replace(line, "^\\x00-?[0-9]+\\x00", "")


def trimmed(frontmatter: Column) -> Column:
    """Without blank lines at both ends."""
    at = F.filter(F.transform(frontmatter, lambda x, i: F.when(C.strip(x) != "", i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.slice(frontmatter, F.array_min(at) + 1, F.array_max(at) - F.array_min(at) + 1)).otherwise(F.array().cast("array<string>"))


def bullet(lines: Column, unit: Column, level: Column) -> Column:
    """Lines as one bullet at a level."""
    space = F.repeat(unit, level)
    return F.array_join(F.transform(lines, lambda x, i: F.concat(space, F.when(i == 0, "- ").otherwise("  "), x)), "\n")


def contexts(outlines: DataFrame, hash_pages: bool = True) -> DataFrame:
    """One row for each block: page, seq, parent, depth, level, content, block_id, context and hybrid_id.

    The context is the frontmatter, a blank line, then each block above and the block itself as
    bullets at their depth. Journals hash without their name (hash_pages false).
    """
    shown = lambda b, d: bullet(F.transform(b["content"], unmarked), F.lit("  "), d)
    front = trimmed(F.col("frontmatter"))
    head = F.when(F.size(front) > 0, F.concat(F.array_join(front, "\n"), F.lit("\n\n"))).otherwise(F.lit(""))
    path = F.transform(F.concat(F.col("b.above"), F.array("b.seq")), lambda s, i: shown(F.get("blocks", s), i))
    rows = outlines.select("page", "blocks", "frontmatter", head.alias("head"), F.explode("blocks").alias("b")).withColumn("context", F.concat("head", F.array_join(path, "\n")))
    own_id = C.hybrid_id(F.col("b.block_id"), F.col("context"), F.col("page") if hash_pages else None)
    return rows.select("page", "b.seq", "b.parent", "b.depth", "b.level", "b.content", "b.block_id", "b.last", "context", own_id.alias("hybrid_id"), for_model(F.col("context"), F.col("frontmatter")).alias("clean"))


def file_text(blocks: str = "blocks") -> Column:
    """A file's text from its indent, its frontmatter and a column of blocks at their textual level; empty lines at the end of a block are dropped."""

    def lines(b: Column) -> Column:
        space = F.repeat(F.col("indent"), b["level"])
        first = F.get(b["content"], F.lit(0))
        size = F.coalesce(F.array_max(F.transform(b["content"], lambda x, i: F.when((i == 0) | (x != ""), i + 1))), F.lit(1))
        less = lambda x: F.greatest(F.regexp_extract(x, "^\\x00(-?[0-9]+)\\x00", 1).cast("int"), F.lit(0))
        under = F.concat(space, F.lit("  "))
        more = F.transform(F.slice(b["content"], F.lit(2), size - 1), lambda x: F.when(x.startswith(MARK), F.concat(F.substring(under, F.lit(1), F.length(under) - less(x)), unmarked(x))).otherwise(F.concat(under, x)))
        return F.concat(F.array(F.concat(space, F.when(first == "", "-").otherwise(F.concat(F.lit("- "), first)))), more)

    return F.array_join(F.concat("frontmatter", F.flatten(F.transform(blocks, lines))), "\n")


def rendered(outlines: DataFrame) -> DataFrame:
    """page, text: the frontmatter and all blocks, see file_text()."""
    return outlines.select("page", file_text().alias("text"))


def without_covered(blocks: DataFrame, selected: DataFrame) -> DataFrame:
    """Of the selected blocks (page, seq) those that are below no other selected one; blocks has page, seq and above (the seqs above it)."""
    own = blocks.join(selected.select("page", "seq").distinct(), ["page", "seq"])
    over = own.select("page", F.explode("above").alias("_over"), F.col("seq"))
    covered = over.join(selected.select(F.col("page"), F.col("seq").alias("_over")).distinct(), ["page", "_over"]).select("page", "seq").distinct()
    return own.join(covered, ["page", "seq"], "left_anti")


def for_model(context: Column, frontmatter: Column) -> Column:
    """A context without id lines and, before its first bullet, without blank lines and frontmatter, which a model gets once for the page."""
    lines = F.filter(F.split(context, "\n"), lambda x: ~x.rlike(r"^\s*id::\s+\S"))
    known = F.transform(frontmatter, C.strip)
    first = lambda xs: F.coalesce(F.array_min(F.transform(xs, lambda x, i: F.when(C.strip(x).startswith("- "), i))), F.size(xs))
    return F.array_join(F.filter(lines, lambda x, i: (i >= first(lines)) | ((C.strip(x) != "") & ~F.array_contains(known, C.strip(x)))), "\n")


def as_xml(chunks: DataFrame) -> DataFrame:
    """request and xml: the chunks that a request may refer to, by page in order of name, then in their own order (seq)."""
    block = F.concat(F.lit('<block id="'), C.xml_escape(F.col("block_id")), F.lit('">'), C.xml_escape(F.col("document")), F.lit("</block>"))
    one = chunks.groupBy("request", "page").agg(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))).alias("bs"))
    page = F.concat(F.lit('<page name="'), C.xml_escape(F.col("page")), F.lit('">'), F.array_join(F.transform("bs", lambda x: x["b"]), ""), F.lit("</page>"))
    pages = one.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("page", page.alias("p")))).alias("ps"))
    return pages.select("request", F.array_join(F.transform("ps", lambda x: x["p"]), "\n").alias("xml"))


def pages_xml(chunks: DataFrame) -> DataFrame:
    """request and xml: what a plan may refer to, as a model gets it: pages by name, each with its properties, then its blocks in their own order, a part to a line.

    chunks: request, page, seq, block_id (as shown), document, frontmatter (lines, or null) and of_page, whether
    a row is the page itself, whose properties aren't shown a second time. Names and ids are escaped, contents are as they are.
    A request's rows are one prompt, so they are few.
    """
    lines = F.coalesce(F.split("frontmatter", "\n"), F.array().cast("array<string>"))
    own = F.when(F.col("of_page"), for_model(F.col("document"), lines)).otherwise(F.col("document"))
    block = F.concat(F.lit('<block id="'), C.xml_escape(F.col("block_id")), F.lit('">\n'), F.coalesce(own, F.lit("")), F.lit("\n</block>"))
    one = chunks.groupBy("request", "page").agg(F.array_sort(F.collect_list(F.struct("seq", block.alias("b")))).alias("bs"), F.first("frontmatter", ignorenulls=True).alias("frontmatter"))
    full = F.filter(F.split("frontmatter", "\n"), lambda x: C.strip(x) != "")
    properties = F.when(F.size(full) > 0, F.concat(F.lit("<properties>\n"), F.array_join(full, "\n"), F.lit("\n</properties>")))
    page = F.concat_ws("\n", F.concat(F.lit('<page name="'), C.xml_escape(F.col("page")), F.lit('">')), properties, F.array_join(F.transform("bs", lambda x: x["b"]), "\n"), F.lit("</page>"))
    pages = one.groupBy("request").agg(F.array_sort(F.collect_list(F.struct("page", page.alias("p")))).alias("ps"))
    return pages.select("request", F.concat(F.lit("<pages>\n"), F.array_join(F.transform("ps", lambda x: x["p"]), "\n"), F.lit("\n</pages>")).alias("xml"))


def block_total(outlines: DataFrame) -> DataFrame:
    """One row: n_roots, the blocks at the top of all outlines, and n_blocks, all of them."""
    roots = F.size(F.filter("blocks", lambda b: b["parent"].isNull()))
    return outlines.agg(F.coalesce(F.sum(roots), F.lit(0)).alias("n_roots"), F.coalesce(F.sum(F.size("blocks")), F.lit(0)).alias("n_blocks"))
