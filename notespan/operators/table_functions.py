"""Table functions for SQL: SELECT ... FROM pages, LATERAL chunks(page, text) or outline(text), and all_chunks(TABLE(...)).

Spark takes no Arrow function on the right of a lateral join, so those two yield rows; all_chunks gets whole
batches of a table. Their Python is the parser and what its results are put together by; index rows of
whole tables are made by expressions (operators.chunks), and all give the same rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from notespan.operators.outline import parse

CHUNK = pa.schema([("page", pa.string()), ("chunk_id", pa.string()), ("block_id", pa.string()), ("chunk_seq", pa.int32()), ("document", pa.string())])
MARKED = re.compile("^\\x00-?[0-9]+\\x00")
ID_LINE = re.compile(r"^\s*id::\s+\S", re.A)


def trimmed(lines: list[str]) -> list[str]:
    full = [i for i, x in enumerate(lines) if x.strip()]
    return lines[full[0] : full[-1] + 1] if full else []


def for_model(context: str, frontmatter: list[str]) -> str:
    lines = [x for x in context.split("\n") if not ID_LINE.match(x)]
    first = next((i for i, x in enumerate(lines) if x.strip().startswith("- ")), len(lines))
    known = {x.strip() for x in frontmatter}
    return "\n".join(x for i, x in enumerate(lines) if i >= first or (x.strip() and x.strip() not in known))


def chunks_of(page: str, text: str | None) -> list[tuple]:
    """chunk_id, block_id, chunk_seq and document of a page and its blocks; of blocks with one id the last."""
    out = parse(text)
    front, blocks = trimmed(out["frontmatter"]), out["blocks"]
    title = next((x.strip().removeprefix("title::").strip() for x in out["frontmatter"] if x.strip().startswith("title::")), "")
    own = [f"Page: {page}", *([f"Title: {title}"] if title and title != page else []), *(["\n".join(front)] if front else [])]
    head = "\n".join(front) + "\n\n" if front else ""
    found = {"__page__": ("__page__", -1, "\n".join(own))}
    for b in blocks:
        path = [*b["above"], b["seq"]]
        shown = ["\n".join("  " * d + ("  " if i else "- ") + MARKED.sub("", x) for i, x in enumerate(blocks[s]["content"])) for d, s in enumerate(path)]
        context = head + "\n".join(shown)
        name = b["block_id"] or hashlib.md5(f"{page}::{context}".encode()).hexdigest()
        found[name] = (name, b["seq"], for_model(context, out["frontmatter"]))
    return [(f"{page}::{name}", *row) for name, row in found.items()]


@udtf(returnType="chunk_id string, block_id string, chunk_seq int, document string")
class Chunks:
    """The index rows of a page: chunks(page, text). A null text has the page's own row, a null page none."""

    def eval(self, page: str, text: str) -> Iterator[tuple]:
        if page is not None:
            yield from chunks_of(page, text)


@udtf(returnType="seq int, parent int, depth int, level int, content string, block_id string")
class Outline:
    """The blocks of a text: outline(text)."""

    def eval(self, text: str) -> Iterator[tuple]:
        for b in parse(text)["blocks"]:
            yield b["seq"], b["parent"], b["depth"], b["level"], "\n".join(b["content"]), b["block_id"]


@arrow_udtf(returnType="page string, chunk_id string, block_id string, chunk_seq int, document string")
class AllChunks:
    """The index rows of a whole table with page and text, batch by batch: all_chunks(TABLE(...))."""

    def eval(self, pages: pa.RecordBatch) -> Iterator[pa.Table]:
        rows = [(p, *r) for p, t in zip(pages.column("page").to_pylist(), pages.column("text").to_pylist(), strict=True) if p is not None for r in chunks_of(p, t)]
        yield pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(CHUNK), CHUNK, strict=True)], schema=CHUNK)


def register(spark: SparkSession) -> None:
    spark.udtf.register("chunks", Chunks)
    spark.udtf.register("outline", Outline)
    spark.udtf.register("all_chunks", AllChunks)
