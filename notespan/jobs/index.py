"""The search index of a folder of notes: built, brought up to date, and searched."""

from __future__ import annotations

import time
import uuid

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from notespan.functions import columns as C
from notespan.jobs.knn import OVERFETCH
from notespan.operators import chunks, models, outline
from notespan.operators.cells import Cells, dealt, fitted, reaches, searched
from notespan.operators.store import Store, Version
from notespan.sources import graph as G
from notespan.sources.work import work_folder, written

#: Another version of the rows: an index of another one is built anew.
VERSION = 3


def chunk_table(pages: DataFrame) -> DataFrame:
    """The index rows of pages (page, text, mtime), without embeddings."""
    parsed = outline.parsed(pages)
    rows = chunks.page_chunks(parsed).union(chunks.block_chunks(outline.contexts(parsed)))
    rows = chunks.last_wins(rows, ["chunk_id"], ["chunk_seq"])
    front = parsed.select("page", F.array_join(outline.trimmed(F.col("frontmatter")), "\n").alias("frontmatter"))
    return rows.join(front, "page").join(pages.select("page", F.col("mtime").cast("double").alias("mtime")), "page").withColumn("schema_version", F.lit(VERSION))


#: The columns of an index row.
ROW = "chunk_id string, page string, block_id string, chunk_seq int, document string, frontmatter string, mtime double, schema_version int, embedding array<float>, near double, cell int"
#: Times that a build starts anew from another one that was committed meanwhile.
ATTEMPTS = 8


def store_of(spark: SparkSession, index: str) -> Store:
    return Store(spark, index, "page", ROW, within=("cell",))


def build(spark: SparkSession, graph: str, index: str, encoder: models.Encoder | None = None) -> DataFrame:
    """Brings the index at a folder up to date with a graph; returns what changed (page, state).

    Only pages that changed are read, encoded and written, to their buckets; see Store. Of two builds at
    the same time one commits first, and the other looks at the graph again from there. A run that breaks off
    leaves the index as it was. How long the build took and what it wrote is kept with its version.
    """
    return _built(spark, graph, index, encoder, False)


def rebuilt(spark: SparkSession, graph: str, index: str, encoder: models.Encoder | None = None) -> DataFrame:
    """Builds the index anew, whatever is there, with its cells and as its next version; returns pages and their state."""
    return _built(spark, graph, index, encoder, True)


def _built(spark: SparkSession, graph: str, index: str, encoder: models.Encoder | None, anew: bool) -> DataFrame:
    store = store_of(spark, index)
    for _ in range(ATTEMPTS):
        began, old = time.monotonic(), store.version()
        anew = anew or old is None or old.schema != VERSION
        pages = G.pages(spark, graph).select("page", "text", F.col("mtime").cast("double").alias("mtime"))
        plan = written(pages.select("page", F.lit("new").alias("state")) if anew else chunks.changes(pages.select("page", "mtime"), store.read(old)))
        touched = plan.where("state != 'unchanged'")
        if not anew and touched.isEmpty():
            return plan
        todo = pages.join(plan.where(F.col("state").isin("new", "modified")), "page", "left_semi")
        rows, name, cells = models.encoded(chunk_table(todo), encoder), None if anew else old.facts["cells"], None
        if anew:
            rows = written(rows)
            cells, name = fitted(rows), uuid.uuid4().hex
            spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(cells.centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{index}/cells/{name}")
        else:
            cells = cells_of(spark, index, old)
        wrote = Observation()
        rows = dealt(rows, cells).observe(wrote, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("chunk_seq") < 0).alias("pages"), F.coalesce(F.sum(F.octet_length("document")), F.lit(0)).alias("bytes"))
        new = store.after(old, VERSION, rows, touched, {}, anew)
        least = dict(cells.least)
        for c, near in reaches(store.read(new) if anew else store.read(Version(0, VERSION, [p for p in new.parts if p.order == new.number]))).items():
            least[c] = min(near, least.get(c, near))
        new.facts = {"cells": name, "least": {str(c): v for c, v in least.items()}, "stats": {**wrote.get, "seconds": time.monotonic() - began}}
        if store.commit(new):
            return plan
        for segment in {p.segment for p in new.parts if p.order == new.number}:
            store.drop(segment)
    raise RuntimeError(f"{index}: other builds were always faster")


def cells_of(spark: SparkSession, index: str, version: Version) -> Cells:
    rows = spark.read.schema("cell int, centre array<double>").parquet(f"{index}/cells/{version.facts['cells']}").orderBy("cell").collect()
    return Cells(np.array([r["centre"] for r in rows]), {int(c): v for c, v in version.facts["least"].items()})


def versions(spark: SparkSession, index: str) -> list[int]:
    return store_of(spark, index).numbers()


def current(spark: SparkSession, index: str) -> DataFrame | None:
    store = store_of(spark, index)
    version = store.version()
    return store.read(version) if version else None


def statistics(spark: SparkSession, index: str) -> dict | None:
    """rows, pages, bytes and seconds of the last build that wrote something, as it was observed."""
    version = store_of(spark, index).version()
    return version.facts["stats"] if version else None


def estimated(spark: SparkSession, index: str, pages: int) -> float | None:
    """Seconds that a build of so many pages takes, by the last build's own record."""
    last = statistics(spark, index)
    if not last:
        return None
    return spark.range(1).select(C.estimated_seconds(F.lit(float(last["seconds"])), F.lit(last["pages"]), F.lit(pages))).first()[0]


def search(rows: DataFrame, queries: DataFrame, k: int = 20, cells: Cells | None = None, probes: int | None = None, encoder: models.Encoder | None = None) -> DataFrame:
    """query_id, rank, page, block_id, document, score of the best rows for each query (query_id, text).

    Three times as many rows as wanted are fetched by cosine; those of pages that the query's text links to
    are raised; the best k stay. With cells, rows that can't be among them aren't read; see operators.cells.
    """
    named = queries.select("query_id", F.col("text").alias("document"), C.page_links(F.coalesce("text", F.lit(""))).alias("links"))
    asked = models.encoded(named, encoder).select("query_id", "links", "embedding")
    near = searched(rows, asked, k * OVERFETCH, cells, probes)
    linked = F.array_contains("links", F.col("page")) | F.array_contains("links", F.replace("page", F.lit("/"), F.lit("___")))
    scored = near.withColumn("score", F.col("similarity") * F.when(linked, C.LINK_BOOST).otherwise(1.0))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "fetched")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "page", "block_id", "document", "score")


def search_index(spark: SparkSession, index: str, queries: DataFrame, k: int = 20, probes: int | None = None, encoder: models.Encoder | None = None) -> DataFrame:
    """search() in the index at a folder, with its cells; probes: so many cells a query and no more, which may lose some rows. No index gives no rows."""
    store = store_of(spark, index)
    version = store.version()
    if version is None:
        return search(spark.createDataFrame([], ROW), queries, k, encoder=encoder)
    return search(store.read(version), queries, k, cells_of(spark, index, version), probes, encoder)


def find_candidates(rows: DataFrame, edited: DataFrame, contexts: DataFrame, k: int = 20) -> DataFrame:
    """search() for every edited block: by its original context (block_id, context), or its original text where there is none. An empty index gives no candidates."""
    asked = edited.join(contexts, "block_id", "left").select(F.col("block_id").alias("query_id"), F.coalesce("context", "original_content").alias("text"))
    return search(rows, asked, k)


def page_frontmatter(rows: DataFrame, results: DataFrame) -> DataFrame:
    """page and frontmatter of the pages that results have, each once."""
    known = rows.groupBy("page").agg(F.first("frontmatter", ignorenulls=True).alias("frontmatter"))
    return known.join(results.select("page").distinct(), "page", "left_semi")


def count_rows(spark: SparkSession, index: str) -> int:
    """How many rows an index has; 0 without one."""
    rows = current(spark, index)
    return rows.count() if rows is not None else 0


def has_rows(spark: SparkSession, index: str) -> bool:
    """Whether there is an index with rows."""
    rows = current(spark, index)
    return rows is not None and not rows.isEmpty()


def encoder_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries over all documents as rows of an index, by counts of words; each item reads only the cells that can hold one of its best."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("text is not null and doc_id is not null")
    rows = written(models.encoded(d.select(F.coalesce("source", F.lit("")).alias("page"), F.col("doc_id").cast("string").alias("block_id"), F.col("text").alias("document")), models.word_counts).withColumn("document", F.lit(None).cast("string")))  # results have no text
    cells = fitted(rows)
    base = work_folder(spark)
    dealt(rows, cells).hint("rebalance", "cell").write.partitionBy("cell").parquet(base)
    rows = spark.read.parquet(base)
    cells.least = reaches(rows)
    asked = spark.read.parquet(f"{sf_dir}/benchmark.parquet").where("item_id is not null").select(F.col("item_id").alias("query_id"), "text")
    return search(rows, asked, 5, cells, encoder=models.word_counts).drop("document")


ENCODER_SEARCH = r"""
WITH t AS (SELECT 'd' AS kind, CAST(doc_id AS VARCHAR) AS id, text FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL UNION ALL SELECT 'q', CAST(item_id AS VARCHAR), coalesce(text, '') FROM benchmark WHERE item_id IS NOT NULL),
w AS (SELECT kind, id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS word FROM t),
c AS (SELECT kind, id, substr(md5(word), 1, 2) AS cell, count(*) AS n FROM w GROUP BY ALL),
norms AS (SELECT kind, id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM c GROUP BY ALL),
dots AS (SELECT q.id AS qid, d.id AS did, CAST(sum(q.n * d.n) AS DOUBLE) AS dot FROM c q JOIN c d ON q.cell = d.cell AND q.kind = 'q' AND d.kind = 'd' GROUP BY ALL),
s AS (
  SELECT b.item_id AS query_id, coalesce(b.text, '') AS asked, coalesce(source, '') AS page, CAST(doc_id AS VARCHAR) AS block_id, coalesce(dot / (nd.norm * nq.norm), 0) AS similarity
  FROM documents JOIN benchmark b ON documents.text IS NOT NULL AND doc_id IS NOT NULL AND item_id IS NOT NULL LEFT JOIN dots ON qid = CAST(item_id AS VARCHAR) AND did = CAST(doc_id AS VARCHAR)
    LEFT JOIN norms nd ON nd.kind = 'd' AND nd.id = did LEFT JOIN norms nq ON nq.kind = 'q' AND nq.id = qid
), f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, page, block_id) AS fetched FROM s),
r AS (SELECT *, similarity * CASE WHEN list_contains(regexp_extract_all(asked, '\[\[([^\]]+)\]\]', 1), page) THEN 1.5 ELSE 1.0 END AS score FROM f WHERE fetched <= 15),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, fetched) AS rank FROM r)
SELECT query_id, CAST(rank AS INT) AS rank, page, block_id, CAST(score AS DOUBLE) AS score FROM o WHERE rank <= 5
"""
