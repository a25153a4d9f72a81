"""One place to call the library from: a folder of notes, its index, models, and what a user does with them.

    s = Session(spark, graph, work, model=ask)
    s.search("how to bake bread").show()
    decisions = s.extract("2025-01-10..2025-01-15")
    s.integrate(decisions).show()
    s.views(); spark.sql("SELECT page, count(*) FROM pages, LATERAL outline(text) GROUP BY page")
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notespan.functions import columns as C
from notespan.jobs import extraction, index, writing
from notespan.operators import chunks, models, outline, table_functions
from notespan.operators import decisions as D
from notespan.sources import graph as G
from notespan.sources.work import work_folder, written


@dataclass
class Session:
    """graph: the folder of notes; work: a folder on shared storage for the index and answers of models; k: rows of a search; threshold: least confidence of a classification that is accepted."""

    spark: SparkSession
    graph: str
    work: str
    model: Callable[[str], Iterator[str]] | None = None
    encoder: models.Encoder | None = None
    k: int = 20
    threshold: float = D.THRESHOLD
    name: str = "notes"

    @property
    def index(self) -> str:
        return f"{self.work}/index"

    def update(self, reindex: bool = False) -> DataFrame:
        """Brings the index up to date, or builds it anew; page and state of what changed."""
        return (index.rebuilt if reindex else index.build)(self.spark, self.graph, self.index, self.encoder)

    def search(self, query: str, k: int | None = None, reindex: bool = False) -> DataFrame:
        """number (1 is the best), page, block_id, percent, snippet and link of what a query finds, after the index was brought up to date; the best stands last."""
        self.update(reindex)
        asked = self.spark.createDataFrame([("query", query)], "query_id string, text string")
        found = index.search_index(self.spark, self.index, asked, k or self.k, encoder=self.encoder)
        n = F.count("*").over(Window.partitionBy("query_id"))
        block = F.when(F.col("block_id") != "__page__", F.col("block_id"))
        link = C.deep_link(F.lit(self.name), F.col("page"), block)
        return found.select(F.col("rank").alias("number"), "page", "block_id", C.relevance(F.col("rank") - 1, n).alias("percent"), C.snippet(F.col("document")).alias("snippet"), link.alias("link")).orderBy(F.desc("number"))

    def journals(self, given: str | None = None, today: date | None = None) -> DataFrame:
        """The journals of a day, of a range A..B, or of today, sorted by day; a day without one is an error when it is read."""
        days = [(d,) for d in G.dates(given, today or date.today())]
        return G.by_day(G.entries(G.journals(self.spark, self.graph), self.spark.createDataFrame(days, "day date")))

    def extract(self, given: str | None = None, today: date | None = None) -> DataFrame:
        """Decisions about the knowledge in journals: seq, knowledge_block_id, target_page, action, target_block_id, confidence, reasoning, refined_text, day.

        Blocks that the model takes for knowledge, surely enough, are reworded; the index is asked for pages that
        each may belong to, and the model plans. Of decisions with one page, action and target the first stays.
        Answers are kept in work, so a run that is repeated asks nothing twice.
        """
        if self.model is None:
            raise ValueError("extract needs a model")
        journals = written(self.journals(given, today).select(F.col("stem").alias("page"), "day", "text"))
        blocks = written(outline.contexts(outline.parsed(journals), hash_pages=False).join(journals.select("page", "day"), "page").select("page", "day", "seq", F.col("hybrid_id").alias("block_id"), "context", F.array_join(F.transform("content", outline.unmarked), "\n").alias("text")))
        log = f"{self.work}/answers"
        said = extraction.classified(blocks.select(F.col("page").alias("request"), "block_id", "text", "seq"), self.model, log)
        sure = written(said.where(F.col("llm_confidence") >= self.threshold).select("block_id").distinct())
        chosen = written(chunks.first_wins(blocks.join(sure, "block_id"), ["block_id"], ["day", "seq"]))
        new = extraction.reworded(chosen.select(F.col("page").alias("request"), "block_id", "text", "context", "seq"), self.model, log)
        edited = written(chosen.join(new, "block_id", "left").withColumn("current_content", F.coalesce("reworded_content", "text")))
        self.update()
        asked = edited.select(F.col("block_id").alias("query_id"), F.col("context").alias("text"))
        found = index.search_index(self.spark, self.index, asked, self.k, encoder=self.encoder)
        front = index.page_frontmatter(index.current(self.spark, self.index), found)
        candidates = found.join(front, "page", "left").select(F.col("query_id").alias("block_id"), "page", F.col("block_id").alias("target"), "document", F.col("rank").alias("seq"), "frontmatter")
        plans = written(extraction.planned(edited.select("block_id", F.col("current_content").alias("text")), written(candidates), self.model, log))
        first = chunks.first_wins(plans, ["target_page", "action", "target_block_id"], ["knowledge_block_id", "place"])
        order = edited.select(F.col("block_id").alias("knowledge_block_id"), "day", F.col("seq").alias("_seq"), F.col("current_content").alias("refined_text"))
        rows = first.join(order, "knowledge_block_id").orderBy("day", "_seq", "knowledge_block_id", "place")
        seq = F.monotonically_increasing_id() + 1  # goes up in that order, with gaps between partitions
        return written(rows.withColumn("seq", seq).select("seq", "knowledge_block_id", "target_page", "action", "target_block_id", "confidence", "reasoning", "refined_text", "day"))

    def integrate(self, decisions: DataFrame) -> DataFrame:
        """Writes decisions into pages and links into journals; seq and error of each."""
        columns = "knowledge_block_id", F.col("seq").cast("long").alias("seq"), "target_page", "action", "target_block_id", "refined_text"
        return writing.integrate(self.spark, self.graph, decisions.select(*columns), work_folder(self.spark))

    def views(self) -> None:
        """Temporary views pages, journals and, with an index, notes_index; table functions chunks(page, text), outline(text) and all_chunks(TABLE(...))."""
        table_functions.register(self.spark)
        G.pages(self.spark, self.graph).createOrReplaceTempView("pages")
        G.journals(self.spark, self.graph).createOrReplaceTempView("journals")
        rows = index.current(self.spark, self.index)
        if rows is not None:
            rows.createOrReplaceTempView("notes_index")
