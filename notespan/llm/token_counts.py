"""Token counts kept up to date by signed changes.

A batch of changes holds inserts, deletes and revised counts of documents. It is reduced to signed
deltas of two additive totals, documents and tokens, for each source, language and tokenizer
version, and committed under its name: each attempt writes its deltas to a folder of its own, then a
marker with the batch's name, which only one attempt can make, says which folder counts. A batch
whose marker is there is not applied again; one that broke off before its marker is written anew.
compact() sums up the batches so far, so that totals read one table and the batches after it.
Totals are the sums of committed deltas; a group goes when it has neither documents nor tokens.

Deltas are pre-aggregated where the changes are, so a source with a third of all rows costs no more
than another. Null sources, languages and versions are groups of their own; null counts are 0.
Changes of an unknown kind are an error. No batches: no totals.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.llm.common import column_or_null, table, work_folder, written

KEYS = ["source", "lang", "tokenizer"]
DELTAS = "source string, lang string, tokenizer string, documents long, tokens long"
INSERT, DELETE, REVISE = "insert", "delete", "revise"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed sums from change (insert, delete or revise), before and after (token counts), by KEYS."""
    kind = F.col("change")
    before, after = F.coalesce(F.col("before"), F.lit(0)), F.coalesce(F.col("after"), F.lit(0))
    sign = F.when(kind == INSERT, 1).when(kind == DELETE, -1).when(kind == REVISE, 0).otherwise(F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(kind, F.lit("null")))).cast("int"))
    tokens = F.when(kind == INSERT, after).when(kind == DELETE, -before).otherwise(after - before)
    return changes.groupBy(*KEYS).agg(F.sum(sign).cast("long").alias("documents"), F.sum(tokens).cast("long").alias("tokens"))


class Rollup:
    """The totals in one folder, which all machines must share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _markers(self) -> dict[str, str]:
        """The batches that count, and the folder of each."""
        fs, at = self._path("commits")
        if not fs.exists(at):
            return {}
        return dict(r["value"].split("\t") for r in self.spark.read.text(f"{self.folder}/commits").collect())

    def committed(self) -> list[str]:
        """The names of the batches that count."""
        return sorted(self._markers())

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch, unless it has been; whether it did. changes has KEYS, change, before and after."""
        fs, marker = self._path("commits", batch)
        if fs.exists(marker):
            return False
        attempt = f"{batch}-{uuid.uuid4().hex}"
        deltas(changes).write.parquet(f"{self.folder}/deltas/{attempt}")
        return self._mark(batch, attempt)

    def _mark(self, batch: str, attempt: str) -> bool:
        """Makes an attempt count, unless another of its batch does: the marker is written aside and then renamed, which fails where there is one.

        That is atomic on HDFS; a store whose rename overwrites needs a lock around the commits of one batch.
        """
        fs, marker = self._path("commits", batch)
        _, aside = self._path("attempts", attempt)
        out = fs.create(aside, False)
        out.write(bytearray(f"{batch}\t{attempt}".encode()))
        out.close()
        fs.mkdirs(marker.getParent())
        return not fs.exists(marker) and fs.rename(aside, marker)

    def compact(self) -> None:
        """Sums up the batches so far: those whose markers are there now, both in the sums and in the list. A run that breaks off leaves the totals as they are."""
        markers = self._markers()
        if markers:
            kept = f"{self.folder}/compacted/{uuid.uuid4().hex}"
            self._sums(markers).withColumn("batches", F.array(*map(F.lit, sorted(markers)))).write.parquet(kept)
            fs, at = self._path("latest")
            out = fs.create(at, True)
            out.write(bytearray(kept.encode()))
            out.close()

    def _sums(self, markers: dict[str, str]) -> DataFrame:
        fs, latest = self._path("latest")
        parts, done = [], set()
        if fs.exists(latest):
            kept = self.spark.read.parquet(self.spark.read.text(f"{self.folder}/latest", wholetext=True).first()[0])
            done = set((kept.select("batches").first() or [[]])[0])
            parts.append(kept.select(*KEYS, "documents", "tokens"))
        if rest := [folder for name, folder in markers.items() if name not in done]:
            parts.append(self.spark.read.schema(DELTAS).parquet(*(f"{self.folder}/deltas/{x}" for x in rest)))
        rows = reduce(DataFrame.unionByName, parts)
        return rows.groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_documents, n_tokens."""
        markers = self._markers()
        if not markers:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_documents long, n_tokens long")
        return self._sums(markers).select(*KEYS, F.col("documents").alias("n_documents"), F.col("tokens").alias("n_tokens")).where("n_documents != 0 or n_tokens != 0")


# What the tokenizer versions count. The first was revised to leave out marks without letters or digits.
VERSIONS = {"white-1": r"[^\x20\x09-\x0D]+", "white-1 revised": r"[0-9A-Za-z\x80-\x{10FFFF}][^\x20\x09-\x0D]*", "letters-2": r"[0-9A-Za-z\x80-\x{10FFFF}]+"}


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang, a digest of the text, and its tokens by version as n1, n1_revised and n2; a null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n = dict(zip(["n1", "n1_revised", "n2"], VERSIONS.values(), strict=True))
    own = docs.where("doc_id is not null")
    return own.select(F.col("doc_id").cast("long"), *(column_or_null(own, c, "string").alias(c) for c in ("source", "lang")), F.sha2(text, 256).alias("digest"), *(F.regexp_count(text, F.lit(p)).cast("long").alias(c) for c, p in n.items()))


def history(docs: DataFrame) -> list[tuple[str, DataFrame]]:
    """Batches that bring a corpus in, take exact copies out again, revise the counts and add a second tokenizer version; the second comes twice."""
    rows = written(counted(docs))
    first = written(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id"))
    stay, copies = rows.join(first, "doc_id", "left_semi"), rows.join(first, "doc_id", "left_anti")
    nothing = F.lit(None).cast("long")
    change = lambda df, version, kind, before, after: df.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(kind).alias("change"), before.alias("before"), after.alias("after"))
    take_out = change(copies, "white-1", DELETE, F.col("n1"), nothing)
    return [
        ("1-insert", change(rows, "white-1", INSERT, nothing, F.col("n1"))),
        ("2-copies", take_out),
        ("3-revised", change(stay.where("n1 != n1_revised"), "white-1", REVISE, F.col("n1"), F.col("n1_revised"))),
        ("4-version", change(stay, "letters-2", INSERT, nothing, F.col("n2"))),
        ("2-copies", take_out),
    ]


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rollup = Rollup(spark, work_folder(spark))
    for batch, changes in history(table(spark, sf_dir, "documents")):
        rollup.commit(batch, changes)
    return rollup.totals()


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first
  FROM documents WHERE doc_id IS NOT NULL
), s AS (SELECT * FROM d WHERE doc_id = first)
SELECT source, lang, 'white-1' AS tokenizer, count(*) AS n_documents,
  CAST(sum(len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}][^\x20\x09-\x0D]*'))) AS BIGINT) AS n_tokens
FROM s GROUP BY source, lang
UNION ALL
SELECT source, lang, 'letters-2', count(*), CAST(sum(len(regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10FFFF}]+'))) AS BIGINT)
FROM s GROUP BY source, lang
"""
