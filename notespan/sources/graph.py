"""Reads a folder of notes: journals/*.md and pages/*.md, each file a row."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.functions import columns as C


def folder_exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def files(spark: SparkSession, graph: str, kind: str) -> DataFrame:
    """path, stem, text (line ends as newlines) and mtime of every Markdown file of a kind (pages or journals); none without the folder."""
    if not folder_exists(spark, graph):
        raise ValueError(f"{graph} is no folder")
    if not folder_exists(spark, f"{graph}/{kind}"):
        return spark.createDataFrame([], "path string, stem string, text string, mtime timestamp")
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(f"{graph}/{kind}")
    return raw.select("path", F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("stem"), F.regexp_replace(F.decode("content", "utf-8"), "\r\n?", "\n").alias("text"), F.col("modificationTime").alias("mtime"))


def pages(spark: SparkSession, graph: str) -> DataFrame:
    return files(spark, graph, "pages").withColumn("page", C.display_name(F.col("stem")))


def journals(spark: SparkSession, graph: str) -> DataFrame:
    return files(spark, graph, "journals").withColumn("journal_date", F.try_to_timestamp(F.col("stem"), F.lit("yyyy_MM_dd")).cast("date"))


def dates(given: str | None, today: date) -> list[date]:
    """A day, or all days of A..B; today if nothing is given. Strictly YYYY-MM-DD."""
    if not given:
        return [today]
    parts = given.split("..")
    if len(parts) > 2 or not all(re.fullmatch(r"\d{4}-\d{2}-\d{2}", p) for p in parts):
        raise ValueError(f"{given} is no date and no range of dates")
    first, last = date.fromisoformat(parts[0]), date.fromisoformat(parts[-1])
    if last < first:
        raise ValueError(f"{given} ends before it begins")
    return [first + timedelta(days=k) for k in range((last - first).days + 1)]


def entries(journals_: DataFrame, wanted: DataFrame) -> DataFrame:
    """The journals of the wanted days (column day); a day without one is an error when its row is read."""
    found = wanted.join(journals_, wanted["day"] == journals_["journal_date"], "left")
    return found.withColumn("text", F.when(F.col("path").isNull(), F.raise_error(F.concat(F.lit("no journal for "), F.col("day").cast("string"))).cast("string")).otherwise(F.col("text")))


def by_day(journals_: DataFrame) -> DataFrame:
    """Journals in order of their day, a total order over files."""
    return journals_.orderBy("journal_date", "path")


def with_contents(candidates: DataFrame, pages_: DataFrame) -> DataFrame:
    """page, text and missing of every page that candidates name, each once; a page without a file, or whose text can't be read, is missing."""
    wanted = candidates.select("page").where("page is not null").distinct()
    return wanted.join(pages_.select("page", "text"), "page", "left").withColumn("missing", F.col("text").isNull())


def existing(candidates: DataFrame, pages_: DataFrame) -> DataFrame:
    """The candidates whose page has a file."""
    return candidates.join(pages_.select("page"), "page", "left_semi")
