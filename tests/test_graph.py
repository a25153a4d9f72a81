import os
from datetime import date

import pytest

from notespan.jobs import index
from notespan.sources import graph
from notespan.streaming.ingest import ingest


@pytest.fixture
def notes(tmp_path):
    for kind in ("pages", "journals"):
        os.makedirs(tmp_path / "g" / kind)
    (tmp_path / "g/pages/A.md").write_text("title:: Alpha\n- one\n  - two")
    (tmp_path / "g/pages/A___B.md").write_text("- three\r\n")
    (tmp_path / "g/journals/2025_01_15.md").write_text("- day")
    return tmp_path


def test_pages_and_journals(spark, notes):
    assert sorted(r["page"] for r in graph.pages(spark, f"{notes}/g").collect()) == ["A", "A/B"]
    assert graph.journals(spark, f"{notes}/g").first()["journal_date"] == date(2025, 1, 15)
    with pytest.raises(ValueError):
        graph.pages(spark, f"{notes}/none")


def test_dates():
    today = date(2025, 3, 1)
    assert graph.dates(None, today) == [today]
    assert len(graph.dates("2024-02-27..2024-03-01", today)) == 4
    for bad in ("2025-1-5", "2025-01-02..2025-01-01", "x", "2025-01-01..2025-01-02..2025-01-03", "20250101"):
        with pytest.raises(ValueError):
            graph.dates(bad, today)


def test_missing_journal_raises(spark, notes):
    wanted = spark.createDataFrame([(date(2025, 1, 15),), (date(2025, 1, 16),)], "day date")
    with pytest.raises(Exception, match="no journal for 2025-01-16"):
        graph.entries(graph.journals(spark, f"{notes}/g"), wanted).select("text").collect()


def test_index_follows_the_graph(spark, notes):
    at = f"{notes}/index"
    assert {r["state"] for r in index.build(spark, f"{notes}/g", at).collect()} == {"new"}
    assert index.current(spark, at).count() == 5
    (notes / "g/pages/A.md").write_text("- changed")
    os.utime(notes / "g/pages/A.md", (2e9, 2e9))
    (notes / "g/pages/A___B.md").unlink()
    (notes / "g/pages/C.md").write_text("- new")
    states = {r["page"]: r["state"] for r in index.build(spark, f"{notes}/g", at).collect()}
    assert states == {"A": "modified", "A/B": "deleted", "C": "new"}
    assert sorted({r["page"] for r in index.current(spark, at).collect()}) == ["A", "C"]
    assert {r["state"] for r in index.build(spark, f"{notes}/g", at).collect()} == {"unchanged"}


def test_stream_takes_new_files_once(spark, notes):
    for _ in range(2):
        ingest(spark, f"{notes}/g/pages", f"{notes}/blocks", f"{notes}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{notes}/blocks").count() == 3
    (notes / "g/pages/D.md").write_text("- later")
    ingest(spark, f"{notes}/g/pages", f"{notes}/blocks", f"{notes}/checkpoint").awaitTermination()
    assert spark.read.parquet(f"{notes}/blocks").count() == 4


def test_contents_of_candidate_pages(spark):
    pages = spark.createDataFrame([("a", "x"), ("b", None)], "page string, text string")
    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("c", 4), (None, 5)], "page string, n int")
    got = {r["page"]: (r["text"], r["missing"]) for r in graph.with_contents(asked, pages).collect()}
    assert got == {"a": ("x", False), "b": (None, True), "c": (None, True)}
    assert sorted(r["n"] for r in graph.existing(asked, pages).collect()) == [1, 2, 3]
