import numpy as np
import pytest

from notespan.jobs import catalogue
from tests.compare import by_spark, by_sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert by_spark(catalogue.queries()[name](spark, SF)) == by_sql(catalogue.oracle_sql()[name], SF)


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert entry.entry(spark).count() == 10 * spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 20 = 0").count()


def test_search_by_words(spark):
    from notespan.jobs.index import search
    from notespan.operators import models

    rows = models.encoded(spark.createDataFrame([("A", "1", "red apple [[B]]", "f:: a"), ("B", "2", "apple tree", None), ("C/D", "3", "stone tree", "")], "page string, block_id string, document string, frontmatter string"))
    of = lambda text, k=2: [(r["page"], round(r["score"], 4)) for r in search(rows, spark.createDataFrame([(1, text)], "query_id int, text string"), k).orderBy("rank").collect()]
    assert [p for p, _ in of("red apple")] == ["A", "B"]  # a link in a found row raises nothing
    plain, raised = dict(of("tree", 3)), dict(of("tree [[C___D]]", 3))
    assert plain["B"] == plain["C/D"] and [p for p, _ in of("tree [[C___D]]", 3)][0] == "C/D"
    exact = np.array([float(models.word_cells(["tree [[C___D]]"])[0] @ models.word_cells(["stone tree"])[0]) * 1.5])
    assert raised["C/D"] == pytest.approx(exact[0], abs=1e-4)


def test_candidates_of_edited_blocks(spark):
    from notespan.jobs.index import find_candidates, page_frontmatter
    from notespan.operators import models

    rows = models.encoded(spark.createDataFrame([("A", "1", "red apple", "f:: a"), ("B", "2", "grey stone", "f:: b")], "page string, block_id string, document string, frontmatter string"))
    edited = spark.createDataFrame([("k1", "red", "blue"), ("k2", "stone", "x")], "block_id string, original_content string, current_content string")
    contexts = spark.createDataFrame([("k2", "grey stone")], "block_id string, context string")
    got = find_candidates(rows, edited, contexts, 1)
    assert {(r["query_id"], r["page"]) for r in got.collect()} == {("k1", "A"), ("k2", "B")}
    assert {(r["page"], r["frontmatter"]) for r in page_frontmatter(rows, got.where("query_id = 'k1'")).collect()} == {("A", "f:: a")}
    assert find_candidates(rows.limit(0), edited, contexts).count() == 0
