import os
import random

import pytest
from pyspark.sql import functions as F

from notespan.operators import chunks, outline, runs
from notespan.sources import folder
from notespan.streaming import following as follow


@pytest.fixture
def notes(spark, tmp_path):
    folder.register(spark)
    os.makedirs(tmp_path / "pages")
    for i in range(30):
        (tmp_path / f"pages/A___{i}.md").write_bytes(f"- page {i}\r\n  - é {i}".encode())
    (tmp_path / "pages/other.txt").write_text("x")
    return tmp_path


def load(spark, notes, schema=None):
    reader = spark.read.format("notes").option("path", f"{notes}/pages")
    return (reader.schema(schema) if schema else reader).load()


def test_files_of_a_folder(spark, notes):
    rows = load(spark, notes).orderBy("path").collect()
    assert len(rows) == 30 and rows[0]["text"] == "- page 0\n  - é 0" and (rows[0]["page"], rows[0]["stem"], rows[0]["state"]) == ("A/0", "A___0", "new")
    assert rows[0]["length"] == os.path.getsize(notes / "pages/A___0.md")
    assert load(spark, notes / "none").count() == 0


def test_only_the_files_that_conditions_leave_are_opened(spark, notes):
    os.chmod(notes / "pages/A___3.md", 0)
    (notes / "pages/A___3.md").unlink()
    os.symlink("/nowhere/at/all", notes / "pages/A___4x.md")
    assert [r["page"] for r in load(spark, notes).where("page = 'A/7'").collect()] == ["A/7"]
    assert sorted(r["page"] for r in load(spark, notes).where(F.col("stem").isin("A___1", "A___2")).collect()) == ["A/1", "A/2"]
    assert load(spark, notes).where("page = 'A/7' and text like '%7%' and length > 3").count() == 1
    assert load(spark, notes).where("mtime > '2100-01-01'").count() == 0
    reader = folder.FolderReader({"path": f"{notes}/pages"}, ["path", "mtime"])
    left = list(reader.pushFilters([folder.EqualTo(("page",), "A/9"), folder.EqualTo(("text",), "x")]))
    assert len(left) == 1 and [f.path[-8:] for p in reader.partitions() for f in p.files] == ["A___9.md"]


def test_without_text_no_file_is_read(spark, notes, monkeypatch):
    pack = folder.Pack([folder.File("/nowhere/A.md", 0.0, 1)])
    assert list(folder.rows(pack, ["path", "page"], f"{notes}/pages", ".md")) == [("/nowhere/A.md", "A")]
    assert list(folder.rows(pack, ["path", "text"], f"{notes}/pages", ".md")) == []
    assert load(spark, notes, "page string, mtime timestamp").count() == 30
    monkeypatch.setattr(folder, "PACK", 50)
    assert len(folder.packed(folder.listed(f"{notes}/pages", ".md"))) > 10


def test_stream_of_listings(notes):
    options = {"path": f"{notes}/pages", "state": f"{notes}/state"}
    stream = folder.FolderStream(options, ["page", "state", "text"])
    start, first = stream.initialOffset(), stream.latestOffset()
    of = lambda a, b: sorted(r for p in stream.partitions(a, b) for r in stream.read(p))
    assert len(of(start, first)) == 30 and stream.latestOffset() == first
    (notes / "pages/A___1.md").write_text("- changed")
    (notes / "pages/A___2.md").unlink()
    (notes / "pages/B.md").write_text("- b")
    second = folder.FolderStream(options, ["page", "state", "text"]).latestOffset()  # another process goes on from the same listings
    want = [("A/1", "modified", "- changed"), ("A/2", "deleted", None), ("B", "new", "- b")]
    assert of(first, second) == want and of(first, second) == want
    stream.commit(second)
    assert [f for f in os.listdir(notes / "state")] == ["2"]
    with pytest.raises(ValueError):
        folder.FolderStream({"path": "x"}, [])


def test_blocks_follow_rewritten_and_deleted_files(spark, notes):
    at = lambda: follow.follow(spark, f"{notes}/pages", f"{notes}/blocks", f"{notes}/check").awaitTermination()
    store = follow.blocks_of(spark, f"{notes}/blocks")
    read = lambda: sorted((r["page"], r["document"]) for r in store.read(store.version()).collect())

    def whole():
        pages = load(spark, notes).select("page", "text")
        return sorted((r["page"], r["document"]) for r in chunks.block_chunks(outline.contexts(outline.parsed(pages))).collect())

    at()
    assert read() == whole() and len(read()) == 60
    (notes / "pages/A___1.md").write_text("- changed")
    (notes / "pages/A___2.md").unlink()
    (notes / "pages/B.md").write_text("- b")
    at()
    assert read() == whole() and len(read()) == 58
    before = store.numbers()
    at()
    assert store.numbers() == before  # nothing new, nothing written
    follow.replaced(store, store.version().facts["batch"], store.read(store.version()).limit(0), spark.createDataFrame([("B",)], "page string"))
    assert read() == whole()  # a batch that is run again


@pytest.mark.parametrize("parts", [1, 4])
def test_shared_list_over_any_split(spark, tmp_path, parts):
    r = random.Random(parts)
    rows = [(i, f"b{r.randint(0, 5)}", r.choice("PQ"), r.choice(["replace", "add_section"]), r.choice([None, "", "t"]), i % 11 == 0) for i in range(80)]
    r.shuffle(rows)
    schema = f"{follow.DECISION}, done boolean"
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        follow.shared_decisions(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/check")
    want, done = {}, {b for _, b, *_, d in rows if d}
    for s, b, p, a, t, _ in sorted(rows):
        want.setdefault((p, a, t), (s, b, b in done))
    got = {(x["target_page"], x["action"], x["target_block_id"]): (x["seq"], x["knowledge_block_id"], x["ready"]) for x in follow.shared_list(spark, f"{tmp_path}/out").collect()}
    assert got == want
    store = follow.blocks_ready(spark, f"{tmp_path}/out")
    assert {x["knowledge_block_id"]: x["n"] for x in store.read(store.version()).collect()} == {b: sum(x[1] == b for x in rows) for b in {x[1] for x in rows}}


def test_windows_in_ranges_equal_whole_ones(spark, monkeypatch):
    monkeypatch.setattr(runs, "SPAN", 5)
    r = random.Random(8)
    rows = [(g, n, r.choice(["a", "a", "b", None])) for g in ("x", "y", None) for n in sorted(r.sample(range(-20, 90), 40))] + [("z", 3, "b")]
    df = spark.createDataFrame(rows, "g string, n int, k string")
    got = {(x["g"], x["n"]): x for x in runs.in_runs(runs.matched(df, F.col("k") == "a", "n", ["g"]), "k", "n", ["g"]).collect()}
    place = {(x["g"], x["n"]): x["p"] for x in runs.ranked(df, "n", "k", ["g"], "p").collect()}
    for g in ("x", "y", None, "z"):
        own = [(n, k) for h, n, k in rows if h == g]
        hits, run = [n for n, k in own if k == "a"], 0
        for i, (n, k) in enumerate(own):
            run += i == 0 or k != own[i - 1][1]
            after, before = [h for h in hits if h > n], [h for h in hits if h < n]
            want = (after or hits or [None])[0], (before or hits or [None])[-1], run
            assert (got[g, n]["next_at"], got[g, n]["previous_at"], got[g, n]["run"]) == want, (g, n)
            assert place[g, n] == i + 1
    assert len(got) == len(rows)
