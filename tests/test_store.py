import os
import random

import numpy as np
import pytest

from notespan.jobs import index
from notespan.operators import cells, models, store
from notespan.operators.store import Store

ROWS = "k string, v int"


def table(spark, rows):
    return spark.createDataFrame(rows, ROWS)


def keys(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "k string")


def read(s, number=None):
    return sorted((r["k"], r["v"]) for r in s.read(s.version(number)).collect())


@pytest.fixture
def kept(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", "k", ROWS, buckets=4)
    rows = [(f"k{i}", j) for i in range(20) for j in range(2)]
    assert s.commit(s.after(None, 1, table(spark, rows), table(spark, rows), {"a": 1}))
    return s, rows


def test_changes_stand_beside_their_base(spark, kept):
    s, rows = kept
    assert read(s) == sorted(rows) and s.version().facts == {"a": 1}
    new = s.after(s.version(), 1, table(spark, [("k3", 9), ("new", 1)]), keys(spark, "k3", "new", "k4"), {})
    assert s.commit(new)
    assert read(s) == sorted([r for r in rows if r[0] not in ("k3", "k4")] + [("k3", 9), ("new", 1)])
    assert read(s, 0) == sorted(rows)  # a reader of the version before still has it
    again = s.after(s.version(), 1, table(spark, [("k4", 5)]), keys(spark, "k4"), {})
    assert s.commit(again) and ("k4", 5) in read(s) and s.numbers() == [1, 2]


def test_one_key_writes_one_bucket(spark, kept):
    s, _ = kept
    new = s.after(s.version(), 1, table(spark, [("k3", 9)]), keys(spark, "k3"), {})
    segment = next(p for p in new.parts if not p.base)
    folders = [d for d in os.listdir(f"{s.path}/rows/segment={segment.segment}") if d.startswith("bucket=")]
    assert folders == [f"bucket={segment.bucket}"] and sum(not p.base for p in new.parts) == 1
    assert {p.segment for p in new.parts if p.base} == {p.segment for p in s.version().parts}


def test_two_that_start_from_one_version(spark, kept):
    s, rows = kept
    a, b = (s.after(s.version(), 1, table(spark, [(n, 1)]), keys(spark, n), {}) for n in ("a", "b"))
    assert s.commit(a) and not s.commit(b)
    assert s.commit(s.after(s.version(), 1, table(spark, [("b", 1)]), keys(spark, "b"), {}))
    assert read(s) == sorted([*rows, ("a", 1), ("b", 1)])
    assert os.listdir(f"{s.path}/staged") in ([], [f for f in os.listdir(f"{s.path}/staged") if f.endswith(".crc")])


def test_outgrown_buckets_are_merged_and_old_segments_go(spark, kept, monkeypatch):
    monkeypatch.setattr(store, "MOST", 2)
    monkeypatch.setattr(store, "BROADCAST_BYTES", 0)
    s, rows = kept
    want = dict.fromkeys(rows)
    for n in range(5):
        want = {r: None for r in want if r[0] != "k3"} | {("k3", n): None}
        assert s.commit(s.after(s.version(), 1, table(spark, [("k3", n)]), keys(spark, "k3"), {}))
        assert read(s) == sorted(want)
    parts = s.version().parts
    assert max(sum(p.bucket == b for p in parts) for b in range(4)) <= 3
    live = {p.segment for n in s.numbers() for p in s.version(n).parts}
    assert {d.split("=")[1] for d in os.listdir(f"{s.path}/rows")} == live


def test_deleting_everything_and_empty_tables(spark, tmp_path):
    s = Store(spark, f"{tmp_path}/s", "k", ROWS, buckets=2)
    assert s.version() is None and s.numbers() == []
    assert s.commit(s.after(None, 1, table(spark, []), keys(spark), {})) and read(s) == []
    assert s.commit(s.after(s.version(), 1, table(spark, [("a", 1)]), keys(spark, "a"), {})) and read(s) == [("a", 1)]
    assert s.commit(s.after(s.version(), 1, table(spark, []), keys(spark, "a"), {})) and read(s) == []


@pytest.fixture
def notes(tmp_path):
    os.makedirs(tmp_path / "g/pages")
    for i in range(12):
        (tmp_path / f"g/pages/P{i}.md").write_text(f"- page {i}\n  - more {i}")
    return tmp_path


def change(path, text, when):
    path.write_text(text)
    os.utime(path, (when, when))


def test_interleaved_builds_keep_both(spark, notes, monkeypatch):
    at, g = f"{notes}/index", f"{notes}/g"
    index.build(spark, g, at)
    change(notes / "g/pages/P1.md", "- one changed", 2e9)
    plain, met = index.reaches, []

    def slow(rows):  # while the first build has written its rows, but not its version, a second one begins and ends
        if not met:
            met.append(1)
            change(notes / "g/pages/P2.md", "- two changed", 2e9)
            (notes / "g/pages/New.md").write_text("- new")
            index.build(spark, g, at)
        return plain(rows)

    monkeypatch.setattr(index, "reaches", slow)
    index.build(spark, g, at)
    assert met and index.versions(spark, at) == [0, 1]
    documents = {(r["page"], r["document"]) for r in index.current(spark, at).where("chunk_seq >= 0").collect()}
    assert {("P1", "- one changed"), ("P2", "- two changed"), ("New", "- new"), ("P3", "- page 3")} <= documents
    assert not any(p == "P1" and "page 1" in d for p, d in documents)
    assert {d.split("=")[1] for d in os.listdir(f"{at}/rows")} == {p.segment for n in (0, 1) for p in index.store_of(spark, at).version(n).parts}  # what lost is gone


def test_one_changed_page_is_all_that_is_written(spark, notes):
    at, g = f"{notes}/index", f"{notes}/g"
    index.build(spark, g, at)
    assert index.count_rows(spark, at) == 36 and index.statistics(spark, at)["pages"] == 12
    assert index.estimated(spark, at, 24) == pytest.approx(2 * index.statistics(spark, at)["seconds"])
    change(notes / "g/pages/P7.md", "- seven", 2e9)
    index.build(spark, g, at)
    version = index.store_of(spark, at).version()
    assert sum(not p.base for p in version.parts) == 1 and index.statistics(spark, at)["rows"] == 2
    assert index.count_rows(spark, at) == 35
    asked = spark.createDataFrame([("q", "seven")], "query_id string, text string")
    assert index.search_index(spark, at, asked, 1).first()["page"] == "P7"
    assert index.estimated(spark, f"{notes}/none", 3) is None and index.count_rows(spark, f"{notes}/none") == 0
    assert index.search_index(spark, f"{notes}/none", asked).count() == 0


def clustered(n, d=16, groups=12, seed=3):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((groups, d)) * 3
    return (centres[r.integers(0, groups, n)] + r.standard_normal((n, d)) * 0.7).astype(np.float32)


def exact(x, q, n):
    s = (x.astype(np.float64) @ q.astype(np.float64)) / (np.linalg.norm(x.astype(np.float64), axis=1) * np.linalg.norm(q.astype(np.float64)))
    return sorted(range(len(x)), key=lambda i: (-s[i], f"p{i % 7}", str(i)))[:n]


def test_cells_lose_nothing_and_few_cells_little(spark, tmp_path, monkeypatch):
    x = clustered(3000)
    table_ = spark.createDataFrame([(f"p{i % 7}", str(i), f"d{i}", [float(c) for c in v]) for i, v in enumerate(x)], "page string, block_id string, document string, embedding array<float>").repartition(5)
    asked = spark.createDataFrame([(i, ["l"], [float(c) for c in x[i]]) for i in range(0, 3000, 60)] + [(-1, [], [0.0] * 16)], "query_id int, links array<string>, embedding array<float>")
    c = cells.fitted(table_)
    assert len(c.centres) == 14
    rows = cells.dealt(table_, c).persist()
    c.least = cells.reaches(rows)
    of = lambda df: {q: [r["block_id"] for r in sorted(rs, key=lambda r: r["fetched"])] for q, rs in grouped(df).items()}

    def grouped(df):
        out = {}
        for r in df.collect():
            out.setdefault(r["query_id"], []).append(r)
        return out

    want = {i: [str(j) for j in exact(x, x[i], 10)] for i in range(0, 3000, 60)}
    got = of(cells.searched(rows, asked, 10, c))
    assert {i: got[i] for i in want} == want and len(got[-1]) == 10
    assert of(cells.searched(rows.drop("cell"), asked, 10)) == got
    monkeypatch.setattr(cells, "QUERY_BYTES", 2000)
    assert of(cells.searched(rows, asked, 10, c)) == got
    few = of(cells.searched(rows, asked, 10, c, probes=2))
    assert np.mean([len({*few[i]} & {*want[i]}) / 10 for i in want]) >= 0.9
    vectors = np.stack([x[i] for i in want]).astype(np.float64)
    least = np.array([np.sort((cells.unit(x.astype(np.float64)) @ cells.unit(vectors).T)[:, j])[-10] for j in range(len(vectors))])
    assert (c.most(vectors) >= least[:, None]).mean() < 0.6  # of all cells, those that can't be left out


def test_search_of_odd_rows(spark):
    rows = models.encoded(spark.createDataFrame([("A", "1", "red"), ("B", None, "red"), (None, "3", None)], "page string, block_id string, document string"))
    got = index.search(rows, spark.createDataFrame([(1, "red"), (2, None), (3, "")], "query_id int, text string"), 5)
    assert got.where("query_id = 1 and score > 0.9").count() == 2 and got.count() == 9
    assert index.search(rows.limit(0), spark.createDataFrame([(1, "red")], "query_id int, text string"), 5).count() == 0
    assert index.search(rows, spark.createDataFrame([], "query_id int, text string"), 5).count() == 0
    ties = models.encoded(spark.createDataFrame([(random.Random(i).choice("ab"), str(i), "same") for i in range(50)], "page string, block_id string, document string").repartition(9))
    best = [(r["page"], r["block_id"]) for r in index.search(ties, spark.createDataFrame([(1, "same")], "query_id int, text string"), 4).orderBy("rank").collect()]
    assert best == sorted((random.Random(i).choice("ab"), str(i)) for i in range(50))[:4]


def test_cells_go_through_a_batch_in_steps():
    import pyarrow as pa

    from notespan.operators import cells

    batch = pa.RecordBatch.from_arrays([pa.array(range(3 * cells.ROWS + 5))], names=["n"])
    own = list(cells.in_steps(iter([batch, batch.slice(0, 0)])))
    assert [b.num_rows for b in own] == [cells.ROWS] * 3 + [5, 0]
    assert [x for b in own for x in b.column("n").to_pylist()] == list(range(3 * cells.ROWS + 5))
