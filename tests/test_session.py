import json
import os
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from notespan.functions import columns as C
from notespan.jobs import extraction
from notespan.jobs.session import Session
from notespan.operators import chunks, merge, models, outline, places, table_functions
from notespan.operators import decisions as D
from notespan.sources import graph


def outlines_of(spark, *pages):
    return outline.parsed(spark.createDataFrame(list(pages), "page string, text string"))


ODD = "title:: Alpha\nk:: v\n\n- a\n  more\n  id:: x1\n  - b\n\n  k:: v\n- a\n      - deep\n- a"


def test_lateral_chunks_equal_the_expressions(spark):
    table_functions.register(spark)
    pages = spark.createDataFrame([("P", ODD), ("Q/R", "title::\n- \ttab\n-"), ("E", ""), ("N", None)], "page string, text string")
    parsed = outline.parsed(pages)
    rows = chunks.last_wins(chunks.page_chunks(parsed).union(chunks.block_chunks(outline.contexts(parsed))), ["chunk_id"], ["chunk_seq"])
    of = lambda df: sorted((r["page"], r["chunk_id"], r["block_id"], r["chunk_seq"], r["document"]) for r in df.collect())
    want = of(rows)
    assert of(spark.sql("SELECT * FROM {p}, LATERAL chunks(page, text)", p=pages)) == want
    assert of(spark.sql("SELECT * FROM all_chunks(TABLE(SELECT page, text FROM {p}))", p=pages)) == want
    assert spark.sql("SELECT count(*) AS n FROM {p}, LATERAL outline(text) WHERE depth = 0", p=pages).first()["n"] == outline.block_total(parsed).first()["n_roots"] == 6


def test_children_at_every_position(spark):
    outlines = outlines_of(spark, ("P", "t:: x\n- r\n  - a\n    - deep\n  - b\n  - c\n- s"), ("Q", ""))
    rows = places.keyed(outlines)
    root, leaf = (rows.where(f"page = 'P' and array_contains(content, '{c}')").first()["key"] for c in ("r", "deep"))

    def put(*asked):
        new = spark.createDataFrame([(p, parent, at, i, [f"n{i}"]) for i, (p, parent, at) in enumerate(asked)], "page string, parent string, position int, turn int, content array<string>")
        return {r["page"]: r["text"] for r in places.rendered(outlines, places.inserted(rows, new)).collect()}

    base = ["a", "b", "c"]
    for at in (None, -9, -2, -1, 0, 1, 2, 3, 99):
        want = list(base)
        want.insert(len(want) if at is None else at, "n0")
        got = re.findall(r"^  - (\w+)$", put(("P", root, at))["P"], re.M)
        assert got == want, at
    both = put(("P", root, 1), ("P", root, 1), ("P", leaf, 0), ("P", "", 0), ("P", "", None), ("Q", "", None), ("P", "nowhere", 0))
    assert both["P"] == "t:: x\n- n3\n- r\n  - a\n    - deep\n      - n2\n  - n0\n  - n1\n  - b\n  - c\n- s\n- n4" and both["Q"] == "- n5"


def test_subtrees_move_by_their_prefix(spark):
    outlines = outlines_of(spark, ("P", "- r\n  - a\n    - deep\n  - b\n- s"))
    rows = places.keyed(outlines)
    key = {r["content"][0]: r["key"] for r in rows.collect()}
    to = spark.range(1).select(places.after(F.lit(key["s"]), F.lit(0)), places.behind_last(F.lit(key["s"]), F.lit(0)), places.before_first(F.lit(""), F.lit(0))).first()
    for target, want in zip(to, ["- r\n  - b\n- s\n- a\n  - deep", "- r\n  - b\n- s\n  - a\n    - deep", "- a\n  - deep\n- r\n  - b\n- s"], strict=True):
        moves = spark.createDataFrame([("P", key["a"], target)], "page string, key string, to string")
        assert places.rendered(outlines, places.moved(rows, moves)).first()["text"] == want


def test_previews_are_copies_with_highlights(spark):
    outlines = outlines_of(spark, ("P", "- r\n  - a\n  - b\n- s"))
    tree = merge.tree(outlines)
    ids = {r["content"][0]: r["hybrid_id"] for r in tree.collect()}
    given = spark.createDataFrame([("k", 1, "P", "replace", ids["r"], "new"), ("k", 2, "P", "replace", ids["r"], "other"), ("k", 3, "P", "add_under", ids["r"], "new"), ("k", 4, "P", "add_under", "gone", "new"), ("k", 5, "P", "replace", "gone", "new"), ("k", 6, "P", "skip_exists", ids["r"], "")], "knowledge_block_id string, seq long, target_page string, action string, target_block_id string, refined_text string")
    got = {r["seq"]: r for r in places.previewed(outlines, given).collect()}
    assert got[1]["text"] == "- r\n- new\n  - a\n  - b\n- s" and (got[1]["old_at"], got[1]["new_at"]) == (0, 1) and got[1]["old_id"] == ids["r"]
    again = {r["content"][0]: r["hybrid_id"] for r in merge.tree(outlines_of(spark, ("P", got[1]["text"]))).collect()}
    assert got[1]["highlight_id"] == again["new"]
    assert got[3]["text"] == "- r\n  - a\n  - b\n  - new\n- s" and got[3]["old_id"] is None and got[3]["new_at"] == 3
    assert got[4]["text"] == "- r\n  - a\n  - b\n- s\n- new" and got[5]["text"] == got[6]["text"] == "- r\n  - a\n  - b\n- s" and got[5]["highlight_id"] is None


@pytest.fixture
def asked(tmp_path):
    calls = tmp_path / "calls"
    calls.write_text("")

    def model(prompt):
        with open(calls, "a") as f:
            f.write(prompt + "\n")
        if prompt.startswith("busy") and calls.read_text().count(prompt) < 3:
            raise models.Busy(0.01)
        if prompt == "fails" and not (tmp_path / "mended").exists():
            raise ValueError("no answer")
        yield f"to {prompt}"
        yield "end"

    return model, calls, tmp_path


def test_no_prompt_is_asked_twice(spark, asked):
    model, calls, at = asked
    rows = spark.createDataFrame([(f"r{i}", f"p{i % 7}") for i in range(30)] + [("x", "fails"), ("y", "busy")], "request string, prompt string").coalesce(1)
    with pytest.raises(Exception, match="no answer"):
        models.asked_once(rows, model, f"{at}/log").collect()
    before = calls.read_text().split()
    (at / "mended").write_text("")
    got = models.asked_once(rows, model, f"{at}/log").collect()
    after = calls.read_text().split()
    assert len(got) == 64 and {(r["request"], r["seq"], r["line"]) for r in got} >= {("r8", 0, "to p1"), ("r8", 1, "end"), ("x", 0, "to fails")}
    assert {p: after.count(p) for p in set(after)} == {**{f"p{i}": 1 for i in range(7)}, "fails": 2, "busy": 3} and len(before) < len(after)
    models.asked_once(rows, model, f"{at}/log").collect()
    assert calls.read_text().split() == after
    assert not [f for f in os.listdir(f"{at}/log") if f.startswith("_")]


def test_patience(monkeypatch):
    waits = []
    monkeypatch.setattr(models.time, "sleep", waits.append)

    def busy(prompt):
        raise models.Busy(7 if len(waits) == 1 else None)
        yield

    with pytest.raises(models.Busy):
        models.patient(busy, "x", times=4, wait=2)
    assert waits == [2, 7, 8]

    def wrong(prompt):
        raise KeyError
        yield

    with pytest.raises(KeyError):
        models.patient(wrong, "x")
    assert len(waits) == 3


def ask(prompt):
    """Takes blocks with FACT for knowledge, rewords them in capitals, and puts each below the first block of its first page."""
    if prompt.startswith("<blocks><block"):
        for n, text in re.findall(r'<block id="(\d+)">([^<]*)</block>', prompt):
            if "FACT" in text:
                yield json.dumps({"block_id": n, "reasoning": "x", "confidence": 0.9 if "sure" in text else 0.3})
    elif prompt.startswith("<blocks>"):
        for n, text in re.findall(r'  <block id="(\d+)">\n(.*?)\n  </block>', prompt, re.S):
            yield json.dumps({"block_id": n, "reworded_content": text.strip().split("\n")[-1].strip(" -").upper()})
    else:
        page = re.search(r'<page name="([^"]*)">', prompt).group(1)
        block = re.search(r'<block id="(\d+)">\n- ', prompt)
        yield json.dumps({"target_page": page, "action": "add_under" if block else "add_section", "target_block_id": block and block.group(1), "confidence": 0.8, "reasoning": "y"})


@pytest.fixture
def notes(tmp_path):
    for kind in ("pages", "journals"):
        os.makedirs(tmp_path / "g" / kind)
    (tmp_path / "g/pages/Bread.md").write_text("k:: v\n- bread needs yeast")
    (tmp_path / "g/pages/Stone___Old.md").write_text("- old stones")
    (tmp_path / "g/journals/2025_01_15.md").write_text("- woke up\n- FACT sure: yeast makes bread rise\n- FACT perhaps: x")
    (tmp_path / "g/journals/2025_01_16.md").write_text("- nothing")
    return tmp_path


def test_search_from_a_session(spark, notes):
    s = Session(spark, f"{notes}/g", f"{notes}/w", k=2, name="my notes")
    rows = s.search("yeast bread").collect()
    assert [r["number"] for r in rows] == [2, 1] and rows[1]["page"] == "Bread" and rows[1]["percent"] == 100
    assert rows[1]["snippet"] == "- bread needs yeast" and rows[1]["link"].startswith("notes://graph/my%20notes?block-id=")
    (notes / "g/pages/Iron.md").write_text("- iron melts")
    assert s.search("iron melts").collect()[-1]["page"] == "Iron"
    assert s.search("iron", reindex=True).count() == 2 and {r["state"] for r in s.update().collect()} == {"unchanged"}


def test_knowledge_goes_from_journals_to_pages(spark, notes):
    s = Session(spark, f"{notes}/g", f"{notes}/w", model=ask)
    got = s.extract("2025-01-15..2025-01-16").collect()
    assert [(r["seq"], r["target_page"], r["action"], r["refined_text"], r["day"]) for r in got] == [(1, "Bread", "add_under", "FACT SURE: YEAST MAKES BREAD RISE", date(2025, 1, 15))]
    out = s.integrate(s.extract("2025-01-15..2025-01-16")).collect()
    assert [(r["seq"], r["error"]) for r in out] == [(1, None)]
    page, journal = (notes / "g/pages/Bread.md").read_text(), (notes / "g/journals/2025_01_15.md").read_text()
    assert "  - FACT SURE: YEAST MAKES BREAD RISE\n    id:: " in page and "extracted-to:: [Bread](((" in journal
    with pytest.raises(Exception, match="no journal for 2025-01-17"):
        s.extract("2025-01-17")
    with pytest.raises(ValueError):
        Session(spark, f"{notes}/g", f"{notes}/w").extract("2025-01-15")


def test_views_and_functions_in_sql(spark, notes):
    s = Session(spark, f"{notes}/g", f"{notes}/w")
    s.update()
    s.views()
    rows = spark.sql("SELECT i.page, i.document FROM notes_index i JOIN (SELECT chunk_id FROM pages, LATERAL chunks(page, text)) c ON i.chunk_id = c.chunk_id WHERE i.chunk_seq >= 0").collect()
    assert {r["page"] for r in rows} == {"Bread", "Stone/Old"} and len(rows) == 2
    assert spark.sql("SELECT count(*) AS n FROM journals").first()["n"] == 2


def test_requests_as_models_get_them(spark):
    rows = spark.createDataFrame([("r", "B<", 0, "2", "- x & y", None, False), ("r", "A", -1, "1", "Page: A\nk:: v", " \nk:: v\n", True), ("r", "A", 3, "3", "- z", " \nk:: v\n", False)], "request string, page string, seq int, block_id string, document string, frontmatter string, of_page boolean")
    assert outline.pages_xml(rows).first()["xml"] == '<pages>\n<page name="A">\n<properties>\nk:: v\n</properties>\n<block id="1">\nPage: A\n</block>\n<block id="3">\n- z\n</block>\n</page>\n<page name="B&lt;">\n<block id="2">\n- x & y\n</block>\n</page>\n</pages>'
    blocks = spark.createDataFrame([("r", 1, "- a\n  id:: q\n  - b", 0), ("r", 2, "- c", 1)], "request string, short int, context string, seq int")
    assert extraction.contexts_xml(blocks).first()["prompt"] == '<blocks>\n  <block id="1">\n- a\n  - b\n  </block>\n\n  <block id="2">\n- c\n  </block>\n\n</blocks>'


def test_small_columns(spark):
    one = spark.range(1)
    sizes = one.select(*(C.model_size(F.lit(n)) for n in (512 << 20, 1 << 30, 0)), C.masked_key(F.lit("sk-1234567890abcdef")), C.masked_key(F.lit("short123")), C.estimated_seconds(F.lit(45.0), F.lit(150), F.lit(200)), C.estimated_seconds(F.lit(45.0), F.lit(0), F.lit(200))).first()
    assert list(sizes) == ["512.0 MB", "1.0 GB", "0.0 MB", "sk-12345...cdef", "shor...t123", 60.0, None]
    ids = [r[0] for r in spark.range(5).select(C.random_id()).collect()]
    assert len(set(ids)) == 5 and all(re.fullmatch(r"[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}", x) for x in ids)
    states = spark.createDataFrame([("knowledge", "llm", 0.7)], "classification string, source string, confidence double")
    assert tuple(D.cleared(states).first()) == ("pending", "user", 0.7)
    titles = outlines_of(spark, ("P", "title:: Alpha\n- x"), ("Q", "title::  \ntitle:: B"), ("R", "- title:: no")).select("page", chunks.page_title(F.col("frontmatter")).alias("t"))
    assert {r["page"]: r["t"] for r in titles.collect()} == {"P": "Alpha", "Q": None, "R": None}
    journals = spark.createDataFrame([("b", date(2025, 1, 2)), ("a", date(2025, 1, 3)), ("c", date(2025, 1, 1))], "path string, journal_date date")
    assert [r["path"] for r in graph.by_day(journals).collect()] == ["c", "b", "a"]
