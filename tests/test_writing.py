import os
import re

import pytest
from pyspark.sql import functions as F

from notespan.functions import columns as C
from notespan.jobs import extraction, index, writing
from notespan.operators import decisions as D
from notespan.operators import editing, merge, outline
from notespan.sources import graph

PAGE = "kind:: x\n- top\n  note\n\n  more\n  - child\n    id:: c1\n   - odd\n- ```py\n  - code\n  ```\n- end\n"


@pytest.fixture
def notes(tmp_path):
    for kind in ("pages", "journals"):
        os.makedirs(tmp_path / "g" / kind)
    (tmp_path / "g/pages/A___B.md").write_text(PAGE)
    (tmp_path / "g/pages/Z.md").write_text("- alone")
    (tmp_path / "g/journals/2025_01_15.md").write_text("- day\n  id:: k1\n- more\n  id:: k2\n  - inner\n    extracted-to:: [Z](((old)))")
    return tmp_path


def todo(spark, *rows):
    return spark.createDataFrame(rows, "knowledge_block_id string, seq long, target_page string, action string, target_block_id string, refined_text string")


def test_decisions_reach_files_once(spark, notes):
    tree = merge.tree(outline.parsed(graph.pages(spark, f"{notes}/g"), strict=True))
    end = tree.where("page = 'A/B'").orderBy(F.desc("seq")).first()["hybrid_id"]
    given = todo(spark, ("k1", 1, "A/B", "add_under", "c1", "under\ntwo lines"), ("k1", 2, "A/B", "add_under", "nowhere", "section"), ("k2", 3, "A/B", "replace", end, "new end"), ("k2", 4, "Z", "skip_exists", "gone", ""), ("k2", 5, "None", "add_section", None, "x"), ("k2", 6, "A/B", "skip_exists", "c1", ""))
    ids = {r["seq"]: r["new_id"] for r in merge.resolved(given, tree).collect()}
    out = {r["seq"]: r["error"] for r in writing.integrate(spark, f"{notes}/g", given, f"{notes}/w1").collect()}
    assert out == {1: None, 2: None, 3: None, 4: "no such target", 5: "no page None", 6: None}
    page = (notes / "g/pages/A___B.md").read_text()
    assert f"id:: {ids[1]}" in page
    assert page.endswith(f"- new end\n  id:: {ids[3]}\n- section\n  id:: {ids[2]}") and "- ```py\n  - code\n  ```" in page and "  note\n\n  more\n  - child\n    id:: c1\n   - odd\n    - under\n      two lines\n" in page
    journal = (notes / "g/journals/2025_01_15.md").read_text()
    assert journal == f"- day\n  id:: k1\n  extracted-to:: [A/B]((({ids[1]}))), [A/B]((({ids[2]})))\n- more\n  id:: k2\n  extracted-to:: [A/B]((({ids[3]}))), [A/B](((c1)))\n  - inner\n    extracted-to:: [Z](((old)))"
    assert (notes / "g/pages/Z.md").read_text() == "- alone" and sorted(os.listdir(notes / "g/pages")) == ["A___B.md", "Z.md"]
    writing.integrate(spark, f"{notes}/g", given, f"{notes}/w2").collect()
    assert (notes / "g/pages/A___B.md").read_text() == page and (notes / "g/journals/2025_01_15.md").read_text() == journal


def test_a_file_that_changed_meanwhile_is_left(spark, notes):
    files = writing.with_digest(graph.pages(spark, f"{notes}/g")).collect()
    z = next(r for r in files if r["page"] == "Z")
    (notes / "g/pages/Z.md").write_text("- by hand")
    texts = spark.createDataFrame([(z["path"], "- ours", z["digest"])], "path string, text string, digest string")
    assert writing.written_files(texts, f"{notes}/o").first()["error"] == "changed by somebody else"
    assert (notes / "g/pages/Z.md").read_text() == "- by hand"
    now = writing.with_digest(graph.pages(spark, f"{notes}/g"))
    assert [r["path"] for r in writing.modified(spark.createDataFrame(files, now.schema), now).collect()] == [z["path"]]


def test_strict_indents_survive(spark):
    text = "- a\n text\nx\n    deep\n  - b\n  y"
    df = spark.createDataFrame([("P", text)], "page string, text string")
    strict = outline.parsed(df, strict=True)
    assert outline.rendered(strict).first()["text"] == text
    assert [r["hybrid_id"] for r in outline.contexts(strict).orderBy("seq").collect()] == [r["hybrid_id"] for r in outline.contexts(outline.parsed(df)).orderBy("seq").collect()]


def test_second_sibling_below_a_jump_becomes_a_root():
    got = [(b["level"], b["parent"], b["last"]) for b in outline.parse("- a\n  - x\n      - c\n        - d\n        - e\n- f")["blocks"]]
    assert got == [(0, None, 1), (1, 0, 1), (3, None, 3), (4, 2, 3), (4, None, 4), (0, None, 5)]


def test_inline_marks_and_contents(spark):
    row = spark.createDataFrame([("see #[[A b]] and [[C]] `x [[n]]` **b** *i* https://a.b/c #tag no#tag",)], "t string")
    got = [(x["kind"], x["text"]) for x in row.select(editing.inline_tokens(F.col("t")).alias("x")).first()["x"]]
    assert got == [("tag link", "#[[A b]]"), ("link", "[[C]]"), ("code", "`x [[n]]`"), ("bold", "**b**"), ("italic", "*i*"), ("url", "https://a.b/c"), ("tag", "#tag")]
    blocks = merge.tree(outline.parsed(spark.createDataFrame([("P", "- one\n  - two\n- Two more")], "page string, text string")))
    wanted = spark.createDataFrame([("P", "wo")], "page string, wanted string")
    assert editing.by_content(blocks, wanted).first()["seq"] == 1 and editing.heading(blocks, "TWO").first()["seq"] == 1
    child = editing.with_child(blocks, F.lit(0), F.array(F.lit("new"))).first()
    assert (child["place"], child["level"], child["content"]) == (1.5, 1, ["new"])
    assert spark.range(1).select(editing.full_content(F.array(F.lit(" a "), F.lit("b")), stripped=True)).first()[0] == "a\nb"
    assert spark.range(1).select(editing.for_display(F.lit("a\n  id::x\nb"))).first()[0] == "a\nb"


def test_selected_blocks_and_restored_ids(spark):
    states = spark.createDataFrame([("a", "knowledge"), ("b", "pending"), ("c", "knowledge")], "block_id string, classification string")
    blocks = spark.createDataFrame([("a", 2, 0, "late"), ("a", 1, 5, "early"), ("b", 1, 0, "x")], "hybrid_id string, day int, seq int, context string")
    assert [(r["block_id"], r["context"]) for r in D.selected_blocks(states, blocks).collect()] == [("a", "early")]
    short = spark.createDataFrame([("r", "x", 1)], "request string, item string, short long")
    replies = spark.createDataFrame([("r", 1), ("r", 2)], "request string, short long")
    assert {(r["short"], r["item"]) for r in D.restored_ids(replies, short).collect()} == {(1, "x"), (2, None)}
    with pytest.raises(Exception, match="unknown id 2"):
        D.restored_ids(replies, short, strict=True).collect()
    assert [r["page"] for r in D.distinct_pages(spark.createDataFrame([("b",), ("a",), ("b",)], "page string")).collect()] == ["a", "b"]


def test_models_reword_and_plan(spark):
    def reword(prompt):
        for n, text in re.findall(r'<block id="(\\d+)">([^<]*)</block>'.replace("\\\\", "\\"), prompt):
            yield 'data: {"choices": [{"delta": {"content": "{\\"block_id\\": \\"%s\\", \\"rewo"}}]}' % n
            yield 'data: {"choices": [{"delta": {"content": "rded_content\\": \\"re %s\\"}"}}]}' % text
        yield "data: [DONE]"

    blocks = spark.createDataFrame([("r", "long-a", "one\n  id:: q", 1), ("r", "long-b", "two", 2)], "request string, block_id string, text string, seq int")
    assert {(r["block_id"], r["reworded_content"]) for r in extraction.reworded(blocks, reword).collect()} == {("long-a", "re one"), ("long-b", "re two")}

    def plan(prompt):
        yield '{"target_page": "P", "action": "add_under", "target_block_id": "1", "confidence": 0.9, "reasoning": "x"}'
        yield '{"target_page": "P", "action": "replace", "target_block_id": "2", "confidence": 0.5, "reasoning": "x"}'
        yield '{"target_page": "P", "action": "replace", "target_block_id": "77", "confidence": 0.5, "reasoning": "unknown"}'
        yield '{"target_page": "P", "action": "add_section", "confidence": 7, "reasoning": "out of range"}'

    candidates = spark.createDataFrame([("long-a", "P", "__PAGE__", "page", 0), ("long-a", "P", "t-2", "doc", 1)], "block_id string, page string, target string, document string, seq int")
    got = {(r["knowledge_block_id"], r["action"], r["target_block_id"]) for r in extraction.planned(blocks, candidates, plan).collect()}
    assert got == {("long-a", "add_section", None), ("long-a", "replace", "t-2")}


def test_forced_rebuild_keeps_its_version_and_old_ones_go(spark, notes):
    at = f"{notes}/index"
    assert not index.has_rows(spark, at)
    for _ in range(3):
        index.rebuilt(spark, f"{notes}/g", at)
    assert index.has_rows(spark, at) and index.versions(spark, at) == [1, 2] and len(os.listdir(f"{at}/rows")) == len(os.listdir(f"{at}/keys")) == 2
    assert {r["state"] for r in index.build(spark, f"{notes}/g", at).collect()} == {"unchanged"}
    page = index.current(spark, at).where("block_id = 'c1'").first()
    assert page["document"] == "- top\n  note\n  \n  more\n  - child\n    - odd" and page["frontmatter"] == "kind:: x"


def test_a_replacement_keeps_every_property(spark):
    page = "- t\n  see http::x\n  ключ:: v\n  my key:: v v\n  - a:: b\n  plain"
    outlines = outline.parsed(spark.createDataFrame([("P", page)], "page string, text string"))
    tree = merge.tree(outlines)
    first = tree.where("seq = 0").first()["hybrid_id"]
    found = merge.resolved(todo(spark, ("k", 1, "P", "replace", first, "new\ntext")), tree)
    new = found.first()["new_id"]
    text = outline.rendered(merge.regrouped(outlines, merge.merged(tree, found))).first()["text"]
    assert text == f"- new\n  text\n  see http::x\n  ключ:: v\n  my key:: v v\n  id:: {new}\n  - a:: b\n    plain"


def test_of_two_changes_of_a_block_the_first_holds(spark, notes):
    tree = merge.tree(outline.parsed(graph.pages(spark, f"{notes}/g"), strict=True))
    end = tree.where("page = 'A/B'").orderBy(F.desc("seq")).first()["hybrid_id"]
    given = todo(spark, ("k1", 1, "A/B", "replace", end, "one"), ("k2", 2, "A/B", "replace", end, "two"), ("k1", 3, "A/B", "replace", "c1", "three"), ("k2", 4, "A/B", "replace", "c1", "four"), ("k1", 5, "A/B", "add_section", None, "again"), ("k1", 6, "A/B", "add_section", None, "again"))
    found = {r["seq"]: (r["done_as"], r["beaten"], r["new_id"]) for r in merge.resolved(given, tree).collect()}
    assert [found[n][:2] for n in range(1, 7)] == [("replace", False), ("invalid", True), ("replace", False), ("replace", False), ("add_section", False), ("done", False)]
    reasons = {r["seq"]: r["reason"] for r in merge.why_invalid(merge.resolved(given, tree)).collect()}
    assert reasons == {2: f"an earlier decision changed {end} in A/B"}
    out = {r["seq"]: r["error"] for r in writing.integrate(spark, f"{notes}/g", given, f"{notes}/w").collect()}
    assert out == {1: None, 2: f"an earlier decision changed {end}", 3: None, 4: None, 5: None, 6: None}
    page, journal = (notes / "g/pages/A___B.md").read_text(), (notes / "g/journals/2025_01_15.md").read_text()
    assert "- one" in page and "two" not in page and "- four\n    id:: c1" in page and page.count("- again") == 1
    assert found[2][2] not in journal and journal.count("(((c1)))") == 2
    again = {r["seq"]: r["error"] for r in writing.integrate(spark, f"{notes}/g", given, f"{notes}/w2").collect()}
    assert again == {1: None, 2: "no such target", 3: None, 4: None, 5: None, 6: None} and (notes / "g/pages/A___B.md").read_text() == page


def test_an_executor_lost_between_both_stages_changes_nothing(spark, notes, monkeypatch):
    tree = merge.tree(outline.parsed(graph.pages(spark, f"{notes}/g"), strict=True))
    end = tree.where("page = 'A/B'").orderBy(F.desc("seq")).first()["hybrid_id"]
    given = todo(spark, ("k1", 1, "A/B", "replace", end, "one"), ("k2", 2, "A/B", "add_section", None, "two"))
    ids = {r["seq"]: r["new_id"] for r in merge.resolved(given, tree).collect()}
    plain = writing.written_files

    def losing(texts, outcomes):
        out = plain(texts, outcomes)
        spark.catalog.clearCache()  # all blocks of all tables are gone; the pages have changed by now
        return out

    monkeypatch.setattr(writing, "written_files", losing)
    assert {r["seq"]: r["error"] for r in writing.integrate(spark, f"{notes}/g", given, f"{notes}/w").collect()} == {1: None, 2: None}
    journal = (notes / "g/journals/2025_01_15.md").read_text()
    assert all(f"((({ids[n]})))" in journal and f"id:: {ids[n]}" in (notes / "g/pages/A___B.md").read_text() for n in (1, 2))


def test_titles_of_odd_contexts(spark):
    given = ["- - x", "\t- - \t y", "", None, "\n \n- z" + "w" * 60, "---"]
    rows = spark.createDataFrame(list(enumerate(given)), "n int, t string").select("n", C.block_title(F.col("t")).alias("x")).orderBy("n").collect()
    assert [r["x"] for r in rows] == ["x", "y", "Unknown block", None, "z" + "w" * 46 + "...", ""]


def test_pages_after_decisions_are_those_of_their_rows(spark):
    """applied() against merged() and regrouped(): every action, several of one block, ends of pages, pages without blocks, decisions or edits."""
    deep = "f:: x\n- a\n  p:: 1\n  - b\n    id:: own\n    - c\n  - d\n- a2\n-"
    pages = spark.createDataFrame([(p, deep) for p in "PQR"] + [("blank", ""), ("front", "only:: this"), ("none", "- alone")], "page string, text string")
    outlines = outline.parsed(pages)
    tree = merge.tree(outlines)
    ids = {(r["page"], r["content"][0]): r["hybrid_id"] for r in tree.collect()}
    rows, n = [], 0
    for p in "PQ":
        for target in ("a", "own", "c", "d", "a2", "", "gone"):
            for action in ("skip_exists", "replace", "add_under", "replace", "skip_exists", "add_under", "add_section"):
                n += 1
                rows.append((f"k{n % 5}", 1000 - n if p == "Q" else n, p, action, ids.get((p, target), target), f"t{n}\nq:: {n}"))
    rows += [("k", 2000, "R", "replace", "gone", "x"), ("k", 2001, "blank", "add_section", None, "x"), ("k", 2002, "front", "add_under", "gone", "y\n"), ("k", 2003, "absent", "add_section", None, "z")]
    found = merge.resolved(todo(spark, *rows), tree)
    shown = lambda o: {r["page"]: (r["indent"], r["frontmatter"], r["blocks"]) for r in o.collect()}
    whole, own = shown(merge.regrouped(outlines, merge.merged(tree, found))), merge.applied(outlines, found)
    assert shown(own) == {p: whole[p] for p in ("P", "Q", "R", "blank", "front")} and len(whole["P"][2]) > 20
    assert {r["page"]: [b["content"] for b in r["before"]] for r in own.collect()}["R"] == [b["content"] for b in whole["R"][2]]
    assert whole["none"][2] and {r["page"]: r["text"] for r in outline.rendered(own).collect()}["front"].startswith("only:: this\n- y\n  \n  id:: ")


def test_a_second_run_keeps_no_blocks_beside_the_pages(spark):
    from notespan.jobs import notes as N

    local = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()]
    work = os.path.dirname(N.work_folder(spark)).removeprefix("file:")

    def kept():
        files = [os.path.join(d, x) for top in (work, *local) for d, _, names in os.walk(top) for x in names if x.endswith(".parquet") or x.startswith("shuffle_")]
        return {f: os.path.getsize(f) for f in files}

    before = kept()
    assert N.idempotent_probe(spark, "/root/testdata/sf0.01").where("changed").count() == 0
    new = sum(size for f, size in kept().items() if f not in before)
    assert new < 5 * os.path.getsize("/root/testdata/sf0.01/documents.parquet")
