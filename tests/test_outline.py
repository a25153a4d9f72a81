import hashlib
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notespan.functions import columns as C
from notespan.operators import outline

CASES = {
    "empty": "",
    "front only": "title:: A\n\n",
    "nested": "- a\n  - b\n    - c\n- d",
    "jump": "- a\n      - deep",
    "fence": "- a\n  ```\n  - no bullet\n  ```\n- b",
    "misaligned": "- a\n  - b\n   - c",
    "lone dash": "-\n- x",
    "props": "- a\n  id:: 7\n  k:: v::w",
    "tabs": "- a\n\t- b",
}


def blocks(text):
    return [(b["level"], b["parent"], b["content"]) for b in outline.parse(text)["blocks"]]


def test_parse_shapes():
    assert blocks(CASES["empty"]) == []
    assert outline.parse(None)["blocks"] == []
    assert outline.parse(CASES["front only"])["frontmatter"] == ["title:: A", "", ""]
    assert blocks(CASES["nested"]) == [(0, None, ["a"]), (1, 0, ["b"]), (2, 1, ["c"]), (0, None, ["d"])]
    assert blocks(CASES["lone dash"]) == [(0, None, [""]), (0, None, ["x"])]
    assert outline.parse(CASES["tabs"])["indent"] == "\t"


def test_fenced_bullets_are_text():
    assert [c for _, _, c in blocks(CASES["fence"])] == [["a", "```", "- no bullet", "```"], ["b"]]


def test_level_jump_becomes_a_root():
    (_, _, _), (level, parent, _) = blocks("- a\n  - b\n")[0], blocks("- a\n  - b\n      - c")[2]
    assert (level, parent) == (3, None)


def test_misaligned_bullet_is_text():
    assert [c for _, _, c in blocks(CASES["misaligned"])][1] == ["b", "- c"]


def test_block_id_is_the_first_id_line():
    assert outline.parse(CASES["props"])["blocks"][0]["block_id"] == "7"


def test_context_and_hash(spark):
    rows = outline.contexts(outline.parsed(spark.createDataFrame([("P", "t:: x\n- a\n  more\n  - b\n    id:: 9")], "page string, text string"))).orderBy("seq").collect()
    assert rows[0]["context"] == "t:: x\n\n- a\n  more"
    assert rows[1]["context"] == "t:: x\n\n- a\n  more\n  - b\n    id:: 9"
    assert rows[0]["hybrid_id"] == hashlib.md5(("P::" + rows[0]["context"]).encode()).hexdigest()
    assert rows[1]["hybrid_id"] == "9"


@pytest.mark.parametrize("name", ["nested", "fence", "props", "tabs"])
def test_render_roundtrip(spark, name):
    df = spark.createDataFrame([("P", CASES[name])], "page string, text string")
    assert outline.rendered(outline.parsed(df)).first()["text"] == CASES[name]


def test_uuid5_equals_python(spark):
    got = spark.range(1).select(C.uuid5(F.lit("a:b:é")).alias("u")).first()["u"]
    assert got == str(uuid.uuid5(uuid.UUID(C.NAMESPACE), "a:b:é"))


def test_small_functions(spark):
    one = spark.createDataFrame([("[A](((1))), [B](((2)))", "\t a  ", "sk-1234567890abcdef")], "links string, space string, key string")
    r = one.select(C.provenance_links(F.col("links")).alias("l"), C.strip(F.col("space")).alias("s"), C.masked_key(F.col("key")).alias("k"), C.model_size(F.lit(3 << 30)).alias("m"), C.provenance(F.col("links"), F.lit("A"), F.lit("1")).alias("p")).first()
    assert [(x[0], x[1]) for x in r["l"]] == [("A", "1"), ("B", "2")]
    assert (r["s"], r["k"], r["m"]) == ("a", "sk-12345...cdef", "3.0 GB")
    assert r["p"] == "[A](((1))), [B](((2)))"  # a repeat adds nothing


def test_batches_are_parsed_in_pieces():

    texts = ["x" * 10] * 20 + [None, "", "y" * 500, "z"] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["page", "text"])
    own = list(outline.in_pieces(batch, "text", 40))
    assert [x for p in own for x in p.column("text").to_pylist()] == texts and [x for p in own for x in p.column("page").to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or sum(len(x or "") for x in p.column("text").to_pylist()) <= 40 for p in own)
    assert [p.num_rows for p in outline.in_pieces(batch.slice(0, 0), "text", 40)] == [0]


def test_a_worker_holds_pieces_of_a_batch_at_a_time(spark, monkeypatch):  # spark: expressions need a session
    """A batch of 3,000 texts leaves the parser as batches of few."""
    seen = []
    texts = pa_batch(3000)
    monkeypatch.setattr(outline, "parse", lambda t, strict=False: seen.append(t) or {"indent": "  ", "frontmatter": [], "blocks": []})

    class Pages:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            return run(iter([texts]))

    first = next(iter(outline.parsed(Pages())))
    assert 0 < len(seen) == first.num_rows < 3000


def pa_batch(n):

    return pa.RecordBatch.from_arrays([pa.array([f"p{i}" for i in range(n)]), pa.array(["- " + "w" * 1000] * n)], names=["page", "text"])
