import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from notespan.jobs import extraction
from notespan.streaming import answers

NESTED = ['{"block_id": "1", "meta": {"a": 1, "b": [{"c": "}"}]}, "t": "x \\" { \\\\"}', '{"block_id":"2",\n "meta":{}}', '{"block_id": "3"}']
TEXT = "Here is {what I found} or {so: " + NESTED[0] + " }\n[" + ",\n".join(NESTED[1:]) + ']\n{"block_id": "4", "cut": '


def test_nested_objects_of_a_text():
    assert answers.Reader().all_of(TEXT) == NESTED
    assert answers.Reader().all_of("{" * 50 + '{"a": 1}' + "}" * 10) == ['{"a": 1}']
    assert answers.Reader().all_of("no } braces \" { here") == []


def test_pieces_of_any_size_give_the_same_objects():
    r = random.Random(4)
    for _ in range(200):
        reader, out, at = answers.Reader(), [], 0
        while at < len(TEXT):
            n = r.choice([1, 1, 2, 5, 40])
            out += reader.feed(TEXT[at : at + n])
            at += n
        assert out + reader.end() == NESTED


def test_an_object_comes_out_as_soon_as_it_closes():
    reader = answers.Reader()
    assert reader.feed('x {"a": {"b') == [] and reader.feed('": 1}') == [] and reader.feed('} {"') == ['{"a": {"b": 1}}']
    assert reader.open == '{"'


def test_what_is_open_is_bounded(monkeypatch):
    monkeypatch.setattr(answers, "MOST", 100)
    reader = answers.Reader()
    got = [o for _ in range(40) for o in reader.feed('{ "x" {"a": 1} ')]
    assert got and set(got) <= {'{"a": 1}'} and len(reader.open) < 200


def test_records_keep_nested_fields(spark):
    rows = extraction.records(spark.createDataFrame([("r", TEXT), ("s", None), ("t", "")], "request string, text string"), "block_id string, meta struct<a: int>").collect()
    assert [(r["request"], r["place"], r["block_id"], r["meta"] and r["meta"]["a"]) for r in sorted(rows, key=lambda r: r["place"])] == [("r", 0, "1", 1), ("r", 1, "2", None), ("r", 2, "3", None)]


def lines_of(request, text, size):
    pieces = [text[i : i + size] for i in range(0, len(text), size)]
    out = [(request, i, "data: " + json.dumps({"choices": [{"delta": {"content": p}}]})) for i, p in enumerate(pieces)]
    return out + [(request, len(out), "data: [DONE]")]


@pytest.mark.parametrize("files", [1, 3, 9])
def test_any_batches_order_and_replay_of_a_stream(spark, tmp_path, files):
    rows = lines_of("a", TEXT, 7) + lines_of("b", TEXT, 1000) + [("c", i, x) for i, x in enumerate(['{"block_id": "5", "meta": {"a": 2}}', '{"message": {"content": "{\\"block_id\\": \\"6\\"}"}, "done": false}', '{"done": true}'])]
    random.Random(files).shuffle(rows)
    parts = [rows[i::files] for i in range(files)]
    read = lambda: sorted((r["request"], r["place"], r["block_id"]) for r in answers.decoded_files(spark, f"{tmp_path}/in", "block_id string", f"{tmp_path}/out", f"{tmp_path}/check").collect())
    for i, part in enumerate(parts):
        spark.createDataFrame(part + parts[0][:3], "request string, seq long, line string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        if i == 0 and files > 1:
            read()
    want = [("a", 0, "1"), ("a", 1, "2"), ("a", 2, "3"), ("b", 0, "1"), ("b", 1, "2"), ("b", 2, "3"), ("c", 0, "5"), ("c", 1, "6")]
    assert read() == want
    assert read() == want  # nothing new: nothing twice


class Store:
    """What the decoder asks of one key's state, and how often."""

    def __init__(self):
        self.value, self.rows, self.calls = None, {}, 0

    def getValueState(self, *_):
        return self

    getMapState = getValueState

    def counted(result):
        def call(self, *given):
            self.calls += 1
            return result(self, *given)

        return call

    exists = counted(lambda self: self.value is not None)
    get = counted(lambda self: self.value)
    update = counted(lambda self, value: setattr(self, "value", value))
    containsKey = counted(lambda self, key: key in self.rows)
    getValue = counted(lambda self, key: self.rows[key])
    updateValue = counted(lambda self, key, value: self.rows.update({key: value}))
    removeKey = counted(lambda self, key: self.rows.pop(key))


@pytest.mark.parametrize("block, most", [(256, 1 << 20), (3, 400), (1, 400)])
def test_calls_of_the_store_are_by_block_and_not_by_piece(monkeypatch, block, most):
    monkeypatch.setattr(answers, "BLOCK", block, raising=False)
    text = "{ " + TEXT * 3
    rows = [Row(seq=i, piece=text[2 * i : 2 * i + 2], done=False) for i in range(len(text) // 2 + 1)]
    rows.append(Row(seq=len(rows), piece=None, done=True))
    monkeypatch.setattr(answers, "MOST", most)
    reader = answers.Reader()
    want = [found for row in rows for found in reader.feed(row.piece or "")] + reader.end()
    shuffled = rows[:]
    random.Random(block).shuffle(shuffled)
    store, found = Store(), []
    decoder = answers.Decoder()
    decoder.init(store)
    for i in range(4):
        found += list(decoder.handleInputRows(("r",), iter(shuffled[i::4] + shuffled[:5]), None))
    assert [r["place"] for r in found] == list(range(len(found))) and not store.rows
    assert [r["json"] for r in found] == want
    assert block < 256 or store.calls < len(rows) / 8


def test_pieces_of_lines(spark):
    lines = spark.createDataFrame([("r", 0, 'data: {"choices": [{"delta": {"content": "x"}}]}'), ("r", 1, "data: [DONE]"), ("r", 2, ""), ("r", 3, "plain"), ("r", 4, None), ("r", 5, '{"done": true}')], "request string, seq int, line string")
    assert [(r["piece"], r["done"]) for r in answers.pieces(lines).orderBy("seq").collect()] == [("x", False), ("", True), ("\n", False), ("plain\n", False), ("\n", False), ("", True)]
    assert extraction.answer_texts(lines).select(F.length("text")).first()[0] == 9
