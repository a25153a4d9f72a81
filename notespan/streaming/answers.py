"""Streamed answers of models, decoded while they arrive.

A model's stream is lines; each gives a piece of text, cut anywhere. Objects are found by a push-down
reader (depth of braces, inside a string, after a backslash) that goes on where the last piece ended, so
nested objects and objects over many pieces come out as soon as they close, and only what is still open
is kept. On a stream, the reader's state is in the state store, by request, with the number of the next
piece: pieces that come early wait there, BLOCK numbers to a row, and pieces that come again are known by their number, so any
order, any batches and any replay give the same rows. In a batch the same reader runs over whole texts.

What is between objects is dropped. An outermost object that isn't JSON (braces in prose) is dropped, and
looked into for objects inside. An object that never closes is looked into at the end of its stream, or
when MOST characters of it are open: a request's state has no more than those and the pieces that wait.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from notespan.operators import decisions as D
from notespan.sources.work import work_folder, written

SPECIAL = re.compile(r'[{}"\\]')
#: Characters of an open object that are waited for.
MOST = 1 << 20
#: Numbers of pieces that share a row of the state while they wait: a call of the store for each piece takes longer than all else.
BLOCK = 256
#: Characters of conversations that one file of streamed lines has; each file is a task of its batch.
FILE_CHARS = 4 << 20
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def is_object(text: str) -> bool:
    try:
        return isinstance(json.loads(text, strict=False), dict)
    except ValueError:
        return False


@dataclass
class Reader:
    """What is open of an answer (from its outermost brace on), how far it was looked at, and how deep that is."""

    open: str = ""
    at: int = 0
    depth: int = 0
    inside: bool = False
    escaped: bool = False

    def feed(self, piece: str) -> list[str]:
        """The objects that close within one more piece."""
        self.open += piece
        out: list[str] = []
        while True:
            if not self.depth:
                first = self.open.find("{", self.at)
                if first < 0:
                    self.open, self.at = "", 0
                    return out
                self.open, self.at, self.depth, self.inside, self.escaped = self.open[first:], 1, 1, False, False
            if self.escaped:
                if self.at == len(self.open):
                    return out
                self.at, self.escaped = self.at + 1, False
            found = SPECIAL.search(self.open, self.at)
            if not found:
                self.at = len(self.open)
                if self.at <= MOST:
                    return out
                out += self.given_up()
                continue
            self.at, c = found.end(), found.group()
            if c == "\\":
                self.escaped = self.inside
            elif c == '"':
                self.inside = not self.inside
            elif not self.inside:
                self.depth += 1 if c == "{" else -1
                if not self.depth:
                    whole, self.open, self.at = self.open[: self.at], self.open[self.at :], 0
                    out += [whole] if is_object(whole) else Reader().all_of(whole[1:])

    def given_up(self) -> list[str]:
        """The objects behind an outermost brace that nothing closes; the reader goes on with the rest."""
        rest = self.open[1:]
        self.open, self.at, self.depth = "", 0, 0
        return self.feed(rest)

    def end(self) -> list[str]:
        out: list[str] = []
        while self.depth:
            out += self.given_up()
        return out

    def all_of(self, text: str) -> list[str]:
        return self.feed(text) + self.end()


def objects(texts: DataFrame) -> DataFrame:
    """request, place and json of every outermost object in each text (request, text), by the reader of the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for request, text in zip(batch.column("request").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = Reader().all_of(text or "")
                yield pa.RecordBatch.from_arrays([pa.array([request] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), pa.array(found, pa.string())], names=["request", "place", "json"])

    return texts.select(F.col("request").cast("string"), F.col("text").cast("string")).mapInArrow(run, "request string, place long, json string")


def pieces(lines: DataFrame) -> DataFrame:
    """request, seq, piece and done of the lines (request, seq, line) that a model streams: pieces of either kind of server; other lines with their line end; done is the end mark of a stream."""
    record = D.stream_record(F.col("line"))
    piece = F.coalesce(D.delta(record), F.concat(F.coalesce(record, F.lit("")), F.lit("\n")))
    done = F.coalesce(F.regexp_replace(F.trim("line"), r"^data:\s*", "") == "[DONE]", F.lit(False)) | F.coalesce(F.get_json_object(record, "$.done") == "true", F.lit(False))
    return lines.select(F.col("request").cast("string"), F.col("seq").cast("long"), F.when(done & D.delta(record).isNull(), "").otherwise(piece).alias("piece"), done.alias("done"))


class Decoder(StatefulProcessor):
    """A reader for each request, in the state store."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reader = handle.getValueState("reader", "open string, at int, depth int, inside boolean, escaped boolean, place long, next long, blocks array<bigint>")
        self.early = handle.getMapState("early", "block long", "pieces string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        kept = self.reader.get() if self.reader.exists() else None
        reader = Reader(*kept[:5]) if kept else Reader()
        place, after, blocks = (kept[5], kept[6], set(kept[7])) if kept else (0, 0, set())
        here: dict[int, tuple[str, bool]] = {}
        held = 0
        for row in rows:
            if row.seq < after:
                continue
            here[row.seq] = (row.piece or "", bool(row.done))
            held += len(here[row.seq][0]) + 1
            if row.seq > after:
                if held > MOST:
                    self.put_by(here, blocks)
                    held = 0
                continue
            while True:
                if after // BLOCK in blocks:  # also where the piece is here: it may have come before
                    here = self.taken(after // BLOCK, blocks) | here
                if after not in here:
                    break
                piece, done = here.pop(after)
                held = max(0, held - len(piece) - 1)
                after += 1
                for found in reader.feed(piece) + (reader.end() if done else []):
                    yield Row(request=key[0], place=place, json=found)
                    place += 1
        self.put_by(here, blocks)
        self.reader.update((reader.open, reader.at, reader.depth, reader.inside, reader.escaped, place, after, sorted(blocks)))

    def put_by(self, here: dict[int, tuple[str, bool]], blocks: set[int]) -> None:
        """Moves pieces to the state, where BLOCK numbers share a row."""
        by_block: dict[int, dict[int, tuple[str, bool]]] = {}
        for seq, x in here.items():
            by_block.setdefault(seq // BLOCK, {})[seq] = x
        here.clear()
        for block, own in by_block.items():
            if block in blocks:
                own = self.taken(block, blocks, keep=True) | own
            self.early.updateValue((block,), (json.dumps([(seq, *x) for seq, x in own.items()]),))
            blocks.add(block)

    def taken(self, block: int, blocks: set[int], keep: bool = False) -> dict[int, tuple[str, bool]]:
        """The pieces of a block, which leave the state unless they are kept."""
        found = {seq: (piece, done) for seq, piece, done in json.loads(self.early.getValue((block,))[0])}
        if not keep:
            self.early.removeKey((block,))
            blocks.discard(block)
        return found

    def close(self) -> None:
        pass


def decoded_stream(lines: DataFrame) -> DataFrame:
    """objects(), but of a stream of lines (request, seq from 0, line), each row once and as soon as its object closes. The session's state store must be STORE = ROCKS."""
    return pieces(lines).groupBy("request").transformWithState(Decoder(), "request string, place long, json string", "Append", "None")


def decoded_files(spark: SparkSession, folder: str, schema: str, out: str, checkpoint: str, files: int = 1) -> DataFrame:
    """Decodes what a folder of Parquet files (request, seq, line) has and hasn't been decoded yet, so many files a batch; returns all objects that out has."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        lines = spark.readStream.schema("request string, seq long, line string").option("maxFilesPerTrigger", files).parquet(folder)
        decoded_stream(lines).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(STORE, before)
    rows = spark.read.schema("request string, place long, json string").parquet(out)
    return rows.select("request", "place", F.from_json("json", schema).alias("_r")).select("request", "place", "_r.*")


def answer_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as a model's answer: prose with braces, then an object with nested ones for every turn, cut into pieces of 61 characters as one kind of server sends them."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turn = F.struct(F.col("turn").cast("string").alias("block_id"), F.struct("role", F.struct(F.col("turn").alias("n"), F.lit("} \\ {").alias("mark")).alias("deep")).alias("meta"), F.coalesce("text", F.lit("")).alias("text"))
    own = c.groupBy(F.col("conv_id").cast("string").alias("request")).agg(F.array_sort(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("r"), F.to_json(turn).alias("x")))).alias("xs"))
    text = F.concat(F.lit("Here is {what I found}, {as asked:\n["), F.array_join(F.transform("xs", lambda x: x["x"]), ",\n"), F.lit("]"))
    own = own.withColumn("t", text)
    cut = own.select("request", F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.length("t") - 1) / 61).cast("int")), lambda i: F.substring(F.col("t"), i * 61 + 1, F.lit(61)))).alias("seq", "piece"))
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("piece").alias("content")).alias("delta"))).alias("choices"))))
    ends = own.select("request", (F.floor((F.length("t") - 1) / 61) + 1).cast("long").alias("seq"), F.lit("data: [DONE]").alias("line"))
    return cut.select("request", F.col("seq").cast("long"), line.alias("line")).unionByName(ends)


def stream_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of streamed answers, decoded over four batches that the pieces fall into by hash, out of order."""
    base = work_folder(spark)
    chars = spark.read.parquet(f"{sf_dir}/conversations.parquet").agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    files = max(1, -(-chars // (4 * FILE_CHARS)))
    written(answer_lines(spark, sf_dir).repartition(4 * files, F.xxhash64("request", "seq")).sortWithinPartitions(F.xxhash64("seq")), f"{base}/lines")
    rows = decoded_files(spark, f"{base}/lines", "block_id string, meta struct<role: string, deep: struct<n: int, mark: string>>, text string", f"{base}/out", f"{base}/checkpoint", files)
    return rows.select("request", "place", "block_id", F.col("meta.role").alias("role"), F.col("meta.deep.n").cast("long").alias("n"), F.col("meta.deep.mark").alias("mark"), F.md5("text").alias("text_md5"))


STREAM_RECORDS = r"""
SELECT CAST(conv_id AS VARCHAR) AS request, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, '')) - 1 AS place, CAST(turn AS VARCHAR) AS block_id, role, CAST(turn AS BIGINT) AS n, '} \ {' AS mark,
  md5(coalesce(text, '')) AS text_md5 FROM conversations
"""
