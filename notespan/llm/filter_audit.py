"""How filters interact: for every order of five filters, what each removes, and what it alone would.

One pass over the texts makes a narrow row of each document: its part, which of the filters A to D it
fails, and the SHA-256 and length of its text, which stand for the text from then on, so that no text
travels. Filter E (a text that a smaller doc_id has too) takes a prepass with a counting Bloom filter in
blocks of COUNTERS: each task counts the places that its digests hash to, up to 2, and sends one sparse
row a block; a block's rows are merged. A digest with a place that counts 1 is of one row alone. Only the
others, the possible repeats, are shuffled for the exact smallest doc_id of each digest. Flags and labels
are joined, counted by part and set of failed filters, and every order's figures follow from those at
most 32 counts of a part: they are additive over parts and over batches of documents.

A text that a third of all documents share counts once a task in the filter and once a task in the
smallest ids (partial aggregates); whether a row has that smallest id is looked up by doc_id and digest,
which no two texts share. Blocks go to all tasks only if they have at most BROADCAST_BYTES, else they
are joined by block number.

Null texts are empty, null parts are the empty string; rows without doc_id have no place in any result.
Rows that repeat a doc_id each count; a document with several labels is good, or toxic, if one of them
says so. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.llm.common import column_or_null, table, written
from notespan.llm.secrets import bound

FILTERS = "ABCDE"
ORDERS = 120
#: Counters of a block, places of a digest in it, and documents that a block is sized for.
COUNTERS, PLACES, BLOCK_DOCUMENTS = 4096, 4, 400
#: Blocks of so many bytes in all are sent to every task.
BROADCAST_BYTES = 32 << 20


def failed(text: Column) -> Column:
    """The sum of 1, 2, 4, 8 for the filters A, B, C, D that a text fails."""
    flag = lambda c, bit: F.when(c, bit).otherwise(0)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = lambda w: F.size(w).cast("long")
    by_words = bound(words, lambda w: flag(n(w) < 200, 1) + flag(100 * n(F.array_distinct(w)) < 50 * n(w), 2))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))
    return by_words + flag(100 * capitals.cast("long") > 2 * F.length(text).cast("long"), 4) + flag(text.rlike("[#$%&*|]"), 8)


def narrow(docs: DataFrame) -> DataFrame:
    """doc_id, part, failed (A to D), and what stands for the text: digest and size."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(column_or_null(docs, "source", "string"), F.lit(""))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), part.alias("part"), failed(text).alias("failed"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("size"))


def placed(rows: DataFrame, blocks: int) -> DataFrame:
    """rows with the block of their digest and its places in it, as parts of one number."""
    return rows.withColumn("block", F.pmod(F.xxhash64("digest"), F.lit(blocks))).withColumn("places", F.xxhash64("digest", F.lit(1)))


def place(places: Column, i: int) -> Column:
    return F.shiftrightunsigned(places, 12 * i).bitwiseAND(F.lit(COUNTERS - 1)).cast("int")


def sketched(rows: DataFrame) -> DataFrame:
    """block and counts (0, 1, or 2 for more) of its counters, from placed rows."""

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block, number = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "places"))
            at = np.sort(np.stack([(number.view(np.uint64) >> np.uint64(12 * i)).astype(np.int64) & (COUNTERS - 1) for i in range(PLACES)], axis=1), axis=1)
            own = np.ones(at.shape, bool)  # a place that a digest has twice counts once
            own[:, 1:] = at[:, 1:] != at[:, :-1]
            cell, n = np.unique((block[:, None] * COUNTERS + at)[own], return_counts=True)
            block, n = cell // COUNTERS, np.minimum(n, 2).astype(np.uint8)
            first = np.flatnonzero(np.diff(block, prepend=-1))
            ends = np.append(first[1:], len(cell))
            cell = (cell % COUNTERS).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array([cell[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary()), pa.array([n[a:b].tobytes() for a, b in zip(first, ends, strict=True)], pa.binary())], names=["block", "cells", "n"])

    def merged(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(COUNTERS, np.uint8)
        for batch in batches:
            for cells, n in zip(batch.column("cells").to_pylist(), batch.column("n").to_pylist(), strict=True):
                out[np.frombuffer(cells, np.uint16)] += np.frombuffer(n, np.uint8)
                np.minimum(out, 2, out=out)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([out.astype(np.int8)], pa.list_(pa.int8()))], names=["block", "counts"])

    return rows.select("block", "places").mapInArrow(sparse, "block long, cells binary, n binary").groupBy("block").applyInArrow(merged, "block long, counts array<tinyint>")


def possible_repeats(rows: DataFrame) -> DataFrame:
    """The narrow rows whose text may stand in another row: all that do, and about one in a hundred others."""
    n = rows.count()
    blocks = max(1, -(-n // BLOCK_DOCUMENTS))
    own = placed(rows, blocks)
    counts = written(sketched(own))
    if blocks * COUNTERS <= BROADCAST_BYTES:
        counts = F.broadcast(counts)
    alone = [F.get("counts", place(F.col("places"), i)) == 1 for i in range(PLACES)]
    return own.join(counts, "block").where(~(alone[0] | alone[1] | alone[2] | alone[3])).select(*rows.columns)


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, failed (E is 16), good and toxic of every document."""
    rows = written(narrow(docs))
    maybe = possible_repeats(rows)
    first = maybe.groupBy("digest", "size").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    again = maybe.join(first, ["doc_id", "digest", "size"], "left").where("first is null").select("doc_id", "digest", "size").distinct().withColumn("again", F.lit(True))
    own = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("quality") == 1).alias("_good"), (F.max("toxic") == 1).alias("_toxic"))
    both = rows.join(again, ["doc_id", "digest", "size"], "left").join(own, "doc_id", "left")
    no = F.lit(False)
    return both.select("doc_id", "part", (F.col("failed") + F.when(F.col("again"), 16).otherwise(0)).alias("failed"), F.coalesce("_good", no).alias("good"), F.coalesce("_toxic", no).alias("toxic"))


def mask_counts(rows: DataFrame) -> DataFrame:
    """part, failed, n, good and toxic: what every figure follows from. Counts of several batches of documents add up."""
    return rows.groupBy("part", "failed").agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))


def by_order(counts: DataFrame) -> DataFrame:
    """The figures of every order of the filters and step of it, for each part."""
    masks = range(32)
    lists = [F.array(*(F.sum(F.when(F.col("failed") == m, F.col(c)).otherwise(0)) for m in masks)).alias(c) for c in ("n", "good", "toxic")]
    steps = [(o, i + 1, 1 << FILTERS.index(f), sum(1 << FILTERS.index(x) for x in o[:i])) for o in map("".join, permutations(FILTERS)) for i, f in enumerate(o)]
    step = F.explode(F.from_json(F.lit("[" + ",".join(f'{{"o":"{o}","s":{s},"own":{own},"before":{before}}}' for o, s, own, before in steps) + "]"), "array<struct<o:string,s:int,own:int,before:int>>"))
    rows = counts.groupBy("part").agg(*lists).withColumn("x", step)
    own, before = F.col("x.own"), F.col("x.before")

    def total(column: str, which) -> Column:
        return F.aggregate(F.transform(column, lambda n, m: F.when(which(m), n).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)

    fails = lambda m, bits: m.bitwiseAND(bits) != 0
    removed = lambda m: fails(m, own) & ~fails(m, before)
    share = lambda m: F.when(fails(m, own), F.lit(ORDERS) / F.bit_count(m)).otherwise(0).cast("long")
    return rows.select(
        "part", F.col("x.o").alias("filter_order"), F.col("x.s").alias("step"),
        total("n", lambda m: ~fails(m, own.bitwiseOR(before))).alias("kept"), total("n", removed).alias("removed"),
        total("n", lambda m: fails(m, own) & fails(m, before)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        F.aggregate(F.transform("n", lambda n, m: n * share(m)), F.lit(0).cast("long"), lambda a, b: a + b).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return by_order(mask_counts(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))))


OP12_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents WHERE doc_id IS NOT NULL
), l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), doc_id > min(doc_id) OVER (PARTITION BY t)] AS fails
  FROM w LEFT JOIN l USING (doc_id)
), m AS (SELECT part, good, toxic, fails, count(*) AS n FROM f GROUP BY ALL),
p(o) AS (
  SELECT a.x || b.x || c.x || d.x || e.x FROM (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) a, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) b, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) c,
    (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) d, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), s AS (SELECT o, i AS step, ascii(o[i]) - 64 AS own, list_transform(range(1, i), lambda j: ascii(o[j]) - 64) AS before FROM p, range(1, 6) AS r(i)),
q AS (
  SELECT part, o, step, own, n, good, toxic, fails[own] AS this, len(list_filter(before, lambda j: fails[j])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS k FROM m, s
), g AS (
  SELECT part, o, step, own, coalesce(sum(n) FILTER (NOT gone AND NOT this), 0) AS kept, coalesce(sum(n) FILTER (this AND NOT gone), 0) AS removed, coalesce(sum(n) FILTER (this AND gone), 0) AS redundant,
    coalesce(sum(n) FILTER (this AND k = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (this AND NOT gone AND good), 0) AS good_lost, coalesce(sum(n) FILTER (this AND NOT gone AND toxic), 0) AS toxic_lost
  FROM q GROUP BY ALL
)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM g
"""
