"""Benchmark decontamination: SimHash windows as long as the items, found by multi-index Hamming blocks, verified exactly.

Texts and items are lower-cased (A-Z) and split at white space; both are bags of five-word shingles
(a shorter item is one shingle of all its words). A shingle weighs more the fewer items of the whole
benchmark have it.
For every item length, the windows of that many words are fingerprinted with 128 bits. The index
splits the bits into 12 blocks and lists, for each value of a block, the items within two bits of
it; 12 blocks with over two bits each would make 36, so every item within a radius of 35 bits is
met. Of those, the exact weighted similarity (common over combined weight) must reach 0.8.

A window of which less than 0.8 of the weight is in shingles that any item has can't be similar to
one, and gets no fingerprint. Each document is a row of its own, so nothing is shuffled but the
result. Items go to the tasks in passes of a bounded number of bytes, so a large benchmark takes
more passes; beside a pass's items, tasks hold 12 bytes for each shingle that several items of the
benchmark have. Results don't depend on the passes. Null texts and texts without words contain nothing; items without
words are contained in nothing.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.llm.common import WHITE, Words, columns, documents, ids_of, mix, names, table, written

WIDTH, SIMILAR = 5, 0.8
BITS, RADIUS = 128, 35
BLOCKS = [11] * 8 + [10] * 4
#: Bytes of items that one pass over the documents compares.
PASS_BYTES = 4 << 20


def bits_of(hashes: np.ndarray) -> np.ndarray:
    """128 bits of each shingle, as -1 and 1."""
    two = np.stack([hashes, mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1)
    return np.unpackbits(two.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


class Items:
    """The index of some benchmark items. often: shingles that several items of the whole benchmark have (sorted), and how many items; if not given, these items are all."""

    def __init__(self, ids: list[int], texts: list[str], often: tuple[np.ndarray, np.ndarray] | None = None):
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        words = Words(data, np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64), WHITE)
        self.lens = np.diff(words.first)
        self.ids = np.array(ids, np.int64)
        hashes, at = words.shingles(WIDTH)
        own = words.text_of[at]
        self.short: dict[int, dict[int, list[int]]] = {}
        for n in range(1, WIDTH):
            h, a = words.shingles(n)
            for x, item in zip(h.tolist(), words.text_of[a].tolist(), strict=True):
                if self.lens[item] == n:
                    self.short.setdefault(n, {}).setdefault(x, []).append(item)
        self.known = np.unique(hashes)
        if often is None:
            several, n = np.unique(once_each(own, hashes), return_counts=True)
            often = several[n > 1], n[n > 1]
        self.often = often[0]
        #: Whole numbers, so that sums are exact: 16 for a shingle of one item, or of none, and less for one of many.
        self.often_weight = np.maximum(1, np.rint(16 / np.sqrt(often[1]))).astype(np.int32)
        self.weight = self.weight_of(self.known)
        self.bags = [Counter() for _ in ids]
        for h, item in zip(hashes.tolist(), own.tolist(), strict=True):
            self.bags[item][h] += 1
        self.weights = dict(zip(self.known.tolist(), self.weight.tolist(), strict=True))
        ok = [i for i in range(len(ids)) if self.lens[i] >= WIDTH]
        self.by_len = sorted({int(self.lens[i]) for i in ok})
        sums = np.zeros((len(ids), BITS), np.int64)
        if len(hashes):
            np.add.at(sums, own, bits_of(hashes) * self.weight[np.searchsorted(self.known, hashes)][:, None])
        self.prints = sums > 0
        self.table = []
        for low, n in zip(np.cumsum([0, *BLOCKS]), BLOCKS, strict=False):
            values = self.prints[:, low : low + n] @ (1 << np.arange(n))
            near = np.array([0] + [1 << i for i in range(n)] + [(1 << i) | (1 << j) for i in range(n) for j in range(i)])
            keys = (values[ok, None] ^ near).ravel() if ok else np.empty(0, np.int64)
            items = np.repeat(np.array(ok, np.int64), len(near))
            order = np.argsort(keys, kind="stable")
            self.table.append((int(low), n, np.searchsorted(keys[order], np.arange((1 << n) + 1)), items[order]))

    def weight_of(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(hashes), 16, np.int64)
        if len(self.often):
            at = np.searchsorted(self.often, hashes)
            at[at == len(self.often)] = 0
            hit = self.often[at] == hashes
            out[hit] = self.often_weight[at[hit]]
        return out

    def near(self, prints: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """Row of prints and item, for all items of that length within the radius."""
        rows, items = [], []
        for low, n, begin, listed in self.table:
            value = prints[:, low : low + n] @ (1 << np.arange(n))
            count = begin[value + 1] - begin[value]
            row = np.repeat(np.arange(len(value)), count)
            place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin[value], count)
            item = listed[place]
            fits = self.lens[item] == length
            rows.append(row[fits])
            items.append(item[fits])
        pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items)], 1), axis=0)
        apart = (prints[pairs[:, 0]] != self.prints[pairs[:, 1]]).sum(axis=1)
        yield from map(tuple, pairs[apart <= RADIUS].tolist())

    def similarity(self, bag: Counter, weight: int, item: int) -> float:
        """Of a bag of shingles that weigh so much in all."""
        other, w = self.bags[item], self.weights
        common = sum(min(n, other[h]) * w[h] for h, n in bag.items() if h in other)
        total = weight + sum(n * w[h] for h, n in other.items())
        return common / (total - common)

    def windows(self, words: Words) -> Iterator[tuple[int, int, int, float]]:
        """Text, first word, item and similarity of every window that is similar to an item as long."""
        for n, wanted in self.short.items():
            h, at = words.shingles(n)
            for k in np.flatnonzero(np.isin(h, np.array(list(wanted), np.uint64))):
                text = int(words.text_of[at[k]])
                for item in wanted[int(h[k])]:
                    yield text, int(at[k] - words.first[text]), item, 1.0
        h, at = words.shingles(WIDTH)
        if not len(h) or not len(self.known):
            return
        place = np.searchsorted(self.known, h)
        place[place == len(self.known)] = 0
        hit = self.known[place] == h
        if not hit.any():
            return
        weight = self.weight_of(h)
        all_w = np.concatenate([[0], np.cumsum(weight)])
        hit_w = np.concatenate([[0], np.cumsum(weight * hit)])
        text = words.text_of[at]
        hits = np.flatnonzero(hit)
        longest = self.by_len[-1] - WIDTH + 1
        edges = np.zeros(len(h) + 1, np.int64)
        np.add.at(edges, np.maximum(hits - longest + 1, 0), 1)
        np.add.at(edges, hits + 1, -1)
        near = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
        picked = []
        for length in self.by_len:
            n = length - WIDTH + 1
            s = near[near + n <= len(h)]
            s = s[text[s] == text[s + n - 1]]
            s = s[(hit_w[s + n] - hit_w[s]) >= SIMILAR * (all_w[s + n] - all_w[s]) - 1e-9]
            if len(s):
                picked.append((length, n, s))
        if not picked:
            return
        cover = np.zeros(len(h) + 1, np.int64)
        for _, n, s in picked:
            np.add.at(cover, s, 1)
            np.add.at(cover, s + n, -1)
        used = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        local = np.zeros(len(h) + 1, np.int64)
        local[used] = np.arange(len(used))
        sums = np.concatenate([np.zeros((1, BITS), np.int64), np.cumsum(bits_of(h[used]).astype(np.int64) * weight[used][:, None], axis=0)])
        for length, n, s in picked:
            prints = (sums[local[s] + n] - sums[local[s]]) > 0
            for row, item in self.near(prints, length):
                at_shingle = int(s[row])
                similar = self.similarity(Counter(h[at_shingle : at_shingle + n].tolist()), int(all_w[at_shingle + n] - all_w[at_shingle]), item)
                if similar >= SIMILAR:
                    t = int(text[at_shingle])
                    yield t, int(at[at_shingle] - words.first[t]), item, similar


def once_each(text: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The hashes, each once for a text."""
    order = np.lexsort((hashes, text))
    text, hashes = text[order], hashes[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new]


def shared_shingles(items: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several items have, sorted, and how many items each."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in columns(batch, lower=True):
                words = Words(data, bounds, WHITE)
                h, at = words.shingles(WIDTH)
                yield pa.RecordBatch.from_arrays([pa.array(once_each(words.text_of[at], h).view(np.int64))], names=["shingle"])

    found = items.mapInArrow(emit, "shingle long").groupBy("shingle").agg(F.count("*").cast("int").alias("n")).where("n > 1").toArrow()
    shingle, n = (found.column(c).to_numpy() for c in ("shingle", "n"))
    shingle = shingle.view(np.uint64)
    order = np.argsort(shingle)
    return shingle[order], n[order]


def passes(benchmark: DataFrame) -> Iterator[Items]:
    """The items, as many at once as PASS_BYTES allows, or one."""
    own = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("item_id is not null and text is not null")
    n = own.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0)).alias("n")).first()["n"]
    parts = -(-n // PASS_BYTES)
    often = shared_shingles(own) if parts else None
    for part in range(parts):
        rows = own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).collect()
        if rows:
            yield Items([r["item_id"] for r in rows], [r["text"] for r in rows], often)


FOUND = "doc_id long, item_id long, similarity double, first_word long, n_words long"


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, first_word and n_words of the most similar window (the first of equals), for every document and item it contains."""
    own = documents(docs)

    def search(items: Items):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, bounds in columns(batch, lower=True):
                    best: dict[tuple[int, int], tuple[float, int, int]] = {}
                    ids = ids_of(batch, rows)
                    for text, start, item, similar in items.windows(Words(data, bounds, WHITE)):
                        key = int(ids[text]), int(items.ids[item])
                        best[key] = max(best.get(key, (0.0, 0, 0)), (similar, -start, int(items.lens[item])))
                    if best:
                        cols = zip(*((*k, s, -a, n) for k, (s, a, n) in best.items()), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()], strict=True)], names=["doc_id", "item_id", "similarity", "first_word", "n_words"])

        return own.mapInArrow(run, FOUND)

    parts: list[DataFrame] = []
    for items in passes(benchmark):
        if parts:  # one index at a time is on the driver: what the one before found is written first
            parts[-1] = written(parts[-1])
        parts.append(search(items))
    if not parts:
        return docs.sparkSession.createDataFrame([], FOUND)
    best = F.max_by(F.struct("similarity", "first_word", "n_words"), F.struct("similarity", -F.col("first_word"))).alias("b")
    return reduce(DataFrame.union, parts).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.*")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that contain an item."""
    return docs.join(contained(docs, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(*names(docs))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
