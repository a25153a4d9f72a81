"""Substring deduplication with prefix-partitioned suffix trees.

A window is 20 consecutive words of one document; a word goes if a window covers it whose words
also start earlier in the corpus (smaller doc_id, or earlier in the same document).

Every window holds an anchor: of the 16 five-word runs in it, the leftmost one with the smallest
fingerprint. Equal windows have equal anchors, so the suffixes that start at one anchor's windows
can be dealt out by the anchor's words, the prefix, and travel packed: neighbouring windows with one
anchor are one stretch of text. The job:

1. Prefixes are counted. A prefix that occurs once is a leaf of the suffix tree, no repeat is below
   it, and its suffixes go no further.
2. Suffixes with other prefixes are dealt out in memory-sized groups. Of a frequent prefix, each
   part of the input first drops windows that it has already seen, and a very frequent prefix is
   made longer, up to the whole window, so that its suffixes spread over all groups.
3. Each group's suffixes are sorted by their words, with the longest common prefixes of neighbours,
   word by word: the leaves and the internal nodes of the group's subtrees, cut at depth 20. A node
   that deep is a repeat; its earliest leaf stays, the others' words go. Windows of a stretch whose
   nodes are that deep join to one repeat, so repeats are as long as they can be.

Exact copies of a whole text are all repeats of the first: they take no part in this, and lose all
words if there are 20 or more. Null texts have no words; texts of under 20 words lose none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.llm.bpe import Recent
from notespan.llm.common import WHITE, Words, columns, documents, groups_for, ids_of, mix, odd_numbers, table

WINDOW, PREFIX = 20, 5
SPAN = WINDOW - PREFIX + 1
#: How often a prefix occurs from which on parts of the input drop windows seen before, and from which on it is made longer.
FREQUENT, VERY_FREQUENT = 8, 4096
#: How often a prefix occurs in what a task sends at once from which on it counts as very frequent, and its documents don't go through its group.
HOT = 256
GROUP_BYTES = 4 << 20
FLUSH_BYTES = 8 << 20
#: Windows of frequent prefixes that a task remembers, in each of two generations.
SEEN = 1 << 20


def anchors(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and anchor of every window, and the prefix at each word (fingerprints with the last two bits 0)."""
    prefix = np.full(len(words), np.uint64(2**64 - 1))
    hashes, at = words.shingles(PREFIX)
    prefix[at] = hashes & ~np.uint64(3)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), prefix
    least, place, width = prefix, np.arange(len(words)), 1
    while width < SPAN:
        right, left = least[width:], least[:-width]
        keep = left <= right
        least = np.where(keep, left, right)
        place = np.where(keep, place[:-width], place[width:])
        width *= 2
    start = np.flatnonzero(words.text_of[:n] == words.text_of[WINDOW - 1 :])
    return start, place[start], prefix


class Blobs:
    """Collects what goes to each group and gives it out in few rows. add() takes rows of equal kinds of arrays, sorted by group."""

    def __init__(self, kinds: int):
        self.held: dict[int, list[list[bytes]]] = {}
        self.kinds, self.size = kinds, 0

    def add(self, group: int, *parts: bytes) -> None:
        self.held.setdefault(group, [[] for _ in range(self.kinds)])
        for out, part in zip(self.held[group], parts, strict=True):
            out.append(part)
            self.size += len(part)

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if self.size > least and self.held:
            groups = sorted(self.held)
            cols = [pa.array([b"".join(self.held[g][k]) for g in groups], pa.binary()) for k in range(self.kinds)]
            yield pa.RecordBatch.from_arrays([pa.array(groups, pa.int32()), *cols], names=["group", *(f"part{k}" for k in range(self.kinds))])
            self.held, self.size = {}, 0


def joined(group: pa.Table, name: str) -> bytes:
    return b"".join(group.column(name).to_pylist())


def prefixes(docs: DataFrame, groups: int) -> DataFrame:
    """doc_id and prefixes (array of long): those of the document's anchors that occur more than once; the last two bits tell how frequent.

    Occurrences go to their prefix's group as id and prefix. Of a prefix that is hot in what a task sends at once,
    only that goes there; the occurrences go to groups of their documents, as very frequent ones, and the
    prefix's group calls all others very frequent too. So a line that every document has makes no large group.
    """

    def parted(batch: pa.RecordBatch) -> pa.RecordBatch:
        """What is sent, without the occurrences of hot prefixes; those to groups below 0, by document."""
        out, home = Blobs(2), []
        for group, keys, ids in zip(*(batch.column(c).to_pylist() for c in ("group", "part0", "part1")), strict=True):
            key, doc = np.frombuffer(keys, np.uint64), np.frombuffer(ids, np.int64)
            names, back, n = np.unique(key, return_inverse=True, return_counts=True)
            hot = (n > HOT)[back.ravel()]
            if hot.any():
                home.append((key[hot] | np.uint64(3), doc[hot]))
                key, doc = np.concatenate([key[~hot], names[n > HOT] | np.uint64(1)]), np.concatenate([doc[~hot], np.zeros((n > HOT).sum(), np.int64)])
            out.add(group, key.tobytes(), doc.tobytes())
        if home:
            key, doc = (np.concatenate(x) for x in zip(*home, strict=True))
            group = -1 - (mix(doc.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            key, doc, group = key[order], doc[order], group[order]
            cuts = np.flatnonzero(np.diff(group, prepend=1))
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)], strict=True):
                out.add(int(group[a]), key[a:b].tobytes(), doc[a:b].tobytes())
        return next(out.flush(-1))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Blobs(2)
        for batch in batches:
            for rows, data, bounds in columns(batch):
                words = Words(data, bounds, WHITE)
                _, anchor, prefix = anchors(words)
                anchor = np.unique(anchor)
                ids = ids_of(batch, rows)[words.text_of[anchor]]
                key = prefix[anchor]
                group = (mix(key) % np.uint64(groups)).astype(np.int64)
                order = np.argsort(group, kind="stable")
                key, ids, group = key[order], ids[order], group[order]
                cuts = np.flatnonzero(np.diff(group, prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(group)], strict=True):
                    out.add(int(group[a]), key[a:b].tobytes(), ids[a:b].astype(np.int64).tobytes())
                yield from map(parted, out.flush(FLUSH_BYTES))
        yield from map(parted, out.flush(0))

    def count(group: pa.Table) -> pa.Table:
        key = np.frombuffer(joined(group, "part0"), np.uint64)
        ids = np.frombuffer(joined(group, "part1"), np.int64)
        if group.column("group")[0].as_py() >= 0:
            order = np.argsort(key, kind="stable")
            key, ids = key[order], ids[order]
            name = key & ~np.uint64(3)
            cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(key)), bool), name[1:] != name[:-1]]))
            n = np.diff(np.append(cuts, len(key)))
            sign = key != name
            hot = np.logical_or.reduceat(sign, cuts) if len(cuts) else np.empty(0, bool)
            often = np.repeat(np.where(hot, VERY_FREQUENT + 1, n), n)
            key = name | (often > FREQUENT).astype(np.uint64) | ((often > VERY_FREQUENT).astype(np.uint64) << np.uint64(1))
            keep = (often > 1) & ~sign
            key, ids = key[keep], ids[keep]
        order = np.argsort(ids, kind="stable")
        key, ids = key[order], ids[order]
        cuts = np.flatnonzero(np.concatenate([np.ones(min(1, len(ids)), bool), ids[1:] != ids[:-1]]))
        lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(ids)).astype(np.int32)), pa.array(key.view(np.int64)))
        return pa.table({"doc_id": pa.array(ids[cuts]), "prefixes": lists})

    dealt = docs.mapInArrow(emit, "group int, part0 binary, part1 binary")
    counted = dealt.groupBy("group").applyInArrow(count, "doc_id long, prefixes array<long>")
    return counted.groupBy("doc_id").agg(F.flatten(F.collect_list("prefixes")).alias("prefixes"))


def wanted(batch: pa.RecordBatch, rows: slice) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and prefix, for all the texts' prefixes."""
    lists = batch.column("prefixes").slice(rows.start, rows.stop - rows.start)
    counts = np.array(lists.value_lengths().fill_null(0), np.int64)
    return np.repeat(np.arange(len(counts)), counts), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def suffixes(docs: DataFrame, groups: int) -> DataFrame:
    """From doc_id, text and prefixes: the stretches of text whose windows may repeat, by group; and windows already known to repeat."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Blobs(3)
        seen = Recent(SEEN)
        for batch in batches:
            for rows, data, bounds in columns(batch):
                words = Words(data, bounds, WHITE)
                start, anchor, prefix = anchors(words)
                text, keys = wanted(batch, rows)
                if not len(start) or not len(keys):
                    continue
                both = np.sort(mix(keys & ~np.uint64(3)) ^ mix(text.astype(np.uint64) + np.uint64(1)))
                order = np.argsort(mix(keys & ~np.uint64(3)) ^ mix(text.astype(np.uint64) + np.uint64(1)))
                own = mix(prefix[anchor]) ^ mix(words.text_of[start].astype(np.uint64) + np.uint64(1))
                place = np.searchsorted(both, own)
                place[place == len(both)] = 0
                fits = both[place] == own
                level = (keys[order] & np.uint64(3))[place][fits].astype(np.int64)
                start, anchor = start[fits], anchor[fits]
                ids = ids_of(batch, rows)[words.text_of[start]].astype(np.int64)
                local = start - words.first[words.text_of[start]]
                # Frequent windows that this part of the input has seen before, earlier in the corpus.
                often = np.flatnonzero(level > 0)
                whole = window_hash(words.hash, start)
                known = np.zeros(len(start), bool)
                for k, h, d, s in zip(often.tolist(), whole[often].tolist(), ids[often].tolist(), local[often].tolist(), strict=True):
                    first = seen.find(h)
                    if first is not None and first < (d, s):
                        known[k] = True
                    else:
                        seen.keep(h, (d, s))
                for d, a, b in zip(*intervals(ids[known], local[known]), strict=True):
                    out.add(int(d % groups), b"", b"", np.array([d, a, b], np.int64).tobytes())
                left = np.flatnonzero(~known)
                if not len(left):
                    continue
                start, anchor, ids, local, level, whole = (x[left] for x in (start, anchor, ids, local, level, whole))
                new = np.ones(len(start), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (level[1:] >= 2)
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(start)))
                deal = np.where(level[first] >= 2, whole[first], mix(prefix[anchor[first]]))
                group = (deal % np.uint64(groups)).astype(np.int64)
                begin, end = words.start[start[first]], words.end[start[first] + count + WINDOW - 2]
                meta = np.stack([ids[first], local[first], count, end - begin], axis=1)
                order = np.argsort(group, kind="stable")
                raw = words.data.tobytes()
                cuts = np.flatnonzero(np.diff(group[order], prepend=-1))
                for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    rs = order[a:b]
                    out.add(int(group[rs[0]]), meta[rs].astype(np.int64).tobytes(), b"".join([raw[x:y] for x, y in zip(begin[rs].tolist(), end[rs].tolist(), strict=True)]), b"")
                yield from out.flush(FLUSH_BYTES)
        yield from out.flush(0)

    return docs.mapInArrow(emit, "group int, part0 binary, part1 binary, part2 binary")


def window_hash(h: np.ndarray, start: np.ndarray) -> np.ndarray:
    odd = odd_numbers(WINDOW)
    total = np.zeros(len(start), np.uint64)
    for j in range(WINDOW):
        total += h[start + j] * odd[j]
    return mix(total)


def intervals(ids: np.ndarray, start: np.ndarray) -> tuple[list, list, list]:
    """doc_id, first word and word after the last that windows cover, from windows' documents and starts."""
    order = np.lexsort((start, ids))
    ids, start = ids[order], start[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (start[1:] > start[:-1] + WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(ids)) - 1 if len(first) else first
    return ids[first].tolist(), start[first].tolist(), (start[last] + WINDOW).tolist()


def leaves(number: np.ndarray, at: np.ndarray, ties: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The order of a subtree's leaves, and how many words, up to a window, each has in common with the leaf before.

    number: the words' numbers, end to end; at: where each suffix starts; ties: what orders equal ones, the last key
    first. So an internal node of depth d is a run of leaves, all but its first with d words or more in common.
    """
    bits = max(1, int(number.max(initial=0)).bit_length())
    packed, keys = 64 // bits, []
    for k in range(0, WINDOW, packed):  # so many words in a key as fit
        key = np.zeros(len(at), np.uint64)
        for j in range(k, min(k + packed, WINDOW)):
            key = (key << np.uint64(bits)) | number[at + j].astype(np.uint64)
        keys.append(key)
    order = np.lexsort((*ties, *keys[::-1]))
    depth, same = np.zeros(len(order), np.int64), np.ones(max(0, len(order) - 1), bool)
    for j in range(WINDOW):
        word = number[at[order] + j]
        same &= word[1:] == word[:-1]
        depth[1:] += same
    return order, depth


def tree(group: pa.Table) -> pa.Table:
    """The words that go, as doc_id, first word, word after the last: below nodes as deep as a window, all leaves but the earliest."""
    meta = np.frombuffer(joined(group, "part0"), np.int64).reshape(-1, 4)
    known = np.frombuffer(joined(group, "part2"), np.int64).reshape(-1, 3)
    data = np.frombuffer(joined(group, "part1"), np.uint8)
    ends = np.concatenate([[0], np.cumsum(meta[:, 3])])
    hashes, row = [np.empty(0, np.uint64)], 0
    while row < len(meta):  # in steps, for memory
        to = max(row + 1, int(np.searchsorted(ends, ends[row] + (1 << 20), "right")) - 1)
        hashes.append(Words(data[ends[row] : ends[to]], ends[row : to + 1] - ends[row], WHITE).hash)
        row = to
    h = np.concatenate(hashes)
    count = meta[:, 2]
    first = np.concatenate([[0], np.cumsum(count + WINDOW - 1)])[:-1]
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(first, count) + step
    ids, start = np.repeat(meta[:, 0], count), np.repeat(meta[:, 1], count) + step
    order, depth = leaves(np.unique(h, return_inverse=True)[1].ravel(), at, (start, ids))
    later = order[depth >= WINDOW]
    found = intervals(ids[later], start[later])
    cols = [np.concatenate([np.array(x, np.int64), known[:, k]]) for k, x in enumerate(found)]
    return pa.table(dict(zip(["doc_id", "first", "after"], cols, strict=True)))


def repeats(docs: DataFrame) -> DataFrame:
    """doc_id, first, after: the words (from 0, the end exclusive) of each distinct text that earlier windows cover; intervals may overlap.

    Exact copies of an earlier text are left out. docs has doc_id and text.
    """
    groups = groups_for(docs, GROUP_BYTES)
    first = docs.where("text is not null").groupBy(F.sha2("text", 256).alias("_sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    few = first.join(prefixes(docs, groups), "doc_id")
    return suffixes(docs.join(few, "doc_id"), groups).groupBy("group").applyInArrow(tree, "doc_id long, first long, after long")


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def kept(docs: DataFrame, texts: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with texts, kept (else null): the words that stay, joined by one space. A row for every document."""
    own = documents(docs)
    first = own.where("text is not null").groupBy(F.sha2("text", 256).alias("_sha")).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("is_first"))
    gone = repeats(own).groupBy("doc_id").agg(F.collect_list(F.struct("first", "after")).alias("gone"))
    rows = own.join(first.join(gone, "doc_id", "left"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, shas, left = [], [], [], []
            for text, is_first, gone in zip(*(batch.column(c).to_pylist() for c in ("text", "is_first", "gone")), strict=True):
                words = (text or "").encode().split()
                n = len(words)
                if not is_first and n >= WINDOW:
                    words = []
                elif gone:
                    stays = np.ones(n, bool)
                    for g in gone:
                        stays[g["first"] : g["after"]] = False
                    words = list(compress(words, stays.tolist()))
                out = b" ".join(words)
                n_words.append(n)
                n_removed.append(n - len(words))
                shas.append(hashlib.sha256(out).hexdigest())
                left.append(out.decode() if texts else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(shas, pa.string()), pa.array(left, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return rows.select("doc_id", "text", "is_first", "gone").mapInArrow(run, KEPT)


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(table(spark, sf_dir, "documents"), texts=False).drop("kept")


OP2_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 19), ' ') AS k FROM (SELECT *, unnest(range(1, len(ws) - 18)) AS i FROM w)),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM s) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT *, unnest(range(0, 20)) AS o FROM d)),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w) p ANTI JOIN g ON g.doc_id = p.doc_id AND g.i = p.i GROUP BY p.doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k ON k.doc_id = w.doc_id
"""
