"""N-gram Jaccard self-join by partitioning the universe of shingles (pigeonhole principle).

A document's set is its distinct five-word shingles, lower-cased (A-Z); with fewer words, all of
them as one. Two documents link when 100 * common >= 80 * combined. Equal sets are one node.

Sizes fall into bands, each 1.25 times the one before, so linked sets are in one band or in
neighbouring ones. For each band of the larger set, hashes split the universe into segments. Linked
sets differ in at most H elements, so with H + 1 segments some segment has no difference. Segments
get an allowance: 0 (its subset must be equal: one signature), or 1 (it may differ by one element:
the subset and all subsets with one element less are signatures, and the segment counts twice and
is twice as wide). How many segments get 1 is a choice of each band by its cost: one in 64 of the
signatures that each choice would give are counted over all different sets, what is sent and what
would meet. The choice never changes a result. The allocation has some spare allowance. What is
spare pays for signatures that are left out (allowance -1): empty subsets, and subsets that many
different sets share. A set with too many empty subsets keeps them as signatures, and nothing is
spare. Sets that meet in a signature are compared exactly.

A set that has left out more than its spare allowance could miss a link, if its partner has too.
Such sets are compared by the frequent signatures as well: within those, only sets that are not
connected yet, until every pair not connected has been compared. So no link between components is
lost. First some sets of each frequent group, those with the most of its signatures, are compared
with all others; that connects most families. Then the group is dealt into blocks of about BLOCK
sets, a large component into blocks of its own, and a task compares two blocks by sizes, signatures
and sketches. Two blocks of one component are not compared. So no task holds more than two blocks
and the pairs between them; the number of tasks grows with the square of the sets of a group that
no link connects, such as a large family just below the threshold.

Null and wordless texts have no shingles, link with nothing and are components by themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notespan.llm.common import WHITE, Words, columns, documents, groups_for, ids_of, mix, table, written
from notespan.llm.components import components
from notespan.llm.substrings import FLUSH_BYTES, Blobs, joined

WIDTH, PERCENT = 5, 80
#: More different sets with one signature than this leave it out.
FREQUENT = 12
#: Sets that the others of a frequent group are compared with, before all pairs not connected yet are.
CENTRES = 8
#: Sets of a frequent group in a block, and parts that the rows of a large group are dealt to in joins.
BLOCK, SALTS = 1024, 64
TOP_SIZE = 1 << 40
#: The least number of a band's segments with allowance 1, and one in how many of its allowance, for each choice; STANDARD is taken where nothing was counted.
CHOICES, STANDARD = ((0, TOP_SIZE), (1, 48), (2, 16)), 1
#: What a pair that meets costs, in signatures sent; one in 2^SHARE_BITS signatures is counted.
PAIR_COST, SHARE_BITS = 20, 6


@cache
def bands() -> list[int]:
    """The first size of each band."""
    out = [1]
    while out[-1] < TOP_SIZE:
        out.append(out[-1] * 100 // PERCENT + 1)
    return out


def differences(total: np.ndarray | int) -> np.ndarray | int:
    """In how many elements linked sets of so many elements in all can differ at most: total - 2 * least common."""
    return total - 2 * -(-PERCENT * total // (100 + PERCENT))


@cache
def plan(choice: int = STANDARD) -> tuple[np.ndarray, np.ndarray]:
    """For each band of the larger set: the number of segments with allowance 1 and that with allowance 0."""
    loose, exact = [], []
    least, one_in = CHOICES[choice]
    for first, after in zip(bands(), bands()[1:], strict=False):
        most = max(int(differences(t)) for t in range(max(2, 2 * (after - 1) - 18), 2 * (after - 1) + 1))
        need = most + 1 + 2 + most * 4 // 100
        one = min(max(least, need // one_in), (need - 1) // 2) if most else 0
        loose.append(one)
        exact.append(need - 2 * one if most else 1)
    return np.array(loose), np.array(exact)


def sets(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and shingle, sorted, without repeats."""
    hashes, at = words.shingles(WIDTH)
    text = words.text_of[at]
    lens = np.diff(words.first)
    for n in range(1, WIDTH):
        if (lens == n).any():
            h, a = words.shingles(n)
            keep = lens[words.text_of[a]] == n
            hashes = np.concatenate([hashes, mix(h[keep] + np.uint64(n))])
            text = np.concatenate([text, words.text_of[a][keep]])
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashes[1:] != hashes[:-1])
    return text[new], hashes[new]


def nodes_of(text: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The size of each of n texts' sets, and a number that stands for the set."""
    size = np.bincount(text, minlength=n)
    total = np.zeros(n, np.uint64)
    np.add.at(total, text, mix(hashes))
    return size, mix(total + size.astype(np.uint64)).view(np.int64)


def only(keep: np.ndarray, text: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets that are kept, numbered anew."""
    own = keep[text]
    return (np.cumsum(keep) - 1)[text[own]], hashes[own], size[keep]


def sketches(text: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> list[bytes]:
    """For each set: how many elements fall in each of 2^k equal parts of the universe, about two in one, counted up to 255."""
    parts = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(size, 1) / 2))).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(parts)])
    cell = first[text] + ((mix(hashes ^ np.uint64(0x5EED)) >> np.uint64(32)) * parts[text].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    counts = np.minimum(np.bincount(cell, minlength=first[-1]), 255).astype(np.uint8).tobytes()
    return [counts[i:j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]


def differ_by(x: bytes, y: bytes) -> int:
    """What two sets with these sketches differ by at least."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    n = min(len(a), len(b))
    a, b = (np.minimum(v.reshape(n, -1).sum(axis=1), 255) for v in (a, b))
    return int(np.abs(a - b).sum())


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (null without shingles), sketch, and tried: some signatures under each choice, as trials() has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in columns(batch, lower=True):
                text, hashes = sets(Words(data, bounds, WHITE))
                size, node = nodes_of(text, hashes, len(bounds) - 1)
                new = np.zeros(len(size), bool)
                new[np.unique(node, return_index=True)[1]] = True
                new &= size > 0
                owner, key = trials(*only(new, text, hashes, size))
                n = np.zeros(len(size), np.int64)
                n[new] = np.bincount(owner, minlength=int(new.sum()))
                ends = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                tried = pa.ListArray.from_arrays(ends, pa.array(key))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(rows.start, len(size)), pa.array(size.astype(np.int64)), pa.array(node, mask=size == 0), pa.array(sketches(text, hashes, size), pa.binary()), tried],
                    names=["doc_id", "n_shingles", "node", "sketch", "tried"],
                )

    return docs.mapInArrow(run, "doc_id long, n_shingles long, node long, sketch binary, tried array<long>")


Plan = tuple[np.ndarray, np.ndarray]
#: Bits of a trial's key that are its choice, and that are its band and choice.
CHOICE_BITS, LABEL_BITS = 4, 16


def trials(text: np.ndarray, hashes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Set and key of one in 2^SHARE_BITS signatures under each choice, by set. A key's low bits are the band and the choice."""
    band = np.searchsorted(bands(), np.maximum(size, 1), "right") - 1
    owners, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for choice in range(len(CHOICES)):
        for k in (0, 1):
            owner, entry, _, _ = signatures(text, hashes, size, k, plan(choice))
            own = np.flatnonzero(entry >> np.uint64(64 - SHARE_BITS) == 0)
            label = ((band[owner[own]] + k) << CHOICE_BITS | choice).astype(np.uint64)
            owners.append(owner[own])
            keys.append(((entry[own] >> np.uint64(LABEL_BITS) << np.uint64(LABEL_BITS)) | label).view(np.int64))
    owner, key = np.concatenate(owners), np.concatenate(keys)
    order = np.argsort(owner, kind="stable")
    return owner[order], key[order]


def allocated(sizes: DataFrame) -> Plan:
    """The plan whose choice for each band costs least: signatures sent, and pairs that meet in those that aren't frequent. sizes: node and tried of sized().

    The driver gets a row for each band and choice.
    """
    n = F.col("n")
    alike = sizes.select("node", F.explode("tried").alias("key")).distinct().groupBy("key").agg(F.count("*").alias("n"))
    meet = F.when(n <= FREQUENT, n * (n - 1) / 2).otherwise(n)
    label = F.col("key").bitwiseAND(F.lit((1 << LABEL_BITS) - 1)).alias("label")
    cost = {r["label"]: r["cost"] for r in alike.groupBy(label).agg(F.sum(n + PAIR_COST * meet).alias("cost")).collect()}
    loose, exact = (x.copy() for x in plan())
    for band in range(len(loose)):
        found = [cost.get(band << CHOICE_BITS | choice) for choice in range(len(CHOICES))]
        if None not in found:
            best = plan(int(np.argmin(found)))
            loose[band], exact[band] = best[0][band], best[1][band]
    return loose, exact


ONE_LESS, TWICE, NEXT_BAND = 1, 2, 4


def signatures(text: np.ndarray, hashes: np.ndarray, size: np.ndarray, k: int, allocation: Plan | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For sets as the smaller of a pair whose larger one is in the k-th band above: text, signature and flags of each entry; and each text's spare allowance."""
    loose, exact = allocation or plan()
    edges = np.array(bands())
    band = np.searchsorted(edges, np.maximum(size, 1), "right") - 1 + k
    ones, parts = loose[band], loose[band] + exact[band]
    slots = 2 * loose[band] + exact[band]
    offset = np.concatenate([[0], np.cumsum(parts)])
    scheme = mix(hashes ^ mix(band[text].astype(np.uint64) + np.uint64(17)))
    slot = ((scheme >> np.uint64(32)) * slots[text].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    part = np.where(slot < 2 * ones[text], slot >> 1, slot - ones[text])
    cell = offset[text] + part
    number = mix(hashes)
    total = np.zeros(offset[-1], np.uint64)
    np.add.at(total, cell, number)
    count = np.bincount(cell, minlength=offset[-1])
    owner = np.repeat(np.arange(len(size)), parts)
    place = np.arange(offset[-1]) - offset[owner]
    twice = place < ones[owner]
    name = mix((band[owner] * 1_000_003 + place).astype(np.uint64) + np.uint64(1 << 50))
    # The largest partner: up to size / 0.8, in this band; the pair's differences must stay below the allowance that is left.
    largest = np.minimum(size * 100 // PERCENT, edges[band + 1] - 1)
    need = (size + largest) * (100 - PERCENT) // (100 + PERCENT) + 1
    lost = np.bincount(owner, ((count == 0) | (twice & (count == 1))) * (1 + twice), minlength=len(size)).astype(np.int64)
    spare = slots - need - lost
    keeps_empty = spare < 0
    # A set that keeps its empty subsets may meet partners that leave theirs out only in other segments: it can spare none of those.
    spare = np.where(keeps_empty, 0, spare)
    own = np.flatnonzero((count > 0) | keeps_empty[owner])
    less = np.flatnonzero(twice[cell] & ((count[cell] > 1) | keeps_empty[text]))
    entry_text = np.concatenate([owner[own], text[less]])
    entry = np.concatenate([mix(total[own] + name[own]), mix(total[cell[less]] - number[less] + name[cell[less]])])
    flags = np.concatenate([twice[own] * TWICE, np.full(len(less), ONE_LESS | TWICE)]) | (NEXT_BAND * k)
    return entry_text, entry, flags.astype(np.uint8), spare


MET = "kind int, x long, y long, z long"
PAIR, STAR, LOST, SPARE, SHARED = range(5)


def met(docs: DataFrame, allocation: Plan) -> DataFrame:
    """What meets in signatures, as kind, x, y, z.

    PAIR and STAR: nodes x and y, the latter from a frequent signature. LOST: node x, band y, allowance z
    left out. SPARE: node x, band y, allowance z to spare. SHARED: signature x, band z and node y, for frequent ones.
    """
    groups = groups_for(docs)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Blobs(4)
        seen: set[int] = set()
        for batch in batches:
            for rows, data, bounds in columns(batch, lower=True):
                words = Words(data, bounds, WHITE)
                text, hashes = sets(words)
                size, node = nodes_of(text, hashes, len(bounds) - 1)
                new = np.zeros(len(size), bool)
                for i in np.flatnonzero(size).tolist():  # each set once for a part of the input
                    if (x := int(node[i])) not in seen:
                        seen.add(x)
                        new[i] = True
                if not new.any():
                    continue
                text, hashes, size = only(new, text, hashes, size)
                node = node[new]
                for k in (0, 1):
                    owner, entry, flags, spare = signatures(text, hashes, size, k, allocation)
                    group = ((entry >> np.uint64(40)) % np.uint64(groups)).astype(np.int64)
                    order = np.argsort(group, kind="stable")
                    owner, entry, flags, group = owner[order], entry[order], flags[order], group[order]
                    low, more, ids = entry.astype(np.uint32), (entry >> np.uint64(32)).astype(np.uint8), node[owner]
                    cuts = np.flatnonzero(np.diff(group, prepend=-1))
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(group)], strict=True):
                        out.add(int(group[a]), low[a:b].tobytes(), more[a:b].tobytes(), flags[a:b].tobytes(), ids[a:b].tobytes())
                    home = (mix(node.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
                    order = np.argsort(home, kind="stable")
                    cuts = np.flatnonzero(np.diff(home[order], prepend=-1))
                    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(home)], strict=True):
                        own = order[a:b]
                        out.add(-1 - int(home[own[0]]), spare[own].astype(np.int64).tobytes(), bytes([k]) * len(own), b"", node[own].tobytes())
                yield from out.flush(FLUSH_BYTES)
        yield from out.flush(0)

    def meet(group: pa.Table) -> pa.Table:
        ids = np.frombuffer(joined(group, "part3"), np.int64)
        first, second = joined(group, "part0"), np.frombuffer(joined(group, "part1"), np.uint8)
        if group.column("group")[0].as_py() < 0:
            return rows([np.full(len(ids), SPARE), ids, second.astype(np.int64), np.frombuffer(first, np.int64)])
        entry = np.frombuffer(first, np.uint32).astype(np.uint64) | (second.astype(np.uint64) << np.uint64(32))
        flags = np.frombuffer(joined(group, "part2"), np.uint8)
        order = np.lexsort((flags & ONE_LESS, ids, entry))
        entry, ids, flags = entry[order], ids[order], flags[order]
        once = np.ones(len(ids), bool)
        once[1:] = (entry[1:] != entry[:-1]) | (ids[1:] != ids[:-1])
        entry, ids, flags = entry[once], ids[once], flags[once]
        begin = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.empty(0, np.int64)
        n = np.diff(np.append(begin, len(entry)))
        out = []
        # Few sets: every two of them, but for two that both lack an element.
        for many in range(2, FREQUENT + 1):
            at = begin[n == many]
            for i in range(many):
                for j in range(i + 1, many):
                    fits = ~((flags[at + i] & flags[at + j] & ONE_LESS) > 0)
                    out.append(np.stack([ids[at + i][fits], ids[at + j][fits]], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0) if out else np.empty((0, 2), np.int64)
        big = np.repeat(n > FREQUENT, n)
        centre = np.repeat(ids[begin], n)[big]
        ids, flags, entry = ids[big], flags[big], entry[big]
        band = ((flags & NEXT_BAND) > 0).astype(np.int64)
        stars = np.unique(np.stack([centre, ids], axis=1)[centre != ids], axis=0)
        lost, back = np.unique(np.stack([ids, band], axis=1), axis=0, return_inverse=True)
        lost_n = np.bincount(back.ravel(), 1 + ((flags & TWICE) > 0), minlength=len(lost)).astype(np.int64)
        whole = (entry | (np.uint64(abs(hash(group.column("group")[0].as_py())) & 0x3FFFFF) << np.uint64(40))).view(np.int64)
        return rows(
            [np.full(len(pairs), PAIR), pairs[:, 0], pairs[:, 1], np.zeros(len(pairs), np.int64)], [np.full(len(stars), STAR), stars[:, 0], stars[:, 1], np.zeros(len(stars), np.int64)],
            [np.full(len(lost), LOST), lost[:, 0], lost[:, 1], lost_n], [np.full(len(ids), SHARED), whole, ids, band],
        )

    # As many partitions as groups, which aren't put together again: a task sorts and holds about one group.
    return docs.mapInArrow(emit, "group int, part0 binary, part1 binary, part2 binary, part3 binary").repartition(groups, "group").groupBy("group").applyInArrow(meet, MET)


def rows(*parts: list[np.ndarray]) -> pa.Table:
    cols = [np.concatenate([p[k] for p in parts]) for k in range(4)]
    return pa.table({"kind": pa.array(cols[0].astype(np.int32)), **{c: pa.array(v.astype(np.int64)) for c, v in zip("xyz", cols[1:], strict=True)}})


def shingled(docs: DataFrame) -> DataFrame:
    """node, shingles (sorted 64-bit numbers, as binary) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in columns(batch, lower=True):
                text, hashes = sets(Words(data, bounds, WHITE))
                size, node = nodes_of(text, hashes, len(bounds) - 1)
                ends = np.concatenate([[0], np.cumsum(size)])
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([raw[8 * a : 8 * b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())], names=["node", "shingles"])

    return docs.mapInArrow(run, "node long, shingles binary")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Of a, b those pairs that may link by their sizes and sketches; these never rule out a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy() for c in ("n", "m"))
            near = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
            most = (n + m) * (100 - PERCENT) // (100 + PERCENT)
            for i in np.flatnonzero(near).tolist():
                near[i] = differ_by(batch.column("s")[i].as_py(), batch.column("t")[i].as_py()) <= most[i]
            at = pa.array(np.flatnonzero(near))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    one = nodes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n"), F.col("sketch").alias("s"))
    two = nodes.select(F.col("node").alias("b"), F.col("n_shingles").alias("m"), F.col("sketch").alias("t"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "n", "m", "s", "t").mapInArrow(run, "a long, b long")


def linked(pairs: DataFrame, sets_of: DataFrame) -> DataFrame:
    """Of a, b those pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("s").to_pylist(), batch.column("t").to_pylist(), strict=True):
                total = (len(x) + len(y)) // 8
                both = np.concatenate([np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= PERCENT * (total - common))
            at = pa.array(np.flatnonzero(keep))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    small = sets_of.select(F.col("node").alias("b"), F.col("shingles").alias("t"))
    large = sets_of.select(F.col("node").alias("a"), F.col("shingles").alias("s"))
    return pairs.join(small, "b").join(large, "a").select("a", "b", "s", "t").mapInArrow(run, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, allocation: Plan) -> DataFrame:
    """a, b: links between nodes, enough to connect all that any links connect. nodes: node, doc_id, n_shingles, sketch."""
    found = written(met(docs, allocation))
    shared = found.where(F.col("kind") == SHARED).select(F.col("x").alias("signature"), F.col("y").alias("node"), F.col("z").alias("band"))
    lost = found.where(F.col("kind").isin(LOST, SPARE)).groupBy("x", "y").agg(F.coalesce(F.sum(F.when(F.col("kind") == LOST, F.col("z"))), F.lit(0)).alias("lost"), F.min(F.when(F.col("kind") == SPARE, F.col("z"))).alias("spare"))
    over = lost.where("lost > spare").select(F.col("x").alias("node"), F.col("y").alias("band"))
    own = written(shared.join(over, ["node", "band"]).select("signature", "node").distinct())
    pairs = written(possible(found.where(F.col("kind").isin(PAIR, STAR)).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), nodes))
    used = pairs.select(F.explode(F.array("a", "b")).alias("node")).union(own.select("node")).distinct()
    sets_of = written(shingled(docs.join(nodes.select("node", "doc_id").join(used, "node").select("doc_id"), "doc_id")))
    edges = written(linked(pairs, sets_of))
    for chosen in (True, False):
        if own.isEmpty():
            break
        roots = components(edges)
        placed = own.join(roots, "node", "left").select("signature", "node", F.coalesce("root", "node").alias("root"))
        open_ = placed.groupBy("signature").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("centre")).where("low < high").select("signature", "centre")
        own = written(placed.join(open_, "signature"))
        edges = written(edges.union(linked(unconnected(blocked(own, nodes), chosen), sets_of)))
        own = own.select("signature", "node")
    return edges


def blocked(shared: DataFrame, nodes: DataFrame) -> DataFrame:
    """centre, block, node, root, mask, n_signatures, n_shingles, sketch: the sets of each centre's group, dealt into blocks.

    shared: signature, centre (the least node with the signature), node, root. mask has a bit for each of the
    set's signatures; sets with no bit in common have no signature in common. All rows of a large component
    are in blocks without others.
    """
    bit = F.expr("shiftleft(1L, cast(pmod(xxhash64(signature), 64) as int))")
    members = shared.groupBy("centre", "node", "root").agg(F.bit_or(bit).alias("mask"), F.count("*").alias("n_signatures"))
    sizes = written(members.groupBy("centre", "root").agg(F.count("*").alias("n")))
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    large = salted(sizes.where(F.col("n") >= BLOCK).select("centre", "root", F.ceil(F.col("n") / BLOCK).alias("own")))
    pool = salted(sizes.where(F.col("n") < BLOCK).groupBy("centre").agg(F.sum("n").alias("n")).where(F.col("n") > BLOCK).select("centre", F.ceil(F.col("n") / BLOCK).alias("parts")))
    rows = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(large, ["centre", "root", "salt"], "left").join(pool, ["centre", "salt"], "left")
    alone = F.xxhash64("centre", "root", F.pmod(F.xxhash64("node", F.lit(1)), F.col("own")))
    block = F.when(F.col("own").isNotNull(), alone).otherwise(F.xxhash64("centre", F.pmod(F.xxhash64("root", F.lit(2)), F.coalesce("parts", F.lit(1)))))
    return written(rows.select("centre", block.alias("block"), "node", "root", "mask", "n_signatures").join(nodes.select("node", "n_shingles", "sketch"), "node"))


COMPARED = ["node", "root", "mask", "n_shingles", "sketch"]


def unconnected(members: DataFrame, chosen: bool) -> DataFrame:
    """a, b: of the sets of blocked() those pairs with a signature in common and different roots that may link by their sketches.

    With chosen, only pairs with one of the CENTRES sets of each group that have the most signatures.
    """
    blocks = members.groupBy("centre", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    if chosen:
        order = Window.partitionBy("centre").orderBy(F.desc("n_signatures"), "node")
        first = members.withColumn("place", F.row_number().over(order)).where(F.col("place") <= CENTRES).drop("place", "block")
        one = first.join(blocks.select("centre", "block"), "centre").withColumnRenamed("block", "task")
        two = members.withColumnRenamed("block", "task")
    else:
        other = blocks.select("centre", *(F.col(c).alias(f"{c}_") for c in ("block", "low", "high")))
        pairs = blocks.join(other, "centre").where("block <= block_ and not (low = high and low_ = high_ and low = low_)")
        pairs = written(pairs.select("block", "block_", F.xxhash64("block", "block_").alias("task")))
        one = members.join(pairs.select("block", "task"), "block")
        two = members.join(pairs.select(F.col("block_").alias("block"), "task"), "block")
    one = one.select("task", *COMPARED)
    two = two.select(F.col("task").alias("task_"), *(F.col(c).alias(f"{c}_") for c in COMPARED))
    return one.groupBy("task").cogroup(two.groupBy("task_")).applyInArrow(compared, "a long, b long").distinct()


class Folded:
    """Sketches as rows of one length, whichever is asked for."""

    def __init__(self, sketches_: list[bytes]):
        self.lens = np.array([len(x) for x in sketches_], np.int64)
        self.of = {n: (np.flatnonzero(self.lens == n), np.frombuffer(b"".join(x for x in sketches_ if len(x) == n), np.uint8).reshape(-1, n)) for n in np.unique(self.lens).tolist()}
        self.known: dict[int, np.ndarray] = {}

    def rows(self, n: int) -> np.ndarray:
        """All sketches of n or more parts in n parts; the rows of shorter ones are 0."""
        if n not in self.known:
            out = np.zeros((len(self.lens), n), np.int16)
            for size, (at, counts) in self.of.items():
                if size >= n:
                    out[at] = np.minimum(counts.reshape(len(at), n, -1).sum(axis=2, dtype=np.int64), 255)
            self.known[n] = out
        return self.known[n]


def compared(one: pa.Table, two: pa.Table) -> pa.Table:
    """a, b: the pairs of two blocks that may link and aren't connected."""
    two = two.rename_columns(one.column_names)
    id1, root1, n1, id2, root2, n2 = (t.column(c).to_numpy() for t in (one, two) for c in ("node", "root", "n_shingles"))
    mask1, mask2 = (t.column("mask").to_numpy() for t in (one, two))
    fold1, fold2 = (Folded(t.column("sketch").to_pylist()) for t in (one, two))
    found = [np.empty((2, 0), np.int64)]
    for i in range(len(id1)):
        near = (root2 != root1[i]) & ((mask2 & mask1[i]) != 0) & (100 * np.minimum(n2, n1[i]) >= PERCENT * np.maximum(n2, n1[i]))
        others = np.flatnonzero(near)
        for size in np.unique(np.minimum(fold2.lens[others], fold1.lens[i])).tolist():
            own = others[np.minimum(fold2.lens[others], fold1.lens[i]) == size]
            least = np.abs(fold2.rows(size)[own] - fold1.rows(size)[i]).sum(axis=1, dtype=np.int64)
            own = own[least <= (n2[own] + n1[i]) * (100 - PERCENT) // (100 + PERCENT)]
            found.append(np.stack([np.full(len(own), id1[i]), id2[own]]))
    pair = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1)
    return pa.table({"a": pa.array(pair[0]), "b": pa.array(pair[1])})


def near_copies(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to): a row for every document."""
    own = documents(docs)
    sizes = written(sized(own))
    nodes = written(sizes.where("node is not null").groupBy("node").agg(F.min_by(F.struct("doc_id", "n_shingles", "sketch"), "doc_id").alias("first")).select("node", "first.*"))
    roots = components(links(own, nodes, allocated(sizes)))
    named = nodes.join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    component = named.join(smallest, "root").select("node", "component_id")
    return sizes.select("doc_id", "n_shingles", "node").join(component, "node", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE doc_id IS NOT NULL
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS k FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.b) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.a GROUP BY r.a
"""
