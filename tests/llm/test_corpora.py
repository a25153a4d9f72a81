"""Operators on whole corpora against brute force."""

import collections
import hashlib
import math
import random
import resource
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from notespan.llm import common, jaccard, lm, neighbours, quality, registry, substrings, token_counts
from notespan.llm.common import work_folder
from notespan.llm.components import components
from tests.compare import by_spark, by_sql
from tests.llm import fixtures as X

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert by_spark(registry.queries()[name](spark, SF)) == by_sql(registry.oracle_sql()[name], SF)


def removed(docs):
    seen, out = set(), {}
    for i, t in sorted(docs):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - 19):
            k = tuple(w[j : j + 20])
            if k in seen:
                gone[j : j + 20] = [True] * 20
            seen.add(k)
        out[i] = len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest()
    return out


def test_substrings(spark):
    r = random.Random(3)
    docs = X.known() + [(5000 + i, " ".join(r.choice("a b c".split()) for _ in range(r.choice([19, 20, 21, 60, 300])))) for i in range(60)]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.kept(spark.createDataFrame(docs, "doc_id long, text string"), texts=False).collect()}
    assert got == removed(docs)
    assert substrings.kept(X.empty(spark)).count() == 0


def test_hot_prefixes_and_forgotten_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "HOT", 3)
    monkeypatch.setattr(substrings, "SEEN", 5)
    r = random.Random(9)
    line = " ".join(f"common{k}" for k in range(24))
    docs = [(i, " ".join(r.choice("a b c d e f".split()) for _ in range(r.choice([0, 5, 30]))) + f" {line} " + " ".join(f"w{r.randint(0, 40)}" for _ in range(r.choice([3, 25])))) for i in range(90)]
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.kept(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), texts=False).collect()}
    assert got == removed(docs)


def long_words():
    """Documents that differ in words of over 64 bytes alone: other orders, repetitions and lengths of the same stretches."""
    a, b, c = ("abc"[k] * 64 for k in range(3))
    words = [a + b + b + a, b + a + a + b, a + b, b + a, a + a, a, a + "a", a + b + c, c + b + a, a + c + b, a * 15, a * 14 + b, b + a * 14, (a + b) * 7, (b + a) * 7, "a" * 1000, "a" * 999 + "b"]
    return [(9000 + i, " ".join(f"{w}{k}" if k == 3 else f"v{k}" for k in range(25)).replace("3", "")) for i, w in enumerate(words)]


def test_words_of_the_same_stretches_are_told_apart(spark):
    docs = long_words()
    assert len({t for _, t in docs}) == len(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.kept(df, texts=False).collect()} == removed(docs)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_copies(df).collect()} == linked(docs)
    c = collections.Counter(w for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2 for w in t.split())
    assert {r["doc_id"]: r["n_known"] for r in lm.scores(df).collect()} == {i: sum(c[w] > 0 for w in t.split()) + 1 for i, t in docs}


def test_fingerprints_differ_as_words_do():
    r, words = random.Random(7), set()
    for _ in range(4000):
        n = r.choice([1, 5, 63, 64, 65, 128, 129, 192, 300, 1000])
        words.add(b"".join(bytes([r.choice(b"ab")]) * min(64, n - k) for k in range(0, n, 64)))
    words = sorted(words)
    h = common.fingerprints(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words]))
    assert len(set(h.tolist())) == len(words)
    short = [w for w in words if len(w) <= 64]
    assert common.fingerprints(np.frombuffer(b"".join(short), np.uint8), np.array([len(w) for w in short])).tolist() == [x for x, w in zip(h.tolist(), words, strict=True) if len(w) <= 64]


def test_leaves_of_a_subtree():
    rng = np.random.default_rng(3)
    for many in (2, 3, 40_000):
        number = rng.integers(0, many, 600)
        number[300:340] = number[100:140]
        at, ties = np.arange(len(number) - substrings.WINDOW + 1), np.zeros(len(number) - substrings.WINDOW + 1, np.int64)
        order, depth = substrings.leaves(number, at, (at, ties))
        words = [number[i : i + substrings.WINDOW].tolist() for i in range(len(at))]
        wanted = sorted(range(len(at)), key=lambda i: (words[i], i))
        assert order.tolist() == wanted
        common = [next((k for k, (x, y) in enumerate(zip(words[a], words[b], strict=True)) if x != y), substrings.WINDOW) for a, b in zip(wanted, wanted[1:], strict=False)]
        assert depth.tolist() == [0, *common]
    order, depth = substrings.leaves(np.empty(0, np.int64), np.empty(0, np.int64), (np.empty(0, np.int64),))
    assert not len(order) and not len(depth)


def test_substrings_with_long_prefixes_and_seen_windows(spark, monkeypatch):
    monkeypatch.setattr(substrings, "FREQUENT", 1)
    monkeypatch.setattr(substrings, "VERY_FREQUENT", 3)
    group, docs = [f"p{k}" for k in range(45)], []
    for i in range(40):
        docs.append((i, " ".join([f"u{i}_{k}" for k in range(i % 7)] + group[i % 5 :] + [f"e{i}"])))
    got = {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in substrings.kept(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == removed(docs)


def linked(docs):
    sets = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[j : j + 5]) for j in range(len(w) - 4)])
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[:n]:
            m = len(sets[a] & sets[b])
            if 100 * m >= 80 * (len(sets[a]) + len(sets[b]) - m):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("frequent", [12, 2])
def test_near_copies(spark, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_copies(X.frame(spark)).collect()}
    assert got == linked(X.known())
    assert jaccard.near_copies(X.empty(spark)).count() == 0


@pytest.mark.parametrize(("frequent", "block"), [(12, 1024), (4, 16)])
def test_a_large_family(spark, monkeypatch, frequent, block):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(8)
    base, docs = [f"w{k}" for k in range(120)], []
    for i in range(150):
        w = base[:]
        for _ in range(r.choice([0, 1, 2, 3, 4, 6, 9])):
            w[r.randrange(len(w))] = f"z{r.randint(0, 99)}"
        docs.append((i, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_copies(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == linked(docs)


def test_blocks_leave_out_no_pair_and_stay_small(spark, monkeypatch):
    """A family just below the threshold with some links, and one large component."""
    monkeypatch.setattr(jaccard, "BLOCK", 32)
    r = np.random.default_rng(4)
    base = r.integers(0, 2**63, 60, dtype=np.uint64)
    sets = [np.unique(np.concatenate([r.choice(base, 60 - k % 9, replace=False), r.integers(0, 2**63, k % 9, dtype=np.uint64)])) for k in range(300)]
    roots = [5 if k % 3 == 0 else k for k in range(300)]
    signatures = [[100 + j for j in range(6) if (k >> j) & 1 or k % 5 == j] for k in range(300)]
    size = np.array([len(x) for x in sets])
    sketch = jaccard.sketches(np.repeat(np.arange(300), size), np.concatenate(sets), size)
    nodes = spark.createDataFrame([(k, int(size[k]), bytearray(sketch[k])) for k in range(300)], "node long, n_shingles long, sketch binary")
    shared = spark.createDataFrame([(s, 0, k, roots[k]) for k in range(300) for s in signatures[k]], "signature long, centre long, node long, root long")
    members = jaccard.blocked(shared, nodes)
    sizes = {x["block"]: (x["n"], x["roots"]) for x in members.groupBy("block").agg(F.count("*").alias("n"), F.collect_set("root").alias("roots")).collect()}
    assert max(n for n, _ in sizes.values()) <= 80 and all(x == [5] or 5 not in x for _, x in sizes.values()) and len(sizes) > 7
    got = {(x["a"], x["b"]) for x in jaccard.unconnected(members, False).collect()}
    must = {(a, b) for a in range(300) for b in range(a + 1, 300) if roots[a] != roots[b] and set(signatures[a]) & set(signatures[b]) and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))}
    assert must <= got and len(must) > 100
    assert {(x["a"], x["b"]) for x in jaccard.unconnected(members, True).collect()} <= got


@pytest.mark.parametrize(("common", "one", "other"), [(4, 0, 1), (8, 0, 2), (9, 1, 1), (12, 1, 2), (13, 0, 3), (16, 0, 4), (20, 1, 4)])
@pytest.mark.parametrize("choice", range(len(jaccard.CHOICES)))
def test_linked_sets_that_meet_in_frequent_signatures_only_are_both_compared_there(common, one, other, choice):
    r, n, edges = np.random.default_rng(0), 20_000, np.array(jaccard.bands())
    assert 100 * common >= 80 * (common + one + other)
    equal = r.integers(0, 2**63, (n, common), dtype=np.uint64)
    k = int(np.searchsorted(edges, common + other, "right") - np.searchsorted(edges, common + one, "right"))
    entries, spare = [], []
    for more, step in ((one, k), (other, 0)):
        s = np.concatenate([equal, r.integers(0, 2**63, (n, more), dtype=np.uint64)], axis=1)
        text, entry, flags, left = jaccard.signatures(np.repeat(np.arange(n), s.shape[1]), s.ravel(), np.full(n, s.shape[1]), step, jaccard.plan(choice))
        spare.append(left)
        entries.append({(t, e): 1 + bool(f & jaccard.TWICE) for t, e, f in zip(text.tolist(), entry.tolist(), flags.tolist(), strict=True)})
    both = entries[0].keys() & entries[1].keys()
    for own, left in zip(entries, spare, strict=True):
        lost = np.zeros(n, np.int64)
        for t, e in both:
            lost[t] += own[t, e]
        assert (lost > left).all()


@pytest.mark.parametrize("choice", range(len(jaccard.CHOICES)))
def test_near_copies_under_each_choice(spark, monkeypatch, choice):
    monkeypatch.setattr(jaccard, "allocated", lambda sizes: jaccard.plan(choice))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.near_copies(X.frame(spark)).collect()}
    assert got == linked(X.known())


def test_each_band_takes_the_cheapest_choice(spark):
    """Band 3: choice 0 has pairs that meet, choice 2 sends least, though a copy's keys come twice. Band 5 has no figures for a choice. Band 7: a frequent signature costs more than some sent."""
    key = lambda band, choice, number: number << jaccard.LABEL_BITS | band << jaccard.CHOICE_BITS | choice
    rows = [(n, [key(3, 0, 1), *(key(3, 1, 10 * n + j) for j in range(3)), *(key(3, 2, 10 * n + j) for j in range(2))]) for n in range(9)]
    rows += [rows[0], (50, [key(5, 0, 1), key(5, 2, 2)])]
    rows += [(n, [key(7, 0, 1), *(key(7, 1, 100 * n + j) for j in range(4)), *(key(7, 2, 100 * n + j) for j in range(9))]) for n in range(100, 100 + 2 * jaccard.FREQUENT)]
    got = jaccard.allocated(spark.createDataFrame(rows, "node long, tried array<long>"))
    want = [jaccard.STANDARD] * len(got[0])
    want[3], want[7] = 2, 1
    for k in (0, 1):
        assert got[k].tolist() == [int(jaccard.plan(c)[k][band]) for band, c in enumerate(want)]
    none = jaccard.allocated(spark.createDataFrame([], "node long, tried array<long>"))
    assert all((a == b).all() for a, b in zip(none, jaccard.plan(), strict=True))


def test_trials_are_the_signatures_of_each_choice():
    r = np.random.default_rng(5)
    sets = [np.unique(r.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 7, 40, 300, 300)]
    sets[4] = sets[3]
    size = np.array([len(x) for x in sets])
    owner, key = jaccard.trials(np.repeat(np.arange(5), size), np.concatenate(sets), size)
    assert (np.diff(owner) >= 0).all() and sorted(key[owner == 3]) == sorted(key[owner == 4]) and (owner == 3).any()
    assert set((key & (1 << jaccard.CHOICE_BITS) - 1).tolist()) == set(range(len(jaccard.CHOICES)))


def test_sketches_never_rule_out_a_link():
    r = np.random.default_rng(0)
    for n in (1, 5, 40, 300, 900):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: -max(1, n // 10)], r.integers(0, 2**63, n // 20 + 1, dtype=np.uint64)]))
        x, y = (jaccard.sketches(np.zeros(len(s), np.int64), s, np.array([len(s)]))[0] for s in (a, b))
        assert jaccard.differ_by(x, y) <= len(np.setxor1d(a, b))


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (300, 200), (5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_counts_and_base_scores(spark):
    docs = {i: (t or "").encode().lower().split() + [None] for i, t in X.known()}
    c = collections.Counter()
    for i, w in docs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            c.update(w)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm.scores(X.frame(spark)).collect()}
    assert set(got) == set(docs)
    for i, w in docs.items():
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w), sum(c[x] > 0 for x in w), n, zlib.crc32(str(i).encode()) % 7 == 2)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] < 0
    assert lm.scores(X.empty(spark)).count() == 0


def test_gradient_is_the_slope():
    net = lm.Network((lm.Network.start(np.random.default_rng(0).random(lm.SYMBOLS) * 100).flat * 3).astype(np.float32))
    r = np.random.default_rng(1)
    given = (r.integers(0, lm.SYMBOLS, (6, 3)), r.integers(0, lm.SYMBOLS, (6, 3)), np.zeros((6, 3), bool), np.ones((6, 3), bool), np.zeros((3, lm.HIDDEN), np.float32))
    given[2][0], given[2][3, 1], given[3][5, 2] = True, True, False
    slope = lm.Network(net.gradient(*given)[1])
    for name in lm.Network.SHAPES:
        own, at = getattr(net, name), np.unravel_index(np.abs(getattr(slope, name)).argmax(), getattr(slope, name).shape)
        kept, ends = own[at], []
        for e in (0.01, -0.01):
            own[at] = kept + e
            ends.append(net.gradient(*given)[0])
        own[at] = kept
        assert getattr(slope, name)[at] == pytest.approx((ends[0] - ends[1]) / 0.02, rel=0.02)


def test_probabilities_sum_to_one_and_windows_carry_the_state():
    net = lm.Network.start(np.random.default_rng(0).random(lm.SYMBOLS) * 100)
    states, _ = net.forward(np.array([[1], [5], [9]]), np.array([[True], [False], [False]]), np.zeros((1, lm.HIDDEN), np.float32))
    p = np.exp(net.log_probability(np.repeat(states[2], lm.SYMBOLS, axis=0), np.arange(lm.SYMBOLS)))
    assert p.sum() == pytest.approx(1, rel=1e-4)
    first, _ = net.forward(np.array([[1], [5]]), np.array([[True], [False]]), np.zeros((1, lm.HIDDEN), np.float32))
    rest, _ = net.forward(np.array([[9]]), np.array([[False]]), first[-1])
    assert np.allclose(rest[-1], states[-1])


def test_steps_of_training_use_the_memory_of_the_step_before():
    net = lm.Network.start(np.random.default_rng(0).random(lm.SYMBOLS) * 100)
    r = np.random.default_rng(1)
    place = (lm.TRAIN_WINDOW, lm.TRAIN_LANES)
    given = (r.integers(0, lm.SYMBOLS, place), r.integers(0, lm.SYMBOLS, place), r.random(place) < 0.01, np.ones(place, bool), np.zeros((lm.TRAIN_LANES, lm.HIDDEN), np.float32))
    for _ in range(3):
        net.gradient(*given)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(20):
        net.gradient(*given)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before < 20 * 60


def test_gates_at_both_ends():
    net = lm.Network.start(np.ones(lm.SYMBOLS))
    net.x[:, : 2 * lm.HIDDEN] = np.where(np.arange(2 * lm.HIDDEN) % 2, 500, -500)
    with np.errstate(divide="raise", over="raise", invalid="raise"):
        states, (_, gates, *_) = net.forward(np.array([[1], [5]]), np.zeros((2, 1), bool), np.full((1, lm.HIDDEN), 0.5, np.float32), keep=True)
    assert np.isfinite(states).all() and np.allclose(states[..., 1::2], 0.5) and set(gates.ravel().tolist()) == {0, 1}


def test_the_network_trains_on_every_learned_document_once(spark):
    dealt = [share.select("doc_id", "trainer").collect() for share in lm.shares(X.frame(spark).where("doc_id is not null"), 3)]
    given = [r["doc_id"] for rows in dealt for r in rows]
    assert len(dealt) == lm.ROUNDS and all({r["trainer"] for r in rows} == {0, 1, 2} for rows in dealt)
    assert sorted(given) == sorted(i for i, _ in X.known() if zlib.crc32(str(i).encode()) % 7 != 2)


def test_learned_scores_beat_counts_on_held_out(spark):
    r = random.Random(0)
    words = [[f"{c}{k}" for k in range(30)] for c in "abc"]
    docs = [(i, " ".join(r.choice(words[i % 3]) for _ in range(120))) for i in range(3000)]
    got = lm.scores(spark.createDataFrame(docs, "doc_id long, text string")).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert got[0] > got[1]


def test_scores_do_not_depend_on_how_the_input_is_split_and_beat_counts(spark, monkeypatch):
    monkeypatch.setattr(lm, "FAN_IN", 2)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    runs = [{r["doc_id"]: r for r in lm.scores(docs.repartition(n)).collect()} for n in (4, 64)]
    held = [i for i, r in runs[0].items() if r["held_out"]]
    assert sum(runs[0][i]["score"] for i in held) > 0.96 * sum(runs[0][i]["base_score"] for i in held)
    assert all(runs[1][i]["score"] == pytest.approx(r["score"], rel=1e-4) for i, r in runs[0].items())


def vectors(spark):
    r = np.random.default_rng(2)
    v = r.normal(size=(1500, 16)).astype(np.float32)
    v[700:900] = v[700]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [float("inf")] + [1.0] * 15), (5200, [1.0, 2.0]), (5250, [None] + [1.0] * 15), (5300, [])]
    return v, spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")


def test_neighbours(spark):
    v, df = vectors(spark)
    got = collections.defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    v = v.astype(np.float64)
    norm = np.sqrt((v * v).sum(axis=1))
    hit = 0
    assert set(got) == set(range(0, 1500, 50))
    for q, rows in got.items():
        s = (v * v[q]).sum(axis=1) / (norm * norm[q])
        s[q] = -2
        best = np.lexsort((np.arange(1500), -s))[:5]
        hit += len({i for i, _ in rows} & set(best.tolist()))
        assert all(x == pytest.approx(s[i], abs=1e-12) for i, x in rows) and len(rows) == 5
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0]))
    assert hit / (5 * len(got)) >= 0.9
    assert [i for i, _ in got[750]] == [700, 701, 702, 703, 704]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    few = df.where("vec_id < 3")
    assert [r["vec_id"] for r in neighbours.search(few, F.col("vec_id") == 0).collect()] and neighbours.search(few, F.col("vec_id") == 0).count() == 2


def test_rollup_commits_once(spark):
    rollup = token_counts.Rollup(spark, work_folder(spark))
    columns = "source string, lang string, tokenizer string, change string, before long, after long"
    change = lambda *rows: spark.createDataFrame(rows, columns)
    assert rollup.totals().count() == 0
    one = change(("a", "en", "v1", "insert", None, 5), ("a", "en", "v1", "insert", None, 7), (None, None, "v1", "insert", None, None))
    assert rollup.commit("1", one) and not rollup.commit("1", one)
    token_counts.deltas(change(("a", "en", "v1", "insert", None, 99))).write.parquet(f"{rollup.folder}/deltas/2")  # broke off before its marker
    assert rollup.commit("2", change(("a", "en", "v1", "delete", 5, None), ("a", "en", "v1", "revise", 7, 4), (None, None, "v1", "delete", None, None)))
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 4)]
    with pytest.raises(Exception, match="unknown change"):
        rollup.commit("3", change(("a", "en", "v1", "what", 1, 1)))
    assert rollup.committed() == ["1", "2"]
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 1, 4)]
    assert rollup.commit("4", change(("a", "en", "v1", "insert", None, 3))) and not rollup.commit("4", one)
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 2, 7)]


def test_quality_scores_by_brute_force(spark, monkeypatch):
    """Each document's chances worked out alone, word by word, from the fitted weights."""
    r = random.Random(15)
    docs = [(i, " ".join(r.choice(["fine", "plain", "Words!", "12", "awful", "awfully"] if i % 3 == 0 else ["fine", "plain", "Words!", "12"]) for _ in range(r.randint(0, 30))) + ("\n|x|\n|x|" if i % 4 == 0 else ""), "en" if i % 2 else None, f"s{i % 3}") for i in range(400)]
    df = spark.createDataFrame([*docs, (900, None, "de", "s1"), (901, "", None, None)], "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    model = quality.trained(df, labels)
    monkeypatch.setattr(quality, "trained", lambda *a: model)
    got = {x["doc_id"]: x for x in quality.scored(df, labels).collect()}
    known, odds, judges = model
    place = {int(h): k for k, h in enumerate(known)}
    hashes = {(x["doc_id"]): (x["source"], x["lang"]) for x in quality.rows_of(df).collect()}
    chance = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    cut = lambda z: max(-15.0, min(15.0, z))

    def term_hashes(word):
        data = np.frombuffer(word.lower().encode(), np.uint8)
        return quality.terms(common.Words(data, np.array([0, len(data)]), quality.BETWEEN))[1].tolist()

    for i, t, _, _ in [*docs, (900, "", None, None), (901, "", None, None)]:
        raw, words, lines = t.encode(), t.split(), [x for x in t.split("\n") if x]
        size = max(len(raw), 1)
        stats = [sum(c in b"!\"#$%&()*+/:;<=>?@[\\]^_`{|}~" for c in raw) / size, raw.count(b"|") / size, sum(48 <= c <= 57 for c in raw) / size, sum(65 <= c <= 90 for c in raw) / size, raw.count(b"\n") / size]
        stats += [len(set(words)) / max(len(words), 1), len(set(lines)) / max(len(lines), 1), math.log1p(len(words)), math.log1p(len(lines)), min(size / max(len(words), 1), 40) / 10]
        has = sorted({place[h] for w in re.findall("[a-z0-9]+", t.lower()) for h in term_hashes(w) if h in place})
        for o in odds:
            stats += [min(max([0.0, *(float(o[k]) for k in has)]), 30), min(sum(max(float(o[k]), 0) for k in has), 30)]
        source, lang = hashes[i]
        meta = quality.meta_features(np.array([source]), np.array([lang]), np.array([0, len(raw)]))[0]
        for name, j in zip(("low", "toxic"), judges, strict=True):
            x = (np.array(stats, np.float64) - j.text.mean) / j.text.scale
            text = cut(float(x @ j.text.model.weights[: len(x)]) + sum(float(j.text.model.weights[len(x) + k]) for k in has) + j.text.model.bias)
            other = cut(float(j.meta.model.weights[meta].sum()) + j.meta.model.bias)
            own = [c.logit(quality.plain(np.array([z])))[0] for c, z in zip(j.calibrate, (text, other), strict=True)]
            both = float(j.combine.logit(quality.plain(*(np.array([z]) for z in own)))[0])
            assert got[i][name] == pytest.approx(chance(both), abs=2e-3), (i, name)
        assert got[i]["keep"] == (got[i]["low"] < 0.5 and got[i]["toxic"] < 0.5)


def test_a_batch_committed_while_others_are_summed_up_counts_once(spark, monkeypatch):
    rollup = token_counts.Rollup(spark, work_folder(spark))
    rows = spark.createDataFrame([("a", "en", "v1", "insert", None, 5)], "source string, lang string, tokenizer string, change string, before long, after long")
    assert rollup.commit("1", rows)
    plain = rollup._markers

    def late():
        found = plain()
        monkeypatch.setattr(rollup, "_markers", plain)
        assert rollup.commit("2", rows)
        return found

    monkeypatch.setattr(rollup, "_markers", late)
    rollup.compact()
    assert rollup.committed() == ["1", "2"] and [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 2, 10)]
    rollup.compact()
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "v1", 2, 10)]


def test_quality_counts_no_word_of_held_out_documents(spark):
    """Words that only held-out documents have are no features: these tell perfectly, so they would be if they were counted."""
    docs = [(i, "bad word" if i % 2 else "good word", "en", "s") for i in range(1000)]
    seen = [d if d[0] % quality.HELD else (d[0], f"secret{d[0] % 2} {d[1]}", "en", "s") for d in docs]
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(1000)], "doc_id long, quality int, toxic int")
    known = [quality.trained(spark.createDataFrame(x, "doc_id long, text string, lang string, source string"), labels)[0].tolist() for x in (docs, seen)]
    assert known[0] == known[1] and len(known[0])


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = quality.scored(docs, labels.where("doc_id % 2 = 0")).withColumnRenamed("toxic", "p").join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    bad = (got["quality"] == 0) | (got["toxic"] == 1)
    assert got["keep"][~bad].mean() > 0.98
    assert (~got["keep"][got["quality"] == 0]).mean() > 0.95
    assert (~got["keep"][got["toxic"] == 1]).mean() > 0.85


def test_both_views_give_labels_that_help_the_other(spark):
    """Half of the words and half of the sources tell; labelled are too few for the text view alone to know all words."""
    r = random.Random(3)
    docs, labels, truth = [], [], {}
    for i in range(6000):
        bad = i % 4 == 0
        sure = r.random() < 0.7
        source = f"s{r.randint(0, 9) + (10 if bad else 0)}" if sure else f"s{r.randint(20, 29)}"
        words = [f"{'b' if bad else 'g'}{r.randint(0, 12)}" for _ in range(2)] if r.random() < 0.8 else []
        docs.append((i, " ".join(words + [f"n{r.randint(0, 300)}" for _ in range(20)]), "en", source))
        truth[i] = bad
        if i < 1500:
            labels.append((i, 0 if bad else 1, 0))
    df, marks = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    judge = quality.trained(df, marks)[2][0]
    assert len(judge.gave) == quality.ROUNDS and all(a > 0 and b > 0 for a, b in judge.gave)
    assert all((judge.combine.weights > 0).tolist())
    got = {x["doc_id"]: x for x in quality.scored(df, marks).collect()}
    right = lambda c: sum((got[i][c] >= 0.5) == truth[i] for i in range(1500, 6000)) / 4500
    assert right("low") > max(right("low_by_text"), right("low_by_meta")) and right("low") > 0.93


def test_labels_of_a_view_that_knows_nothing_are_not_given():
    r = np.random.default_rng(0)
    answers = np.arange(400) % 2
    assert len(quality.surest(r.normal(size=1000), np.where(answers == 1, -1.0, 1.0), answers, 100)[0]) == 0
    rows, labels, weights = quality.surest(np.arange(1000.0), np.where(answers == 1, 1.0, -1.0), answers, 100)
    assert sorted(rows.tolist()) == [*range(50), *range(950, 1000)] and (labels == (rows >= 500)).all() and (weights > 0.9).all()


def test_quality_keeps_rare_telling_words(spark):
    rare = 600
    marked = [f"q{k:03d}" for k in range(rare)] * 12
    docs = [(i, f"p{i % 400} p{i % 399}", 0, 0) for i in range(12_000)] + [(20_000 + i, " ".join(marked[i : i + 6]), 0, 1) for i in range(0, len(marked), 6)]
    known, odds = quality.telling_words(spark.createDataFrame(docs, "doc_id long, text string, low int, toxic int"))
    assert len(known) >= rare and (odds[1] > 0).sum() >= rare


def test_features_by_places_are_those_of_a_matrix():
    r = np.random.default_rng(0)
    numbers, has = r.normal(size=(50, 3)).astype(np.float32), r.random((50, 20)) < 0.1
    has[7] = False
    x, dense = quality.Features.of(numbers, has), np.concatenate([numbers, has], axis=1)
    w, y, rows = r.normal(size=23), r.normal(size=50), r.permutation(50)[:30]
    assert np.allclose(x.times(w), dense @ w, atol=1e-5) and np.allclose(x.back(y), dense.T @ y, atol=1e-5)
    assert np.allclose(x.take(rows).times(w), dense[rows] @ w, atol=1e-5)


def test_quality_without_labels_keeps_all(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.scored(X.frame(spark), labels).collect()
    assert len(got) == len(X.known()) and all(r["keep"] for r in got)
    odd = spark.createDataFrame([(1, None, 0), (2, 0, None), (3, 1, 0), (3, 0, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.scored(X.frame(spark), odd).count() == len(X.known())
    assert quality.scored(X.empty(spark), labels).count() == 0
