"""Toxicity by held-out accuracy, the filter audit by brute force, whitening by a dense eigendecomposition."""

import itertools
import re
import zlib

import numpy as np
import pytest

from notespan.llm import filter_audit, toxicity, whitening
from tests.llm import fixtures as X

SF = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def part_of(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3


@pytest.fixture(scope="module")
def scored(spark):
    return toxicity.op11_toxicity(spark, SF).persist()


def test_toxic_documents_that_were_held_out(spark, scored):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = scored.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == (part_of(r["doc_id"]) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    held = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert sum(toxic) >= 0.7 * len(toxic) and sum(clean) <= 0.06 * len(clean)  # few labels here: 34 toxic ones to learn from


def test_labels_that_are_held_out_and_metadata_change_no_score(spark):
    docs = spark.createDataFrame([(i, f"plain words {i % 7} here" + (" awful" if i % 4 == 0 else ""), "en" if i % 2 else "de", f"s{i % 3}") for i in range(300)], "doc_id long, text string, lang string, source string")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(300)]
    got = {r["doc_id"]: r for r in toxicity.scored(docs, spark.createDataFrame(labels, LABELS)).collect()}
    assert all(got[i]["predicted"] == (i % 4 == 0) for i in range(300))
    turned = [(i, q, 1 - t if part_of(i) == 1 else t) for i, q, t in labels]
    other = docs.select("doc_id", "text", docs.lang.alias("source"), docs.source.alias("lang"))
    again = {r["doc_id"]: r["score"] for r in toxicity.scored(other, spark.createDataFrame(turned, LABELS)).collect()}
    assert again == {i: r["score"] for i, r in got.items()}


def test_toxicity_learns_from_all_labels_and_calibrates_on_all(spark):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "concat('plain ', id % 7) AS text", "'en' AS lang")
    rows = toxicity.learned(docs, docs.selectExpr("doc_id", "1 AS quality", "CAST(doc_id % 4 = 0 AS INT) AS toxic"))
    assert {r["doc_id"] for r in rows.select("doc_id").collect()} == {i for i in range(20_000) if part_of(i) != 1}
    random = np.random.default_rng(3)
    z, y = random.normal(0, 3, 5000), random.random(5000) < 0.3
    bins = toxicity.as_arrays(toxicity.binned(spark.createDataFrame([("en", int(b), float(a)) for a, b in zip(z, y, strict=True)], "lang string, toxic int, z double")).toArrow())
    f1 = lambda cut: 2 * (y & (z >= cut)).sum() / ((z >= cut).sum() + y.sum())
    assert bins[2].sum() == (~y).sum() and bins[3].sum() == y.sum()
    assert f1(toxicity.best_cut(*bins)) >= max(map(f1, z)) - 1e-3


def test_nets_of_many_trainers_are_averaged(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 500)
    docs = spark.range(600).selectExpr("id AS doc_id", "concat('plain words ', id % 7, if(id % 4 = 0, ' awful', '')) AS text", "'en' AS lang")
    labels = docs.selectExpr("doc_id", "1 AS quality", "CAST(doc_id % 4 = 0 AS INT) AS toxic")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs, labels).collect()}
    assert got == {i: int(i % 4 == 0) for i in range(600)}


def test_toxicity_of_odd_rows(spark):
    docs = X.frame(spark)
    twice = docs.union(docs.limit(5))
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)] + [(3, None, None), (3, 1, 1), (None, 1, 1), (10**9, 0, 1)], LABELS)
    got = toxicity.scored(twice, labels).collect()
    assert len(got) == twice.where("doc_id is not null").count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["score"] for r in toxicity.scored(docs, labels.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in toxicity.scored(docs, spark.createDataFrame([(i, 1, 1) for i in range(9)], LABELS)).collect()} == {1.0}
    assert toxicity.scored(X.empty(spark), labels).count() == 0


def test_gradient_of_the_network():
    random = np.random.default_rng(3)
    tells = np.zeros(toxicity.CELLS, np.float32)
    rows, begin = toxicity.laid_out(random.integers(0, 50, (12, 4)), np.array([0, 5, 5, 12]))
    y = np.array([1.0, 0.0, 1.0], np.float32)

    def net():
        n = toxicity.Net.start(tells, 0.3)
        n.table = n.table.astype(np.float64) * 20
        n.filters, n.biases, n.out = [f.astype(np.float64) for f in n.filters], n.biases.astype(np.float64), n.out.astype(np.float64)
        return n

    def loss(n):
        z = n.logit(rows, begin)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    trainer = toxicity.Trainer(net())
    trainer.seen = [np.full(p.shape, 1e12, np.float64) for p in trainer.net.parts()]  # so large that a step is the gradient times RATE / 1e6
    trainer.step(rows, begin, y)
    for part, places in ((0, [(int(rows[0, 0]), 0), (int(rows[1, 2]), 3)]), (2, [(0, 0, 0), (1, 0, 0)]), (5, [0, 8])):
        for at in places:
            a, b = net(), net()
            for n, by in ((a, 1e-5), (b, -1e-5)):
                n.parts()[part][at] += by
            slope = (loss(a) - loss(b)) / (a.parts()[part][at] - b.parts()[part][at])
            moved = float(net().parts()[part][at]) - float(trainer.net.parts()[part][at])
            assert moved * 1e6 / toxicity.RATE == pytest.approx(slope, rel=2e-2, abs=1e-4)


def audited(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least, masks, out = {}, {}, {}
    rows = [(i, s or "", t or "") for i, t, _, s, *_ in rows if i is not None]
    for i, _, t in rows:
        least[t] = min(i, least.get(t, i))
    for i, s, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), least[t] < i]
        masks.setdefault(s, []).append(({f for f, x in zip("ABCDE", fails, strict=True) if x}, i in good, i in toxic))
    for s, docs in masks.items():
        shapley = dict.fromkeys("ABCDE", 0)
        for o in itertools.permutations("ABCDE"):
            for k, f in enumerate(o):
                before = set(o[:k])
                gone = [d for d in docs if f in d[0] and not d[0] & before]
                shapley[f] += len(gone)
                out[s, "".join(o), k + 1] = [sum(not d[0] & (before | {f}) for d in docs), len(gone), sum(f in d[0] and bool(d[0] & before) for d in docs), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)]
        for o in itertools.permutations("ABCDE"):
            for k, f in enumerate(o):
                out[s, "".join(o), k + 1].append(shapley[f])
    return out


def test_filter_audit(spark, monkeypatch):
    rows = X.rows() + [(700 + i, "Copy " * 250, "en", "src0", None, *"nkswb") for i in range(300)] + [(5, "another text of one id", "en", "src1", None, *"nkswb"), (5, "another text of one id", "en", "src1", None, *"nkswb")]
    labels = [(i, i % 2, int(i % 7 == 0)) for i in range(0, 900, 2)] + [(4, 0, 1), (None, 1, 1), (6, None, None)]
    docs, marks = spark.createDataFrame(rows, X.CLASHING), spark.createDataFrame(labels, LABELS)
    run = lambda: {(r[0], r[1], r[2]): list(r)[3:] for r in filter_audit.by_order(filter_audit.mask_counts(filter_audit.flagged(docs, marks))).collect()}
    want = audited(rows, labels)
    assert run() == want
    monkeypatch.setattr(filter_audit, "BLOCK_DOCUMENTS", 20)
    monkeypatch.setattr(filter_audit, "BROADCAST_BYTES", 0)
    assert run() == want
    nothing = filter_audit.by_order(filter_audit.mask_counts(filter_audit.flagged(X.empty(spark), marks)))
    assert nothing.count() == 0


def test_unique_texts_are_cleared_before_the_shuffle(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(3000)] + [(5000 + i, f"text {i}") for i in range(50)], "doc_id long, text string")
    maybe = {r["doc_id"] for r in filter_audit.possible_repeats(filter_audit.narrow(docs)).select("doc_id").collect()}
    assert maybe >= {*range(50), *range(5000, 5050)} and len(maybe) < 300


def test_mask_counts_add_up(spark):
    docs, marks = X.frame(spark), spark.createDataFrame([], LABELS)
    rows = filter_audit.flagged(docs, marks).persist()
    halves = [filter_audit.mask_counts(rows.where(f"doc_id % 2 = {k}")) for k in (0, 1)]
    total = halves[0].union(halves[1])
    assert sorted(map(tuple, filter_audit.by_order(total).collect())) == sorted(map(tuple, filter_audit.by_order(filter_audit.mask_counts(rows)).collect()))


def dense(vectors, components=16):
    x = np.floor(64 * np.asarray(vectors, np.float64)) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, parts = np.linalg.eigh(np.cov(fit.T, bias=True).reshape(x.shape[1], -1))
    values, parts = values[::-1], parts[:, ::-1]
    k = min(components, int((values > 1e-9 * values[0]).sum()))
    return (x - s / n) @ parts[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), ((n * x - s) ** 2).sum(axis=1), n


def whitened_table(rows):
    ids = sorted({r["vec_id"] for r in rows})
    k = max(r["component"] for r in rows)
    got = {(r["vec_id"], r["component"]): r for r in rows}
    return ids, np.array([[got[i, c]["whitened"] for c in range(1, k + 1)] for i in ids]), got


def test_whitening(spark):
    random = np.random.default_rng(2)
    vectors = (random.standard_normal((400, 20)) @ random.standard_normal((20, 20))).astype(np.float32)
    vectors[100:200] = vectors[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)] + [(900, None), (901, [float("nan")] * 20), (902, [None] * 20), (903, [float("inf")] * 20), (904, [1.0]), (905, [])]
    got = whitening.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(7)).collect()
    want, explained, far, n = dense(vectors)
    ids, own, of = whitened_table(got)
    assert ids == list(range(400)) and own.shape == want.shape
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-9
    assert all(of[i, 1]["deviation"] == int(far[i]) and of[i, 1]["n"] == n for i in ids)
    assert [of[0, c + 1]["explained"] for c in range(16)] == pytest.approx(list(explained), rel=1e-9)
    assert got[0]["identity_error"] < 1e-9


def test_whitening_of_few_directions_and_of_nothing(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, component string, n string")
    line = [(i, [i / 2.0, i / 2.0, 0.0], "c", "n") for i in range(9)] + [(3, [1.5, 1.5, 0.0], "c", "n")]
    got = whitening.whitened(frame(line)).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 10 and got[0]["explained"] == pytest.approx(1.0)
    square = [(i, [float(a), float(b), 0.0], "c", "n") for i, (a, b) in enumerate([(1, 0), (-1, 0), (0, 1), (0, -1)])]  # one variance twice
    own = whitening.whitened(frame(square)).collect()
    assert {r["component"] for r in own} == {1, 2} and own[0]["identity_error"] < 1e-9
    for rows in ([], [(1, [2.0, 3.0, 4.0], "c", "n")] * 3, [(1, None, "c", "n")]):
        assert whitening.whitened(frame(rows)).count() == 0
    huge = whitening.whitened(frame([(1, [1e300, 0.0], "c", "n"), (2, [-1e300, 1.0], "c", "n")])).collect()
    assert {r["deviation"] for r in huge} == {None}


def test_long_vectors_stop_when_components_have_settled(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FULL", 10)
    random = np.random.default_rng(4)
    vectors = random.standard_normal((300, 60)) * 0.9 ** np.arange(60) * 20
    got = whitening.whitened(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>"), 3).collect()
    want, *_ = dense(vectors, 3)
    _, own, _ = whitened_table(got)
    assert np.abs(own * np.sign((own * want).sum(axis=0)) - want).max() < 1e-8
