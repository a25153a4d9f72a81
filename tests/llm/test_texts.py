"""Operators on single texts against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from notespan.llm import bpe, decontamination, licences, secrets
from tests.llm import fixtures as X

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def test_licences(spark):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    extra = [(1000, "Under the MIT license apache license, version 2.0; CC-BY-NC cc by nc under the mit"), (1001, licences.TEMPLATES[0][1]), (1002, "This work is licensed under the GNU General Public License, version 3.")]
    df = X.frame(spark).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in licences.labelled(df).collect()}
    for i, t in X.known() + extra:
        w = word.findall((t or "").translate(LOW))
        at = [(j, label) for p, label in licences.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split()]
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r["score"] <= 1
    assert got[1001]["labels"] == "mit" and got[1001]["score"] == 1 and got[1002]["labels"] == "gpl"
    assert licences.labelled(X.empty(spark)).count() == 0


def test_licence_phrases_of_any_length(spark):
    df = spark.createDataFrame([(1, "the mit license and isc, mit isc"), (2, "bsd")], "doc_id long, text string")
    got = {r["doc_id"]: [(p["label"], p["start"]) for p in r["places"]] for r in licences.scan(df, phrases={"mit license": "mit", "isc": "isc"}).collect()}
    assert sorted(got[1], key=lambda x: x[1]) == [("mit", 1), ("isc", 4), ("isc", 6)] and got[2] == []


def test_matching_statistics_and_chains(spark):
    """Matches against all runs of template words; a chain over a template that repeats a run."""
    r = random.Random(3)
    templates = [("a", "p q r s p q r t u v p q r w"), ("b", "x y z p q r x y z s t u")]
    own = licences.Licences(tuple(templates), (), licences.Rules())
    runs = {tuple(t.split()[i:j]) for _, t in templates for i in range(20) for j in range(i + 1, 20)}
    for _ in range(300):
        w = [r.choice("p q r s t u v w x y z k".split()) for _ in range(r.randint(0, 30))]
        want = set()
        longest = [max((n for n in range(i + 1) if tuple(w[i - n : i]) in runs), default=0) for i in range(len(w) + 1)]
        for i in range(1, len(w) + 1):
            if longest[i] >= 3 and (i == len(w) or longest[i + 1] <= longest[i]):
                want.add((i - longest[i], longest[i]))
        words = licences.words_of(" ".join(w))
        assert {(a, n) for _, start, numbers in own.runs(words) for a, n, _ in own.stream(start, numbers)[1]} == want
    df = spark.createDataFrame([(1, templates[0][1]), (2, "p q r s p q r gap t u v p q r w"), (3, "u v p q r w")], "doc_id long, text string")
    spans = {x["doc_id"]: {s["label"]: (s["start"], s["end"], round(s["share"], 3)) for s in x["spans"]} for x in licences.scan(df, templates=templates, phrases={}).collect()}
    assert spans[1]["a"] == (0, 14, 1.0) and spans[2]["a"] == (0, 15, 1.0) and spans[3]["a"][2] == round(6 / 14, 3)


def test_bpe_equals_the_library():
    mine, other = bpe.tokenizer(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())
    r = random.Random(2)
    letters = "abcdehrstABC019 \n\t\r\x0b'\"“é日本\x1c\x85\xa0　 !?..--__<>|😀́²½"
    odd = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(4000)]
    odd += [t or "" for t in X.texts()] + ["x <|endoftext|> y<|endoftext|>", "a" * 3000, "I'll can't 'S we've", "\n\n a"]
    odd += ["  <|endoftext|> <|endoftext|>\n", "<|endof", "text|> a", "don't 'tis ''s x'RE 1's", "a1b2 c3. d.e\nf\n\ng \nh", "y" * 60 + " " + "z7" * 40]
    raw = [t.encode() for t in odd]
    flat, counts = mine.encode_all(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
    ends = np.concatenate([[0], np.cumsum(counts)])
    for k, t in enumerate(odd):
        ids = mine.encode(t)
        assert flat[ends[k] : ends[k + 1]].tobytes() == ids
        assert np.frombuffer(ids, "<u4").tolist() == other.encode(t, add_special_tokens=False).ids
        assert mine.decode_bytes(ids).decode() == t


def test_bpe_takes_no_part_for_another(monkeypatch):
    monkeypatch.setattr(bpe, "fingerprints", lambda data, lens: (lens % 3).astype(np.uint64))
    mine, other = bpe.Tokenizer(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())
    text = "one two six ten " * 3 + "seven"
    assert np.frombuffer(mine.encode(text), "<u4").tolist() == other.encode(text, add_special_tokens=False).ids


def test_bpe_rows(spark):
    got = {r["doc_id"]: r for r in bpe.encoded(X.frame(spark), bpe.vocabulary()).collect()}
    assert len(got) == len(X.known())
    for i, t in X.known():
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(got[i]["ids"], "<u4").tobytes()).hexdigest() and got[i]["n_tokens"] == len(got[i]["ids"])
    back = bpe.decode(bpe.encode(X.frame(spark), bpe.vocabulary()), bpe.vocabulary())
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in X.known()}
    assert bpe.encoded(X.empty(spark), bpe.vocabulary()).count() == 0


def base_spans(t):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    return sorted(out + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32])


def test_secrets(spark):
    odd = ["token=token=abcdefgh12", "x 😀 token : 'ABCDEFGHij' AKIAABCDEFGHIJKL12 é " + "0af" * 20, 'token="short" token==........ secret: a', "AKIAAKIA" + "Z" * 9, "PassWord:abcdefgh secret='x'", "ſecret=abcdefghij"]
    pieces = ["token", "=", " ", '"', "secret:", "abcdefgh", "AKIA", "X1Y2Z3A4B5C6", "0123456789abcdef" * 2, "é", "\n"]
    r = random.Random(4)
    odd += ["".join(r.choice(pieces) for _ in range(r.randint(1, 25))) for _ in range(300)]
    extra = list(enumerate(odd, 2000))
    df = X.frame(spark).select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in secrets.digests(df).collect()}
    for i, t in X.known() + extra:
        spans, row = base_spans(t or ""), got[i]
        text = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest(), t
        assert [row[f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert set(filter(None, text.split(","))) <= set(row["spans"].split(","))
    assert secrets.digests(X.empty(spark)).count() == 0


def test_running_sums_of_any_length(spark):
    sizes = [0, 1, 2, 63, 64, 65, 66, 100, 1000, 5001]
    r = random.Random(1)
    given = [(k, [r.randint(0, 99) for _ in range(n)]) for k, n in enumerate(sizes)]
    rows = spark.createDataFrame(given, "k long, v array<long>").select("k", secrets.running(F.col("v")).alias("sums"), secrets.running(F.col("v"), F.greatest).alias("most")).collect()
    for row in rows:
        v = given[row["k"]][1]
        assert row["sums"] == list(itertools.accumulate(v)) and row["most"] == list(itertools.accumulate(v, max))


def test_secrets_of_long_texts_with_very_many_matches(spark):
    r = random.Random(5)
    code = lambda: "".join(r.choice("0123456789abcdef") for _ in range(32))
    docs = [(1, " ".join(f"é😀 {code()}" for _ in range(20_000))), (2, "x " * 9000 + code() + "é" * 9000), (3, code() + " y")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    began = time.time()
    got = {x["doc_id"]: x for x in secrets.digests(df).collect()}
    out = {x["doc_id"]: x["text"] for x in secrets.redacted(df).collect()}
    assert time.time() - began < 60
    for i, t in docs:
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base_spans(t)).encode()).hexdigest()
        assert out[i] == re.sub("[0-9a-f]{32,}", "[secret]", t)


def test_redaction_keeps_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "key 0123456789abcdef0123456789abcdef", 5, 6)], "doc_id long, text string, `a.b` int, `c``d` int")
    out = secrets.redacted(df)
    assert out.columns == df.columns and tuple(out.first()) == (1, "key [secret]", 5, 6)
    marks = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    assert tuple(decontamination.clean(df, marks).first()) == tuple(df.first())


def test_markov_finds_random_strings(spark):
    r = random.Random(1)
    key = lambda n, letters: "".join(r.choice(letters) for _ in range(n))
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = ["get", "user", "name", "list", "value", "from", "table", "index", "read", "write", "first", "last", "number", "of", "items"]
    docs = [(i, f"token = '{key(40, every)}' then " + " ".join("_".join(r.choice(names) for _ in range(5)) for _ in range(8))) for i in range(300)]
    docs += [(900, "see " + key(44, every) + " here"), (901, "call " + "_".join(names[:9]) + " here"), (902, None)]
    got = {x["doc_id"]: x["spans"] for x in secrets.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[900] == "markov:4:48" and got[901] == "" and got[902] == ""


def test_all_spans_by_brute_force(spark):
    r = random.Random(12)
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
    key = lambda n: "".join(r.choice(every) for _ in range(n))
    names = ["get", "user", "name", "list", "value", "from", "table", "index"]
    docs = [(i, f"é token = '{key(40)}' {key(r.randint(15, 60))} AKIA{'Q7WZ' * 4}/{key(30)} " + "_".join(r.choice(names) for _ in range(6)) + " " + "0af" * r.randint(9, 13)) for i in range(120)]
    df = spark.createDataFrame([*docs, (900, None), (901, "")], "doc_id long, text string")
    cells = [round(x, 5) for x in secrets.ratios(df)]
    got = {x["doc_id"]: x["spans"] for x in secrets.digests(df).collect()}
    found = 0
    for i, t in docs:
        spans = base_spans(t)
        bare = list(t)
        for a, _, b in spans:
            bare[a:b] = " " * (b - a)
        for m in re.finditer(secrets.TOKEN, "".join(bare)):
            ratio = sum(cells[ord(x) * 128 + ord(y)] for x, y in itertools.pairwise(m[0]))
            if ratio >= max(secrets.LEAST_TOTAL, secrets.LEAST_MEAN * (len(m[0]) - 1)):
                spans.append((m.start(), 3, m.end()))
                found += 1
        assert got[i] == ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans)), t
    assert found > 50 and got[900] == got[901] == ""


def test_filters_above_don_t_copy_spans(spark, monkeypatch):
    df = X.frame(spark).select("doc_id", "text")
    monkeypatch.setattr(secrets, "ratios", lambda *a: [0.1] * 128 * 128)
    size = lambda d: len(d._jdf.queryExecution().optimizedPlan().toString())
    masked = secrets.redacted(df)
    assert size(secrets.digests(df).where("spans != ''")) < 250_000 and size(masked.where("text like '%secret%'")) < 250_000
    assert size(secrets.digests(masked).where("n_assign > 0")) < 400_000
    want = sorted(r["doc_id"] for r in masked.collect() if r["text"] and "[secret]" in r["text"])
    assert sorted(r["doc_id"] for r in masked.where("text like '%[secret]%'").collect()) == want and want


@pytest.mark.parametrize("between", ["/", "+", "_", "-"])
def test_what_a_known_form_leaves_of_a_token_is_scanned(spark, between):
    r = random.Random(6)
    key = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    names = ["get", "user", "name", "list", "value", "from", "table", "index", "read", "write", "first", "last", "number", "of", "items"]
    docs = [(i, f"token = '{key(40)}' then " + " ".join("_".join(r.choice(names) for _ in range(5)) for _ in range(8))) for i in range(300)]
    access, secret, plain = "AKIA" + "Q7WZ" * 4, "x" + key(39), "_".join(names[:9])
    docs += [(900, f"é {access}{between}{secret} end"), (901, f"{secret}{between}{access}{between}{secret}"), (902, f"{access}{between}{plain} end")]
    got = {x["doc_id"]: x["text"] for x in secrets.redacted(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert not any(secret[1:] in got[i] for i in (900, 901)) and got[900].endswith(" end") and got[900].startswith("é ")
    assert got[902].endswith(plain + " end") and access not in got[902]


def test_redaction_keeps_rows_and_columns(spark):
    df = X.frame(spark)
    out = secrets.redacted(df)
    assert out.columns == df.columns
    by = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert out.count() == df.count()
    for i, t in X.known():
        want, at = "", 0
        for a, _, b in base_spans(t or ""):
            want, at = want + (t[at:a] + "[secret]" if a >= at else ""), max(at, b)
        if base_spans(t or ""):
            assert by[i]["text"] == want + t[at:]
        elif t is None or len(t) < 1000:
            assert by[i]["text"] == t


def test_decontamination(spark):
    item = [f"b{k}" for k in range(40)]
    items = [(1, " ".join(item)), (2, "Short one"), (3, None), (4, ""), (5, " ".join(item)), (6, " ".join(f"q{k}" for k in range(60)))]
    near = item[:]
    near[38] = "changed"
    long = [f"q{k}" for k in range(60)]
    long[30] = "other"
    docs = [(i, f"a c d {t} e f") for i, t in enumerate([" ".join(item).upper(), " ".join(near), " ".join(item[:20]), "short ONE", " ".join(item[::-1]), " ".join(long)], 3000)]
    df = X.frame(spark).select("doc_id", "text").union(spark.createDataFrame(docs, "doc_id long, text string"))
    marks = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 3), r["first_word"]) for r in decontamination.contained(df, marks).collect()}
    assert set(got) == {(3000, 1), (3000, 5), (3001, 1), (3001, 5), (3003, 2), (3005, 6)}
    assert got[3000, 1] == (1.0, 3) and 0.8 <= got[3001, 1][0] < 1 and got[3003, 2] == (1.0, 3) and got[3005, 6][0] >= 0.8
    assert decontamination.contained(df, marks.limit(0)).count() == 0 and decontamination.contained(X.empty(spark), marks).count() == 0
    assert decontamination.clean(df, marks).count() == df.count() - 4


def test_decontamination_is_the_same_in_any_number_of_passes(spark, monkeypatch):
    r = random.Random(9)
    shared = [[f"s{k}_{j}" for j in range(12)] for k in range(4)]
    items = [(i, " ".join([f"i{i}_{j}" for j in range(r.randint(8, 16))] + shared[i % 4] + shared[(i + 1) % 4][: r.randint(5, 12)])) for i in range(60)]
    docs = []
    for i, t in items:
        for k in range(6):
            w = t.split()
            for _ in range(r.choice([1, 1, 2])):  # new words, or passages of other items
                at = r.randrange(len(w))
                w[at : at + 5] = [f"n{k}"] * len(w[at : at + 5]) if r.random() < 0.3 else r.choice(shared)[: len(w[at : at + 5])]
            docs.append((100 * i + k, "a b " + " ".join(w) + " c d"))
    docs, marks = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontamination.contained(docs, marks).collect()))
    monkeypatch.setattr(decontamination, "PASS_BYTES", 2000)
    assert len(list(decontamination.passes(marks))) > 3
    assert sorted(map(tuple, decontamination.contained(docs, marks).collect())) == one and len(one) > 15


def weighted_similar(doc, items):
    """Item, first word and similarity of every window as long as an item that is similar to it."""
    shingled = lambda w: [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    spread = collections.Counter(s for _, t in items for s in set(shingled(t.lower().split())))
    weigh = lambda s: max(1, round(16 / math.sqrt(max(spread[s], 1))))
    total = lambda bag: sum(n * weigh(s) for s, n in bag.items())
    w, out = doc.lower().split(), []
    for item, t in items:
        other = t.lower().split()
        bag = collections.Counter(shingled(other))
        for i in range(len(w) - len(other) + 1):
            own = collections.Counter(shingled(w[i : i + len(other)]))
            both = total(own & bag)
            if both / (total(own) + total(bag) - both) >= 0.8 - 1e-12:
                out.append((item, i, both / (total(own) + total(bag) - both)))
    return out


@pytest.mark.parametrize("pass_bytes", [4 << 20, 1000])
def test_contained_equals_brute_force(spark, monkeypatch, pass_bytes):
    monkeypatch.setattr(decontamination, "PASS_BYTES", pass_bytes)
    r = random.Random(12)
    shared = [[f"s{k}_{j}" for j in range(10)] for k in range(3)]
    items = [(i, " ".join([f"i{i}_{j}" for j in range(r.randint(20, 60))] + r.choice(shared) * r.choice([0, 1, 1]))) for i in range(25)]
    docs = []
    for i in range(200):
        w = r.choice(items)[1].split()
        for _ in range(r.choice([0, 0, 1, 1, 2])):
            w[r.randrange(len(w))] = "new"
        docs.append((i, " ".join([f"d{k}" for k in range(r.randint(0, 9))] + w + ["end"] * r.randint(0, 4))))
    got = {(x["doc_id"], x["item_id"]): (x["similarity"], x["first_word"]) for x in decontamination.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, t in docs:
        for item, at, s in weighted_similar(t, items):
            want[d, item] = max(want.get((d, item), (0, 0)), (s, -at))
    want = {k: (s, -at) for k, (s, at) in want.items()}
    assert set(got) <= set(want) and len(set(want) - set(got)) <= 0.01 * len(want) and len(want) > 60
    assert all(got[k][0] == pytest.approx(want[k][0]) and got[k][1] == want[k][1] for k in got)


@pytest.mark.parametrize("bits", [0, 10, 25, 35])
def test_blocks_guarantee_the_radius(bits):
    r = np.random.default_rng(bits)
    items = decontamination.Items(list(range(50)), [" ".join(f"v{r.integers(0, 9999)}" for _ in range(30)) for _ in range(50)])
    prints = items.prints.copy()
    for row in prints:
        row[r.choice(decontamination.BITS, bits, replace=False)] ^= True
    found = set(items.near(prints, 30))
    assert {(k, k) for k in range(50)} <= found
