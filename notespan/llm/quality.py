"""Quality classifier by co-training of two views.

One view is the text: shares of marks, digits, capitals, repeated lines and words, and which of the
telling words a text has, beginnings of words included. The other is metadata: source, language,
both together, and length in quarters of a power of two. For each of two questions (low quality,
toxic) each view has a logistic model. In rounds, each view labels those documents of an unlabelled
pool that it is surest of, for either answer in proportion to how frequent that is, and the other
view learns from them as well. Labelled documents that neither saw tell how far such labels are
better than chance, and the labels weigh accordingly; those no better than chance are not given.
The same documents then calibrate both views and weigh them against each other, and the combined
models score every document.

The models are fitted on at most LABELLED labelled documents and POOL others, taken by the hash of
doc_id; those come to the driver as packed features, and are fitted there as lists of the words that
each has. Telling words are the words whose presence tells labels apart best among the labelled ones that
aren't held out. Scoring is one pass over all documents, each a row
of its own. Null texts are empty, null metadata are values of their own, labels with nulls are left
out, and several labels of one document count as the worst of them. With no labels, or only one
kind, that question's chance is 0 and every document is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.llm.common import WHITE, Words, byte_numbers, column_or_null, columns, ids_of, mix, table
from notespan.llm.licences import BETWEEN

LABELLED, POOL = 15_000, 4_000
#: Bytes of the beginnings of words that count as words too.
BEGINNINGS = (4, 6)
#: Telling words, documents that one must occur in, and standard errors that it must tell apart by.
WORDS, LEAST_DOCUMENTS, LEAST_Z = 1024, 5, 3.5
#: Rounds of co-training, and labels that a view gives in the first; in later ones it gives twice as many, and so on.
ROUNDS, PER_ROUND = 2, 500
REJECT = 0.5
QUESTIONS = ["low", "toxic"]
#: Of the labelled documents, those whose id this divides are held out: they weigh pseudo-labels and calibrate, and nothing is fitted or counted on them.
HELD = 5

LINE_END = np.arange(256) == 10
MARKS = np.isin(np.arange(256), [*b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"])
PLAIN_MARKS = np.isin(np.arange(256), [*b".,'-"])
CLASSES = [MARKS & ~PLAIN_MARKS, np.isin(np.arange(256), [*b"|"]), (np.arange(256) >= 48) & (np.arange(256) <= 57), (np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) == 10]
STATS = len(CLASSES) + 5
#: Leading features of the text view that are numbers.
NUMBERS = STATS + 2 * len(QUESTIONS)
SOURCES, LANGS, BOTH, LENGTHS = 64, 16, 256, 96
META = SOURCES + LANGS + BOTH + LENGTHS


def terms(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of what may tell: each word, and the beginnings of longer words."""
    text, out = [words.text_of], [words.hash]
    lens, total, at = words.end - words.start, np.zeros(len(words), np.uint64), 0
    for n in BEGINNINGS:
        own = np.flatnonzero(lens > n)
        for k in range(at, n):
            fits = np.flatnonzero(lens > k)
            total[fits] += byte_numbers()[(k << 8) | words.data[words.start[fits] + k].astype(np.int64)]
        at = n
        text.append(words.text_of[own])
        out.append(mix(total[own] ^ np.uint64(0xBE61 * n)))
    return np.concatenate(text), np.concatenate(out)


def different(words: Words) -> np.ndarray:
    """How many different words each text has."""
    text, h = words.text_of, words.hash
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return np.bincount(text[new], minlength=len(words.bounds) - 1)


def text_features(data: np.ndarray, bounds: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text: STATS numbers, and which of the known words (sorted hashes) it has."""
    n = len(bounds) - 1
    size = np.maximum(np.diff(bounds), 1)
    words, lines = Words(data, bounds, WHITE), Words(data, bounds, LINE_END)
    total = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask[data])])[bounds])
    n_words, n_lines = np.diff(words.first), np.diff(lines.first)
    stats = [total(m) / size for m in CLASSES]
    stats += [different(words) / np.maximum(n_words, 1), different(lines) / np.maximum(n_lines, 1), np.log1p(n_words), np.log1p(n_lines), np.minimum(size / np.maximum(n_words, 1), 40) / 10]
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    letters = Words(low, bounds, BETWEEN)
    has = np.zeros((n, len(known)), bool)
    if len(known) and len(letters):
        text, h = terms(letters)
        at = np.searchsorted(known, h)
        at[at == len(known)] = 0
        hit = known[at] == h
        has[text[hit], at[hit]] = True
    return np.stack(stats, axis=1).astype(np.float32), has


@dataclass
class Features:
    """Rows of some numbers and of many columns that are 0 or 1: these as lists of the places that have a 1, sorted by row."""

    numbers: np.ndarray
    row: np.ndarray
    place: np.ndarray
    places: int

    @classmethod
    def of(cls, numbers: np.ndarray, has: np.ndarray) -> Features:
        row, place = np.nonzero(has)
        return cls(np.asarray(numbers, np.float32), row.astype(np.int32), place.astype(np.int32), has.shape[1])

    def __len__(self) -> int:
        return len(self.numbers)

    @property
    def width(self) -> int:
        return self.numbers.shape[1] + self.places

    def take(self, rows: np.ndarray) -> Features:
        first = np.searchsorted(self.row, np.arange(len(self) + 1))
        n = np.diff(first)[rows]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1][rows], n)
        return Features(self.numbers[rows], np.repeat(np.arange(len(rows), dtype=np.int32), n), self.place[at], self.places)

    def times(self, w: np.ndarray) -> np.ndarray:
        """For each row, its sum of w."""
        d = self.numbers.shape[1]
        return self.numbers @ w[:d] + np.bincount(self.row, w[d:][self.place], len(self)).astype(np.float32)

    def back(self, r: np.ndarray) -> np.ndarray:
        """For each column, its sum of r."""
        return np.concatenate([self.numbers.T @ r, np.bincount(self.place, r[self.row], self.places)]).astype(np.float32)


def view_of_text(stats: np.ndarray, has: np.ndarray, odds: np.ndarray) -> Features:
    """The text view: the numbers, for each question the largest and the sum of the log-odds of the words that a text has, and the words themselves."""
    out = Features.of(stats, has)
    own = []
    for o in odds:
        largest = np.zeros(len(stats), np.float32)
        if len(out.row):
            begin = np.flatnonzero(np.diff(out.row, prepend=-1))
            largest[out.row[begin]] = np.maximum(np.maximum.reduceat(o[out.place], begin), 0)
        own += [largest, np.bincount(out.row, np.maximum(o, 0)[out.place], len(stats))]
    out.numbers = np.concatenate([stats, np.minimum(np.stack(own, axis=1), 30)], axis=1).astype(np.float32)
    return out


def view_of_meta(meta: np.ndarray) -> Features:
    return Features.of(np.empty((len(meta), 0), np.float32), meta)


def meta_features(source: np.ndarray, lang: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One-hot: hashed source, hashed language, both, and the length's power of two in quarters."""
    n = len(source)
    out = np.zeros((n, META), bool)
    rows = np.arange(n)
    out[rows, source % SOURCES] = 1
    out[rows, SOURCES + lang % LANGS] = 1
    both = mix(source.astype(np.uint64) * np.uint64(1 << 20) + lang.astype(np.uint64))
    out[rows, SOURCES + LANGS + (both % np.uint64(BOTH)).astype(np.int64)] = 1
    out[rows, SOURCES + LANGS + BOTH + np.minimum(4 * np.log2(np.diff(bounds) + 1), LENGTHS - 1).astype(np.int64)] = 1
    return out


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, text, and hashes of source and language."""
    own = docs.where("doc_id is not null")
    hashed = lambda c: F.pmod(F.xxhash64(column_or_null(own, c, "string")), F.lit(1 << 20)).alias(c)
    return own.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), hashed("source"), hashed("lang"))


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float

    def logit(self, x: Features) -> np.ndarray:
        return x.times(self.weights) + self.bias


def fitted(x: Features, y: np.ndarray, ridge: float = 3e-4, steps: int = 200, weigh: np.ndarray | None = None) -> Logistic:
    """Logistic regression by accelerated gradient steps; without both answers, a constant. Rows weigh 1 if weigh isn't given."""
    if not len(y) or y.min() == y.max():
        return Logistic(np.zeros(x.width, np.float32), -20.0 if not len(y) or y.max() == 0 else 20.0)
    share = (np.ones(len(y)) if weigh is None else weigh).astype(np.float32)
    share /= share.sum()
    times = lambda w: x.times(w[:-1]) + w[-1]
    back = lambda r: np.append(x.back(r), r.sum()).astype(np.float32)
    v = np.ones(x.width + 1, np.float32)
    for _ in range(12):
        v = back(share * times(v))
        top = float(np.linalg.norm(v))
        v /= top
    w = np.zeros(x.width + 1, np.float32)
    ahead, rate = w.copy(), 1 / (0.27 * top + ridge)
    keep = np.append(np.full(x.width, ridge, np.float32), 0)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(times(ahead), -30, 30)))
        new = ahead - rate * (back(share * (p - y)) + keep * ahead)
        ahead = new + k / (k + 3) * (new - w)
        w = new
    return Logistic(w[:-1], float(w[-1]))


@dataclass
class View:
    """A view's models for one question: what its numbers are standardised by, and the model."""

    mean: np.ndarray
    scale: np.ndarray
    model: Logistic

    def logit(self, x: Features) -> np.ndarray:
        return np.clip(self.model.logit(replace(x, numbers=(x.numbers - self.mean) / self.scale)), -15, 15)


def view(x: Features, rows: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> View:
    """Fits the given rows; their numbers are standardised."""
    own = x.take(rows)
    mean, scale = np.zeros(own.numbers.shape[1], np.float32), np.ones(own.numbers.shape[1], np.float32)
    if len(own):
        mean, scale = own.numbers.mean(axis=0), own.numbers.std(axis=0) + np.float32(1e-4)
        own.numbers = (own.numbers - mean) / scale
    return View(mean, scale, fitted(own, y, weigh=weigh))


def plain(*columns: np.ndarray) -> Features:
    """Numbers alone."""
    return Features.of(np.stack(columns, axis=1), np.empty((len(columns[0]), 0), bool))


@dataclass
class Judge:
    """Both views of one question after co-training, and how to combine them. gave: labels that each view gave in each round."""

    text: View
    meta: View
    calibrate: list[Logistic]
    combine: Logistic
    gave: list[tuple[int, int]]

    def chances(self, text: Features, meta: Features) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated chances by text, by metadata, and by both."""
        own = [c.logit(plain(v.logit(x))) for v, x, c in zip((self.text, self.meta), (text, meta), self.calibrate, strict=True)]
        both = self.combine.logit(plain(*own))
        return tuple(1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (*own, both))


def surest(of_pool: np.ndarray, tested: np.ndarray, answers: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places in the pool, answers and weights of the labels that a view gives.

    of_pool: its logits of the pool. tested, answers: its logits of documents that it hasn't seen, and what they
    are. A label weighs by how much better than chance the view is among as large a share of those.
    """
    places, labels, weights = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    for answer in (0, 1):
        chance = float((answers == answer).mean()) if len(answers) else 0.0
        if not 0 < chance < 1:
            continue
        sign = 1 if answer else -1
        best = np.argsort(-sign * of_pool, kind="stable")[: max(1, round(n * chance))]
        top = np.argsort(-sign * tested, kind="stable")[: max(1, -(-len(tested) * len(best) // len(of_pool)))]
        right = (float((answers[top] == answer).sum()) + chance) / (len(top) + 1)
        if (better := (right - chance) / (1 - chance)) > 0:
            places.append(best)
            labels.append(np.full(len(best), answer))
            weights.append(np.full(len(best), better))
    return np.concatenate(places), np.concatenate(labels), np.concatenate(weights)


def co_trained(text: Features, meta: Features, y: np.ndarray, held: np.ndarray) -> Judge:
    """y: answers, with -1 for the pool. held: labelled rows that tell how good the views are, and calibrate them."""
    labelled, pool = np.flatnonzero((y >= 0) & ~held), np.flatnonzero(y < 0)
    unseen = np.flatnonzero((y >= 0) & held)
    given = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))] * 2  # rows, answers and weights that each view got from the other
    features, gave = (text, meta), []
    views: list[View] = []
    for turn in range(ROUNDS + 1):
        views = [view(x, np.concatenate([labelled, rows]), np.concatenate([y[labelled], labels]).astype(np.float32), np.concatenate([np.ones(len(labelled)), weights])) for x, (rows, labels, weights) in zip(features, given, strict=True)]
        if turn == ROUNDS or not len(pool):
            break
        told = [surest(v.logit(x.take(pool)), v.logit(x.take(unseen)), y[unseen], PER_ROUND * (turn + 1)) for v, x in zip(views, features, strict=True)]
        gave.append(tuple(len(rows) for rows, _, _ in told))
        given = [(pool[rows], labels, weights) for rows, labels, weights in reversed(told)]
    test = held & (y >= 0)
    if not test.any():
        test = y >= 0
    answers = y[test].astype(np.float32)
    tested = [v.logit(x.take(np.flatnonzero(test))) for v, x in zip(views, features, strict=True)]
    calibrate = [fitted(plain(z), answers) for z in tested]
    own = [np.clip(c.logit(plain(z)), -15, 15) for c, z in zip(calibrate, tested, strict=True)]
    return Judge(*views, calibrate, fitted(plain(*own), answers), gave)


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A bounded sample as rows_of with low and toxic: 0 or 1 for labelled documents, -1 for the pool."""
    own = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.min("quality") < 1).cast("int").alias("low"), (F.max("toxic") > 0).cast("int").alias("toxic"))
    ids = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"))
    by_hash = lambda df, n: df.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    some = by_hash(own.join(ids, "doc_id", "left_semi"), LABELLED)
    rest = by_hash(ids.join(own, "doc_id", "left_anti"), POOL).select("doc_id", F.lit(-1).alias("low"), F.lit(-1).alias("toxic"))
    return rows_of(docs).join(F.broadcast(some.union(rest)), "doc_id")


def telling_words(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the words whose presence tells the answers of a question apart best, and each question's log-odds of them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in columns(batch, lower=True):
                words = Words(data, bounds, BETWEEN)
                text, h = terms(words)
                order = np.lexsort((text, h))
                text, h = text[order], h[order]
                new = np.ones(len(h), bool)
                new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
                doc, (h, back) = text[new], np.unique(h[new], return_inverse=True)
                cols = [np.bincount(back.ravel(), ids_of(batch, part, q)[doc] if q else None, len(h)).astype(np.int64) for q in (None, *QUESTIONS)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, cols)], names=["word", "n", *QUESTIONS])

    known = rows.where("low >= 0")
    counts = known.mapInArrow(count, "word long, n long, low long, toxic long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n", *QUESTIONS))).where(F.col("n") >= LEAST_DOCUMENTS)
    all_ = known.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(q), F.lit(0)).alias(q) for q in QUESTIONS)).first()
    scores, tells = [], []
    for q in QUESTIONS:
        yes, no = F.col(q), F.col("n") - F.col(q)
        odds = F.log((yes + 0.5) / (all_[q] + 1.0)) - F.log((no + 0.5) / (all_["n"] - all_[q] + 1.0))
        tells.append(odds.alias(f"odds_{q}"))
        scores.append(F.abs(odds) / F.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5)))
    best = counts.select("word", *tells, F.greatest(*scores).alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "word").limit(WORDS).collect()
    words = np.array([r["word"] for r in best], np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], np.array([[r[f"odds_{q}"] for r in best] for q in QUESTIONS], np.float32).reshape(len(QUESTIONS), len(best))[:, order]


def trained(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, list[Judge]]:
    """The telling words, their log-odds, and a judge for each question."""
    rows = sample(docs, labels)
    known, odds = telling_words(rows.where(F.pmod("doc_id", F.lit(HELD)) != 0))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in columns(batch):
                stats, has = text_features(data, bounds, known)
                bits = np.packbits(has, axis=1)
                meta = meta_features(ids_of(batch, part, "source"), ids_of(batch, part, "lang"), bounds)
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("low"), own.column("toxic"), *(pa.array([r.tobytes() for r in x], pa.binary()) for x in (stats, bits, np.packbits(meta, axis=1)))], names=["doc_id", "low", "toxic", "stats", "has", "meta"])

    packed = rows.mapInArrow(pack, "doc_id long, low int, toxic int, stats binary, has binary, meta binary").orderBy("doc_id").collect()
    load = lambda name, kind: np.stack([np.frombuffer(r[name], kind) for r in packed]) if packed else np.empty((0, 0), kind)
    if not packed:
        text, meta = Features.of(np.empty((0, NUMBERS), np.float32), np.empty((0, len(known)), bool)), view_of_meta(np.empty((0, META), bool))
    else:
        has = np.unpackbits(load("has", np.uint8), axis=1)[:, : len(known)] if len(known) else np.empty((len(packed), 0), np.uint8)
        text = view_of_text(load("stats", np.float32), has, odds)
        meta = view_of_meta(np.unpackbits(load("meta", np.uint8), axis=1)[:, :META])
    held = np.array([r["doc_id"] % HELD == 0 for r in packed], bool)
    return known, odds, [co_trained(text, meta, np.array([r[q] for r in packed], np.int64), held) for q in QUESTIONS]


SCORED = "doc_id long, low double, toxic double, low_by_text double, low_by_meta double, toxic_by_text double, toxic_by_meta double, keep boolean"


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every document: its chances of being low in quality and toxic, by both views together and by each, and whether it is kept."""
    known, odds, judges = trained(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, bounds in columns(batch):
                stats, has = text_features(data, bounds, known)
                text = view_of_text(stats, has, odds)
                meta = view_of_meta(meta_features(ids_of(batch, part, "source"), ids_of(batch, part, "lang"), bounds))
                (lt, lm, low), (tt, tm, toxic) = (j.chances(text, meta) for j in judges)
                keep = (low < REJECT) & (toxic < REJECT)
                cols = [np.asarray(x, np.float64) for x in (low, toxic, lt, lm, tt, tm)]
                yield pa.RecordBatch.from_arrays([pa.array(ids_of(batch, part)), *map(pa.array, cols), pa.array(keep)], names=["doc_id", "low", "toxic", "low_by_text", "low_by_meta", "toxic_by_text", "toxic_by_meta", "keep"])

    return rows_of(docs).mapInArrow(score, SCORED)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
