"""Toxicity by a convolutional text classifier: hashed word embeddings, filters over one, two and three words, max pooling.

A word's vector is the sum of the rows of one table that the word and its beginnings (of BEGINNINGS
bytes) hash to, so compounds share what their beginning says. A text's vectors run through filters of
each width; each filter's largest value over the whole text goes through one logistic output. Only
letters, any case, count as words. A score depends on nothing but the text.

The model is fitted on all labelled documents of the stated split, each whole. One part in five of
them, by the hash of doc_id, calibrates and is seen by nothing else. The table starts from how each cell
tells the labels apart in all the others, counted by Spark. Then a task for every TRAIN_BYTES of them, dealt
by hash, goes through its documents in numpy, and the weights are averaged, ROUNDS times, FAN_IN at a time:
the driver holds a few copies of the weights, of a fixed size.

Calibration turns the output into a chance of which REJECT (0.7) is the best cut for all languages
together. Each language with enough labels has a cut of its own, with `threshold` and `flagged` beside
the score; the score doesn't depend on it. Cuts come from counts of all outputs in bins of 1 / BINS, so
what is gathered doesn't grow with the documents.

Null texts are empty, and empty texts have a score as well; a null language is one of its own. Several
labels of one document count as toxic if one of them is; null labels are left out. Without labels of
both kinds the score is the share of toxic ones, or 0. Rows that repeat a doc_id are each scored;
rows without doc_id have no place in the result. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.llm.common import Words, byte_numbers, column_or_null, columns, ids_of, mix, table, written
from notespan.llm.licences import BETWEEN

#: Bytes of the beginnings of words that have vectors as well.
BEGINNINGS = (4, 6, 8)
#: Rows of the table of vectors, numbers in one, filters of each width, widths.
CELLS, SIZE, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
OFFSETS = sum(WIDTHS)
#: Bytes of texts for each of the tasks that train side by side, rounds after each of which they are averaged, times that each document is met in a round, documents of a step, and the rate.
TRAIN_BYTES, ROUNDS, TIMES, STEP, RATE = 16 << 20, 4, 2, 16, 0.03
#: Models that are averaged at a time, and bins of 1 in which outputs are counted, up to MOST_OUTPUT on both sides of 0.
FAN_IN, BINS, MOST_OUTPUT = 4, 256, 40
#: Standard errors that a cell's log-odds are drawn towards 0 by.
DRAWN = 1.5
REJECT = 0.7
#: Labelled documents of either kind that a language needs for a cut of its own.
LEAST_OF_LANGUAGE = 20


def cells(words: Words) -> np.ndarray:
    """For each word, the rows of its own vector and of those of its beginnings; the last row (zeros) where it is no longer than that."""
    out = np.full((len(words), 1 + len(BEGINNINGS)), CELLS, np.int64)
    cut = lambda h: (h >> np.uint64(20)).astype(np.int64) & (CELLS - 1)
    out[:, 0] = cut(words.hash)
    lens, total, at = words.end - words.start, np.zeros(len(words), np.uint64), 0
    for j, n in enumerate(BEGINNINGS):
        for k in range(at, n):
            fits = np.flatnonzero(lens > k)
            total[fits] += byte_numbers()[(k << 8) | words.data[words.start[fits] + k].astype(np.int64)]
        at = n
        own = np.flatnonzero(lens > n)
        out[own, 1 + j] = cut(mix(total[own] ^ np.uint64(0xBE61 * n)))
    return out


def laid_out(own: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of cells with room (zeros) for the widest filter after each text, and where each text begins (one more at the end)."""
    pad = max(WIDTHS)
    n = np.diff(first)
    begin = first + pad * np.arange(len(first))
    out = np.full((begin[-1], own.shape[1]), CELLS, np.int64)
    out[np.arange(first[-1]) + np.repeat(pad * np.arange(len(n)), n)] = own[: first[-1]]
    return out, begin


@dataclass
class Net:
    """table: vectors of cells, the last of zeros; filters: for each width, its offsets by SIZE by FILTERS; their biases; output weights and bias."""

    table: np.ndarray
    filters: list[np.ndarray]
    biases: np.ndarray
    out: np.ndarray
    bias: float

    @classmethod
    def start(cls, tells: np.ndarray, share: float) -> Net:
        """The first number of a vector is how its cell tells labels apart; the first filter of each width looks for that."""
        random = np.random.default_rng(11)
        own = (random.standard_normal((CELLS + 1, SIZE)) * 0.02).astype(np.float32)
        own[:CELLS, 0] = tells
        own[CELLS] = 0
        filters = [(random.standard_normal((w, SIZE, FILTERS)) * 0.1).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0, 0] = 1.0
        out = (random.random(FILTERS * len(WIDTHS)) * 0.1).astype(np.float32)
        out[::FILTERS] = 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return cls(own, filters, np.zeros(FILTERS * len(WIDTHS), np.float32), out, float(np.log(share / (1 - share))))

    def parts(self) -> list[np.ndarray]:
        return [self.table, *self.filters, self.biases, self.out, np.array([self.bias], np.float32)]

    @classmethod
    def of(cls, parts: list[np.ndarray]) -> Net:
        return cls(parts[0], list(parts[1:-3]), parts[-3], parts[-2], float(parts[-1][0]))

    def pooled(self, rows: np.ndarray, begin: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Each filter's largest value in each text, below 0 cut, and where it is."""
        vectors = self.table[rows[:, 0]]
        for j in range(1, rows.shape[1]):
            vectors += self.table[rows[:, j]]
        most, where = [], []
        last = np.zeros(len(rows), bool)
        for w, f in zip(WIDTHS, self.filters, strict=True):
            value = vectors @ f[0]
            for j in range(1, w):
                value[:-j] += vectors[j:] @ f[j]
            last[:] = False
            for j in range(1, w):
                last[begin[1:] - j] = True  # a window that would reach into the next text
            value[last] = -np.inf
            most.append(np.maximum.reduceat(value, begin[:-1], axis=0))
            if places:
                where.append(np.stack([a + value[a:b].argmax(axis=0) for a, b in zip(begin[:-1], begin[1:], strict=True)]))
        return np.maximum(np.concatenate(most, axis=1) + self.biases, 0), np.concatenate(where, axis=1) if places else None

    def logit(self, rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """What each text's output is before it becomes a chance."""
        return self.pooled(rows, begin)[0] @ self.out + self.bias


@dataclass
class Trainer:
    """Adaptive steps (each number's own rate falls with what it has moved by) on a net."""

    net: Net
    seen: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.seen = [np.full(p.shape, 1e-2, np.float32) for p in self.net.parts()]

    def step(self, rows: np.ndarray, begin: np.ndarray, y: np.ndarray) -> None:
        net, n = self.net, len(y)
        most, where = net.pooled(rows, begin, places=True)
        z = np.clip(most @ net.out + net.bias, -30, 30)
        wrong = ((1 / (1 + np.exp(-z)) - y) / n).astype(np.float32)
        back = wrong[:, None] * net.out * (most > 0)
        grads, touched, vectors = [], [], []
        for i, (w, f) in enumerate(zip(WIDTHS, net.filters, strict=True)):
            own, at = back[:, i * FILTERS : (i + 1) * FILTERS], where[:, i * FILTERS : (i + 1) * FILTERS]
            grad = np.empty_like(f)
            for j in range(w):
                cell = rows[at + j]
                v = net.table[cell].sum(axis=2)
                grad[j] = np.einsum("dfs,df->sf", v, own)
                touched.append(cell.reshape(-1, rows.shape[1]))
                vectors.append((own[:, :, None] * f[j].T[None]).reshape(-1, SIZE))
            grads.append(grad)
        cell, vector = np.concatenate(touched), np.concatenate(vectors)
        cell, of = cell.ravel(), np.repeat(np.arange(len(vector)), rows.shape[1])
        order = np.argsort(cell, kind="stable")
        first = np.flatnonzero(np.diff(cell[order], prepend=-1))
        which, total = cell[order][first], np.add.reduceat(vector[of[order]], first, axis=0)
        fine = which < CELLS
        which, total = which[fine], total[fine]
        self.seen[0][which] += total * total
        net.table[which] -= RATE * total / np.sqrt(self.seen[0][which])
        rest = [*grads, back.sum(axis=0), most.T @ wrong, np.array([wrong.sum()], np.float32)]
        parts = net.parts()
        for p, g, s in zip(parts[1:], rest, self.seen[1:], strict=True):
            s += g * g
            p -= RATE * g / np.sqrt(s)
        net.bias = float(parts[-1][0])


def split(doc_id: Column) -> Column:
    """The remainder that decides whether a document's label may be learned from (not 1) or is held out."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3


def learned(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, lang, toxic, and part (by hash: 0 calibrates, others train) of every document whose label may be learned from. Labels grow with the documents, so both are dealt by doc_id."""
    own = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(split(F.col("doc_id")) != 1)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(column_or_null(docs, "lang", "string"), F.lit("")).alias("lang")).where(split(F.col("doc_id")) != 1)
    return rows.join(own.hint("merge"), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)).cast("int"))


def texts_of(batch: pa.RecordBatch) -> Iterator[tuple[slice, Words]]:
    """Rows of a batch in steps, with their texts' words."""
    for part, data, bounds in columns(batch, lower=True):
        yield part, Words(data, bounds, BETWEEN)


def telling(rows: DataFrame) -> tuple[np.ndarray, float, int]:
    """How each cell tells toxic documents from others, the share of toxic ones, and how many there are."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, CELLS + 1), np.int64)
        for batch in batches:
            for part, words in texts_of(batch):
                toxic = ids_of(batch, part, "toxic")
                own = cells(words)
                pair = np.unique((words.text_of[:, None] * (CELLS + 1) + own).ravel())
                text, cell = pair // (CELLS + 1), pair % (CELLS + 1)
                for kind in (0, 1):
                    total[kind] += np.bincount(cell[toxic[text] == kind], minlength=CELLS + 1)
        some = np.flatnonzero(total[:, :CELLS].any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[0, some]), pa.array(total[1, some])], names=["cell", "no", "yes"])

    size = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("yes")).first()
    n, yes = size["n"], size["yes"]
    got = rows.select("text", "toxic").mapInArrow(count, "cell long, no long, yes long").groupBy("cell").agg(F.sum("no").alias("no"), F.sum("yes").alias("yes")).toArrow()
    out = np.zeros(CELLS, np.float32)
    a, b = (got.column(c).to_numpy().astype(np.float64) for c in ("yes", "no"))
    odds = np.log((a + 0.5) / (yes + 1)) - np.log((b + 0.5) / (n - yes + 1))
    unsure = DRAWN * np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    out[got.column("cell").to_numpy()] = np.sign(odds) * np.maximum(np.abs(odds) - unsure, 0)
    return out, yes / n if n else 0.0, n


def by_trainer(rows: DataFrame, trainers: int) -> DataFrame:
    """Rows dealt by hash to trainers, once for all rounds; kept on the executors' disks. Few of the parts have more than one trainer."""
    own = rows.select("doc_id", "text", "toxic", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(trainers)).cast("int").alias("trainer"))
    return own.repartition(4 * trainers, "trainer").persist(StorageLevel.DISK_ONLY)


NETS = "trainer int, nets long, net binary"


def added(nets: pa.Table) -> tuple[int, np.ndarray]:
    """How many nets some rows stand for, and their sum, added up in the order of their trainers."""
    nets = nets.combine_chunks().sort_by("trainer")
    total = np.zeros(len(nets.column("net")[0].as_buffer()) // 4)
    for x in nets.column("net"):
        total += np.frombuffer(x.as_buffer(), np.float32)
    return sum(nets.column("nets").to_pylist()), total


def one_round(dealt: DataFrame, trainers: int, net: Net, number: int) -> Net:
    """The average of the nets that the trainers make of a net, each with its own documents."""
    parts = net.parts()
    shapes = [p.shape for p in parts]

    def train(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, y, ids = [], [], []
        for batch in batches:
            for part, words in texts_of(batch):
                c = cells(words).astype(np.int32)
                own += [c[a:b] for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                y.append(ids_of(batch, part, "toxic"))
                ids.append(ids_of(batch, part))
        answers = np.concatenate(y).astype(np.float32)
        trainer = Trainer(Net.of([p.copy() for p in parts]))
        random = np.random.default_rng(number)
        known = np.lexsort(([int(c.sum()) for c in own], [len(c) for c in own], np.concatenate(ids)))  # rows come in any order
        order = np.concatenate([known[random.permutation(len(own))] for _ in range(TIMES)])
        for at in range(0, len(order), STEP):
            some = order[at : at + STEP]
            first = np.concatenate([[0], np.cumsum([len(own[i]) for i in some])])
            trainer.step(*laid_out(np.concatenate([own[i] for i in some]).astype(np.int64), first), answers[some])
        flat = np.concatenate([p.ravel() for p in trainer.net.parts()]).astype(np.float32)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([1], pa.int64()), pa.array([flat.tobytes()], pa.binary())], names=["trainer", "nets", "net"])

    def add(key: tuple, some: pa.Table) -> pa.Table:
        n, total = added(some)
        return pa.table({"trainer": pa.array([key[0].as_py()], pa.int32()), "nets": pa.array([n], pa.int64()), "net": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    nets, left = dealt.groupBy("trainer").applyInArrow(train, NETS), trainers
    while left > FAN_IN:  # a few sums are left for the driver
        nets = nets.withColumn("trainer", F.floor(F.col("trainer") / FAN_IN).cast("int")).groupBy("trainer").applyInArrow(add, NETS)
        left = -(-left // FAN_IN)
    n, total = added(nets.toArrow())
    flat = (total / n).astype(np.float32)
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    return Net.of([flat[e - int(np.prod(s)) : e].reshape(s).copy() for e, s in zip(ends, shapes, strict=True)])


#: Outputs in bins, the highest first: the smallest and largest of each, and how many of either label.
OUTPUTS = ("low", "high", "no", "yes")


def binned(outputs: DataFrame) -> DataFrame:
    """lang, bin, and OUTPUTS of each, from lang, toxic and z of all documents that calibrate."""
    bin = F.floor(F.greatest(F.least(F.col("z"), F.lit(float(MOST_OUTPUT))), F.lit(-float(MOST_OUTPUT))) * BINS).cast("long")
    return outputs.groupBy("lang", bin.alias("bin")).agg(F.min("z").alias("low"), F.max("z").alias("high"), F.count_if(F.col("toxic") == 0).alias("no"), F.count_if(F.col("toxic") == 1).alias("yes"))


def as_arrays(bins: pa.Table) -> list[np.ndarray]:
    bins = bins.combine_chunks().sort_by([("bin", "descending")])
    return [bins.column(c).to_numpy().astype(np.float64) for c in OUTPUTS]


def best_cut(low: np.ndarray, high: np.ndarray, no: np.ndarray, yes: np.ndarray) -> float:
    """The cut between bins with the largest F1, in the middle between the outputs on both sides of it."""
    right = np.cumsum(yes)
    f1 = 2 * right / (np.cumsum(yes + no) + max(yes.sum(), 1))
    at = int(np.argmax(f1))
    return float((low[at] + high[at + 1]) / 2) if at + 1 < len(low) else float(low[at] - 1)


@dataclass
class Classifier:
    """A net, the cut and slope that make REJECT of it, and each language's cut as a score. Without a net, chance is all scores."""

    net: Net | None
    cut: float
    slope: float
    languages: dict[str, float]
    chance: float = 0.0

    def scores(self, rows: np.ndarray, begin: np.ndarray) -> np.ndarray:
        if self.net is None:
            return np.full(len(begin) - 1, self.chance)
        return self.chances(self.net.logit(rows, begin))

    def chances(self, z: np.ndarray) -> np.ndarray:
        level = np.log(REJECT / (1 - REJECT))
        return 1 / (1 + np.exp(-np.clip(level + self.slope * (z.astype(np.float64) - self.cut), -40, 40)))


def slope_of(low: np.ndarray, high: np.ndarray, no: np.ndarray, yes: np.ndarray, cut: float) -> float:
    """The slope, of a few, that makes the answers likeliest around a cut; one wrong answer of either kind is taken for granted."""
    level, best, z, n = np.log(REJECT / (1 - REJECT)), (np.inf, 1.0), (low + high) / 2, (no + yes).sum()
    for slope in np.geomspace(0.25, 2, 13):
        p = 1 / (1 + np.exp(-np.clip(level + slope * (z - cut), -30, 30)))
        p = (p * n + 0.5) / (n + 1)
        best = min(best, (float(-(yes * np.log(p) + no * np.log(1 - p)).sum()), float(slope)))
    return best[1]


def cuts_of_languages(bins: DataFrame) -> dict[str, float]:
    """The cut of each language that has LEAST_OF_LANGUAGE labels of either kind."""

    def cut(key: tuple, own: pa.Table) -> pa.Table:
        return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "cut": pa.array([best_cut(*as_arrays(own))], pa.float64())})

    enough = bins.groupBy("lang").agg(F.sum("no").alias("_no"), F.sum("yes").alias("_yes")).where(F.least("_no", "_yes") >= LEAST_OF_LANGUAGE).select("lang")
    return {r["lang"]: r["cut"] for r in bins.join(enough, "lang").groupBy("lang").applyInArrow(cut, "lang string, cut double").collect()}


def trained(docs: DataFrame, labels: DataFrame) -> Classifier:
    rows = written(learned(docs, labels))
    kinds = rows.agg(F.count("*").alias("n"), F.coalesce(F.avg("toxic"), F.lit(0.0)).alias("share")).first()
    known = rows.where("part > 0")
    tells, share, n = telling(known)
    if not n or not 0 < share < 1:
        return Classifier(None, 0.0, 1.0, {}, float(kinds["share"]))
    net = Net.start(tells, share)
    trainers = -(-known.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] // TRAIN_BYTES)
    dealt = by_trainer(known, trainers)
    for number in range(ROUNDS):
        net = one_round(dealt, trainers, net, number)
    dealt.unpersist()

    def outputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in texts_of(batch):
                own = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([own.column("lang"), own.column("toxic"), pa.array(net.logit(*laid_out(cells(words), words.first)).astype(np.float64))], names=["lang", "toxic", "z"])

    tested = rows.where("part = 0") if not rows.where("part = 0 and toxic = 1").isEmpty() and not rows.where("part = 0 and toxic = 0").isEmpty() else rows
    bins = written(binned(tested.select("text", "lang", "toxic").mapInArrow(outputs, "lang string, toxic int, z double")))
    every = as_arrays(bins.groupBy("bin").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("no").alias("no"), F.sum("yes").alias("yes")).toArrow())
    cut = best_cut(*every)
    out = Classifier(net, cut, slope_of(*every, cut), {})
    out.languages = {name: float(out.chances(np.array([own]))[0]) for name, own in cuts_of_languages(bins).items()}
    return out


SCORED = "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean"


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every document: whether its label was held out, its score, whether that is REJECT or more, its language's threshold and whether the score reaches that."""
    model = trained(docs, labels)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in texts_of(batch):
                own = batch.slice(part.start, part.stop - part.start)
                p = model.scores(*laid_out(cells(words), words.first))
                cut = np.array([model.languages.get(x, REJECT) for x in own.column("lang").to_pylist()], np.float64)
                yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("held_out"), pa.array(p), pa.array((p >= REJECT).astype(np.int32)), pa.array(cut), pa.array(p >= cut)], names=["doc_id", "held_out", "score", "predicted", "threshold", "flagged"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(column_or_null(docs, "lang", "string"), F.lit("")).alias("lang"), (split(F.col("doc_id")) == 1).alias("held_out"))
    return rows.mapInArrow(score, SCORED)


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
