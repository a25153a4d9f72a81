"""Language-model scoring: a gated recurrent network in numpy, with word counts of the whole corpus beside it.

Tokens are the white-space words, A-Z lower-cased, and an end for each document. Documents whose
crc32 of the id as text leaves 2 when divided by 7 are held out; all others are learned from.

Counts. Documents are dealt into memory-sized blocks by a hash of their ids. A block sends each of
its different words once, with its count, to the group that the word's hash names; the group adds
up and replies with the totals. So a word that every document has costs one row for each block.

The network. The 1022 most frequent words, the end and one symbol for all other words are what it
predicts: first a class, then the symbol in its class. It is trained by truncated backpropagation
on all documents learned from, each once. A hash of the id deals them to trainers, as many as the
bytes of text call for, and to rounds. In every round, each trainer trains on its documents from the
same start, and the models are averaged as a tree; so scores don't depend on how the input is split.
When scoring, the state is carried across windows, so a text's score is the log-probability of all
of it. Other words get the symbol's probability times their own, from the counts.

Null and empty texts have the end as their only token. No documents: no rows.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notespan.llm.common import WHITE, Words, columns, documents, groups_for, ids_of, mix, table, text_bytes, written

CLASSES, MEMBERS, HIDDEN = 32, 32, 24
SYMBOLS = CLASSES * MEMBERS
OTHER, END = 0, 1
END_HASH = np.uint64(0x0E0D0E0D0E0D0E0D)
#: Rounds of training, and bytes of text that one trainer learns from in all of them; a hash of the id deals the documents.
ROUNDS, TRAIN_BYTES = 4, 8 << 20
#: Documents side by side when scoring and training, and tokens that a window holds.
LANES, TRAIN_LANES, WINDOW, TRAIN_WINDOW = 256, 256, 64, 16
#: Tokens after which a longer document is trained on as if another began, so that lanes are alike in length.
TRAIN_STRETCH = 256
RATE, CLIP = 1.2e-2, 1.0
#: How many trained models are averaged at once.
FAN_IN = 16
#: Bytes of freed memory that a worker keeps at the end of its heap: a window's arrays are freed and asked for again at every step, and getting their pages anew from the system costs as much as the arithmetic.
KEEP_BYTES = 16 << 20
if hasattr(ctypes.CDLL(None), "mallopt"):  # of the GNU C library; -1 names the size above which the heap's end goes back
    ctypes.CDLL(None).mallopt(-1, KEEP_BYTES)


def held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(str(int(i)).encode()) % 7 == 2 for i in ids], bool)


class Network:
    """Parameters in one flat vector; arrays are views of it."""

    SHAPES = {"x": (SYMBOLS, 3 * HIDDEN), "u": (HIDDEN, 3 * HIDDEN), "b": (3 * HIDDEN,), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wi": (CLASSES, HIDDEN, MEMBERS), "bi": (CLASSES, MEMBERS)}

    def __init__(self, flat: np.ndarray):
        self.flat, at = flat, 0
        for name, shape in self.SHAPES.items():
            size = int(np.prod(shape))
            setattr(self, name, flat[at : at + size].reshape(shape))
            at += size

    @classmethod
    def size(cls) -> int:
        return sum(int(np.prod(s)) for s in cls.SHAPES.values())

    @classmethod
    def start(cls, counts: np.ndarray) -> Network:
        """Small random weights; the biases give each symbol its share of all tokens."""
        net = cls(np.random.default_rng(11).normal(0, 0.08, cls.size()).astype(np.float32))
        share = ((counts + 0.5) / (counts + 0.5).sum()).reshape(CLASSES, MEMBERS)
        net.b[:] = 0
        net.bc[:] = np.log(share.sum(axis=1))
        net.bi[:] = np.log(share / share.sum(axis=1, keepdims=True))
        return net

    def forward(self, inputs: np.ndarray, reset: np.ndarray, h: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
        """States after each input, steps x lanes; reset: where a document begins. With keep, also the states before, both gates (gates x steps x lanes), candidates and what the reset gate weighs."""
        size, n = len(inputs) if keep else 1, inputs.shape[1]
        states = np.empty((*inputs.shape, HIDDEN), np.float32)
        before, new = (np.empty((size, n, HIDDEN), np.float32) for _ in range(2))
        gates, g, a = np.empty((2, size, n, HIDDEN), np.float32), np.empty((3, n, HIDDEN), np.float32), np.empty((3, size, n, HIDDEN), np.float32)
        # By gate, so that what a step works on lies end to end; the gates' signs are turned for the exponential.
        x, u, begins = by_gate(self.x + self.b), by_gate(self.u), reset.any(axis=1).tolist()
        np.negative(x[:2], out=x[:2])
        np.negative(u[:2], out=u[:2])
        with np.errstate(over="ignore"):  # the exponential may be infinite: the gate is 0
            for t in range(len(inputs)):
                if begins[t]:
                    h = np.where(reset[t][:, None], np.float32(0), h)
                k = t if keep else 0
                gate, candidate, inner = gates[:, k], new[k], a[2, k]
                np.matmul(h, u, out=a[:, k])
                np.take(x, inputs[t], axis=1, out=g, mode="clip")
                np.add(a[:2, k], g[:2], out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                np.multiply(inner, gate[0], out=candidate)
                candidate += g[2]
                np.tanh(candidate, out=candidate)
                if keep:
                    before[k] = h
                out = states[t]
                np.subtract(h, candidate, out=out)
                out *= gate[1]
                out += candidate
                h = out
        return states, (before, gates, new, a[2])

    def by_class(self, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order of targets by class, and where each class begins in it (one more at the end)."""
        cls = (targets // MEMBERS).astype(np.uint8)  # few bytes are sorted by radix
        return np.argsort(cls, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=CLASSES))])

    def members(self, states: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """What each state, in the order of the target's class, gives the members of that class."""
        out = np.empty((len(states), MEMBERS), np.float32)
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[c], cuts[c + 1])
            np.matmul(states[own], self.wi[c], out=out[own])
            out[own] += self.bi[c]
        return out

    def log_probability(self, states: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithm of each target's probability."""
        x = states @ self.wc
        x += self.bc
        out = log_softmax_at(x, targets // MEMBERS)
        order, cuts = self.by_class(targets)
        out[order] += log_softmax_at(self.members(np.take(states, order, axis=0), cuts), (targets % MEMBERS)[order])
        return out

    def gradient(self, inputs: np.ndarray, targets: np.ndarray, reset: np.ndarray, used: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Loss of a window (sum over used places), its gradient, and the last state; backpropagation ends where the window begins."""
        grad = Network(np.zeros(self.size(), np.float32))
        states, (before, gates, new, inner) = self.forward(inputs, reset, h, keep=True)
        order, cuts = self.by_class(targets.ravel())
        y, use, flat = targets.ravel()[order], used.ravel()[order], np.take(states.reshape(-1, HIDDEN), order, axis=0)
        rows, cls = np.arange(len(y)), y // MEMBERS
        p = flat @ self.wc
        p += self.bc
        p, q = softmax(p), softmax(self.members(flat, cuts))
        at, member = p[rows, cls], q[rows, y % MEMBERS]
        loss = -np.log(at * member + 1e-30)[use].sum()
        p[rows, cls], q[rows, y % MEMBERS] = at - 1, member - 1
        if not use.all():
            p[~use] = q[~use] = 0
        ones = np.ones(len(y), np.float32)
        grad.wc[:], grad.bc[:] = flat.T @ p, ones @ p
        back, up = p @ self.wc.T, np.ascontiguousarray(self.wi.swapaxes(1, 2))
        for c in np.flatnonzero(np.diff(cuts)).tolist():
            own = slice(cuts[c], cuts[c + 1])
            f, e = flat[own], q[own]
            np.matmul(f.T, e, out=grad.wi[c])
            np.matmul(ones[own], e, out=grad.bi[c])
            back[own] += e @ up[c]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        behind = np.take(back, place, axis=0).reshape(states.shape)
        # d_a: the slopes of each gate; d_new: those of what the candidate's tanh is taken of.
        d_a, d_new = np.empty((3, *states.shape), np.float32), np.empty_like(states)
        up, begins = np.ascontiguousarray(by_gate(self.u).swapaxes(1, 2)), reset.any(axis=1).tolist()
        dh, rest, sent = np.zeros_like(states[0]), np.empty_like(states[0]), np.empty((3, *states[0].shape), np.float32)
        for t in range(len(inputs) - 1, -1, -1):
            r, z, n, d, own = gates[0, t], gates[1, t], new[t], d_a[:, t], d_new[t]
            dh += behind[t]
            np.multiply(n, n, out=own)
            np.subtract(1, own, out=own)
            np.subtract(1, z, out=rest)
            own *= rest
            own *= dh
            np.multiply(own, r, out=d[2])
            np.subtract(before[t], n, out=d[1])
            d[1] *= rest
            dh *= z
            d[1] *= dh
            np.subtract(1, r, out=rest)
            np.multiply(d[2], rest, out=d[0])
            d[0] *= inner[t]
            np.matmul(d, up, out=sent)
            for x in sent:
                dh += x
            if begins[t]:
                dh[reset[t]] = 0
        into, old = d_a.reshape(3, -1, HIDDEN), before.reshape(-1, HIDDEN)
        order = np.argsort(inputs.astype(np.uint16), axis=None, kind="stable")
        own, rows = inputs.ravel()[order], grad.x.reshape(-1, 3, HIDDEN)
        begin = np.flatnonzero(np.diff(own, prepend=-1))
        for k, last in enumerate((into[0], into[1], d_new.reshape(-1, HIDDEN))):
            gate = slice(k * HIDDEN, (k + 1) * HIDDEN)
            grad.u[:, gate] = old.T @ into[k]
            grad.b[gate] = ones @ last
            rows[own[begin], k] = np.add.reduceat(np.take(last, order, axis=0), begin)
        return float(loss), grad.flat, states[-1]


def by_gate(weights: np.ndarray) -> np.ndarray:
    """Weights of the gates and the candidate, side by side in each row, as one array after the other."""
    return np.ascontiguousarray(weights.reshape(-1, 3, HIDDEN).swapaxes(0, 1))


#: What a symbol or class gets at most before its exponential, so that sums stay finite.
MOST = np.float32(60)
#: Rows whose numbers stay in a processor's cache from one step to the next.
ROWS = 512


def softmax(x: np.ndarray) -> np.ndarray:
    """The softmax of each row, in the place of x."""
    ones = np.ones(x.shape[1], np.float32)
    for at in range(0, len(x), ROWS):
        own = x[at : at + ROWS]
        np.exp(np.minimum(own, MOST, out=own), out=own)
        own *= (1 / (own @ ones + np.float32(1e-30)))[:, None]
    return x


def log_softmax_at(x: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The logarithm of each row's softmax at one place; x is used up."""
    own, total, ones = np.minimum(x[np.arange(len(x)), at], MOST).astype(np.float64), np.empty(len(x), np.float32), np.ones(x.shape[1], np.float32)
    for begin in range(0, len(x), ROWS):
        some = x[begin : begin + ROWS]
        np.exp(np.minimum(some, MOST, out=some), out=some)
        np.matmul(some, ones, out=total[begin : begin + ROWS])
    return own - np.log(total + np.float32(1e-30))


def lanes(lens: np.ndarray, n: int) -> list[list[int]]:
    """Documents laid end to end in n lanes, the longest first to the shortest lane."""
    import heapq

    heap = [(0, k) for k in range(n)]
    out: list[list[int]] = [[] for _ in range(n)]
    for d in np.argsort(-lens, kind="stable").tolist():
        used, k = heapq.heappop(heap)
        out[k].append(d)
        heapq.heappush(heap, (used + int(lens[d]), k))
    return out


def laid_out(symbols: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, targets, resets and documents (-1: none), each steps x lanes, the longest lane first. Document d has symbols[first[d]:first[d + 1]]."""
    lens = np.diff(first)
    dealt = sorted((x for x in lanes(lens, max(1, min(n, len(lens)))) if x), key=lambda x: -int(lens[x].sum()))
    steps = max((int(lens[x].sum()) for x in dealt), default=0)
    inputs, targets = np.full((steps, len(dealt)), END, np.int32), np.full((steps, len(dealt)), END, np.int32)
    reset, doc = np.zeros((steps, len(dealt)), bool), np.full((steps, len(dealt)), -1, np.int32)
    for k, own in enumerate(dealt):
        y = np.concatenate([symbols[first[d] : first[d + 1]] for d in own])
        begin = np.concatenate([[0], np.cumsum(lens[own])[:-1]])
        targets[: len(y), k] = y
        inputs[1 : len(y), k] = y[:-1]
        inputs[begin, k] = END
        reset[begin, k] = True
        doc[: len(y), k] = np.repeat(own, lens[own])
    return inputs, targets, reset, doc


class Vocabulary:
    """The words that are symbols of their own, by hash, and all symbols' counts."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, n_end: int, n_all: int, n_different: int):
        order = np.argsort(hashes)
        self.sorted, self.symbol = hashes[order], (np.arange(len(hashes)) + 2)[order]
        self.counts = np.zeros(SYMBOLS)
        self.counts[END], self.counts[2 : 2 + len(counts)] = n_end, counts
        self.counts[OTHER] = max(0, n_all - n_end - int(counts.sum()))
        self.n_all, self.n_different = n_all, n_different
        #: Logarithm (10) of the weights of all words that share a symbol.
        self.other = np.log10(self.counts[OTHER] + max(0, n_different - len(hashes) - (n_end > 0)) + 1)

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not len(self.sorted):
            return np.full(len(h), OTHER)
        at = np.searchsorted(self.sorted, h)
        at[at == len(self.sorted)] = 0
        return np.where(self.sorted[at] == h, self.symbol[at], OTHER)


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids of some documents, their words' hashes with an end after each, and where each begins (one more at the end)."""
    for batch in batches:
        for rows, data, bounds in columns(batch, lower=True):
            words = Words(data, bounds, WHITE)
            h = np.insert(words.hash, words.first[1:], END_HASH)
            yield ids_of(batch, rows), h, words.first + np.arange(len(words.first))


def counted(blocks: DataFrame, groups: int) -> DataFrame:
    """kind 0: block, group, totals (long, as binary) of the block's words in the group, sorted by hash. kind 1: N, V and the documents of a group, and its most frequent words as hashes and totals."""

    def emit(block: pa.Table) -> pa.Table:
        all_h, train_h = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for ids, h, first in tokens(block.to_batches()):
            all_h.append(np.unique(h))
            train_h.append(h[np.repeat(~held_out(ids), np.diff(first))])
        different = np.unique(np.concatenate(all_h))
        own, n = np.unique(np.concatenate(train_h), return_counts=True)
        count = np.zeros(len(different), np.int64)
        count[np.searchsorted(different, own)] = n
        group, order, cuts = dealt(different, groups)
        cols = {"block": [], "group": [], "hashes": [], "counts": []}
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            cols["block"].append(block.column("block")[0].as_py())
            cols["group"].append(int(group[order[a]]))
            cols["hashes"].append(different[order[a:b]].tobytes())
            cols["counts"].append(count[order[a:b]].tobytes())
        return pa.table({k: pa.array(v, t) for (k, v), t in zip(cols.items(), [pa.int32(), pa.int32(), pa.binary(), pa.binary()], strict=True)})

    def add(group: pa.Table) -> pa.Table:
        h = np.frombuffer(b"".join(group.column("hashes").to_pylist()), np.uint64)
        n = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.int64)
        different, back = np.unique(h, return_inverse=True)
        total = np.zeros(len(different), np.int64)
        np.add.at(total, back, n)
        ends = np.concatenate([[0], np.cumsum([len(x.as_py()) // 8 for x in group.column("counts")])])
        raw = total[back].tobytes()
        replies = [raw[8 * a : 8 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        top = most_frequent(different, np.where(different != END_HASH, total, 0))
        k, number = len(replies), group.column("group")[0].as_py()
        # A row for each reply, and one for the group.
        block, reply = [*group.column("block").to_pylist(), None], [*replies, top.tobytes()]
        one, two, three = (np.array([0] * k + [int(x)]) for x in (total.sum(), (total > 0).sum(), total[different == END_HASH].sum()))
        return pa.table({"kind": pa.array([0] * k + [1], pa.int32()), "block": pa.array(block, pa.int32()), "group": pa.array([number] * (k + 1), pa.int32()), "totals": pa.array(reply, pa.binary()), "one": one, "two": two, "three": three})

    sent = blocks.groupBy("block").applyInArrow(emit, "block int, group int, hashes binary, counts binary")
    return sent.groupBy("group").applyInArrow(add, "kind int, block int, group int, totals binary, one long, two long, three long")


def dealt(different: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The group of each hash, the order by group, and where each group begins in it."""
    group = (mix(different) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    return group, order, np.flatnonzero(np.diff(group[order], prepend=-1)).tolist()


def most_frequent(hashes: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """The words that may be symbols: rows of hash and total, the most frequent first."""
    best = np.lexsort((hashes, -totals))[: SYMBOLS - 2]
    best = best[totals[best] > 0]
    return np.stack([hashes[best].view(np.int64), totals[best]], axis=1)


def merged(lists: list[bytes]) -> np.ndarray:
    rows = np.frombuffer(b"".join(lists), np.int64).reshape(-1, 2)
    return most_frequent(np.ascontiguousarray(rows[:, 0]).view(np.uint64), rows[:, 1])


def vocabulary(counts: DataFrame, groups: int) -> Vocabulary:
    """The groups' lists of words are merged by some tasks first; the driver gets about the square root of their number."""

    def merge(part: pa.Table) -> pa.Table:
        sums = [[sum(part.column(c).to_pylist())] for c in ("one", "two", "three")]
        return pa.table({"totals": pa.array([merged(part.column("totals").to_pylist()).tobytes()], pa.binary()), **{c: pa.array(v, pa.int64()) for c, v in zip(("one", "two", "three"), sums, strict=True)}})

    part = F.pmod("group", F.lit(max(1, int(groups**0.5))))
    rows = counts.where("kind = 1").withColumn("part", part).groupBy("part").applyInArrow(merge, "totals binary, one long, two long, three long").collect()
    n = [sum(r[c] for r in rows) for c in ("one", "two", "three")]
    top = merged([bytes(r["totals"]) for r in rows])
    return Vocabulary(np.ascontiguousarray(top[:, 0]).view(np.uint64), top[:, 1], n[2], n[0], n[1])


def train(net: Network, vocab: Vocabulary, docs: pa.Table) -> int:
    """Trains on some documents, once, in the order of their ids; returns the number of tokens."""
    parts = list(tokens(docs.combine_chunks().sort_by([("doc_id", "ascending"), ("text", "ascending")]).to_batches()))
    h = np.concatenate([x for _, x, _ in parts])
    symbols = vocab.symbols(h)
    symbols[h == END_HASH] = END
    first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, _, f in parts]))])
    first = np.unique(np.concatenate([first, *(np.arange(a, b, TRAIN_STRETCH) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True))]))
    inputs, targets, reset, doc = laid_out(symbols, first, TRAIN_LANES)
    m, v = np.zeros_like(net.flat), np.zeros_like(net.flat)
    state = np.zeros((inputs.shape[1], HIDDEN), np.float32)
    for step, at in enumerate(range(0, len(inputs), TRAIN_WINDOW), 1):
        busy = int((doc[at] >= 0).sum())  # the longest lanes come first
        part = slice(at, at + TRAIN_WINDOW), slice(0, busy)
        used = doc[part] >= 0
        _, g, state = net.gradient(inputs[part], targets[part], reset[part], used, state[:busy])
        g /= used.sum()
        g *= min(1.0, CLIP / (float(np.sqrt((g * g).sum())) + 1e-9))
        m += 0.1 * (g - m)
        v += 0.001 * (g * g - v)
        net.flat -= RATE / (1 - 0.9**step) * m / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return len(h)


def shares(docs: DataFrame, trainers: int) -> list[DataFrame]:
    """The documents that each round trains on, with their trainer: together all that are learned from, each once."""
    learned = docs.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2)
    place = F.pmod(F.xxhash64("doc_id"), F.lit(ROUNDS * trainers))
    return [learned.where(F.floor(place / trainers) == turn).withColumn("trainer", F.pmod(place, F.lit(trainers)).cast("int")) for turn in range(ROUNDS)]


MODEL = "trainer int, weight double, weights binary"


def average(models: pa.Table) -> tuple[float, np.ndarray]:
    """The weights and the weighted sum of some models, added up in the order of their trainers."""
    models = models.combine_chunks().sort_by("trainer")
    total = np.zeros(Network.size())
    for x in models.column("weights"):
        total += np.frombuffer(x.as_buffer(), np.float32)
    return sum(models.column("weight").to_pylist()), total


def trained(docs: DataFrame, vocab: Vocabulary) -> np.ndarray:
    """The averaged parameters after all rounds."""
    trainers = max(1, -(-text_bytes(docs) // TRAIN_BYTES))
    flat = Network.start(vocab.counts).flat

    def from_start(given: np.ndarray):
        def run(key: tuple, own: pa.Table) -> pa.Table:
            net = Network(given.copy())
            n = train(net, vocab, own)
            return pa.table({"trainer": pa.array([key[0].as_py()], pa.int32()), "weight": pa.array([n], pa.float64()), "weights": pa.array([(net.flat * np.float32(n)).tobytes()], pa.binary())})

        return run

    for share in shares(docs, trainers):

        def add(key: tuple, some: pa.Table) -> pa.Table:
            weight, total = average(some)
            return pa.table({"trainer": pa.array([key[0].as_py()], pa.int32()), "weight": pa.array([weight], pa.float64()), "weights": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

        models, left = share.groupBy("trainer").applyInArrow(from_start(flat), MODEL), trainers
        while left > FAN_IN:  # a few models are left for the driver
            models = models.withColumn("trainer", F.floor(F.col("trainer") / FAN_IN).cast("int")).groupBy("trainer").applyInArrow(add, MODEL)
            left = -(-left // FAN_IN)
        weight, total = average(models.toArrow())
        if weight:
            flat = (total / weight).astype(np.float32)
    return flat


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame) -> DataFrame:
    """A row for every document: its numbers of tokens, the score by counts alone, and the network's."""
    own = documents(docs)
    groups = groups_for(own)
    blocks = own.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int"))
    counts = written(counted(blocks, groups))
    vocab = vocabulary(counts, groups)
    flat = trained(own, vocab)

    def score(key: tuple, block: pa.Table, replies: pa.Table) -> pa.Table:
        net = Network(flat)
        parts = list(tokens(block.to_batches()))
        if not parts:
            return pa.table({n: pa.array([], t) for n, t in zip(["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"], [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)})
        ids = np.concatenate([i for i, _, _ in parts])
        h = np.concatenate([x for _, x, _ in parts])
        first = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(f) for _, _, f in parts]))])
        different, back = np.unique(h, return_inverse=True)
        group, order, cuts = dealt(different, groups)
        of_group = dict(zip(replies.column("group").to_pylist(), replies.column("totals").to_pylist(), strict=True))
        total = np.zeros(len(different), np.int64)
        for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
            total[order[a:b]] = np.frombuffer(of_group[int(group[order[a]])], np.int64)
        c = total[back]
        doc = np.repeat(np.arange(len(ids)), np.diff(first))
        logs = np.log10(c + 1.0)
        n_tokens = np.diff(first)
        base = np.bincount(doc, logs, len(ids)) - n_tokens * np.log10(vocab.n_all + vocab.n_different + 1.0)
        symbols = vocab.symbols(h)
        symbols[h == END_HASH] = END
        by_other = np.bincount(doc, np.where(symbols == OTHER, logs - vocab.other, 0.0), len(ids))
        inputs, targets, reset, of = laid_out(symbols, first, LANES)
        state = np.zeros((inputs.shape[1], HIDDEN), np.float32)
        for t in range(0, len(inputs), WINDOW):
            busy = int((of[t] >= 0).sum())  # the longest lanes come first
            part = slice(t, t + WINDOW), slice(0, busy)
            states, _ = net.forward(inputs[part], reset[part], state[:busy])
            state = states[-1]
            used = of[part] >= 0
            by_other += np.bincount(of[part][used], net.log_probability(states[used], targets[part][used]), len(ids)) / np.log(10)
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(held_out(ids)), "n_tokens": pa.array(n_tokens.astype(np.int64)), "n_known": pa.array(np.bincount(doc, c > 0, len(ids)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(ids), vocab.n_all, np.int64)), "base_score": pa.array(base), "score": pa.array(by_other),
        })

    replies = counts.where("kind = 0").select("block", "group", "totals")
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(score, SCORES)


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
