"""BPE encoding and decoding by dynamic programming over the prefixes of each piece of text.

The texts are cut where the tokenizer surely begins a piece; of a step of texts, each different
part is looked up or encoded once, and the ids of all texts are gathered from those. A part is split
as the tokenizer splits it, and each piece is encoded by itself. Of a piece,
every prefix has exactly one encoding that byte-pair merging can give, so its last token is all
that needs storing. Candidates for that token are the vocabulary's tokens that end where the
prefix ends. A suffix automaton of the vocabulary, fed byte by byte, is at the longest match;
its links lead to the shorter ones. A candidate is the last token if it can stand beside the last
token of the prefix before it: no merge over the border of the two would have come first. The ids
follow from the back-pointers.

Every document is a row of its own, so nothing is shuffled. A null text is empty: no ids.
The vocabulary has a fixed size; each worker reads it once and keeps a bounded number of pieces.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from notespan.llm.automaton import Automaton
from notespan.llm.common import columns, documents, fingerprints, ids_of, table

# How the tokenizer splits texts, and white space as it knows it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

#: Pieces that each of a worker's two generations keeps the ids of, and the longest (in bytes) that is kept.
KEPT, KEPT_BYTES = 120_000, 48
#: Pieces that are encoded side by side.
AT_ONCE = 32_768
#: Bytes that white space of more than one byte begins with, and bytes that surely begin no white space.
WIDE_SPACE = [0xC2, 0xE1, 0xE2, 0xE3]
NO_SPACE = ~np.isin(np.arange(256), [9, 10, 11, 12, 13, 32, *WIDE_SPACE])
PLAIN = (np.arange(256) > 32) & (np.arange(256) < 127)
#: 1: letters, 2: digits, 3: other marks, of ASCII; a piece ends where one kind follows another, but after an apostrophe.
KIND = np.array([0 if not 32 < b < 127 else 1 if chr(b).isalpha() else 2 if chr(b).isdigit() else 3 for b in range(256)], np.uint8)
#: Pairs of tokens (a power of two) whose compatibility is kept; a new one takes the place of another.
PAIR_BITS = 20
NEVER = 1 << 60


def byte_letters() -> dict[str, int]:
    """The letter that the vocabulary file writes for each byte: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Recent:
    """What was computed or used lately, in two generations: when the new one is full it becomes the old one, and the old one goes."""

    def __init__(self, size: int):
        self.size, self.now, self.before = size, {}, {}

    def find(self, key):
        if (value := self.now.get(key)) is None and (value := self.before.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(self.now) >= self.size:
            self.now, self.before = {}, self.now
        self.now[key] = value


class Table:
    """A fixed map of whole numbers from 0 to numbers, which looks up many at once; -1 for what it hasn't."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys)), self._first(keys)
        while len(left):
            free = self.keys[at] < 0
            slot, own = np.unique(at[free], return_index=True)
            own = np.flatnonzero(free)[own]
            self.keys[slot], self.values[slot] = keys[left[own]], values[left[own]]
            stay = np.ones(len(left), bool)
            stay[own] = False
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((found != keys) & (found >= 0))
        at = at[left]
        while len(left):
            at = (at + 1) & self.mask
            found = self.keys[at]
            hit = found == keys[left]
            out[left[hit]] = self.values[at[hit]]
            on = ~hit & (found >= 0)
            left, at = left[on], at[on]
        return out


class Tokenizer:
    """Encodes and decodes as the vocabulary file at path says."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        as_bytes = lambda s: bytes(letters[c] for c in s)
        own = [(as_bytes(s), i) for s, i in vocab.items() if s not in special]
        self.bytes_of: list[bytes] = [b""] * (1 + max([*vocab.values(), *special.values()]))
        for s, i in own:
            self.bytes_of[i] = s
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.special = {x.encode(): i for x, i in special.items()}
        self.special_parts = re.compile(b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if special else None
        self.size = np.array([len(x) for x in self.bytes_of], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.rank: dict[tuple[int, int], int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for k, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            pair = vocab[a], vocab[b]
            self.rank.setdefault(pair, k)
            parts.setdefault(vocab[a + b], (k, *pair))
        # Of each token: what stands at its right end (left end) until the merge of which rank.
        self.right: dict[int, list[tuple[int, int]]] = {}
        self.left: dict[int, list[tuple[int, int]]] = {}
        for _, i in own:
            for side, out in ((2, self.right), (1, self.left)):
                t, until, ends = i, NEVER, []
                while True:
                    ends.append((t, until))
                    if t not in parts:
                        break
                    until, t = parts[t][0], parts[t][side]
                out[i] = ends
        self.automaton = auto = Automaton([s for s, _ in own])
        self.ids = [i for _, i in own]
        self.lens = [len(s) for s, _ in own]
        self.pieces = regex.compile(PIECES).findall
        self.pairs = Recent(KEPT)
        self.part_ids = Recent(KEPT)
        # The same as arrays, for many pieces at once.
        edges = [(state << 8 | b, to) for state, out in enumerate(auto.next) for b, to in out.items()]
        self.steps = Table(*np.array(edges, np.int64).reshape(-1, 2).T)
        self.link, self.length, self.at = (np.array(x, np.int32) for x in (auto.link, auto.length, auto.at))
        self.below = np.where(self.link >= 0, self.at[self.link], -1).astype(np.int32)
        numbers = np.array(auto.whole, np.int64)
        self.token, self.token_size = (np.array(x, np.int32)[numbers] for x in (self.ids, self.lens))
        self.ranks = Table(np.array([a << 20 | b for a, b in self.rank], np.int64), np.array(list(self.rank.values()), np.int32))
        self.right_ends, self.left_ends = (listed_ends(x, len(self.bytes_of)) for x in (self.right, self.left))
        self.pair_seen, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging leaves the border between a and b. Of equal merges the leftmost comes first."""
        key = a << 32 | b
        if (known := self.pairs.find(key)) is not None:
            return known
        rank, fits = self.rank, True
        for x, x_until in self.right[a]:
            for y, y_until in self.left[b]:
                r = rank.get((x, y))
                if r is not None and r < x_until and r <= y_until:
                    fits = False
        self.pairs.keep(key, fits)
        return fits

    def encode_piece(self, s: bytes) -> list[int]:
        auto, ids, lens = self.automaton, self.ids, self.lens
        step, at, link, whole, length = auto.step, auto.at, auto.link, auto.whole, auto.length
        last = [-1] * (len(s) + 1)
        size = [0] * (len(s) + 1)
        state = matched = 0
        for i, b in enumerate(s, 1):
            state, matched = step(state, matched, b)
            found = at[state] if matched == length[state] else at[link[state]]
            while found > 0:
                number = whole[found]
                before = i - lens[number]
                if before == 0 or (last[before] >= 0 and self.compatible(last[before], ids[number])):
                    last[i], size[i] = ids[number], lens[number]
                    break
                found = at[link[found]]
        out, i = [], len(s)
        while i:
            out.append(last[i])
            i -= size[i]
        out.reverse()
        return out

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """compatible() of many pairs."""
        key = a.astype(np.int64) << 20 | b
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_fits[slot]
        new = np.flatnonzero(self.pair_seen[slot] != key)
        if len(new):
            own, back = np.unique(key[new], return_inverse=True)
            x, y = own >> 20, own & 0xFFFFF
            (begin_x, ends_x, until_x), (begin_y, ends_y, until_y) = self.right_ends, self.left_ends
            n, m = begin_x[x + 1] - begin_x[x], begin_y[y + 1] - begin_y[y]
            k = spread(np.zeros(len(own), np.int64), n * m)
            m_all = np.repeat(m, n * m)
            i, j = np.repeat(begin_x[x], n * m) + k // m_all, np.repeat(begin_y[y], n * m) + k % m_all
            rank = self.ranks.get(ends_x[i] << 20 | ends_y[j])
            bad = (rank >= 0) & (rank < until_x[i]) & (rank <= until_y[j])
            good = ~np.logical_or.reduceat(bad, np.cumsum(n * m) - n * m)
            out[new] = good[back.ravel()]
            self.pair_seen[slot[new]], self.pair_fits[slot[new]] = key[new], out[new]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """encode_piece() of many short pieces, as little-endian numbers: one step of all pieces at a time."""
        lens = np.array([len(x) for x in pieces], np.int64)
        order = np.argsort(-lens, kind="stable")
        sizes, n = lens[order], len(pieces)
        width = int(sizes[0])
        text = np.zeros((width, n), np.uint8)
        place = spread(np.zeros(n, np.int64), lens)
        column = np.empty(n, np.int64)
        column[order] = np.arange(n)
        text[place, np.repeat(column, lens)] = np.frombuffer(b"".join(pieces), np.uint8)
        last, size, count = (np.zeros((width + 1, n), np.int32) for _ in range(3))
        state, matched = np.zeros(n, np.int32), np.zeros(n, np.int32)
        for i in range(1, width + 1):
            m = int(np.searchsorted(-sizes, -i, "right"))
            self.step(state[:m], matched[:m], text[i - 1, :m])
            now = state[:m]
            found = np.where(matched[:m] == self.length[now], self.at[now], self.below[now])
            left = np.flatnonzero(found > 0)
            found = found[left]
            while len(left):
                token, own = self.token[found], self.token_size[found]
                before = i - own
                fits = before == 0
                inner = np.flatnonzero(~fits & (size[before, left] > 0))
                fits[inner] = self.fits(last[before[inner], left[inner]], token[inner])
                at = left[fits]
                last[i, at], size[i, at], count[i, at] = token[fits], own[fits], count[before[fits], at] + 1
                found = self.below[found[~fits]]
                left = left[~fits][found > 0]
                found = found[found > 0]
        total = count[sizes, np.arange(n)]
        ends = np.cumsum(total)
        out = np.zeros(int(ends[-1]), "<u4")
        place, slot, left = sizes.copy(), ends - 1, np.arange(n)
        while len(left):
            out[slot[left]] = last[place[left], left]
            place[left] -= size[place[left], left]
            slot[left] -= 1
            left = left[place[left] > 0]
        raw, ends = out.tobytes(), (4 * ends).tolist()
        in_order = [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return [in_order[k] for k in column.tolist()]

    def step(self, state: np.ndarray, matched: np.ndarray, byte: np.ndarray) -> None:
        """Moves the automaton's states and lengths on by a byte each, in place."""
        left = np.arange(len(state))
        while len(left):
            now = state[left]
            to = self.steps.get(now.astype(np.int64) << 8 | byte[left])
            hit = to >= 0
            state[left[hit]] = to[hit]
            matched[left[hit]] += 1
            back = left[~hit & (now > 0)]
            matched[left[~hit & (now == 0)]] = 0
            state[back] = self.link[state[back]]
            matched[back] = self.length[state[back]]
            left = back

    def encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """The ids of parts that are split off where the tokenizer also splits, as little-endian numbers."""
        out: list[bytes] = [b""] * len(parts)
        single, several, short, owners = [], {}, [], []
        for k, own in enumerate(parts):
            if len(own) <= KEPT_BYTES and (own[1:] if own[:1] == b" " else own).isalpha():
                single.append(k)  # one piece: there is nothing to split
            elif (special := self.special.get(own)) is not None:
                out[k] = np.array([special], "<u4").tobytes()
            else:
                several[k] = ids = []
                for piece in self.pieces(own.decode("utf-8", "replace")):
                    raw = piece.encode()
                    if len(raw) <= KEPT_BYTES:
                        owners.append((ids, len(ids)))
                        short.append(raw)
                        ids.append(b"")
                    else:
                        ids.append(np.array(self.encode_piece(raw), "<u4").tobytes())
        for at in range(0, len(single), AT_ONCE):
            some = single[at : at + AT_ONCE]
            for k, x in zip(some, self.encode_pieces([parts[k] for k in some]), strict=True):
                out[k] = x
        for at in range(0, len(short), AT_ONCE):
            for (ids, j), x in zip(owners[at : at + AT_ONCE], self.encode_pieces(short[at : at + AT_ONCE]), strict=True):
                ids[j] = x
        for k, ids in several.items():
            out[k] = b"".join(ids)
        return out

    def specials(self, raw: bytes, bounds: np.ndarray) -> list[tuple[int, int]]:
        """Where special tokens begin and end in the texts."""
        if self.special_parts is None or not self.special_parts.search(raw):
            return []
        return [m.span() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) for m in self.special_parts.finditer(raw, a, b)]

    def parts(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where the parts begin: at texts' and special tokens' edges, at a space before what is no white space, at a line end between two words and after it, and where letters, digits and marks meet."""
        n, special = len(data), self.specials(data.tobytes(), bounds)
        edges = np.concatenate([bounds, np.array(special, np.int64).ravel()])
        cut = np.zeros(n + 1, bool)
        inner = np.ones(n + 1, bool)
        inner[edges] = False  # no edge: this byte and the one before it are of one text
        cut[: n - 1] |= (data[:-1] == 32) & NO_SPACE[data[1:]] & inner[1:n]
        line = np.flatnonzero((data[1:-1] == 10) & PLAIN[data[:-2]] & NO_SPACE[data[2:]] & inner[1 : n - 1] & inner[2:n]) + 1
        cut[line] = cut[line + 1] = True
        kind = KIND[data]
        cut[1:n] |= (kind[1:] != kind[:-1]) & (kind[1:] > 0) & (kind[:-1] > 0) & (data[:-1] != 39)
        cut[edges] = True
        for a, b in special:
            cut[a + 1 : b] = False
        return np.flatnonzero(cut[:n])

    def encode_all(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and how many each has."""
        if not len(data):
            return np.empty(0, "<u4"), np.zeros(len(bounds) - 1, np.int64)
        raw = data.tobytes()
        start = self.parts(data, bounds)
        lens = np.diff(np.append(start, len(data)))
        _, first, number = np.unique(fingerprints(data, lens), return_index=True, return_inverse=True)
        number = number.ravel()
        if not same_bytes(data, start, lens, first[number]):  # two parts with one fingerprint: none is taken for another
            own = {}
            number = np.array([own.setdefault(raw[a : a + n], len(own)) for a, n in zip(start.tolist(), lens.tolist(), strict=True)])
            first = np.unique(number, return_index=True)[1]
        own = [raw[a : a + n] for a, n in zip(start[first].tolist(), lens[first].tolist(), strict=True)]
        ids = list(map(self.part_ids.find, own))
        new = [k for k, x in enumerate(ids) if x is None]
        for k, x in zip(new, self.encode_parts([own[k] for k in new]), strict=True):
            ids[k] = x
            if len(own[k]) <= KEPT_BYTES:
                self.part_ids.keep(own[k], x)
        size = np.array([len(x) for x in ids], np.int64) // 4
        begin = np.cumsum(size) - size
        count = size[number]
        flat = np.frombuffer(b"".join(ids), "<u4")[spread(begin[number], count)]
        of_text = np.searchsorted(bounds, start, "right") - 1
        return flat, np.bincount(of_text, count, len(bounds) - 1).astype(np.int64)

    def encode(self, text: str) -> bytes:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        return self.encode_all(data, np.array([0, len(data)]))[0].tobytes()

    def decode_all(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text, from the ids of all end to end and how many each has."""
        size = self.size[ids]
        raw = self.all_bytes[spread(self.begin[ids], size)].tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [raw[a:b] for a, b in zip(ends, ends[1:], strict=False)]

    def decode_bytes(self, ids: bytes) -> bytes:
        own = np.frombuffer(ids, "<u4")
        return self.decode_all(own, np.array([len(own)]))[0]


def listed_ends(ends: dict[int, list[tuple[int, int]]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each token's ends begin (one more at the end), the ends, and the ranks that they last until."""
    sizes = np.array([len(ends.get(i, ())) for i in range(n)], np.int64)
    flat = np.array([pair for i in range(n) for pair in ends.get(i, ())], np.int64).reshape(-1, 2)
    return np.concatenate([[0], np.cumsum(sizes)]), np.ascontiguousarray(flat[:, 0]), np.ascontiguousarray(flat[:, 1])


def spread(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... count[0] numbers, then the same of the next ones."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + count, count)


def same_bytes(data: np.ndarray, start: np.ndarray, lens: np.ndarray, other: np.ndarray) -> bool:
    """Whether each stretch has the bytes of the stretch whose number other gives."""
    return bool((lens[other] == lens).all()) and bool((data[spread(start[other], lens)] == data).all())


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of int): the ids of every whole text; null and empty texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for rows, data, bounds in columns(batch):
                ids, counts = t.encode_all(data, bounds)
                yield pa.RecordBatch.from_arrays([pa.array(ids_of(batch, rows)), pa.array(counts), listed(ids, counts)], names=["doc_id", "n_tokens", "ids"])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def listed(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from doc_id, ids; bytes that are no UTF-8 become U+FFFD, null ids an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in small(batches):
            lists = batch.column("ids")
            counts = np.asarray(lists.value_lengths().fill_null(0), np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            texts = [x.decode("utf-8", "replace") for x in t.decode_all(ids, counts)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encoded(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with_ids, ids: encodes every whole text and decodes the ids again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        for batch in batches:
            for rows, data, bounds in columns(batch):
                ids, counts = t.encode_all(data, bounds)
                ends = (4 * np.concatenate([[0], np.cumsum(counts)])).tolist()
                raw = memoryview(ids.tobytes())
                ids_sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)]
                text_sha = [hashlib.sha256(valid(x)).hexdigest() for x in t.decode_all(ids, counts)]
                cols = [pa.array(ids_of(batch, rows)), pa.array(counts), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
                if with_ids:
                    cols.append(listed(ids, counts))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(cols)])

    return documents(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)


def valid(data: bytes) -> bytes:
    return data.decode("utf-8", "replace").encode()


def small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def vocabulary() -> str:
    """The vocabulary file that the query uses."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)
