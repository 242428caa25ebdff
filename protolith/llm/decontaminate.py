"""Benchmark decontamination by latent semantic retrieval.

Terms of the benchmark get TF-IDF weights from document counts over the whole corpus.
Items are cut into passages of about a window. For each ``ROWS`` passages a randomised SVD of all corpus passages, of which the executors make one matrix of how
terms occur together, gives a latent basis with as many dimensions, which holds those passages. Windows of the
documents are projected and compared by cosine with the passages; candidates are
checked, where they are found, by the longest common subsequence of words and by
the item's answer.

An inverted index of each item's rarer words says which windows and items are worth a
comparison. It loses nothing: half of an item's words in order cannot be found where
fewer of its rarer words stand than that half must hold.

The corpus is never shuffled: all passes over it are maps, and what comes back is
a count per benchmark term, the matrices, whose size depends on the benchmark alone, and the leaks themselves.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, without, written

#: Passages of items searched in one pass, and rows of one latent space.
ITEMS, ROWS = 4000, 256
#: Least latent dimensions, where rows are fewer; least share of a row's energy in the basis.
RANK, KEPT = 192, 0.8
#: Numbers of the matrices that are made in one pass, and of a piece of one that is sent.
GRAM, PIECE = 1 << 23, 1 << 17
#: Words of a block; a window is two blocks. So many words are searched at once.
BLOCK, SLICE = 16, 1 << 18
#: Characters of texts that are read at once; odd numbers of the words' hash and of its place in a table.
CHARS, ODD, MIX = 1 << 19, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Share of an item's words, the rarest, that the inverted index holds.
RARE = 0.6
#: Least cosine of a candidate; least share of an item's words in order, alone and with its answer found.
COSINE, COMMON, COMMON_ANSWERED = 0.25, 0.6, 0.5
_WORD, _OTHER = re.compile(r"\w+"), re.compile(r"\W")


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def answer(text: str | None) -> list[str]:
    """The words of an item's answer: what follows its last question mark, else its last sentence of three words or more."""
    head, mark, tail = (text or "").rpartition("?")
    if mark and len(words(tail)) > 0:
        return words(tail)
    parts = [p for p in map(words, re.split(r"[.!?\n]+", text or "")) if len(p) >= 3]
    return parts[-1] if parts else words(text)


def pieces(item: list[str]) -> list[list[str]]:
    """An item in passages of about a window, each of which makes the item a candidate."""
    count = max(1, round(len(item) / (2 * BLOCK)))
    edges = [k * len(item) // count for k in range(count + 1)]
    return [item[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel dynamic programming."""
    full, masks = (1 << len(a)) - 1, {}
    for k, w in enumerate(a):
        masks[w] = masks.get(w, 0) | 1 << k
    row = full
    for w in b:
        if (m := masks.get(w)) is not None:
            hit = row & m
            row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@lru_cache(1)
def _lowered() -> np.ndarray:
    """The lower-case code point of each character of a word, 0 for any other character."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalnum() or x == "_":
            out[c] = ord(x.lower()[0])
    return out


_made: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    """``size`` powers of ``base`` modulo 2^64 from the 0th on; a worker keeps the longest run."""
    if len(_made.get(base, ())) < size:
        out = np.full(1 << max(16, (size - 1).bit_length()), base, np.uint64)
        out[0] = 1
        _made[base] = np.cumprod(out, dtype=np.uint64)
    return _made[base][:size]


class Reader:
    """Term ids of whole texts. A slice of a column is one array of code points: words are its runs of word
    characters, and a sum of code points times powers of an odd number, modulo 2^64, is looked up as a word's hash."""

    def __init__(self, vocab: dict[str, int]):
        self.shift, self.hash = np.uint64(64 - max(10, (8 * len(vocab)).bit_length())), np.zeros(0, np.uint64)
        self.slot = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        known = sorted(vocab, key=vocab.get)
        if known:
            self.hash = self._hashes("\0".join(known))[0]
            if len(np.unique(self.hash)) < len(known):
                raise ValueError("two words have one hash")
        for k, at in enumerate(self._slots(self.hash).tolist()):
            while self.slot[at] >= 0:
                at = (at + 1) % len(self.slot)
            self.slot[at] = k

    def _slots(self, h: np.ndarray) -> np.ndarray:
        return ((h * np.uint64(MIX)) >> self.shift).astype(np.int64)

    @staticmethod
    def _hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each word, and where it starts."""
        low = _lowered()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        edge = np.flatnonzero(np.diff(np.r_[False, low != 0, False]))
        total = np.r_[np.uint64(0), np.cumsum(low * _powers(ODD, len(low)), dtype=np.uint64)]
        begin, end = edge[::2], edge[1::2]
        return (total[end] - total[begin]) * _powers(pow(ODD, -1, 1 << 64), len(low))[begin], begin

    def _ids(self, h: np.ndarray) -> np.ndarray:
        at = self._slots(h)
        out = self.slot[at]
        wrong = np.flatnonzero(out >= 0)
        wrong = wrong[self.hash[out[wrong]] != h[wrong]]
        while len(wrong):  # the next slots, until a word or a gap is met
            at[wrong] = (at[wrong] + 1) % len(self.slot)
            out[wrong] = self.slot[at[wrong]]
            wrong = wrong[out[wrong] >= 0]
            wrong = wrong[self.hash[out[wrong]] != h[wrong]]
        return out

    def slices(self, column: pa.Array):
        """(first row, ids of all words one after another with -1 for other words, where each row starts and the end), of at most ``CHARS`` unless one text is longer."""
        held, size, low = [], 0, 0
        for k, text in enumerate(column.to_pylist()):
            text = text or ""
            if "\u0130" in text or "\u03a3" in text:  # the characters whose lower case is longer or depends on what follows
                text = text.lower()
            if held and size + len(text) > CHARS:
                yield low, *self._read(held)
                held, size, low = [], 0, k
            held.append(text)
            size += len(text)
        if held:
            yield low, *self._read(held)

    def _read(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(texts) > 1 or len(texts[0]) <= CHARS:
            h, begin = self._hashes("\0".join(texts))
            starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
            return self._ids(h), np.searchsorted(begin, starts)
        text, found, at = texts[0], [], 0
        while at < len(text):  # a long text is cut between words
            cut = _OTHER.search(text, min(at + CHARS, len(text)))
            end = cut.start() if cut else len(text)
            found.append(self._ids(self._hashes(text[at:end])[0]))
            at = end
        ids = np.concatenate(found)
        return ids, np.array([0, len(ids)])


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[k] .. first[k] + count[k] - 1 of all k, one after another."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - count), count)


@dataclass
class Part:
    """Rows of some items in a latent space of their own, which has about as many dimensions as rows."""

    of: list[int]  # item of each row, which is a passage of it
    local: np.ndarray  # term of the part for each term of the index, or -1; one more, for words that are no term
    mass: np.ndarray  # squared weight of each term of the part
    #: (term, row): the product of the term's latent vector with the row's, over the row's length. A window's latent
    #: vector is a sum over its words, so its product with a row is the sum of these.
    score: np.ndarray

    def __post_init__(self):
        self.item = np.array(self.of)
        self.order = np.argsort(self.item, kind="stable")

    def windows(self, item: np.ndarray, begin: np.ndarray, end: np.ndarray, origin: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(region, first word, cosine) of windows of the regions that lie within the least cosine of a row of their item."""
        low = np.searchsorted(self.item[self.order], item, "left")
        rows = np.searchsorted(self.item[self.order], item, "right") - low
        region = np.repeat(np.arange(len(item)), rows)
        row = self.order[spread(low, rows)]
        size = (end - begin)[region]
        out = []
        for some in np.array_split(np.arange(len(region)), max(1, int(size.sum()) >> 19)):
            pair = np.repeat(some, size[some])
            at = spread(begin[region[some]], size[some])
            own = self.local[ids[at]]
            held = np.flatnonzero(own >= 0)
            if not len(held):
                continue
            pair, own = pair[held], own[held]
            block = (at[held] - origin[region[pair]]) // BLOCK
            first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (pair[1:] != pair[:-1])])
            both = np.add.reduceat(self.score[own, row[pair]], first, dtype=np.float64)
            mass = np.add.reduceat(self.mass[own], first, dtype=np.float64)
            pair, block = pair[first], block[first]
            next_ = np.flatnonzero((pair[1:] == pair[:-1]) & (block[1:] == block[:-1] + 1))
            more, more_mass = both[next_ + 1], mass[next_ + 1]
            both[next_] += more
            mass[next_] += more_mass
            cosine = both / np.sqrt(mass)
            near = np.flatnonzero(cosine >= COSINE)
            out.append((region[pair[near]], origin[region[pair[near]]] + block[near] * BLOCK, cosine[near]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(map(np.concatenate, zip(*out, strict=True)))


class Index:
    """Items of one block, in parts, behind an inverted index of their rarer words."""

    def __init__(self, ids: list, texts: list[list[str]], answers: list[list[str]], vocab: dict[str, int], weight: np.ndarray, parts: list[Part]):
        self.ids, self.vocab, self.parts = ids, vocab, parts
        self.texts, self.answers = ([[vocab[w] for w in t] for t in x] for x in (texts, answers))
        self.size = np.array([len(t) for t in texts])
        self.span = 2 * self.size + 2 * BLOCK  # words around a window that are searched for an item
        self.need = np.zeros(len(texts), np.int64)  # rarer words that stand in them if half of an item does
        pairs = []
        for k, t in enumerate(self.texts):
            held, n = Counter(t), 0
            for w in sorted(held, key=lambda w: (-weight[w], w)):
                if n >= RARE * len(t):
                    break
                pairs.append((w, k))
                n += held[w]
            self.need[k] = max(1, math.ceil(COMMON_ANSWERED * len(t)) + n - len(t))
        term, self.item = np.array(sorted(pairs), np.int64).reshape(-1, 2).T
        self.count = np.bincount(term, minlength=len(vocab) + 1)  # the last, which -1 picks, has none
        self.first = np.cumsum(self.count) - self.count
        self.read = Reader(vocab)

    def leaks(self, text: str | None) -> list[tuple]:
        return [r[1:] for r in self.search(pa.array([text], pa.string()))]

    def search(self, column: pa.Array) -> list[tuple]:
        """(row, item, cosine, share of its words in order, whether its answer is there, first word) of each leaked item of each text."""
        return [(low + d, self.ids[k], *v) for low, ids, starts in self.read.slices(column) for (d, k), v in sorted(self._found(ids, starts).items())]

    def _found(self, ids: np.ndarray, starts: np.ndarray) -> dict[tuple[int, int], tuple]:
        best: dict[tuple[int, int], tuple] = {}
        for low in range(0, len(ids), SLICE):  # windows of bounded memory, each with what may follow
            high = low + SLICE + int(self.span.max())
            pos = low + np.flatnonzero(self.count[ids[low:high]])
            if not len(pos):
                continue
            item, doc, begin, end = self._near(pos, ids, starts)
            cosines: dict[tuple[int, int, int], float] = {}
            for p in self.parts:
                for r, w, c in zip(*(x.tolist() for x in p.windows(item, begin, end, starts[doc], ids)), strict=True):
                    key = (int(doc[r]), int(item[r]), w)
                    cosines[key] = max(c, cosines.get(key, 0.0))
            for (d, k, w), c in sorted(cosines.items()):
                self._compare(d, k, w, c, ids, starts, best)
        return best

    def _near(self, pos: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """(item, document, from, to) of the regions where windows of the item may lie, by its rarer words at ``pos``."""
        each = self.count[ids[pos]]
        item = self.item[spread(self.first[ids[pos]], each)]
        order = np.argsort(item, kind="stable")
        item, at = item[order], np.repeat(pos, each)[order]
        doc = np.searchsorted(starts, at, "right") - 1
        last = np.arange(len(item)) + self.need[item] - 1
        some = np.flatnonzero(last < len(item))
        last = last[some]
        some = some[(item[last] == item[some]) & (doc[last] == doc[some]) & (at[last] - at[some] < self.span[item[some]])]
        last = some + self.need[item[some]] - 1
        item, doc, n = item[some], doc[some], self.size[item[some]]
        origin = starts[doc]
        begin = np.maximum(origin, origin + ((at[last] - origin - n) // BLOCK - 2) * BLOCK)
        end = np.minimum(starts[doc + 1], origin + ((at[some] - origin + n) // BLOCK + 2) * BLOCK)
        # overlapping regions of an item are one: both ends only grow
        new = np.r_[True, (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (begin[1:] > end[:-1])] if len(item) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        return item[head], doc[head], begin[head], end[np.r_[head[1:], len(item)] - 1] if len(item) else end

    def _compare(self, d: int, k: int, a: int, cosine: float, ids: np.ndarray, starts: np.ndarray, best: dict) -> None:
        item, was = self.texts[k], best.get((d, k))
        if was and was[1] == 1:
            return
        begin = max(int(starts[d]), a - len(item))
        near = ids[begin : min(int(starts[d + 1]), a + 2 * BLOCK + len(item))].tolist()
        # no more words can be common in order than occur at all
        if sum(map(set(near).__contains__, item)) < COMMON_ANSWERED * len(item):
            return
        share = common_length(item, near) / len(item)
        if share < COMMON_ANSWERED or was and share <= was[1]:
            return
        reply = self.answers[k]
        told = common_length(reply, near) >= 0.8 * len(reply)
        if share >= COMMON or told:
            best[d, k] = (cosine, share, told, begin - int(starts[d]))


def _counts(docs: DataFrame, vocab: dict[str, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each term, and all documents. One row per partition and term meets in an aggregation."""

    def run(batches):
        held, total, read = np.zeros(len(vocab), np.int64), 0, Reader(vocab)
        for b in batches:
            total += b.num_rows
            for _, ids, starts in read.slices(b.column(0)):
                doc = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[ids >= 0]
                once = np.unique(doc * len(vocab) + ids[ids >= 0])
                held += np.bincount(once % len(vocab), minlength=len(vocab))
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[held[some], total])], names=["term", "n"])

    rows = docs.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(len(vocab)), 0
    for r in rows:
        if r.term < 0:
            total = r.n
        else:
            out[r.term] = r.n
    return out, total


def _triangle(n):
    """Numbers in a lower triangle of ``n`` rows, which are packed one after another."""
    return n * (n + 1) // 2


def _add_pairs(out: np.ndarray, t: np.ndarray, w: np.ndarray, row: np.ndarray) -> None:
    """Add L to a packed lower triangle, where L + L' is A'A and A has the weights ``w`` at terms ``t`` of its rows; those of a row stand together."""
    start = _triangle(t)
    np.add.at(out, start + t, w * w / 2)
    for d in range(1, len(t)):
        near = np.flatnonzero(row[d:] == row[:-d])
        if not len(near):
            return
        a, b = t[near], t[near + d]
        np.add.at(out, np.where(a > b, start[near] + b, start[near + d] + a), w[near] * w[near + d])


def _grams(docs: DataFrame, vocab: dict[str, int], parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each part, (its term or -1 for each of the vocabulary, weights of its terms), A'A over every passage of the corpus, as ``_add_pairs`` packs it.

    A is never made. A task sends what it added up, so there are no more tasks than cores, however many partitions there are.
    """
    sizes = [_triangle(len(w)) for _, w in parts]
    local = [np.append(x, np.int32(-1)) for x, _ in parts]

    def run(batches):
        read, totals = Reader(vocab), [np.zeros(n) for n in sizes]
        for b in batches:
            for _, ids, starts in read.slices(b.column(0)):
                count = np.diff(starts)
                passages = -(-count // (2 * BLOCK))
                row = np.repeat(np.cumsum(passages) - passages, count) + spread(np.zeros(len(count), np.int64), count) // (2 * BLOCK)
                high = 0
                while high < len(ids):  # whole passages of bounded memory
                    low, high = high, int(np.searchsorted(row, row[min(high + SLICE, len(ids)) - 1], "right"))
                    for total, own, (_, weight) in zip(totals, local, parts, strict=True):
                        t = own[ids[low:high]].astype(np.int64)
                        held = np.flatnonzero(t >= 0)
                        if not len(held):
                            continue
                        t, r = t[held], row[low + held]
                        r -= r[0]
                        _add_pairs(total, t, weight[t] / np.sqrt(np.bincount(r, weight[t] ** 2))[r], r)
        for k, total in enumerate(totals):
            for first in range(0, len(total), PIECE):
                yield from sent(k, first, total[first : first + PIECE])

    def sent(k: int, first: int, total: np.ndarray):
        at = np.flatnonzero(total).astype(np.int32)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([first], pa.int64()), pa.array([at.tobytes()], pa.binary()), pa.array([total[at].tobytes()], pa.binary())], names=["part", "first", "at", "sum"])

    def add(batches):
        totals: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, first, at, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                totals.setdefault((k, first), np.zeros(PIECE))[np.frombuffer(at, np.int32)] += np.frombuffer(value)
        for (k, first), total in totals.items():
            yield from sent(k, first, total)

    schema = "part int, first long, at binary, sum binary"
    some = docs.coalesce(docs.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema)
    out = [np.zeros(n) for n in sizes]
    for r in some.repartition(8, "part", "first").mapInArrow(add, schema).toLocalIterator():
        out[r.part][r.first + np.frombuffer(r.at, np.int32)] += np.frombuffer(r["sum"])
    return out


def _times(low: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(L + L') q of a packed lower triangle; some of its rows are unpacked at once."""
    out = np.zeros_like(q)
    for a in range(0, len(q), 256):
        b = min(len(q), a + 256)
        rows = np.zeros((b - a, b))
        for k in range(a, b):
            rows[k - a, : k + 1] = low[_triangle(k) : _triangle(k + 1)]
        out[a:b] += rows @ q[:b]
        out[:b] += rows.T @ q[a:b]
    return out


def _basis(gram: np.ndarray, own: np.ndarray, rank: int) -> np.ndarray:
    """Leading right singular vectors of the weighted passages, given by A'A, and of ``own``, the part's rows of length one, by two rounds of subspace iteration.

    Of a row whose energy is not kept in them, what is missing becomes a direction too: at least ``KEPT`` of
    each row's is in the basis, however many there are, so an exact copy keeps as much of its cosine.
    """
    # rows of the part count as often as the corpus, so the basis spans them
    terms = own.shape[1]
    often = max(1.0, 2 * gram[_triangle(np.arange(1, terms + 1)) - 1].sum() / len(own))
    product = lambda q: _times(gram, q) + often * (own.T @ (own @ q))
    q = np.linalg.qr(np.random.RandomState(5).standard_normal((terms, min(terms, rank + 8))))[0]
    for _ in range(2):
        q = np.linalg.qr(product(q))[0]
    values, vectors = np.linalg.eigh(q.T @ product(q))
    basis = q @ vectors[:, np.argsort(-values)[:rank]]
    missing = own - own @ basis @ basis.T
    _, size, more = np.linalg.svd(missing[(missing**2).sum(1) > 1 - KEPT], full_matrices=False)
    return np.c_[basis, more[size > 1e-6].T]


def _parts(docs: DataFrame, vocab: dict[str, int], weight: np.ndarray, passages: list[tuple[int, list[str]]], rank: int) -> list[Part]:
    """Latent spaces of ``ROWS`` passages each, or of fewer where their words make too large a matrix."""

    def fitting(some: list[tuple[int, list[str]]]) -> list:
        terms = np.unique([vocab[w] for _, t in some for w in t])
        if _triangle(len(terms)) <= GRAM or len(some) == 1:
            return [(some, terms)]
        return fitting(some[: len(some) // 2]) + fitting(some[len(some) // 2 :])

    out, held = [], []
    cuts = [x for some in np.array_split(np.arange(len(passages)), math.ceil(len(passages) / ROWS)) for x in fitting([passages[k] for k in some])]
    for some, terms in cuts:
        if held and sum(_triangle(len(x)) for _, x in [*held, (some, terms)]) > GRAM:
            out += _pass(docs, vocab, weight, held, rank)
            held = []
        held.append((some, terms))
    return out + _pass(docs, vocab, weight, held, rank)


def _pass(docs: DataFrame, vocab: dict[str, int], weight: np.ndarray, held: list[tuple[list, np.ndarray]], rank: int) -> list[Part]:
    """Parts of (passages, terms), by one pass over the corpus."""
    places = []
    for _, terms in held:
        local = np.full(len(vocab), -1, np.int32)
        local[terms] = np.arange(len(terms))
        places.append((local, weight[terms]))
    return [_part(gram, vocab, *place, some, rank) for gram, place, (some, _) in zip(_grams(docs, vocab, places), places, held, strict=True)]


def _part(gram: np.ndarray, vocab: dict[str, int], local: np.ndarray, weight: np.ndarray, passages: list[tuple[int, list[str]]], rank: int) -> Part:
    own = np.zeros((len(passages), len(weight)))
    for k, (_, t) in enumerate(passages):
        np.add.at(own[k], at := local[[vocab[w] for w in t]], weight[at])
        own[k] /= np.sqrt((weight[at] ** 2).sum())
    unit = own / np.linalg.norm(own, axis=1, keepdims=True)
    basis = _basis(gram, unit, min(max(rank, len(passages)), len(weight)))
    score = (basis * weight[:, None]) @ (own @ basis).T
    return Part([k for k, _ in passages], local, weight**2, score.astype(np.float32))


@dataclass
class Corpus:
    """What indexes of any items need of a corpus: how many documents hold a word."""

    vocab: dict[str, int]
    held: np.ndarray
    total: int


def survey(docs: DataFrame, vocab: set[str]) -> Corpus:
    """One pass over all texts (column ``t``) for counts."""
    known = {w: k for k, w in enumerate(sorted(vocab))}
    held, total = _counts(docs, known)
    return Corpus(known, held, total)


def build_index(docs: DataFrame, items: list[tuple], rank: int = RANK, corpus: Corpus | None = None) -> Index | None:
    """An index of (id, text) items; ``docs`` has the text in column ``t``. None if no item has a word."""
    items = [(k, t) for k, t in items if words(t)]
    if not items:
        return None
    texts = [words(t) for _, t in items]
    own = {w for t in texts for w in t}
    corpus = corpus or survey(docs, own)
    # every term weighs something: copies of an item may be so many that all its words are frequent
    weight = np.log((corpus.total + 1) / (corpus.held + 0.5)) + 1
    passages = [(k, p) for k, t in enumerate(texts) for p in pieces(t)]
    # the matrices are of these items' terms alone
    vocab = {w: k for k, w in enumerate(sorted(own))}
    at = np.array([corpus.vocab[w] for w in vocab])
    parts = _parts(docs, vocab, weight[at], passages, rank)
    for p in parts:
        p.local = np.append(p.local, np.int32(-1))
    return Index([k for k, _ in items], texts, [answer(t) for _, t in items], vocab, weight[at], parts)


SCHEMA = "doc_id long, item_id long, cosine double, common double, answer_found boolean, start_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it repeats or paraphrases.

    ``doc_id``, ``item_id``, ``cosine`` of the candidate window, ``common`` (share of the
    item's words in order near it), ``answer_found`` and ``start_word`` of the searched region.
    A leak has ``common`` >= 0.6, or >= 0.5 with the answer there.

    Null and empty texts hold nothing and match nothing; repeated rows are reported each; a
    null id is passed on. The items are searched in blocks of about ``ITEMS`` passages. Without documents or items the
    result is empty. Other columns are not read.
    """
    text = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    bench = benchmark.select(F.col(item_col).cast("long"), F.col(item_text_col).cast("string")).orderBy(item_col, item_text_col)
    vocab: set[str] = set()
    for r in bench.toLocalIterator():
        vocab.update(words(r[1]))
    if not vocab:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    corpus, done, block, held = survey(text.select("t"), vocab), [], [], 0

    def search(items: list[tuple]) -> DataFrame | None:
        index = build_index(text.select("t"), items, corpus=corpus)

        def run(batches):
            for b in batches:
                rows = index.search(b.column(1))
                doc = b.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, *(pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()), 1))], names=[x.split()[0] for x in SCHEMA.split(", ")])

        return text.mapInArrow(run, SCHEMA) if index else None

    for r in bench.toLocalIterator():
        if held >= ITEMS:
            # the driver holds one index at a time
            done += [written(found, "leaks")] if (found := search(block)) else []
            block, held = [], 0
        block.append((r[0], r[1]))
        held += len(pieces(words(r[1])))
    done += [found] if (found := search(block)) else []
    return reduce(DataFrame.unionByName, done)


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs``, with all columns, without the rows whose text repeats a benchmark item.

    Rows are told apart by a number of their own: ids may be null or repeated and are not read. Without
    documents or items ``docs`` is unchanged.
    """
    rows = numbered(docs)
    leaks = find_leaks(rows.select("uid", F.col("row").getField(text_col).alias("t")), benchmark, "uid", "t")
    return without(rows, leaks.select(F.col("doc_id").alias("uid")).distinct())
