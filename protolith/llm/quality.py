"""Quality scores from a generalised additive model with pairwise interactions.

Every feature has a lookup table over its bins, and the most useful pairs of
features have one over both. Shallow trees, boosted in cycles over the
features and then over the pairs, fill the tables; a score is a sum of table entries, taken for
a whole batch at once, through the logistic function.

The model is small and fitted on the driver from at most ``TRAIN_ROWS``
labelled rows, whose features (never their texts) are collected.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The bound of the fitting sample, taken by hash over all labelled rows.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 12, 150, 60, 0.15
THRESHOLD = 0.3

FEATURES = (
    "chars", "words", "word_length", "distinct_words", "top_word", "repeated_triples", "lines", "line_length", "repeated_lines",
    "short_lines", "upper", "digits", "non_ascii", "bangs", "bars", "symbols", "stops", "commas", "slashes", "quotes",
    "brackets", "underscores", "long_words", "title_words", "function_words", "spaces",
)
# Frequent function words of a few languages.
COMMON = frozenset("the of and to in a is that it for on was be with as by this de la le les des et en un une du que qui dans pour el los las y del se con por der die das und ist nicht ein eine zu den mit von auf".split())


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[[ord(c) for c in chars]] = 1
    return out


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_HIGH = (np.arange(256) >= 128).astype(np.int64)
_CLASSES = np.stack([_UPPER, _DIGIT, _HIGH, _class("!"), _class("|"), _class("#$%&*@^~+="), _class(".?;:"), _class(","), _class("/\\"), _class("\"'"), _class("()[]{}<>"), _class("_"), _class(" \t\n\r")])


def features(text: str | None) -> np.ndarray:
    """The values of ``FEATURES``, over the whole text; an empty or null text has zeros."""
    out = np.zeros(len(FEATURES))
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return out
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    counts: dict = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    n, m = max(1, len(words)), max(1, len(lines))
    triples = max(1, len(words) - 2)
    kinds = _CLASSES @ np.bincount(raw, minlength=256) / len(raw)
    out[:10] = (
        np.log1p(len(raw)), np.log1p(len(words)), sum(map(len, words)) / n, len(counts) / n, max(counts.values(), default=0) / n,
        1 - len(set(zip(words, words[1:], words[2:], strict=False))) / triples if len(words) > 2 else 0, np.log1p(len(lines)), np.log1p(len(raw) / m),
        1 - len(set(lines)) / m, sum(len(x) < 40 for x in lines) / m,
    )
    out[10:22] = kinds[:12]
    out[22] = sum(len(w) > 18 for w in words) / n
    out[23] = sum(c for w, c in counts.items() if w.istitle()) / n
    out[24] = sum(c for w, c in counts.items() if w.lower() in COMMON) / n
    out[25] = kinds[12]
    return out


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_edges: list[np.ndarray]
    pair_tables: list[np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of the rows of a feature matrix: one addition per table."""
        z = np.full(len(x), self.base)
        for k, t in enumerate(self.tables):
            z += t[np.searchsorted(self.edges[k], x[:, k], "right")]
        coarse = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.pair_edges)]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.zeros(0)


def _leaf(g: float, h: float) -> float:
    return g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """A step function over bins: the best split, and the best split of either part."""
    best, at = g.sum() ** 2 / (h.sum() + 1), None
    if depth and len(g) > 1:
        gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gain = gl**2 / (hl + 1) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1)
        k = int(gain.argmax())
        if gain[k] > best + 1e-9:
            at = k + 1
    if at is None:
        return np.full(len(g), _leaf(g.sum(), h.sum()))
    return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of both features."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(g)
    for i in range(g.shape[0] - 1):
        for j in range(g.shape[1] - 1):
            corner = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])  # noqa: B023, E731
            gs, hs = corner(cg), corner(ch)
            gain = sum(a * a / (b + 1) for a, b in zip(gs, hs, strict=True))
            if gain > best:
                leaf = [_leaf(a, b) for a, b in zip(gs, hs, strict=True)]
                best = gain
                out = np.empty_like(g)
                out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on features ``x`` and labels ``y`` (0 or 1). Without rows every score is one half."""
    d = len(FEATURES)
    base = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges, coarse = [_edges(x[:, k], BINS) for k in range(d)], [_edges(x[:, k], PAIR_BINS) for k in range(d)]
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges], [], coarse, [])
    if len(y) == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(edges)]
    z = np.full(len(y), base)
    push = lambda: (y - (p := 1 / (1 + np.exp(-z))), p * (1 - p))
    for _ in range(ROUNDS):
        for k in range(d):
            g, h = push()
            size = len(edges[k]) + 1
            step = RATE * _tree(np.bincount(bins[k], g, size), np.bincount(bins[k], h, size))
            model.tables[k] += step
            z += step[bins[k]]
    cells = [np.searchsorted(e, x[:, k], "right") for k, e in enumerate(coarse)]
    g, h = push()

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        m = len(coarse[b]) + 1
        return np.bincount(cells[a] * m + cells[b], v, (len(coarse[a]) + 1) * m).reshape(-1, m)

    ranked = sorted(combinations(range(d), 2), key=lambda p: -_quadrants(grid(*p, g), grid(*p, h))[0])
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            g, h = push()
            step = RATE * _quadrants(grid(a, b, g), grid(a, b, h))[1]
            t += step
            z += step[cells[a], cells[b]]
    return model


def held_out(id_col: str, folds: int = 5, fold: int = 0) -> Column:
    """Rows whose labels are never learned; rows without an id are among them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(True))


def _matrix(b: pa.Array) -> np.ndarray:
    return np.stack([features(t) for t in b.to_pylist()]) if len(b) else np.zeros((0, len(FEATURES)))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``rows`` labelled documents outside the held-out fold. Null labels are not used; a document labelled twice takes the lower label."""
    usable = labels.select(F.col(id_col).cast("long").alias("d"), F.col("quality").cast("int").alias("q")).where(~held_out("d") & F.col("q").isin(0, 1))
    sample = usable.groupBy("d").agg(F.min("q").alias("q")).orderBy(F.xxhash64("d"), "d").limit(rows)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(_matrix(b.column(2)).tolist(), pa.list_(pa.float64()))], names=["d", "q", "x"])

    # at most ``rows`` rows of two numbers are broadcast
    text = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"))
    found = text.join(F.broadcast(sample), "d").select("d", "q", "t").mapInArrow(run, "d long, q int, x array<double>")
    got = sorted((r.d, r.q, r.x) for r in found.groupBy("d").agg(F.min("q").alias("q"), F.min("x").alias("x")).collect())
    return fit(np.array([r[2] for r in got]).reshape(-1, len(FEATURES)), np.array([r[1] for r in got], float))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every row.

    Null and empty texts are scored as texts without words. Repeated rows are scored each; other
    columns are not read; an empty table gives an empty result.
    """

    def run(batches):
        for b in batches:
            s = model.score(_matrix(b.column(2)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long"), held_out(id_col), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score at least ``threshold``.

    Every row is judged by its own text: a null or empty one as a text without words, repeated rows and ids each.
    An empty table stays empty; without labels every score is one half, and all rows stay.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(_matrix(b.column(at))) >= threshold))

    return docs.mapInArrow(run, docs.schema)
