"""Language identification by hierarchical discrimination.

A linear support vector machine per language family picks the family; inside it,
one machine for each pair of languages votes. The features are letter
trigrams of the whole text, hashed over its lower-cased UTF-8 bytes with numpy.

The machines are fitted on the driver from a bounded sample: ``PER_LANGUAGE``
documents of every language, each as a whole and as
two short pieces, so that short texts are known as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .quality import held_out

PER_LANGUAGE, DIM = 400, 2048
#: Bytes of a text that are counted at once.
STEP = 1 << 20
UNKNOWN = "und"
# Languages of each family, by ISO 639 code. Codes that are not listed are a family together.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be bg mk sr hr bs sl cs sk pl",
    "turkic": "tr az kk ky uz tt tk",
    "uralic": "fi et hu",
    "indic": "hi bn ur pa gu mr ne si",
    "sinitic": "zh yue wuu",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def trigrams(text: str) -> np.ndarray:
    """A unit vector of damped trigram counts; bytes that are not letters count as blanks."""
    raw = b" " + b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_BLANK).split()) + b" "
    whole, counts = np.frombuffer(raw, np.uint8), np.zeros(DIM)
    if len(whole) < 3:
        return counts.astype(np.float32)
    for at in range(0, len(whole) - 2, STEP):
        a = whole[at : at + STEP + 2].astype(np.uint32)
        code = (a[:-2] << 16) | (a[1:-1] << 8) | a[2:]
        counts += np.bincount((code * np.uint32(2654435761)) >> 21, minlength=DIM)
    v = np.sqrt(counts).astype(np.float32)
    return v / np.linalg.norm(v)


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 20.0, steps: int = 120) -> np.ndarray:
    """Linear machine with squared hinge loss and a bias, by accelerated gradient steps. y is -1 or 1."""
    w = v = np.zeros(x.shape[1] + 1, x.dtype)
    y, size = y.astype(x.dtype), weight.sum()
    weight, ridge = (weight / size).astype(x.dtype), np.append(np.full(x.shape[1], 1 / (c * size)), 0).astype(x.dtype)
    rate = 1 / (1 / c + 4.0)
    for t in range(steps):
        slack = np.maximum(0, 1 - y * (x @ v[:-1] + v[-1])) * y * weight
        new = v - x.dtype.type(rate) * (ridge * v - 2 * np.append(slack @ x, slack.sum()))
        v = new + x.dtype.type(t / (t + 3)) * (new - w)
        w = new
    return w


def _balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * len(y)


@dataclass
class Model:
    families: list[tuple[str, list[str]]]
    first: np.ndarray
    second: list[tuple[list[tuple[int, int]], np.ndarray]]

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """A language and a score between 0 and 1 for each text."""
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        at = [k for k, t in enumerate(texts) if t and _LETTER.search(t)] if self.families else []
        if not at:
            return names, scores
        x = np.stack([trigrams(texts[k]) for k in at])
        family, sure = np.zeros(len(at), int), np.ones(len(at))
        if len(self.families) > 1:
            z = x @ self.first[:, :-1].T + self.first[:, -1]
            family = z.argmax(1)
            sure = 1 / (1 + np.exp(-4 * z.max(1)))
        for f, (_, langs) in enumerate(self.families):
            mine = np.nonzero(family == f)[0]
            votes = np.zeros((len(mine), len(langs)))
            margin = np.zeros_like(votes)
            pairs, w = self.second[f]
            if pairs:
                z = x[mine] @ w[:, :-1].T + w[:, -1]
                for k, (a, b) in enumerate(pairs):
                    votes[:, a] += z[:, k] > 0
                    votes[:, b] += z[:, k] <= 0
                    margin[:, a] += z[:, k] / len(langs)
                    margin[:, b] -= z[:, k] / len(langs)
            best = (votes + 1e-3 * np.tanh(margin)).argmax(1)
            part = 1 / (1 + np.exp(-4 * margin[np.arange(len(mine)), best])) if pairs else 1.0
            scores[np.array(at)[mine]] = sure[mine] * part
            for m, k in zip(mine, best, strict=True):
                names[at[m]] = langs[k]
        return names, scores


def fit(x: np.ndarray, langs: list[str]) -> Model:
    known = sorted(set(langs))
    groups: dict[str, list[str]] = {}
    for code in known:
        groups.setdefault(_FAMILY.get(code.lower().split("-")[0], "other"), []).append(code)
    families = sorted(groups.items())
    lang = np.array(langs, dtype=object)
    of = np.array([next(k for k, (_, m) in enumerate(families) if code in m) for code in langs], int)
    sign = lambda mask: np.where(mask, 1.0, -1.0)
    first = np.array([_machine(x, y := sign(of == f), _balanced(y)) for f in range(len(families))]) if len(families) > 1 else np.zeros((0, x.shape[1] + 1))
    second = []
    for _, members in families:
        pairs = list(combinations(range(len(members)), 2))
        ws = []
        for a, b in pairs:
            rows = np.nonzero((lang == members[a]) | (lang == members[b]))[0]
            y = sign(lang[rows] == members[a])
            ws.append(_machine(x[rows], y, _balanced(y)))
        second.append((pairs, np.array(ws)))
    return Model(families, first, second)


def _samples(doc: int, text: str) -> list[np.ndarray]:
    """The whole text and two short pieces of it, at places that follow from the id."""
    words = text.split()
    out = [text]
    for size, salt in ((3, 7919), (12, 104729)):
        at = doc * salt % max(1, len(words) - size + 1)
        out.append(" ".join(words[at : at + size]))
    return [trigrams(t) for t in out if _LETTER.search(t)]


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, folds: int = 4, fold: int = 2) -> Model:
    """Fit from texts with a language outside the held-out fold.

    About ``per_language`` documents of each language are taken by a hash of the id, at most
    twice as many; every language is learned.
    """
    cols = docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l"))
    usable = cols.where(~held_out("d", folds, fold) & F.col("l").isNotNull() & (F.col("l") != UNKNOWN) & F.col("t").isNotNull())
    counts = usable.groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").collect()
    if not counts:
        return Model([], np.zeros((0, DIM + 1)), [])
    share = F.create_map(*(F.lit(v) for r in counts for v in (r.l, min(1.0, 1.5 * per_language / r.n))))
    draw = F.pmod(F.xxhash64("d", F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    chosen = usable.where(draw < share[F.col("l")])

    def run(batches):
        for b in batches:
            rows = [(d, lang, v.tobytes()) for d, lang, t in zip(*(c.to_pylist() for c in b.columns), strict=True) for v in _samples(d, t)]
            yield pa.RecordBatch.from_pylist([{"d": d, "l": lang, "x": v} for d, lang, v in rows], pa.schema([("d", pa.int64()), ("l", pa.string()), ("x", pa.binary())]))

    bound = 6 * per_language * len(counts)
    found = chosen.select("d", "l", "t").mapInArrow(run, "d long, l string, x binary").orderBy(F.xxhash64("d"), "l", "x").limit(bound).collect()
    return fit(np.array([np.frombuffer(r.x, np.float32) for r in found]).reshape(-1, DIM), [r.l for r in found])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", folds: int = 4, fold: int = 2) -> DataFrame:
    """``doc_id``, ``held_out``, ``lang_pred`` and ``score`` of every row.

    Texts that are null or have no letter are ``und`` with score 0, as are all if nothing was
    learned. Repeated rows are predicted each; other columns are not read; an empty table gives an
    empty result.
    """

    def run(batches):
        for b in batches:
            names, scores = model.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long"), held_out(id_col, folds, fold), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
