"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text is cut into bins; the logit of good quality is a constant plus one table entry a feature plus
one a chosen pair of features (coarser bins). Tables grow by cyclic boosting: feature by feature, round after round, a
shallow tree (three leaves by a Newton step each) is fitted to the logistic loss and added to the feature's table with
a small rate; then the pairs whose trees would gain most (four quadrants) are boosted the same way. Scoring is a
look-up and a sum of bins, for whole chunks of texts.

The model is fitted on at most `max_rows` labelled rows, taken by the hash of their id (a documented parameter), so
the sample and the tables, which are broadcast, have a bounded size. Scoring reads every text whole, without a shuffle.

Defined results: a null or empty text has the features of an empty text; without labelled rows every score is 0.5, with
rows of one class alone it is near that class; an id with several labels counts by the lowest, an id with several texts
by the one of the least features; null ids have no label; repeated documents each get their own row; input columns named as a result
column come back as <name>_input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import col, map_rows, table, utf8
from .words import SPACED, classes, find

LINES = classes(b"\n", lower=False)
FEATURES = ["log_bytes", "log_words", "word_bytes", "longest_word", "upper", "digit", "punctuation", "symbol", "bang", "bar", "line_breaks", "wide", "distinct_words", "repeated_neighbours", "distinct_lines", "words_a_line", "capital_words", "words_a_stop"]
MAX_ROWS, BINS, COARSE, ROUNDS, RATE, PAIRS = 20_000, 32, 8, 200, 0.1, 6
NEW = [T.StructField("features", T.ArrayType(T.FloatType())), T.StructField("score", T.DoubleType())]


def _mask(chars: bytes) -> np.ndarray:
    lut = np.zeros(256, bool)
    lut[list(chars)] = True
    return lut


UPPER, DIGIT, STOP = _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58))), _mask(b".?!")
PUNCTUATION, SYMBOL, WIDE = _mask(b".,;:?!'\"()-"), _mask(b"#$%&*+/<=>@[\\]^_`{|}~"), _mask(bytes(range(128, 256)))


def _distinct(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Distinct hashes of each document."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.bincount(doc[new], minlength=len(first) - 1)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, offsets = utf8(texts)
    docs, size = len(offsets) - 1, np.diff(offsets)

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask, dtype=np.int32)])[offsets])

    w, lines = find(texts, SPACED), find(texts, LINES)
    n_words, n_lines, doc = np.diff(w.first), np.diff(lines.first), w.doc
    length = (w.end - w.start).astype(float)
    longest = np.zeros(docs)
    np.maximum.at(longest, doc, length)
    again = np.bincount(doc[1:][(w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])], minlength=docs)
    capital = np.bincount(doc, UPPER[data[w.start]] if len(doc) else None, docs)
    words, each = np.maximum(n_words, 1), np.maximum(size, 1)
    share = [count(m[data]) / each for m in (UPPER, DIGIT, PUNCTUATION, SYMBOL, _mask(b"!"), _mask(b"|"), _mask(b"\n"), WIDE)]
    return np.column_stack([
        np.log1p(size), np.log1p(n_words), np.bincount(doc, length, docs) / words, longest, *share, _distinct(w.hash, w.first) / words, again / words,
        _distinct(lines.hash, lines.first) / np.maximum(n_lines, 1), n_words / np.maximum(n_lines, 1), capital / words, n_words / np.maximum(count(STOP[data]), 1),
    ]).astype(np.float32)


@dataclass
class Additive:
    """Cuts of each feature, its table by bin, and tables of pairs by coarse bins."""

    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    constant: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.constant)
        for j, (cut, held) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += held[np.searchsorted(cut, x[:, j], "right")]
        for (j, k), held in zip(self.pairs, self.pair_tables, strict=True):
            z += held[np.searchsorted(self.coarse[j], x[:, j], "right"), np.searchsorted(self.coarse[k], x[:, k], "right")]
        return z


def _steps(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g / (h + 1.0)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Best gain of one cut of bins with these sums, and its place."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    if not len(left_g):
        return 0.0, 0
    gain = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h) - _gain(g.sum(), h.sum())
    return float(gain.max()), int(gain.argmax()) + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A tree of at most three leaves over ordered bins: the value of each bin."""
    parts = [(0, len(g))]
    for _ in range(2):
        best = max(((*_cut(g[a:b], h[a:b]), a, b) for a, b in parts), key=lambda x: x[0])
        if best[0] <= 1e-9:
            break
        _, at, a, b = best
        parts = [p for p in parts if p != (a, b)] + [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = _steps(g[a:b].sum(), h[a:b].sum())
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Best four quadrants of a grid: gain and the value of each cell."""
    pad = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    sg, sh = pad(g), pad(h)
    n, m = g.shape
    best, value = 0.0, np.zeros_like(g)
    i, j = np.meshgrid(np.arange(1, n), np.arange(1, m), indexing="ij")
    four = lambda s: (s[i, j], s[n, j] - s[i, j], s[i, m] - s[i, j], s[n, m] - s[n, j] - s[i, m] + s[i, j])
    gains = sum(_gain(a, b) for a, b in zip(four(sg), four(sh), strict=True)) - _gain(sg[n, m], sh[n, m])
    if gains.size and gains.max() > 1e-9:
        best = float(gains.max())
        a, b = (int(x) + 1 for x in np.unravel_index(gains.argmax(), gains.shape))
        for rows in (slice(0, a), slice(a, n)):
            for cols in (slice(0, b), slice(b, m)):
                value[rows, cols] = _steps(g[rows, cols].sum(), h[rows, cols].sum())
    return best, value


def train(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, rate: float = RATE, n_pairs: int = PAIRS) -> Additive:
    quantiles = lambda n: [np.unique(np.quantile(x[:, j], np.arange(1, n) / n)) if len(x) else np.zeros(0) for j in range(x.shape[1])]
    model = Additive(quantiles(BINS), [], quantiles(COARSE))
    model.tables = [np.zeros(len(c) + 1) for c in model.cuts]
    if not len(x):
        return model
    p = (y.sum() + 0.5) / (len(y) + 1)
    model.constant = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return model
    z = np.full(len(x), model.constant)
    fine = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.cuts)]
    rough = [np.searchsorted(c, x[:, j], "right") for j, c in enumerate(model.coarse)]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for j, at in enumerate(fine):
            g, h = slopes()
            step = rate * _tree(np.bincount(at, g, len(model.tables[j])), np.bincount(at, h, len(model.tables[j])))
            model.tables[j] += step
            z += step[at]

    def grid(j: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = (len(model.coarse[j]) + 1, len(model.coarse[k]) + 1)
        at = rough[j] * shape[1] + rough[k]
        g, h = slopes()
        return at, *(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    chances = sorted(((_quadrants(*grid(j, k)[1:])[0], j, k) for j in range(len(fine)) for k in range(j)), reverse=True)
    model.pairs = [(j, k) for gain, j, k in chances[:n_pairs] if gain > 0]
    model.pair_tables = [np.zeros((len(model.coarse[j]) + 1, len(model.coarse[k]) + 1)) for j, k in model.pairs]
    for _ in range(rounds // 4):
        for n, (j, k) in enumerate(model.pairs):
            at, g, h = grid(j, k)
            step = rate * _quadrants(g, h)[1]
            model.pair_tables[n] += step
            z += step.ravel()[at]
    return model


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", rows: Column | None = None, max_rows: int = MAX_ROWS, **options) -> Additive:
    """From labelled rows that `rows`, a condition on id_col, admits; max_rows of them at most."""
    rows = F.lit(True) if rows is None else rows
    marks = labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull() & rows).groupBy(col(id_col).alias("id")).agg(F.min(col(label_col)).alias("label"))
    marks = marks.orderBy(F.xxhash64("id", F.lit(9)), "id").limit(max_rows)
    own = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(marks), "id")  # bounded by max_rows
    seen = map_rows(own, ["id", "label"], "text", NEW[:1], lambda texts: [list(features(texts))])
    held = seen.groupBy("id").agg(F.min(F.struct("label", "features")).alias("r")).orderBy(F.xxhash64("id", F.lit(9)), "id").select("r.*").toArrow()
    x = np.array(held.column("features").to_pylist(), np.float32).reshape(-1, len(FEATURES))
    return train(x, (held.column("label").to_numpy() > 0).astype(float), **options)


def score(docs: DataFrame, model: Additive, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """`keep` columns (all, if None), features and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: tables of BINS and COARSE^2 entries

    def work(texts: pa.Array) -> list:
        x = features(texts)
        return [list(x), 1 / (1 + np.exp(-np.clip(shared.value.logit(x), -60, 60)))]

    return map_rows(docs, docs.columns if keep is None else keep, text_col, NEW, work)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, of = table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 4
    made = score(docs, fit(docs, table(spark, sf_dir, "labels"), rows=of != 2), ["doc_id"])
    return made.select("doc_id", F.coalesce(of == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
