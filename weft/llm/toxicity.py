"""Toxicity by class-conditional Kneser-Ney models.

A word's characters (UTF-8 bytes) are predicted from the ORDER - 1 before them, padded at the word's start, with an
end sign. Each class has its own counts of ORDER-grams; the weight of falling back from a context, and all lower orders,
Kneser-Ney continuation counts, are shared by both classes. So an expression that neither class knows says nothing,
whatever the classes' sizes, and one that is rare in a class falls back to what both know. A document's statistics are
length-normalised: the mean difference of the classes' log-likelihoods per sign, and the mean of what single words
have above each of TAILS nats, per word. A logistic function of these, fitted on rows kept from the counts, makes the score.

Counting runs over labelled rows, `train_rows` and `train_bytes` of text a class at most (documented parameters; rows
are taken by the hash of their id), so the model has a bounded size: at most one entry a byte counted. It is
broadcast. Scoring reads every text whole, without a shuffle; each distinct word of a chunk is scored once.

Defined results: a null or empty text, or one without words, has all statistics 0; without labelled rows of both
classes every score is the share of toxic ones among the labelled rows, or 0 without any; rows of an id with several
labels count as toxic if one says so; null ids have no label; repeated documents each get their own row; input columns
named as a result column come back as <name>_input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import ship
from .base import col, map_rows, once, table, utf8_chunks
from .words import ALNUM, HashTable, Words, find, mix

ORDER, DISCOUNT, TAILS, LEAST_TAIL = 6, 0.75, (1.0, 2.0, 3.5, 5.0), 0.003
#: Labelled rows and bytes of their text a class, for the counts and for the logistic function each.
TRAIN_ROWS, TRAIN_BYTES = 8192, 8 << 20
END, START = 1, 2
STATISTICS = ["gap", *(f"tail_{k}" for k in range(len(TAILS)))]
NEW = [T.StructField(c, T.DoubleType()) for c in (*STATISTICS, "score")]


def signs(w: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ORDER-grams of the given words, one a character and one for the end, and the number of them by word."""
    size = (w.end - w.start)[at] + 1
    ends = np.cumsum(size)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
    here = np.repeat(w.start[at], size) + place
    last = place == np.repeat(size - 1, size)
    low = np.append(w.low, 0)
    sign = np.where(last, END, low[np.minimum(here, len(w.low))]).astype(np.uint64)
    keys = sign.copy()
    for k in range(1, ORDER):
        keys |= np.where(place >= k, low[np.maximum(here - k, 0)], START).astype(np.uint64) << np.uint64(8 * k)
    return keys, size


def distinct(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct word, and the number of the distinct word at each place."""
    _, at, number = np.unique(w.hash, return_index=True, return_inverse=True)
    return at, number


@dataclass
class Model:
    """log P(toxic model) - log P(ordinary model) of each ORDER-gram counted in either class; it is 0 for others."""

    grams: np.ndarray
    gap: np.ndarray
    weights: np.ndarray


def train(keys: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """From the distinct ORDER-grams and their counts in each class.

    Shared lower orders: P_k(s|h) by interpolated continuation counts over both classes, and the weight of falling back,
    w(h) = D * types(h) / c(h), likewise. For class c with the discounted counts d(hs) = (c(hs) - D)+ and their sum d(h),
    P(s|h) = (1 - w(h)) * d(hs) / d(h) + w(h) * P_k(s|h'), or P_k(s|h') where d(h) is 0.
    """
    order = np.argsort(keys)
    keys, toxic, ordinary = keys[order], toxic[order].astype(float), ordinary[order].astype(float)
    lower = np.full(1, 1 / 256)  # before any sign is known
    held: list[np.ndarray] = [keys]
    for k in range(ORDER - 1, 0, -1):
        held.append(np.unique(keys & np.uint64((1 << 8 * k) - 1)))
    below = np.zeros(1, np.int64)
    for k in range(1, ORDER):  # shared, from one sign on
        grams, above = held[ORDER - k], held[ORDER - k - 1]
        kinds = np.bincount(np.searchsorted(grams, above & np.uint64((1 << 8 * k) - 1)), minlength=len(grams)).astype(float)
        _, of = np.unique(grams >> np.uint64(8), return_inverse=True)
        total, types = np.bincount(of, kinds)[of], np.bincount(of)[of]
        below = np.searchsorted(held[ORDER - k + 1], grams & np.uint64((1 << 8 * (k - 1)) - 1)) if k > 1 else np.zeros(len(grams), np.int64)
        lower = np.maximum(kinds - DISCOUNT, 0) / total + DISCOUNT * types / total * lower[below]
    shared = lower[np.searchsorted(held[1], keys & np.uint64((1 << 8 * (ORDER - 1)) - 1))]
    _, of = np.unique(keys >> np.uint64(8), return_inverse=True)
    both, types = np.bincount(of, toxic + ordinary), np.bincount(of)
    rest = (DISCOUNT * types / both)[of]
    logs = []
    for count in (toxic, ordinary):
        held = np.maximum(count - DISCOUNT, 0)
        total = np.bincount(of, held)[of]
        logs.append(np.log(np.where(total > 0, (1 - rest) * held / np.where(total > 0, total, 1), (1 - rest) * shared) + rest * shared))
    return Model(keys, (logs[0] - logs[1]).astype(np.float32), np.zeros(len(STATISTICS) + 1))


def scorer(model: Model):
    """For chunks of texts: the statistics of each document."""
    grams = HashTable(mix(model.grams), model.gap)

    def work(texts: pa.Array) -> list[np.ndarray]:
        w = find(texts, ALNUM)
        at, number = distinct(w)
        keys, size = signs(w, at)
        slot = grams.find(mix(keys))
        gap = np.where(slot >= 0, grams.values[slot], 0).astype(np.float64)
        by_word = np.add.reduceat(gap, np.cumsum(size) - size) if len(size) else np.zeros(0)
        doc, docs = w.doc, len(w.first) - 1
        n_words, n_signs = np.bincount(doc, minlength=docs), np.bincount(doc, size[number], docs)
        total = np.bincount(doc, by_word[number], docs)
        tails = [np.bincount(doc, np.maximum(by_word - t, 0)[number], docs) / np.maximum(n_words, 1) for t in TAILS]
        return [total / np.maximum(n_signs, 1), *tails]

    return work


def scaled(x: list[np.ndarray]) -> list[np.ndarray]:
    """The statistics as the logistic function takes them: the logarithm of tails, as shares differ by magnitudes."""
    return [x[0], *(np.log(t + LEAST_TAIL) for t in x[1:])]


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Weights by Newton's method, the constant last; features are scaled inside."""
    mean, scale = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1)  # a constant feature has no part
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    weight = weight / weight.mean()
    b, damp = np.zeros(z.shape[1]), np.diag([ridge * len(x)] * x.shape[1] + [1e-9])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (weight * p * (1 - p) + 1e-9)[:, None]).T @ z + damp, z.T @ (weight * (y - p)) - damp @ b)
        b += np.clip(step, -5, 5)
    return np.append(b[:-1] / scale, b[-1] - (b[:-1] * mean / scale).sum())


def _thinned(rows: DataFrame, id_col: str, amounts: dict[int, float], limit: float, salt: int) -> tuple[DataFrame, dict[int, float]]:
    """Of each label's rows, by the hash of their id, the share that brings its amount down to the limit; the shares."""
    shares = {label: min(1.0, limit / max(1.0, n)) for label, n in amounts.items()}
    share = F.lit(0.0)
    for label, part in shares.items():
        share = F.when(F.col("label") == label, F.lit(part)).otherwise(share)
    return rows.filter(F.pmod(F.xxhash64(id_col, F.lit(salt)), F.lit(1 << 20)) < share * (1 << 20)), shares


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str, text_col: str, rows: Column, max_rows: int, max_bytes: int) -> DataFrame:
    """(label, weight, text) of labelled rows that `rows` admits: of each label about max_rows and max_bytes of text at
    most; weight is the inverse of the label's share that was taken. The ids are broadcast, so no text is shuffled."""
    marks = labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull() & rows).groupBy(col(id_col).alias("id")).agg((F.max(col(label_col)) > 0).cast("int").alias("label"))
    counts = {r["label"]: float(r["count"]) for r in marks.groupBy("label").count().collect()}  # two rows
    marks, by_rows = _thinned(marks, "id", counts, max_rows, 5)
    own = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(marks), "id").filter("text is not null")  # bounded by max_rows
    sizes = {r["label"]: float(r["n"] or 0) for r in own.groupBy("label").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    own, by_bytes = _thinned(own, "id", sizes, max_bytes, 6)
    weight = F.lit(0.0)
    for label, part in by_bytes.items():
        weight = F.when(F.col("label") == label, F.lit(1 / (part * by_rows[label]))).otherwise(weight)
    return own.select("label", weight.alias("weight"), "text")


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", count_rows: Column | None = None, scale_rows: Column | None = None, train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """count_rows and scale_rows: which labelled rows (conditions on id_col) the counts and the logistic function see."""
    ship(docs.sparkSession)
    count_rows, scale_rows = (F.lit(True) if c is None else c for c in (count_rows, scale_rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in utf8_chunks(batch.column(1)):
                w = find(batch.column(1).slice(a, b - a), ALNUM)
                at, number = distinct(w)
                keys, size = signs(w, at)
                label = batch.column(0).slice(a, b - a).to_numpy(zero_copy_only=False)[w.doc] > 0
                grams, of = np.unique(keys, return_inverse=True)
                n = [np.bincount(of, np.repeat(np.bincount(number, label == t, len(at)), size), len(grams)).astype(np.int64) for t in (True, False)]
                yield pa.RecordBatch.from_pydict({"key": grams.view(np.int64), "t": n[0], "o": n[1]})

    own = labelled(docs, labels, label_col, id_col, text_col, count_rows, train_rows, train_bytes)
    counts = own.select("label", "text").mapInArrow(count, "key long, t long, o long").groupBy("key").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))
    held = counts.toArrow()  # bounded by train_bytes: an entry for each byte counted at most
    keys, t, o = (held.column(c).to_numpy() for c in ("key", "t", "o"))
    model = train(keys.view(np.uint64), t, o)
    if not t.any() or not o.any():
        model.gap[:] = 0
        share = labels.filter(col(label_col).isNotNull() & col(id_col).isNotNull() & (count_rows | scale_rows)).agg(F.avg(col(label_col).cast("double")).alias("p")).first()["p"] or 0.0
        p = min(max(share, 1e-9), 1 - 1e-9)
        model.weights = np.array([*[0.0] * len(STATISTICS), np.log(p / (1 - p))])
        return model
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = labelled(docs, labels, label_col, id_col, text_col, scale_rows, train_rows, train_bytes)
    seen = map_rows(rest, ["label", "weight"], "text", NEW[:-1], lambda texts: once(shared, scorer)(texts)).toArrow()
    y = seen.column("label").to_numpy() > 0
    x = np.column_stack(scaled([seen.column(c).to_numpy() for c in STATISTICS]))
    if y.any() and not y.all():
        model.weights = fit_logistic(x, y.astype(float), seen.column("weight").to_numpy())
    else:  # nothing to scale by: a gap of 0 is even
        model.weights = np.array([50.0, *[0.0] * len(TAILS), -1.0])
    return model


def score(docs: DataFrame, model: Model, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """`keep` columns (all, if None), STATISTICS, and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by train_bytes

    def work(texts: pa.Array) -> list:
        m, x = shared.value, once(shared, scorer)(texts)
        z = sum(a * b for a, b in zip(scaled(x), m.weights[:-1], strict=True)) + m.weights[-1]
        return [*x, 1 / (1 + np.exp(-np.clip(z, -60, 60)))]

    return map_rows(docs, docs.columns if keep is None else keep, text_col, NEW, work)


def fold(id_col: str, n: int) -> Column:
    return F.crc32(F.col(id_col).cast("string")) % n


def fitted(spark: SparkSession, docs: DataFrame, sf_dir: str, held_out: int | None = None) -> Model:
    """Counts from the folds 1-3 of crc32(id) mod 5, the logistic function from fold 4; fold 0 is left for tests."""
    of = fold("doc_id", 5)
    return fit(docs, table(spark, sf_dir, "labels"), count_rows=of.between(1, 3), scale_rows=of == 4)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = score(docs, fitted(spark, docs, sf_dir), ["doc_id"])
    return made.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *STATISTICS)
