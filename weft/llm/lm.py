"""Stupid-backoff language-model scores, computed relationally.

N-gram counts (orders 1 to `order`) over all documents are tables partitioned by hash: blocks of the corpus send each
bucket their distinct n-grams, buckets sum and answer (corpus.py), and the answers are joined to the block's n-grams
and summed by document. Rows of these tables are packed, some hundred n-grams in one, as plain rows don't fit the
budget for shuffled bytes. A document is scored by the other ones: its own counts are taken off first, so a text that
only repeats itself isn't likely. S(w | h) is c(hw) / c(h) if c(hw) > 0, else ALPHA times the score with the history's
first word dropped; at the end c(w) / N, with c(w) at least FLOOR.

Words are runs of [0-9a-z] and non-ASCII characters after A-Z are lowered. No n-gram reaches over a document's end.

Defined results: a null or empty text, or one without words, has n_words 0, log_score 0 and mean_log_score null;
repeated rows are documents of their own and count for each other; an empty table gives none; input columns named as
a result column come back as <name>_input.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import arrow_type, outer_names, release, table
from .corpus import answered, blocks, exchange, hashes, words_of
from .words import ALNUM, grams

#: Highest order, weight of a step back, and the count that stands for an unknown word.
ORDER, ALPHA, FLOOR = 2, 0.4, 0.5
NEW = [T.StructField("n_words", T.LongType()), T.StructField("log_score", T.DoubleType()), T.StructField("mean_log_score", T.DoubleType())]


def all_grams(h: np.ndarray, first: np.ndarray, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """By order: the n-grams inside documents, and the places at which they start."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = []
    for m in range(1, order + 1):
        g = grams(h, m)
        at = np.flatnonzero(np.arange(len(g)) + m <= first[doc[: len(g)] + 1]) if len(g) else np.zeros(0, np.int64)
        out.append((g[at], at))
    return out


def score(docs: DataFrame, keep: list[str] | None = None, text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, **sizes) -> DataFrame:
    """`keep` columns of each row (all, if None), n_words, log_score (sum over words) and mean_log_score."""
    keep = list(dict.fromkeys(docs.columns if keep is None else keep))
    corpus = blocks(docs, keep, text_col, ALNUM)
    total = words_of(corpus)

    def own(row: dict) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(np.concatenate([g for g, _ in all_grams(*hashes(row), order)]), return_counts=True)

    told, n_buckets, kind = exchange(corpus, total * order, own, True, **sizes)
    kept = [f for f in corpus.schema["rows"].dataType.elementType.fields]
    schema = T.StructType([*kept, *NEW])
    kinds = [arrow_type(f.dataType) for f in schema.fields]

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        for i, row in enumerate(left.select(["block", "first", "vocab", "codes"]).to_pylist()):
            h, first = hashes(row)
            size = np.diff(first)
            doc = np.repeat(np.arange(len(size)), size)
            made = all_grams(h, first, order)
            keys, number = np.unique(np.concatenate([g for g, _ in made]), return_inverse=True)
            counts = answered(keys, n_buckets, right, kind)
            rest = []  # by order and place: how often the n-gram occurs in other documents
            for (g, at), of in zip(made, np.split(number, np.cumsum([len(g) for g, _ in made])[:-1]), strict=True):
                _, pair, mine = np.unique(doc[at] * max(1, len(keys)) + of, return_inverse=True, return_counts=True)
                held = np.zeros(len(h))
                held[at] = counts[of].astype(np.int64) - mine[pair]
                rest.append(held)
            others = np.maximum(total - size, 1)[doc]
            logs, place, open_ = np.zeros(len(h)), np.arange(len(h)) - first[doc], np.ones(len(h), bool)
            for m in range(order, 1, -1):
                p = np.flatnonzero(open_ & (place >= m - 1))
                c, before = rest[m - 1][p - m + 1], rest[m - 2][p - m + 1]
                seen = c > 0
                logs[p[seen]] += np.log(c[seen] / before[seen])
                logs[p[~seen]] += np.log(alpha)
                open_[p[seen]] = False
            logs[open_] += np.log(np.maximum(rest[0][open_], FLOOR) / others[open_])
            sums = np.bincount(doc, logs, len(size))
            rows = left.column("rows")[i].values
            mean = pa.array(sums / np.maximum(size, 1), mask=size == 0)
            columns = [*(rows.field(f.name) for f in kept), pa.array(size), pa.array(sums), mean]
            parts.append(pa.table([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=[f.name for f in schema.fields]))
            del made, keys, number, counts, rest
            release()
        return pa.concat_tables(parts) if parts else pa.Table.from_batches([], pa.schema([(f.name, k) for f, k in zip(schema.fields, kinds, strict=True)]))

    names = [f.name for f in NEW]
    return corpus.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(summed, schema).toDF(*outer_names(keep, names), *names)


def op8_lm_score(spark: SparkSession, sf_dir: str, order: int = ORDER) -> DataFrame:
    made = score(table(spark, sf_dir, "documents"), ["doc_id"], order=order)
    return made.select("doc_id", "n_words", F.round("mean_log_score", 6).alias("mean_log_score"))


def op8_lm_score_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_lm_score(spark, sf_dir, 3)
