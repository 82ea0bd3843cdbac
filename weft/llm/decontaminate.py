"""Benchmark decontamination: a broadcast hash set of test n-grams, scanned over training token windows.

Words are runs of [0-9a-z] and non-ASCII characters after A-Z are lowered. An item's windows are its runs of `n`
words; an item of fewer words, but not none, is one window. Windows are held as sorted hashes with the place of their
words in the benchmark's text (some 30 bytes a word); each candidate is verified on its words before it counts, so a
hash collision changes nothing.

The benchmark is broadcast in pieces of about `piece_bytes`, to which items are dealt by hash; each is a pass over the
documents. The first one makes a row for every document; further ones make rows for texts with hits alone, known by
the digest of the text, and these are joined to the documents that may have some (route.py). So what executors hold is
bounded at every size of the benchmark, texts aren't written again, and nothing is left out.

Defined results: a null text has no words and no hits; items whose id or text is null have no windows; repeated
rows of an item count once; repeated documents each get their own row; an empty benchmark marks nothing; input
columns named as a result column come back as <name>_input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import col, hold, inner, map_rows, once, outer_names, table, utf8
from .route import split
from .words import ALNUM, find, grams

#: Words of the shortest item that is cut: a single word is ordinary language.
LEAST_CUT = 2
#: Bytes of benchmark text in a broadcast.
PIECE_BYTES = 8 << 20
SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
#: hits: runs of hit words, as word numbers; spans: the same runs in code points; cuts: those of whole n-word windows and of shorter items of LEAST_CUT words or more.
NEW = [T.StructField("n_words", T.LongType()), T.StructField("item_ids", T.ArrayType(T.StringType())), *(T.StructField(c, SPAN) for c in ("hits", "spans", "cuts"))]
#: Bits of the first, cheap test.
BITS = 20


@dataclass
class Windows:
    """Distinct windows of one length in the order of their hashes, each by a place where it stands in the benchmark;
    the items that have window k are items[first[k] : first[k + 1]]."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    items: np.ndarray


@dataclass
class Benchmark:
    """A piece: the items' names, their words in one text, joined by blanks, and the windows of each length."""

    n: int
    names: list[str]
    text: np.ndarray
    windows: dict[int, Windows]


def benchmark_of(names: list[str], texts: pa.Array, n: int) -> Benchmark:
    w = find(texts, ALNUM)
    size = w.end - w.start
    to = np.cumsum(size + 1) - size - 1  # words one after the other, a blank behind each
    text = np.full(int((size + 1).sum()), 32, np.uint8)
    text[np.repeat(to, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = w.low[np.repeat(w.start, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
    count, out = np.diff(w.first), {}
    for length in sorted({min(n, c) for c in count.tolist()} - {0}):
        at = np.flatnonzero(np.repeat(np.minimum(count, n) == length, count))
        item = w.doc[at]
        inside = at + length <= w.first[item + 1]
        at, item = at[inside], item[inside].astype(np.int32)
        h = grams(w.hash, length)[at]
        order = np.lexsort((item, h))
        h, at, item = h[order], at[order], item[order]
        start, end = to[at], to[at + length - 1] + size[at + length - 1]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        run = np.cumsum(new) - 1
        # Windows of one hash are the same words, but for a collision: then each different one is a window of its own.
        lead = np.flatnonzero(new)[run]
        other = [k for k in np.flatnonzero(~new).tolist() if text[start[k] : end[k]].tobytes() != text[start[lead[k]] : end[lead[k]]].tobytes()]
        if other:
            words = [text[a:b].tobytes() for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            order = np.array(sorted(range(len(h)), key=lambda k: (int(h[k]), words[k], int(item[k]))))  # noqa: B023
            h, start, end, item = h[order], start[order], end[order], item[order]
            new[1:] = [words[a] != words[b] for a, b in zip(order[1:].tolist(), order[:-1].tolist(), strict=True)]
            run = np.cumsum(new) - 1
        keep = np.ones(len(h), bool)
        keep[1:] = (run[1:] != run[:-1]) | (item[1:] != item[:-1])  # an item has a window once
        out[length] = Windows(h[new], start[new], end[new], np.searchsorted(run[keep], np.arange(int(new.sum()) + 1)), item[keep])
    return Benchmark(n, names, text, out)


def _runs(on: np.ndarray) -> np.ndarray:
    """First and end of each run of marked words."""
    return np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]]))).reshape(-1, 2)


def scanner(benchmark: Benchmark):
    """The work of map_rows."""
    least = min(LEAST_CUT, benchmark.n)
    tables = {}
    for size, held in benchmark.windows.items():
        tables[size] = np.zeros(1 << BITS, bool)
        tables[size][(held.hashes >> np.uint64(64 - BITS)).astype(np.int64)] = True

    def work(texts: pa.Array) -> list:
        w = find(texts, ALNUM)
        n_words = np.diff(w.first)
        edge, whole = np.zeros((2, len(w.start) + 1), np.int32)
        items: dict[int, set[int]] = {}
        doc = w.doc
        for size, held in benchmark.windows.items():
            h = grams(w.hash, size)
            at = np.flatnonzero(tables[size][(h >> np.uint64(64 - BITS)).astype(np.int64)])
            at = at[at + size <= w.first[doc[at] + 1]]
            begin, end = np.searchsorted(held.hashes, h[at]), np.searchsorted(held.hashes, h[at], "right")
            some = end > begin
            for j, d, a, b in zip(at[some].tolist(), doc[at[some]].tolist(), begin[some].tolist(), end[some].tolist(), strict=True):
                own = b" ".join([w.low[x:y].tobytes() for x, y in zip(w.start[j : j + size].tolist(), w.end[j : j + size].tolist(), strict=True)])
                for k in range(a, b):
                    if benchmark.text[held.start[k] : held.end[k]].tobytes() == own:
                        items.setdefault(d, set()).update(held.items[held.first[k] : held.first[k + 1]].tolist())
                        edge[j] += 1
                        edge[j + size] -= 1
                        whole[j] += size >= least
                        whole[j + size] -= size >= least
        out: list[list[list[dict]]] = [[[] for _ in range(len(n_words))] for _ in range(3)]
        data, offsets = utf8(texts)
        hit, cut_out = np.cumsum(edge) > 0, np.cumsum(whole) > 0
        for d in items:
            a, b = w.first[d], w.first[d + 1]
            hits = _runs(hit[a:b])
            out[0][d] = [{"start": x, "end": y} for x, y in hits.tolist()]
            lead = np.concatenate([[0], np.cumsum((data[offsets[d] : offsets[d + 1]] & 0xC0) != 0x80)])
            for k, runs in ((1, hits), (2, _runs(cut_out[a:b]))):
                begin, end = lead[w.start[a + runs[:, 0]] - offsets[d]], lead[w.end[a + runs[:, 1] - 1] - offsets[d]]
                out[k][d] = [{"start": x, "end": y} for x, y in zip(begin.tolist(), end.tolist(), strict=True)]
        return [n_words, [sorted({benchmark.names[k] for k in items.get(d, ())}) for d in range(len(n_words))], *out]

    return work


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 8, keep: list[str] | None = None, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """`keep` columns of each document (all, if None), the columns NEW."""
    spark = docs.sparkSession
    keep = list(dict.fromkeys(docs.columns if keep is None else keep))
    items = benchmark.select(col(item_col).cast("string").alias("item"), col(item_text_col).alias("text")).dropna().distinct()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    pieces = max(1, -(-size // piece_bytes))
    piece = F.pmod(F.xxhash64("item", "text"), F.lit(pieces))

    def held(k: int):
        # Bounded: one piece holds about piece_bytes of benchmark text.
        own = items.filter(piece == k).toArrow()
        return spark.sparkContext.broadcast(benchmark_of(own.column("item").to_pylist(), pa.concat_arrays([pa.array([], pa.string()), *(c.cast(pa.string()) for c in own.column("text").chunks)]), n))

    def scanned(rows: DataFrame, columns: list[str], text: str, k: int) -> DataFrame:
        shared = held(k)
        return map_rows(rows, columns, text, NEW, lambda texts: once(shared, scanner)(texts))

    new = [f.name for f in NEW]
    if pieces == 1:
        return scanned(docs, keep, text_col, 0)
    flat = inner(docs, keep, text=col(text_col), digest=F.sha2(F.coalesce(col(text_col), F.lit("")), 256))
    own = flat.columns[: len(keep)]
    out = scanned(flat, [*own, "digest"], "text", 0)
    more = None
    for k in range(1, pieces):
        found = hold(scanned(flat.select("digest", "text"), ["digest"], "text", k).filter(F.size("item_ids") > 0).dropDuplicates(["digest"]), "hits")
        more = found if more is None else more.unionByName(found)
    lists = lambda c: F.flatten(F.collect_list(c))  # noqa: E731 - of a text: one list a piece
    more = hold(more.groupBy(F.col("digest").alias("of")).agg(F.array_distinct(lists("item_ids")).alias("item_ids"), *(lists(c).alias(c) for c in new[2:])).select("of", F.xxhash64("of").alias("hit"), *[F.col(c).alias(f"more_{c}") for c in new[1:]]), "hits")
    clean, rest = split(out, F.xxhash64("digest"), more, "hit")
    both = rest.join(more, (rest["__key"] == more["hit"]) & (rest["digest"] == more["of"]), "left")
    either = lambda c: F.concat(c, F.coalesce(f"more_{c}", F.array()))
    joined = {"item_ids": F.array_sort(F.array_distinct(either("item_ids")))} | {c: merged(either(c)) for c in new[2:]}
    return clean.select(*own, *new).unionByName(both.withColumns(joined).select(*own, *new)).toDF(*outer_names(keep, new), *new)


def merged(spans: Column) -> Column:
    """Spans as a sorted list in which overlapping ones are one."""
    empty = F.array().cast(SPAN)

    def add(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (last["end"] >= x["start"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), empty, add)


def cut(text: Column, spans: Column) -> Column:
    """The text without its spans; a single blank stands for each."""
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    parts = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda x: F.substring(text, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    return F.when(F.size(spans) > 0, F.array_join(parts, " ")).otherwise(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, min_items: int = 2, remove: str = "both", text_col: str = "text", **options) -> DataFrame:
    """Documents with the columns of `docs`, without contamination.

    remove="documents" drops documents in which windows of `min_items` items or more occur; "spans" cuts the hit words
    out of every document; "both" drops those documents and cuts hits out of the others. Cutting uses windows of
    `n` words and whole items of fewer, but not of fewer than LEAST_CUT: those are ordinary language. Texts without hits come back unchanged.
    """
    found = find_hits(docs, benchmark, n, docs.columns, text_col, **options)
    own = found.columns[: len(docs.columns)]
    if remove in ("documents", "both"):
        found = found.filter(F.size("item_ids") < min_items)
    columns = [col(c) for c in own]
    if remove in ("spans", "both"):
        at = docs.columns.index(text_col)
        columns[at] = cut(columns[at], F.col("cuts"))
    return found.select(*[c.alias(f"k{i}") for i, c in enumerate(columns)]).toDF(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from the operator's."""
    n_items = F.size("item_ids").cast("long")
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]))
