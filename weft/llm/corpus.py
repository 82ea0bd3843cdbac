"""Corpus tables in blocks, and n-gram statistics that are exchanged between blocks.

A block is about 2 MB of text as word hashes: a vocabulary and codes, compressed, written to the shared folder once,
so that later passes see the same blocks. A statistic of n-grams (how often, in how many documents) is gathered by
hash: each block sends every bucket the distinct keys that it has there, once, with its own count; a bucket sums them
and answers each block key by key. So a key costs one entry a block, however many documents or rows hold it, and a
bucket's size is the hash's share of the distinct keys: no hot key, document or source lands in one task.

The number of buckets follows from the corpus's words, up to MESSAGES; so a block sends that many messages at most, of
a hundred keys on average. A larger corpus takes two levels: a bucket's messages of a group of blocks are merged, and
the merged keys are sent on to MESSAGES buckets of a second level, whose answers go back the same way. So the number of
messages grows with the corpus, not with its square, and no task holds more than about BUCKET_KEYS keys up to
MESSAGES^2 * BUCKET_KEYS of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import ship
from .base import arrow_type, col, drop_written, hold, inner, release, utf8_chunks, written
from .words import find

#: Bytes of text in a block, keys in a bucket on average, and messages of a block or merged group at most.
BLOCK_BYTES, BUCKET_KEYS, MESSAGES = 2 << 20, 1 << 20, 4096


def pack(x: np.ndarray) -> bytes:
    """Bytes of an array, plane by plane, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T if len(x) else x
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(held: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(held), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel() if len(flat) else np.zeros(0, kind)


def blocks(docs: DataFrame, keep: list[str], text_col: str, kinds: tuple[np.ndarray, np.ndarray], extra: list[T.StructField] = (), make: Callable[[np.ndarray, np.ndarray], list] | None = None) -> DataFrame:
    """Rows of blocks: block, rows (the kept columns of its documents as k0, k1, ...), n_words, vocab, codes, and what
    make(hashes, first word of each document) adds, a list a document for each of `extra`."""
    ship(docs.sparkSession)
    held_in = inner(docs, keep, text=col(text_col))
    kept = held_in.schema.fields[:-1]
    element = T.StructType([*kept, *extra])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("rows", T.ArrayType(element)), *(T.StructField(c, T.BinaryType()) for c in ("first", "vocab", "codes"))])
    types, names = [arrow_type(f.dataType) for f in element.fields], [f.name for f in schema.fields]

    def close(number: int, held: list[tuple[list[pa.Array], np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        h = np.concatenate([x[1] for x in held])
        first = np.concatenate([[0], np.cumsum(np.concatenate([x[2] for x in held]))]).astype(np.int64)
        columns = [pa.chunked_array([x[0][i] for x in held]).combine_chunks() for i in range(len(kept))]
        held.clear()
        made = make(h, first) if make else []
        columns = [c if isinstance(c, pa.Array) else c.chunk(0) for c in columns] + [pa.array(x, k) for x, k in zip(made, types[len(kept) :], strict=True)]
        rows = pa.ListArray.from_arrays(pa.array([0, len(first) - 1], pa.int32()), pa.StructArray.from_arrays(columns, fields=[pa.field(f.name, k) for f, k in zip(element.fields, types, strict=True)]))
        vocab, codes = np.unique(h, return_inverse=True)
        values = [pa.array([number]), pa.array([len(h)]), rows, *(pa.array([pack(x)], pa.binary()) for x in (first, vocab, codes.astype(np.uint32)))]
        return pa.RecordBatch.from_arrays(values, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            texts = batch.column(len(kept))
            for a, b in utf8_chunks(texts, BLOCK_BYTES // 2):
                w = find(texts.slice(a, b - a), kinds)
                held.append(([batch.column(i).slice(a, b - a) for i in range(len(kept))], w.hash, np.diff(w.first)))
                size += len(w.low)
                del w
                if size >= BLOCK_BYTES // 4 * 3:
                    yield close(number, held)
                    number, held, size = number + 1, [], 0
                    release()
        if held:
            yield close(number, held)
            release()

    return hold(held_in.mapInArrow(run, schema), "blocks")


def hashes(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block and the first word of each document."""
    return unpack(row["vocab"], np.uint64)[unpack(row["codes"], np.uint32)], unpack(row["first"], np.int64)


def bucket_number(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def ask(corpus: DataFrame, n_buckets: int, keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]], kind: type) -> DataFrame:
    """(bucket, block, keys, counts): keys_of(block) are its distinct keys in ascending order and its own counts.

    kind: uint32 keeps the low 32 bits of a key in its bucket, so that two keys may share a count; uint64 all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                yield messages(row["block"], *keys_of(row), n_buckets, kind)
                release()

    return corpus.select("block", "first", "vocab", "codes").mapInArrow(run, "bucket int, block long, keys binary, counts binary")


def messages(block: int, keys: np.ndarray, counts: np.ndarray, n_buckets: int, kind: type, buckets: tuple[int, int] | None = None) -> pa.RecordBatch:
    """One message for each bucket (of the range) that has keys."""
    begin, end = buckets or (0, n_buckets)
    cuts = np.searchsorted(bucket_number(keys, n_buckets), np.arange(begin, end + 1))
    to, out = np.flatnonzero(np.diff(cuts)), []
    for b in to.tolist():
        k, c = keys[cuts[b] : cuts[b + 1]].astype(kind), counts[cuts[b] : cuts[b + 1]]
        if kind is np.uint32:
            k, at = np.unique(k, return_inverse=True)
            c = np.bincount(at, c)
        out.append((pack(np.diff(k, prepend=kind(0))), pack(c.astype(np.uint32))))
    held = [pa.array([x[i] for x in out], pa.binary()) for i in range(2)]
    return pa.RecordBatch.from_arrays([pa.array(to + begin, pa.int32()), pa.array(np.full(len(to), block)), *held], names=["bucket", "block", "keys", "counts"])


def _summed(held: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a bucket's messages: the distinct keys and sums of counts, the key of each entry, and where messages end."""
    keys = [np.cumsum(unpack(k, kind), dtype=kind) for k in held.column("keys").to_pylist()]
    ends = np.cumsum([len(k) for k in keys])
    flat, at = np.unique(np.concatenate([np.zeros(0, kind), *keys]), return_inverse=True)
    del keys
    counts = np.concatenate([np.zeros(0, np.uint32), *(unpack(c, np.uint32) for c in held.column("counts").to_pylist())])
    return flat, np.bincount(at, counts, len(flat)).astype(np.uint64), at, ends


def _replies(held: pa.Table, sums: np.ndarray, at: np.ndarray, ends: np.ndarray) -> pa.Table:
    totals = [pack(sums[at[a:b]]) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
    return pa.table({"block": held.column("block"), "bucket": held.column("bucket"), "totals": pa.array(totals, pa.binary())})


TOLD = "block long, bucket int, totals binary"


def answer(asked: DataFrame, kind: type) -> DataFrame:
    """(block, bucket, totals): for each block and bucket, the sums of counts over all blocks, in the order of its keys."""

    def total(held: pa.Table) -> pa.Table:
        _, sums, at, ends = _summed(held, kind)
        out = _replies(held, sums, at, ends)
        del sums, at
        release()
        return out

    return asked.groupBy("bucket").applyInArrow(total, TOLD)


def exchange(corpus: DataFrame, n_keys: int, keys_of: Callable[[dict], tuple[np.ndarray, np.ndarray]], exact: bool, bucket_keys: int = BUCKET_KEYS, most: int = MESSAGES) -> tuple[DataFrame, int, type]:
    """The answers (TOLD) to all blocks, the number of buckets and the kind of key, as `answered` takes them.

    n_keys: about how many keys all blocks send. Unless exact, two keys of a bucket may share a count, where that
    makes messages smaller. With more than `most` buckets of bucket_keys there are two levels of `most` each."""
    n = max(1, -(-n_keys // bucket_keys))
    if n <= most:
        kind = np.uint64 if exact else np.uint32
        return answer(ask(corpus, n, keys_of, kind), kind), n, kind
    n_groups = -(-n // most)
    asked = hold(ask(corpus, most, keys_of, np.uint64).withColumn("part", F.pmod(F.xxhash64("block"), F.lit(n_groups)).cast("int")), "asked")

    def merge(held: pa.Table) -> pa.Table:
        bucket, part = held.column("bucket")[0].as_py(), held.column("part")[0].as_py()
        keys, sums, _, _ = _summed(held, np.uint64)
        return pa.Table.from_batches([messages(part, keys, sums, most * most, np.uint64, (bucket * most, (bucket + 1) * most))])

    def pass_on(held: pa.Table, told: pa.Table) -> pa.Table:
        keys, _, at, ends = _summed(held, np.uint64)
        out = _replies(held, answered(keys, most * most, told.sort_by("bucket"), np.uint64), at, ends)
        release()
        return out

    merged = asked.groupBy("bucket", "part").applyInArrow(merge, "bucket int, block long, keys binary, counts binary")
    told = answer(merged, np.uint64).select(F.floor(F.col("bucket") / most).cast("int").alias("first_bucket"), F.col("block").cast("int").alias("part"), "bucket", "totals")
    return asked.groupBy("bucket", "part").cogroup(told.groupBy("first_bucket", "part")).applyInArrow(pass_on, TOLD), most, np.uint64


def answered(keys: np.ndarray, n_buckets: int, rows: pa.Table, kind: type) -> np.ndarray:
    """The totals of a block's ascending distinct keys."""
    out = np.zeros(len(keys), np.uint64)
    number = bucket_number(keys, n_buckets)
    for b, held in zip(rows.column("bucket").to_pylist(), rows.column("totals").to_pylist(), strict=True):
        begin, end = np.searchsorted(number, [b, b + 1])
        part, totals = keys[begin:end], unpack(held, np.uint64)
        if kind is np.uint32:
            low = part.astype(np.uint32)
            totals = totals[np.searchsorted(np.unique(low), low)]
        out[begin:end] = totals
    return out


def words_of(corpus: DataFrame) -> int:
    return corpus.agg(F.sum("n_words").alias("n")).first()["n"] or 0


def local_forest(edges: DataFrame) -> DataFrame:
    """Per partition, edges of a spanning forest as stars around each tree's smallest node; keeps all connections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        def flush() -> pa.RecordBatch:
            out = [(x, top(x)) for x in list(up)]
            out = [(x, y) for x, y in out if x != y]
            up.clear()
            return pa.RecordBatch.from_pydict({"src": pa.array([x for x, _ in out], pa.int64()), "dst": pa.array([y for _, y in out], pa.int64())})

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                if a != b:
                    up[max(a, b)] = min(a, b)
            if len(up) > 500_000:
                yield flush()
        yield flush()

    return edges.select("src", "dst").mapInArrow(run, "src long, dst long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of the edges (src, dst) reaches; alternating large and small
    stars until the edges no longer change. Minima are summed per task first, and joins may be split where a node is hot."""
    since = written()
    e = hold(local_forest(edges.filter("src <> dst")).distinct(), "edges")
    seen = None
    while True:
        both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = both.join(least, "src").filter("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).distinct()
        down = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(down, "src").select(F.explode(F.array(F.struct("src", F.col("m").alias("dst")), F.struct(F.col("dst").alias("src"), F.col("m").alias("dst")))).alias("e"))
        e = hold(small.select("e.*").filter("src <> dst").distinct(), "edges")
        drop_written(e.sparkSession, since, 1)  # the rounds before
        now = e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        seen = now
