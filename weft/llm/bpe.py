"""Byte-level BPE by corpus-level merge replay.

Each chunk of texts is split by the vocabulary's pattern; its distinct pieces that the worker hasn't met yet form a
corpus of byte tokens, laid out as one linked list per piece. An inverted index maps each token pair, named by the
rank of the token it makes, to the positions where it stands. A queue gives the lowest rank that has positions; the
merge is applied at all of them at once and only the pairs that touch a merged place are looked up and indexed anew.
Pieces that are tokens themselves keep that token. So the ids are those of encoding piece by piece.

A new pair may have a lower rank than the merge that made it. For such tokens (found once, from the vocabulary) one
place of a piece is merged at a time, from the left, which keeps the order that a piece alone would see.

What a worker holds is bounded: one chunk of texts and at most `known` pieces, which are forgotten together. No row
is shuffled. Texts are encoded whole.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows each get their own row; ids
that are null decode to no bytes, and an id outside the vocabulary is an error; input columns named as a result
column come back as <name>_input.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import ship
from .base import inner, map_rows, once, outer_names, release, table
from .words import HashTable, mix

#: Pieces that a worker remembers when it begins a chunk, at most, bytes of text in a chunk, and rows decoded at a time.
KNOWN, CHUNK, ROWS = 100_000, 1 << 20, 1000
IDS, DECODED = T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Merges:
    """Which pairs of tokens make a token."""

    def __init__(self, tokens: list[bytes]):
        self.rank = {t: r for r, t in enumerate(tokens)}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], np.int32)
        self.pairs: dict[int, int] = {}
        lowest = list(range(len(tokens)))
        for r, t in enumerate(tokens):
            for cut in range(1, len(t)):
                a, b = self.rank.get(t[:cut]), self.rank.get(t[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 32 | b] = r
                    lowest[a], lowest[b] = min(lowest[a], r), min(lowest[b], r)
        #: Whether a token can be part of one of lower rank.
        self.back = np.array([low < r for r, low in enumerate(lowest)])
        keys = np.fromiter(self.pairs, np.uint64, len(self.pairs))
        self.table = HashTable(mix(keys), np.fromiter(self.pairs.values(), np.int32, len(self.pairs)))

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, -1 if none."""
        keys = a.astype(np.int64) << 32 | b
        if len(keys) < 24:
            return np.array([self.pairs.get(k, -1) for k in keys.tolist()], np.int32)
        slot = self.table.find(mix(keys.astype(np.uint64)))
        return np.where(slot >= 0, self.table.values[slot], -1).astype(np.int32)


def replay(pieces: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces one after the other, and the number of each piece's ids."""
    size = np.array([len(p) for p in pieces], np.int64)
    token = merges.byte[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(token)
    piece = np.repeat(np.arange(len(pieces)), size)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    ends = np.cumsum(size)
    after[ends[size > 0] - 1] = -1
    before[(ends - size)[size > 0]] = -1
    alive, now = np.ones(n, bool), np.full(n, -1, np.int32)
    index: dict[int, list[np.ndarray]] = {}
    queue: list[int] = []

    def add(at: np.ndarray) -> None:
        """Looks up the pairs that start at these places and puts them into the index."""
        now[at] = ranks = merges.of(token[at], token[after[at]])
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        if len(at) > 1:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            groups = zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True)
        else:
            groups = zip(ranks.tolist(), [at] * len(at), strict=True)
        for r, places in groups:
            if r in index:
                index[r].append(places)
            else:
                index[r] = [places]
                heapq.heappush(queue, r)

    add(np.flatnonzero(after >= 0))
    while queue:
        r = heapq.heappop(queue)
        held = index.pop(r)
        at = held[0] if len(held) == 1 else np.sort(np.concatenate(held))
        at = at[now[at] == r]
        if not len(at):
            continue
        if len(at) > 1 and merges.back[r]:
            first = np.concatenate([[True], piece[at[1:]] != piece[at[:-1]]])
            if not first.all():
                index[r] = [at[~first]]
                heapq.heappush(queue, r)
                at = at[first]
        elif len(at) > 1:
            chained = np.concatenate([[False], after[at[:-1]] == at[1:]])
            if chained.any():  # of places that share a token, every second one from the left
                place = np.arange(len(at))
                at = at[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
        right = after[at]
        token[at], alive[right], now[right] = r, False, -1
        follow = after[right]
        after[at] = follow
        has = follow >= 0
        before[follow[has]] = at[has]
        now[at] = -1
        back = before[at]
        back = back[back >= 0]
        near = np.concatenate([at[has], back])
        if len(near):
            add(np.unique(near) if len(back) and len(at) > 1 else near)
    return token[alive], np.bincount(piece[alive], minlength=len(pieces))


class _Pieces(dict):
    """Numbers of pieces, in the order in which they were met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = k = len(self)
        return k


class Encoder:
    """Encodes chunks of texts; keeps the pieces that it knows."""

    def __init__(self, tokens: list[bytes], pattern: str, known: int = KNOWN):
        import regex

        self.merges, self.split, self.known = Merges(tokens), regex.compile(pattern).findall, known
        self.clear()

    def clear(self) -> None:
        self.pieces, self.flat, self.count = _Pieces(), np.zeros(0, np.int32), np.zeros(0, np.int64)

    def learn(self) -> None:
        new = [p.encode() for p in list(self.pieces)[len(self.count) :]]
        whole = np.array([self.merges.rank.get(p, -1) for p in new], np.int32)
        flat, count = replay([b"" if w >= 0 else p for p, w in zip(new, whole.tolist(), strict=True)], self.merges)
        own = np.where(whole >= 0, 1, count)
        made = np.empty(int(own.sum()), np.int32)
        starts = np.cumsum(own) - own
        lone = np.zeros(len(made), bool)
        lone[starts[whole >= 0]] = True
        made[lone], made[~lone] = whole[whole >= 0], flat
        self.flat, self.count = np.concatenate([self.flat, made]), np.concatenate([self.count, own])

    def encode(self, texts: pa.Array) -> pa.Array:
        if len(self.pieces) > self.known:
            self.clear()
        number, split = self.pieces.__getitem__, self.split
        rows = [np.array(list(map(number, split(t))) if t else (), np.int64) for t in texts.to_pylist()]
        if len(self.pieces) > len(self.count):
            self.learn()
        at = np.concatenate([np.zeros(0, np.int64), *rows])
        count = self.count[at]
        ends = np.cumsum(count)
        flat = self.flat[np.repeat((np.cumsum(self.count) - self.count)[at] - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))


def decoded_of(ids: pa.ListArray, tokens: list[bytes]) -> pa.Array:
    """The bytes of each list of ids."""
    token, bounds, flat = tokens.__getitem__, ids.offsets.to_pylist(), ids.values.to_numpy(zero_copy_only=False)
    return pa.array([b"".join(map(token, flat[a:b].tolist())) for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary())


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """`keep` columns (all, if None) and `ids`, the token ids of the whole text. The rank file is read on the driver.

    With decoded, also `decoded`: the bytes that the ids decode to, in the same workers.
    """
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(ranks_path), pattern))  # bounded: one vocabulary

    def work(texts: pa.Array) -> list:
        ids = once(shared, lambda held: Encoder(*held)).encode(texts)
        return [ids, decoded_of(ids, shared.value[0])] if decoded else [ids]

    return map_rows(docs, docs.columns if keep is None else keep, text_col, [IDS, DECODED] if decoded else [IDS], work, CHUNK)


def decode(coded: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """All columns and `decoded`, the bytes of the ids."""
    shared = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    ship(coded.sparkSession)
    held = inner(coded, coded.columns)
    at, names = coded.columns.index(ids_col), [*held.columns, DECODED.name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(k, ROWS) for batch in batches for k in range(0, batch.num_rows, ROWS)):
            yield pa.RecordBatch.from_arrays([*part.columns, decoded_of(part.column(at), shared.value)], names=names)
            del part
            release()

    return held.mapInArrow(run, T.StructType([*held.schema.fields, DECODED])).toDF(*outer_names(coded.columns, [DECODED.name]), DECODED.name)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, ["doc_id"], decoded=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
