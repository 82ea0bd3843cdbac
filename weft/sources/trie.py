"""Adjacency lists as nested compressed rows: per level the distinct values, and where each one's children begin.

Tables of adjacency lists (write_adjacency) are the form to keep; the single-file form below is for exchange: a header
of 64-bit numbers (levels, then the length of each level, then attribute ids), the levels' 32-bit values, and for each
level but the last its 32-bit offsets, one more than values.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.wcoj import adjacency
from .columnar import _open, listed, put_file, read_columnar
from .shared import ship

HEAD, VALUE, ROWS = np.dtype("<u8"), np.dtype("<i4"), 1 << 16
#: Rows of a file that a task makes among others.
FILE_ROWS = 1 << 20


def write_adjacency(edges: DataFrame, path: str, src: str = "a0", dst: str = "a1") -> None:
    adjacency(edges, src, dst).write.mode("overwrite").parquet(path)


def encode_trie(columns: list[np.ndarray], attributes: list[int]) -> bytes:
    """From equally long columns; rows are sorted and made distinct."""
    rows = np.unique(np.stack(columns, 1), axis=0) if len(columns[0]) else np.zeros((0, len(columns)), int)
    levels, offsets = [], []
    starts = np.arange(len(rows) + 1)
    for k in range(len(columns) - 1, -1, -1):
        prefix = rows[:, : k + 1]
        new = np.ones(len(rows), bool)
        if len(rows):
            new[1:] = (prefix[1:] != prefix[:-1]).any(1)
        first = np.flatnonzero(new)
        levels.insert(0, rows[first, k])
        if k < len(columns) - 1:
            offsets.insert(0, np.searchsorted(starts, np.append(first, len(rows))))
        starts = first
    head = np.array([len(columns), *map(len, levels), *attributes], HEAD)
    return b"".join([head.tobytes(), *(x.astype(VALUE).tobytes() for x in levels), *(x.astype(VALUE).tobytes() for x in offsets)])


def trie_rows(held: bytes, step: int) -> Iterator[list[np.ndarray]]:
    """Columns of `step` rows at a time; besides the file, no more is held."""
    n = int(np.frombuffer(held, HEAD, 1)[0])
    lengths, at = np.frombuffer(held, HEAD, n, 8).astype(int), 8 * (2 * n + 1)
    levels, offsets = [], []
    for size in lengths:
        levels.append(np.frombuffer(held, VALUE, size, at))
        at += 4 * size
    for size in lengths[:-1]:
        offsets.append(np.frombuffer(held, VALUE, size + 1, at))
        at += 4 * (size + 1)
    for begin in range(0, lengths[-1], step):
        place = np.arange(begin, min(begin + step, lengths[-1]), dtype=VALUE)
        columns = [levels[-1][place]]
        for k in range(n - 2, -1, -1):
            place = np.searchsorted(offsets[k], place, "right") - 1
            columns.insert(0, levels[k][place])
            place = place.astype(VALUE)
        yield columns


def decode_trie(held: bytes) -> tuple[list[int], np.ndarray]:
    """Attribute ids and the rows."""
    n = int(np.frombuffer(held, HEAD, 1)[0])
    ids = np.frombuffer(held, HEAD, n, 8 * (n + 1)).astype(int)
    made = [np.stack(columns, 1) for columns in trie_rows(held, FILE_ROWS)]
    return ids.tolist(), np.concatenate([np.zeros((0, n), VALUE), *made])


def write_trie(rows: DataFrame, path: str) -> None:
    """A relation with columns a<k> as one file. For small relations: one task makes it (write_tries: many)."""
    made = write_tries(rows.coalesce(1), f"{path}.parts", 1, None)
    system, base = _open(path)
    if made:
        system.move(_open(made[0])[1], base)
    else:
        put_file(path, encode_trie([np.zeros(0, int) for _ in rows.columns], [int(c.removeprefix("a")) for c in rows.columns]))
    if system.get_file_info(_open(f"{path}.parts")[1]).type == fs.FileType.Directory:
        system.delete_dir(_open(f"{path}.parts")[1])


def write_tries(rows: DataFrame, directory: str, parts: int | None = None, file_rows: int | None = FILE_ROWS) -> list[str]:
    """A relation with columns a<k> as files of at most file_rows rows; a task makes those of a range of the first column,
    in order, and holds one at a time (None: one file for each range). Returns the paths. Equal rows meet in one range
    and next to each other, so files are sets and share no row. A null is an error."""
    ship(rows.sparkSession)
    ids = [int(c.removeprefix("a")) for c in rows.columns]
    first = rows.columns[0]
    checked = rows.select(*[F.coalesce(F.col(c).cast("int"), F.raise_error(F.lit(f"{c} is null")).cast("int")).alias(c) for c in rows.columns])
    dealt = checked if parts == 1 else checked.repartitionByRange(first) if parts is None else checked.repartitionByRange(parts, first)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        paths: list[str] = []

        def put(columns: list[list[np.ndarray]]) -> None:
            paths.append(f"{directory}/{TaskContext.get().partitionId():05d}-{len(paths):05d}.tr")
            put_file(paths[-1], encode_trie([np.concatenate(c) for c in columns], ids))

        held, n, last = [[] for _ in ids], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy() for c in batch.columns]
            new = np.append(last != [c[0] for c in columns], np.any([c[1:] != c[:-1] for c in columns], axis=0))
            last = [c[-1] for c in columns]
            columns = [c[new] for c in columns]
            while len(columns[0]):
                took = len(columns[0]) if file_rows is None else min(len(columns[0]), file_rows - n)
                for k, c in enumerate(columns):
                    held[k].append(c[:took].copy())
                n, columns = n + took, [c[took:] for c in columns]
                if n == file_rows:
                    put(held)
                    held, n = [[] for _ in ids], 0
        if n:
            put(held)
        if paths:
            yield pa.RecordBatch.from_pydict({"path": paths})

    return sorted(r["path"] for r in dealt.sortWithinPartitions(*rows.columns).mapInArrow(write, "path string").collect())


def read_tries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files of one relation, each read by a task of its own."""
    ship(spark)
    system, base = _open(paths[0])
    with system.open_input_file(base) as f:
        n = int(np.frombuffer(f.read_at(8, 0), HEAD)[0])
        ids = np.frombuffer(f.read_at(8 * n, 8 * (n + 1)), HEAD).astype(int).tolist()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, base = _open(path)
                with system.open_input_file(base) as f:
                    held = f.read()
                for columns in trie_rows(held, ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f"a{i}" for i in ids])

    listed_paths = spark.createDataFrame([(p,) for p in paths], "path string").repartition(len(paths))
    return listed_paths.mapInArrow(read, ", ".join(f"a{i} int" for i in ids))


def read_trie(spark: SparkSession, path: str) -> DataFrame:
    system, base = _open(path)
    if system.get_file_info(base).type != fs.FileType.File:
        raise FileNotFoundError(path)
    return read_tries(spark, [path])


def read_any(spark: SparkSession, directory: str) -> DataFrame:
    """A directory's relation: of files that differ only in the suffix, the trie (.tr), else the columns (.db)."""
    prefix = directory[: len(directory) - len(_open(directory)[1])]
    found = [f"{prefix}{p}" for p in listed(directory, (".tr", ".db"))]
    tries, plain = [p for p in found if p.endswith(".tr")], [p for p in found if p.endswith(".db")]
    out = [read_tries(spark, tries)] if tries else []
    out += [read_columnar(spark, p) for p in plain]
    if not out:
        raise FileNotFoundError(f"no .tr or .db file in {directory}")
    return reduce(DataFrame.unionByName, out)
