"""Headerless binary columns: all values of the first column, then of the second, and so on, 32-bit little endian.

A file's name is its schema: <rows>_<attribute>_<attribute>....db. Readers are tasks over row ranges that fetch only
their bytes of each column, through pyarrow's file systems, so a file of any size is read in parallel.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import IntegerType, StructField, StructType

from .shared import ship

NAME = re.compile(r"(?:^|/)(\d+)((?:_\d+)+)\.[^./]+$")
ROWS_A_TASK = 1 << 22
VALUE = np.dtype("<i4")


def schema_of(path: str) -> tuple[int, list[str]]:
    """Rows and column names a<k> that a file's name states."""
    found = NAME.search(path)
    if not found:
        raise ValueError(f"{path} isn't named <rows>_<attribute>_....db")
    return int(found[1]), [f"a{k}" for k in found[2][1:].split("_")]


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def put_file(path: str, held: bytes) -> None:
    system, base = _open(path)
    system.create_dir(base.rsplit("/", 1)[0])
    with system.open_output_stream(f"{base}.tmp") as f:
        f.write(held)
    system.move(f"{base}.tmp", base)  # a retried task replaces the same file


@dataclass
class RowRange(InputPartition):
    begin: int
    end: int


class ColumnReader(DataSourceReader):
    def __init__(self, path: str, rows: int, columns: list[str], step: int):
        self.path, self.rows, self.columns, self.step = path, rows, columns, step

    def partitions(self) -> Sequence[InputPartition]:
        return [RowRange(a, min(a + self.step, self.rows)) for a in range(0, max(self.rows, 1), self.step)]

    def read(self, partition: RowRange) -> Iterator[pa.RecordBatch]:
        system, path = _open(self.path)
        size = VALUE.itemsize
        with system.open_input_file(path) as f:
            if f.size() < self.rows * len(self.columns) * size:
                raise ValueError(f"{self.path} is shorter than its name states")
            held = [f.read_at((partition.end - partition.begin) * size, (k * self.rows + partition.begin) * size) for k in range(len(self.columns))]
        yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, VALUE)) for x in held], names=self.columns)


class ColumnSource(DataSource):
    """spark.read.format("coldb").load(path); options: rows and columns (comma-separated) for files named otherwise."""

    @classmethod
    def name(cls) -> str:
        return "coldb"

    def _stated(self) -> tuple[int, list[str]]:
        if "columns" in self.options:
            return int(self.options["rows"]), self.options["columns"].split(",")
        return schema_of(self.options["path"])

    def schema(self) -> StructType:
        return StructType([StructField(c, IntegerType()) for c in self._stated()[1]])

    def reader(self, schema: StructType) -> DataSourceReader:
        rows, columns = self._stated()
        return ColumnReader(self.options["path"], rows, columns, int(self.options.get("rowsPerTask", ROWS_A_TASK)))


def read_columnar(spark: SparkSession, path: str, rows: int | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    ship(spark).dataSource.register(ColumnSource)
    reader = spark.read.format("coldb")
    if columns is not None:
        reader = reader.option("columns", ",".join(columns)).option("rows", str(rows))
    return reader.load(path)


def write_columnar(df: DataFrame, directory: str) -> list[str]:
    """One file for each partition, named by its rows and attributes (columns a<k>); returns the paths.

    A file holds one partition, since a column's bytes are consecutive; read_relation reads all files of a directory.
    The format has no nulls: a null, or a value that isn't a 32-bit number, is an error.
    """
    ship(df.sparkSession)
    ids = [c.removeprefix("a") for c in df.columns]
    if not all(x.isdigit() for x in ids):
        raise ValueError("columns must be named a<number>")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [[] for _ in ids]
        for batch in batches:
            for k in range(len(ids)):
                held[k].append(batch.column(k).to_numpy(zero_copy_only=False).astype(VALUE))
        columns = [np.concatenate([np.zeros(0, VALUE), *x]) for x in held]
        if len(columns[0]):
            path = f"{directory}/part-{TaskContext.get().partitionId():05d}/{len(columns[0])}_{'_'.join(ids)}.db"
            put_file(path, b"".join(x.tobytes() for x in columns))
            yield pa.RecordBatch.from_pydict({"path": [path]})

    bad = lambda c: F.raise_error(F.concat(F.lit(f"{c} has no 32-bit number: "), F.coalesce(F.col(c).cast("string"), F.lit("NULL")))).cast("int")
    whole = df.select(*[F.coalesce(F.col(c).try_cast("int"), bad(c)).alias(c) for c in df.columns])
    return sorted(r["path"] for r in whole.mapInArrow(write, "path string").collect())


def listed(directory: str, suffixes: Sequence[str] = (".db",)) -> list[str]:
    """Files of a directory tree by suffix, sorted; of names that differ only in the suffix, the first suffix wins."""
    system, base = _open(directory)
    found: dict[str, str] = {}
    for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
        for rank, suffix in enumerate(suffixes):
            if info.type == fs.FileType.File and info.path.endswith(suffix):
                stem = info.path.removesuffix(suffix)
                if stem not in found or rank < next(k for k, s in enumerate(suffixes) if found[stem].endswith(s)):
                    found[stem] = info.path
    return [found[k] for k in sorted(found)]


def read_relation(spark: SparkSession, directory: str) -> DataFrame:
    """All files under a directory as one relation."""
    out = None
    for path in listed(directory):
        part = read_columnar(spark, path)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise FileNotFoundError(f"no .db file in {directory}")
    return out


def read_relations(spark: SparkSession, directory: str, order: Sequence[int] | None = None) -> list[DataFrame]:
    """One relation for each file, in the order of their names or as `order` says."""
    made = [read_columnar(spark, path) for path in listed(directory)]
    return made if order is None else [made[k] for k in order]


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """A two-column file as (src, dst)."""
    held = read_columnar(spark, path)
    if len(held.columns) != 2:
        raise ValueError(f"{path} has {len(held.columns)} columns")
    return held.toDF("src", "dst")
