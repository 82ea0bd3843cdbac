"""What the operators of this subpackage share: column passing, Arrow batches, shared scratch tables.

Kept columns go through operators under names of their own (k0, k1, ...), by place: an input column may be named as
anything, with dots, like an internal column or like another one.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_dir, ship

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: Bytes of text that a worker turns into numpy arrays at a time (one longer text is taken alone, whole).
CHUNK_BYTES = 1 << 20


def release() -> None:
    """Gives memory that a worker no longer uses back to the system: workers live on for other stages."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


#: Rows of an Arrow batch, where the session has Spark's default: texts of a few kB then take some MB a batch.
BATCH_ROWS, DEFAULT_ROWS = "1000", "10000"


def prepared(spark: SparkSession) -> SparkSession:
    """The session, with this package on its workers and batches of whole texts that take little memory there. The
    batch size is the session's from then on, for registered queries and pipeline stages; operators that are called
    directly leave it as it is."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == DEFAULT_ROWS:
        spark.conf.set(name, BATCH_ROWS)
    return ship(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def outer_names(names: list[str], new: list[str]) -> list[str]:
    """Names under which kept columns come back: those that an operator needs for its results become <name>_input."""
    taken = {c.lower() for c in names} | {n.lower() for n in new}
    lowered = {n.lower() for n in new}
    out = []
    for c in names:
        if c.lower() in lowered:
            c = f"{c}_input"
            while c.lower() in taken:
                c += "_"
            taken.add(c.lower())
        out.append(c)
    return out


def inner(df: DataFrame, keep: list[str], **more: Column) -> DataFrame:
    """The kept columns as k0, k1, ... and the columns of `more`."""
    return df.select(*[col(c).alias(f"k{i}") for i, c in enumerate(keep)], *[x.alias(name) for name, x in more.items()])


_kept: dict[int, tuple] = {}


def once(shared, make: Callable):
    """make(the broadcast's value), built once a worker, not once a task; few of them are kept at a time."""
    value = shared.value
    if id(value) not in _kept:
        if len(_kept) >= 2:
            _kept.clear()
        _kept[id(value)] = (value, make(value))
    return _kept[id(value)][1]


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def utf8_chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; every row is in exactly one of them."""
    sizes = np.diff(utf8(texts)[1])
    begin, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield begin, i
            begin, held = i, 0
        held += size
    if begin < len(texts):
        yield begin, len(texts)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2] if len(texts) else None
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def map_rows(df: DataFrame, keep: list[str], text_col: str, new: list[T.StructField], work: Callable[[pa.Array], list], chunk: int = CHUNK_BYTES) -> DataFrame:
    """`keep` of each row and the `new` columns that work(texts of a chunk) returns, row by row in order.

    Nothing is shuffled; one chunk of texts is held at a time.
    """
    ship(df.sparkSession)
    keep = list(dict.fromkeys(keep))
    held = inner(df, keep, text=col(text_col))
    schema = T.StructType([*held.schema.fields[:-1], *new])
    kinds = [arrow_type(f.dataType) for f in new]
    names = [f.name for f in schema.fields]
    n_kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(n_kept)
            for a, b in utf8_chunks(texts, chunk):
                out = work(texts.slice(a, b - a))
                made = [x if isinstance(x, pa.Array) else pa.array(x, kind) for x, kind in zip(out, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(n_kept)), *made], names=names)
                del out, made
            del batch, texts
            release()

    added = [f.name for f in new]
    return held.mapInArrow(run, schema).toDF(*outer_names(keep, added), *added)


#: Bytes that a writer of a held table gathers before it writes them: many are open at a time, and all is read again.
HELD_BYTES = 16 << 20
#: Paths of the tables that this process has written for its own use, in order.
_written: list[str] = []


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the folder that driver and executors share."""
    path = f"{shared_dir(spark).rstrip('/')}/weft/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def hold(df: DataFrame, tag: str) -> DataFrame:
    """Written to the shared folder and read again: lineage ends here, and a lost executor loses nothing of it."""
    path = scratch(df.sparkSession, tag)
    df.write.option("compression", "zstd").option("parquet.block.size", HELD_BYTES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many held tables there are, for drop_written(since=...)."""
    return len(_written)


def drop_written(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Deletes held tables, but for those written before `since` and the last `keep`. To be called when the results of
    the queries that wrote them have been read or written: results are lazy and read them."""
    gone = _written[since : len(_written) - keep]
    del _written[since : len(_written) - keep]
    for path in gone:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where))
