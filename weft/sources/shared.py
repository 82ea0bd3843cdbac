"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a temporary folder of this machine, but only with a local master, as
    in tests: on a cluster that folder would be another one on each machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or f"{tempfile.gettempdir()}/weft-shared"


def checkpointed(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def new_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/weft/{tag}-{uuid.uuid4().hex}"


def held(df: DataFrame, tag: str = "held") -> DataFrame:
    """Written as a table to the shared folder and read again: computed once, however often it is used."""
    path = new_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors' Python workers, once a context: they may not have it on their path."""
    context = spark.sparkContext
    if not getattr(context, "_weft_shipped", False):
        root = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="weft-")) / "weft_package.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(to))
        context._weft_shipped = True
    return spark
