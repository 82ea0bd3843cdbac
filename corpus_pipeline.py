"""A training-data pipeline of five stages, each over all that the one before has kept.

toxicity: documents whose score is 0.5 or more go. near_duplicates: one document of each component of links stays.
decontaminate: documents with windows of two or more benchmark items go; of others, 8-word windows of an item, or all of
an item of 2 to 7 words, are cut out. secrets: found secrets are replaced by [SECRET]. bpe: token ids, and the text that they decode to.

Every stage but the last returns the columns of its input, whatever else they are named; n_chars follows a text that a
stage changes. The toxicity model is learned from labelled rows of the input outside crc32(doc_id) mod 5 = 0.

Defined results. Null and empty texts pass all stages: they are neither toxic nor copies, and have no hits; the last
stage gives them no ids and the empty text. Null ids are ids without labels. Of rows equal in id and text, one stays, if
the text has words; of a component's rows, that of the smallest id that isn't null stays, and among rows of that id the
one of the smaller hash of id and text. The last stage's own columns are ids, n_tokens and text; input columns of these
names (but for text) come back as <name>_input. An empty table passes as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm import bpe, decontaminate, ngram_join, secrets, toxicity
from weft.llm.base import col, drop_written, hold, outer_names, prepared, table, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _counted(before: DataFrame, after: DataFrame) -> DataFrame:
    """n_chars of the text as it now is, where it was right before."""
    if "n_chars" not in before.columns:
        return after
    length = F.coalesce(F.char_length("text"), F.lit(0)).cast(before.schema["n_chars"].dataType)
    return after.withColumn("n_chars", F.when(F.col("n_chars").isNull(), F.col("n_chars")).otherwise(length))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    made = toxicity.score(docs, toxicity.fitted(spark, docs, sf_dir))
    return made.filter(F.col("score") < 0.5).select(*[col(c) for c in made.columns[: len(docs.columns)]]).toDF(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.one_of_each(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(docs, decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(docs, secrets.redact(docs))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = [c for c in docs.columns if c != "text"]
    coded = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, rest, decoded=True)
    new = ["ids", "n_tokens", "text"]
    kept = [col(c).alias(f"k{i}") for i, c in enumerate(coded.columns[: len(rest)])]
    return coded.select(*kept, "ids", F.size("ids").cast("long"), F.col("decoded").cast("string")).toDF(*outer_names(rest, new), *new)


def _prepared(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    return lambda spark, docs, sf_dir: stage(prepared(spark), docs, sf_dir)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", _prepared(toxicity_stage)),
    ("near_duplicates", _prepared(near_duplicates_stage)),
    ("decontaminate", _prepared(decontaminate_stage)),
    ("secrets", _prepared(secrets_stage)),
    ("bpe", _prepared(bpe_stage)),
]

#: The toxicity model and the token ids can't be expressed in SQL; tests/llm compare each stage with a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; what each returns is written to the shared folder and read again, and what
    it held for itself is deleted then."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        since = written()
        docs = hold(stage(spark, docs, sf_dir), f"pipeline-{name}")
        drop_written(spark, since, 1)
    return STAGES[-1][1](spark, docs, sf_dir)
