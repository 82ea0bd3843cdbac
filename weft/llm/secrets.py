"""Secret scans over an incremental ledger of blobs.

A blob is a distinct text, named by its SHA-256. The ledger is a Parquet table of (blob_id, rule_version, findings):
a scan looks only at blobs that the ledger doesn't have for this rule version, appends them, whether they hold a
secret or not, and joins findings back to every row (path, version) that has the blob. Equal texts meet in one row
before any text is shuffled further (one partial row per blob and task), so a hot blob stays one row a task; the
join back carries no texts.

Rules. Base: assign, access, hex. The method's own: pem (private key blocks) and jwt. Findings of a blob are spans in
code points, sorted by start, then by the rules' order.

Defined results: a null text is the empty blob; repeated rows and paths each get their own row; rows whose id is null
are scanned too; an empty table scans nothing; input columns named as a result column come back as <name>_input.
A ledger is written by one scan at a time.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .base import col, exists, inner, map_rows, outer_names, scratch, table
from .route import split

#: The base rules' patterns (letters of assign's names in either case) and least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # each run of [0-9a-f] is one leftmost match, kept from 24 characters on
PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?!-----BEGIN)[\s\S])*?-----END [A-Z ]*PRIVATE KEY-----")
#: jwt: eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+, found by its dotted runs in linear time
DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]++)+", re.ASCII)
KINDS = ("assign", "access", "hex", "pem", "jwt")
BASE_KINDS = KINDS[:3]
RULE_VERSION = "1"
NAMES = re.compile(r"passw|secret|token|api", re.ASCII | re.IGNORECASE)
FINDINGS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def tokens_in(text: str) -> list[tuple[int, int]]:
    """Spans of jwt, leftmost and not overlapping: of a run's parts between dots, three in a row, of which the first one
    has eyJ and more behind it, and the second one begins so."""
    found = []
    for run in DOTTED.finditer(text):
        parts, starts, at = run[0].split("."), [], run.start()
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        k = 0
        while k + 2 < len(parts):
            lead = parts[k].find("eyJ")
            if 0 <= lead < len(parts[k]) - 3 and parts[k + 1].startswith("eyJ") and len(parts[k + 1]) > 3:
                found.append((starts[k] + lead, starts[k + 2] + len(parts[k + 2])))
                k += 3
            else:
                k += 1
    return found


def scan_text(text: str) -> list[tuple[str, int, int]]:
    found = []
    if NAMES.search(text):
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        found += [("pem", *m.span()) for m in PEM.finditer(text)]
    if "eyJ" in text:
        found += [("jwt", a, b) for a, b in tokens_in(text)]
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


def _work(texts: pa.Array) -> list:
    return [[[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t)] for t in texts.to_pylist()]]


def scan_new(blobs: DataFrame, ledger: str, rule_version: str = RULE_VERSION) -> DataFrame:
    """Appends what the ledger hasn't seen of blobs (blob_id, text) and returns the ledger's rows of this version."""
    spark = blobs.sparkSession
    schema = T.StructType([T.StructField("blob_id", T.StringType()), T.StructField("findings", FINDINGS), T.StructField("rule_version", T.StringType())])
    todo = blobs
    if exists(spark, ledger):
        seen = spark.read.schema(schema).parquet(ledger).filter(F.col("rule_version") == rule_version)
        todo = blobs.join(seen.select("blob_id"), "blob_id", "left_anti")
    unique = todo.groupBy("blob_id").agg(F.first("text").alias("text"))
    made = map_rows(unique, ["blob_id"], "text", [T.StructField("findings", FINDINGS)], _work).withColumn("rule_version", F.lit(rule_version))
    made.write.mode("append").partitionBy("rule_version").option("compression", "zstd").parquet(ledger)
    return spark.read.schema(schema).parquet(ledger).filter(F.col("rule_version") == rule_version)


def scan_secrets(docs: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """`keep` columns of each row (all, if None), blob_id and findings. Without a ledger's path a new one is begun."""
    keep = list(dict.fromkeys(docs.columns if keep is None else keep))
    text = F.coalesce(col(text_col), F.lit(""))
    ledger = ledger or scratch(docs.sparkSession, "ledger")
    rows = scan_new(docs.select(F.sha2(text, 256).alias("blob_id"), text.alias("text")), ledger, rule_version)
    hits = rows.filter(F.size("findings") > 0).select(F.col("blob_id").alias("blob"), "findings")
    at = inner(docs, keep, blob_id=F.sha2(text, 256))
    joined = at.join(hits, at["blob_id"] == hits["blob"], "left")
    made = joined.select(*[f"k{i}" for i in range(len(keep))], "blob_id", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))
    return made.toDF(*outer_names(keep, ["blob_id", "findings"]), "blob_id", "findings")


def masked(text: Column, findings: Column) -> Column:
    """The text with each finding's characters replaced by [SECRET]; overlapping findings are one."""
    from .decontaminate import merged

    spans = merged(F.transform(findings, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"))))
    begins = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.char_length(text).cast("long")))
    parts = F.transform(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda x: F.substring(text, (x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")))
    return F.when(F.size(findings) > 0, F.array_join(parts, "[SECRET]")).otherwise(text)


def redact(docs: DataFrame, ledger: str | None = None, rule_version: str = RULE_VERSION, text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, secrets replaced in the text; a text without any comes back unchanged.

    Texts without findings aren't shuffled again: only rows whose blob may have some are joined (route.py)."""
    flat, own = inner(docs, docs.columns), [f"k{i}" for i in range(len(docs.columns))]
    name = own[docs.columns.index(text_col)]
    text = F.coalesce(F.col(name), F.lit(""))
    blob = F.sha2(text, 256)
    ledger = ledger or scratch(docs.sparkSession, "ledger")
    rows = scan_new(flat.select(blob.alias("blob_id"), text.alias("text")), ledger, rule_version)
    hits = rows.filter(F.size("findings") > 0).select(F.col("blob_id").alias("blob"), "findings", F.xxhash64("blob_id").alias("hit"))
    clean, rest = split(flat, F.xxhash64(blob), hits, "hit")
    found = rest.join(hits, (rest["__key"] == hits["hit"]) & (F.sha2(F.coalesce(rest[name], F.lit("")), 256) == hits["blob"]), "left")
    columns = [F.when(F.col("findings").isNull(), F.col(c)).otherwise(masked(F.col(c), F.col("findings"))).alias(c) if c == name else F.col(c) for c in own]
    return clean.select(*own).unionByName(found.select(*columns)).toDF(*docs.columns)


def joined_spans(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base = F.filter("findings", lambda f: f["kind"].isin(*BASE_KINDS))
    of = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    count = [of(k).alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *count, F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("findings")).alias("spans"))
