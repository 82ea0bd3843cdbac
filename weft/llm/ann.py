"""Approximate nearest neighbours by largest inner product: a forest of random-projection trees, one shared queue a
query, and exact reranking of the leaves' vectors.

Vectors get one more component that makes all lengths equal, so the largest inner product is the smallest angle. Trees
split a bounded sample (`sample_rows`) halfway between two of a node's rows; then every vector is put into its leaf of
each tree. A query walks all trees through one queue, ordered by the squared margins that a way has crossed, until its
leaves hold `enough` rows; scores are then taken in double precision on the original vectors, leaf by leaf.

A query's k + 1 best rows of the sample are candidates like those of its leaves, and their last score is a bound: what a
leaf has below it can't be among the nearest, and isn't passed on.

How much is enough is measured: for `probes` queries the exact neighbours over all rows are found by brute force, and
the least number of rows is taken that gives them back with a mean recall of `recall`. So the index searches little
where the data allow it, and as much as needed where they don't (vectors like noise need about half of all rows).

Equal vectors are one entry of the index with their k + 1 smallest ids, which is all that a query's k nearest can use,
and a query vector that many rows share is searched once; so a hot vector is neither a large leaf nor repeated work.
Leaves are reranked in tiles: at most about TILE_ROWS of a leaf's rows with TILE_ASKS of its visits, so neither a large
leaf nor one that many queries visit is a large task. Cost: shuffled are trees * rows * dimension floats, and
queries * leaves visited; nothing is joined pair by pair.

Defined results: null vectors, vectors with null or non-finite components or of length 0, and those of another
dimension than the commonest one (the smaller, of two) take no part, nor do rows whose id is null. Rows with equal id
and vector count once; a row is not a candidate of queries with its own id. An empty table gives no rows. Vectors of
doubles stay doubles, others are taken as floats, which hold them exactly if they are floats.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.shared import ship
from .base import col, hold, table
from .forest import Forest, build

#: Rows of the sample, trees, rows of a leaf that is aimed at, probes, their mean recall, and rows of a bucket of leaves.
SAMPLE_ROWS, TREES, LEAF_ROWS, PROBES, RECALL, BUCKET_ROWS = 16_384, 16, 256, 64, 0.95, 1 << 16
#: Rows of a leaf and visits to it that are scored together, and visits in one matrix product.
TILE_ROWS, TILE_ASKS, PRODUCT_ASKS = 1 << 14, 1 << 12, 256


def usable(vec: Column) -> Column:
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)


def per_batch(df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], dict]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(work(batch))

    return df.mapInArrow(run, schema)


def best(query: np.ndarray, found: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best distinct entries of each query."""
    order = np.lexsort((found, -score, query))
    query, found, score = query[order], found[order], score[order]
    again = np.zeros(len(query), bool)
    again[1:] = (query[1:] == query[:-1]) & (found[1:] == found[:-1])  # the same entry through another leaf
    query, found, score = query[~again], found[~again], score[~again]
    place = np.arange(len(query)) - np.searchsorted(query, query)
    return query[place < k], found[place < k], score[place < k]


def top(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest; of those that tie with the k-th, the first columns."""
    if scores.shape[1] <= k:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    at = np.argpartition(-scores, k - 1, 1)[:, :k]
    least = np.take_along_axis(scores, at, 1).min(1, keepdims=True)
    tied = np.flatnonzero((scores >= least).sum(1) > k)
    at[tied] = np.argsort(-scores[tied], 1, kind="stable")[:, :k]
    return at


def _truth(shared, k: int):
    """Exact neighbours of the probes within a batch, with their leaves."""

    def work(batch: pa.RecordBatch) -> dict:
        probes = shared.value
        batch = batch.sort_by("entry")  # ties go to the smaller entry
        scores = probes @ matrix(batch.column(1)).astype(np.float64).T
        at = top(scores, k)
        q = np.repeat(np.arange(len(probes)), at.shape[1])
        found = at.ravel()
        return {"q": pa.array(q, pa.int32()), "entry": batch.column(0).take(pa.array(found)), "score": scores[q, found], "n": batch.column(3).take(pa.array(found)), "leaves": batch.column(2).take(pa.array(found))}

    return work


def enough_rows(forest: Forest, sizes: np.ndarray, probes: np.ndarray, truth: list[list[tuple[int, list[int]]]], recall: float, k: int) -> int:
    """The fewest rows of leaves with which the mean recall of the probes' true neighbours is reached. truth: a probe's
    entries, best first, with the number of rows that each stands for."""
    needed = []
    for query, neighbours in zip(probes, truth, strict=True):
        order = forest.search(query, sizes, 1 << 62)
        before = np.full(len(sizes), 1 << 62)
        before[order] = np.cumsum(sizes[order]) - sizes[order]  # rows held when the leaf is still taken: one less will do
        left = k
        for rows, leaves in neighbours:
            if (took := min(rows, left)) > 0:
                needed.append((int(min(before[leaf] for leaf in leaves)) + 1, took / k))
                left -= took
    needed.sort()
    have = np.cumsum([w for _, w in needed])
    return needed[min(int(np.searchsorted(have, recall * have[-1])), len(needed) - 1)][0]


def nearest(rows: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", n_trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, probes: int = PROBES, recall: float = RECALL, seed: int = 3) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest of the rows for which `queries` holds."""
    spark = ship(rows.sparkSession)
    stored = rows.select(col(vec_col).alias("vec")).schema["vec"].dataType.elementType.simpleString()
    array = f"array<{'float' if stored == 'float' else 'double'}>"
    all_rows = rows.select(col(id_col).cast("long").alias("id"), col(vec_col).cast(array).alias("vec"), F.coalesce(queries, F.lit(False)).alias("asks")).filter(F.col("id").isNotNull() & usable(F.col("vec")))
    common = all_rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    result = "query_id long, rank int, vec_id long, score double"
    if common is None:
        return spark.createDataFrame([], result)
    all_rows = all_rows.filter(F.size("vec") == common["d"])

    # Entries: distinct vectors, with the k + 1 smallest ids of each; the limit of a rank is applied before the shuffle.
    ranked = all_rows.select("id", "vec", F.dense_rank().over(Window.partitionBy("vec").orderBy("id")).alias("r")).filter(F.col("r") <= k + 1)
    entries = hold(ranked.groupBy("vec").agg(F.array_sort(F.collect_set("id")).alias("ids")).select(F.element_at("ids", 1).alias("entry"), "ids", "vec", F.xxhash64("vec").alias("h")), "entries")
    asked = all_rows.filter("asks").select(F.col("id").alias("query_id"), "vec").distinct().withColumn("h", F.xxhash64("vec"))
    asked = hold(asked.join(entries.select("h", "entry", F.col("vec").alias("v")), "h").filter("vec = v").select("query_id", "entry"), "asked")
    n, limit = entries.agg(F.count("*"), F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)))).first()

    drawn = entries.orderBy("h").limit(sample_rows).select("entry", "vec").toArrow().combine_chunks()  # bounded
    sample = matrix(drawn.column("vec").combine_chunks()).astype(np.float64)
    forest = build(sample, n_trees, max(2, leaf_rows * len(sample) // n), seed, float(limit) * (1 + 1e-6))
    by_entry = np.argsort(drawn.column("entry").to_numpy())  # ties go to the smaller entry
    # Bounded by sample_rows * trees.
    shared = spark.sparkContext.broadcast(forest)
    known = spark.sparkContext.broadcast((drawn.column("entry").to_numpy()[by_entry], np.ascontiguousarray(sample[by_entry].T)))

    def place(batch: pa.RecordBatch) -> dict:
        f = shared.value
        leaves = f.leaves(f.lift(matrix(batch.column(1)).astype(np.float64)))
        return {"entry": batch.column(0), "vec": batch.column(1), "n": batch.column(2), "leaves": pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1) * leaves.shape[1], pa.int32()), pa.array(leaves.ravel(), pa.int32()))}

    placed = hold(per_batch(entries.select("entry", "vec", F.size("ids").alias("n")), f"entry long, vec {array}, n int, leaves array<int>", place), "placed")
    sizes = np.zeros(forest.n_leaves, np.int64)
    for r in placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").count().toLocalIterator():  # bounded by the forest
        sizes[r["leaf"]] = r["count"]

    searched = asked.select("entry").distinct().join(entries.select("entry", "vec"), "entry")
    chosen = searched.orderBy(F.xxhash64("entry", F.lit(seed))).limit(probes).select("vec").toArrow().column("vec").combine_chunks()
    if not len(chosen):
        return spark.createDataFrame([], result)
    asks = matrix(chosen).astype(np.float64)
    truth = per_batch(placed.select("entry", "vec", "leaves", "n"), "q int, entry long, score double, n int, leaves array<int>", _truth(spark.sparkContext.broadcast(asks), k + 1))
    truth = truth.select("q", "n", "leaves", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "entry")).alias("r")).filter(F.col("r") <= k + 1).orderBy("q", "r").collect()  # probes * (k + 1)
    by_probe: list[list[tuple[int, list[int]]]] = [[] for _ in asks]
    for r in truth:
        by_probe[r["q"]].append((r["n"], r["leaves"]))
    enough = enough_rows(forest, sizes, asks, by_probe, recall, k + 1)

    def in_sample(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best entries of the sample for each query, and their scores."""
        found, score = [], []
        for part in (own[i : i + PRODUCT_ASKS // 4] for i in range(0, len(own), PRODUCT_ASKS // 4)):
            scores = part @ known.value[1]
            at = top(scores, k + 1)
            found.append(known.value[0][at])
            score.append(np.take_along_axis(scores, at, 1))
        return np.concatenate(found), np.concatenate(score)

    def first_found(batch: pa.RecordBatch) -> dict:
        found, score = in_sample(matrix(batch.column(1)).astype(np.float64))
        return {"ask": batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), found.shape[1]))), "entry": found.ravel(), "score": score.ravel()}

    def visit(batch: pa.RecordBatch) -> dict:
        own = matrix(batch.column(1)).astype(np.float64)
        leaves = [shared.value.search(q, sizes, enough) for q in own]
        at = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
        score = in_sample(own)[1]
        bound = score.min(1) - 1e-9 * np.abs(score).max(1) if score.shape[1] > k else np.full(len(own), -np.inf)
        return {"entry": batch.column(0).take(pa.array(at)), "vec": batch.column(1).take(pa.array(at)), "leaf": pa.array(np.concatenate(leaves), pa.int32()), "bound": bound[at]}

    # Tiles of a leaf: parts of its rows times parts of its visits, each dealt by hash. Both are bounded by the forest.
    visits = hold(per_batch(searched.select("entry", "vec"), f"entry long, vec {array}, leaf int, bound double", visit), "visits")
    asked_of = np.zeros(forest.n_leaves, np.int64)
    for r in visits.groupBy("leaf").count().toLocalIterator():
        asked_of[r["leaf"]] = r["count"]
    n_home, n_ask = -(-sizes // TILE_ROWS), -(-asked_of // TILE_ASKS)
    loads = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(n_home, n_ask, strict=True)) if a and b], "leaf int, n_home int, n_ask int")
    n_buckets = max(1, int((sizes * n_ask + asked_of * n_home)[(n_home > 0) & (n_ask > 0)].sum()) // BUCKET_ROWS)
    mine = lambda n: F.pmod(F.xxhash64("entry"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    visits = visits.join(F.broadcast(loads), "leaf").select("entry", "vec", "leaf", "bound", every("n_home").alias("home"), mine("n_ask").alias("part"), F.lit(True).alias("asks"))
    homes = placed.select("entry", "vec", F.explode("leaves").alias("leaf")).join(F.broadcast(loads), "leaf").select("entry", "vec", "leaf", F.lit(0.0).alias("bound"), mine("n_home").alias("home"), every("n_ask").alias("part"), F.lit(False).alias("asks"))

    def rerank(held: pa.Table) -> pa.Table:
        held = held.combine_chunks()
        leaf, home, visit_part, asks, entry = (held.column(c).to_numpy() for c in ("leaf", "home", "part", "asks", "entry"))
        vec, bound = matrix(held.column("vec").combine_chunks()), held.column("bound").to_numpy()
        order = np.lexsort((entry, asks, visit_part, home, leaf))  # ties go to the smaller entry
        changes = (np.diff(leaf[order]) != 0) | (np.diff(home[order]) != 0) | (np.diff(visit_part[order]) != 0)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for tile in np.split(order, np.flatnonzero(changes) + 1):
            cut = len(tile) - int(asks[tile].sum())
            rows, ask = tile[:cut], tile[cut:]
            if not len(rows) or not len(ask):
                continue
            of = vec[rows].astype(np.float64).T
            for at in (ask[i : i + PRODUCT_ASKS] for i in range(0, len(ask), PRODUCT_ASKS)):
                scores = vec[at].astype(np.float64) @ of
                near = top(scores, k + 1)
                score = np.take_along_axis(scores, near, 1)
                i, j = np.nonzero(score >= bound[at][:, None])
                out.append((entry[at][i], entry[rows][near[i, j]], score[i, j]))
        q, found, score = best(*(np.concatenate(x) for x in zip(*out, strict=True)), k + 1) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"ask": q, "entry": found, "score": score})

    near = visits.unionByName(homes).withColumn("bucket", F.pmod(F.xxhash64("leaf", "home", "part"), F.lit(n_buckets))).groupBy("bucket").applyInArrow(rerank, "ask long, entry long, score double")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    near = near.unionByName(per_batch(searched.select("entry", "vec"), "ask long, entry long, score double", first_found))
    near = near.unionByName(searched.select(F.col("entry").alias("ask"), "entry", norm.alias("score")))  # copies of the query, wherever they lie
    first = Window.partitionBy("ask").orderBy(F.desc("score"), "entry")
    near = near.groupBy("ask", "entry").agg(F.max("score").alias("score")).withColumn("r", F.row_number().over(first)).filter(F.col("r") <= k + 1)
    each = near.join(entries.select("entry", "ids"), "entry").select("ask", "score", F.explode("ids").alias("vec_id"))
    kept = each.withColumn("r", F.row_number().over(Window.partitionBy("ask").orderBy(F.desc("score"), "vec_id"))).filter(F.col("r") <= k + 1)
    lists = kept.groupBy("ask").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))
    answers = asked.join(lists, asked["entry"] == lists["ask"]).select("query_id", F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return answers.select("query_id", F.posexplode("near").alias("pos", "x")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
