"""Whole texts and ties, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from weft.llm import ann, decontaminate, lm, ngram_join

SF = "/root/testdata/sf0.001"


def test_trigram_scores_are_registered(spark):
    found = {r["doc_id"]: r["mean_log_score"] for r in entry.queries()["op8_lm_score_trigrams"](spark, SF).collect()}
    made = lm.score(spark.read.parquet(f"{SF}/documents.parquet"), ["doc_id"], order=3)
    want = {r["doc_id"]: r["m"] for r in made.select("doc_id", F.round("mean_log_score", 6).alias("m")).collect()}
    assert found == pytest.approx(want, abs=2e-6)
    assert found != {r["doc_id"]: r["mean_log_score"] for r in entry.queries()["op8_lm_score"](spark, SF).collect()}


@pytest.mark.parametrize("item", ["one two", "one two three four five", "one two three four five six seven"])
def test_short_items_are_cut(spark, item):
    docs = spark.createDataFrame([(1, f"before {item.upper()}, after"), (2, "one, after"), (3, None)], "doc_id long, text string")
    out = decontaminate.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: "before  , after", 2: "one, after", 3: None}


def test_ties_go_to_smaller_columns():
    rng = np.random.default_rng(5)
    scores = rng.integers(0, 4, (200, 60)).astype(float)
    for k in (1, 5, 21):
        want = [sorted(sorted(range(60), key=lambda c: (-row[c], c))[:k]) for row in scores]  # noqa: B023
        assert [sorted(r) for r in ann.top(scores, k).tolist()] == want


def test_nearest_of_binary_vectors(spark):
    rng = np.random.default_rng(6)
    vectors = np.unique(rng.integers(0, 2, (400, 12)), axis=0)
    vectors = rng.permutation(vectors[vectors.any(1)]).astype(np.float32)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    found = ann.nearest(df, F.col("vec_id") % 20 == 0, 10, leaf_rows=1000, recall=1.0).collect()
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in found}
    scores = vectors @ vectors.T
    for q in range(0, len(vectors), 20):
        want = sorted((k for k in range(len(vectors)) if k != q), key=lambda k: (-scores[q, k], k))[:10]  # noqa: B023
        assert [got[q, r] for r in range(1, 11)] == want


@pytest.mark.parametrize("share", [0.0, 0.2, 1.0])
def test_hot_shingles_are_spread_whole(spark, monkeypatch, share):
    monkeypatch.setattr(ngram_join, "SHARE", share)
    rows = [(node, key, node % 2, node % 3, node % 4 if key else 7) for key in range(4) for node in range(40 if key < 2 else 3 * key)]
    apart = spark.createDataFrame(rows, "node long, key long, slot int, part int, label long")
    tally = {}
    for node, key, slot, part, label in rows:
        tally.setdefault((key, slot), []).append((part, label))
    held = [(k, s, len({y for _, y in v}) > 1 and len({x for x, _ in v}) > 1, sorted({x for x, _ in v}), len(v)) for (k, s), v in tally.items()]
    made = ngram_join._spread(apart, spark.createDataFrame(held, "key long, slot int, mixed boolean, parts array<int>, n long"))
    got = sorted((r["node"], r["key"], r["slot"], r["part"], tuple(r["parts"])) for r in made.collect())
    of = {(k, s): tuple(p) for k, s, mixed, p, _ in held if mixed}
    assert got == sorted((node, key, slot, part, of[key, slot]) for node, key, slot, part, _ in rows if (key, slot) in of)
    assert of and len(of) < len(held)
