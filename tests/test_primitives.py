import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weft.functions import scalar as X
from weft.functions.checksum import checksum
from weft.operators import primitives as P


def test_scans(spark, rows):
    rnd = random.Random(5)
    data = [(k, rnd.randrange(-50, 50)) for k in range(500)]
    rnd.shuffle(data)
    df = spark.createDataFrame(data, "i int, v int")
    total, incl, excl, top = 0, [], [], []
    for k, v in sorted(data):
        excl.append((k, total))
        total += v
        incl.append((k, total))
        top.append((k, max(x for i, x in data if i <= k)))
    made = [P.scan(df, ["i"], "v", "s", op, inclusive).select("i", "s") for op, inclusive in (("sum", True), ("sum", False), ("max", True))]
    for got, want in zip(made, (incl, excl, top), strict=True):
        assert sorted(tuple(r) for r in got.collect()) == want
    assert P.scan(df.limit(0), ["i"], "v", "s").count() == 0


def test_runs(spark, rows):
    df = spark.createDataFrame([(0, k, v) for k, v in enumerate("aabbba")], "g int, i int, v string")
    assert rows(P.runs(df, "g", "i", "v").select("run", "v", "length")) == [(1, "a", 2), (2, "b", 3), (3, "a", 1)]
    assert P.nontrivial_runs(df, "g", "i", "v").count() == 2
    assert rows(P.unique_consecutive(df, "g", "i", "v").select("i")) == [(0,), (2,), (5,)]


def test_insert_remove_partition(spark, rows):
    df = spark.createDataFrame([(k, c) for k, c in enumerate("abcde")], "i int, c string")
    kept = P.bulk_remove(df, "i", spark.createDataFrame([(1,), (3,)], "x int"))
    assert rows(kept.select("i", "c")) == [(0, "a"), (1, "c"), (2, "e")]
    more = P.bulk_insert(df, "i", spark.createDataFrame([(0, "x"), (2, "y")], "i int, c string"))
    assert "".join(r["c"] for r in more.orderBy("i").collect()) == "xabycde"
    order = P.partition_if(df, F.col("c").isin("b", "d"), "i").orderBy("place")
    assert "".join(r["c"] for r in order.collect()) == "bdeca"


def test_bounds(spark):
    rnd = random.Random(2)
    hay, needles = [rnd.randrange(40) for _ in range(200)], [rnd.randrange(-2, 45) for _ in range(50)]
    h, n = spark.createDataFrame([(x,) for x in hay], "v int"), spark.createDataFrame([(x,) for x in needles], "v int")
    for upper, side in ((False, "left"), (True, "right")):
        got = sorted((r["v"], r["bound"]) for r in P.bounds(n, h, "v", upper).collect())
        assert got == sorted((x, int(np.searchsorted(sorted(hay), x, side))) for x in needles)


def test_expansion(spark, rows):
    df = spark.createDataFrame([(1, 2), (2, 0), (3, 1)], "k int, n int")
    assert rows(P.expand(df, "n").select("k", "rank")) == [(1, 0), (1, 1), (3, 0)]
    assert rows(P.segmented_reduce(df.select("k"), df.filter("n > 0"), "k", "n")) == [(1, 2), (2, 0), (3, 1)]
    assert rows(P.multivalue(spark.createDataFrame([(1, 3), (1, 1)], "k int, v int"), "k", "v")) == [(1, [1, 3])]


def test_list_rank(spark, rows):
    df = spark.createDataFrame([(3, 1), (1, 4), (4, None), (9, None)], "node int, next int")
    assert rows(P.list_rank(df)) == [(1, 1), (3, 2), (4, 0), (9, 0)]


def test_texts(spark):
    df = spark.createDataFrame([(1, "banana"), (2, "")], "id int, t string")
    made = P.suffix_array(df, "id", "t").orderBy("id", "rank").collect()
    assert [r["start"] for r in made if r["id"] == 1] == [5, 3, 1, 0, 4, 2]
    assert P.burrows_wheeler(df, "id", "t").filter("id = 1").first()["bwt"] == "annb\0aa"
    assert P.move_to_front(df, "id", "t").filter("id = 1").first()["codes"] == [1, 1, 2, 1, 1, 1]


def test_tridiagonal(spark):
    rnd = np.random.default_rng(1)
    a, c, b = rnd.random(6), rnd.random(6), rnd.random(6) + 3
    d = rnd.random(6)
    m = np.diag(b) + np.diag(a[1:], -1) + np.diag(c[:-1], 1)
    df = spark.createDataFrame([(0, k, float(a[k]), float(b[k]), float(c[k]), float(d[k])) for k in range(6)], "s int, i int, a double, b double, c double, d double")
    got = [r["x"] for r in P.tridiagonal_solve(df, "s", "i", "a", "b", "c", "d").orderBy("i").collect()]
    assert np.allclose(got, np.linalg.solve(m, d))


def test_hashes_and_powers(spark):
    def murmur(h):
        h &= 0xFFFFFFFF
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    keys = [0, 1, 7, 8, 123456789, 4294967295, 2**40 + 5]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    k = F.col("k")
    for r in df.select("k", X.murmur_finaliser(k).alias("m"), X.linear_hash(k, 3, 5, 101, 10).alias("l"), X.floor_power_of_2(k).alias("f"), X.ceil_power_of_2(k).alias("c")).collect():
        assert r["m"] == murmur(r["k"]) and r["l"] == (3 * r["k"] + 5) % 101 % 10
        if r["k"]:
            assert r["f"] == 1 << (r["k"].bit_length() - 1) and r["c"] == 1 << (r["k"] - 1).bit_length()


def test_checksum_ignores_order(spark):
    a = spark.createDataFrame([(1, 2), (3, 4)], "x int, y int")
    b = spark.createDataFrame([(3, 4), (1, 2)], "x int, y int")
    assert checksum(a).first() == checksum(b).first() != checksum(a.limit(1)).first()


def test_list_rank_refuses_rings(spark):
    with pytest.raises(ValueError, match="ring"):
        P.list_rank(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node int, next int"))


def test_change_flags_without_segments(spark, rows):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([None, None, 1, 1, 2, None, 2])], "at int, v int")
    assert rows(P.change_flags(df, ["at"], "v", "new").select("at", "new")) == [(0, True), (1, False), (2, True), (3, False), (4, True), (5, True), (6, True)]


def test_reduce_by_counts_copies(spark, rows):
    from weft.operators import functors

    df = spark.createDataFrame([(k % 2, 3) for k in range(101)] + [(0, 5)], "k int, v long")
    assert rows(functors.reduce_by(df, ["k"], "v", F.lit(0).cast("long"), lambda a, b: a + b)) == [(0, 51 * 3 + 5), (1, 150)]


def test_list_rank_broadcasts_nothing(spark, monkeypatch):
    """Nodes stay on the executors in every round, however small their files are."""
    plans = []
    held = P.held
    monkeypatch.setattr(P, "held", lambda df, *a: plans.append(df._jdf.queryExecution().executedPlan().toString()) or held(df, *a))
    nodes = spark.range(100).select(F.col("id").alias("node"), F.when(F.col("id") < 99, F.col("id") + 1).alias("next"))
    assert {r["node"]: r["rank"] for r in P.list_rank(nodes).collect()} == {k: 99 - k for k in range(100)}
    assert len(plans) > 6 and not any("Broadcast" in p for p in plans)
