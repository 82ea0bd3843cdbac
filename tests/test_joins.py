import random
from collections import Counter
from itertools import combinations

import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weft.operators import blocks
from weft.operators import natural_join as NJ
from weft.operators import patterns as pat
from weft.operators import skew
from weft.operators.natural_join import counted_join, join_count, lookup_join, natural_join, pairwise_chain, row_id_join
from weft.operators.sliced import hash_slices, range_slices, sliced_generic_join, sliced_join
from weft.operators.wcoj import adjacency, generic_join, nested_adjacency, triangle_levels
from weft.plans.hypergraph import greedy_order

R = [(1, 2), (1, 3), (1, 5), (2, 2), (2, 5), (9, 10)]
S = [(2, 3), (2, 5), (3, 2), (3, 5), (5, 5), (12, 17)]
T = [(1, 2), (1, 3), (2, 2), (2, 3), (2, 5), (22, 98)]
TOY = [(1, 2, 3), (1, 3, 2), (2, 2, 3), (2, 2, 5), (2, 5, 5)]


def rel(spark, data, *names):
    return spark.createDataFrame(data, ", ".join(f"{n} int" for n in names))


@pytest.fixture(scope="module")
def toy(spark):
    return [rel(spark, R, "a0", "a1"), rel(spark, S, "a1", "a2"), rel(spark, T, "a0", "a2")]


@pytest.mark.parametrize("strategy", ["auto", "broadcast", "shuffle_hash", "merge", "nested_loop"])
def test_toy_triangles(toy, rows, strategy):
    assert rows(natural_join(toy, strategy=strategy)) == TOY


def test_toy_other_strategies(toy, rows):
    assert rows(generic_join(toy)) == TOY
    assert rows(generic_join(toy, chunk=1)) == TOY
    assert rows(triangle_levels(*toy)) == TOY
    assert rows(sliced_join(toy, 4)) == TOY
    assert rows(sliced_generic_join(toy, ["a0", "a1", "a2"], 3)) == TOY
    assert rows(natural_join(toy, order="greedy")) == TOY
    assert generic_join(toy, ["a0", "a1", "a2"], []).first()["count"] == 5
    assert join_count(toy) == 5


def test_first_key_only(toy):
    assert natural_join(toy, keys="first").count() == 19


def test_k5(spark):
    edges = rel(spark, list(combinations(range(1, 6), 2)), "src", "dst")
    for pattern, n in ((pat.TRIANGLE, 10), (pat.FOUR_CLIQUE, 5), (pat.clique(5), 1)):
        assert pat.match(edges, pattern).count() == n
        assert pat.match(edges, pattern, strategy="wcoj").count() == n
        assert pat.count_matches(edges, pattern).first()["count"] == n


def test_bags_nulls_and_odd_keys(spark, rows):
    r = rel(spark, [(1, 1), (1, 1)], "a0", "a1")
    assert natural_join([r, rel(spark, [(1, 2)], "a1", "a2")]).count() == 2
    n = rel(spark, [(None, 1), (-1, 2), (2147483647, 3)], "a0", "a1")
    m = rel(spark, [(None, 7), (-1, 8), (2147483647, 9)], "a0", "a2")
    assert rows(natural_join([n, m])) == [(-1, 2, 8), (2147483647, 3, 9)]
    loop = rel(spark, [(1, 1)], "src", "dst")
    assert rows(pat.match(loop)) == [(1, 1, 1)]
    assert pat.match(loop, isomorphism=True).count() == 0
    assert pat.match(loop, drop_self_loops=True).count() == 0
    empty = rel(spark, [], "a0", "a1")
    assert natural_join([empty, m]).count() == 0 and natural_join([m, empty]).count() == 0
    assert generic_join([empty, rel(spark, S, "a1", "a2")], count_by=[]).first()["count"] == 0


def test_disconnected(spark):
    a, b = rel(spark, [(1,), (2,)], "a0"), rel(spark, [(3,)], "a1")
    with pytest.raises(ValueError):
        natural_join([a, b])
    assert natural_join([a, b], allow_cross=True).count() == 2


def test_greedy_order_avoids_cross_products(spark):
    a, b, c = rel(spark, [(1, 2)], "a0", "a1"), rel(spark, [(1, 2)], "a2", "a3"), rel(spark, [(1, 2)], "a1", "a2")
    assert greedy_order([a, b, c], [10, 1, 5]) == [0, 2, 1]


def test_limit_and_lookup(spark, toy, rows):
    assert natural_join(toy, limit=2).count() == 2
    dim = rel(spark, [(2, 20), (3, 30)], "a1", "v")
    assert rows(lookup_join(toy[0].filter("a0 = 1"), dim, "a1", assert_unique=True)) == [(2, 1, 20), (3, 1, 30), (5, 1, None)]
    with pytest.raises(ValueError):
        lookup_join(toy[0], rel(spark, [(2, 1), (2, 2)], "a1", "v"), "a1", assert_unique=True)
    pairs = row_id_join(rel(spark, [(1, 10), (1, 11)], "k", "i"), rel(spark, [(1, 20)], "k", "j"), "k", "i", "j")
    assert rows(pairs) == [(10, 20), (11, 20)]


def test_skewed_joins_equal_plain_ones(spark, rows):
    rnd = random.Random(3)
    left = rel(spark, [(0 if rnd.random() < 0.5 else rnd.randrange(50), k) for k in range(2000)], "k", "x")
    right = rel(spark, [(k, k * 2) for k in range(40)] + [(0, 7)], "k", "y")
    third = rel(spark, [(2 * k, k) for k in range(30)], "y", "z")
    plain = rows(left.join(right, "k").select("k", "x", "y"))
    assert rows(skew.salted_join(left, right, "k", 4, 0.1).select("k", "x", "y")) == plain
    chain = rows(left.join(right, "k").join(third, "y").select("k", "x", "y", "z"))
    assert rows(skew.heavy_light_join(left, "k", [right, third], 0.1).select("k", "x", "y", "z")) == chain
    assert rows(pairwise_chain([left, right.select("k", "y"), third.select("y", "z")]).select("k", "x", "y", "z")) == chain
    assert skew.heavy_hitters(left, "k", 1).first()["k"] == 0
    assert skew.heavy_hitters_approx(left, "k", 1).first()["k"] == 0


def test_slices_cover_their_input(spark):
    df = spark.range(101).select(F.when(F.col("id") > 0, F.col("id")).alias("id"))
    for parts in (list(hash_slices(df, 4)), list(range_slices(df, "id", 4))):
        assert sum(p.count() for p in parts) == 101


def test_adjacency(spark, rows):
    e = rel(spark, [(1, 3), (1, 2), (1, 2), (2, 5)], "s", "d")
    assert rows(adjacency(e, "s", "d")) == [(1, [2, 3]), (2, [5])]
    parted = adjacency(e, "s", "d", parts=64).collect()
    assert sorted((r["s"], v) for r in parted for v in r["near"]) == [(1, 2), (1, 3), (2, 5)] and len(parted) == 3
    nested = nested_adjacency(rel(spark, [(1, 2, 3), (1, 2, 4), (1, 5, 6)], "a", "b", "c"), "a", "b", "c").first()
    assert [(x["value"], x["below"]) for x in nested["near"]] == [(2, [3, 4]), (5, [6])]


def test_bfs(spark, rows):
    e = rel(spark, [(0, 1), (1, 2), (2, 0), (2, 3), (5, 6)], "src", "dst")
    assert rows(pat.bfs_levels(e, 0)) == [(0, 0), (1, 1), (2, 2), (3, 3)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from([-1, 0, 1, 2, 3, 4, 2147483647]), st.sampled_from([-1, 0, 1, 2, 3, 4, 2147483647])), max_size=30))
def test_strategies_agree(spark, rows, data):
    edges = rel(spark, data, "src", "dst")
    held = set(data)
    expected = sorted(((a, b, c) for a, b in held for x, c in held if x == b and (a, c) in held), key=repr)
    assert rows(pat.match(edges)) == expected
    assert rows(pat.match(edges, strategy="wcoj")) == expected
    by = Counter(a for a, _, _ in expected)
    assert {r["a0"]: r["count"] for r in pat.count_matches(edges, by=["a0"]).collect() if r["count"]} == dict(by)


def test_broadcast_by_bytes_in_memory(spark, tmp_path, monkeypatch):
    """A side whose file is small but whose hash table isn't is not broadcast, and sides share the room."""
    spark.range(20000).select(F.col("id").alias("k"), F.lit("x" * 50).alias("v")).coalesce(1).write.parquet(f"{tmp_path}/big")
    big, small = spark.read.parquet(f"{tmp_path}/big"), spark.range(100).select(F.col("id").alias("k"), F.col("id").alias("w"))
    monkeypatch.setattr(NJ, "BROADCAST_BYTES", 1 << 20)
    assert NJ.size_in_bytes(big) < 1 << 20 < NJ.bytes_in_memory(big)
    hints = lambda df: df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast")
    assert hints(natural_join([small, big], strategy="broadcast")) == 0
    assert hints(natural_join([big, small], strategy="broadcast")) == 1
    monkeypatch.setattr(NJ, "BROADCAST_BYTES", NJ.bytes_in_memory(small) * 3 // 2)
    two = natural_join([big, small, small.withColumnRenamed("w", "u")], strategy="broadcast")
    assert hints(two) == 1 and two.count() == 100


def _graph(seed, vertices=30, n=250):
    draw = random.Random(seed)
    return sorted({(draw.randrange(vertices) if draw.random() < 0.8 else 3, draw.randrange(vertices)) for _ in range(n)})


@pytest.mark.parametrize("size", [(1 << 18, 1 << 24), (20, 40)])
def test_parallel_paths_by_blocks(spark, monkeypatch, size):
    """Squares and triple paths, in one block and in many of several parts; no step makes a row for each path."""
    monkeypatch.setattr(blocks, "EDGES", size[0])
    monkeypatch.setattr(blocks, "PATHS", size[1])
    edges = _graph(1)
    ways = Counter((a, d) for a, b in edges for c, d in edges if b == c)
    table = spark.createDataFrame(edges, "src int, dst int")
    assert pat.count_matches(table, pat.SQUARE, order=["a0", "a1", "a3", "a2"]).first()["count"] == sum(n * n for n in ways.values())
    assert pat.count_matches(table, ((0, 1), (1, 4), (0, 2), (2, 4), (0, 3), (3, 4))).first()["count"] == sum(n**3 for n in ways.values())
    assert pat.count_matches(table.filter("src < 0"), pat.SQUARE).first()["count"] == 0
    plan = pat.count_matches(table, pat.SQUARE)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Generate explode(array_intersect" not in plan


def test_paths_of_a_block(monkeypatch):
    """Runs cut anywhere give the same, with and without a table of marks."""
    edges = _graph(2)
    by = {v: sorted(b for a, b in edges if a == v) for v, _ in edges}
    left = pa.table({"a0": [a for a, _ in edges], "a1": [b for _, b in edges], "of": pa.array([3] * len(edges), pa.int32())})
    right = pa.table({"middle": list(by) + [3], "near": pa.array([*by.values(), []], pa.list_(pa.int64()))})
    ways = Counter((a, c) for a, b in edges for c in by.get(b, []))
    want = sorted((a, b, c) for a, b in edges for c in by.get(b, []) if c in by[a])
    for at_once in (1, 7, 1 << 20):
        monkeypatch.setattr(blocks, "AT_ONCE", at_once)
        paths = blocks.Paths(left, right)
        assert blocks.powers(paths, 2) == sum(n * n for n in ways.values())
        edge, last = blocks.closed(paths)
        assert sorted(zip(paths.roots[paths.root[edge]].tolist(), paths.a1[edge].tolist(), last.tolist(), strict=True)) == want


@pytest.mark.parametrize("keys", ["all", "first"])
@pytest.mark.parametrize("strategy", ["auto", "nested_loop"])
def test_counted_join_makes_no_pairs(spark, keys, strategy):
    """A billion rows and more are counted from a few; copies and nulls count as in the rows' join."""
    r, s, t = [(1, 2), (1, 2), (1, None), (3, 2), (None, 2)], [(2, 5), (2, 5), (2, 6), (None, 5)], [(1, 5), (1, 6), (1, 5), (3, 7)]
    held = [rel(spark, r, "a0", "a1"), rel(spark, s, "a1", "a2"), rel(spark, t, "a0", "a2")]
    plain = natural_join(held, keys=keys)
    assert counted_join(held, keys=keys, strategy=strategy).first()["n"] == plain.count()
    assert Counter(r["a0"] for r in plain.collect()) == {r["a0"]: r["n"] for r in counted_join(held, keys=keys, strategy=strategy, by=["a0"]).collect()}
    many = spark.range(100_000).select((F.col("id") % 2).alias("k"), "id")
    pair = counted_join([many.toDF("k", "x"), many.toDF("k", "y")], keys=keys, strategy=strategy)
    assert pair.first()["n"] == 5_000_000_000
    assert counted_join([many.toDF("k", "x"), many.filter("k > 5").toDF("k", "y")], keys=keys, strategy=strategy).first()["n"] == 0
    assert strategy != "nested_loop" or "CartesianProduct" in pair._jdf.queryExecution().toString()


def test_distinct_is_spread_by_size(spark, tmp_path, monkeypatch):
    """The input's size sets the partitions; adaptive execution doesn't put them together."""
    spark.range(20000).select(F.col("id").alias("a"), (F.col("id") % 7).alias("b")).union(spark.range(9).select("id", "id")).write.parquet(f"{tmp_path}/t")
    table = spark.read.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(NJ, "DISTINCT_BYTES", NJ.size_in_bytes(table) // 12)
    made = NJ.spread_distinct(table)
    assert made.count() == table.distinct().count() and made.rdd.getNumPartitions() >= 12


def test_paths_are_counted_without_rows_for_each(spark):
    """A tree's matches, by groups as well; 10^12 of them from 20000 edges."""
    edges = _graph(3)
    out = Counter(a for a, _ in edges)
    by = Counter()
    for a, b in edges:
        by[a] += sum(out[d] for c, d in edges if c == b)
    table = spark.createDataFrame(edges, "src int, dst int")
    assert pat.count_matches(table, pat.PATH_3).first()["count"] == sum(by.values())
    assert {r["a0"]: r["count"] for r in pat.count_matches(table, pat.PATH_3, ["a0"]).collect() if r["count"]} == {a: n for a, n in by.items() if n}
    hubs = spark.range(1, 10_001).select("id", F.lit(0).cast("long").alias("to"))
    both = hubs.union(hubs.select("to", "id"))
    assert pat.count_matches(both, pat.PATH_3).first()["count"] == 2 * 10**8
    assert pat.count_matches(both, ((0, 1), (1, 2), (2, 3), (3, 4))).first()["count"] == 10**12 + 10**8
