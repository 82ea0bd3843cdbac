"""Queries that take whole tables, against counts made without Spark."""

import os
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weft import queries as core
from weft.operators import patterns as pat
from weft.operators import primitives as P

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def column(table, name):
    return pq.read_table(f"{SF}/{table}.parquet", columns=[name]).column(name).to_pylist()


@pytest.fixture(scope="module")
def near():
    out = defaultdict(set)
    for a, b in zip(column("lineitem", "l_partkey"), column("lineitem", "l_suppkey"), strict=True):
        out[a].add(b)
    return out


def get(near, v):
    return near.get(v, set())


@pytest.mark.parametrize("name", ["j30_triangle_rows", "j16_triangle_wcoj", "j17_triangle_wcoj_chunked", "j18_triangle_levels", "j34_sliced_wcoj"])
def test_triangles_of_all_edges(spark, near, name):
    want = sorted((a, b, c) for a in near for b in near[a] for c in get(near, b) & near[a])
    assert sorted((r["a0"], r["a1"], r["a2"]) for r in core.QUERIES[name](spark, SF).collect()) == want


def test_patterns_of_all_edges(spark, near):
    ways = defaultdict(int)
    for a in near:
        for b in near[a]:
            for c in get(near, b):
                ways[a, c] += 1
    triangles = [(a, b, c) for a in near for b in near[a] for c in get(near, b) & near[a]]
    want = {
        "j02_first_key_mode": sum(n * len(near[a]) for (a, _), n in ways.items()), "p_square": sum(n * n for n in ways.values()),
        "p_diamond": sum(len(get(near, b) & get(near, c)) for _, b, c in triangles), "p_tailed_triangle": sum(len(get(near, c)) for _, _, c in triangles),
    }
    assert {name: core.QUERIES[name](spark, SF).first()[0] for name in want} == want


def test_rows_of_whole_tables(spark):
    lines, sizes = column("lineitem", "l_orderkey"), column("part", "p_size")
    suppliers = [s % 97 for s in column("supplier", "s_suppkey")]
    want = {
        "f01_projection": len(lines), "a17_product": len(set(lines)), "x13_intervals": len(column("orders", "o_orderkey")), "p07_expand": sum(sizes),
        "u05_comparator": sum(c % 97 in suppliers for c in column("customer", "c_custkey")),
    }
    assert {name: core.QUERIES[name](spark, SF).count() for name in want} == want
    assert max(r["o_orderkey"] for r in core.QUERIES["x13_intervals"](spark, SF).collect()) == max(column("orders", "o_orderkey"))


def test_scatter_loses_no_position(spark, tmp_path):
    spark.range(500).select(F.col("id").alias("s_suppkey"), (F.col("id") % 25).cast("int").alias("s_nationkey")).write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r["s_suppkey"]: r["s_nationkey"] for r in core.QUERIES["p08_scatter"](spark, str(tmp_path)).collect()}
    assert got == {k: k % 25 for k in range(500)} | dict.fromkeys(range(500, 520))  # places behind the last one are empty


@pytest.mark.parametrize("position", [3, -1, None])
def test_scatter_refuses_other_positions(spark, position):
    values = spark.createDataFrame([(0, 7), (position, 8)], "at long, v int")
    with pytest.raises(Exception, match="outside"):
        P.scatter(values, "at", 3).collect()
    assert [tuple(r) for r in P.scatter(values.filter("at = 0"), "at", 3).orderBy("at").collect()] == [(0, 7), (1, None), (2, None)]


def test_bfs_goes_on_to_the_last_level(spark):
    path = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert sorted((r["v"], r["level"]) for r in pat.bfs_levels(path, 0).collect()) == [(k, k) for k in range(41)]
    assert pat.bfs_levels(path, 0, 5).count() == 6


def test_bfs_of_all_edges(spark, near):
    level, frontier = {0: 0}, {0}
    while frontier:
        reached = {b for a in frontier for b in get(near, a)} - level.keys()
        level |= dict.fromkeys(reached, max(level.values()) + 1)
        frontier = reached
    assert {r["v"]: r["level"] for r in core.QUERIES["p12_bfs_levels"](spark, SF).collect()} == level
