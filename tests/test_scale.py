"""Steps that made a row for each pair, on inputs whose pairs are too many for a test."""

from pyspark.sql import functions as F

from weft.operators import blocks, functors, natural_join, patterns
from weft.operators.natural_join import row_id_join


def test_sums_by_a_computed_key_make_no_pairs(spark):
    left, right = spark.range(100_000).toDF("a"), spark.range(100_000).toDF("b")
    made = functors.sum_by(left.union(left.filter("a < 5")), right, F.col("a") % 2, F.col("b") % 2, ["a"], "b", "s")
    assert made.count() == 100_000
    assert {r["a"]: (r["n"], r["s"]) for r in made.filter("a < 6").collect()} == {a: ((2 if a < 5 else 1) * 50_000, (2 if a < 5 else 1) * sum(range(a % 2, 100_000, 2))) for a in range(6)}


def test_triangles_are_closed_without_rows_of_paths(spark):
    """No join or generator makes a row for each of the hub's 10^8 paths: none of them is a triangle but loops'."""
    hub = spark.range(1, 10_001).select("id", F.lit(0).cast("long").alias("to"))
    edges = hub.union(hub.select("to", "id")).union(spark.createDataFrame([(0, 0)], "id long, to long"))
    found = patterns.match(edges)
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.count() == 1 + 3 * 10_000


def test_a_key_of_many_pairs_is_the_work_of_many_tasks(spark, rows):
    """20,000 x 9,000 rows of one key: pairs in many tasks, none with half of them; null and repeated ids and keys count."""
    left, right = spark.range(20_000).selectExpr("id div 100000 k", "id i"), spark.range(9_000).selectExpr("id div 100000 k", "id j")
    made = row_id_join(left, right, "k", "i", "j")
    sizes = [r["count"] for r in made.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 20_000 * 9_000 and max(sizes) < sum(sizes) / 2
    ends = made.agg(F.sum("left_row"), F.sum("right_row"), F.count_if((F.col("left_row") == 7) & (F.col("right_row") == 8_999))).first()
    assert tuple(ends) == (9_000 * sum(range(20_000)), 20_000 * sum(range(9_000)), 1)
    odd = spark.createDataFrame([(1, None), (1, 5), (1, 5), (None, 6), (2, 7)], "k int, i int")
    other = spark.createDataFrame([(1, "a"), (1, None), (None, "b"), (3, "c")], "k int, j string")
    assert rows(row_id_join(odd, other, "k", "i", "j")) == sorted([(None, "a"), (None, None), (5, "a"), (5, "a"), (5, None), (5, None)], key=repr)


def test_edges_are_dealt_by_their_size(spark, monkeypatch, rows):
    """Ranges are as many as the size asks for, though adaptive execution would put them together; triangles are the same."""
    edges = spark.range(3_000).selectExpr("id % 50 a0", "id * 7 % 60 a1").distinct()
    plain = rows(patterns.match(edges))
    monkeypatch.setattr(natural_join, "DISTINCT_BYTES", max(1, natural_join.size_in_bytes(edges) // 20))
    assert 15 < blocks.dealt(edges).groupBy(F.spark_partition_id()).count().count() <= 21
    assert plain and rows(patterns.match(edges)) == plain
