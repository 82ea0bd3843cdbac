import numpy as np
import pytest

from weft.sources import columnar, generators, text, trie
from weft.streaming import triangles


def test_columnar_round_trip(spark, rows, tmp_path):
    df = spark.createDataFrame([(k, -k) for k in range(1000)], "a3 int, a1 int").repartition(3)
    paths = columnar.write_columnar(df, f"{tmp_path}/r")
    assert len(paths) == 3 and all(p.endswith("_3_1.db") for p in paths)
    assert rows(columnar.read_relation(spark, f"{tmp_path}/r")) == rows(df)
    np.array([[1, 2, 3], [4, 5, 6]], "<i4").tofile(f"{tmp_path}/3_0_1.db")
    assert rows(columnar.read_graph(spark, f"{tmp_path}/3_0_1.db")) == [(1, 4), (2, 5), (3, 6)]
    spark.dataSource.register(columnar.ColumnSource)
    many = spark.read.format("coldb").option("rowsPerTask", "2").load(f"{tmp_path}/3_0_1.db")
    assert many.rdd.getNumPartitions() == 2 and rows(many) == [(1, 4), (2, 5), (3, 6)]
    assert [r.columns for r in columnar.read_relations(spark, str(tmp_path), [0])] == [["a0", "a1"]]
    with pytest.raises(ValueError):
        columnar.schema_of("edges.db")


def test_trie_round_trip(spark, rows, tmp_path):
    df = spark.createDataFrame([(1, 2, 3), (1, 2, 5), (1, 4, 3), (7, 2, 3), (7, 2, 3)], "a0 int, a1 int, a2 int")
    trie.write_trie(df, f"{tmp_path}/x.tr")
    assert rows(trie.read_trie(spark, f"{tmp_path}/x.tr")) == rows(df.distinct())
    trie.write_adjacency(df.select("a0", "a1"), f"{tmp_path}/adj")
    assert rows(spark.read.parquet(f"{tmp_path}/adj")) == [(1, [2, 4]), (7, [2])]


def test_text(spark, rows, tmp_path):
    (tmp_path / "e.txt").write_text("1 2\n3\t4\n5|5\nbad\n\n")
    assert rows(text.read_edge_list(spark, f"{tmp_path}/e.txt", strict=False)) == [(1, 2), (3, 4), (5, 5)]
    assert rows(text.reverse_edges(text.read_edge_list(spark, f"{tmp_path}/e.txt", True, False))) == [(2, 1), (4, 3)]
    assert text.malformed_lines(spark, f"{tmp_path}/e.txt") == 1
    with pytest.raises(Exception, match="not an edge: bad"):
        text.read_edge_list(spark, f"{tmp_path}/e.txt").collect()
    with pytest.raises(Exception, match="a1 has no 32-bit number"):
        columnar.write_columnar(spark.createDataFrame([(1, 2), (3, None)], "a0 int, a1 int"), f"{tmp_path}/nulls")
    (tmp_path / "t.tbl").write_text("1|x|10|\n2|y|20|\n")
    paths = text.table_to_columnar(spark, f"{tmp_path}/t.tbl", [0, 2], [4, 6], f"{tmp_path}/c")
    assert rows(columnar.read_relation(spark, f"{tmp_path}/c")) == [(1, 10), (2, 20)] and paths
    text.table_to_tsv(spark, f"{tmp_path}/t.tbl", [1, 0], f"{tmp_path}/tsv")
    assert rows(spark.read.text(f"{tmp_path}/tsv")) == [("x\t1",), ("y\t2",)]
    text.split_columns(spark.createDataFrame([(1, 2)], "p int, q int"), f"{tmp_path}/cols")
    assert rows(spark.read.text(f"{tmp_path}/cols/q")) == [("2",)]


def test_generators(spark):
    values = [r[0] for r in generators.zipf(spark, 20000, 5, 50, 1.5).collect()]
    counts = sorted(np.bincount(values, minlength=55)[5:], reverse=True)
    assert len(values) == 20000 and min(values) >= 5 and max(values) < 55
    weights = np.arange(1, 51) ** -1.5
    assert abs(counts[0] / 20000 - weights[0] / weights.sum()) < 0.02
    assert generators.unique_pairs(spark, 90, 0, 10).distinct().count() == 90
    assert generators.unique_pairs(spark, 300, 0, 100).distinct().count() == 300
    assert generators.generate_relation(spark, 100, [{"attr": 2, "low": 0, "high": 9}, {"attr": 4, "low": 0, "high": 20, "alpha": 1.0}]).count() == 100
    assert generators.foreign_keys(spark, 40, 10).groupBy("key").count().filter("count <> 4").count() == 0


def test_streaming_triangles(spark, tmp_path):
    batches = [[(1, 2), (2, 3)], [(1, 3), (2, 4)], [(3, 4), (1, 4), (1, 2), (5, 5)]]
    for k, b in enumerate(batches):
        spark.createDataFrame(b, "src int, dst int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema("src int, dst int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    triangles.run(spark, stream, f"{tmp_path}/state", f"{tmp_path}/check").awaitTermination()
    every = spark.createDataFrame([e for b in batches for e in b], "src int, dst int")
    assert triangles.total(spark, f"{tmp_path}/state") == triangles.static_total(every)


def test_tasks_of_tries_hold_a_bounded_file(spark, rows, tmp_path):
    """A vertex of 2.5 million neighbours, each twice: no file holds them all, none of them is in two files."""
    hub = spark.range(2_500_000).selectExpr("cast(7 as int) a0", "cast(id as int) a1")
    paths = trie.write_tries(hub.union(hub), f"{tmp_path}/t")
    assert len(paths) > 1 and max((tmp_path / "t" / p.rsplit("/", 1)[1]).stat().st_size for p in paths) < 5 << 20
    assert tuple(trie.read_tries(spark, paths).selectExpr("count(*)", "sum(a0)", "sum(a1)").first()) == (2_500_000, 7 * 2_500_000, sum(range(2_500_000)))
    deep = spark.createDataFrame([(a % 3, -(a % 5), a % 2) for a in range(60)], "a2 int, a0 int, a1 int")
    small = trie.write_tries(deep, f"{tmp_path}/d", 2, 4)
    assert len(small) >= 8 and rows(trie.read_tries(spark, small)) == rows(deep.distinct())
    trie.write_trie(deep, f"{tmp_path}/one.tr")
    assert rows(trie.read_trie(spark, f"{tmp_path}/one.tr")) == rows(deep.distinct())
    trie.write_trie(deep.limit(0), f"{tmp_path}/none.tr")
    assert rows(trie.read_trie(spark, f"{tmp_path}/none.tr")) == []
