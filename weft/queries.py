"""The registered queries of joins, patterns and primitives, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar as X
from .functions.checksum import checksum, deciles
from .operators import functors
from .operators import patterns as pat
from .operators import primitives as P
from .operators import skew
from .operators.natural_join import counted_join, estimated_rows, lookup_join, natural_join, pairwise_chain, row_id_join, semi_reduce, spread_distinct
from .operators.sliced import sliced_generic_join, sliced_join
from .operators.wcoj import adjacency, generic_join, triangle_levels
from .plans import decision
from .sources import generators as gen
from .sources import columnar, text, trie
from .sources.shared import new_folder, ship
from .sources.text import reverse_edges

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def folder(self, tag: str) -> str:
        return new_folder(self.spark, tag)

    @property
    def edges(self) -> DataFrame:
        """The part-supplier graph: distinct (l_partkey, l_suppkey), ids in one domain."""
        return spread_distinct(self.lineitem.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")))

    @property
    def lines(self) -> DataFrame:
        """lineitem with a position of its own: by all columns, so that equal rows are interchangeable."""
        return self.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Callable[[Tables], DataFrame]]:
    def add(make: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: make(Tables(ship(spark), sf_dir))
        if sql is not None:
            ORACLES[name] = sql
        return make

    return add


def _repeat(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.column(0).to_numpy() % 3
    rank = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return pa.RecordBatch.from_pydict({"k": batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), n))), "i": rank})


E_SQL = "e AS (SELECT DISTINCT l_partkey AS src, l_suppkey AS dst FROM lineitem)"
TRIANGLES_SQL = "SELECT x.src AS a0, x.dst AS a1, y.dst AS a2 FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst"
T_BY_A0 = f"WITH {E_SQL} SELECT a0, count(*) AS count FROM ({TRIANGLES_SQL}) t GROUP BY a0"


def named(df: DataFrame, **names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(a) for a, c in names.items()])


# --- natural joins -----------------------------------------------------------------------------------------------


@query("j01_multiway_chain", "SELECT c_custkey AS a0, o_orderkey AS a1, l_partkey AS a2 FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING'")
def _(t):
    customer = named(t.customer.filter("c_mktsegment = 'BUILDING'"), a0="c_custkey")
    return natural_join([customer, named(t.orders, a0="o_custkey", a1="o_orderkey"), named(t.lineitem, a1="l_orderkey", a2="l_partkey")], order="greedy")


@query("j01_star", "SELECT p_brand, s_nationkey, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY p_brand, s_nationkey")
def _(t):
    held = [named(t.lineitem, p="l_partkey", s="l_suppkey"), named(t.part, p="p_partkey", p_brand="p_brand"), named(t.supplier, s="s_suppkey", s_nationkey="s_nationkey")]
    return natural_join(held, strategy="broadcast").groupBy("p_brand", "s_nationkey").agg(F.count("*").alias("n"))


@query("j01_snowflake_eight_tables", "SELECT r_name, b.n_name AS s_nation, count(*) AS n FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN region ON r_regionkey = a.n_regionkey JOIN nation b ON b.n_nationkey = s_nationkey GROUP BY r_name, b.n_name")
def _(t):
    held = [
        named(t.lineitem, ok="l_orderkey", pk="l_partkey", sk="l_suppkey"), named(t.part, pk="p_partkey"), named(t.supplier, sk="s_suppkey", sn="s_nationkey"), named(t.orders, ok="o_orderkey", ck="o_custkey"),
        named(t.customer, ck="c_custkey", cn="c_nationkey"), named(t.nation, cn="n_nationkey", rk="n_regionkey"), named(t.region, rk="r_regionkey", r_name="r_name"), named(t.nation, sn="n_nationkey", s_nation="n_name"),
    ]
    return natural_join(held, order="greedy").groupBy("r_name", "s_nation").agg(F.count("*").alias("n"))


@query("j01_cyclic", "SELECT n_name, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name")
def _(t):
    held = [named(t.customer, ck="c_custkey", nk="c_nationkey"), named(t.orders, ck="o_custkey", ok="o_orderkey"), named(t.lineitem, ok="l_orderkey", sk="l_suppkey"), named(t.supplier, sk="s_suppkey", nk="s_nationkey"), named(t.nation, nk="n_nationkey", n_name="n_name")]
    return natural_join(held, order="greedy").groupBy("n_name").agg(F.count("*").alias("n"))


def _chain(t: Tables) -> list[DataFrame]:
    return [named(t.lineitem, a1="l_orderkey", a2="l_partkey"), named(t.orders, a1="o_orderkey", a0="o_custkey"), named(t.customer, a0="c_custkey", a3="c_nationkey")]


CHAIN_COUNT = "SELECT c_nationkey AS a3, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY c_nationkey"
for _name, _options in (("j08_open_addressing_as_shuffle_hash", {"strategy": "shuffle_hash"}), ("j40_broadcast", {"strategy": "broadcast"}), ("j45_sort_merge", {"strategy": "merge"})):
    query(_name, CHAIN_COUNT)(lambda t, o=_options: natural_join(_chain(t), **o).groupBy("a3").agg(F.count("*").alias("n")))
query("j13_pairwise_chain", CHAIN_COUNT)(lambda t: pairwise_chain(_chain(t)).groupBy("a3").agg(F.count("*").alias("n")))
query("j03_salted", CHAIN_COUNT)(lambda t: skew.salted_join(skew.salted_join(_chain(t)[0], _chain(t)[1], "a1"), _chain(t)[2], "a0").groupBy("a3").agg(F.count("*").alias("n")))
query("j06_heavy_light", CHAIN_COUNT)(lambda t: skew.heavy_light_join(_chain(t)[0], "a1", _chain(t)[1:], 0.00015).groupBy("a3").agg(F.count("*").alias("n")))
query("j33_sliced", CHAIN_COUNT)(lambda t: sliced_join(_chain(t), 3).groupBy("a3").agg(F.count("*").alias("n")))
query("j01_count_mode", "SELECT count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey")(lambda t: natural_join(_chain(t)).agg(F.count("*").alias("n")))
query("o11_limit", "SELECT least(count(*), 1000) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey")(lambda t: natural_join(_chain(t)[:2], limit=1000).agg(F.count("*").alias("n")))


query("j02_first_key_mode", f"WITH {E_SQL} SELECT count(*) AS n FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src")(lambda t: counted_join(_three(t.edges), keys="first"))


def _upserted(t: Tables) -> DataFrame:
    """A keyed table after inserts that replace what a key had, and deletes of keys."""
    held, changed, gone = named(t.part, k="p_partkey", v="p_size"), t.part.filter("p_partkey % 5 = 2").select(F.col("p_partkey").alias("k"), (-F.col("p_size")).alias("w")), t.part.filter("p_partkey % 7 = 3").select(F.col("p_partkey").alias("k"))
    return lookup_join(held, changed, "k").select("k", F.coalesce("w", "v").alias("v")).join(gone, "k", "left_anti")


@query("j11_lookup_unique", "SELECT o_orderkey, c_nationkey FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey")
def _(t):
    return lookup_join(named(t.orders, o_orderkey="o_orderkey", key="o_custkey"), named(t.customer.filter("c_acctbal > 0"), key="c_custkey", c_nationkey="c_nationkey"), "key", assert_unique=True).drop("key")


@query("j14_row_id_pairs", "SELECT a.c_custkey AS left_row, b.s_suppkey AS right_row FROM customer a JOIN supplier b ON a.c_nationkey = b.s_nationkey")
def _(t):
    return row_id_join(t.customer.withColumnRenamed("c_nationkey", "k"), t.supplier.withColumnRenamed("s_nationkey", "k"), "k", "c_custkey", "s_suppkey")


query("j19_semi_reduction", f"WITH {E_SQL} SELECT DISTINCT src FROM e WHERE src IN (SELECT dst FROM e)")(lambda t: semi_reduce(t.edges.select("src"), t.edges.select(F.col("dst").alias("src")), ["src"])[0].distinct())
query("j22_leaf_expansion", f"WITH {E_SQL} SELECT src, dst FROM e")(lambda t: adjacency(t.edges, "src", "dst").select("src", F.explode("near").alias("dst")))
query("j25_membership", "SELECT count(*) AS n FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")(lambda t: t.orders.join(t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").agg(F.count("*").alias("n")))
query("j26_pair_semi", f"WITH {E_SQL} SELECT count(*) AS n FROM e WHERE EXISTS (SELECT 1 FROM e f WHERE f.src = e.dst AND f.dst = e.src)")(lambda t: t.edges.join(t.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_semi").agg(F.count("*").alias("n")))
query("j27_match_and_position", f"WITH {E_SQL}, v AS (SELECT src, row_number() OVER (ORDER BY src) - 1 AS dense FROM (SELECT DISTINCT src FROM e)) SELECT s_suppkey AS src, dense FROM supplier LEFT JOIN v ON v.src = s_suppkey")(lambda t: t.supplier.select(F.col("s_suppkey").alias("src")).join(P.compact_ids(t.edges, "src"), "src", "left"))
query("j43_nested_loop", "SELECT count(*) AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey")(lambda t: counted_join([named(t.supplier, k="s_nationkey", x="s_suppkey"), named(t.supplier, k="s_nationkey", y="s_suppkey")], strategy="nested_loop"))
query("j46_left_outer", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus <> 'F' GROUP BY c_custkey")(lambda t: t.customer.join(t.orders.filter("o_orderstatus <> 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n")))
query("j47_semi", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")(lambda t: t.orders.join(t.lineitem.filter("l_quantity > 49"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("o_orderkey"))
query("j48_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2000-01-01')")(lambda t: t.customer.join(t.orders.filter("o_orderdate >= DATE '2000-01-01'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey"))
query("j49_theta_exists", "SELECT DISTINCT a.l_orderkey FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)")(lambda t: t.lineitem.alias("a").join(t.lineitem.alias("b"), (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_suppkey") != F.col("b.l_suppkey")), "left_semi").select("a.l_orderkey").distinct())
query("j50_scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.5 FROM customer)")(lambda t: t.customer.crossJoin(F.broadcast(t.customer.agg((F.avg("c_acctbal") * 1.5).alias("m")))).filter("c_acctbal > m").select("c_custkey"))
query("j48_not_in_null_aware", "SELECT s_suppkey FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)")(lambda t: t.supplier.join(t.customer.filter("c_acctbal > 9900").select("c_nationkey").distinct(), F.expr("(s_nationkey = c_nationkey) OR isnull(s_nationkey = c_nationkey)"), "left_anti").select("s_suppkey"))
query("j51_point_lookup_insert_delete", "SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 2 THEN -p_size ELSE p_size END AS v FROM part WHERE p_partkey % 7 <> 3")(lambda t: _upserted(t))
query("j52_self_join_aliases", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")(lambda t: natural_join([named(t.nation, r="n_regionkey", i="n_nationkey", x="n_name"), named(t.nation, r="n_regionkey", j="n_nationkey", y="n_name")]).filter("i < j").select("x", "y"))

# --- patterns ----------------------------------------------------------------------------------------------------

def _three(e: DataFrame) -> list[DataFrame]:
    return pat.edge_relations(e, pat.TRIANGLE, True)


TRIANGLE_ROWS = f"WITH {E_SQL} {TRIANGLES_SQL}"
query("j30_triangle_rows", TRIANGLE_ROWS)(lambda t: pat.match(t.edges, assume_distinct=True))
query("j16_triangle_wcoj", TRIANGLE_ROWS)(lambda t: pat.match(t.edges, strategy="wcoj", assume_distinct=True))
query("j17_triangle_wcoj_chunked", TRIANGLE_ROWS)(lambda t: generic_join(_three(t.edges), ["a0", "a1", "a2"], chunk=8, assume_distinct=True))
query("j18_triangle_levels", TRIANGLE_ROWS)(lambda t: triangle_levels(*_three(t.edges)))
query("j34_sliced_wcoj", TRIANGLE_ROWS)(lambda t: sliced_generic_join(_three(t.edges), ["a0", "a1", "a2"], 3))
query("j30_triangles_by_vertex", T_BY_A0)(lambda t: pat.count_matches(t.edges, by=["a0"], assume_distinct=True).filter("count > 0"))
query("j16_triangle_count", f"WITH {E_SQL} SELECT count(*) AS count FROM ({TRIANGLES_SQL}) t")(lambda t: pat.count_matches(t.edges, assume_distinct=True))
query("j16_triangle_count_by_vertex", T_BY_A0)(lambda t: pat.count_matches(t.edges, by=["a0"], assume_distinct=True).filter("count > 0"))
query("j31_four_clique_by_vertex", f"WITH {E_SQL}, t AS ({TRIANGLES_SQL}) SELECT a0, count(*) AS count FROM t JOIN e p ON p.src = a2 JOIN e q ON q.src = a0 AND q.dst = p.dst JOIN e r ON r.src = a1 AND r.dst = p.dst GROUP BY a0")(lambda t: pat.count_matches(t.edges, pat.FOUR_CLIQUE, ["a0"], assume_distinct=True).filter("count > 0"))
query("p_wedge", f"WITH {E_SQL} SELECT x.src AS a0, count(*) AS count FROM e x JOIN e y ON y.src = x.dst GROUP BY x.src")(lambda t: pat.match(t.edges, pat.WEDGE, assume_distinct=True).groupBy("a0").agg(F.count("*").alias("count")))
query("p_path3", f"WITH {E_SQL} SELECT count(*) AS count FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = y.dst")(lambda t: pat.count_matches(t.edges, pat.PATH_3, assume_distinct=True))
query("p_square", f"WITH {E_SQL} SELECT count(*) AS count FROM e a JOIN e b ON b.src = a.dst JOIN e c ON c.dst = b.dst JOIN e d ON d.src = a.src AND d.dst = c.src")(lambda t: pat.count_matches(t.edges, pat.SQUARE, assume_distinct=True, order=["a0", "a1", "a3", "a2"]))
query("p_diamond", f"WITH {E_SQL} SELECT count(*) AS count FROM e a JOIN e b ON b.src = a.src JOIN e c ON c.src = a.dst AND c.dst = b.dst JOIN e d ON d.src = a.dst JOIN e f ON f.src = b.dst AND f.dst = d.dst")(lambda t: pat.count_matches(t.edges, pat.DIAMOND, assume_distinct=True))
query("p_tailed_triangle", f"WITH {E_SQL} SELECT count(*) AS count FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst JOIN e w ON w.src = y.dst")(lambda t: pat.count_matches(t.edges, pat.TAILED_TRIANGLE, assume_distinct=True))
query("p_isomorphic_triangles", f"WITH {E_SQL} SELECT count(*) AS count FROM ({TRIANGLES_SQL}) t WHERE a0 <> a1 AND a1 <> a2 AND a0 <> a2")(lambda t: pat.match(t.edges, isomorphism=True, assume_distinct=True).agg(F.count("*").alias("count")))
query("a23_degrees", f"WITH {E_SQL} SELECT src AS v, count(*) AS degree FROM e GROUP BY src")(lambda t: pat.degrees(t.edges))
# No shortest path has more edges than there are destinations.
query("p12_bfs_levels", f"WITH RECURSIVE {E_SQL}, r(v, level) AS (SELECT 0::bigint, 0 UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.v WHERE r.level <= (SELECT count(DISTINCT l_suppkey) FROM lineitem)) SELECT v, min(level) AS level FROM r GROUP BY v")(lambda t: pat.bfs_levels(t.edges, 0))

# --- selection ---------------------------------------------------------------------------------------------------

query("f01_projection", "SELECT o_custkey AS a0, o_orderkey AS a1, l_suppkey AS a2 FROM orders JOIN lineitem ON l_orderkey = o_orderkey")(lambda t: natural_join([named(t.orders, a0="o_custkey", a1="o_orderkey"), named(t.lineitem, a1="l_orderkey", a2="l_suppkey")]))
query("f02_flagged", "SELECT c_custkey FROM customer WHERE c_acctbal > 5000")(lambda t: P.select_flagged(t.customer.select("c_custkey", (F.col("c_acctbal") > 5000).alias("flag")), "flag"))
query("f04_if", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40 AND l_discount < 0.03")(lambda t: P.select_if(t.lineitem, (F.col("l_quantity") > 40) & (F.col("l_discount") < 0.03)).select("l_orderkey", "l_linenumber"))
query("f07_partition", "SELECT c_custkey, row_number() OVER (ORDER BY CASE WHEN c_acctbal > 0 THEN 0 ELSE 1 END, CASE WHEN c_acctbal > 0 THEN c_custkey ELSE -c_custkey END) - 1 AS place FROM customer")(lambda t: P.partition_if(t.customer.select("c_custkey", "c_acctbal"), F.col("c_acctbal") > 0, "c_custkey").select("c_custkey", F.col("place").cast("long").alias("place")))
query("f09_bulk_remove", "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS p_partkey, p_size FROM part WHERE p_partkey % 7 <> 3")(lambda t: P.bulk_remove(t.part.select("p_partkey", "p_size"), "p_partkey", t.part.filter("p_partkey % 7 = 3").select("p_partkey")))
query("f09_bulk_insert", "SELECT row_number() OVER (ORDER BY pos, side) - 1 AS p_partkey, p_size FROM (SELECT p_partkey AS pos, 1 AS side, p_size FROM part UNION ALL SELECT p_partkey, 0, -1 FROM part WHERE p_partkey % 50 = 1) x")(lambda t: P.bulk_insert(t.part.select("p_partkey", "p_size"), "p_partkey", t.part.filter("p_partkey % 50 = 1").select("p_partkey", F.lit(-1).alias("p_size"))))
query("f11_comparators", "SELECT CAST(sum(CASE WHEN p_size = 10 THEN 1 ELSE 0 END) AS bigint) AS eq, CAST(sum(CASE WHEN p_size < p_retailprice / 50 THEN 1 ELSE 0 END) AS bigint) AS lt, CAST(sum(CASE WHEN p_partkey >= p_size THEN 1 ELSE 0 END) AS bigint) AS ge FROM part")(lambda t: t.part.select(F.count_if(F.col("p_size") == 10).alias("eq"), F.count_if(F.col("p_size") < F.col("p_retailprice") / 50).alias("lt"), F.count_if(F.col("p_partkey") >= F.col("p_size")).alias("ge")))

_PAIRS = {"ints": ("l_linenumber", "4"), "doubles": ("l_discount", "0.05"), "mixed": ("l_orderkey", "l_extendedprice"), "strings": ("l_returnflag", "l_linestatus"), "dates": ("CAST(l_shipdate AS date)", "DATE '1997-06-15'")}
_COMPARE = [f"CAST(sum(CASE WHEN {a} {op} {b} THEN 1 ELSE 0 END) AS bigint) AS {name}_{what}" for what, (a, b) in _PAIRS.items() for name, op in (("eq", "="), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">="))]
query("f11_comparators_all_types", f"SELECT {', '.join(_COMPARE)} FROM lineitem")(lambda t: t.lineitem.select(*[F.expr(c) for c in _COMPARE]))

# --- reductions --------------------------------------------------------------------------------------------------

query("a02_sum", "SELECT CAST(sum(l_quantity) AS bigint) AS s FROM lineitem")(lambda t: t.lineitem.agg(F.sum("l_quantity").cast("long").alias("s")))
query("a03_max", "SELECT max(l_extendedprice) AS m FROM lineitem")(lambda t: t.lineitem.agg(F.max("l_extendedprice").alias("m")))


@query("a04_checksum", f"WITH {E_SQL}, t AS ({TRIANGLES_SQL}), v AS (SELECT a0 AS v FROM t UNION ALL SELECT a1 FROM t UNION ALL SELECT a2 FROM t), h AS (SELECT v & 1048575 AS value, count(*) AS n FROM v GROUP BY 1) SELECT md5(string_agg(value || ':' || n, ',' ORDER BY value)) AS md5 FROM h")
def _(t):
    return checksum(pat.match(t.edges, assume_distinct=True))


query("a04_deciles", f"WITH {E_SQL}, v AS (SELECT src AS v FROM e UNION ALL SELECT dst FROM e), h AS (SELECT v & 1048575 AS value, count(*) AS count FROM v GROUP BY 1) SELECT value, count, CAST(floor((sum(count) OVER (ORDER BY value) * 10 - 1) / (SELECT sum(count) FROM h)) AS int) AS decile FROM h")(lambda t: deciles(t.edges))
query("a05_bucket_offsets", "SELECT i AS bucket, coalesce(n, 0) AS count, CAST(coalesce(sum(n) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start FROM (SELECT CAST(unnest(range(64)) AS int) AS i) b LEFT JOIN (SELECT l_suppkey & 63 AS b, count(*) AS n FROM lineitem GROUP BY 1) c ON c.b = i")(lambda t: P.bucket_offsets(t.lineitem, "l_suppkey", 6))
query("a06_unique", "SELECT DISTINCT l_suppkey FROM lineitem")(lambda t: t.lineitem.select("l_suppkey").distinct())
query("a07_topk_exact", "SELECT l_suppkey, count(*) AS count FROM lineitem GROUP BY l_suppkey ORDER BY count DESC, l_suppkey LIMIT 10")(lambda t: skew.heavy_hitters(t.lineitem, "l_suppkey", 10))
query("a07_topk_approx")(lambda t: skew.heavy_hitters_approx(t.lineitem, "l_suppkey", 10))
query("a08_sampled_estimate")(lambda t: t.spark.range(1).select(F.lit(estimated_rows(_chain(t)[0], _chain(t)[1:], 0.1)).alias("rows")))
query("a09_arg_extremes", "SELECT p_type, min(p_retailprice) AS least, min_by(p_partkey, struct_pack(a := p_retailprice, b := p_partkey)) AS arg_least, max(p_retailprice) AS largest, max_by(p_partkey, struct_pack(a := p_retailprice, b := -p_partkey)) AS arg_largest FROM part GROUP BY p_type")(lambda t: P.arg_extremes(t.part, "p_retailprice", "p_partkey", ["p_type"]))
query("a10_reduce_by_key", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS bigint) AS sum FROM lineitem GROUP BY 1, 2")(lambda t: P.reduce_by_key(t.lineitem, ["l_returnflag", "l_linestatus"], "l_quantity").withColumn("sum", F.col("sum").cast("long")))
query("a11_segmented_reduce", "SELECT o_custkey, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n FROM orders GROUP BY o_custkey")(lambda t: t.orders.groupBy("o_custkey").agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"), F.count("*").alias("n")))
RUNS = "SELECT o_custkey, CAST(run AS bigint) AS run, o_orderstatus, count(*) AS length, min(o_orderkey) AS first, max(o_orderkey) AS last FROM (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS run FROM (SELECT *, CASE WHEN lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = o_orderstatus THEN 0 ELSE 1 END AS new FROM orders) x) y GROUP BY o_custkey, run, o_orderstatus"
query("a12_rle", RUNS)(lambda t: P.runs(t.orders, "o_custkey", "o_orderkey", "o_orderstatus"))
query("a12_nontrivial_runs", f"SELECT * FROM ({RUNS}) r WHERE length > 1")(lambda t: P.nontrivial_runs(t.orders, "o_custkey", "o_orderkey", "o_orderstatus"))
query("a06_unique_consecutive", f"SELECT o_custkey, first AS o_orderkey, o_orderstatus FROM ({RUNS}) r")(lambda t: P.unique_consecutive(t.orders.select("o_custkey", "o_orderkey", "o_orderstatus"), "o_custkey", "o_orderkey", "o_orderstatus"))
query("a13_histogram_even", "SELECT CAST(i AS int) AS bin, coalesce(n, 0) AS count FROM (SELECT unnest(range(25)) AS i) b LEFT JOIN (SELECT least(floor((l_quantity - 1) / 2), 24) AS b, count(*) AS n FROM lineitem WHERE l_quantity >= 1 AND l_quantity < 51 GROUP BY 1) c ON c.b = i")(lambda t: P.histogram_even(t.lineitem, "l_quantity", 1, 51, 25))
query("a13_histogram_range", "SELECT CAST(i AS int) AS bin, coalesce(n, 0) AS count FROM (SELECT unnest(range(4)) AS i) b LEFT JOIN (SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 20 THEN 1 WHEN l_quantity < 21 THEN 2 ELSE 3 END AS b, count(*) AS n FROM lineitem WHERE l_quantity >= 0 AND l_quantity < 60 GROUP BY 1) c ON c.b = i")(lambda t: P.histogram_range(t.lineitem, "l_quantity", [0, 5, 20, 21, 60]))
query("a13_multi_histogram", "SELECT 'l_quantity' AS channel, CAST(i AS int) AS bin, (SELECT count(*) FROM lineitem WHERE l_quantity >= i * 10 AND l_quantity < i * 10 + 10) AS count FROM range(6) r(i) UNION ALL SELECT 'l_linenumber', CAST(i AS int), (SELECT count(*) FROM lineitem WHERE l_linenumber >= i * 2 AND l_linenumber < i * 2 + 2) FROM range(6) r(i)")(lambda t: P.multi_histogram_even(t.lineitem, {"l_quantity": (0, 60), "l_linenumber": (0, 12)}, 6))
query("a14_transform_reduce", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS s FROM lineitem")(lambda t: t.lineitem.agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("s")))
query("a15_segreduce_empty", "SELECT c_custkey, coalesce(CAST(s AS bigint), 0) AS sum FROM customer LEFT JOIN (SELECT o_custkey, sum(o_orderkey) AS s FROM orders WHERE o_orderdate >= DATE '2000-06-01' GROUP BY o_custkey) o ON o_custkey = c_custkey")(lambda t: P.segmented_reduce(t.customer.select("c_custkey"), t.orders.filter("o_orderdate >= DATE '2000-06-01'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), "c_custkey", "o_orderkey"))
query("a16_spmv", "SELECT l_orderkey AS i, round(sum(l_quantity * s_acctbal), 2) AS y FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY l_orderkey")(lambda t: P.spmv(named(t.lineitem, i="l_orderkey", j="l_suppkey", v="l_quantity"), named(t.supplier, j="s_suppkey", x="s_acctbal")).withColumn("y", F.round("y", 2)))
query("a17_product", "SELECT l_orderkey AS o_orderkey, round(product(1 - l_discount), 8) AS p FROM lineitem GROUP BY l_orderkey")(lambda t: t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.round(F.product(1 - F.col("l_discount")), 8).alias("p")))
query("a19_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts")))
query("a19_count_distinct_approx")(lambda t: t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts")))
query("a20_conditional", "SELECT l_linenumber, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS bigint) AS returned, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS bigint) AS kept FROM lineitem GROUP BY l_linenumber")(lambda t: t.lineitem.groupBy("l_linenumber").agg(F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("returned"), F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).alias("kept")))

# --- scans and windows -------------------------------------------------------------------------------------------

query("w01_exclusive_scan", "SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS total FROM orders")(lambda t: P.scan(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey", "total", inclusive=False).select("o_orderkey", "total"))
query("w02_inclusive_scan", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (ORDER BY o_orderkey) AS bigint) AS total FROM orders")(lambda t: P.scan(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey", "total").select("o_orderkey", "total"))
query("w02_max_scan", "SELECT o_orderkey, max(o_totalprice) OVER (ORDER BY o_orderkey) AS top FROM orders")(lambda t: P.scan(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], "o_totalprice", "top", op="max").select("o_orderkey", "top"))
query("w04_segmented_scan", "SELECT o_custkey, o_orderkey, CAST(coalesce(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS total FROM orders")(lambda t: P.segmented_scan(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", "o_orderkey", "total", inclusive=False, backward=True))
query("w05_change_flags", "SELECT o_custkey, o_orderkey, lag(o_orderpriority) OVER w IS DISTINCT FROM o_orderpriority AS flag FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")(lambda t: P.change_flags(t.orders.select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_orderkey"], "o_orderpriority", "flag", "o_custkey").drop("o_orderpriority"))
query("w06_rank_in_group", f"WITH {E_SQL} SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS int) AS rank FROM e")(lambda t: P.rank_in_group(t.edges, "src", "dst"))
query("w07_list_rank", "SELECT p_partkey AS node, ((SELECT count(*) FROM part) - 1 - p_partkey) // 3 AS rank FROM part")(lambda t: P.list_rank(t.part.select(F.col("p_partkey").alias("node")).join(t.part.select(F.col("p_partkey").alias("next")), F.col("next") == F.col("node") + 3, "left").select("node", "next")))

# --- sorting -----------------------------------------------------------------------------------------------------

query("o01_sort_pairs", f"WITH {E_SQL} SELECT src, dst, CAST(row_number() OVER (ORDER BY src, dst) - 1 AS bigint) AS place FROM e")(lambda t: P.sort_pairs(t.edges, ["src", "dst"], "place").withColumn("place", F.col("place").cast("long")))
query("o04_lexicographic_sort", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey, o_orderstatus, o_orderpriority, o_totalprice, o_orderkey) - 1 AS bigint) AS place FROM orders")(lambda t: P.sort_pairs(t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice"), ["o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderkey"], "place").select("o_orderkey", F.col("place").cast("long").alias("place")))
query("o06_segmented_sort", "SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS int) AS place FROM orders")(lambda t: P.segmented_sort(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), "o_custkey", "o_totalprice", ["o_orderkey"], True).drop("o_totalprice"))
query("o08_merge", "SELECT c_acctbal AS v FROM customer UNION ALL SELECT s_acctbal FROM supplier")(lambda t: P.merge_sorted(named(t.customer, v="c_acctbal"), named(t.supplier, v="s_acctbal"), "v"))
query("o09_string_sort", "SELECT p_name, CAST(row_number() OVER (ORDER BY p_name, p_partkey) - 1 AS bigint) AS place FROM part")(lambda t: P.sort_pairs(t.part.select("p_name", "p_partkey"), ["p_name", "p_partkey"], "place").select("p_name", F.col("place").cast("long").alias("place")))
query("o10_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")(lambda t: P.top_k(t.orders.select("o_orderkey", "o_totalprice"), 25, F.desc("o_totalprice"), "o_orderkey"))

# --- sets --------------------------------------------------------------------------------------------------------

query("e01_intersect", f"WITH {E_SQL} SELECT src FROM e INTERSECT SELECT dst FROM e")(lambda t: P.intersection(t.edges.select("src"), t.edges.select("dst")))
query("e02_except_all", "SELECT l_suppkey FROM lineitem EXCEPT ALL SELECT s_suppkey FROM supplier")(lambda t: P.difference(t.lineitem.select("l_suppkey"), t.supplier.select("s_suppkey")))
query("e03_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")(lambda t: P.concatenation(named(t.customer, k="c_nationkey"), named(t.supplier, k="s_nationkey")))

# --- scalars -----------------------------------------------------------------------------------------------------

query("x01_radix_digit", "SELECT o_orderkey, o_orderkey & 255 AS low, (o_orderkey >> 4) & 15 AS digit FROM orders")(lambda t: t.orders.select("o_orderkey", X.low_bits(F.col("o_orderkey"), 8).alias("low"), X.radix_digit(F.col("o_orderkey"), 4, 4).alias("digit")))
query("x02_murmur", "WITH a AS (SELECT o_orderkey, o_orderkey & 4294967295 AS h FROM orders), b AS (SELECT o_orderkey, CAST((CAST(xor(h, h >> 16) AS hugeint) * 2246822507) % 4294967296 AS bigint) AS h FROM a), c AS (SELECT o_orderkey, CAST((CAST(xor(h, h >> 13) AS hugeint) * 3266489909) % 4294967296 AS bigint) AS h FROM b) SELECT o_orderkey, xor(h, h >> 16) AS h FROM c")(lambda t: t.orders.select("o_orderkey", X.murmur_finaliser(F.col("o_orderkey")).alias("h")))
query("x03_linear_hash", "SELECT o_orderkey, CAST(((1999 * CAST(o_orderkey AS hugeint) + 42) % 4294967291) % 1024 AS bigint) AS h FROM orders")(lambda t: t.orders.select("o_orderkey", X.linear_hash(F.col("o_orderkey"), 1999, 42, 4294967291, 1024).alias("h")))
query("x04_buckets", "SELECT o_orderkey, CAST(greatest(0, least(15, floor(o_orderkey * 16.0 / 10001))) AS int) AS r, CAST((o_orderkey >> 3) % 7 AS int) AS m FROM orders")(lambda t: t.orders.select("o_orderkey", X.range_bucket(F.col("o_orderkey"), 0, 10000, 16).alias("r"), X.modulo_bucket(F.col("o_orderkey"), 3, 7).alias("m")))
query("x04_order_key", "SELECT o_orderkey, ((o_orderkey >> 5) << 3) | (o_orderkey & 7) AS h FROM orders")(lambda t: t.orders.select("o_orderkey", X.order_key_hash(F.col("o_orderkey")).alias("h")))
query("x05_adjacency", f"WITH {E_SQL} SELECT src, string_agg(dst, ',' ORDER BY dst) AS near FROM e GROUP BY src")(lambda t: adjacency(t.edges, "src", "dst").select("src", F.array_join("near", ",").alias("near")))
query("x06_date_to_int", "SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y%m%d') AS int) AS d FROM orders")(lambda t: t.orders.select("o_orderkey", X.date_to_int(F.col("o_orderdate")).alias("d")))
query("x07_powers_of_2", "SELECT o_orderkey, CAST(2 ** floor(log2(o_orderkey)) AS bigint) AS lo, CAST(2 ** ceil(log2(o_orderkey)) AS bigint) AS hi, o_orderkey & (o_orderkey - 1) = 0 AS is FROM orders WHERE o_orderkey > 0".replace("AS is ", 'AS "is" '))(lambda t: t.orders.filter("o_orderkey > 0").select("o_orderkey", X.floor_power_of_2(F.col("o_orderkey")).alias("lo"), X.ceil_power_of_2(F.col("o_orderkey")).alias("hi"), X.is_power_of_2(F.col("o_orderkey")).alias("is")))
query("x08_strings", "SELECT url, split_part(url, '/', -1) AS name, split_part(url, '/', 3) AS host FROM pages")(lambda t: t.pages.select("url", X.file_name(F.col("url")).alias("name"), F.element_at(F.split("url", "/"), 3).alias("host")))
query("x09_sorted_search", f"WITH {E_SQL}, a AS (SELECT src, list(dst ORDER BY dst) AS near FROM e GROUP BY src) SELECT src, CAST(len(list_filter(near, lambda v: v < 10)) AS int) AS lo, CAST(len(list_filter(near, lambda v: v <= 10)) AS int) AS hi FROM a")(lambda t: adjacency(t.edges, "src", "dst").select("src", X.lower_bound(F.col("near"), F.lit(10)).alias("lo"), X.upper_bound(F.col("near"), F.lit(10)).alias("hi")))
query("x11_md5", "SELECT c_custkey, md5(c_name) AS h FROM customer")(lambda t: t.customer.select("c_custkey", F.md5("c_name").alias("h")))
query("x12_year", "SELECT CAST(year(o_orderdate) AS int) AS y, count(*) AS n FROM orders GROUP BY 1")(lambda t: t.orders.groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")))
query("x13_intervals", "SELECT o_orderkey, CAST(o_orderdate AS date) + INTERVAL 90 DAY AS plus_days, strftime(make_date(CAST(year(o_orderdate) + 1 AS int), CAST(month(o_orderdate) AS int), 1), '%Y-%m-%d') AS next_year FROM orders")(lambda t: t.orders.select("o_orderkey", F.date_add(F.col("o_orderdate").cast("date"), 90).cast("timestamp_ntz").alias("plus_days"), F.trunc(F.add_months(F.col("o_orderdate").cast("date"), 12), "month").cast("string").alias("next_year")))
query("x14_substring", "SELECT substring(p_type, 1, 5) AS s, count(*) AS n FROM part GROUP BY 1")(lambda t: t.part.groupBy(F.substring("p_type", 1, 5).alias("s")).agg(F.count("*").alias("n")))
query("x15_decode", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS d FROM orders")(lambda t: t.orders.select("o_orderkey", X.decode(F.col("o_orderstatus"), "F", 1, "O", 2, default=0).alias("d")))
query("x17_like", "SELECT CAST(sum(CASE WHEN p_type LIKE 'PRO%' THEN 1 ELSE 0 END) AS bigint) AS prefix, CAST(sum(CASE WHEN p_brand LIKE '%3' THEN 1 ELSE 0 END) AS bigint) AS suffix, CAST(sum(CASE WHEN p_name LIKE '%e%g%' THEN 1 ELSE 0 END) AS bigint) AS two FROM part")(lambda t: t.part.select(F.count_if(F.col("p_type").like("PRO%")).alias("prefix"), F.count_if(F.col("p_brand").like("%3")).alias("suffix"), F.count_if(F.col("p_name").like("%e%g%")).alias("two")))
query("x18_suffix_array", "WITH x AS (SELECT n_nationkey, n_name, CAST(unnest(range(1, length(n_name) + 1)) AS int) AS s FROM nation) SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY n_nationkey ORDER BY substring(n_name, s)) - 1 AS int) AS rank, s - 1 AS start FROM x")(lambda t: P.suffix_array(t.nation, "n_nationkey", "n_name"))

query("x18_burrows_wheeler", "WITH x AS (SELECT n_nationkey, n_name || chr(1) AS e FROM nation), s AS (SELECT n_nationkey, e, unnest(range(1, length(e) + 1)) AS i FROM x) SELECT n_nationkey, string_agg(CASE WHEN i = 1 THEN chr(1) ELSE substring(e, i - 1, 1) END, '' ORDER BY substring(e, i)) AS bwt FROM s GROUP BY n_nationkey")(lambda t: P.burrows_wheeler(t.nation, "n_nationkey", "n_name").select("n_nationkey", F.translate("bwt", "\0", "\1").alias("bwt")))
query("x18_move_to_front", "WITH RECURSIVE s AS (SELECT n_nationkey, n_name, list_sort(list_distinct(string_split(n_name, ''))) AS held, 1 AS i, CAST([] AS int[]) AS codes FROM nation UNION ALL SELECT n_nationkey, n_name, list_concat([substring(n_name, i, 1)], list_filter(held, lambda c: c <> substring(n_name, i, 1))), i + 1, list_append(codes, CAST(list_position(held, substring(n_name, i, 1)) - 1 AS int)) FROM s WHERE i <= length(n_name)) SELECT n_nationkey, array_to_string(codes, ',') AS codes FROM s WHERE i = length(n_name) + 1")(lambda t: P.move_to_front(t.nation, "n_nationkey", "n_name").select("n_nationkey", F.array_join("codes", ",").alias("codes")))


@query("x18_tridiagonal", "SELECT n_regionkey AS id, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS bigint) AS row, CAST(n_nationkey AS double) AS x FROM nation")
def _(t):
    """Systems whose solutions are the nations' keys: rows -1, 4, -1, and the right side made of them."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    around = lambda f: F.coalesce(f("n_nationkey").over(w), F.lit(0))
    rows = t.nation.select(F.col("n_regionkey").alias("id"), (F.row_number().over(w) - 1).cast("long").alias("row"), F.lit(-1.0).alias("a"), F.lit(4.0).alias("b"), F.lit(-1.0).alias("c"), (4 * F.col("n_nationkey") - around(F.lag) - around(F.lead)).alias("d"))
    return P.tridiagonal_solve(rows, "id", "row", "a", "b", "c", "d").withColumn("x", F.round("x", 6))


query("x18_compress", "SELECT n_nationkey, n_name AS back FROM nation")(lambda t: _through_codec(t, t.nation.select("n_nationkey", F.col("n_name").alias("back"))))
query("x18_rand", "SELECT CAST(i AS int) AS bin, true AS even FROM range(10) r(i)")(lambda t: gen.uniform(t.spark, 100_000, 0, 10, seed=5, name="bin").groupBy("bin").agg((F.abs(F.count("*") - 10_000) < 500).alias("even")))

# --- partitioning, search, expansion -----------------------------------------------------------------------------

query("p01_radix_partition", "SELECT l_suppkey & 15 AS bucket, count(*) AS n, min(l_suppkey) AS lo FROM lineitem GROUP BY 1")(lambda t: P.radix_partition(t.lineitem.select("l_suppkey"), "l_suppkey", 4).groupBy(F.col("bucket").cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.min("l_suppkey").alias("lo")))
query("p02_lookup_values", "SELECT l_orderkey, l_linenumber, l_suppkey, s_acctbal FROM lineitem LEFT JOIN (SELECT * FROM supplier WHERE s_suppkey % 2 = 0) s ON s_suppkey = l_suppkey")(lambda t: lookup_join(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey"), named(t.supplier.filter("s_suppkey % 2 = 0"), l_suppkey="s_suppkey", s_acctbal="s_acctbal"), "l_suppkey"))
query("p05_multisplit", "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_custkey % 4, o_orderkey) - 1 AS bigint) AS place FROM orders")(lambda t: P.multisplit(t.orders.select("o_orderkey", "o_custkey"), (F.col("o_custkey") % 4).cast("int"), "o_orderkey").select("o_orderkey", F.col("place").cast("long").alias("place")))
query("p07_expand", "SELECT p_partkey, CAST(unnest(range(p_size)) AS int) AS rank FROM part")(lambda t: P.expand(t.part.select("p_partkey", "p_size"), "p_size").select("p_partkey", "rank"))
query("p08_interval_gather", "SELECT i.s_suppkey, p.p_partkey, p.p_size FROM supplier i JOIN part p ON p.p_partkey >= i.s_suppkey * 2 AND p.p_partkey < i.s_suppkey * 2 + 5")(lambda t: P.interval_gather(t.supplier.select("s_suppkey", (F.col("s_suppkey") * 2).alias("start"), F.lit(5).alias("count")), t.part.select("p_partkey", "p_size"), "start", "count", "p_partkey").select("s_suppkey", "p_partkey", "p_size"))
query("p08_scatter", "SELECT i AS s_suppkey, s_nationkey FROM range((SELECT max(s_suppkey) + 21 FROM supplier)) r(i) LEFT JOIN supplier ON s_suppkey = i")(lambda t: P.scatter(t.supplier.select("s_suppkey", "s_nationkey"), "s_suppkey", (t.supplier.agg(F.max("s_suppkey")).first()[0] or 0) + 21))
query("p09_lower_bound", "SELECT s_acctbal AS v, (SELECT count(*) FROM customer WHERE c_acctbal < s_acctbal) AS bound FROM supplier")(lambda t: P.bounds(named(t.supplier, v="s_acctbal"), named(t.customer, v="c_acctbal"), "v"))
query("p09_upper_bound", "SELECT s_nationkey AS v, (SELECT count(*) FROM customer WHERE c_nationkey <= s_nationkey) AS bound FROM supplier")(lambda t: P.bounds(named(t.supplier, v="s_nationkey"), named(t.customer, v="c_nationkey"), "v", upper=True))
query("p10_compact_ids", "SELECT k AS l_partkey, CAST(row_number() OVER (ORDER BY k) - 1 AS bigint) AS dense FROM (SELECT DISTINCT l_partkey AS k FROM lineitem) x")(lambda t: P.compact_ids(t.lineitem, "l_partkey").withColumn("dense", F.col("dense").cast("long")))
query("p10_multivalue", "SELECT o_custkey, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS held FROM orders GROUP BY o_custkey")(lambda t: P.multivalue(t.orders, "o_custkey", "o_orderkey").select("o_custkey", F.array_join("values", ",").alias("held")))

# --- the caller's own functions ----------------------------------------------------------------------------------

query("u01_predicate", "SELECT c_custkey FROM customer WHERE c_custkey % 3 = 1 AND c_acctbal < 100")(lambda t: functors.where(t.customer, lambda d: (d["c_custkey"] % 3 == 1) & (d["c_acctbal"] < 100)).select("c_custkey"))
query("u02_reduction", "SELECT l_suppkey, bit_xor(l_orderkey) AS reduced FROM lineitem GROUP BY l_suppkey")(lambda t: functors.reduce_by(t.lineitem.select("l_suppkey", "l_orderkey"), ["l_suppkey"], "l_orderkey", F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b)))
query("u03_flat_map", "SELECT p_partkey, unnest([p_size, -p_size]) AS v FROM part")(lambda t: functors.flat_map(t.part, F.array(F.col("p_size"), -F.col("p_size")), "v").select("p_partkey", "v"))
query("u04_create_rows", "SELECT o_orderkey AS k, unnest(range(o_orderkey % 3)) AS i FROM orders")(lambda t: functors.create_rows(t.orders.select("o_orderkey"), _repeat, "k long, i long"))
query("u05_comparator", "SELECT c.c_custkey, count(*) AS n, CAST(sum(s.s_suppkey) AS bigint) AS suppliers FROM customer c JOIN supplier s ON c.c_custkey % 97 = s.s_suppkey % 97 GROUP BY c.c_custkey")(lambda t: functors.sum_by(t.customer.select("c_custkey"), t.supplier.select("s_suppkey"), F.col("c_custkey") % 97, F.col("s_suppkey") % 97, ["c_custkey"], "s_suppkey", "suppliers"))
query("u06_partitioner", "SELECT CAST(l_suppkey % 5 AS int) AS k, count(*) AS n FROM lineitem GROUP BY 1")(lambda t: functors.deal(t.lineitem, 5, F.col("l_suppkey") % 5).groupBy((F.col("l_suppkey") % 5).cast("int").alias("k")).agg(F.count("*").alias("n")))
query("x10_formats", "SELECT c_custkey, format('{:,}', c_custkey * 1234) AS f FROM customer")(lambda t: t.customer.select("c_custkey", F.format_number(F.col("c_custkey") * 1234, 0).alias("f")))
query("s16_reverse_edges", f"WITH {E_SQL} SELECT dst AS src, src AS dst FROM e")(lambda t: reverse_edges(t.edges))
query("s19_filtered_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY') AND o_orderdate < DATE '1997-01-01'")(lambda t: t.orders.filter("o_orderdate < DATE '1997-01-01'").join(t.customer.filter("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey"))

# --- generators: rows where they are fixed, else what must hold of them ------------------------------------------------

query("g01_uniform", "SELECT 100000 AS n, 100 AS kinds, 0 AS lo, 99 AS hi, true AS even")(lambda t: gen.uniform(t.spark, 100_000, 0, 100).groupBy("a0").agg(F.count("*").alias("c")).agg(F.sum("c").cast("int").alias("n"), F.count("*").cast("int").alias("kinds"), F.min("a0").alias("lo"), F.max("a0").alias("hi"), (F.max(F.abs(F.col("c") - 1000)) < 200).alias("even")))
query("g02_cyclic", "SELECT CAST(i % 7 AS int) AS a0 FROM range(100) r(i)")(lambda t: gen.cyclic(t.spark, 100, 7))
# The k-th commonest of 100 values has a share of k^-1.2: within four deviations for the five commonest.
query("g03_zipf", "WITH w AS (SELECT i, i ** -1.2 / (SELECT sum(j ** -1.2) FROM range(1, 101) q(j)) AS p FROM range(1, 101) r(i)) SELECT CAST(i AS int) AS place, true AS near FROM w WHERE i <= 5")(lambda t: _zipf_places(gen.zipf(t.spark, 100_000, 0, 100, 1.2), 100_000, 100, 1.2))
query("g04_relation", "SELECT 20000 AS n, 2 AS lo, 8 AS hi, true AS skewed")(lambda t: gen.generate_relation(t.spark, 20_000, [{"attr": 2, "low": 2, "high": 9}, {"attr": 4, "low": 0, "high": 50, "alpha": 1.5}]).groupBy("a4").agg(F.count("*").alias("c"), F.min("a2").alias("lo"), F.max("a2").alias("hi")).agg(F.sum("c").cast("int").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), (F.max("c") > 20_000 / 3).alias("skewed")))
query("g05_unique_pairs", "SELECT 5000 AS n, 5000 AS kinds, true AS inside")(lambda t: gen.unique_pairs(t.spark, 5000, 0, 100).agg(F.count("*").cast("int").alias("n"), F.count_distinct("a0", "a1").cast("int").alias("kinds"), (F.min(F.least("a0", "a1")).between(0, 9) & F.max(F.greatest("a0", "a1")).between(90, 99)).alias("inside")))
query("g06_sequential_pairs", "SELECT CAST(i // 9 AS int) AS a0, CAST(i % 9 AS int) AS a1 FROM range(70) r(i)")(lambda t: gen.sequential_pairs(t.spark, 70, 9))
query("g07_skewed_pairs", "SELECT true AS distinct_rows, true AS skewed, true AS inside")(lambda t: gen.skewed_pairs(t.spark, 20_000, 400, 1.1).groupBy("a0").agg(F.count("*").alias("c"), F.count_distinct("a1").alias("d"), F.max("a1").alias("m")).agg((F.sum("c") == F.sum("d")).alias("distinct_rows"), (F.max("c") > 3 * F.avg("c")).alias("skewed"), ((F.max("a0") < 400) & (F.max("m") < 400)).alias("inside")))


@query("g08_triangle_relations", "SELECT 'a0,a1' AS names, 300 AS n, 300 AS kinds UNION ALL SELECT 'a1,a2', 300, 300 UNION ALL SELECT 'a0,a2', 300, 300")
def _(t):
    made = [r.agg(F.lit(",".join(r.columns)).alias("names"), F.count("*").cast("int").alias("n"), F.count_distinct(*r.columns).cast("int").alias("kinds")) for r in gen.triangle_relations(t.spark, 300, 40)]
    return made[0].unionByName(made[1]).unionByName(made[2])


query("g09_primary_keys", "SELECT CAST(i + 1 AS int) AS key, CAST(i AS int) AS payload FROM range(50) r(i)")(lambda t: gen.primary_keys(t.spark, 50))
query("g09_foreign_keys", "SELECT CAST(i % 30 + 1 AS int) AS key, CAST(count(*) AS bigint) AS n FROM range(1000) r(i) GROUP BY 1")(lambda t: gen.foreign_keys(t.spark, 1000, 30).groupBy("key").agg(F.count("*").alias("n")))
query("g09_non_unique_keys", "SELECT 5000 AS n, true AS repeated, true AS inside")(lambda t: gen.uniform(t.spark, 5000, 1, 101, name="key").agg(F.count("*").cast("int").alias("n"), (F.count_distinct("key") <= 100).alias("repeated"), (F.min("key").between(1, 3) & F.max("key").between(98, 100)).alias("inside")))


def _zipf_places(values: DataFrame, n: int, span: int, alpha: float) -> DataFrame:
    """Of the five commonest values: whether their number is what the law says, within four deviations."""
    total = sum(k**-alpha for k in range(1, span + 1))
    counts = values.groupBy("a0").agg(F.count("*").alias("c")).orderBy(F.desc("c"), "a0").limit(5)
    placed = counts.select(F.row_number().over(Window.orderBy(F.desc("c"), "a0")).alias("place"), "c")  # five rows
    p = F.pow("place", F.lit(-alpha)) / total
    return placed.select("place", (F.abs(F.col("c") - n * p) < 4 * F.sqrt(n * p)).alias("near"))


# --- sources: tables written in each format and read back ----------------------------------------------------------------

S_EDGES = f"WITH {E_SQL} SELECT CAST(src AS int) AS src, CAST(dst AS int) AS dst FROM e"


def _ab(t: Tables) -> DataFrame:
    return t.edges.toDF("a0", "a1").select(F.col("a0").cast("int").alias("a0"), F.col("a1").cast("int").alias("a1"))


def _db(t: Tables) -> str:
    at = t.folder("db")
    columnar.write_columnar(_ab(t), at)
    return at


def _tbl(t: Tables, df: DataFrame) -> str:
    at = t.folder("tbl")
    text.write_delimited(df, at, "|")
    return at


def _el(t: Tables, sep: str = " ") -> str:
    at = t.folder("el")
    text.write_delimited(t.edges, at, sep)
    return at


query("s01_columnar", S_EDGES)(lambda t: columnar.read_relation(t.spark, _db(t)).toDF("src", "dst"))
query("s03_graph", "SELECT CAST(s_suppkey AS int) AS src, CAST(s_nationkey AS int) AS dst FROM supplier")(lambda t: columnar.read_graph(t.spark, columnar.write_columnar(t.supplier.select(F.col("s_suppkey").alias("a0"), F.col("s_nationkey").alias("a1")).coalesce(1), t.folder("db"))[0]))
query("s04_relations_in_order", "SELECT CAST(s_suppkey AS int) AS a0, CAST(s_nationkey AS int) AS a1, CAST(n_regionkey AS int) AS a2 FROM supplier JOIN nation ON n_nationkey = s_nationkey")(lambda t: natural_join(_two_relations(t)))
query("s06_trie_before_columns", S_EDGES)(lambda t: _preferred(t).toDF("src", "dst"))
query("s07_trie", S_EDGES)(lambda t: trie.read_tries(t.spark, trie.write_tries(_ab(t), t.folder("tr"))).toDF("src", "dst"))
query("s10_space_separated", S_EDGES)(lambda t: text.read_edge_list(t.spark, _el(t)))
query("s11_tab_separated", S_EDGES)(lambda t: text.read_table(t.spark, _el(t, "\t"), [0, 1], ["src", "dst"], ["int", "int"], "\t"))
query("s12_table_to_columnar", "SELECT CAST(o_orderkey AS int) AS a5, CAST(o_custkey AS int) AS a2 FROM orders")(lambda t: _table_to_columnar(t))
query("s13_table_to_tsv", "SELECT o_orderstatus AS s, CAST(o_orderkey AS int) AS k FROM orders")(lambda t: _table_to_tsv(t))
query("s14_edge_list_to_columnar", S_EDGES)(lambda t: _edge_list_to_columnar(t))
query("s15_edge_list_to_adjacency", f"WITH {E_SQL} SELECT CAST(src AS int) AS src, string_agg(dst, ',' ORDER BY dst) AS near FROM e GROUP BY src")(lambda t: adjacency(text.read_edge_list(t.spark, _el(t, "|")), "src", "dst").select("src", F.array_join("near", ",").alias("near")))
query("s17_table_columns", "SELECT CAST(c_custkey AS bigint) AS k, c_mktsegment AS s FROM customer")(lambda t: text.read_table(t.spark, _tbl(t, t.customer.select("c_name", "c_mktsegment", "c_custkey")), [2, 1], ["k", "s"], ["bigint", "string"]))
query("s18_without_self_loops", f"{S_EDGES} WHERE src <> dst")(lambda t: text.read_table(t.spark, _tbl(t, t.edges), [0, 1], ["src", "dst"], ["int", "int"], drop_self_loops=True))
query("s20_orders_before", "SELECT o_orderkey AS k FROM orders WHERE o_orderdate < DATE '1997-01-01'")(lambda t: text.read_table(t.spark, _tbl(t, t.orders.select("o_orderkey", F.col("o_orderdate").cast("date").cast("string"))), [0, 1], ["k", "d"], ["bigint", "date"], where=F.col("d") < F.lit("1997-01-01").cast("date")).select("k"))
query("s21_lines_after", "SELECT l_orderkey AS k, CAST(l_linenumber AS int) AS i FROM lineitem WHERE l_shipdate > DATE '1999-01-01'")(lambda t: text.read_table(t.spark, _tbl(t, t.lineitem.select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").cast("string"))), [0, 1, 2], ["k", "i", "d"], ["bigint", "int", "date"], where=F.col("d") > F.lit("1999-01-01").cast("date")).select("k", "i"))
query("s22_rows_of_a_file", "SELECT count(*) AS n FROM orders")(lambda t: text.row_count(t.spark, _tbl(t, t.orders.select("o_orderkey"))))
query("s23_export_table", "SELECT n_nationkey AS k, n_name AS s, n_regionkey AS r FROM nation")(lambda t: text.read_table(t.spark, _tbl(t, t.nation.select("n_nationkey", "n_name", "n_regionkey")), [0, 1, 2], ["k", "s", "r"], ["bigint", "string", "bigint"]))
query("s24_split_columns", "SELECT s_name AS value FROM supplier")(lambda t: _split_columns(t))
query("s25_compressed_text", "SELECT CAST(s_suppkey AS int) AS k FROM supplier")(lambda t: _bzip2(t))
query("s26_relation_as_text", "SELECT CAST(i + 1 AS int) AS key, CAST(i AS int) AS payload FROM range(200) r(i)")(lambda t: text.read_table(t.spark, _tbl(t, gen.primary_keys(t.spark, 200)), [0, 1], ["key", "payload"], ["int", "int"]))


def _through_codec(t: Tables, df: DataFrame) -> DataFrame:
    """Columns compressed by a codec, and decompressed."""
    at = t.folder("zstd")
    df.write.option("compression", "zstd").parquet(at)
    return t.spark.read.parquet(at)


def _two_relations(t: Tables) -> list[DataFrame]:
    at = t.folder("db")
    columnar.write_columnar(t.nation.select(F.col("n_nationkey").alias("a1"), F.col("n_regionkey").alias("a2")).coalesce(1), f"{at}/x")
    columnar.write_columnar(t.supplier.select(F.col("s_suppkey").alias("a0"), F.col("s_nationkey").alias("a1")).coalesce(1), f"{at}/y")
    return columnar.read_relations(t.spark, at, [1, 0])


def _preferred(t: Tables) -> DataFrame:
    """A folder with a relation as tries, and files of its stems as columns, which mustn't be read."""
    at = t.folder("tr")
    for path in trie.write_tries(_ab(t), at):
        columnar.put_file(f"{path.removesuffix('.tr')}.db", b"")
    return trie.read_any(t.spark, at)


def _table_to_columnar(t: Tables) -> DataFrame:
    to = t.folder("db")
    text.table_to_columnar(t.spark, _tbl(t, t.orders.select("o_orderkey", "o_orderstatus", "o_custkey")), [0, 2], [5, 2], to)
    return columnar.read_relation(t.spark, to)


def _table_to_tsv(t: Tables) -> DataFrame:
    to = t.folder("tsv")
    text.table_to_tsv(t.spark, _tbl(t, t.orders.select("o_orderkey", "o_orderstatus")), [1, 0], to)
    return text.read_table(t.spark, to, [0, 1], ["s", "k"], ["string", "int"], "\t")


def _edge_list_to_columnar(t: Tables) -> DataFrame:
    to = t.folder("db")
    text.edge_list_to_columnar(t.spark, _el(t, "\t"), to)
    return columnar.read_relation(t.spark, to).toDF("src", "dst")


def _split_columns(t: Tables) -> DataFrame:
    to = t.folder("columns")
    text.split_columns(t.supplier.select("s_suppkey", "s_name"), to)
    return t.spark.read.text(f"{to}/s_name")


def _bzip2(t: Tables) -> DataFrame:
    to = t.folder("bz2")
    text.write_delimited(t.supplier.select("s_suppkey"), to, "|", "bzip2")
    return text.read_table(t.spark, to, [0], ["k"], ["int"])


# --- decision support --------------------------------------------------------------------------------------------

for _name, _sql in decision.QUERIES.items():
    QUERIES[_name] = lambda spark, sf_dir, sql=_sql: decision.run(spark, sf_dir, sql)
    ORACLES[_name] = _sql
for _name, (_base, _) in decision.VARIANTS.items():
    QUERIES[_name] = lambda spark, sf_dir, sql=decision.SPARK_VARIANTS[_name]: decision.run(spark, sf_dir, sql)
    ORACLES[_name] = decision.QUERIES[_base]


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    """Triangles of the part-supplier graph."""
    return pat.match(Tables(spark, sf_dir).edges, assume_distinct=True)
