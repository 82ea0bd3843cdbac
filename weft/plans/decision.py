"""The decision-support queries, adapted to tables without partsupp, comments, ship modes and commit dates.

Each is one SQL text that Spark and the oracle both run. Parameters are chosen so that the driver's data give rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
REVENUE = "l_extendedprice * (1 - l_discount)"

QUERIES: dict[str, str] = {
    "q01": f"""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
  round(sum({REVENUE}), 2) AS sum_disc_price, round(sum({REVENUE} * (1 + l_tax)), 2) AS sum_charge,
  round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
    # No partsupp: the cheapest part of each type, among small brands.
    "q02": """
WITH least AS (SELECT p_type AS kind, min(p_retailprice) AS price FROM part WHERE p_brand LIKE '%1' GROUP BY p_type)
SELECT p_partkey, p_type, p_brand, p_retailprice FROM part JOIN least ON p_type = kind AND p_retailprice = price
WHERE p_brand LIKE '%1' ORDER BY p_retailprice DESC, p_partkey LIMIT 100""",
    "q03": f"""
SELECT o_orderkey, round(sum({REVENUE}), 2) AS revenue, o_orderdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY o_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, o_orderkey LIMIT 10""",
    # No commit and receipt dates: an item shipped more than 60 days after its order is late.
    "q04": """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_shipdate > o_orderdate + INTERVAL '60' DAY)
GROUP BY o_orderpriority""",
    "q05": f"""
SELECT n_name, round(sum({REVENUE}), 2) AS revenue
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey AND s_nationkey = c_nationkey
WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01' GROUP BY n_name""",
    "q06": """
SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "q07": f"""
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 2) AS revenue FROM (
  SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS int) AS l_year, {REVENUE} AS volume
  FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
    JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey
  WHERE ((a.n_name = 'NATION_1' AND b.n_name = 'NATION_2') OR (a.n_name = 'NATION_2' AND b.n_name = 'NATION_1'))
    AND l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31') shipping
GROUP BY supp_nation, cust_nation, l_year""",
    "q08": f"""
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_1' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS int) AS o_year, {REVENUE} AS volume, b.n_name AS nation
  FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
    JOIN customer ON c_custkey = o_custkey JOIN nation a ON a.n_nationkey = c_nationkey JOIN region ON r_regionkey = a.n_regionkey
    JOIN nation b ON b.n_nationkey = s_nationkey
  WHERE r_name = 'AMERICA' AND o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND p_type = 'ECONOMY') all_nations
GROUP BY o_year""",
    # No supply cost: the amount is the revenue.
    "q09": f"""
SELECT n_name AS nation, CAST(year(o_orderdate) AS int) AS o_year, round(sum({REVENUE}), 2) AS sum_profit
FROM part JOIN lineitem ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
  JOIN nation ON n_nationkey = s_nationkey
WHERE p_name LIKE '%red%' GROUP BY n_name, CAST(year(o_orderdate) AS int)""",
    "q10": f"""
SELECT c_custkey, c_name, round(sum({REVENUE}), 2) AS revenue, c_acctbal, n_name
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON n_nationkey = c_nationkey
WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""",
    # No partsupp: the value of a part is what suppliers of the nation have sold of it.
    "q11": """
WITH sold AS (SELECT l_partkey, l_quantity * l_extendedprice AS amount FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_name = 'NATION_3')
SELECT l_partkey, round(sum(amount), 2) AS value FROM sold GROUP BY l_partkey HAVING sum(amount) > (SELECT sum(amount) * 0.002 FROM sold)""",
    # No ship mode: return flags stand for it.
    "q12": """
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS bigint) AS high_line_count,
  CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS bigint) AS low_line_count
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE l_returnflag IN ('R', 'A') AND l_shipdate > o_orderdate AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_returnflag""",
    "q13": """
SELECT c_count, count(*) AS custdist FROM (
  SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus <> 'F' GROUP BY c_custkey) c_orders
GROUP BY c_count""",
    "q14": f"""
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 6) AS promo_revenue
FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'""",
    "q15": f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({REVENUE}), 2) AS total_revenue FROM lineitem
  WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)""",
    # No partsupp and comments: suppliers in debt don't count.
    "q16": """
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
  AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""",
    "q17": """
SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#23' AND l_quantity < (SELECT 0.2 * avg(i.l_quantity) FROM lineitem i WHERE i.l_partkey = p_partkey)""",
    "q18": """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS qty
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""",
    "q19": f"""
SELECT round(sum({REVENUE}), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15)
   OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30)
   OR (p_brand = 'Brand#14' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 45)""",
    # No partsupp: suppliers whose sales of a part exceed half of what the part's suppliers sell on average.
    "q20": """
WITH sold AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_partkey, l_suppkey)
SELECT s_suppkey, s_name FROM supplier JOIN nation ON n_nationkey = s_nationkey
WHERE n_name = 'NATION_4' AND s_suppkey IN (
  SELECT l_suppkey FROM sold WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_type LIKE 'P%')
    AND qty > (SELECT 0.5 * avg(o.qty) FROM sold o WHERE o.l_partkey = sold.l_partkey))""",
    # No receipt dates: a returned item stands for a late one.
    "q21": """
SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem a ON s_suppkey = a.l_suppkey JOIN orders ON o_orderkey = a.l_orderkey JOIN nation ON n_nationkey = s_nationkey
WHERE o_orderstatus = 'F' AND a.l_returnflag = 'R' AND n_name = 'NATION_5'
  AND EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
  AND NOT EXISTS (SELECT 1 FROM lineitem c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_returnflag = 'R')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    # No phone: the nation is the code; only recent orders count as orders.
    "q22": """
SELECT c_nationkey AS cntrycode, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer
WHERE c_nationkey IN (13, 31, 23, 2, 9, 18, 17) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0.00 AND c_nationkey IN (13, 31, 23, 2, 9, 18, 17))
  AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01') GROUP BY c_nationkey""",
}
#: Variants: DECODE for CASE, a derived table for an outer join's groups, a share by counts.
VARIANTS: dict[str, tuple[str, str]] = {
    "q08a": ("q08", "sum(CASE WHEN nation = 'NATION_1' THEN volume ELSE 0 END)"),
    "q12a": ("q12", ""),
    "q13a": ("q13", ""),
    "q14a": ("q14", "sum(CASE WHEN p_type LIKE 'PROMO%'"),
    "q15a": ("q15", ""),
}
SPARK_VARIANTS: dict[str, str] = {
    "q08a": QUERIES["q08"].replace(VARIANTS["q08a"][1], "sum(decode(nation, 'NATION_1', volume, 0))"),
    "q12a": QUERIES["q12"].replace("CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END", "decode(o_orderpriority, '1-URGENT', 1, '2-HIGH', 1, 0)").replace("CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END", "decode(o_orderpriority, '1-URGENT', 0, '2-HIGH', 0, 1)"),
    "q13a": """
WITH per_customer AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey)
SELECT coalesce(n, 0) AS c_count, count(*) AS custdist FROM customer LEFT JOIN per_customer ON c_custkey = o_custkey GROUP BY coalesce(n, 0)""",
    "q14a": QUERIES["q14"].replace("CASE WHEN p_type LIKE 'PROMO%'", "CASE WHEN substring(p_type, 1, 5) = 'PROMO'"),
    "q15a": """
SELECT s_suppkey, s_name, total_revenue FROM (
  SELECT s_suppkey, s_name, total_revenue, rank() OVER (ORDER BY total_revenue DESC) AS place FROM supplier JOIN (
    SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM lineitem
    WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey) r ON s_suppkey = l_suppkey) ranked WHERE place = 1""",
}


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The query over this folder's tables; views are replaced, so a later query reads its own folder."""
    for name in TABLES:
        if name in sql:
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    return spark.sql(sql)
