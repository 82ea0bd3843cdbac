"""What plans must look like to hold at scale."""

import os
import re

import pytest
from pyspark.sql import functions as F

from weft import queries as core
from weft.operators.natural_join import natural_join

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_projection_and_filter_reach_the_scan(spark):
    t = core.Tables(spark, SF)
    customer = t.customer.filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("a0"))
    text = plan(natural_join([customer, t.orders.select(F.col("o_custkey").alias("a0"), F.col("o_orderkey").alias("a1"))]))
    assert "EqualTo(c_mktsegment,BUILDING)" in text
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>", text)
    assert "c_name" not in text


def test_broadcast_star_has_no_shuffle(spark):
    t = core.Tables(spark, SF)
    held = [t.lineitem.select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")), t.part.select(F.col("p_partkey").alias("p")), t.supplier.select(F.col("s_suppkey").alias("s"))]
    text = plan(natural_join(held, strategy="broadcast"))
    assert text.count("BroadcastHashJoin") == 2 and "hashpartitioning" not in text


@pytest.mark.parametrize("name", sorted(core.ORACLES))
def test_no_cartesian_product_and_no_python_rows(spark, name):
    text = plan(core.QUERIES[name](spark, SF))
    assert "BatchEvalPython" not in text
    if name != "j43_nested_loop":
        assert "CartesianProduct" not in text
