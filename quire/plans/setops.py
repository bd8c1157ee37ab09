"""U: set operations on registers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reconcile
from .registry import Tables, plan


@plan("u1_union", "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def u1(t: Tables):
    suppliers = t("supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))
    return t("customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).unionByName(suppliers)


@plan("u2_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 10")
def u2(t: Tables):
    used = t("lineitem").filter((F.col("l_returnflag") == "A") & (F.col("l_quantity") < 10)).select("l_partkey")
    return t("part").select("p_partkey").subtract(used)


@plan("u3_intersection", """
SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'""")
def u3(t: Tables):
    verified = t("customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_custkey")
    return verified.intersect(t("orders").filter(F.col("o_orderstatus") == "P").select("o_custkey"))


@plan("u4_coverage", """
WITH r AS (SELECT o_orderkey AS k FROM orders WHERE o_orderpriority <> '5-LOW'),
p AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')
(SELECT k, 'register' AS only_in FROM r EXCEPT SELECT k, 'register' FROM p) UNION ALL (SELECT k, 'parts' FROM p EXCEPT SELECT k, 'parts' FROM r)""")
def u4(t: Tables):
    orders = t("orders").withColumn("k", F.col("o_orderkey"))
    register = orders.filter(F.col("o_orderpriority") != "5-LOW")
    index, duplicates = orders.filter(F.col("o_orderstatus") == "F"), orders.filter(F.col("o_orderstatus") == "P")
    return reconcile.coverage(register, index, duplicates, key="k")
