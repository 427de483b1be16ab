"""Lookups in configuration tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import lookups
from workload.feeds import table
from workload.registry import query


@query("lookup_optional", """
SELECT p_partkey, p_type FROM part WHERE p_size = 7 AND lower(p_brand) = lower('Brand#1')""")
def lookup_optional(spark, sf):
    rows = table(spark, sf, "part")
    found = lookups.matching(rows, ignore_case=["p_brand"], p_size=7, p_name=None, p_brand="BRAND#1")
    return found.select("p_partkey", "p_type")


@query("lookup_requests", """
WITH q AS (
  SELECT c_custkey AS request, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS s_nationkey,
    CASE WHEN c_custkey % 3 <> 1 THEN CAST(c_custkey % 100 AS BIGINT) END AS s_suppkey FROM customer)
SELECT request, s.s_suppkey, s.s_nationkey FROM q JOIN supplier s
  ON (q.s_nationkey IS NULL OR q.s_nationkey = s.s_nationkey) AND (q.s_suppkey IS NULL OR q.s_suppkey = s.s_suppkey)""")
def lookup_requests(spark, sf):
    """Suppliers by nation, number or both, one request per customer."""
    requests = table(spark, sf, "customer").selectExpr(
        "c_custkey AS request", "CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS s_nationkey",
        "CASE WHEN c_custkey % 3 <> 1 THEN CAST(c_custkey % 100 AS bigint) END AS s_suppkey")
    rows = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return lookups.answered(rows, requests, "request", ["s_nationkey", "s_suppkey"])


def orders_per_customer(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    return lookups.one_per_key(orders, ["custkey"], customers)


@query("exactly_one", """
SELECT o_custkey AS custkey, max(o_orderkey) AS o_orderkey, max(o_totalprice) AS o_totalprice
FROM orders GROUP BY 1 HAVING count(*) = 1""")
def exactly_one(spark, sf):
    return orders_per_customer(spark, sf)[0]


@query("not_exactly_one", """
SELECT coalesce(c_custkey, o_custkey) AS custkey, count(o_orderkey) AS found
FROM customer FULL JOIN orders ON c_custkey = o_custkey GROUP BY 1 HAVING count(o_orderkey) <> 1""")
def not_exactly_one(spark, sf):
    return orders_per_customer(spark, sf)[1]
