"""Upserts, reconciliation and cascades on keyed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import mirror
from workload.feeds import table
from workload.registry import query

# Customers as mirrored rows; the newest order of each customer as the upstream's.


def mirrored(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "c_name AS label", "c_acctbal AS amount", "c_nationkey AS link",
        "CAST('2024-01-01' AS timestamp_ntz) AS synced")


MIRRORED_SQL = """mirrored AS (
  SELECT c_custkey AS id, c_name AS label, c_acctbal AS amount, c_nationkey AS link,
    TIMESTAMP '2024-01-01' AS synced FROM customer)"""


def upstream(spark, sf):
    orders = table(spark, sf, "orders").filter("o_orderstatus = 'F'").selectExpr(
        "o_custkey * 3 div 2 AS id", "o_orderpriority AS label", "o_totalprice AS amount",
        "CAST(o_orderkey % 25 AS int) AS link", "o_orderkey")
    return mirror.newest_per_key(orders, ["id"], F.col("o_orderkey")).drop("o_orderkey")


UPSTREAM_SQL = """upstream AS (
  SELECT o_custkey * 3 // 2 AS id, o_orderpriority AS label, o_totalprice AS amount,
    CAST(o_orderkey % 25 AS INTEGER) AS link FROM orders WHERE o_orderstatus = 'F'
  QUALIFY row_number() OVER (PARTITION BY o_custkey * 3 // 2 ORDER BY o_orderkey DESC) = 1)"""

BOTH = f"WITH {MIRRORED_SQL}, {UPSTREAM_SQL}"

def now():
    return F.lit("2024-06-01").cast("timestamp_ntz")


MERGED_COLUMNS = """coalesce(u.id, m.id) AS id,
  CASE WHEN u.id IS NULL THEN m.label ELSE u.label END AS label,
  CASE WHEN u.id IS NULL THEN m.amount ELSE u.amount END AS amount,
  CASE WHEN m.id IS NULL THEN u.link ELSE m.link END AS link,
  CASE WHEN u.id IS NULL THEN m.synced ELSE TIMESTAMP '2024-06-01' END AS synced"""


@query("upsert", f"{BOTH} SELECT {MERGED_COLUMNS} FROM mirrored m FULL JOIN upstream u ON m.id = u.id")
def upsert(spark, sf):
    return mirror.upsert(mirrored(spark, sf), upstream(spark, sf), ["id"], keep=["link"],
                         stamps={"synced": now()})


@query("reconcile", f"""{BOTH}
SELECT {MERGED_COLUMNS}, CASE WHEN m.id IS NULL THEN 'inserted' WHEN u.id IS NULL THEN 'deleted'
    WHEN m.label = u.label AND m.amount = u.amount THEN 'unchanged' ELSE 'updated' END AS action
FROM mirrored m FULL JOIN upstream u ON m.id = u.id""")
def reconcile(spark, sf):
    return mirror.reconcile(mirrored(spark, sf), upstream(spark, sf), ["id"], keep=["link"],
                            stamps={"synced": now()})


@query("reconciled", f"""{BOTH}
SELECT {MERGED_COLUMNS} FROM mirrored m RIGHT JOIN upstream u ON m.id = u.id""")
def reconciled(spark, sf):
    return mirror.reconciled(reconcile(spark, sf))


@query("reconcile_removed", f"""{BOTH}
SELECT count(*) AS removed FROM mirrored WHERE id NOT IN (SELECT id FROM upstream)""")
def reconcile_removed(spark, sf):
    return mirror.removed_count(reconcile(spark, sf))


# Customers against customers with two columns redone, so that every action occurs.


@query("snapshot_diff", """
SELECT coalesce(a.c_custkey, b.k) AS c_custkey,
  CASE WHEN a.c_custkey IS NULL THEN 'inserted' WHEN b.k IS NULL THEN 'deleted'
    WHEN a.c_mktsegment IS NOT DISTINCT FROM b.seg THEN 'unchanged' ELSE 'updated' END AS action
FROM customer a FULL JOIN (
  SELECT c_custkey + 100 * CAST(c_nationkey > 12 AS INTEGER) AS k,
    arg_max(CASE WHEN c_nationkey % 2 = 0 THEN c_mktsegment END, c_nationkey * 10000000 + c_custkey)
      FILTER (WHERE c_nationkey % 2 = 0) AS seg
  FROM customer GROUP BY 1) b ON a.c_custkey = b.k""")
def snapshot_diff(spark, sf):
    customer = table(spark, sf, "customer")
    even = F.col("c_nationkey") % 2 == 0
    other = customer.groupBy(
        (F.col("c_custkey") + 100 * (F.col("c_nationkey") > 12).cast("int")).alias("c_custkey")
    ).agg(F.max_by("c_mktsegment", F.when(
        even, F.col("c_nationkey") * 10000000 + F.col("c_custkey"))).alias("c_mktsegment"))
    return mirror.snapshot_diff(customer.select("c_custkey", "c_mktsegment"), other, ["c_custkey"])


@query("not_in", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)""")
def not_in(spark, sf):
    orders = table(spark, sf, "orders").filter("o_totalprice > 400000").select(
        F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(orders, "c_custkey", "left_anti").select(
        "c_custkey", "c_name")


@query("semi_in", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""")
def semi_in(spark, sf):
    owing = table(spark, sf, "customer").filter("c_acctbal < 0").select(
        F.col("c_custkey").alias("o_custkey"))
    return mirror.keep_only(table(spark, sf, "orders"), owing, ["o_custkey"]).select(
        "o_orderkey", "o_totalprice")


@query("keep_only", """
SELECT c_custkey, c_name FROM customer
WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def keep_only(spark, sf):
    seen = table(spark, sf, "orders").filter("o_totalprice > 300000").select(
        F.col("o_custkey").alias("c_custkey"))
    return mirror.keep_only(table(spark, sf, "customer"), seen, ["c_custkey"]).select(
        "c_custkey", "c_name")


@query("keep_none", "SELECT count(*) AS kept FROM customer WHERE c_custkey < 0")
def keep_none(spark, sf):
    nobody = table(spark, sf, "customer").filter("c_custkey < 0")
    kept = mirror.keep_only(table(spark, sf, "customer"), nobody, ["c_custkey"])
    return kept.agg(F.count("*").alias("kept"))


# Orders as children of customers; customers of some nations are replaced.


def children(spark, sf):
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS id", "o_custkey AS parent", "o_totalprice AS amount", "o_orderpriority AS note")


def incoming_children(spark, sf):
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").groupBy("l_orderkey").agg(
        F.max("l_extendedprice").alias("amount"), F.max("l_suppkey").alias("s"))
    customers = table(spark, sf, "customer").filter("c_nationkey < 10").select("c_custkey")
    joined = lines.join(customers, F.col("s") * 13 == F.col("c_custkey"))
    return joined.selectExpr("l_orderkey AS id", "c_custkey AS parent", "amount",
                             "'from upstream' AS note")


INCOMING_SQL = """incoming AS (
  SELECT l_orderkey AS id, c_custkey AS parent, amount, 'from upstream' AS note
  FROM (SELECT l_orderkey, max(l_extendedprice) AS amount, max(l_suppkey) AS s
        FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
  JOIN customer ON s * 13 = c_custkey WHERE c_nationkey < 10),
children AS (
  SELECT o_orderkey AS id, o_custkey AS parent, o_totalprice AS amount, o_orderpriority AS note
  FROM orders),
parents AS (SELECT c_custkey AS parent FROM customer WHERE c_nationkey < 10)"""


@query("replace_children", f"""WITH {INCOMING_SQL}
SELECT i.id, i.parent, i.amount, coalesce(c.note, i.note) AS note
FROM incoming i LEFT JOIN children c ON i.id = c.id
UNION ALL
SELECT * FROM children WHERE id NOT IN (SELECT id FROM incoming)
  AND parent NOT IN (SELECT parent FROM parents)""")
def replace_children(spark, sf):
    parents = table(spark, sf, "customer").filter("c_nationkey < 10").select(
        F.col("c_custkey").alias("parent"))
    return mirror.replace_children(children(spark, sf), incoming_children(spark, sf), parents,
                                   ["id"], "parent", keep=["note"])


@query("replace_owned", f"""WITH {INCOMING_SQL}
SELECT id, parent, amount FROM incoming
UNION ALL
SELECT id, parent, amount FROM children WHERE parent NOT IN (SELECT parent FROM parents)""")
def replace_owned(spark, sf):
    parents = table(spark, sf, "customer").filter("c_nationkey < 10").select(
        F.col("c_custkey").alias("parent"))
    columns = ["id", "parent", "amount"]
    return mirror.replace_owned(
        children(spark, sf).select(columns), incoming_children(spark, sf).select(columns), parents,
        "parent").select(columns)


@query("cascade_delete", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def cascade_delete(spark, sf):
    gone = table(spark, sf, "orders").filter("o_orderstatus = 'P'")
    return mirror.cascade_children(table(spark, sf, "lineitem"), gone, "l_orderkey",
                                   "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@query("unlink", """
SELECT o_orderkey, CASE WHEN c_acctbal >= 0 THEN o_custkey END AS o_custkey
FROM orders JOIN customer ON o_custkey = c_custkey""")
def unlink(spark, sf):
    gone = table(spark, sf, "customer").filter("c_acctbal < 0")
    return mirror.unlink(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), gone,
                         "o_custkey", "c_custkey")


ORPHANS = """SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice < 400000 THEN o_custkey END AS owner
  FROM orders"""


@query("orphans", f"""
SELECT o_orderkey, owner FROM ({ORPHANS}) WHERE owner IS NOT NULL
  AND owner NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')""")
def orphans(spark, sf):
    owned = table(spark, sf, "orders").selectExpr(
        "o_orderkey", "CASE WHEN o_totalprice < 400000 THEN o_custkey END AS owner")
    owners = table(spark, sf, "customer").filter("c_mktsegment <> 'BUILDING'")
    return mirror.orphans(owned, owners, "owner", "c_custkey")


@query("exclusive_flag", """
SELECT s_suppkey, s_suppkey = (SELECT max(s_suppkey) FROM supplier) // 2 AS is_primary FROM supplier""")
def exclusive_flag(spark, sf):
    supplier = table(spark, sf, "supplier").select("s_suppkey")
    middle = supplier.agg(F.expr("max(s_suppkey) div 2").alias("middle"))
    rows = supplier.join(middle, F.col("s_suppkey") == F.col("middle"), "left")
    return mirror.set_exclusive_flag(rows, "is_primary", F.col("middle").isNotNull()).select(
        "s_suppkey", "is_primary")


@query("exclusive_flag_per_group", """
SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = 1
  AS is_primary FROM customer""")
def exclusive_flag_per_group(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return mirror.set_exclusive_flag_per_group(
        rows, "c_nationkey", "c_custkey", "is_primary", F.struct("c_acctbal", "c_custkey")
    ).select("c_custkey", "is_primary")


# Customers and their orders against what the line items and one half of the nations say.


def resynced(spark, sf):
    customers = table(spark, sf, "customer")
    parents = customers.selectExpr("c_custkey AS id", "c_name AS label", "c_acctbal AS amount")
    seen = customers.filter("c_nationkey < 15").selectExpr(
        "c_custkey AS id", "c_name AS label", "CASE WHEN c_nationkey < 5 THEN 0D ELSE c_acctbal END AS amount")
    lines = table(spark, sf, "lineitem").filter("l_returnflag = 'A'").groupBy("l_orderkey").agg(
        F.max("l_extendedprice").alias("amount"))
    owners = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    seen_children = lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "o_orderkey AS id", "o_custkey AS parent", "amount", "'seen' AS note")
    return mirror.resync(parents, children(spark, sf), seen, seen_children, "id", ["id"], "parent",
                         keep=["note"])


@query("resync_parents", """
SELECT c_custkey AS id, c_name AS label, CASE WHEN c_nationkey < 5 THEN 0 ELSE c_acctbal END AS amount,
  CASE WHEN c_nationkey >= 15 THEN 'deleted' WHEN c_nationkey < 5 AND c_acctbal <> 0 THEN 'updated'
    ELSE 'unchanged' END AS action FROM customer""")
def resync_parents(spark, sf):
    return resynced(spark, sf)[0]


@query("resync_children", """
SELECT o_orderkey AS id, o_custkey AS parent, amount, o_orderpriority AS note
FROM (SELECT l_orderkey, max(l_extendedprice) AS amount FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < 15""")
def resync_children(spark, sf):
    return resynced(spark, sf)[1]


@query("resync_removed", "SELECT count(*) AS removed FROM customer WHERE c_nationkey >= 15")
def resync_removed(spark, sf):
    return resynced(spark, sf)[2]
