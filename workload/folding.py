"""Folds and single statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import statements as st
from tidemark.operators.fold import fold
from tidemark.operators.mirror import newest_per_key
from tidemark.plans.project import applied_ids
from workload import feeds
from workload.feeds import table
from workload.registry import query


@query("fold_hard", feeds.fold_sql(feeds.USER_CHANGES_SQL, "user_id", ["value", "props"]))
def fold_hard(spark, sf):
    return fold(feeds.user_changes(spark, sf), feeds.USER_SPEC)


@query("fold_soft", feeds.fold_sql(feeds.USER_CHANGES_SQL, "user_id", ["value", "props"], True))
def fold_soft(spark, sf):
    return fold(feeds.user_changes(spark, sf), feeds.USER_SOFT)


ORDER_COLUMNS = ["price", "priority", "quantity", "status"]


@query("fold_orders", feeds.fold_sql(feeds.ORDER_CHANGES_SQL, "orderkey", ORDER_COLUMNS))
def fold_orders(spark, sf):
    return fold(feeds.order_changes(spark, sf), feeds.ORDER_SPEC)


@query("fold_orders_soft",
       feeds.fold_sql(feeds.ORDER_CHANGES_SQL, "orderkey", ORDER_COLUMNS, True))
def fold_orders_soft(spark, sf):
    return fold(feeds.order_changes(spark, sf), feeds.ORDER_SOFT)


SNAPSHOT_SQL = "SELECT c_custkey AS k, c_acctbal AS value, c_mktsegment AS props, {} AS old_flag FROM customer"


def customer_state(spark, sf):
    return table(spark, sf, "customer").selectExpr(
        "c_custkey AS user_id", "c_acctbal AS value", "c_mktsegment AS props",
        "c_acctbal < 0 AS is_deleted",
    )


@query("fold_with_snapshot", feeds.fold_sql(
    feeds.USER_CHANGES_SQL, "user_id", ["value", "props"],
    state=SNAPSHOT_SQL.format("CAST(NULL AS BOOLEAN)")))
def fold_with_snapshot(spark, sf):
    state = customer_state(spark, sf).drop("is_deleted")
    return fold(feeds.user_changes(spark, sf), feeds.USER_SPEC, state)


@query("fold_with_snapshot_soft", feeds.fold_sql(
    feeds.USER_CHANGES_SQL, "user_id", ["value", "props"], True,
    SNAPSHOT_SQL.format("c_acctbal < 0")))
def fold_with_snapshot_soft(spark, sf):
    return fold(feeds.user_changes(spark, sf), feeds.USER_SOFT, customer_state(spark, sf))


# One key in three holds every third event: the hot key is one row per task in the shuffle.
HOT_SQL = feeds.USER_CHANGES_SQL.replace(
    "user_id AS k", "CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS k")


@query("fold_hot_key", feeds.fold_sql(HOT_SQL, "user_id", ["value", "props"]))
def fold_hot_key(spark, sf):
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(-1)).otherwise(F.col("user_id"))
    changes = feeds.user_changes(spark, sf).withColumn("user_id", hot.cast("bigint"))
    return fold(changes, feeds.USER_SPEC)


# Single statements against the customers.


def clicked(spark, sf):
    events = table(spark, sf, "events").filter("event_type = 'click'")
    newest = newest_per_key(
        events.selectExpr("user_id AS c_custkey", "ts", "event_id", "value"), ["c_custkey"],
        F.struct("ts", "event_id"),
    )
    return newest.select("c_custkey", "value")


def erring(spark, sf):
    return table(spark, sf, "events").filter("event_type = 'error' AND value > 20").select(
        F.col("user_id").alias("c_custkey")
    )


ERRING = "(SELECT user_id FROM events WHERE event_type = 'error' AND value > 20)"


@query("update_columns", """
SELECT c_custkey, c_name, CASE WHEN user_id IS NULL THEN c_acctbal ELSE value END AS c_acctbal
FROM customer LEFT JOIN (
  SELECT user_id, arg_max(value, event_id) AS value FROM (
    SELECT * FROM events WHERE event_type = 'click'
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
  GROUP BY user_id) ON c_custkey = user_id""")
def update_columns(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return st.update_columns(customer, clicked(spark, sf), "c_custkey", {"c_acctbal": F.col("value")})


@query("insert_rows", """
SELECT c_custkey, c_name FROM customer
UNION ALL
SELECT DISTINCT user_id * 11, 'user' || user_id FROM events
WHERE user_id * 11 NOT IN (SELECT c_custkey FROM customer)""")
def insert_rows(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "user_id * 11 AS c_custkey", "'user' || user_id AS c_name").distinct()
    return st.insert_rows(table(spark, sf, "customer").select("c_custkey", "c_name"), rows, "c_custkey")


@query("refused_rows", """
SELECT DISTINCT user_id * 11 AS c_custkey, 'user' || user_id AS c_name FROM events
WHERE user_id * 11 IN (SELECT c_custkey FROM customer)""")
def refused_rows(spark, sf):
    rows = table(spark, sf, "events").selectExpr(
        "user_id * 11 AS c_custkey", "'user' || user_id AS c_name").distinct()
    return st.refused_rows(table(spark, sf, "customer"), rows, "c_custkey")


@query("delete_hard", f"""
SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN {ERRING}""")
def delete_hard(spark, sf):
    customer = table(spark, sf, "customer").select("c_custkey", "c_name")
    return st.delete_rows(customer, erring(spark, sf), "c_custkey")


@query("delete_soft", f"""
SELECT c_custkey, CASE WHEN c_custkey IN {ERRING} THEN true ELSE c_acctbal < 0 END AS is_deleted
FROM customer""")
def delete_soft(spark, sf):
    customer = table(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal < 0 AS is_deleted")
    return st.set_flag(customer, erring(spark, sf), "c_custkey", "is_deleted", True)


@query("undelete", f"""
SELECT c_custkey, CASE WHEN c_custkey IN {ERRING} THEN false ELSE c_acctbal < 0 END AS is_deleted
FROM customer""")
def undelete(spark, sf):
    customer = table(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal < 0 AS is_deleted")
    return st.set_flag(customer, erring(spark, sf), "c_custkey", "is_deleted", False)


@query("flag_as_int", f"""
SELECT c_custkey, CASE WHEN c_custkey IN {ERRING} THEN 1 ELSE c_nationkey * 0 END AS is_deleted
FROM customer""")
def flag_as_int(spark, sf):
    customer = table(spark, sf, "customer").selectExpr("c_custkey", "c_nationkey * 0 AS is_deleted")
    return st.set_flag(customer, erring(spark, sf), "c_custkey", "is_deleted", True, "Integer")


@query("affected_rows", f"""
SELECT count(*) AS affected FROM customer WHERE c_custkey IN {ERRING}""")
def affected_rows(spark, sf):
    return st.affected(table(spark, sf, "customer"), erring(spark, sf), "c_custkey")


def with_ids(spark, sf):
    kind = F.expr(feeds.USER_KIND)
    ids = F.array("user_id", F.col("event_id") % 97, "user_id")
    return table(spark, sf, "events").select("event_id", kind.alias("kind"), ids.alias("ids"))


@query("create_first_id", """
SELECT event_id, user_id AS id FROM events WHERE event_type = 'signup'""")
def create_first_id(spark, sf):
    rows = with_ids(spark, sf).filter("kind = 'CREATE'")
    return rows.select("event_id", F.explode(applied_ids(F.col("ids"), F.col("kind"))).alias("id"))


@query("fanout_ids", """
SELECT event_id, user_id AS id FROM events
UNION
SELECT event_id, event_id % 97 FROM events WHERE event_type <> 'signup'""")
def fanout_ids(spark, sf):
    rows = with_ids(spark, sf)
    return rows.select("event_id", F.explode(applied_ids(F.col("ids"), F.col("kind"))).alias("id"))


# The folded table is fed back as the snapshot of the next part of the feed.


@query("fold_in_two_parts", feeds.fold_sql(feeds.USER_CHANGES_SQL, "user_id", ["value", "props"]))
def fold_in_two_parts(spark, sf):
    changes = feeds.user_changes(spark, sf)
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz")
    state = fold(changes.filter(early), feeds.USER_SPEC, track=True)
    # The second part repeats some of the first; what the state has seen is ignored.
    later = changes.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz"))
    return fold(later, feeds.USER_SPEC, state)
