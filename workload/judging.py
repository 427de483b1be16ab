"""What became of changes at their table, and orders that stay visible."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.fold import fold
from tidemark.operators.judge import judged, per_event
from tidemark.operators.ranges import ranked
from tidemark.plans import project as p
from tidemark.session import staged
from workload import feeds, payloads
from workload.feeds import table
from workload.registry import query

FIRST_DAYS = "TIMESTAMP '2024-01-10'"


def judged_sql(soft: bool = False, seen: str | None = None) -> str:
    """Outcomes by windows over keys. ``seen`` is a condition on the changes a snapshot has seen."""
    turns = "('CREATE')" if soft else "('CREATE', 'DELETE')"
    late = "FALSE"
    if seen:
        late = f"coalesce((ts, event_id) <= max(CASE WHEN {seen} THEN (ts, event_id) END) OVER (PARTITION BY k), FALSE)"
    undelete = "" if soft else "WHEN kind = 'UNDELETE' THEN 'undelete skipped'"
    return f"""WITH changes AS (
  SELECT event_id, ts, user_id AS k, {feeds.USER_KIND} AS kind FROM events WHERE user_id IS NOT NULL),
j AS (
  SELECT *, {late} AS late, coalesce(arg_max(kind = 'CREATE', (ts, event_id))
      FILTER (WHERE kind IN {turns}) OVER (PARTITION BY k ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS there FROM changes)
SELECT event_id, k AS user_id, kind AS change_type,
  CASE WHEN kind IS NULL THEN 'unknown type' WHEN late THEN 'late'
    WHEN kind = 'CREATE' THEN CASE WHEN there THEN 'refused' ELSE 'applied' END {undelete}
    WHEN there THEN 'applied' ELSE 'no row' END AS outcome FROM j"""


def columns(rows):
    return rows.select("event_id", "user_id", "change_type", "outcome")


@query("change_outcomes", judged_sql())
def change_outcomes(spark, sf):
    # Dealt out by ranges whatever the size, as a feed too large for one task is.
    return columns(judged(feeds.user_changes(spark, sf), feeds.USER_SPEC, small=0))


@query("change_outcomes_batch", judged_sql())
def change_outcomes_batch(spark, sf):
    return columns(judged(feeds.user_changes(spark, sf), feeds.USER_SPEC))


@query("change_outcomes_soft", judged_sql(soft=True))
def change_outcomes_soft(spark, sf):
    return columns(judged(feeds.user_changes(spark, sf), feeds.USER_SOFT, small=0))


def tracked(spark, sf, spec):
    """All changes, judged on the table that those of the first days have left."""
    changes = feeds.user_changes(spark, sf)
    state = fold(changes.filter(f"ts < {FIRST_DAYS}"), spec, track=True)
    return columns(judged(changes, spec, staged(state, "state"), small=0))


@query("change_outcomes_late", judged_sql(seen=f"ts < {FIRST_DAYS}"))
def change_outcomes_late(spark, sf):
    return tracked(spark, sf, feeds.USER_SPEC)


EVENT_SQL = f"""WITH {payloads.CHANGES_SQL},
j AS (
  SELECT ord, kind, coalesce(arg_max(kind = 'CREATE', ord) FILTER (WHERE kind IN ('CREATE', 'DELETE'))
    OVER (PARTITION BY k ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS there
  FROM changes)
SELECT 'e' || ord AS event_id, count(*) AS ids, count(*) FILTER (WHERE there <> (kind = 'CREATE')) AS affected,
  CASE WHEN count(*) FILTER (WHERE there <> (kind = 'CREATE')) > 0 THEN 'applied'
    WHEN max(kind) = 'CREATE' THEN 'refused' ELSE 'no row' END AS outcome
FROM j GROUP BY ord"""


@query("event_outcomes_at_table", EVENT_SQL)
def event_outcomes_at_table(spark, sf):
    rows, chosen = payloads.projected(spark, sf)
    changes = staged(p.change_rows(rows, chosen, keep=("event_id",)), "changes")
    seen = judged(changes, chosen.fold_spec(), keep=("event_id",), small=0)
    return per_event(seen, ["event_id"]).select("event_id", "ids", "affected", "outcome")


@query("affected_by_kind", f"""{EVENT_SQL.replace("SELECT 'e' || ord AS event_id,", "SELECT kind AS change_type, ord,")
.replace("FROM j GROUP BY ord", "FROM j GROUP BY ord, kind").replace("SELECT kind AS change_type, ord,",
"SELECT change_type, outcome, count(*) AS events, sum(affected)::BIGINT AS affected FROM (SELECT kind AS change_type, ord,", 1)})
GROUP BY 1, 2""")
def affected_by_kind(spark, sf):
    rows, chosen = payloads.projected(spark, sf)
    changes = staged(p.change_rows(rows, chosen, keep=("event_id",)), "changes")
    seen = judged(changes, chosen.fold_spec(), keep=("event_id",), small=0)
    events = per_event(seen, ["event_id", p.KIND])
    return events.groupBy(F.col(p.KIND).alias("change_type"), "outcome").agg(
        F.count("*").alias("events"), F.sum("affected").alias("affected"))


@query("registry_ranked", f"""WITH {feeds.REGISTRY_SQL}
SELECT id, schema_id, row_number() OVER (ORDER BY date_created DESC, id DESC) AS place FROM registry""")
def registry_ranked(spark, sf):
    rows = feeds.registry(spark, sf)
    return ranked(rows, [F.desc("date_created"), F.desc("id")], "place").select("id", "schema_id", "place")


@query("lineitems_ranked", """
SELECT l_orderkey, l_linenumber, row_number() OVER (
  ORDER BY l_shipdate NULLS FIRST, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS place FROM lineitem""")
def lineitems_ranked(spark, sf):
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    rows = table(spark, sf, "lineitem").select(*order)
    return ranked(rows, order, "place").select("l_orderkey", "l_linenumber", "place")
