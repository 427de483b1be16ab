"""What became of change rows at their table: applied, refused, no row or late.

Whether a change finds its row depends on the last CREATE or DELETE of its key before it.
That is an as-of question, asked without a window over all changes of a key: rows are dealt
out by ranges of key and order, so that a key with a third of all rows fills many ranges.
Each range tells for its keys the last CREATE or DELETE in it; the last one of the ranges
before, a maximum over one row per range, is what a range begins with; and only inside a
range do rows look back at rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators.fold import LAST_ORDER, LIVE, FoldSpec
from tidemark.operators.ranges import PLACE, dealt, part
from tidemark.plans import routing
from tidemark.sizing import SMALL_ROWS, is_small


def keyed(spec: FoldSpec) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in spec.key])


def placed(rows: DataFrame, order: list[str], spec: FoldSpec, small: int) -> DataFrame:
    """``rows`` with ``_part`` and ``_at``: their range, and a number that grows with the order of a
    key. Rows too few to overfill a task, as those of a micro-batch, are one range.
    """
    if is_small(rows, small):
        by_key = Window.partitionBy(*spec.key).orderBy(*order)
        return rows.withColumns({PLACE: F.row_number().over(by_key).cast("long"), "_part": F.lit(0).cast("long")})
    return dealt(rows, [*spec.key, *order], "judged").withColumn("_part", part())


def judged(
    changes: DataFrame,
    spec: FoldSpec,
    snapshot: DataFrame | None = None,
    keep: tuple[str, ...] = (),
    small: int = SMALL_ROWS,
) -> DataFrame:
    """Key, order and type of all change rows, the columns ``keep`` and their ``outcome``.

    ``snapshot`` holds the rows there were before, one per key; one of a tracked fold also says
    which keys are gone and up to which order it has seen each: changes up to that are `late`.
    A CREATE of a row that is there is `refused`, any other change of one that is not finds
    `no row`. A row without a key or an order has an outcome of its own and no influence.
    Orders are taken to differ within a key; rows that share one are taken by type and ``keep``.
    """
    names = list(dict.fromkeys([*spec.key, *spec.order, spec.kind, *keep]))
    rows = changes.select(*names, spec.order_value().alias("_ord"))
    usable = keyed(spec) & F.col("_ord").isNotNull()
    others = rows.filter(~usable).select(*names, F.when(keyed(spec), routing.NO_ORDER).otherwise(
        routing.NO_KEY).alias("outcome"))
    rows = placed(rows.filter(usable), ["_ord", spec.kind, *keep], spec, small)

    kind = F.col(spec.kind)
    alive = kind == "CREATE"
    turns = kind == "CREATE" if spec.soft else kind.isin("CREATE", "DELETE")
    # What each range knows of a key: its last change of life, in the order of the key.
    ends = rows.groupBy("_part", *spec.key).agg(
        F.max(F.when(turns, F.struct(PLACE, "_ord", alive.alias("alive")))).alias("_last"))
    earlier = Window.partitionBy(*spec.key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ends.select("_part", *spec.key, F.max("_last").over(earlier).alias("_before"))
    was_live, seen = F.lit(False), F.lit(None)
    if snapshot is not None:
        tracked = LAST_ORDER in snapshot.columns
        state = snapshot.select(
            *spec.key, (F.col(LIVE) if LIVE in snapshot.columns else F.lit(True)).alias("_was_live"),
            *([F.col(LAST_ORDER).alias("_seen")] if tracked else []))
        starts = starts.join(state, list(spec.key), "left")
        was_live = F.coalesce("_was_live", F.lit(False))
        seen = F.col("_seen") if tracked else seen
    # Late changes are the first of their key, so if the last one before is late all are.
    known = seen.isNull() | (F.col("_before._ord") > seen)
    starts = starts.select(
        "_part", *spec.key, F.coalesce(F.when(known, F.col("_before.alive")), was_live).alias("_there"),
        *([seen.alias("_seen")] if snapshot is not None and LAST_ORDER in snapshot.columns else []))

    met = rows.join(starts, ["_part", *spec.key])
    late = F.coalesce(F.col("_ord") <= F.col("_seen"), F.lit(False)) if "_seen" in met.columns else F.lit(False)
    back = Window.partitionBy("_part", *spec.key).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, -1)
    there = F.coalesce(F.last(F.when(turns & ~late, alive), ignorenulls=True).over(back), F.col("_there"))
    found = F.when(there, routing.APPLIED).otherwise(routing.NO_ROW)
    outcome = (
        F.when(kind.isNull() | ~kind.isin(fixed.APPLIED_KINDS), routing.UNKNOWN_KIND)
        .when(late, routing.LATE)
        .when(kind == "CREATE", F.when(there, routing.REFUSED).otherwise(routing.APPLIED))
        .when((kind == "UNDELETE") & F.lit(not spec.soft), routing.UNDELETE_SKIPPED)
        .otherwise(found)
    )
    return met.select(*names, outcome.alias("outcome")).unionByName(others)


def per_event(rows: DataFrame, event: list[str]) -> DataFrame:
    """One row per event of judged change rows: how many rows of the table it touched, and its
    outcome. An event that touched a row is applied, whatever its other ids met.
    """
    def count(outcome: str) -> Column:
        return F.count_if(F.col("outcome") == outcome)

    counted = rows.groupBy(*event).agg(
        F.count("*").alias("ids"), count(routing.APPLIED).alias("affected"), count(routing.REFUSED).alias("refused"),
        count(routing.LATE).alias("late"), count(routing.NO_ROW).alias("no_row"), F.min("outcome").alias("_else"))
    outcome = (
        F.when(F.col("affected") > 0, routing.APPLIED).when(F.col("refused") > 0, routing.REFUSED)
        .when(F.col("late") > 0, routing.LATE).when(F.col("no_row") > 0, routing.NO_ROW).otherwise(F.col("_else"))
    )
    return counted.withColumn("outcome", outcome).drop("_else")
