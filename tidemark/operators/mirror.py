"""Keep keyed tables equal to what an upstream system holds.

Incoming rows are one per key unless ``newest_by`` says how to choose. All joins
are on the key, and both sides have one row per key, so no key is hot.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged


def newest_per_key(rows: DataFrame, key: Sequence[str], newest_by: Column) -> DataFrame:
    """The row with the greatest ``newest_by`` for each key, by a mergeable maximum."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max_by(F.struct(*rest), newest_by).alias("_row")
    return rows.groupBy(*key).agg(best).select(*key, "_row.*").select(*rows.columns)


def first_per_key(rows: DataFrame, key: Sequence[str], first_by: Column) -> DataFrame:
    """The row with the least ``first_by`` for each key."""
    rest = [c for c in rows.columns if c not in key]
    best = F.min_by(F.struct(*rest), first_by).alias("_row")
    return rows.groupBy(*key).agg(best).select(*key, "_row.*").select(*rows.columns)


def _side_by_side(table: DataFrame, incoming: DataFrame, key: Sequence[str]) -> DataFrame:
    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*key, F.struct(*df.columns).alias(name))

    return side(table, "old").join(side(incoming, "new"), list(key), "full")


def upsert(
    table: DataFrame,
    incoming: DataFrame,
    key: Sequence[str],
    keep: Sequence[str] = (),
    stamps: dict[str, Column] | None = None,
) -> DataFrame:
    """Insert new rows; on rows already there overwrite what ``incoming`` lists.

    Columns named in ``keep`` are written on insert only. Columns ``incoming``
    does not have keep their value. ``stamps`` are written on every incoming row.
    """
    both = _side_by_side(table, incoming, key)
    return _merged(both, table.columns, incoming.columns, key, keep, stamps or {})


def _merged(
    both: DataFrame,
    columns: Sequence[str],
    given: Sequence[str],
    key: Sequence[str],
    keep: Sequence[str],
    stamps: dict[str, Column],
    *extra: Column,
) -> DataFrame:
    seen, known = F.col("new").isNotNull(), F.col("old").isNotNull()

    def value(c: str) -> Column:
        if c in key:
            return F.col(c)
        old = F.col(f"old.{c}")
        if c in stamps:
            return F.when(seen, stamps[c]).otherwise(old)
        if c not in given:
            return old
        overwrite = seen & ~known if c in keep else seen
        return F.when(overwrite, F.col(f"new.{c}")).otherwise(old)

    return both.select(*[value(c).alias(c) for c in columns], *extra)


def keep_only(table: DataFrame, ids: DataFrame, key: Sequence[str]) -> DataFrame:
    """Delete the rows whose key is not among ``ids``; no ids deletes all."""
    return table.join(ids.select(*key), list(key), "left_semi")


def snapshot_diff(
    table: DataFrame, incoming: DataFrame, key: Sequence[str], compare: Sequence[str] | None = None
) -> DataFrame:
    """``key, action``: inserted, updated, unchanged or deleted."""
    compared = [c for c in (compare or incoming.columns) if c not in key]
    return _side_by_side(table, incoming, key).select(*key, _action(compared).alias("action"))


def _action(compared: Sequence[str]) -> Column:
    same = [F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in compared]
    return (
        F.when(F.col("old").isNull(), "inserted")
        .when(F.col("new").isNull(), "deleted")
        .when(reduce(lambda a, b: a & b, same, F.lit(True)), "unchanged")
        .otherwise("updated")
    )


def reconcile(
    table: DataFrame,
    incoming: DataFrame,
    key: Sequence[str],
    keep: Sequence[str] = (),
    stamps: dict[str, Column] | None = None,
) -> DataFrame:
    """The table after a full snapshot, plus ``action`` for every row old or new.

    Rows with action ``deleted`` are those to drop; ``reconciled`` drops them.
    """
    both = _side_by_side(table, incoming, key)
    compared = [c for c in incoming.columns if c in table.columns and c not in {*key, *keep}]
    action = _action(compared).alias("action")
    return _merged(both, table.columns, incoming.columns, key, keep, stamps or {}, action)


def reconciled(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("action") != "deleted").drop("action")


def removed_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("action") == "deleted").alias("removed"))


def replace_children(
    children: DataFrame,
    incoming: DataFrame,
    parents: DataFrame,
    key: Sequence[str],
    parent: str,
    keep: Sequence[str] = (),
    stamps: dict[str, Column] | None = None,
) -> DataFrame:
    """Make the children of ``parents`` exactly the incoming ones.

    A parent without incoming children loses all of its own. A child that moves
    here from a parent outside the list is taken over, as its key is unique.
    """
    touched = parents.select(F.col(parent).alias("_parent")).distinct()
    both = _side_by_side(children, incoming, key).join(
        touched, F.col(f"old.{parent}") == F.col("_parent"), "left"
    )
    stays = both.filter(F.col("new").isNotNull() | F.col("_parent").isNull())
    return _merged(stays, children.columns, incoming.columns, key, keep, stamps or {})


def replace_owned(
    rows: DataFrame, incoming: DataFrame, owners: DataFrame, owner: str
) -> DataFrame:
    """All rows of ``owners`` are replaced by ``incoming``, none merged."""
    others = rows.join(owners.select(owner), owner, "left_anti")
    return others.unionByName(incoming.join(owners.select(owner), owner, "left_semi"))


def cascade_children(children: DataFrame, deleted: DataFrame, owner: str, key: str) -> DataFrame:
    """Children whose owner was deleted go with it; ownerless ones stay."""
    gone = deleted.select(F.col(key).alias(owner))
    return children.join(gone, owner, "left_anti").select(*children.columns)


def unlink(rows: DataFrame, deleted: DataFrame, link: str, key: str) -> DataFrame:
    """Optional links to deleted rows become NULL."""
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    joined = rows.join(gone, rows[link] == gone["_gone"], "left")
    return joined.select(*[
        F.when(F.col("_gone").isNull(), rows[c]).alias(c) if c == link else rows[c]
        for c in rows.columns
    ])


def orphans(children: DataFrame, parents: DataFrame, owner: str, key: str) -> DataFrame:
    """Children that name an owner which does not exist."""
    owned = children.filter(F.col(owner).isNotNull())
    return owned.join(parents.select(F.col(key).alias(owner)), owner, "left_anti").select(
        *children.columns
    )


def set_exclusive_flag(rows: DataFrame, flag: str, chosen: Column) -> DataFrame:
    """Set the flag on the chosen row and clear it on all others."""
    return rows.withColumn(flag, F.coalesce(chosen, F.lit(False)))


def set_exclusive_flag_per_group(
    rows: DataFrame, group: str, key: str, flag: str, first_by: Column
) -> DataFrame:
    """In every group set the flag on the row with the least ``first_by``."""
    best = rows.groupBy(group).agg(F.min_by(F.col(key), first_by).alias("_best"))
    joined = rows.join(best, group)
    return joined.withColumn(flag, F.col(key) == F.col("_best")).drop("_best").select(
        *dict.fromkeys([*rows.columns, flag])
    )


def resync(
    parents: DataFrame,
    children: DataFrame,
    seen_parents: DataFrame,
    seen_children: DataFrame,
    key: str,
    child_key: Sequence[str],
    parent: str,
    keep: Sequence[str] = (),
    stamps: dict[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Make parents and their children equal to a full upstream snapshot.

    Returns the parents with their ``action`` (see ``reconcile``), the children
    and the number of parents removed. Children of a removed parent go with it.
    """
    # One full join of the parents; its three outputs and the children read what it wrote.
    rows = staged(reconcile(parents, seen_parents, [key], keep, stamps), "resync")
    known = rows.select(F.col(key).alias("_owner"), F.col("action").alias("_action"))
    both = _side_by_side(children, seen_children, child_key)
    incoming = F.col("new").isNotNull()
    owner = F.when(incoming, F.col(f"new.{parent}")).otherwise(F.col(f"old.{parent}"))
    placed = both.withColumn("_to", owner).join(known, F.col("_to") == F.col("_owner"), "left")
    # Every parent is either in the snapshot or removed, so all of them have their children
    # replaced: an incoming child stays unless its parent goes, another one if it has none.
    stays = F.when(incoming, F.coalesce(F.col("_action") != "deleted", F.lit(True))).otherwise(F.col("_owner").isNull())
    owned = _merged(placed.filter(stays), children.columns, seen_children.columns, child_key, keep, stamps or {})
    return rows, owned, removed_count(rows)
