import random

import pytest
from pyspark.sql import functions as F

from simulate import run
from tidemark.operators.fold import FoldSpec, fold

COLUMNS = ["name", "amount"]
SCHEMA = (
    "key bigint, replay_id bigint, change_type string, "
    "name string, amount double, name__set boolean, amount__set boolean"
)


def random_changes(seed, count=400, keys=25, hot=0.34):
    rng = random.Random(seed)
    orders = rng.sample(range(count * 10), count)
    changes = []
    for order in orders:
        kind = rng.choice(["CREATE", "UPDATE", "UPDATE", "UPDATE", "DELETE", "UNDELETE"])
        values = {}
        if kind in ("CREATE", "UPDATE"):
            for column, value in (("name", f"n{order}"), ("amount", float(order))):
                if rng.random() < 0.6:
                    null = kind == "UPDATE" and rng.random() < 0.3
                    values[column] = None if null else value
        key = 0 if rng.random() < hot else rng.randrange(keys)
        changes.append({"key": key, "replay_id": order, "change_type": kind, "values": values})
    return changes


def frame(spark, changes):
    rows = [
        (
            c["key"], c["replay_id"], c["change_type"],
            c["values"].get("name"), c["values"].get("amount"),
            "name" in c["values"], "amount" in c["values"],
        )
        for c in changes
    ]
    return spark.createDataFrame(rows, SCHEMA)


def spec(soft, spread=4):
    return FoldSpec(
        key=("key",), columns=tuple(COLUMNS), flag="is_deleted" if soft else None, spread=spread
    )


def as_table(df):
    out = {}
    for row in df.collect():
        values = row.asDict()
        assert values["key"] not in out
        out[values.pop("key")] = values
    return out


@pytest.mark.parametrize("soft", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_matches_one_by_one_application(spark, soft, seed):
    changes = random_changes(seed)
    got = as_table(fold(frame(spark, changes), spec(soft)))
    assert got == run(changes, COLUMNS, soft)


@pytest.mark.parametrize("soft", [False, True])
@pytest.mark.parametrize("seed", [4, 5])
def test_folding_in_parts_equals_folding_once(spark, soft, seed):
    changes = sorted(random_changes(seed), key=lambda c: c["replay_id"])
    cuts = sorted(random.Random(seed).sample(range(len(changes)), 3))
    state = None
    for lo, hi in zip([0, *cuts], [*cuts, len(changes)]):
        folded = fold(frame(spark, changes[lo:hi]), spec(soft), state, track=True)
        state = spark.createDataFrame(folded.collect(), folded.schema)
        # the same part delivered again changes nothing
        again = fold(frame(spark, changes[lo:hi]), spec(soft), state, track=True)
        assert sorted(map(str, again.collect())) == sorted(map(str, state.collect()))
    live = state.filter("live").drop("live", "last_order")
    assert as_table(live) == run(changes, COLUMNS, soft)


def test_plain_snapshot_counts_as_rows_created_earlier(spark):
    changes = random_changes(6)
    state = {k: {"name": f"old{k}", "amount": None} for k in range(0, 30, 2)}
    rows = [(k, v["name"], v["amount"]) for k, v in state.items()]
    snapshot = spark.createDataFrame(rows, "key bigint, name string, amount double")
    got = as_table(fold(frame(spark, changes), spec(False), snapshot))
    assert got == run(changes, COLUMNS, False, state)


def test_delivered_twice_in_one_batch(spark):
    changes = random_changes(7)
    once = as_table(fold(frame(spark, changes), spec(False)))
    assert as_table(fold(frame(spark, changes + changes), spec(False))) == once


def test_created_row_takes_defaults_until_written(spark):
    changes = [
        {"key": 1, "replay_id": 1, "change_type": "CREATE", "values": {"name": "a"}},
        {"key": 2, "replay_id": 2, "change_type": "CREATE", "values": {"name": "b"}},
        {"key": 2, "replay_id": 3, "change_type": "UPDATE", "values": {"amount": None}},
    ]
    with_default = FoldSpec(
        key=("key",), columns=tuple(COLUMNS), flag="is_deleted",
        defaults={"amount": F.lit(5.0), "is_deleted": F.lit(False)},
    )
    assert as_table(fold(frame(spark, changes), with_default)) == {
        1: {"name": "a", "amount": 5.0, "is_deleted": False},
        2: {"name": "b", "amount": None, "is_deleted": False},
    }


def test_field_mapped_to_the_flag_column(spark):
    """Marks and written values meet in one column; the later of them holds."""
    def change(key, order, kind, value="unset"):
        return (key, order, kind, None if value == "unset" else value, value != "unset")

    rows = spark.createDataFrame([
        change(1, 1, "CREATE", False), change(1, 2, "DELETE"), change(1, 3, "UPDATE", False),
        change(2, 1, "CREATE", True), change(2, 2, "UNDELETE"),
        change(3, 1, "CREATE", False), change(3, 2, "UPDATE", None), change(3, 3, "DELETE"),
        change(4, 1, "DELETE"), change(4, 2, "CREATE", False),
    ], "key int, replay_id int, change_type string, gone boolean, gone__set boolean")
    both = FoldSpec(key=("key",), columns=("gone",), flag="gone")
    want = {1: {"gone": False}, 2: {"gone": False}, 3: {"gone": True}, 4: {"gone": False}}
    assert as_table(fold(rows, both)) == want
    early = fold(rows.filter("replay_id < 2"), both, track=True)
    later = fold(rows.filter("replay_id >= 2"), both, early)
    assert as_table(later) == want


def test_composite_order_and_key(spark):
    changes = random_changes(8)
    rows = frame(spark, changes).selectExpr(
        "key", "key % 2 AS part", "replay_id div 7 AS major", "replay_id % 7 AS minor",
        "change_type", *COLUMNS, *[c + "__set" for c in COLUMNS],
    )
    wide = FoldSpec(key=("part", "key"), columns=tuple(COLUMNS), order=("major", "minor"))
    got = as_table(fold(rows, wide).drop("part"))
    assert got == run(changes, COLUMNS)


def test_rows_of_a_key_are_reduced_before_they_are_shuffled(spark):
    """Whatever is shuffled by key alone is partially aggregated, already one row
    per key, or spread over salts; nothing sorts or collects the rows of a key.
    """
    snapshot = spark.createDataFrame([(1, "a", None)], "key bigint, name string, amount double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = fold(frame(spark, random_changes(9)), spec(False), snapshot)
        lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    text = "\n".join(lines)
    for word in ("Window", "collect_", "CartesianProduct", "BroadcastNestedLoop"):
        assert word not in text
    shuffles = [(line, lines[i + 1]) for i, line in enumerate(lines) if "Exchange hash" in line]
    assert len(shuffles) == 6
    for shuffle, below in shuffles:
        salted = "_salt" in shuffle
        reduced = "partial_" in below
        of_snapshot = "_old0" in below
        assert salted or reduced or of_snapshot, (shuffle, below)


def test_a_hot_key_reaches_its_task_as_one_row_per_map_task(spark):
    kinds = ["CREATE", "UPDATE", "UPDATE", "DELETE"] * 500
    hot = [{"key": 0, "replay_id": 10_000 + i, "change_type": k,
            "values": {"name": str(i)} if k != "DELETE" else {}} for i, k in enumerate(kinds)]
    rows = frame(spark, hot + random_changes(10, 200)).repartition(6)
    df = fold(rows, spec(False))
    got = as_table(df)
    assert got == run(hot + random_changes(10, 200), COLUMNS)
    node = df._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in node
