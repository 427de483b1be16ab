import random

import pytest
from pyspark.sql import functions as F

from test_fold import frame, random_changes, spec
from tidemark.operators import judge
from tidemark.operators.fold import fold
from tidemark.operators.ranges import PLACE, dealt, part, ranked
from tidemark.plans import routing


def outcomes(rows, soft, seen=None, live=()):
    """One change after another; ``rows`` are (key, order, kind)."""
    there, out = set(live), {}
    for key, order, kind in sorted(rows, key=lambda r: r[1]):
        if kind not in ("CREATE", "UPDATE", "DELETE", "UNDELETE"):
            said = "unknown type"
        elif seen and key in seen and order <= seen[key]:
            said = "late"
        elif kind == "CREATE":
            said = "refused" if key in there else "applied"
            there.add(key)
        elif kind == "UNDELETE" and not soft:
            said = "undelete skipped"
        else:
            said = "applied" if key in there else "no row"
            if kind == "DELETE" and not soft:
                there.discard(key)
        out[key, order] = said
    return out


def plain(changes):
    return [(c["key"], c["replay_id"], c["change_type"]) for c in changes]


def judged(rows, chosen, snapshot=None, **options):
    got = judge.judged(rows, chosen, snapshot, **options).collect()
    return {(r["key"], r["replay_id"]): r["outcome"] for r in got}


@pytest.mark.parametrize("soft", [False, True])
@pytest.mark.parametrize("small", [0, 1_000])
def test_outcomes_of_changes_one_after_another(spark, soft, small):
    changes = random_changes(31, 300)
    got = judged(frame(spark, changes).repartition(5), spec(soft), small=small)
    assert got == outcomes(plain(changes), soft)
    assert len(set(got.values())) >= 3


@pytest.mark.parametrize("soft", [False, True])
def test_changes_up_to_what_the_table_has_seen_are_late(spark, soft):
    changes = random_changes(32, 300)
    early = [c for i, c in enumerate(changes) if i % 3]
    state = fold(frame(spark, early), spec(soft), track=True).cache()
    table = {r["key"]: r for r in state.collect()}
    seen = {k: r["last_order"] for k, r in table.items()}
    got = judged(frame(spark, changes), spec(soft), state, small=0)
    assert got == outcomes(plain(changes), soft, seen, [k for k, r in table.items() if r["live"]])
    assert "late" in got.values()


def test_a_plain_snapshot_says_which_rows_there_are(spark):
    rows = spark.createDataFrame([(1, 1, "CREATE"), (1, 2, "UPDATE"), (2, 3, "UPDATE")], "key int, replay_id int, change_type string")
    rows = rows.withColumns({c: F.lit(1) for c in ("a", "b")}).withColumns({c + "__set": F.lit(True) for c in ("a", "b")})
    state = spark.createDataFrame([(1, 0, 0)], "key int, a int, b int")
    assert judged(rows, spec(False), state) == {(1, 1): "refused", (1, 2): "applied", (2, 3): "no row"}


def test_rows_without_key_or_order_are_told_apart(spark):
    rows = spark.createDataFrame(
        [(None, 1, "CREATE"), (1, None, "CREATE"), (1, 2, "UPDATE"), (1, 3, None)], "key int, replay_id int, change_type string")
    got = judged(rows, spec(False))
    assert got == {(None, 1): "no key", (1, None): "no order", (1, 2): "no row", (1, 3): "unknown type"}


def test_a_hot_key_is_spread_over_ranges(spark):
    rng = random.Random(3)
    kinds = ["CREATE", "UPDATE", "UPDATE", "DELETE"]
    rows = [(1 if i % 3 else i, i, rng.choice(kinds)) for i in range(6_000)]
    changes = spark.createDataFrame(rows, "key int, replay_id int, change_type string").repartition(8)
    assert judged(changes, spec(False), small=0) == outcomes(rows, False)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        places = dealt(changes, ["key", "replay_id"]).groupBy(part().alias("p")).agg(
            F.count("*").alias("n"), F.countDistinct("key").alias("keys")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(places) >= 4 and max(r["n"] for r in places) <= 2 * 6_000 / len(places)


def test_no_window_sees_all_rows_of_a_key(spark):
    """Rows look back within a range; over a key there is one row per range."""
    changes = frame(spark, random_changes(33, 50))
    plan = judge.judged(changes, spec(False), small=0)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert len(windows) == 2
    over_rows = [w for w in windows if PLACE in w.split("windowspecdefinition(")[1]]
    assert all("_part" in w.split("windowspecdefinition(")[1].split("ASC")[0] for w in over_rows)


def test_events_count_the_rows_they_touched(spark):
    rows = spark.createDataFrame(
        [("e1", "applied"), ("e1", "no row"), ("e2", "no row"), ("e3", "refused"), ("e4", "late"), ("e4", "no row"),
         ("e5", "no key")], "event_id string, outcome string")
    got = {r["event_id"]: (r["ids"], r["affected"], r["outcome"]) for r in judge.per_event(rows, ["event_id"]).collect()}
    assert got == {"e1": (2, 1, routing.APPLIED), "e2": (1, 0, routing.NO_ROW), "e3": (1, 0, routing.REFUSED),
                   "e4": (2, 0, routing.LATE), "e5": (1, 0, routing.NO_KEY)}


def test_ranks_count_on_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7919 % 1009,) for i in range(2_000)], "v int").repartition(7)
    got = [r["rank"] for r in ranked(rows, [F.desc("v")]).orderBy(F.desc("v"), "rank").collect()]
    assert got == list(range(1, 2_001))
    assert ranked(rows.limit(0), ["v"]).count() == 0
    same = spark.range(500).select(F.lit(1).alias("v")).repartition(6)
    assert sorted(r["rank"] for r in ranked(same, ["v"]).collect()) == list(range(1, 501))
