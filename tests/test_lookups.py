import pytest

from tidemark.operators import lookups


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("lookups") / "rows")
    spark.createDataFrame([(1, "A", "x"), (2, "a", "x"), (3, "B", None), (4, None, "y")], "id int, name string, kind string"
                          ).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def ids(rows):
    return sorted(r["id"] for r in rows.collect())


def test_none_asks_for_nothing(stored):
    assert ids(lookups.matching(stored)) == ids(lookups.matching(stored, name=None)) == [1, 2, 3, 4]
    assert ids(lookups.matching(stored, name="a", kind=None)) == [2]
    assert ids(lookups.matching(stored, ignore_case=["name"], name="a", kind="x")) == [1, 2]
    assert ids(lookups.matching(stored, id=4, kind="x")) == []


def test_conditions_reach_the_scan(stored):
    plan = lookups.matching(stored, name="a", kind=None, id=2)._jdf.queryExecution().executedPlan().toString()
    pushed = plan.split("PushedFilters: [")[1].split("]")[0]
    assert "EqualTo(name,a)" in pushed and "EqualTo(id,2)" in pushed and "kind" not in pushed


def test_many_requests_at_once(spark, stored):
    requests = spark.createDataFrame(
        [(10, "A", None), (11, None, "x"), (12, "B", "x"), (13, "a", "x"), (14, None, "y"), (15, "z", None)],
        "request int, name string, kind string")
    got = {(r["request"], r["id"]) for r in lookups.answered(stored, requests, "request", ["name", "kind"]).collect()}
    assert got == {(10, 1), (11, 1), (11, 2), (13, 2), (14, 4)}
    plan = lookups.answered(stored, requests, "request", ["name", "kind"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_exactly_one_and_how_many_else(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "n"), (4, None)], "k int, v string")
    single, others = lookups.one_per_key(rows, ["k"])
    assert {tuple(r) for r in single.collect()} == {(1, "a"), (None, "n"), (4, None)}
    assert {tuple(r) for r in others.collect()} == {(2, 2)}
    wanted = spark.createDataFrame([(1,), (5,), (5,)], "k int")
    single, others = lookups.one_per_key(rows, ["k"], wanted)
    assert {tuple(r) for r in others.collect()} == {(2, 2), (5, 0)}
    assert single.count() == 3
    plan = single._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan


def test_many_answers_are_dealt_out(spark, monkeypatch):
    """One key with more answers than a task is to give: 400 rows times 500 requests."""
    monkeypatch.setattr(lookups, "TASK_ROWS", 10_000, raising=False)
    monkeypatch.setattr(lookups, "CELL", 50, raising=False)
    rows = spark.range(500).selectExpr("CAST(id AS int) AS id", "CASE WHEN id < 400 THEN 7 ELSE id END AS k")
    requests = spark.range(600).selectExpr(
        "id AS request", "CASE WHEN id < 500 THEN 7 ELSE id - 100 END AS k").union(spark.sql("SELECT 1L, 7L"))
    got = lookups.answered(rows.union(rows.filter("id = 3")), requests, "request", ["k"]).selectExpr(
        "*", "spark_partition_id() AS part").collect()
    wanted = [(r, i) for r in [*range(500), 1] for i in [*range(400), 3]] + [(r, r - 100) for r in range(500, 600)]
    assert sorted((r["request"], r["id"]) for r in got) == sorted(wanted)
    held = {}
    for r in got:
        held[r["part"]] = held.get(r["part"], 0) + 1
    assert max(held.values()) < len(wanted) / 4
