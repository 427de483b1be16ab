from pyspark.sql import functions as F

from tidemark.operators import mirror
from tidemark.operators import statements as st

CHILD = "id string, parent int, name string, link int"


def children(spark):
    return spark.createDataFrame(
        [("a", 1, "a1", 7), ("b", 1, "b1", 8), ("c", 2, "c2", 9), ("d", 3, "d3", None)], CHILD)


def bag(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_replace_children_of_a_parent(spark):
    incoming = spark.createDataFrame([("a", 1, "a9", 0), ("c", 1, "c9", 0), ("e", 1, "e9", 5)], CHILD)
    parents = spark.createDataFrame([(1,), (3,), (3,)], "parent int")
    got = mirror.replace_children(children(spark), incoming, parents, ["id"], "parent", keep=["link"])
    # b is gone, c moved here from parent 2, d lost with parent 3's empty set
    assert bag(got) == [("a", 1, "a9", 7), ("c", 1, "c9", 9), ("e", 1, "e9", 5)]


def test_replace_owned(spark):
    incoming = spark.createDataFrame([("z", 1, "z", 0), ("y", 9, "ignored", 0)], CHILD)
    owners = spark.createDataFrame([(1,), (2,)], "parent int")
    got = mirror.replace_owned(children(spark), incoming, owners, "parent")
    assert bag(got.select(children(spark).columns)) == [("d", 3, "d3", None), ("z", 1, "z", 0)]


def test_reconcile_and_counts(spark):
    table = spark.createDataFrame([(1, "a", 0), (2, "b", 0), (3, "c", 0)], "id int, v string, synced int")
    incoming = spark.createDataFrame([(1, "a"), (2, "x"), (4, None)], "id int, v string")
    rows = mirror.reconcile(table, incoming, ["id"], stamps={"synced": F.lit(9)})
    assert bag(rows) == [(1, "a", 9, "unchanged"), (2, "x", 9, "updated"), (3, "c", 0, "deleted"),
                         (4, None, 9, "inserted")]
    assert bag(mirror.reconciled(rows)) == [(1, "a", 9), (2, "x", 9), (4, None, 9)]
    assert mirror.removed_count(rows).first()[0] == 1
    nothing = incoming.filter("id < 0")
    assert mirror.reconciled(mirror.reconcile(table, nothing, ["id"])).count() == 0


def test_snapshot_diff_treats_null_as_a_value(spark):
    old = spark.createDataFrame([(1, None), (2, None), (3, "x")], "id int, v string")
    new = spark.createDataFrame([(1, None), (2, "y"), (3, None)], "id int, v string")
    assert bag(mirror.snapshot_diff(old, new, ["id"])) == [
        (1, "unchanged"), (2, "updated"), (3, "updated")]


def test_cascades(spark):
    gone = spark.createDataFrame([(1,), (1,), (9,)], "pid int")
    assert bag(mirror.cascade_children(children(spark), gone, "parent", "pid").select("id")) == [
        ("c",), ("d",)]
    unlinked = mirror.unlink(children(spark), spark.createDataFrame([(7,), (7,)], "l int"), "link", "l")
    assert bag(unlinked.select("id", "link")) == [("a", None), ("b", 8), ("c", 9), ("d", None)]
    owners = spark.createDataFrame([(7,), (8,)], "l int")
    assert bag(mirror.orphans(children(spark), owners, "link", "l").select("id")) == [("c",)]


def test_exclusive_flags(spark):
    rows = children(spark).withColumn("main", F.lit(True))
    assert bag(mirror.set_exclusive_flag(rows, "main", F.col("link") == 8).select("id", "main")) == [
        ("a", False), ("b", True), ("c", False), ("d", False)]
    per = mirror.set_exclusive_flag_per_group(rows, "parent", "id", "main", F.col("name"))
    assert bag(per.select("id", "main")) == [("a", True), ("b", False), ("c", True), ("d", True)]


def test_statements(spark):
    table = spark.createDataFrame([(1, "a", False), (2, "b", True)], "id int, v string, gone boolean")
    ids = spark.createDataFrame([(1,), (1,), (5,)], "id int")
    assert bag(st.update_columns(table, ids, "id", {"v": F.lit(None).cast("string")})) == [
        (1, None, False), (2, "b", True)]
    assert bag(st.delete_rows(table, ids, "id")) == [(2, "b", True)]
    assert bag(st.set_flag(table, ids, "id", "gone", True)) == [(1, "a", True), (2, "b", True)]
    assert st.affected(table, ids, "id").first()[0] == 1
    rows = spark.createDataFrame([(2, "x"), (3, "c")], "id int, v string")
    assert bag(st.insert_rows(table, rows, "id"))[-1] == (3, "c", None)
    assert bag(st.refused_rows(table, rows, "id")) == [(2, "x")]


def test_second_new_row_of_a_key_is_refused(spark):
    table = spark.createDataFrame([(1, "a")], "id INT, name STRING")
    rows = spark.createDataFrame([(2, "x"), (2, "w"), (2, "w"), (1, "b"), (3, None)], "id INT, name STRING")
    assert sorted(map(tuple, st.insert_rows(table, rows, "id").collect()), key=str) == [
        (1, "a"), (2, "w"), (3, None)]
    assert sorted(map(tuple, st.refused_rows(table, rows, "id").collect())) == [
        (1, "b"), (2, "w"), (2, "x")]
