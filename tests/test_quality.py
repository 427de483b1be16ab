import pytest
from pyspark.sql import functions as F

from tidemark.functions.names import column_family
from tidemark.operators import quality as q

CASES = [
    # type, column, max length, dialect, level
    ("DateTime", "timestamp", None, "postgres", "Compatible"),
    ("DateOnly", "date", None, "postgres", "Compatible"),
    ("DateOnly", "timestamp with time zone", None, "postgres", "Compatible"),
    ("TimeOnly", "time", None, "postgres", "Compatible"),
    ("DateTime", "text", None, "postgres", "Compatible"),
    ("DateTime", "date", None, "postgres", "Warning"),
    ("DateTime", "integer", None, "postgres", "Error"),
    ("DateTime", "boolean", None, "postgres", "Error"),
    ("DateOnly", "numeric", None, "postgres", "Error"),
    ("TimeOnly", "date", None, "postgres", "Error"),
    ("TimeOnly", "timestamp", None, "postgres", "Error"),
    ("DateTime", "INTEGER", None, "sqlite", "Warning"),
    ("Integer", "bigint", None, "postgres", "Compatible"),
    ("Integer", "numeric", None, "postgres", "Compatible"),
    ("Currency", "double precision", None, "postgres", "Compatible"),
    ("Percent", "real", None, "postgres", "Compatible"),
    ("Currency", "integer", None, "postgres", "Warning"),
    ("Double", "text", None, "postgres", "Warning"),
    ("Integer", "varchar", 3, "postgres", "Warning"),
    ("Double", "boolean", None, "postgres", "Error"),
    ("Integer", "date", None, "postgres", "Error"),
    ("Text", "text", None, "postgres", "Compatible"),
    ("Email", "varchar", 80, "postgres", "Compatible"),
    ("Email", "varchar", 79, "postgres", "Warning"),
    ("MultiEnum", "varchar", 255, "postgres", "Warning"),
    ("StringPlusClob", "varchar(255)", 255, "postgres", "Warning"),
    ("Text", "integer", None, "postgres", "Error"),
    ("Phone", "boolean", None, "postgres", "Error"),
    ("Boolean", "bool", None, "postgres", "Compatible"),
    ("Boolean", "smallint", None, "postgres", "Warning"),
    ("Boolean", "text", None, "postgres", "Warning"),
    ("Boolean", "date", None, "postgres", "Error"),
    ("Boolean", "bit", None, "sqlserver", "Compatible"),
    ("Address", "text", None, "postgres", "Error"),
    ("Location", "jsonb", None, "postgres", "Error"),
    ("PersonName", "text", None, "postgres", "Error"),
    ("Unknown", "text", None, "postgres", "Warning"),
    ("Text", "jsonb", None, "postgres", "Warning"),
]


@pytest.mark.parametrize("dialect", ["postgres", "sqlite", "sqlserver"])
def test_fit(spark, dialect):
    cases = [c for c in CASES if c[3] == dialect]
    rows = spark.createDataFrame(cases, "t string, c string, n int, d string, want string").coalesce(1)
    level = q.fit(F.col("t"), column_family(F.col("c"), dialect), F.col("n"), dialect)["level"]
    assert [tuple(r) for r in rows.select("t", "c", level).collect()] == [
        (c[0], c[1], c[4]) for c in cases]


def test_key_and_flag_columns(spark):
    rows = spark.createDataFrame(
        [("varchar", 18, True), ("text", None, True), ("varchar", 18, False), ("integer", None, True),
         ("varchar", 17, True)], "c string, n int, u boolean").coalesce(1)
    family = column_family(F.col("c"))
    key = q.key_fit(family, F.col("n"), F.col("u"))["level"]
    assert [r[0] for r in rows.select(key).collect()] == [
        "Compatible", "Compatible", "Warning", "Error", "Error"]
    flags = spark.createDataFrame([("boolean",), ("integer",), ("text",)], "c string").coalesce(1)
    level = q.flag_fit(column_family(F.col("c")))["level"]
    assert [r[0] for r in flags.select(level).collect()] == ["Compatible", "Warning", "Error"]


MAPPINGS = "binding_id int, source_field string, target_column string"
COLUMNS = """binding_id int, column_name string, data_type string, max_length int,
    is_unique boolean, nullable boolean, default_value string"""


def standard(spark):
    columns = spark.createDataFrame([
        (1, "sf_id", "varchar", 18, True, False, None), (1, "name", "text", None, False, True, None),
        (1, "phone", "text", None, False, True, None),
        (1, "annual_revenue", "numeric", None, False, True, None),
        (1, "is_deleted", "boolean", None, False, False, None),
        (1, "employee_count", "integer", None, False, False, "0")], COLUMNS)
    fields = spark.createDataFrame(
        [(1, "Phone", "Phone"), (1, "AnnualRevenue", "Currency"), (1, "Name", "Text")],
        "binding_id int, field string, field_type string")
    return columns, fields


def report(spark, mappings, soft=False, flag=None, schema_id="S", binding=1):
    columns, fields = standard(spark)
    bindings = spark.createDataFrame(
        [(binding, schema_id, soft, flag)],
        "binding_id int, schema_id string, soft_delete_enabled boolean, soft_delete_column string")
    rows = spark.createDataFrame(mappings, MAPPINGS)
    items = q.validation_items(bindings, rows, fields, columns)
    found = {(i["item"], i["level"], i["reason"]) for i in items.collect()}
    return found, q.validation_report(bindings, items).first()


KEYED = [(1, "MappedSFKey", "sf_id"), (1, "Phone", "phone"), (1, "annualrevenue", "Annual_Revenue")]


def test_valid_binding(spark):
    found, row = report(spark, KEYED)
    assert row["can_activate"] and row["blockers"] == row["errors"] == 0
    assert ("is_deleted", "Warning", "required but unwritten") in found


def test_flag_column_counts_as_written(spark):
    found, row = report(spark, KEYED, True, "IS_DELETED")
    assert row["can_activate"]
    assert not any(reason == "required but unwritten" for _, _, reason in found)


@pytest.mark.parametrize("mappings, soft, flag, schema_id, binding, reason", [
    (KEYED[1:], False, None, "S", 1, "no key mapping"),
    (KEYED[:1], False, None, "S", 1, "no field mapping"),
    (KEYED, False, None, None, 1, "no schema"),
    (KEYED, False, None, "S", 2, "no target table"),
    (KEYED, True, " ", "S", 1, "no flag column"),
    (KEYED, True, "gone", "S", 1, "no such flag column"),
    (KEYED, True, "name", "S", 1, "flag not boolean"),
    ([*KEYED, (1, "Phone", "gone")], False, None, "S", 1, "no such column"),
    ([*KEYED, (1, "Gone", "name")], False, None, "S", 1, "no such field"),
    ([(1, "MappedSFKey", "employee_count"), *KEYED[1:]], False, None, "S", 1, "key not text"),
])
def test_invalid_bindings(spark, mappings, soft, flag, schema_id, binding, reason):
    found, row = report(spark, mappings, soft, flag, schema_id, binding)
    assert reason in {r for _, _, r in found}
    assert not row["can_activate"]


def test_mapping_set_problems(spark):
    columns, fields = standard(spark)
    proposed = spark.createDataFrame([
        (1, "Phone", "phone"), (1, "Name", "PHONE"), (1, "BillingAddress", "name"),
        (1, "AnnualRevenue", "nowhere"), (1, "name", "SF_ID")], MAPPINGS)
    keys = spark.createDataFrame([(1, "sf_id")], "binding_id int, key_column string")
    got = {(r["source_field"], r["target_column"], r["problem"])
           for r in q.mapping_set_problems(proposed, fields, columns, keys).collect()}
    assert got == {
        ("BillingAddress", "name", "unknown field"), ("AnnualRevenue", "nowhere", "unknown column"),
        ("name", "SF_ID", "holds the record id"), (None, "PHONE", "column mapped twice")}


def test_data_measures(spark):
    rows = spark.createDataFrame(
        [(1, "abc", 1.0), (1, "abcd", 1.5), (2, None, None)], "id int, name string, amount double")
    assert list(q.text_overflow(rows, {"name": 3}).first()) == [1, 4]
    assert list(q.precision_loss(rows, ["amount"], []).first()) == [1]
    assert list(q.missing_required(rows, ["name", "id"]).first()) == [1, 0]
    assert [tuple(r) for r in q.duplicate_keys(rows, ["id"]).collect()] == [(1, 2)]
    parents = spark.createDataFrame([(2,)], "key int")
    assert [tuple(r) for r in q.missing_parents(rows, parents, "id", "key").collect()] == [(1, 2)]
    bound = spark.createDataFrame([("A",), ("a",), ("b",), (None,)], "target_table string")
    assert [tuple(r) for r in q.shared_destinations(bound, "target_table").collect()] == [("a", 2)]
