import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidemark.functions import bitmap, convert, docs, names


def values(spark, column, given, schema="v string"):
    rows = spark.createDataFrame([(v,) for v in given], schema)
    return [r[0] for r in rows.coalesce(1).select(column(F.col("v"))).collect()]


def test_bitmap_positions(spark):
    expected = {
        "0x800000": [23],
        "0x800002": [1, 23],
        "0x100000000000800000": [23, 68],
        "0x0400000000000000": [58],
        "6-0x01": [0],
        "6-0x0180": [7, 8],
        "0x180": [],
        "0xzz": [],
        "": [],
        "0x": [],
        "800002": [1, 23],
    }
    assert values(spark, bitmap.positions, expected) == list(expected.values())


def test_bitmap_parents_and_broken_entries(spark):
    given = ["6-0x01", "0x01", "-0x01", "a-0x01"]
    assert values(spark, bitmap.nested_parent, given) == [6, None, None, None]
    assert values(spark, bitmap.is_broken_entry, given) == [False, False, False, True]


def test_field_changed(spark):
    rows = spark.createDataFrame([(["0x800002", "6-0x0180", "0x180", ""],), (None,)], "e array<string>")
    parsed = bitmap.parsed_entries(F.col("e"))

    def has(parent, position):
        changed = bitmap.field_changed(parsed, F.lit(parent), F.lit(position).cast("int"))
        return [r[0] for r in rows.select(changed).collect()]

    assert has(-1, 1) == [True, False] and has(-1, 23) == [True, False]
    assert has(6, 7) == [True, False] and has(6, 0) == [False, False]
    assert has(-1, 7) == [False, False] and has(-1, 900) == [False, False]
    assert has(-1, None) == [False, False]


def test_doc_texts(spark):
    expected = {
        "Data:DateTime:00NDp000009Rr9D": ("Data", "DateTime", "DateTime", "00NDp000009Rr9D"),
        "ForeignKey:EntityId": ("ForeignKey", "EntityId", "EntityId", None),
        "CreatedDate:DateTime": ("CreatedDate", "DateTime", "DateTime", None),
        "Data:Switchable_PersonName": ("Data", "Switchable_PersonName", "PersonName", None),
        "data:switchable_personname": ("data", "switchable_personname", "PersonName", None),
        "Data:SomeTypeInventedLater:00N123": ("Data", "SomeTypeInventedLater", "Unknown", "00N123"),
        "currency": ("", "currency", "Currency", None),
        "": ("", "", "Unknown", None),
        " \t": ("", "", "Unknown", None),
        None: ("", "", "Unknown", None),
    }
    assert [tuple(v) for v in values(spark, docs.parse_doc, expected)] == list(expected.values())


def test_type_classes(spark):
    given = ["DateOnly", "Percent", "Boolean", "Location", "Phone", "Unknown", "Other"]
    assert values(spark, docs.type_class, given) == [
        "temporal", "numeric", "boolean", "compound", "textual", "unknown", "unknown"]


def test_member_names(spark):
    given = [("SalesEvents__chn", "AccountChangeEvent"), ("Order_Channel__chn", "Order_NorthAmer__e"),
             ("ChangeEvents", "AccountChangeEvent"), ("MyChannel__chn", "MyObject__ChangeEvent"),
             (" ", "X")]
    rows = spark.createDataFrame(given, "c string, e string").coalesce(1)
    got = [r[0] for r in rows.select(names.member_name(F.col("c"), F.col("e"))).collect()]
    assert got == ["SalesEvents_chn_AccountChangeEvent", "Order_Channel_chn_Order_NorthAmer_e",
                   "ChangeEvents_AccountChangeEvent", "MyChannel_chn_MyObject_ChangeEvent", None]


def test_channel_names(spark):
    bad = ["SalesEvents", "", "__chn", "9Sales__chn", "Sales_-Events__chn", "Sales__Events__chn",
           "SalesEvents___chn", None]
    good = ["SalesEvents__chn", "A__chn", "Order_Channel__chn", "a1_2b__chn"]
    assert values(spark, names.is_channel_name, bad) == [False] * len(bad)
    assert values(spark, names.is_channel_name, good) == [True] * len(good)


def test_normalised_names(spark):
    given = ["BillingAddressCity", "billing_address_city", "Some_Date__c", "Größe-2", "x__C"]
    assert values(spark, names.normalised_name, given) == [
        "billingaddresscity", "billingaddresscity", "somedate", "größe2", "x"]


def test_table_names(spark):
    given = ["sales.account", "account", ".account", "a.b.c"]
    assert [tuple(v) for v in values(spark, names.split_table_name, given)] == [
        ("sales", "account"), ("public", "account"), ("public", ".account"), ("a.b", "c")]


def test_record_ids(spark):
    given = ["001Dp00000JJkkHIAT", "001dp00000jjkkhia", "001Dp00000JJkkHIA!", None, "x" * 19]
    assert values(spark, names.is_record_id, given) == [True, False, False, False, False]


def test_json_names(spark):
    given = ['["a", " ", "b "]', "[]", "not json", None]
    assert values(spark, names.json_names, given) == [["a", "b"], [], None, None]


@pytest.mark.parametrize("wire, doc, value, expected", [
    ("string", "Text", "O'Brien", "O'Brien"),
    ("long", "DateTime", 1705314645000, datetime.datetime(2024, 1, 15, 10, 30, 45)),
    ("long", "DateOnly", 1705276800000, datetime.datetime(2024, 1, 15)),
    ("long", "TimeOnly", 37845000, "10:30:45.000"),
    ("long", "TimeOnly", 86400000, None),
    ("long", "DateTime", 2**62, None),
    ("long", "Unknown", 42, 42),
    ("int", "Integer", 42, 42),
    ("double", "Currency", 1234.56, 1234.56),
    ("boolean", "Boolean", True, True),
    ("string", "Text", None, None),
    ("long", "DateTime", None, None),
])
def test_conversion(spark, wire, doc, value, expected):
    wire_type = {"string": "string", "long": "bigint", "int": "int", "double": "double",
                 "boolean": "boolean"}[wire]
    rows = spark.createDataFrame([(value,)], f"v {wire_type}")
    out = convert.convert(F.col("v"), doc, wire)
    if isinstance(expected, datetime.datetime):
        out = out.cast("timestamp_ntz")
    assert rows.select(out).first()[0] == expected


def test_conversion_by_target_family(spark):
    rows = spark.createDataFrame([(1705314645000, "x1", "17")], "ms bigint, bad string, good string")
    got = rows.select(
        convert.convert(F.col("ms"), "DateOnly", "long", "Date"),
        convert.convert(F.col("ms"), "DateTime", "long", "Text"),
        convert.convert(F.col("bad"), "Text", "string", "Integer"),
        convert.convert(F.col("good"), "Text", "string", "Integer"),
        convert.flag_value(F.lit(True), "Integer"), convert.flag_value(F.lit(True), "Boolean"),
    ).first()
    assert list(got) == [datetime.date(2024, 1, 15), "2024-01-15 10:30:45", None, 17, 1, True]


def test_pluggable_converter(spark):
    rows = spark.createDataFrame([(1234.56,)], "v double")
    table = {**convert.DEFAULT_CONVERTERS, "Currency": lambda v: v.cast("decimal(10,1)")}
    out = convert.convert(F.col("v"), "Currency", "double", None, table)
    assert str(rows.select(out).first()[0]) == "1234.6"


def test_replay_positions(spark):
    encoded = [bytes(bytearray.fromhex(h)) for h in (
        "00000000001790500000", "00000000001790290000", "0000000000A7483B0000",
        "FFFFFFFFFFFFFFFE0000")]
    assert values(spark, convert.replay_position, encoded, "v binary") == [
        1544272, 1544233, 10962999 + 4, -2]


@pytest.mark.parametrize("kind,value,field_type,wire,family,made,problem", [
    ("string", "1705314645000", "DateTime", "string", None, datetime.datetime(2024, 1, 15, 10, 30, 45), None),
    ("string", "soon", "DateTime", "string", None, None, "no time"),
    ("bigint", 2**62, "DateTime", "long", None, None, "out of range"),
    ("double", 3600000.0, "TimeOnly", "double", None, "01:00:00.000", None),
    ("boolean", True, "DateOnly", "boolean", None, datetime.datetime(1970, 1, 1, 0, 0, 0, 1000), None),
    ("string", "12x", "Text", "string", "Integer", None, "no number"),
    ("double", 2.5, "Percent", "double", "Integer", 2, "digits lost"),
    ("double", 1e30, "Percent", "double", "Integer", None, "out of range"),
    ("double", 1234.56, "Currency", "double", "Decimal(6,2)", Decimal("1234.56"), None),
    ("double", 1234.56, "Currency", "double", "Decimal(6, 1)", Decimal("1234.6"), "digits lost"),
    ("double", 12345.6, "Currency", "double", "Decimal(5,2)", None, "out of range"),
    ("string", "7.5", "Currency", "string", "Decimal(5,2)", Decimal("7.50"), None),
    ("string", "x", "Text", "string", "Boolean", None, "no truth value"),
    ("string", "x", "Text", "long", None, None, "no number"),
    ("string", None, "DateTime", "string", None, None, None),
    ("double", None, "Currency", "double", "Decimal(5,2)", None, None),
])
def test_types_that_do_not_agree(spark, kind, value, field_type, wire, family, made, problem):
    """Neither the plan nor a task fails, whatever declared, wire and target type there are."""
    rows = spark.createDataFrame([(value,)], f"v {kind}")
    out = convert.convert(F.col("v"), field_type, wire, family)
    if isinstance(made, datetime.datetime):
        out = out.cast("timestamp_ntz")
    got = rows.select(out, convert.problem(F.col("v"), field_type, wire, family)).first()
    assert list(got) == [made, problem]
