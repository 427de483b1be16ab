import json

import pytest

from tidemark.plans.field_rows import binding_fields, entity_field_rows, unreadable
from tidemark.plans.schema import entity_fields, parse_schema
from workload import encode

ADDRESS = {"type": "record", "name": "Address", "fields": [
    {"name": "Street", "type": ["null", "string"]}, {"name": "Lat", "type": "double", "doc": "Data:Percent"},
    {"name": "Kind", "type": ["null", {"type": "enum", "name": "Kind", "symbols": ["a"]}]},
    {"name": "Inner", "type": {"type": "record", "name": "Deep", "fields": []}}]}


def record(fields, **more):
    return json.dumps({"type": "record", "name": "AChangeEvent", "fields": fields, **more})


TEXTS = {
    "R1": encode.REVISIONS["R1"],
    "R2": encode.REVISIONS["R2"],
    "none": record([]),
    "all": record([
        {"name": "ChangeEventHeader", "type": ADDRESS},
        {"name": "A", "type": "string", "doc": "Data:Text:00N1"},
        {"name": "B", "type": ["null", "com.x.Address"], "doc": "Data:Address:00N2"},
        {"name": "C", "type": ["string", {"type": "array", "items": "string"}], "doc": "Data:MultiEnum"},
        {"name": "D", "type": ["null", "string", "Address"], "doc": "Data:PersonName:x"},
        {"name": "E", "type": {"type": "long", "logicalType": "timestamp-millis"}, "doc": "SwitchableCurrency"},
        {"name": "F", "type": ["null", "Kind"]},
        {"name": "G", "type": {"type": ["null", "int"]}},
        {"name": "H", "type": "bytes", "doc": None}], namespace="com.x"),
    "spaces": record([
        {"name": "P", "type": ["null", {**ADDRESS, "namespace": "o.p"}]}, {"name": "Q", "type": ["null", "o.p.Address"]},
        {"name": "R", "type": ["null", "o.p.Kind"]}], namespace="com.y"),
    "bare": record([{"name": "P", "type": ["null", ADDRESS]}, {"name": "Q", "type": ["null", "Address"]}]),
    "map": record([{"name": "A", "type": ["null", {"type": "map", "values": "int"}]}]),
    "nowhere": record([{"name": "A", "type": "string"}, {"name": "B", "type": ["null", "Nowhere"]}]),
    "cut": record([])[:-1],
    "list": "[1]",
    "null": None,
}


def expected(text):
    try:
        fields = entity_fields(parse_schema(text))
    except (ValueError, TypeError, KeyError):
        return None
    return sorted(((f.name, f.field_type, f.wire_type, f.nullable, f.parent_position, f.position, f.parent, f.child,
                    f.field_id) for f in fields), key=str)


@pytest.fixture(scope="module")
def registry(spark):
    return spark.createDataFrame(list(TEXTS.items()), "schema_id string, schema_json string")


def test_rows_equal_what_the_driver_reads_of_each_text(registry):
    got = {}
    for row in entity_field_rows(registry).collect():
        got.setdefault(row["schema_id"], []).append(tuple(row)[1:])
    for schema_id, text in TEXTS.items():
        assert sorted(got.get(schema_id, []), key=str) == (expected(text) or []), schema_id
    assert len(got["all"]) == 14


def test_unreadable_texts_are_listed_with_a_reason(registry):
    got = {r["schema_id"]: r["problem"] for r in unreadable(registry).collect()}
    assert got == {"map": "unsupported type", "nowhere": "unsupported type", "cut": "no JSON", "null": "no JSON",
                   "list": "no record"}
    assert set(got) == {k for k, text in TEXTS.items() if expected(text) is None}


def test_no_python_reads_the_texts(registry):
    plan = entity_field_rows(registry)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_fields_of_bindings_come_from_the_linked_revision(spark, registry):
    numbered = spark.createDataFrame([(1, "all"), (2, "cut")], "id bigint, schema_id string")
    bindings = spark.createDataFrame([(7, 1), (8, 2), (9, None)], "id bigint, avro_schema_id bigint")
    rows = binding_fields(entity_field_rows(registry), bindings, numbered).collect()
    assert {r["binding_id"] for r in rows} == {7}
    types = {r["field"]: r["field_type"] for r in rows}
    assert types["D"] == "Text" and types["DLat"] == "Percent" and "Id" not in types and len(types) == len(rows)
