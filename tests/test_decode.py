import json

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.plans.schema import UnsupportedSchema, entity_fields, field_layout, parse_schema
from tidemark.sources.avro import Decoder, decode_payloads
from workload.encode import ADDRESS, encode, event, event_schema, number, optional

NAME = {"type": "record", "name": "Switchable_PersonName", "fields": [
    optional("First", "string"), optional("Last", "string")]}
SCHEMA = event_schema("ThingChangeEvent", [
    optional("Name", ["string", NAME], "Data:Switchable_PersonName"),
    optional("Size", "int", "Data:Integer"),
    optional("Weight", "double", "Data:Percent"),
    optional("Ratio", "float"),
    optional("Made", "long", "Data:DateTime:00N"),
    optional("Raw", "bytes"),
    optional("Good", "boolean", "Data:Boolean"),
    optional("Home", ADDRESS, "Data:Address"),
    # refers to the record type defined above
    optional("Work", "feed.Address", "Data:Address"),
])
WANTED = {"Name": "string", "NameFirst": "string", "NameLast": "string", "Size": "int",
          "Weight": "double", "Ratio": "float", "Made": "long", "Raw": "bytes", "Good": "boolean",
          "HomeStreet": "string", "HomeLatitude": "double", "WorkStreet": "string"}
NODE = parse_schema(SCHEMA)
DECODER = Decoder({"S": SCHEMA}, WANTED)


def decoded(payloads, decoder=DECODER, schema_id="S"):
    names = ["header", "fields", "compounds", "error"]
    columns = decoder.decode(schema_id, pa.array(payloads, pa.binary()))
    return [dict(zip(names, row)) for row in zip(*[c.to_pylist() for c in columns])]


maybe = st.none()
address = st.fixed_dictionaries({"Street": maybe | st.text(), "Latitude": maybe | st.floats(allow_nan=False)})
person = st.fixed_dictionaries({"First": maybe | st.text(), "Last": maybe | st.text()})
things = st.fixed_dictionaries({
    "Name": maybe | st.text() | person,
    "Size": maybe | st.integers(-2**31, 2**31 - 1),
    "Weight": maybe | st.floats(allow_nan=False),
    "Ratio": maybe | st.floats(allow_nan=False, width=32),
    "Made": maybe | st.integers(-2**63, 2**63 - 1),
    "Raw": maybe | st.binary(),
    "Good": maybe | st.booleans(),
    "Home": maybe | address,
    "Work": maybe | address,
})


def expected(thing):
    name, home, work = thing["Name"], thing["Home"] or {}, thing["Work"] or {}
    person = name if isinstance(name, dict) else {}
    return {
        "Name": name if isinstance(name, str) else None, "NameFirst": person.get("First"),
        "NameLast": person.get("Last"), "HomeStreet": home.get("Street"),
        "HomeLatitude": home.get("Latitude"), "WorkStreet": work.get("Street"),
        **{k: thing[k] for k in ("Size", "Weight", "Ratio", "Made", "Raw", "Good")},
    }


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(things, st.lists(st.text(max_size=20), max_size=5)), min_size=1, max_size=6))
def test_round_trip(batch):
    payloads = [event(NODE, ids, "UPDATE", ["Size", "Home.Street"], "Thing", i, values)
                for i, (values, ids) in enumerate(batch)]
    for i, (row, (values, ids)) in enumerate(zip(decoded(payloads), batch)):
        assert row["error"] is None
        assert row["fields"] == expected(values)
        assert row["header"]["recordIds"] == ids
        assert row["header"]["changeType"] == "UPDATE" and row["header"]["sequenceNumber"] == i
        assert row["header"]["changedFields"] == ["0x04", "8-0x01"]
        assert bool(row["compounds"]["Home"]) == (values["Home"] is not None)
        assert bool(row["compounds"]["Name"]) == isinstance(values["Name"], dict)


def test_damaged_payloads_are_marked_and_others_unharmed():
    whole = event(NODE, ["a", "b"], "CREATE", values={"Size": 7, "Home": {"Street": "x"}})
    cuts = [whole[:i] for i in range(len(whole))]
    rows = decoded([*cuts, whole + b"\0", None, whole])
    assert all(r["error"] for r in rows[:-1])
    assert all(r["fields"]["Size"] is None for r in rows[:-1])
    assert [r["error"] for r in rows[-3:-1]] == ["trailing bytes", "no payload"]
    assert rows[-1]["error"] is None and rows[-1]["fields"]["Size"] == 7


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=200), min_size=1, max_size=5))
def test_any_bytes_are_safe(payloads):
    whole = event(NODE, ["a"], "DELETE")
    rows = decoded([*payloads, whole])
    assert len(rows) == len(payloads) + 1 and rows[-1]["error"] is None


def test_arrays_in_several_blocks():
    whole = event(NODE, ["a", "b", "c"], "DELETE")
    one_block = encode(parse_schema('{"type": "array", "items": "string"}'), ["a", "b", "c"])
    # the same items as a block of one and a sized block of two
    sized = number(-2) + number(4) + number(1) + b"b" + number(1) + b"c"
    blocks = number(1) + number(1) + b"a" + sized + number(0)
    assert one_block in whole
    row = decoded([whole.replace(one_block, blocks, 1)])[0]
    assert row["error"] is None and row["header"]["recordIds"] == ["a", "b", "c"]


def test_invalid_text_is_replaced_not_fatal():
    whole = event(NODE, ["a"], "CREATE", values={"Name": "abc"})
    rows = decoded([whole.replace(b"abc", b"a\xffc"), whole])
    assert rows[0]["fields"]["Name"] == "a�c" and rows[1]["fields"]["Name"] == "abc"


def test_bad_tags_and_symbols():
    kind = event_schema("E", [optional("Size", "int")])
    whole = event(parse_schema(kind), [], "CREATE", values={"Size": 1})
    decoder = Decoder({"S": kind}, {"Size": "int"})
    columns = decoder.decode("S", pa.array([whole[:-2] + number(5) + number(1)], pa.binary()))
    assert columns[-1].to_pylist() == ["bad union tag"]


def test_revisions_meet_in_the_wanted_fields(spark):
    old = event_schema("E", [optional("A", "int"), optional("B", "string")])
    new = event_schema("E", [optional("B", "string"), optional("X", "double"), optional("A", "long")])
    events = spark.createDataFrame([
        (1, "old", event(parse_schema(old), ["k"], "CREATE", values={"A": 5, "B": "b"})),
        (2, "new", event(parse_schema(new), ["k"], "CREATE", values={"A": 2**40, "B": None, "X": 1.0})),
        (3, "other", b"\0"), (4, None, b"\0"),
    ], "replay_id bigint, schema_id string, payload binary")
    rows = decode_payloads(events, {"old": old, "new": new}, {"A": "long", "B": "string", "X": "double"})
    got = {r["replay_id"]: (tuple(r["fields"]) if r["fields"] else None, r["decode_error"])
           for r in rows.collect()}
    assert got == {
        1: ((5, "b", None), None), 2: ((2**40, None, 1.0), None),
        3: ((None, None, None), "no schema"), 4: ((None, None, None), "no schema")}


def test_entity_fields():
    fields = {f.name: f for f in entity_fields(NODE)}
    assert len(fields) == len(entity_fields(NODE)) == 13
    assert "ChangeEventHeader" not in fields and "Home" not in fields
    assert fields["Name"].field_type == "Text" and fields["NameFirst"].parent == "Name"
    assert fields["HomeLatitude"].field_type == "Double" and fields["HomeLatitude"].child == "Latitude"
    assert fields["Made"].field_type == "DateTime" and fields["Made"].field_id == "00N"
    assert fields["Ratio"].field_type == "Unknown"
    assert (fields["Size"].parent_position, fields["Size"].position) == (-1, 2)
    assert (fields["WorkStreet"].parent_position, fields["WorkStreet"].position) == (9, 0)
    top, children = field_layout(NODE)
    assert top[9] == "Work" and children[9] == ["Street", "Latitude"] and children[2] == []


def test_unsupported_schemas():
    with pytest.raises(UnsupportedSchema):
        parse_schema(event_schema("E", [optional("A", "nowhere")]))
    with pytest.raises(UnsupportedSchema):
        parse_schema(json.dumps({"type": "map", "values": "string"}))


def test_bad_payload_never_fails_the_job(spark):
    rows = spark.range(1000).select(
        F.col("id").alias("replay_id"), F.lit("S").alias("schema_id"),
        F.unhex(F.sha2(F.col("id").cast("string"), 512)).alias("payload"))
    out = decode_payloads(rows, {"S": SCHEMA}, WANTED)
    assert out.count() == 1000 and out.filter("decode_error IS NULL").count() == 0


def test_a_changed_wire_type_fails_its_events_only(spark):
    """A field that is text in one revision and a number in another, or wider than now."""
    texts = {"text": event_schema("ThingChangeEvent", [optional("Size", "string", "Data:Text")]),
             "wide": event_schema("ThingChangeEvent", [optional("Size", "long", "Data:Integer")]),
             "now": event_schema("ThingChangeEvent", [optional("Size", "int", "Data:Integer")])}
    nodes = {k: parse_schema(v) for k, v in texts.items()}
    rows = [("text", "17"), ("text", "x"), ("wide", 5), ("wide", 2**40 + 5), ("now", 7), ("now", None)]
    events = [(i, k, event(nodes[k], ["a"], "CREATE", values={"Size": v})) for i, (k, v) in enumerate(rows)]
    df = spark.createDataFrame(events, "event int, schema_id string, payload binary").coalesce(1)
    got = decode_payloads(df, texts, {"Size": "int"}).orderBy("event").select("fields.Size", "decode_error").collect()
    wrong = "value of another type"
    assert [tuple(r) for r in got] == [(17, None), (None, wrong), (5, None), (None, wrong), (7, None), (None, None)]
