import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.fold import fold
from tidemark.plans import project as p
from tidemark.plans.schema import flatten_structs, parse_schema
from workload.encode import ADDRESS, event, event_schema, optional

PERSON = {"type": "record", "name": "PersonName", "fields": [
    optional("FirstName", "string"), optional("LastName", "string")]}
SCHEMA = event_schema("AccountChangeEvent", [
    optional("Name", ["string", PERSON], "Data:Switchable_PersonName"),
    optional("Phone", "string", "Data:Phone"),
    optional("AnnualRevenue", "double", "Data:Currency"),
    optional("Born", "long", "Data:DateOnly"),
    optional("Home", ADDRESS, "Data:Address"),
])
NODE = parse_schema(SCHEMA)
MAPPINGS = {"MappedSFKey": "sf_id", "Phone": "phone", "AnnualRevenue": "annual_revenue",
            "Name": "name", "NameLastName": "last_name", "Born": "born", "HomeStreet": "street",
            "Gone": "gone"}


def binding(**options):
    return p.plan_binding(1, "AccountChangeEvent", "crm.account", MAPPINGS, {"S": SCHEMA}, "S",
                          {"born": "Date"}, **options)


def projected(spark, events, chosen, **options):
    rows = [(i, "S", payload) for i, payload in enumerate(events, 1)]
    envelopes = spark.createDataFrame(rows, "replay_id bigint, schema_id string, payload binary")
    return p.project(p.decode_binding(envelopes, chosen), chosen, **options)


def written(row, chosen):
    return {c: row["target"][c] for c in chosen.columns if row["written"][c]}


def run(spark, events, **options):
    chosen = binding(**options)
    rows = projected(spark, events, chosen).orderBy("replay_id").collect()
    return [(r["outcome"], written(r, chosen)) for r in rows]


VALUES = {"Phone": "1", "AnnualRevenue": 2.5, "Born": 0, "Name": "n", "Home": {"Street": "s"}}


def test_fields_unknown_to_every_revision_are_left_out():
    assert "gone" not in binding().columns


def test_create_writes_values_that_are_there(spark):
    got = run(spark, [
        event(NODE, ["a"], "CREATE", values=VALUES),
        event(NODE, ["a"], "CREATE", values={"Name": {"FirstName": "f", "LastName": "l"}}),
    ])
    assert got == [
        ("applied", {"phone": "1", "annual_revenue": 2.5, "born": datetime.date(1970, 1, 1),
                     "name": "n", "street": "s"}),
        ("applied", {"last_name": "l"}),
    ]


def test_update_writes_what_changed_even_null(spark):
    got = run(spark, [
        event(NODE, ["a"], "UPDATE", ["Phone"], values=VALUES),
        event(NODE, ["a"], "UPDATE", ["Phone", "Born"], values={"AnnualRevenue": 1.0}),
        event(NODE, ["a"], "UPDATE", ["Home.Street", "Name.LastName"],
              values={"Home": {"Street": None}, "Name": {"LastName": "x"}}),
        event(NODE, ["a"], "UPDATE", ["Home.Latitude"], values=VALUES),
        event(NODE, ["a"], "UPDATE", [], values=VALUES),
    ])
    assert got == [
        ("applied", {"phone": "1"}),
        ("applied", {"phone": None, "born": None}),
        ("applied", {"street": None, "last_name": "x"}),
        ("no change", {}),
        ("no change", {}),
    ]


def test_change_inside_a_null_compound(spark):
    lost = event(NODE, ["a"], "UPDATE", ["Home.Street"], values={"Phone": "1"})
    assert run(spark, [lost]) == [("no change", {})]
    assert run(spark, [lost], null_compound="null_children") == [("applied", {"street": None})]


def test_outcomes(spark):
    events = [
        event(NODE, [], "CREATE", values=VALUES), event(NODE, ["a"], "GAP_UPDATE"),
        event(NODE, ["a"], "SNAPSHOT"), event(NODE, ["a"], "UNDELETE"),
        event(NODE, ["a"], "DELETE"), b"\0",
    ]
    outcomes = [o for o, _ in run(spark, events)]
    assert outcomes == ["bad header", "unsupported type", "unknown type", "undelete skipped",
                        "applied", "bad payload"]
    assert [o for o, _ in run(spark, events, flag="is_deleted")][3] == "applied"


def test_record_ids(spark):
    chosen = binding()
    rows = projected(spark, [
        event(NODE, ["a", "b"], "CREATE", values=VALUES),
        event(NODE, ["a", "b", "a"], "UPDATE", ["Phone"], values=VALUES),
        event(NODE, ["c", "d"], "DELETE"),
    ], chosen)
    got = sorted((r[p.ORDER], r["sf_id"]) for r in p.change_rows(rows, chosen).collect())
    assert got == [(1, "a"), (2, "a"), (2, "b"), (3, "c"), (3, "d")]


def test_two_fields_for_one_column_are_refused():
    mappings = {"MappedSFKey": "id", "Phone": "text", "NameLastName": "text"}
    with pytest.raises(ValueError, match="two fields to one column"):
        p.plan_binding(1, "E", "t", mappings, {"S": SCHEMA}, "S")


def test_value_that_does_not_convert_fails_its_event(spark):
    chosen = p.plan_binding(1, "E", "t", {"MappedSFKey": "id", "Phone": "phone"}, {"S": SCHEMA}, "S",
                            {"phone": "Integer"})
    rows = projected(spark, [
        event(NODE, ["a"], "CREATE", values={"Phone": "12x"}),
        event(NODE, ["a"], "UPDATE", ["Phone"], values={"Phone": "12"}),
        event(NODE, ["a"], "UPDATE", ["Phone"], values={"Phone": None}),
        event(NODE, ["a"], "UPDATE", ["Phone"], values={"Phone": "x"}),
        event(NODE, ["a"], "DELETE", values={"Phone": "x"}),
    ], chosen).orderBy("replay_id")
    assert [r["outcome"] for r in rows.collect()] == [
        "bad value", "applied", "applied", "bad value", "applied"]
    assert p.change_rows(rows, chosen).count() == 3


def test_handlers_and_converters_can_be_replaced(spark):
    chosen = binding(converters={"Phone": lambda v: F.concat(F.lit("+"), v)})
    handlers = {**p.DEFAULT_HANDLERS, "DELETE": lambda f: (f.value, f.wire.isNotNull())}
    rows = projected(spark, [event(NODE, ["a"], "DELETE", values={"Phone": "1"})], chosen,
                     handlers=handlers)
    assert written(rows.first(), chosen) == {"phone": "+1"}


def test_changed_names(spark):
    chosen = binding()
    envelopes = spark.createDataFrame(
        [(1, "S", event(NODE, ["a"], "UPDATE", ["Phone", "Born", "Home.Latitude", "Name.LastName"]))],
        "replay_id bigint, schema_id string, payload binary")
    decoded = p.decode_binding(envelopes, chosen)
    assert sorted(decoded.select(p.changed_names(chosen)).first()[0]) == [
        "Born", "HomeLatitude", "NameLastName", "Phone"]


def test_a_key_mapping_is_required():
    with pytest.raises(ValueError, match="key mapping"):
        p.plan_binding(1, "E", "t", {"Phone": "phone"}, {"S": SCHEMA}, "S")


def test_target_columns_may_have_any_name(spark):
    mappings = {"MappedSFKey": "header", "Phone": "replay_id", "AnnualRevenue": "change_type",
                "Born": "schema_id"}
    chosen = p.plan_binding(1, "E", "t", mappings, {"S": SCHEMA}, "S")
    rows = projected(spark, [
        event(NODE, ["a"], "CREATE", values=VALUES),
        event(NODE, ["a"], "UPDATE", ["Phone"], values={"Phone": "2"})], chosen)
    got = fold(p.change_rows(rows, chosen), chosen.fold_spec()).first().asDict()
    assert got == {"header": "a", "replay_id": "2", "change_type": 2.5,
                   "schema_id": datetime.datetime(1970, 1, 1)}


def test_key_column_cannot_carry_a_field():
    with pytest.raises(ValueError, match="key column"):
        p.plan_binding(1, "E", "t", {"MappedSFKey": "id", "Phone": "id"}, {"S": SCHEMA}, "S")


def test_flatten_structs(spark):
    rows = spark.sql("""SELECT struct(1 AS a) AS ChangeEventHeader, 'n' AS Name,
        struct('s' AS Street, 1.5D AS Latitude) AS Home""")
    flat = flatten_structs(rows)
    assert flat.columns == ["Name", "HomeStreet", "HomeLatitude"]
    assert tuple(flat.first()) == ("n", "s", 1.5)


TIMES = event_schema("AccountChangeEvent", [
    optional("Seen", "string", "Data:DateTime"), optional("Price", "double", "Data:Currency"),
    optional("Phone", "string", "Data:Phone")])


def test_a_time_carried_as_text_stops_neither_the_plan_nor_other_events(spark):
    node = parse_schema(TIMES)
    chosen = p.plan_binding(
        1, "E", "t", {"MappedSFKey": "id", "Seen": "seen", "Price": "price", "Phone": "phone"}, {"S": TIMES}, "S",
        {"price": "Decimal(5,1)", "phone": "Integer"})
    rows = projected(spark, [
        event(node, ["a"], "CREATE", values={"Seen": "1705314645000", "Price": 12.5, "Phone": "1"}),
        event(node, ["b"], "CREATE", values={"Seen": "soon", "Price": 12.54, "Phone": "x"}),
        event(node, ["c"], "CREATE", values={"Seen": None, "Price": 12.54, "Phone": "1"}),
        event(node, ["d"], "UPDATE", ["Price"], values={"Seen": "soon", "Price": 1e9, "Phone": "x"}),
    ], chosen).orderBy("replay_id")
    assert [r["outcome"] for r in rows.collect()] == ["applied", "bad value", "applied", "bad value"]
    found = {tuple(r) for r in p.value_problems(rows, ["replay_id"]).collect()}
    assert found == {(2, "Seen", "seen", "no time"), (2, "Price", "price", "digits lost"), (2, "Phone", "phone", "no number"),
                     (3, "Price", "price", "digits lost"), (4, "Price", "price", "out of range")}
