from pyspark.sql import functions as F

from tidemark.operators import catalog
from tidemark.plans import config, routing

REGISTRY = "id int, schema_id string, record_name string, schema_json string, date_created int"
BINDINGS = """id int, avro_schema_id int, entity_name string, target_table string, state string,
    soft_delete_enabled boolean, soft_delete_column string"""


def tables(spark):
    registry = spark.createDataFrame([
        (1, "V1", "AccountChangeEvent", "{}", 1), (2, "V2", "AccountChangeEvent", "{}", 2),
        (3, "C1", "ContactChangeEvent", "{}", 1), (4, "L1", "LeadChangeEvent", "{}", 1),
        (5, "N1", "NoteChangeEvent", "{}", 1)], REGISTRY)
    bindings = spark.createDataFrame([
        (1, 1, "AccountChangeEvent", "crm.account", "Active", False, None),
        (2, 3, "ContactChangeEvent", "crm.contact", "Inactive", False, None),
        (3, 4, "LeadChangeEvent", "crm.lead", "Active", False, None),
        (4, None, "TaskChangeEvent", "crm.task", "Active", False, None)], BINDINGS)
    channels = spark.createDataFrame([(1, "A__chn", False), (2, "B__chn", True)],
                                     "id int, full_name string, is_primary boolean")
    members = spark.createDataFrame(
        [(2, "accountchangeevent"), (2, "ContactChangeEvent"), (2, "TaskChangeEvent"),
         (1, "LeadChangeEvent")], "channel_id int, selected_entity string")
    return registry, bindings, channels, members


def test_subscription_plan(spark):
    registry, bindings, channels, members = tables(spark)
    plan = config.subscription_plan(bindings, registry, channels, members)
    assert [(r["id"], r["schema_id"]) for r in plan.collect()] == [(1, "V1")]
    none = channels.withColumn("is_primary", F.lit(False))
    assert config.subscription_plan(bindings, registry, none, members).count() == 0


def test_routes(spark):
    registry, bindings, channels, members = tables(spark)
    plan = config.subscription_plan(bindings, registry, channels, members)
    events = spark.createDataFrame([(s,) for s in ("V1", "V2", "C1", "L1", "N1", "??")] + [(None,)],
                                   "schema_id string")
    got = {r["schema_id"]: (r["binding_id"], r["route"])
           for r in routing.route(events, plan, registry, bindings).collect()}
    assert got == {
        "V1": (1, "direct"), "V2": (1, "by name"), "C1": (None, "inactive"),
        # by record name a binding is found even when its entity is on no channel
        "L1": (3, "by name"), "N1": (None, "no binding"), "??": (None, "no schema"),
        None: (None, "no schema")}


def test_large_configuration_is_not_broadcast(spark, monkeypatch):
    import tidemark.sizing as sizing

    registry, bindings, channels, members = tables(spark)
    plan = config.subscription_plan(bindings, registry, channels, members)
    rows = spark.range(10)
    hinted = sizing.broadcast_if_small(rows)._jdf.queryExecution().analyzed().toString()
    plain = sizing.broadcast_if_small(rows, limit=5)._jdf.queryExecution().analyzed().toString()
    assert "ResolvedHint" in hinted and "ResolvedHint" not in plain
    assert plan.count() == 1


def test_registry_operators(spark):
    registry, bindings, _, _ = tables(spark)
    newest = {r["record_name"]: r["schema_id"] for r in config.latest_revisions(registry).collect()}
    assert newest["AccountChangeEvent"] == "V2"
    seen = spark.createDataFrame([("V2", "x"), ("V3", "new"), ("V3", "new")],
                                 "schema_id string, record_name string")
    known = config.register(registry, seen)
    assert known.filter("schema_id = 'V3'").count() == 1 and known.count() == 6
    events = spark.createDataFrame([("V1", 1), ("V2", 2), ("L1", 3)], "schema_id string, at int")
    linked = config.relink(bindings, registry, events, F.col("at"))
    assert {r["id"]: r["avro_schema_id"] for r in linked.collect()} == {1: 2, 2: 3, 3: 4, 4: None}
    plan = config.bound_revisions(bindings, registry).unionByName(
        config.bound_revisions(bindings.withColumn("avro_schema_id", F.lit(2)).filter("id = 1"), registry))
    current = routing.current_revisions(plan.filter("schema_id IS NOT NULL"), F.col("avro_schema_id"))
    assert {r["entity_name"]: r["schema_id"] for r in current.collect()}["AccountChangeEvent"] == "V2"


def test_mapping_scans(spark):
    mappings = spark.createDataFrame(
        [(1, 1, "MappedSFKey", "id"), (2, 1, "A", "a"), (3, 1, "A", "a2"), (4, 2, "B", "b")],
        "id int, binding_id int, source_field string, target_column string")
    maps = {r["binding_id"]: r["fields"] for r in config.field_maps(mappings).collect()}
    assert maps == {1: {"MappedSFKey": "id", "A": "a2"}, 2: {"B": "b"}}
    summary = {r["binding_id"]: (r["key_column"], r["field_mappings"])
               for r in config.mapping_summary(mappings).collect()}
    assert summary == {1: ("id", 2), 2: (None, 1)}


def test_selectable_entities(spark):
    rows = spark.createDataFrame([
        ("bChangeEvent", None, True), ("BChangeEvent", "B", True), ("Order__e", " ", True),
        ("0Ab", "x", True), (" ", "x", True), ("OffChangeEvent", "x", False), (None, "x", True)],
        "value string, label string, active boolean")
    assert [tuple(r) for r in config.selectable_entities(rows).collect()] == [
        ("BChangeEvent", "B"), ("Order__e", "Order__e"), ("bChangeEvent", "bChangeEvent")]
    assert [r["value"] for r in config.selectable_entities(rows, "EVENT").collect()] == ["Order__e"]
    assert config.selectable_entities(rows, "data").count() == 2


def test_backfilled_state(spark):
    rows = spark.createDataFrame(
        [("Incomplete", None), ("Incomplete", ""), ("Incomplete", "t"), ("Inactive", "t")],
        "s string, t string").coalesce(1)
    assert [r[0] for r in rows.select(config.backfilled_state(F.col("s"), F.col("t"))).collect()] == [
        "Incomplete", "Incomplete", "Active", "Inactive"]


def test_soft_delete_needs_switch_and_column(spark):
    rows = spark.createDataFrame(
        [(True, "f"), (True, " "), (True, None), (False, "f"), (None, "f")], "e boolean, c string"
    ).coalesce(1)
    assert [r[0] for r in rows.select(routing.marks_deleted(F.col("e"), F.col("c"))).collect()] == [
        True, False, False, False, False]


def test_suggested_columns(spark):
    fields = spark.createDataFrame(
        [(1, "BillingAddressCity", "Text"), (1, "Phone", "Phone"), (1, "Some_Date__c", "DateOnly"),
         (1, "Id", "EntityId"), (1, "Fax", "Phone")],
        "binding_id int, field string, field_type string")
    columns = spark.createDataFrame(
        [(1, "billing_address_city", 1), (1, "BillingAddressCity", 2), (1, "phone", 3),
         (1, "some_date", 4), (1, "fax", 5)], "binding_id int, column_name string, position int")
    mappings = spark.createDataFrame(
        [(1, "phone", "Phone_No"), (1, "MappedSFKey", "FAX")],
        "binding_id int, source_field string, target_column string")
    got = {r["field"]: (r["mapped_column"], r["suggested_column"])
           for r in catalog.suggested_columns(fields, columns, mappings).collect()}
    assert got == {
        "BillingAddressCity": (None, "billing_address_city"), "Phone": ("Phone_No", None),
        "Some_Date__c": (None, "some_date"), "Id": (None, "sf_id"), "Fax": (None, None)}


def test_versions_in_force_at_each_event(spark):
    versions = spark.createDataFrame(
        [(1, 10, "a"), (1, 20, "b"), (1, 20, "c"), (1, None, "never"), (2, 5, "x")], "binding int, since int, state string")
    events = spark.createDataFrame([(1, 9), (1, 10), (1, 19), (1, 20), (1, 99), (2, 5), (3, 7), (1, None)], "binding int, at int")
    got = {(r["binding"], r["at"]): r["state"] for r in config.as_of(
        events, versions, ["binding"], "since", F.col("at")).collect()}
    assert got == {(1, 9): None, (1, 10): "a", (1, 19): "a", (1, 20): "c", (1, 99): "c", (2, 5): "x", (3, 7): None,
                   (1, None): None}
    assert config.as_of(events, versions, ["binding"], "since", F.col("at")).columns == ["binding", "at", "since", "state"]
