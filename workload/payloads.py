"""Encoded events: envelopes, decoding, projection and application, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import outcomes
from tidemark.operators.fold import fold
from tidemark.plans import project as p
from tidemark.plans.schema import flatten_structs
from tidemark.session import run_folder, staged
from tidemark.sources import envelope
from tidemark.sources.avro import decode_payloads
from tidemark.sources.tables import KeyedTable
from tidemark.streaming.pipeline import ChangeApplier, Configuration, start
from workload import encode, feeds
from workload.feeds import table
from workload.registry import query

KIND = """CASE o_orderpriority WHEN '1-URGENT' THEN 'CREATE' WHEN '4-NOT SPECIFIED' THEN 'DELETE'
    ELSE 'UPDATE' END"""
STATUS = "CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderstatus END"
SCHEMA_ID = "CASE WHEN o_custkey % 3 = 0 THEN 'R2' ELSE 'R1' END"


def order_events(spark, sf, *more):
    """Orders as events on their customer and on the one at half its number; ``more`` is SQL."""
    def id_of(number):
        return f"'C' || lpad(CAST({number} AS string), 17, '0')"

    return table(spark, sf, "orders").selectExpr(
        "'e' || o_orderkey AS event_id", f"{SCHEMA_ID} AS schema_id", "o_orderkey AS replay_id",
        f"{KIND} AS kind", f"array({id_of('o_custkey')}, {id_of('o_custkey div 2')}) AS ids",
        f"{STATUS} AS status", "o_totalprice AS price",
        "unix_millis(CAST(o_orderdate AS timestamp)) AS ordered_ms",
        "CASE WHEN o_orderstatus <> 'P' THEN 'st' || o_orderkey END AS street",
        "CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END AS latitude",
        f"""CASE WHEN {KIND} <> 'UPDATE' THEN CAST(array() AS array<string>)
            WHEN o_orderstatus = 'F' THEN array('Status', 'TotalPrice')
            WHEN o_orderstatus = 'O' THEN array('OrderDate', 'Home.Street')
            ELSE array('TotalPrice', 'Home.Latitude') END AS changed""", *more,
    )


def encoded(spark, sf, **more):
    """Events with their payloads; ``more`` are columns of integers, given by SQL on an order."""
    # The test table is one file of one row group: spread it before the row-wise encoder.
    events = order_events(spark, sf, *[f"CAST({sql} AS bigint) AS {name}" for name, sql in more.items()])
    spread = events.repartition(spark.sparkContext.defaultParallelism, "replay_id")
    return spread.mapInArrow(encode.encode_orders, ", ".join(
        ["event_id string, schema_id string, replay_id bigint", *[f"{name} bigint" for name in more], "payload binary"]))


CHANGES_SQL = f"""ev AS (
  SELECT o_orderkey AS ord, o_custkey, {KIND} AS kind, o_orderstatus AS s, {STATUS} AS status,
    o_totalprice AS price, o_orderdate AS ordered,
    CASE WHEN o_orderstatus <> 'P' THEN 'st' || o_orderkey END AS street,
    CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END AS latitude FROM orders),
ids AS (
  SELECT ord, 'C' || lpad(CAST(o_custkey AS VARCHAR), 17, '0') AS k FROM ev
  UNION
  SELECT ord, 'C' || lpad(CAST(o_custkey // 2 AS VARCHAR), 17, '0') FROM ev WHERE kind <> 'CREATE'),
changes AS (
  SELECT k, ev.ord, kind, status, price, ordered, street, latitude,
    CASE kind WHEN 'CREATE' THEN status IS NOT NULL WHEN 'UPDATE' THEN s = 'F' ELSE false END AS status_set,
    kind = 'CREATE' OR (kind = 'UPDATE' AND s <> 'O') AS price_set,
    kind = 'CREATE' OR (kind = 'UPDATE' AND s = 'O') AS ordered_set,
    CASE kind WHEN 'CREATE' THEN s <> 'P' WHEN 'UPDATE' THEN s = 'O' ELSE false END AS street_set,
    kind = 'CREATE' AND s <> 'P' AS latitude_set
  FROM ev JOIN ids ON ev.ord = ids.ord)"""
COLUMNS = ["status", "price", "ordered", "street", "latitude"]


def binding(**options):
    return p.plan_binding(1, encode.ENTITY, "sales.customer", encode.MAPPINGS, encode.REVISIONS,
                          "R2", **options)


def plain(df):
    return df.withColumn("ordered", F.col("ordered").cast("timestamp_ntz"))


def projected(spark, sf, **options):
    chosen = binding(**options)
    return p.project(p.decode_binding(encoded(spark, sf), chosen), chosen), chosen


@query("decode_roundtrip", f"""
SELECT 'e' || o_orderkey AS event_id, 'C' || lpad(CAST(o_custkey AS VARCHAR), 17, '0') AS first_id,
  {KIND} AS kind, CAST(1 AS INTEGER) AS sequence, 12279648331300 AS commit_number, {STATUS} AS status,
  o_totalprice AS price, epoch_ms(o_orderdate) AS ordered_ms,
  CASE WHEN o_orderstatus <> 'P' THEN 'st' || o_orderkey END AS street,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice / 1000 END AS latitude,
  o_orderstatus <> 'P' AS has_home, CAST(NULL AS VARCHAR) AS decode_error FROM orders""")
def decode_roundtrip(spark, sf):
    wanted = {"Status": "string", "TotalPrice": "double", "OrderDate": "long",
              "HomeStreet": "string", "HomeLatitude": "double"}
    rows = decode_payloads(encoded(spark, sf), encode.REVISIONS, wanted)
    return rows.select(
        "event_id", F.get("header.recordIds", F.lit(0)).alias("first_id"),
        F.col("header.changeType").alias("kind"), F.col("header.sequenceNumber").alias("sequence"),
        F.col("header.commitNumber").alias("commit_number"), F.col("fields.Status").alias("status"),
        F.col("fields.TotalPrice").alias("price"), F.col("fields.OrderDate").alias("ordered_ms"),
        F.col("fields.HomeStreet").alias("street"), F.col("fields.HomeLatitude").alias("latitude"),
        F.coalesce("compounds.Home", F.lit(False)).alias("has_home"), "decode_error")


@query("decode_errors", f"""
SELECT CASE WHEN o_orderkey % 10 = 3 THEN CASE WHEN o_custkey % 3 = 0 AND {STATUS} IS NOT NULL
      THEN 'bad length' ELSE 'truncated' END
    WHEN o_orderkey % 10 = 4 THEN 'trailing bytes' WHEN o_orderkey % 10 = 5 THEN 'no schema'
    WHEN o_orderkey % 10 = 6 THEN 'no payload' END AS decode_error,
  count(*) AS events FROM orders GROUP BY 1""")
def decode_errors(spark, sf):
    kind = F.col("replay_id") % 10
    payload = F.col("payload")
    damaged = (
        F.when(kind == 3, F.substring(payload, F.lit(1), F.length(payload) - 1))
        .when(kind == 4, F.concat(payload, F.unhex(F.lit("00"))))
        .when(kind != 6, payload)
    )
    schema_id = F.when(kind == 5, F.lit("R9")).otherwise(F.col("schema_id"))
    events = encoded(spark, sf).withColumns({"payload": damaged, "schema_id": schema_id})
    rows = decode_payloads(events, encode.REVISIONS, {"Status": "string"})
    return outcomes.outcome_counts(rows, ["decode_error"])


@query("event_changes", f"""WITH {CHANGES_SQL}
SELECT k AS record_id, ord AS replay_id, kind AS change_type,
  CASE WHEN status_set THEN status END AS status, CASE WHEN price_set THEN price END AS price,
  CASE WHEN ordered_set THEN ordered END AS ordered, CASE WHEN street_set THEN street END AS street,
  CASE WHEN latitude_set THEN latitude END AS latitude, status_set, price_set, ordered_set,
  street_set, latitude_set FROM changes""")
def event_changes(spark, sf):
    rows, chosen = projected(spark, sf)
    changes = p.change_rows(rows, chosen)
    out = changes.select(
        "record_id", F.col(p.ORDER).alias("replay_id"), F.col(p.KIND).alias("change_type"),
        *[F.when(F.col(c + "__set"), F.col(c)).alias(c) for c in COLUMNS],
        *[F.col(c + "__set").alias(c + "_set") for c in COLUMNS])
    return plain(out)


@query("apply_events", feeds.fold_sql(CHANGES_SQL, "record_id", COLUMNS))
def apply_events(spark, sf):
    rows, chosen = projected(spark, sf)
    changes = staged(p.change_rows(rows, chosen), "changes")
    return plain(fold(changes, chosen.fold_spec()))


@query("apply_events_soft", feeds.fold_sql(CHANGES_SQL, "record_id", COLUMNS, True))
def apply_events_soft(spark, sf):
    rows, chosen = projected(spark, sf, flag="is_deleted")
    changes = staged(p.change_rows(rows, chosen), "changes")
    return plain(fold(changes, chosen.fold_spec()))


@query("null_compound_children", f"""
SELECT 'e' || o_orderkey AS event_id, o_orderstatus = 'O' AS street_set, o_orderstatus = 'P' AS latitude_set
FROM orders WHERE {KIND} = 'UPDATE'""")
def null_compound_children(spark, sf):
    rows, _ = projected(spark, sf, null_compound="null_children")
    return rows.filter("header.changeType = 'UPDATE'").select(
        "event_id", F.col("written.street").alias("street_set"),
        F.col("written.latitude").alias("latitude_set"))


def oddly_typed(spark, sf):
    """The events with other change types, broken bitmaps and missing ids mixed in."""
    chosen = binding()
    decoded = p.decode_binding(encoded(spark, sf), chosen)
    odd = F.col("replay_id") % 8
    kind = (
        F.when(odd == 1, "SNAPSHOT").when(odd == 2, "GAP_DELETE").when(odd == 3, "UNDELETE")
        .when(odd == 4, F.lit(None)).otherwise(F.col("header.changeType"))
    )
    ids = F.when(odd != 5, F.col("header.recordIds")).otherwise(F.array().cast("array<string>"))
    entries = F.when(odd == 6, F.array(F.lit("x-0x01"))).when(
        odd == 7, F.array(F.lit("0x00"), F.lit(""))).otherwise(F.col("header.changedFields"))
    header = F.col("header").withField("changeType", kind).withField("recordIds", ids).withField(
        "changedFields", entries)
    return p.project(decoded.withColumn("header", header), chosen)


@query("event_outcomes", f"""
SELECT CASE o_orderkey % 8 WHEN 1 THEN 'unknown type' WHEN 2 THEN 'unsupported type'
    WHEN 3 THEN 'undelete skipped' WHEN 4 THEN 'bad header' WHEN 5 THEN 'bad header'
    WHEN 6 THEN CASE WHEN {KIND} = 'UPDATE' THEN 'bad bitmap' ELSE 'applied' END
    WHEN 7 THEN CASE WHEN {KIND} = 'UPDATE' THEN 'no change' ELSE 'applied' END
    ELSE 'applied' END AS outcome, count(*) AS events FROM orders GROUP BY 1""")
def event_outcomes(spark, sf):
    return outcomes.outcome_counts(oddly_typed(spark, sf), ["outcome"])


FREQUENCY_SQL = f"""WITH named AS (
  SELECT unnest(CASE o_orderstatus WHEN 'F' THEN ['Status', 'TotalPrice']
    WHEN 'O' THEN ['OrderDate', 'HomeStreet'] ELSE ['TotalPrice', 'HomeLatitude'] END) AS field
  FROM orders WHERE {KIND} = 'UPDATE')
SELECT 'Customer' AS entity, field, count(*) AS changes FROM named"""


def frequency(spark, sf):
    chosen = binding()
    decoded = p.decode_binding(encoded(spark, sf), chosen)
    return outcomes.changed_frequency(decoded, F.col("header.entityName"), p.changed_names(chosen))


@query("changed_frequency", f"{FREQUENCY_SQL} GROUP BY 2")
def changed_frequency(spark, sf):
    return frequency(spark, sf)


@query("unmapped_report", f"{FREQUENCY_SQL} WHERE field NOT IN ('Status', 'HomeStreet') GROUP BY 2")
def unmapped_report(spark, sf):
    mapped = spark.range(1).select(
        F.lit("Customer").alias("entity"), F.explode(F.array(F.lit("Status"), F.lit("HomeStreet"))).alias("field"))
    return outcomes.unmapped_fields(frequency(spark, sf), mapped)


# Envelopes as text, in each of the shapes they come in.


def with_headers(spark, sf):
    header = F.struct(F.lit("h").alias("key"), F.encode("event_id", "utf-8").alias("value"))
    return encoded(spark, sf).withColumn("headers", F.array(header))


def position_bytes():
    return F.unhex(F.concat(F.lpad(F.hex("replay_id"), 16, "0"), F.lit("0000")))


def text_event():
    headers = F.transform("headers", lambda h: F.struct(
        h["key"].alias("key"), F.base64(h["value"]).alias("value")))
    event = F.struct(F.col("event_id").alias("id"), F.col("schema_id").alias("schemaId"),
                     F.base64("payload").alias("payload"), headers.alias("headers"))
    return F.struct(event.alias("event"), F.base64(position_bytes()).alias("replayId"))


ENVELOPE_SQL = f"""
SELECT 'e' || o_orderkey AS event_id, {SCHEMA_ID} AS schema_id, o_orderkey AS replay_id,
  'e' || o_orderkey AS header, true AS same FROM orders"""


def compared(read, spark, sf):
    """Envelopes read back beside the payloads they were made from."""
    made = encoded(spark, sf).select("event_id", F.col("payload").alias("made"))
    # An inner join would ask for an id in a filter, which writes and parses each envelope once more.
    return read.join(made, "event_id", "left").select(
        "event_id", "schema_id", "replay_id",
        F.decode(F.get("headers", F.lit(0))["value"], "utf-8").alias("header"),
        (F.col("payload") == F.col("made")).alias("same"))


@query("envelope_read", ENVELOPE_SQL)
def envelope_read(spark, sf):
    lines = with_headers(spark, sf).select(F.to_json(text_event()).alias("value"))
    return compared(envelope.from_event_json(lines), spark, sf)


@query("envelope_responses", ENVELOPE_SQL)
def envelope_responses(spark, sf):
    # A response holds at most 25 events, as a fetch does.
    fetched = with_headers(spark, sf).groupBy((F.col("replay_id") / 25).cast("bigint").alias("fetch"))
    responses = fetched.agg(F.collect_list(text_event()).alias("events"))
    lines = responses.select(F.to_json(F.struct(
        "events", F.lit("").alias("latestReplayId"), F.lit(1).alias("pendingNumRequested")
    )).alias("value"))
    return compared(envelope.from_response_json(lines), spark, sf)


def byte_list(value):
    # In Latin-1 a byte is the character of its number.
    characters = F.split(F.decode(value, "iso-8859-1"), "")
    return F.when(F.length(value) > 0, F.transform(characters, lambda c: F.ascii(c))).otherwise(
        F.when(value.isNotNull(), F.array().cast("array<int>")))


@query("envelope_bytes", ENVELOPE_SQL)
def envelope_bytes(spark, sf):
    header = F.struct(F.lit("h").alias("Key"), byte_list(F.encode("event_id", "utf-8")).alias("Value"))
    event = F.struct(F.col("event_id").alias("Id"), F.col("schema_id").alias("SchemaId"),
                     byte_list(F.col("payload")).alias("Payload"), F.array(header).alias("Headers"))
    lines = encoded(spark, sf).select(F.to_json(F.struct(
        event.alias("Event"), byte_list(position_bytes()).alias("ReplayId"))).alias("value"))
    return compared(envelope.from_byte_event_json(lines), spark, sf)


@query("start_position", """
SELECT 'e' || o_orderkey AS event_id FROM orders WHERE o_orderkey > 5000""")
def start_position(spark, sf):
    return envelope.starting_from(encoded(spark, sf), "CUSTOM", 5000).select("event_id")


# Streams. Each finishes inside the call and leaves its result in the shared folder.

# Together they take in every row, whatever its time, and those without one.
PARTS = ["ts < timestamp_ntz'2024-01-10'",
         "ts >= timestamp_ntz'2024-01-10' AND ts < timestamp_ntz'2024-01-20'",
         "ts >= timestamp_ntz'2024-01-20' OR ts IS NULL"]


def stream_users(spark, sf, spec, name):
    """Land the feed in three parts, applying what has landed after each: the second and
    third run resume from the checkpoint the one before left.
    """
    root = run_folder(spark, name)
    changes = feeds.user_changes(spark, sf)
    state = KeyedTable(spark, f"{root}/table", spec, at_least=1000)
    for when in PARTS:
        changes.filter(when).write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema(changes.schema).parquet(f"{root}/landed")
        start(stream, state.apply, f"{root}/checkpoint").awaitTermination()
    return state.rows()


@query("stream_foreach", feeds.fold_sql(feeds.USER_CHANGES_SQL, "user_id", ["value", "props"]))
def stream_foreach(spark, sf):
    return stream_users(spark, sf, feeds.USER_SPEC, "stream-hard")


@query("stream_foreach_soft",
       feeds.fold_sql(feeds.USER_CHANGES_SQL, "user_id", ["value", "props"], True))
def stream_foreach_soft(spark, sf):
    return stream_users(spark, sf, feeds.USER_SOFT, "stream-soft")


def late_users(spark, sf, spec, name, at_least):
    """The feed in three batches dealt out by a hash, so that most changes come late."""
    state = KeyedTable(spark, run_folder(spark, name), spec, at_least=at_least, share=0.1)
    changes = feeds.user_changes(spark, sf)
    for number in range(3):
        state.apply(changes.filter(F.pmod(F.xxhash64(*spec.order), F.lit(3)) == number), number)
    return state.rows()


LATE_SQL = feeds.fold_sql(feeds.USER_CHANGES_SQL, "user_id", ["value", "props"])


@query("table_late_changes", LATE_SQL)
def table_late_changes(spark, sf):
    return late_users(spark, sf, feeds.USER_SPEC, "late-folded", 0)


@query("table_late_changes_pending", LATE_SQL)
def table_late_changes_pending(spark, sf):
    return late_users(spark, sf, feeds.USER_SPEC, "late-pending", 1 << 60)


@query("table_late_changes_soft",
       feeds.fold_sql(feeds.USER_CHANGES_SQL, "user_id", ["value", "props"], True))
def table_late_changes_soft(spark, sf):
    return late_users(spark, sf, feeds.USER_SOFT, "late-soft", 0)


@query("stream_restart", LATE_SQL)
def stream_restart(spark, sf):
    """Each part of the feed as a stream with a checkpoint of its own, numbered from 0 again."""
    root = run_folder(spark, "stream-restart")
    changes = feeds.user_changes(spark, sf)
    state = KeyedTable(spark, f"{root}/table", feeds.USER_SPEC, at_least=1000)
    for number, when in enumerate(PARTS):
        changes.filter(when).write.parquet(f"{root}/landed-{number}")
        stream = spark.readStream.schema(changes.schema).parquet(f"{root}/landed-{number}")
        start(stream, state.apply, f"{root}/checkpoint-{number}").awaitTermination()
    return state.rows()


def configuration(spark):
    registry = spark.createDataFrame(
        [(i, s, encode.ENTITY, text, i) for i, (s, text) in enumerate(encode.REVISIONS.items(), 1)],
        "id bigint, schema_id string, record_name string, schema_json string, date_created int")
    bindings = spark.createDataFrame(
        [(1, 1, encode.ENTITY, "sales.customer", "Active", False, None)],
        "id bigint, avro_schema_id bigint, entity_name string, target_table string, state string, "
        "soft_delete_enabled boolean, soft_delete_column string")
    mappings = spark.createDataFrame(
        [(i, 1, s, t) for i, (s, t) in enumerate(encode.MAPPINGS.items())],
        "id bigint, binding_id bigint, source_field string, target_column string")
    channels = spark.createDataFrame([(1, "All__chn", True)], "id int, full_name string, is_primary boolean")
    members = spark.createDataFrame([(1, encode.ENTITY.lower())], "channel_id int, selected_entity string")
    return Configuration(registry, bindings, mappings, channels, members, {})


def apply_stream(spark, sf, name):
    root = run_folder(spark, name)
    encoded(spark, sf).withColumn("headers", F.array().cast(
        "array<struct<key: string, value: binary>>")).select(
        "event_id", "schema_id", "payload", "headers", "replay_id").write.parquet(f"{root}/landed")
    applier = ChangeApplier(spark, f"{root}/state", configuration, ask_table=False)
    files = len(spark.read.parquet(f"{root}/landed").inputFiles())
    # At least three batches where there are as many files.
    stream = envelope.stream_envelopes(spark, f"{root}/landed", files_per_trigger=max(1, -(-files // 3)))
    start(stream, applier.apply, f"{root}/checkpoint").awaitTermination()
    return applier


@query("stream_envelopes", feeds.fold_sql(CHANGES_SQL, "record_id", COLUMNS))
def stream_envelopes(spark, sf):
    return plain(apply_stream(spark, sf, "stream-events").table(binding()).rows())


@query("stream_outcomes", f"""
SELECT 1 AS binding_id, {KIND} AS change_type, 'applied' AS outcome, count(*) AS events
FROM orders GROUP BY 2""")
def stream_outcomes(spark, sf):
    applier = apply_stream(spark, sf, "stream-outcomes")
    return applier.outcomes().groupBy("binding_id", "change_type", "outcome").agg(
        F.sum("events").alias("events"))


@query("flatten_compounds", f"""
SELECT o_orderkey AS "Id", {STATUS} AS "Status", 'st' || o_orderkey AS "HomeStreet",
  o_totalprice / 1000 AS "HomeLatitude" FROM orders""")
def flatten_compounds(spark, sf):
    home = F.struct(F.concat(F.lit("st"), "o_orderkey").alias("Street"),
                    (F.col("o_totalprice") / 1000).alias("Latitude"))
    header = F.struct(F.col("o_orderkey").alias("sequenceNumber"))
    return flatten_structs(table(spark, sf, "orders").select(
        header.alias("ChangeEventHeader"), F.col("o_orderkey").alias("Id"),
        F.expr(STATUS).alias("Status"), home.alias("Home")))
