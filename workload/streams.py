"""Streams of encoded events over several batches: outcomes at the table, revisions that
become known on the way, and many tables at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import run_folder
from tidemark.sources import envelope
from tidemark.streaming.pipeline import ChangeApplier, Configuration, planned_bindings, start
from workload import encode, feeds, payloads
from workload.judging import EVENT_SQL
from workload.payloads import CHANGES_SQL, COLUMNS, SCHEMA_ID, binding, encoded, plain
from workload.registry import query

BATCHES = 3


def in_order(events, root, applier):
    """Land events in the order of their positions, a share at a time, and apply what has landed:
    each run of the stream resumes from the checkpoint of the one before.
    """
    events = events.withColumn("headers", F.array().cast("array<struct<key: string, value: binary>>"))
    events = events.select("event_id", "schema_id", "payload", "headers", "replay_id")
    events.write.parquet(f"{root}/encoded")
    made = events.sparkSession.read.schema(events.schema).parquet(f"{root}/encoded")
    cuts = made.agg(F.percentile_approx("replay_id", [i / BATCHES for i in range(1, BATCHES)])).first()[0]
    share = reduce(lambda a, b: a + b, [(F.col("replay_id") > c).cast("int") for c in cuts])
    for number in range(BATCHES):
        made.filter(share == number).write.mode("append").parquet(f"{root}/landed")
        stream = envelope.stream_envelopes(events.sparkSession, f"{root}/landed", files_per_trigger=1_000)
        start(stream, applier.apply, f"{root}/checkpoint").awaitTermination()
    return applier


@query("stream_outcomes_at_table", EVENT_SQL.replace("SELECT 'e' || ord AS event_id, count(*) AS ids,", """
SELECT change_type, outcome, count(*) AS events FROM (SELECT max(kind) AS change_type,""").replace(
    "FROM j GROUP BY ord", "FROM j GROUP BY ord) GROUP BY 1, 2"))
def stream_outcomes_at_table(spark, sf):
    root = run_folder(spark, "stream-asked")
    applier = in_order(encoded(spark, sf), root, ChangeApplier(spark, f"{root}/state", payloads.configuration))
    return applier.outcomes().groupBy("change_type", "outcome").agg(F.sum("events").alias("events"))


def unknown_at_first(spark):
    """The configuration with an empty registry: every revision has to be looked up."""
    known = payloads.configuration(spark)
    source = known.registry.drop("id")
    bindings = known.bindings.withColumn("avro_schema_id", F.lit(None).cast("bigint"))
    return Configuration(known.registry.limit(0), bindings, known.mappings, known.channels, known.members, {}, source)


def first_revisions(spark, sf, name):
    root = run_folder(spark, name)
    return in_order(encoded(spark, sf), root, ChangeApplier(spark, f"{root}/state", unknown_at_first, ask_table=False))


@query("stream_registration", f"""
WITH seen AS (SELECT {SCHEMA_ID} AS schema_id, o_orderkey AS ord FROM orders)
SELECT schema_id, '{encode.ENTITY}' AS record_name,
  schema_id = (SELECT arg_max(schema_id, ord) FROM seen) AS linked FROM seen GROUP BY 1""")
def stream_registration(spark, sf):
    applier = first_revisions(spark, sf, "stream-registration")
    settings = unknown_at_first(spark)
    current = applier.revisions.current(settings.bindings, settings.registry).select(
        "schema_id", F.lit(True).alias("_linked"))
    return applier.revisions.registered().join(current, "schema_id", "left").select(
        "schema_id", "record_name", F.coalesce("_linked", F.lit(False)).alias("linked"))


@query("stream_first_revisions", feeds.fold_sql(CHANGES_SQL, "record_id", COLUMNS))
def stream_first_revisions(spark, sf):
    return plain(first_revisions(spark, sf, "stream-first").table(binding()).rows())


TABLES = 5


def many(spark):
    """One entity, binding and table for each remainder of a customer's number."""
    registry = [(10 * t + i, f"{s}-{t}", f"Customer{t}ChangeEvent", text, i)
                for t in range(TABLES) for i, (s, text) in enumerate(encode.REVISIONS.items(), 1)]
    bindings = [(t + 1, 10 * t + 1, f"Customer{t}ChangeEvent", f"sales.customer{t}", "Active", False, None)
                for t in range(TABLES)]
    mappings = [(100 * t + i, t + 1, s, c) for t in range(TABLES)
                for i, (s, c) in enumerate(encode.MAPPINGS.items())]
    one = payloads.configuration(spark)
    return Configuration(
        spark.createDataFrame(registry, one.registry.schema), spark.createDataFrame(bindings, one.bindings.schema),
        spark.createDataFrame(mappings, one.mappings.schema), one.channels,
        spark.createDataFrame([(1, b[2].lower()) for b in bindings], one.members.schema), {})


@query("stream_many_tables", feeds.fold_sql(CHANGES_SQL.replace(
    "SELECT k, ev.ord", f"SELECT (ev.o_custkey % {TABLES}) || '/' || k AS k, ev.ord"), "record_id", COLUMNS))
def stream_many_tables(spark, sf):
    root = run_folder(spark, "stream-many")
    # The remainder of the customer's number, which each payload's first record id ends with.
    events = encoded(spark, sf, t=f"o_custkey % {TABLES}").withColumn(
        "schema_id", F.concat("schema_id", F.lit("-"), "t"))
    applier = in_order(events, root, ChangeApplier(spark, f"{root}/state", many, ask_table=False))
    planned, _ = planned_bindings(many(spark), list(range(1, TABLES + 1)))
    tables = [applier.table(b).rows().withColumn(
        "record_id", F.concat(F.lit(f"{b.binding_id - 1}/"), "record_id")) for b in planned]
    return plain(reduce(DataFrame.unionByName, tables))
