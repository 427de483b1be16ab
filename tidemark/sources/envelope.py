"""Event envelopes: landed batches and streams of change events.

Every reader returns the same columns: ``event_id, schema_id, payload, headers,
replay_id``, with the payload still encoded and the replay id as a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.convert import replay_position

ENVELOPE = (
    "event_id string, schema_id string, payload binary, "
    "headers array<struct<key: string, value: binary>>, replay_id bigint"
)
TEXT_EVENT = (
    "event struct<id: string, schemaId: string, payload: string, "
    "headers: array<struct<key: string, value: string>>>, replayId string"
)
BYTES_EVENT = (
    "Event struct<Id: string, SchemaId: string, Payload: array<int>, "
    "Headers: array<struct<Key: string, Value: array<int>>>>, ReplayId array<int>"
)
RESPONSE = (
    "events array<struct<event: struct<id: string, schemaId: string, payload: string, "
    "headers: array<struct<key: string, value: string>>>, replayId: string>>, "
    "latestReplayId string, rpcId string, pendingNumRequested int"
)


def _bytes(numbers: Column) -> Column:
    """An array of byte values as binary."""
    pairs = F.array(*[F.lit(f"{b:02X}") for b in range(256)])
    return F.unhex(F.array_join(F.transform(
        numbers, lambda b: F.coalesce(F.get(pairs, b), F.lpad(F.hex(b), 2, "0"))), ""))


def _text_events(rows: DataFrame) -> DataFrame:
    headers = F.transform(
        "event.headers",
        lambda h: F.struct(h["key"].alias("key"), F.unbase64(h["value"]).alias("value")),
    )
    return rows.select(
        F.col("event.id").alias("event_id"),
        F.col("event.schemaId").alias("schema_id"),
        F.unbase64("event.payload").alias("payload"),
        headers.alias("headers"),
        replay_position(F.unbase64("replayId")).alias("replay_id"),
    )


def from_responses(responses: DataFrame) -> DataFrame:
    """Rows of fetch responses, each holding an ``events`` array."""
    return _text_events(responses.select(F.explode("events").alias("e")).select("e.*"))


def from_event_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """One JSON event per text row: the form to land a large feed in, as it splits."""
    return _text_events(lines.select(F.from_json(column, TEXT_EVENT).alias("e")).select("e.*"))


def from_response_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """One JSON fetch response per text row."""
    return from_responses(lines.select(F.from_json(column, RESPONSE).alias("r")).select("r.*"))


def from_byte_events(rows: DataFrame) -> DataFrame:
    """Events whose payload and replay id are arrays of byte values."""
    headers = F.transform(
        "Event.Headers",
        lambda h: F.struct(h["Key"].alias("key"), _bytes(h["Value"]).alias("value")),
    )
    return rows.select(
        F.col("Event.Id").alias("event_id"),
        F.col("Event.SchemaId").alias("schema_id"),
        _bytes(F.col("Event.Payload")).alias("payload"),
        headers.alias("headers"),
        replay_position(_bytes(F.col("ReplayId"))).alias("replay_id"),
    )


def from_byte_event_json(lines: DataFrame, column: str = "value") -> DataFrame:
    return from_byte_events(lines.select(F.from_json(column, BYTES_EVENT).alias("e")).select("e.*"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that each hold one fetch response."""
    return from_responses(spark.read.schema(RESPONSE).option("multiLine", True).json(path))


def read_event_arrays(spark: SparkSession, path: str) -> DataFrame:
    """JSON files that each hold an array of events."""
    return _text_events(spark.read.schema(TEXT_EVENT).option("multiLine", True).json(path))


def read_byte_event_arrays(spark: SparkSession, path: str) -> DataFrame:
    return from_byte_events(spark.read.schema(BYTES_EVENT).option("multiLine", True).json(path))


def read_payload_text(spark: SparkSession, path: str, schema_id: str) -> DataFrame:
    """Text files with one base64 payload per line and nothing around it."""
    return spark.read.text(path).select(
        F.lit(None).cast("string").alias("event_id"),
        F.lit(schema_id).alias("schema_id"),
        F.unbase64(F.trim("value")).alias("payload"),
        F.array().cast("array<struct<key: string, value: binary>>").alias("headers"),
        F.lit(None).cast("bigint").alias("replay_id"),
    )


def stream_envelopes(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of landed Parquet envelopes; the limit bounds a micro-batch."""
    reader = spark.readStream.schema(ENVELOPE)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def stream_event_json(
    spark: SparkSession, path: str, files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of landed JSON lines, one event each."""
    reader = spark.readStream.schema("value string")
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return from_event_json(reader.text(path))


def starting_from(events: DataFrame, preset: str, replay_id: int | None = None) -> DataFrame:
    """Events after a start position.

    EARLIEST keeps all and CUSTOM those after ``replay_id``. LATEST keeps those
    after the position that was newest when reading began, given as ``replay_id``.
    """
    if preset == "EARLIEST":
        return events
    if preset not in ("LATEST", "CUSTOM"):
        raise ValueError(f"unknown start position {preset!r}")
    if replay_id is None:
        raise ValueError(f"{preset} needs the position to start after")
    return events.filter(F.col("replay_id") > F.lit(replay_id))
