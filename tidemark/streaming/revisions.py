"""Schema revisions and links of bindings that become known while a stream runs.

Each batch writes what it registers and links under its own number and reads what other
batches have written, so a batch that is run again comes to the same rows and replaces
its own. Nothing here counts upwards: the number of a revision follows from its schema id.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import config, routing

PLACE = "stream string, batch bigint"
REVISION = "id bigint, schema_id string, record_name string, schema_json string, date_created int"
LINK = "binding_id bigint, avro_schema_id bigint, at bigint"


class Revisions:
    """``root`` is on shared storage; ``registry`` and ``links`` under it hold a folder per batch."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(f"{schema}, {PLACE}").parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def _write(self, rows: DataFrame, name: str, stream: str, batch: int) -> None:
        path = f"{self.root}/{name}/stream={stream or 'none'}/batch={batch}"
        rows.coalesce(1).write.mode("overwrite").parquet(path)

    def registered(self) -> DataFrame | None:
        """All revisions that batches have registered, each once."""
        rows = self._read("registry", REVISION)
        if rows is None:
            return None
        one = rows.groupBy("schema_id").agg(
            F.min(F.struct("date_created", "id", "record_name", "schema_json")).alias("_r"))
        return one.select("_r.id", "schema_id", "_r.record_name", "_r.schema_json", "_r.date_created")

    def known(self, registry: DataFrame) -> DataFrame:
        """The configured registry and what batches have added to it."""
        added = self.registered()
        return registry if added is None else config.register(registry, added)

    def register(self, registry: DataFrame, events: DataFrame, source: DataFrame, stream: str, batch: int) -> DataFrame:
        """The registry with the revisions that ``events`` name first and ``source`` (schema_id,
        record_name, schema_json, date_created) has the text of. Ids without one stay unknown.
        """
        # Another run of this batch may have registered some; they count as new again.
        mine = (F.col("stream") == (stream or "none")) & (F.col("batch") == batch)
        earlier = self._read("registry", REVISION)
        if earlier is not None:
            registry = config.register(registry, earlier.filter(~mine).drop("stream", "batch"))
        seen = events.select("schema_id").distinct().join(registry.select("schema_id"), "schema_id", "left_anti")
        found = source.join(seen, "schema_id", "left_semi").groupBy("schema_id").agg(
            F.min(F.struct("record_name", "schema_json", "date_created")).alias("_r"))
        fresh = found.select(
            F.xxhash64("schema_id").bitwiseAND(F.lit((1 << 62) - 1)).alias("id"), "schema_id", "_r.record_name",
            "_r.schema_json", F.col("_r.date_created").cast("int").alias("date_created"))
        # As many rows as revisions are new: the shapes of entities, not their events.
        rows = fresh.collect()
        mine_before = earlier is not None and not earlier.filter(mine).isEmpty()
        fresh = self.spark.createDataFrame(rows, REVISION)
        if rows or mine_before:
            self._write(fresh, "registry", stream, batch)
        return config.register(registry, fresh) if rows else registry

    def linked(self, bindings: DataFrame, stream: str, batch: int) -> DataFrame:
        """Bindings with the revision that events before this batch have linked them to."""
        links = self._read("links", LINK)
        if links is None:
            return bindings
        mine = (F.col("stream") == (stream or "none")) & (F.col("batch") >= batch)
        newest = links.filter(~mine).groupBy("binding_id").agg(F.max_by("avro_schema_id", "at").alias("_linked"))
        joined = bindings.join(newest, F.col("id") == F.col("binding_id"), "left")
        return joined.withColumn("avro_schema_id", F.coalesce("_linked", "avro_schema_id")).select(*bindings.columns)

    def link(self, bindings: DataFrame, registry: DataFrame, events: DataFrame, stream: str, batch: int) -> None:
        """Store which bindings the events of this batch link to another revision."""
        newest = config.newest_named(registry, events, F.col("replay_id"))
        changed = bindings.join(newest, "entity_name").filter(
            ~F.col("revision").eqNullSafe(F.col("avro_schema_id")))
        # One row per binding at most.
        rows = changed.select(F.col("id").cast("bigint").alias("binding_id"), F.col("revision").cast("bigint").alias(
            "avro_schema_id"), F.col("at").cast("bigint").alias("at")).collect()
        if rows:
            self._write(self.spark.createDataFrame(rows, LINK), "links", stream, batch)

    def current(self, bindings: DataFrame, registry: DataFrame) -> DataFrame:
        """``entity_name, schema_id``: the one revision of each entity that counts, all told."""
        links = self._read("links", LINK)
        newest = bindings.select(F.col("id").alias("binding_id"), "avro_schema_id", F.lit(-1).cast("bigint").alias("at"))
        if links is not None:
            newest = newest.unionByName(links.select(*newest.columns))
        newest = newest.groupBy("binding_id").agg(F.max_by("avro_schema_id", "at").alias("_linked"), F.max("at").alias("at"))
        plan = bindings.join(newest, F.col("id") == F.col("binding_id")).join(
            self.known(registry).select(F.col("id").alias("_linked"), "schema_id"), "_linked")
        return routing.current_revisions(plan, F.struct("at", "_linked"))
