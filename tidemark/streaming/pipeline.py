"""Apply a stream of change events to keyed tables, micro-batch by micro-batch.

A micro-batch is applied completely before the next is read. Its number names
everything it writes, so a batch that is run again after a failure overwrites
its own files and a table that already has it is left alone.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark import fixed
from tidemark.operators.fold import LAST_ORDER, LIVE, SET_SUFFIX, FoldSpec
from tidemark.operators.judge import judged, per_event
from tidemark.operators.outcomes import outcome_counts
from tidemark.plans import config, routing
from tidemark.plans.project import KIND, ORDER, Binding, applied_ids, decode_binding, plan_binding, project
from tidemark.plans.schema import parse_schema
from tidemark.sizing import broadcast_if_small
from tidemark.sources.tables import EMPTY, CommitLog, KeyedTable, delete
from tidemark.streaming.revisions import Revisions


@dataclass
class Configuration:
    """The configuration tables, read anew for every micro-batch."""

    registry: DataFrame
    bindings: DataFrame
    mappings: DataFrame
    channels: DataFrame
    members: DataFrame
    families: dict[str, dict[str, str]]
    # Where texts of revisions are looked up that the registry lacks (schema_id, record_name,
    # schema_json, date_created); without it their events are listed as unknown.
    source: DataFrame | None = None


def readable(revisions: list[Row]) -> dict[str, str]:
    """Schema texts that can be read; events of the others fail one by one."""
    out = {}
    for r in revisions:
        try:
            parse_schema(r["schema_json"])
        except (ValueError, KeyError, TypeError):
            continue
        out[r["schema_id"]] = r["schema_json"]
    return out


def planned_bindings(
    settings: Configuration, binding_ids: list[int]
) -> tuple[list[Binding], dict[int, str]]:
    """Work out the bindings a batch has events for, and why some cannot be applied.

    Reads only the configuration of those bindings.
    """
    bindings = settings.bindings.filter(F.col("id").isin(binding_ids)).collect()
    entities = [b["entity_name"] for b in bindings]
    mappings = settings.mappings.filter(F.col("binding_id").isin(binding_ids)).collect()
    maps: dict[int, dict[str, str]] = {}
    for m in sorted(mappings, key=lambda m: m["id"]):
        maps.setdefault(m["binding_id"], {})[m["source_field"]] = m["target_column"]
    revisions = settings.registry.filter(F.col("record_name").isin(entities)).collect()
    revisions.sort(key=lambda r: (r["date_created"] is not None, r["date_created"] or 0, r["id"]))
    planned, refused = [], {}
    for b in bindings:
        own = readable([r for r in revisions if r["record_name"] == b["entity_name"]])
        if fixed.KEY_MAPPING_FIELD not in maps.get(b["id"], {}):
            refused[b["id"]] = routing.NO_KEY_MAPPING
            continue
        if not own:
            refused[b["id"]] = routing.NO_SCHEMA
            continue
        soft = b["soft_delete_enabled"] and (b["soft_delete_column"] or "").strip()
        families = settings.families.get(b["target_table"], {})
        try:
            planned.append(plan_binding(
                b["id"], b["entity_name"], b["target_table"], maps[b["id"]], own, list(own)[-1],
                families, flag=b["soft_delete_column"] if soft else None,
                flag_family=families.get(b["soft_delete_column"], "Boolean") if soft else "Boolean",
            ))
        except ValueError:
            refused[b["id"]] = routing.BAD_MAPPING
    return planned, refused


# Rows that all bindings have in common; the columns of a binding's table are in a struct of its own.
COMMON = f"event_id string, {ORDER} bigint, {KIND} string, outcome string, first boolean, key string, binding_id bigint"
TOGETHER = 32  # bindings written by one job: what a file has of others' columns stays bounded


def struct_name(binding: Binding) -> str:
    return f"b{binding.binding_id}"


def table_rows(routed: DataFrame, binding: Binding) -> DataFrame:
    """One row per record id of every event of a binding, and one per event that is not applied.

    ``first`` marks one row of each event.
    """
    own = routed.filter(F.col("binding_id") == binding.binding_id)
    rows = project(decode_binding(own, binding), binding)
    ids = applied_ids(F.col("header.recordIds"), F.col("header.changeType"))
    applies = F.col("outcome") == routing.APPLIED
    columns = [F.col("target")[c].alias(c) for c in binding.columns]
    columns += [F.col("written")[c].alias(c + SET_SUFFIX) for c in binding.columns]
    values = F.when(applies, F.struct(*columns)) if columns else F.struct(F.lit(None).cast("string").alias("none"))
    return rows.select(
        "event_id", F.col("replay_id").alias(ORDER), F.col("header.changeType").alias(KIND), "outcome",
        F.posexplode(F.when(applies, ids).otherwise(F.array(F.lit(None).cast("string")))).alias("_place", "key"),
        values.alias(struct_name(binding)), F.lit(binding.binding_id).cast("bigint").alias("binding_id"),
    ).withColumn("first", F.col("_place") == 0).drop("_place")


class ChangeApplier:
    """Applies batches of envelopes to the tables their bindings name.

    ``root`` must be on storage the executors share. Under it: ``tables`` holds
    the folded tables and ``commits`` what they consist of; ``changes`` the change rows of
    every batch until they are folded, those of all bindings written by one job;
    ``outcomes`` counts of what became of the events of every batch, ``quarantine`` the
    events that were not applied, ``registry`` and ``links`` the revisions that became known,
    and ``batches`` the routed events a batch is computed from, kept as files so that
    a lost executor costs a re-read, for ``keep`` batches.

    With ``ask_table`` an event's outcome is what it met at its table: it may have been
    refused, have found no row, or have come late. That reads keys and last orders of the tables
    a batch has changes for. Without, an event that goes to its table counts as applied.
    """

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        configuration: Callable[[SparkSession], Configuration],
        keep: int = 10,
        ask_table: bool = True,
        **table_options,
    ):
        self.spark, self.root, self.table_options = spark, root.rstrip("/"), table_options
        self.keep, self.ask_table = keep, ask_table
        self.configuration = configuration
        self.revisions = Revisions(spark, self.root)
        self.log = CommitLog(spark, f"{self.root}/commits", keep)

    def table(self, binding: Binding) -> KeyedTable:
        path = f"{self.root}/tables/{binding.table}"
        return KeyedTable(self.spark, path, binding.fold_spec(), log=self.log, shared=struct_name(binding),
                          **self.table_options)

    def apply(self, events: DataFrame, batch_id: int, stream: str = "") -> None:
        """Apply a batch; ``stream`` tells the numbers of one checkpoint from another's.

        All tables take the batch in by one commit, after everything else is written. A
        batch that was committed before is left alone.
        """
        commits = self.log.newest()
        if any(r["streams"].get(stream, -1) >= batch_id for r in commits.values()):
            return
        place = f"stream={stream or 'none'}/batch={batch_id}"
        settings = self.configuration(self.spark)
        registry = self.revisions.known(settings.registry)
        if settings.source is not None:
            registry = self.revisions.register(settings.registry, events, settings.source, stream, batch_id)
        bindings = self.revisions.linked(settings.bindings, stream, batch_id)
        settings = replace(settings, registry=registry, bindings=bindings)
        routed, present = self._routed(events, settings, place)
        if any(r["route"] == routing.BY_NAME for r in present):
            self.revisions.link(bindings, registry, routed, stream, batch_id)

        wanted = {r["binding_id"] for r in present if r["binding_id"] is not None}
        planned, refused = planned_bindings(settings, sorted(wanted))
        judged = [self._dropped(routed, planned, refused)]
        tables: dict[int, KeyedTable] = {}
        arrived: dict[int, int] = {}
        if planned:
            rows = self._written(routed, planned, place)
            tables = {b.binding_id: self.table(b) for b in planned}
            applied = rows.filter(F.col("outcome") == routing.APPLIED)
            counts = applied.groupBy("binding_id").agg(F.count("*").alias("n")).collect()
            arrived = {r["binding_id"]: r["n"] for r in counts}
            judged += self._judged(rows, planned, tables, commits, arrived)
        self._listed(reduce(DataFrame.unionByName, judged), place)
        self._committed(tables, commits, arrived, place, batch_id, stream)
        # Working files of a batch long completed; the tables keep their own.
        delete(self.spark, f"{self.root}/batches/stream={stream or 'none'}/batch={batch_id - self.keep}")

    def _routed(self, events: DataFrame, settings: Configuration, place: str) -> tuple[DataFrame, list[Row]]:
        """Routed events, written so that every binding reads only its own part, and which
        bindings there are and by which route.
        """
        plan = config.subscription_plan(
            settings.bindings, settings.registry, settings.channels, settings.members
        )
        routed = routing.route(events, plan, settings.registry, settings.bindings)
        path = f"{self.root}/batches/{place}/routed"
        routed.write.mode("overwrite").partitionBy("binding_id").parquet(path)
        routed = self.spark.read.schema(routed.schema).parquet(path)
        return routed, routed.select("binding_id", "route").distinct().collect()

    def _dropped(self, routed: DataFrame, planned: list[Binding], refused: dict[int, str]) -> DataFrame:
        """Events without a binding that can be applied, and why."""
        reason = F.col("route")
        for binding_id, why in refused.items():
            reason = F.when(F.col("binding_id") == binding_id, why).otherwise(reason)
        applied = [b.binding_id for b in planned]
        dropped = routed.filter(F.col("binding_id").isNull() | ~F.col("binding_id").isin(applied))
        return dropped.select(
            F.col("binding_id").cast("bigint").alias("binding_id"), "event_id", "replay_id",
            F.lit(None).cast("string").alias("change_type"), reason.alias("outcome"),
        )

    def _written(self, routed: DataFrame, planned: list[Binding], place: str) -> DataFrame:
        """The change rows of all bindings, decoded once and by one job for up to TOGETHER of them;
        read back without the columns of their tables.
        """
        paths = []
        for at in range(0, len(planned), TOGETHER):
            parts = [table_rows(routed, b) for b in planned[at:at + TOGETHER]]
            paths.append(f"{self.root}/changes/{place}/group={at // TOGETHER}")
            together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
            together.write.mode("overwrite").partitionBy("binding_id").parquet(paths[-1])
        read = [self.spark.read.schema(COMMON).parquet(path) for path in paths]
        return reduce(DataFrame.unionByName, read)

    def _judged(
        self, rows: DataFrame, planned: list[Binding], tables: dict[int, KeyedTable],
        commits: dict[str, Row], arrived: dict[int, int],
    ) -> list[DataFrame]:
        shown = ["binding_id", "event_id", F.col(ORDER).alias("replay_id"), F.col(KIND).alias("change_type"), "outcome"]
        if not self.ask_table:
            return [rows.filter("first").select(*shown)]
        out = [rows.filter(F.col("first") & (F.col("outcome") != routing.APPLIED)).select(*shown)]
        changes = rows.filter(F.col("outcome") == routing.APPLIED).drop("outcome")
        for soft in (False, True):
            own = [b for b in planned if (b.flag is not None) == soft and b.binding_id in arrived]
            if not own:
                continue
            # The tables of all bindings as one, whose key says which.
            spec = FoldSpec(key=("binding_id", "key"), columns=(), order=(ORDER,), kind=KIND,
                            flag="flag" if soft else None)
            mine = changes.filter(F.col("binding_id").isin([b.binding_id for b in own]))
            keys = mine.select("binding_id", "key").distinct()
            states = []
            for b in own:
                manifest = commits.get(tables[b.binding_id].path)
                state = None if manifest is None else tables[b.binding_id].tracked(manifest)
                if state is not None:
                    states.append(state.select(
                        F.lit(b.binding_id).cast("bigint").alias("binding_id"),
                        F.col(b.key_column).cast("string").alias("key"), LIVE, LAST_ORDER))
            before = None
            if states:
                before = reduce(DataFrame.unionByName, states).join(
                    broadcast_if_small(keys), ["binding_id", "key"], "left_semi")
            met = judged(mine, spec, before, keep=("event_id",))
            events = per_event(met, ["binding_id", "event_id", ORDER, KIND])
            out.append(events.select(*shown))
        return out

    def _listed(self, judged_events: DataFrame, place: str) -> None:
        """Counts of what became of the events, and those that were not applied one by one."""
        counts = outcome_counts(judged_events, ["binding_id", "change_type", "outcome"])
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/outcomes/{place}")
        failed = judged_events.filter(~F.col("outcome").isin(routing.APPLIED, routing.NO_CHANGE))
        failed.write.mode("overwrite").parquet(f"{self.root}/quarantine/{place}")

    def _committed(
        self, tables: dict[int, KeyedTable], commits: dict[str, Row], arrived: dict[int, int],
        place: str, batch_id: int, stream: str,
    ) -> None:
        """One commit for all tables of the batch."""
        after = {}
        for at, (binding_id, table) in enumerate(tables.items()):
            before = commits[table.path].asDict() if table.path in commits else EMPTY
            files = f"{self.root}/changes/{place}/group={at // TOGETHER}/binding_id={binding_id}"
            after[table.path] = table.taken(before, files, arrived.get(binding_id, 0), batch_id, stream)
            if binding_id not in arrived:
                delete(self.spark, files)
        if after:
            self.log.commit(after)

    def quarantine(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/quarantine")

    def outcomes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/outcomes")


def start(
    stream: DataFrame,
    apply: Callable[..., None],
    checkpoint: str,
    **trigger,
) -> StreamingQuery:
    """Run ``apply`` on every micro-batch; the checkpoint is where it resumes.

    An ``apply`` with a parameter ``stream`` is also given the id of the checkpoint, which
    Spark wrote before the first batch: batches of a new checkpoint are numbered from 0 again.
    """
    known: list[str] = []

    def named(batch: DataFrame, batch_id: int) -> None:
        if not known:
            known.append(batch.sparkSession.read.json(f"{checkpoint.rstrip('/')}/metadata").first()["id"])
        apply(batch, batch_id, stream=known[0])

    wants = "stream" in inspect.signature(apply).parameters
    writer = stream.writeStream.foreachBatch(named if wants else apply)
    writer = writer.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
