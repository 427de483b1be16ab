"""From decoded events to change rows of a binding's target table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import bitmap
from tidemark.functions.convert import Converter, convert, problem
from tidemark.operators.fold import FoldSpec, SET_SUFFIX
from tidemark.plans import routing
from tidemark.plans.schema import EntityField, Node, entity_fields, field_layout, parse_schema
from tidemark.sources.avro import decode_payloads


# Columns of change rows beside those of the target table, which may have any name.
ORDER, KIND = "__replay_id", "__change_type"


@dataclass(frozen=True)
class MappedField:
    """A source field, the column it goes to and what is known about both."""

    source: str
    target: str
    field_type: str
    wire_type: str
    family: str | None = None


@dataclass(frozen=True)
class Binding:
    """An entity bound to a table, with everything a job needs to read its events."""

    binding_id: int
    entity: str
    table: str
    key_column: str
    fields: tuple[MappedField, ...]
    revisions: Mapping[str, str]
    flag: str | None = None
    flag_family: str = "Boolean"
    null_compound: str = "skip"
    converters: dict[str, Converter] | None = field(default=None, compare=False)

    @property
    def columns(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(f.target for f in self.fields))

    def fold_spec(self) -> FoldSpec:
        return FoldSpec(key=(self.key_column,), columns=self.columns, order=(ORDER,), kind=KIND,
                        flag=self.flag, flag_family=self.flag_family)


def plan_binding(
    binding_id: int,
    entity: str,
    table: str,
    mappings: Mapping[str, str],
    revisions: Mapping[str, str],
    newest: str,
    families: Mapping[str, str] | None = None,
    **options,
) -> Binding:
    """Work out a binding from its mappings and schema texts.

    Types are those of the ``newest`` revision; a field only older ones have is
    typed by them. A binding without a key mapping cannot be applied, nor one that
    maps a field to the column of the record id, nor one that maps two to one column.
    """
    if fixed.KEY_MAPPING_FIELD not in mappings:
        raise ValueError(f"binding {binding_id} has no key mapping")
    key_column = mappings[fixed.KEY_MAPPING_FIELD]
    if any(t == key_column for s, t in mappings.items() if s != fixed.KEY_MAPPING_FIELD):
        raise ValueError(f"binding {binding_id} maps a field to the key column {key_column}")
    if len(set(mappings.values())) < len(mappings):
        raise ValueError(f"binding {binding_id} maps two fields to one column")
    known: dict[str, EntityField] = {}
    for schema_id in sorted(revisions, key=lambda s: s == newest):
        known.update({f.name: f for f in entity_fields(parse_schema(revisions[schema_id]))})
    fields = tuple(
        MappedField(s, t, known[s].field_type, known[s].wire_type, (families or {}).get(t))
        for s, t in mappings.items() if s != fixed.KEY_MAPPING_FIELD and s in known
    )
    return Binding(binding_id, entity, table, mappings[fixed.KEY_MAPPING_FIELD], fields,
                   dict(revisions), **options)


def decode_binding(events: DataFrame, binding: Binding) -> DataFrame:
    wanted = {f.source: f.wire_type for f in binding.fields}
    return decode_payloads(events, binding.revisions, wanted)


ENTRIES, LOST = "changed_entries", "value_lost"
PROBLEMS = "problems"


class FieldAccess:
    """Column expressions for one mapped field of decoded events."""

    def __init__(self, binding: Binding, mapped: MappedField, schemas: Mapping[str, Node]):
        self.mapped = mapped
        self.wire = F.col("fields")[mapped.source]
        self.value = convert(self.wire, mapped.field_type, mapped.wire_type, mapped.family,
                             binding.converters)
        self.problem = problem(self.wire, mapped.field_type, mapped.wire_type, mapped.family,
                               binding.converters)
        places, parents, both = [], set(), False
        for schema_id, schema in schemas.items():
            found = [f for f in entity_fields(schema) if f.name == mapped.source]
            both = both or any(f.parent == mapped.source for f in entity_fields(schema))
            for f in found[:1]:
                place = F.struct(F.lit(f.parent_position).alias("parent"),
                                 F.lit(f.position).alias("position"))
                places += [F.lit(schema_id), place]
                parents |= {f.parent} if f.parent else set()
        here = F.try_element_at(F.create_map(*places), F.col("schema_id")) if places else None
        changed = F.lit(False) if here is None else bitmap.field_changed(
            F.col(ENTRIES), here["parent"], here["position"])
        if parents and binding.null_compound == "skip":
            # A compound that arrives as NULL carries no values for its children.
            for parent in sorted(parents):
                changed = changed & F.coalesce(F.col("compounds")[parent], F.lit(False))
        if both:
            # The scalar of a scalar-or-compound field has no value while the compound does.
            changed = changed & ~F.coalesce(F.col("compounds")[mapped.source], F.lit(False))
        self.changed = changed


# What an event of each type writes to a column: its ``(value, is written)``.
FieldHandler = Callable[[FieldAccess], tuple[Column, Column]]

DEFAULT_HANDLERS: dict[str, FieldHandler] = {
    "CREATE": lambda f: (f.value, f.wire.isNotNull()),
    "UPDATE": lambda f: (f.value, f.changed),
}


def event_outcome(soft: bool) -> Column:
    """Outcome of a decoded event; applied where nothing stands against it."""
    ids = F.col("header.recordIds")
    entries = F.col("header.changedFields")
    broken = F.coalesce(F.exists(entries, bitmap.is_broken_entry), F.lit(False))
    return (
        F.when(F.col("decode_error").isNotNull(), routing.BAD_PAYLOAD)
        .when(ids.isNull() | (F.size(ids) == 0), routing.BAD_HEADER)
        .otherwise(
            F.coalesce(
                routing.kind_outcome(F.col("header.changeType"), F.lit(soft)),
                F.when((F.col("header.changeType") == "UPDATE") & broken, routing.BAD_BITMAP),
                F.lit(routing.APPLIED),
            )
        )
    )


def project(
    decoded: DataFrame, binding: Binding, handlers: dict[str, FieldHandler] | None = None
) -> DataFrame:
    """Decoded events with ``target`` and ``written``, structs of the target columns'
    new values and of whether the event writes them, their ``outcome``, and ``problems``: for
    each field that is written what is wrong with its value. An event with a value that does
    not convert to its column is not applied; one that only loses digits is, and says so.
    """
    handlers = DEFAULT_HANDLERS if handlers is None else handlers
    schemas = {i: parse_schema(text) for i, text in binding.revisions.items()}
    kind = F.col("header.changeType")
    by_target: dict[str, list[FieldAccess]] = {}
    for mapped in binding.fields:
        by_target.setdefault(mapped.target, []).append(FieldAccess(binding, mapped, schemas))
    values, flags, lost, problems = [], [], F.lit(False), []
    for target, accesses in by_target.items():
        value, written = None, None
        for change_type, handler in handlers.items():
            here = kind == change_type
            # Of several fields for one column the last that is written wins.
            for access in reversed(accesses):
                v, w = handler(access)
                w = here & F.coalesce(w, F.lit(False))
                lost = lost | (w & access.wire.isNotNull() & access.value.isNull())
                problems.append(F.struct(F.lit(access.mapped.source).alias("field"), F.lit(target).alias("column"),
                                         F.when(w, access.problem).alias("problem")))
                value = F.when(w, v) if value is None else value.when(w, v)
                written = w if written is None else written | w
        values.append(value.alias(target))
        flags.append(F.coalesce(written, F.lit(False)).alias(target))
    parsed = decoded.withColumn(ENTRIES, bitmap.parsed_entries(F.col("header.changedFields")))
    out = parsed.withColumns({
        **({"target": F.struct(*values), "written": F.struct(*flags)} if values else {}),
        "outcome": event_outcome(binding.flag is not None), LOST: lost,
        PROBLEMS: F.filter(F.array(*problems), lambda p: p["problem"].isNotNull()) if problems else F.array().cast(
            "array<struct<field: string, column: string, problem: string>>"),
    })
    touched = F.lit(False)
    for target in by_target:
        touched = touched | F.col("written")[target]
    empty = (F.col("outcome") == routing.APPLIED) & (kind == "UPDATE") & ~touched
    outcome = F.when(empty, routing.NO_CHANGE).when(
        (F.col("outcome") == routing.APPLIED) & F.col(LOST), routing.BAD_VALUE
    ).otherwise(F.col("outcome"))
    return out.withColumn("outcome", outcome).drop(ENTRIES, LOST)


def value_problems(projected: DataFrame, keep: list[str]) -> DataFrame:
    """One row per value that did not fit: ``keep``, field, column and problem."""
    return projected.select(*keep, F.explode(PROBLEMS).alias("_p")).select(*keep, "_p.*")


def applied_ids(ids: Column, kind: Column) -> Column:
    """Record ids an event applies to: all of them, but only the first for CREATE."""
    return F.when(kind == "CREATE", F.slice(ids, 1, 1)).otherwise(F.array_distinct(ids))


def change_rows(projected: DataFrame, binding: Binding, keep: tuple[str, ...] = ()) -> DataFrame:
    """One change row per record id of every applied event, with its columns ``keep``."""
    ids = applied_ids(F.col("header.recordIds"), F.col("header.changeType"))
    return projected.filter(F.col("outcome") == routing.APPLIED).select(
        F.explode(ids).alias(binding.key_column),
        F.col("replay_id").alias(ORDER),
        F.col("header.changeType").alias(KIND),
        *keep,
        *[F.col("target")[c].alias(c) for c in binding.columns],
        *[F.col("written")[c].alias(c + SET_SUFFIX) for c in binding.columns],
    )


def changed_names(binding: Binding) -> Column:
    """Names of the fields an UPDATE says changed, mapped or not."""
    entries = []
    for schema_id, text in binding.revisions.items():
        top, children = field_layout(parse_schema(text))
        layout = F.struct(
            F.array(*[F.lit(n) for n in top]).alias("top"),
            F.array(*[
                F.array(*[F.lit(c) for c in names]).cast("array<string>") for names in children
            ]).alias("children"),
        )
        entries += [F.lit(schema_id), layout]
    layout = F.try_element_at(F.create_map(*entries), F.col("schema_id"))

    def names(entry: Column) -> Column:
        parent = bitmap.nested_parent(entry)
        top = F.transform(bitmap.positions(entry), lambda i: F.get(layout["top"], i))
        nested = F.transform(
            bitmap.positions(entry),
            lambda i: F.concat(F.get(layout["top"], parent),
                               F.get(F.get(layout["children"], parent), i)),
        )
        return F.when(bitmap.is_nested(entry), nested).otherwise(top)

    found = F.flatten(F.transform(F.col("header.changedFields"), names))
    return F.filter(found, lambda n: n.isNotNull())
