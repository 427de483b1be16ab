"""Schema revisions: what a record schema says about the fields of an event.

Schemas are configuration. They are read once, on the driver, when a job is
planned; the data columns themselves are flattened by ``flatten_structs``.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import fixed
from tidemark.functions.docs import TYPE_CLASSES, WIRE_TYPES

PRIMITIVES = {"null", "boolean", "int", "long", "float", "double", "bytes", "string"}


class UnsupportedSchema(ValueError):
    """The schema uses a type that change events do not have."""


@dataclass(frozen=True)
class Node:
    """A type of the schema, with named references resolved."""

    kind: str
    name: str = ""
    fields: tuple[tuple[str, "Node", str | None], ...] = ()
    members: tuple["Node", ...] = ()
    symbols: tuple[str, ...] = ()


@dataclass(frozen=True)
class EntityField:
    """A field that can be mapped: a scalar or the child of a compound."""

    name: str
    field_type: str
    wire_type: str
    nullable: bool
    parent_position: int
    position: int
    parent: str | None = None
    child: str | None = None
    field_id: str | None = None


def parse_schema(text: str) -> Node:
    return _node(json.loads(text), "", {})


def _node(raw, namespace: str, named: dict[str, Node]) -> Node:
    if isinstance(raw, list):
        return Node("union", members=tuple(_node(m, namespace, named) for m in raw))
    if isinstance(raw, str):
        if raw in PRIMITIVES:
            return Node(raw)
        full = raw if "." in raw or not namespace else f"{namespace}.{raw}"
        if full not in named:
            raise UnsupportedSchema(f"type {raw!r}")
        return named[full]
    kind = raw["type"]
    if kind == "array":
        return Node("array", members=(_node(raw["items"], namespace, named),))
    if kind not in ("record", "enum"):
        if isinstance(kind, str) and kind not in PRIMITIVES:
            raise UnsupportedSchema(f"type {kind!r}")
        return _node(kind, namespace, named)
    namespace = raw.get("namespace", namespace)
    full = raw["name"] if "." in raw["name"] or not namespace else f"{namespace}.{raw['name']}"
    if kind == "enum":
        node = Node("enum", raw["name"], symbols=tuple(raw["symbols"]))
    else:
        node = Node("record", raw["name"], fields=tuple(
            (f["name"], _node(f["type"], namespace, named), f.get("doc")) for f in raw["fields"]
        ))
    named[full] = node
    return node


def _members(node: Node) -> tuple[Node, ...]:
    return node.members if node.kind == "union" else (node,)


def _documented(doc: str | None) -> tuple[str, str | None]:
    """Semantic type and field id of a doc text, as ``functions.docs.parse_doc`` does it."""
    parts = [p.strip() for p in (doc or "").split(":")]
    raw = parts[1] if len(parts) > 1 else parts[0]
    if raw.lower().startswith(fixed.SWITCHABLE_PREFIX.lower()):
        raw = raw[len(fixed.SWITCHABLE_PREFIX):]
    known = {t.lower(): t for t in TYPE_CLASSES}
    return known.get(raw.lower(), fixed.UNKNOWN_TYPE), (parts[2] if len(parts) > 2 else "") or None


def entity_fields(schema: Node) -> list[EntityField]:
    """Every field that can be mapped, the header left out and compounds flattened."""
    out = []
    for position, (name, node, doc) in enumerate(schema.fields):
        if name == fixed.HEADER_FIELD:
            continue
        documented, field_id = _documented(doc)
        members = _members(node)
        nullable = any(m.kind == "null" for m in members)
        for member in members:
            if member.kind == "null":
                continue
            if member.kind != "record":
                by_wire = WIRE_TYPES.get(member.kind, fixed.UNKNOWN_TYPE)
                compound = TYPE_CLASSES.get(documented) == "compound"
                out.append(EntityField(
                    name, by_wire if compound else documented, member.kind, nullable, -1,
                    position, field_id=field_id,
                ))
                continue
            for at, (child, child_node, child_doc) in enumerate(member.fields):
                scalars = [m for m in _members(child_node) if m.kind not in ("null", "record")]
                if not scalars:
                    continue
                child_type, _ = _documented(child_doc)
                if child_type == fixed.UNKNOWN_TYPE:
                    child_type = WIRE_TYPES.get(scalars[0].kind, fixed.UNKNOWN_TYPE)
                out.append(EntityField(
                    name + child, child_type, scalars[0].kind,
                    any(m.kind == "null" for m in _members(child_node)), position, at,
                    parent=name, child=child, field_id=field_id,
                ))
    return out


def field_layout(schema: Node) -> tuple[list[str], list[list[str]]]:
    """Names by position, and for compounds the names of their children."""
    children = []
    for _, node, _ in schema.fields:
        records = [m for m in _members(node) if m.kind == "record"]
        children.append([f[0] for f in records[0].fields] if records else [])
    return [f[0] for f in schema.fields], children


def flatten_structs(rows: DataFrame, skip: Sequence[str] = (fixed.HEADER_FIELD,)) -> DataFrame:
    """Replace every struct column by its children, named parent and child together."""
    out: list[Column] = []
    for column in rows.schema.fields:
        if column.name in skip:
            continue
        if isinstance(column.dataType, T.StructType):
            out += [
                F.col(column.name)[child].alias(column.name + child)
                for child in column.dataType.fieldNames()
            ]
        else:
            out.append(F.col(column.name))
    return rows.select(*out)
