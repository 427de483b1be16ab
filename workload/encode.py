"""Encodes change events the way a producer does, to have payloads to decode."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark import fixed
from tidemark.plans.schema import Node, parse_schema


def number(value: int) -> bytes:
    value = (value << 1) ^ (value >> 63)
    out = bytearray()
    while value > 0x7F:
        out.append((value & 0x7F) | 0x80)
        value >>= 7
    out.append(value)
    return bytes(out)


def encode(node: Node, value) -> bytes:
    kind = node.kind
    if kind == "record":
        return b"".join(encode(child, value.get(name)) for name, child, _ in node.fields)
    if kind == "union":
        want = "null" if value is None else "record" if isinstance(value, dict) else None
        for tag, member in enumerate(node.members):
            if member.kind == want or (want is None and member.kind not in ("null", "record")):
                return number(tag) + encode(member, value)
        raise ValueError(f"no member of the union holds {value!r}")
    if kind == "array":
        body = b"".join(encode(node.members[0], v) for v in value)
        return (number(len(value)) + body if value else b"") + number(0)
    if kind == "string":
        raw = value.encode()
        return number(len(raw)) + raw
    if kind == "bytes":
        return number(len(value)) + value
    if kind in ("int", "long"):
        return number(value)
    if kind == "double":
        return struct.pack("<d", value)
    if kind == "float":
        return struct.pack("<f", value)
    if kind == "boolean":
        return bytes([value])
    if kind == "enum":
        return number(node.symbols.index(value))
    return b""


def bitmap(positions: list[int]) -> str:
    bits = sum(1 << p for p in positions)
    size = max(1, (bits.bit_length() + 7) // 8)
    return "0x" + bits.to_bytes(size, "big").hex()


def changed_fields(schema: Node, names: list[str]) -> list[str]:
    """Bitmap entries for field names; ``Parent.Child`` names a compound's child."""
    top = [f[0] for f in schema.fields]
    entries, nested = [], {}
    for name in names:
        parent, _, child = name.partition(".")
        if child:
            nested.setdefault(top.index(parent), []).append(child)
    direct = [top.index(n) for n in names if "." not in n]
    if direct:
        entries.append(bitmap(direct))
    for at, children in nested.items():
        record = next(m for m in schema.fields[at][1].members if m.kind == "record")
        known = [f[0] for f in record.fields]
        entries.append(f"{at}-{bitmap([known.index(c) for c in children])}")
    return entries


HEADER = {
    "type": "record",
    "name": fixed.HEADER_FIELD,
    "fields": [
        {"name": "entityName", "type": "string"},
        {"name": "recordIds", "type": {"type": "array", "items": "string"}},
        {"name": "changeType", "type": {
            "type": "enum", "name": "ChangeType",
            "symbols": [*fixed.APPLIED_KINDS, *fixed.GAP_KINDS, "SNAPSHOT"]}},
        {"name": "changeOrigin", "type": "string"},
        {"name": "transactionKey", "type": "string"},
        {"name": "sequenceNumber", "type": "int"},
        {"name": "commitTimestamp", "type": "long"},
        {"name": "commitNumber", "type": "long"},
        {"name": "commitUser", "type": "string"},
        {"name": "nulledFields", "type": {"type": "array", "items": "string"}},
        {"name": "diffFields", "type": {"type": "array", "items": "string"}},
        {"name": "changedFields", "type": {"type": "array", "items": "string"}},
    ],
}


def event_schema(name: str, fields: list[dict]) -> str:
    header = {"name": fixed.HEADER_FIELD, "type": HEADER}
    return json.dumps({"type": "record", "name": name, "namespace": "feed",
                       "fields": [header, *fields]})


def optional(name: str, kind, doc: str | None = None) -> dict:
    kinds = kind if isinstance(kind, list) else [kind]
    return {"name": name, "type": ["null", *kinds], "default": None, **({"doc": doc} if doc else {})}


def header_values(schema: Node, ids, kind, changed, entity, sequence) -> dict:
    return {
        "entityName": entity, "recordIds": list(ids), "changeType": kind, "changeOrigin": "",
        "transactionKey": "t", "sequenceNumber": sequence, "commitTimestamp": 1700000000000,
        "commitNumber": 12279648331300, "commitUser": "u", "nulledFields": [], "diffFields": [],
        "changedFields": changed_fields(schema, list(changed)),
    }


def event(schema: Node, ids, kind, changed=(), entity="", sequence=1, values=None) -> bytes:
    header = header_values(schema, ids, kind, changed, entity, sequence)
    return encode(schema, {fixed.HEADER_FIELD: header, **(values or {})})


def joined(*parts) -> pa.Array:
    """Columns of bytes, or bytes that all rows share, put together row by row; at least one is a column."""
    shared = [pa.scalar(p, pa.binary()) if isinstance(p, bytes) else p for p in parts]
    return pc.binary_join_element_wise(*shared, pa.scalar(b"", pa.binary()))


def numbers(values: pa.Array) -> pa.Array:
    """``number`` of each of a column of integers; a null counts as 0."""
    value = values.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
    left = ((value << 1) ^ (value >> 63)).astype(np.uint64)
    out, length = np.zeros((len(left), 10), np.uint8), np.ones(len(left), np.int64)
    for i in range(10):
        out[:, i] = left & np.uint64(0x7F)
        left >>= np.uint64(7)
        more = left > 0
        out[more, i] |= 0x80
        length += more
        if not more.any():
            break
    ends = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
    data = out[np.arange(10) < length[:, None]]
    return pa.Array.from_buffers(pa.binary(), len(left), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def column(node: Node, values: pa.Array) -> pa.Array:
    """What ``encode`` does for one value, for a column of them: unions with null, records, arrays,
    strings, integers and doubles.
    """
    kind = node.kind
    if kind == "record":
        known = [f.name for f in values.type]
        return joined(b"", *[column(child, values.field(name) if name in known else pa.nulls(len(values)))
                             for name, child, _ in node.fields])
    if kind == "union":
        nothing = number([m.kind for m in node.members].index("null"))
        none = pa.repeat(pa.scalar(nothing, pa.binary()), len(values))
        if pa.types.is_null(values.type):
            return none
        is_record = pa.types.is_struct(values.type)
        tag, member = next((t, m) for t, m in enumerate(node.members)
                           if m.kind != "null" and (m.kind == "record") == is_record)
        return pc.if_else(values.is_valid(), joined(number(tag), column(member, values)), none)
    if kind == "array":
        counts = values.value_lengths().fill_null(0)
        ends = np.concatenate([[0], np.cumsum(counts.to_numpy(zero_copy_only=False))]).astype(np.int32)
        items = pa.ListArray.from_arrays(pa.array(ends), column(node.members[0], values.flatten()))
        body = joined(numbers(counts), pc.binary_join(items, pa.scalar(b"", pa.binary())), number(0))
        return pc.if_else(pc.greater(counts, 0), body, pa.scalar(number(0), pa.binary()))
    if kind == "string":
        raw = values.cast(pa.binary())
        return joined(numbers(pc.binary_length(raw)), raw)
    if kind in ("int", "long"):
        return numbers(values)
    if kind == "double":
        raw = values.fill_null(0.0).to_numpy(zero_copy_only=False).astype("<f8")
        ends = np.arange(0, 8 * len(raw) + 8, 8, dtype=np.int32)
        return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(ends), pa.py_buffer(raw)])
    raise ValueError(f"no column of {kind}")


def event_column(schema: Node, ids: pa.Array, kinds: pa.Array, changed: pa.Array, entity: str, values: pa.Array) -> pa.Array:
    """What ``event`` does for one event, for columns of them. Of a header only the record ids differ
    from event to event; the rest is written once for each type and list of changed fields.
    """
    header = schema.fields[0][1]
    place = [name for name, _, _ in header.fields].index("recordIds")
    heads = pc.binary_join_element_wise(kinds, pc.binary_join(changed, "\x1f"), "\x1e").dictionary_encode()
    before, after = [], []
    for head in heads.dictionary.to_pylist():
        kind, _, names = head.partition("\x1e")
        given = header_values(schema, (), kind, names.split("\x1f") if names else [], entity, 1)
        written = [encode(child, given[name]) for name, child, _ in header.fields]
        before.append(b"".join(written[:place]))
        after.append(b"".join(written[place + 1:]))
    parts = [pa.array(part, pa.binary()).take(heads.indices) for part in (before, after)]
    fields = Node("record", fields=schema.fields[1:])
    return joined(parts[0], column(header.fields[place][1], ids), parts[1], column(fields, values))


# Customers as an entity in two revisions; the second has its fields elsewhere.

ADDRESS = {"type": "record", "name": "Address", "fields": [
    optional("Street", "string"), optional("Latitude", "double")]}
FIELDS = [
    optional("Status", "string", "Data:Text"),
    optional("TotalPrice", "double", "Data:Currency:00N1"),
    optional("OrderDate", "long", "Data:DateTime"),
    optional("Home", ADDRESS, "Data:Address"),
]
ENTITY = "CustomerChangeEvent"
REVISIONS = {
    "R1": event_schema(ENTITY, FIELDS),
    "R2": event_schema(ENTITY, [optional("Channel", "string", "Data:Text"), *reversed(FIELDS)]),
}
MAPPINGS = {
    "MappedSFKey": "record_id", "Status": "status", "TotalPrice": "price", "OrderDate": "ordered",
    "HomeStreet": "street", "HomeLatitude": "latitude",
}


ORDER_COLUMNS = ["ids", "kind", "changed", "status", "price", "ordered_ms", "street", "latitude"]


def encode_orders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns that say nothing of the payload are passed on."""
    schemas = {i: parse_schema(text) for i, text in REVISIONS.items()}
    for batch in batches:
        second = pc.equal(batch.column("schema_id"), "R2").fill_null(False)
        for schema_id, rows in (("R1", batch.filter(pc.invert(second))), ("R2", batch.filter(second))):
            if not rows.num_rows:
                continue
            ids, kinds, changed, status, price, ordered_ms, street, latitude = (rows.column(c) for c in ORDER_COLUMNS)
            home = pa.StructArray.from_arrays([street, latitude], ["Street", "Latitude"], mask=street.is_null())
            values = pa.StructArray.from_arrays(
                [status, price, ordered_ms, home], ["Status", "TotalPrice", "OrderDate", "Home"])
            payloads = event_column(schemas[schema_id], ids, kinds, changed, "Customer", values)
            kept = [n for n in rows.schema.names if n not in ORDER_COLUMNS]
            yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in kept), payloads], names=[*kept, "payload"])
