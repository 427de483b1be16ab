"""Decode change-event payloads with the schema revision each event names.

The job is one ``mapInArrow`` pass without a shuffle. Inside a task an Arrow
batch is split by schema id and each part is read field by field for all its
rows at once. Only the header and the fields a mapping asks for are built; the
rest is stepped over. A payload that does not fit its schema to the last byte
is marked in ``decode_error`` and never fails the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark import fixed
from tidemark.plans.schema import Node, entity_fields, parse_schema

ARROW_TYPES = {
    "string": pa.string(), "enum": pa.string(), "bytes": pa.binary(), "int": pa.int32(),
    "long": pa.int64(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(),
    "array": pa.list_(pa.string()),
}
SPARK_TYPES = {
    "string": "string", "enum": "string", "bytes": "binary", "int": "int", "long": "bigint",
    "float": "float", "double": "double", "boolean": "boolean", "array": "array<string>",
}
# Fields of the event header.
HEADER_WIRE_TYPES = {
    "entityName": "string",
    "recordIds": "array",
    "changeType": "enum",
    "changeOrigin": "string",
    "transactionKey": "string",
    "sequenceNumber": "int",
    "commitTimestamp": "long",
    "commitNumber": "long",
    "commitUser": "string",
    "nulledFields": "array",
    "diffFields": "array",
    "changedFields": "array",
}
ERRORS = ["", "truncated", "bad number", "bad length", "bad union tag", "bad enum",
          "trailing bytes", "no payload"]
TRUNCATED, BAD_NUMBER, BAD_LENGTH, BAD_TAG, BAD_ENUM, TRAILING, NO_PAYLOAD = range(1, 8)


class _Payloads:
    """The payloads of one schema id: one buffer and a read position per row."""

    def __init__(self, column: pa.Array):
        self.size = len(column)
        self.error = np.zeros(self.size, np.int8)
        self.error[np.asarray(column.is_null())] = NO_PAYLOAD
        column = column.fill_null(b"").cast(pa.large_binary())
        offsets = np.frombuffer(column.buffers()[1], np.int64)[
            column.offset:column.offset + self.size + 1]
        data = column.buffers()[2]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data = np.concatenate([raw, np.zeros(16, np.uint8)])
        self.at, self.end = offsets[:-1].copy(), offsets[1:]

    def fail(self, rows: np.ndarray, code: int) -> None:
        self.error[rows[self.error[rows] == 0]] = code

    def number(self, rows: np.ndarray) -> np.ndarray:
        """Variable-length zig-zag integers."""
        value = np.zeros(len(rows), np.uint64)
        at, end = self.at[rows], self.end[rows]
        left = np.arange(len(rows))
        for shift in range(0, 70, 7):
            inside = at[left] < end[left]
            if not inside.all():
                self.fail(rows[left[~inside]], TRUNCATED)
                left = left[inside]
            byte = self.data[at[left]]
            value[left] |= (byte & 0x7F).astype(np.uint64) << np.uint64(shift)
            at[left] += 1
            left = left[byte >= 0x80]
            if not len(left):
                break
        self.fail(rows[left], BAD_NUMBER)
        self.at[rows] = at
        half = (value >> np.uint64(1)).astype(np.int64)
        return half ^ -(value & np.uint64(1)).astype(np.int64)

    def fixed_width(self, rows: np.ndarray, dtype: str) -> np.ndarray:
        width = np.dtype(dtype).itemsize
        start = self.at[rows]
        short = start + width > self.end[rows]
        self.fail(rows[short], TRUNCATED)
        start = np.where(short, 0, start)
        self.at[rows] = np.where(short, self.end[rows], start + width)
        picked = self.data[start[:, None] + np.arange(width)]
        return np.ascontiguousarray(picked).view(dtype)[:, 0]

    def span(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of length-prefixed bytes."""
        length = self.number(rows)
        start = self.at[rows]
        bad = (length < 0) | (length > self.end[rows] - start)
        self.fail(rows[bad], BAD_LENGTH)
        length = np.where(bad, 0, length)
        self.at[rows] = np.where(bad, self.end[rows], start + length)
        return start, length

    def binary(self, start: np.ndarray, length: np.ndarray) -> pa.Array:
        offsets = np.zeros(len(start) + 1, np.int64)
        np.cumsum(length, out=offsets[1:])
        picked = np.repeat(start - offsets[:-1], length) + np.arange(offsets[-1])
        return pa.Array.from_buffers(
            pa.large_binary(), len(start),
            [None, pa.py_buffer(offsets), pa.py_buffer(self.data[picked])],
        ).cast(pa.binary())

    def text(self, start: np.ndarray, length: np.ndarray) -> pa.Array:
        raw = self.binary(start, length)
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


class _Pieces(dict):
    """Values read so far: path in the record to parts of ``(rows, values)``."""

    def add(self, path, rows: np.ndarray, values: pa.Array) -> None:
        if path in self and len(rows):
            self[path].append((rows, values))


def _read(data: _Payloads, node: Node, rows: np.ndarray, path: tuple, out: _Pieces) -> None:
    if not len(rows):
        return
    kind = node.kind
    if kind == "record":
        out.add((*path, ""), rows, pa.array(np.ones(len(rows), bool)))
        for name, child, _ in node.fields:
            _read(data, child, rows, (*path, name), out)
    elif kind == "union":
        tags = data.number(rows)
        data.fail(rows[(tags < 0) | (tags >= len(node.members))], BAD_TAG)
        for tag, member in enumerate(node.members):
            _read(data, member, rows[tags == tag], path, out)
    elif kind == "array":
        _read_array(data, node.members[0], rows, path, out)
    elif kind in ("int", "long"):
        values = data.number(rows)
        if kind == "int":
            data.fail(rows[values != values.astype(np.int32)], BAD_NUMBER)
        out.add(path, rows, pa.array(values))
    elif kind in ("float", "double"):
        out.add(path, rows, pa.array(data.fixed_width(rows, "<f4" if kind == "float" else "<f8")))
    elif kind == "boolean":
        values = data.fixed_width(rows, "u1")
        data.fail(rows[values > 1], BAD_NUMBER)
        out.add(path, rows, pa.array(values == 1))
    elif kind in ("string", "bytes"):
        start, length = data.span(rows)
        if path in out:
            build = data.text if kind == "string" else data.binary
            out.add(path, rows, build(start, length))
    elif kind == "enum":
        index = data.number(rows)
        bad = (index < 0) | (index >= len(node.symbols))
        data.fail(rows[bad], BAD_ENUM)
        symbols = pa.array(node.symbols, pa.string())
        out.add(path, rows, symbols.take(pa.array(np.where(bad, 0, index))))


def _read_array(data: _Payloads, item: Node, rows: np.ndarray, path: tuple, out: _Pieces) -> None:
    """Items come in blocks; all rows advance by one item at a time."""
    parts = []
    block = rows
    while len(block):
        count = data.number(block)
        sized = block[count < 0]
        data.number(sized)
        count = np.abs(count)
        fine = (data.error[block] == 0) & (count > 0)
        block, left = block[fine], count[fine]
        current, todo = block, left
        while len(current):
            if item.kind == "string":
                start, length = data.span(current)
                parts.append((current, start, length))
            else:
                _read(data, item, current, (*path, "[]"), out)
            todo = todo - 1
            more = (todo > 0) & (data.error[current] == 0)
            current, todo = current[more], todo[more]
        block = block[data.error[block] == 0]
    if path not in out or item.kind != "string":
        return
    if not parts:
        empty = pa.ListArray.from_arrays(pa.array(np.zeros(len(rows) + 1, np.int32)),
                                         pa.array([], pa.string()))
        out.add(path, rows, empty)
        return
    owner, start, length = (np.concatenate(p) for p in zip(*parts))
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(np.searchsorted(rows, owner), minlength=len(rows))
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    items = data.text(start[order], length[order])
    out.add(path, rows, pa.ListArray.from_arrays(pa.array(offsets), items))


WRONG_TYPE = "value of another type"


def _fitted(values: pa.Array, arrow_type: pa.DataType) -> tuple[pa.Array, np.ndarray]:
    """``values`` in the type of a column, and which of them have no place in it."""
    try:
        return values.cast(arrow_type), np.empty(0, np.int64)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        pass  # some do not fit: look at each
    out: list = []
    lost = []
    for i, value in enumerate(values):
        try:
            out.append(value.cast(arrow_type).as_py())
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
            out.append(None)
            lost.append(i)
    return pa.array(out, arrow_type), np.array(lost, np.int64)


def _column(
    parts: list, size: int, failed: np.ndarray, arrow_type: pa.DataType, lost: np.ndarray
) -> pa.Array:
    """Parts in row order, NULL where nothing was read or the payload is bad. ``lost`` marks rows
    whose schema has the field in another type, and a value that this one cannot hold.
    """
    where = np.full(size, -1, np.int64)
    chunks, base = [], 0
    for rows, values in parts:
        where[rows] = base + np.arange(len(rows))
        base += len(rows)
        chunks.append(values)
    where[failed] = -1
    if not chunks:
        return pa.nulls(size, arrow_type)
    if any(c.type != arrow_type for c in chunks):
        fitted = [_fitted(c, arrow_type) for c in chunks]
        for (rows, _), (_, bad) in zip(parts, fitted, strict=True):
            lost[rows[bad]] = True
        chunks = [c for c, _ in fitted]
    values = pa.chunked_array(chunks).combine_chunks()
    return values.take(pa.array(where, mask=where < 0))


class Decoder:
    """Reads the wanted fields of payloads of several schema revisions."""

    def __init__(self, revisions: Mapping[str, str], wanted: Mapping[str, str]):
        """``revisions`` schema id to schema text; ``wanted`` field name to wire type."""
        self.wanted = dict(wanted)
        self.schemas, self.paths = {}, {}
        parents = set()
        for schema_id, text in revisions.items():
            schema = parse_schema(text)
            known = {f.name: f for f in entity_fields(schema)}
            compounds = {f.parent for f in known.values() if f.parent}
            self.schemas[schema_id] = schema
            self.paths[schema_id] = {
                n: (known[n].parent, known[n].child) if known[n].parent else (n,)
                for n in self.wanted if n in known
            }
            for name, path in self.paths[schema_id].items():
                parents.update(c for c in (path[0], name) if c in compounds)
        self.parents = sorted(parents)

    def columns_ddl(self) -> str:
        def struct(fields: dict[str, str]) -> str:
            return "struct<" + ", ".join(f"`{n}`: {t}" for n, t in fields.items()) + ">"

        header = {n: SPARK_TYPES[t] for n, t in HEADER_WIRE_TYPES.items()}
        values = {n: SPARK_TYPES[t] for n, t in self.wanted.items()}
        present = dict.fromkeys(self.parents, "boolean")
        parts = [f"header {struct(header)}"]
        parts += [f"fields {struct(values)}"] if values else []
        parts += [f"compounds {struct(present)}"] if present else []
        return ", ".join([*parts, "decode_error string"])

    def decode(self, schema_id: str | None, payloads: pa.Array) -> list[pa.Array]:
        size = len(payloads)
        schema = self.schemas.get(schema_id)
        paths = self.paths.get(schema_id, {})
        out = _Pieces({(fixed.HEADER_FIELD, n): [] for n in HEADER_WIRE_TYPES})
        out.update({p: [] for p in paths.values()})
        out.update({(p, ""): [] for p in self.parents})
        if schema is None:
            failed, errors = np.ones(size, bool), pa.array(["no schema"] * size, pa.string())
        else:
            data = _Payloads(payloads)
            _read(data, schema, np.arange(size), (), out)
            data.fail(np.flatnonzero(data.at != data.end), TRAILING)
            failed = data.error > 0
            errors = pa.array(ERRORS, pa.string()).take(pa.array(data.error, mask=~failed))
        lost = np.zeros(size, bool)

        def column(path, wire: str) -> pa.Array:
            return _column(out.get(path, []), size, failed, ARROW_TYPES[wire], lost)

        def struct(arrays: list, names) -> pa.Array:
            return pa.StructArray.from_arrays(arrays, names=list(names))

        made = [struct([column((fixed.HEADER_FIELD, n), t) for n, t in HEADER_WIRE_TYPES.items()],
                       HEADER_WIRE_TYPES)]
        if self.wanted:
            made.append(struct([column(paths.get(n), t) for n, t in self.wanted.items()],
                               self.wanted))
        if self.parents:
            made.append(struct([column((p, ""), "boolean") for p in self.parents], self.parents))
        if (lost & ~failed).any():
            errors = pc.if_else(pa.array(lost & ~failed), WRONG_TYPE, errors)
        return [*made, errors]

    def decode_batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("schema_id").dictionary_encode()
            codes = ids.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            others = [i for i, n in enumerate(batch.schema.names) if n != "payload"]
            for code in np.unique(codes):
                rows = pa.array(np.flatnonzero(codes == code))
                schema_id = None if code < 0 else ids.dictionary[int(code)].as_py()
                part = batch if len(rows) == batch.num_rows else batch.take(rows)
                made = self.decode(schema_id, part.column("payload"))
                kept = [part.column(i) for i in others]
                names = [batch.schema.names[i] for i in others]
                names += ["header", *(["fields"] if self.wanted else []),
                          *(["compounds"] if self.parents else []), "decode_error"]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=names)


def decode_payloads(
    events: DataFrame, revisions: Mapping[str, str], wanted: Mapping[str, str]
) -> DataFrame:
    """Events with ``header``, ``fields``, ``compounds`` and ``decode_error`` for ``payload``.

    ``revisions`` are the schema texts of the bindings being read, so they are
    bounded by the configuration and travel with the task.
    """
    decoder = Decoder(revisions, wanted)
    kept = ", ".join(
        f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema if f.name != "payload"
    )
    return events.mapInArrow(decoder.decode_batches, f"{kept}, {decoder.columns_ddl()}")
