"""SentencePiece encoding of texts of any length, and decoding (operator 6).

A giant text is cut into chunks that are encoded apart, exactly as the library encodes the
whole. A sequence of pieces is the library's encoding of a text if and only if every two
neighbours are the encoding of what they spell: a merge across their border would have
come up in the pair as well. So paths may be joined at any piece they share.

The state at a border is the piece that reaches it. For each chunk a matrix tells, from each
state at its left to each at its right border, the weight of the path between them: minus
its number of pieces, or minus infinity where there is none. The matrices are combined in
the max-plus algebra, which is associative, over a tree of bounded groups; going down the
tree again gives every chunk its states, from which it reads its own pieces.

States are looked for near the borders. Inside a long run of one character, say, where the
pieces lie may follow from the whole run, so that no state of one chunk is one of the next
and there is no path. Such a text is cut again into chunks GROW times as long, until it has one;
in the end it is one chunk. So results never follow from where a text is cut.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import lean, text_values
from tidemark.session import staged
from tidemark.sizing import broadcast_if_small

CHUNK = 16_384  # characters; a longer text is giant
FAN = 32  # matrices combined in one group
GROW = 8  # times as long chunks for texts without a path
TASK_CHUNKS = 512  # chunks whose matrices are combined in one task
WINDOW = 64  # characters first looked at to join two paths
BLANK = "▁"


class Pieces:
    """The model, with what paths need: how many characters each piece spells."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        with open(path, "rb") as file:
            model = proto.ModelProto.FromString(file.read())
        # The blank before a text is written out, as a chunk has none.
        self.prefix = " " if model.normalizer_spec.add_dummy_prefix else ""
        model.normalizer_spec.add_dummy_prefix = False
        if model.normalizer_spec.remove_extra_whitespaces or model.normalizer_spec.precompiled_charsmap:
            raise ValueError("the model changes characters, so places in a text are not kept")
        if model.trainer_spec.model_type != proto.TrainerSpec.BPE:
            raise ValueError("the model does not merge pairs")
        self.model = sentencepiece.SentencePieceProcessor()
        self.model.LoadFromSerializedProto(model.SerializeToString())
        count = self.model.get_piece_size()
        names = [self.model.id_to_piece(i) for i in range(count)]
        self.bytes: list[bytes] = []
        self.length = np.ones(count, np.int64)
        for i, name in enumerate(names):
            if self.model.is_byte(i):
                value = int(name[1:-1], 16)
                self.bytes.append(bytes([value]))
                self.length[i] = 0 if 0x80 <= value < 0xC0 else 1
            else:
                hidden = self.model.is_control(i)
                self.bytes.append(b"" if hidden else name.replace(BLANK, " ").encode())
                self.length[i] = 0 if hidden else len(name)
        self.longest = int(self.length.max())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([self.prefix + t if t else "" for t in texts], num_threads=1)

    def units(self, text: str, at: int) -> Units:
        return Units(np.array(self.model.encode(text), np.int32), self.length, at)

    def decode(self, ids) -> str:
        spelled = b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")
        return spelled[len(self.prefix):] if spelled.startswith(self.prefix) else spelled


class Units:
    """Encoded text as units with a place: a piece, or the bytes of one character together."""

    def __init__(self, ids: np.ndarray, length: np.ndarray, at: int):
        self.ids = ids
        sizes = length[ids]
        self.first = np.flatnonzero(sizes)
        sizes = sizes[self.first]
        self.ends = at + np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.codes = self.starts * 64 + sizes

    def __len__(self) -> int:
        return len(self.first)

    def slice(self, low: int, high: int) -> np.ndarray:
        """The ids of the units from ``low`` to before ``high``."""
        start = self.first[low] if low < len(self) else len(self.ids)
        return self.ids[start:self.first[high] if high < len(self) else len(self.ids)]


def chunk_paths(pieces: Pieces, text: str, low: int, high: int, ends_left: bool, ends_right: bool) -> dict:
    """The paths through ``text[low:high]``, around which ``text`` has the characters that a
    piece may reach over. ``ends_left``, ``ends_right``: whether the whole text ends there.
    """
    main = pieces.units(text[low:high], low)
    ins, outs = {}, {}
    if ends_left:
        ins[None] = (np.empty(0, np.int32), 0, None)
    else:
        for start in range(max(low - pieces.longest, 0), low):
            found = joined_in(pieces, text, start, low, high, main)
            if found is not None:
                ins[found[0]] = found[1:] + (start,)
    if ends_right:
        outs[None] = (len(main) - 1, np.empty(0, np.int32), None)
    else:
        for end in range(high, min(high + pieces.longest, len(text)) + 1):
            found = joined_out(pieces, text, end, low, high, main)
            if found is not None:
                outs[found[0]] = found[1:] + (end,)
    matrix = np.full((len(ins), len(outs)), -np.inf)
    direct = {}
    for r, (state, (before, i, start)) in enumerate(ins.items()):
        for c, (to, (j, after, end)) in enumerate(outs.items()):
            if i is not None and j is not None and i <= j:
                matrix[r, c] = -(len(before) + len(main.slice(i, j + 1)) + len(after))
                continue
            # The paths do not meet in the middle: look at the whole way.
            a, b = low if start is None else start, high if end is None else end
            whole = pieces.units(text[a:b], a)
            if not len(whole):
                if state is None and to is None:
                    matrix[r, c], direct[r, c] = 0, whole.ids
                continue
            if (state is None or (whole.starts[0], whole.ends[0]) == state) and (
                    to is None or (whole.starts[-1], whole.ends[-1]) == to):
                direct[r, c] = whole.slice(0 if state is None else 1, len(whole))
                matrix[r, c] = -len(direct[r, c])
    return {"ins": list(ins), "outs": list(outs), "matrix": matrix, "direct": direct,
            "before": [v[:2] for v in ins.values()], "after": [v[:2] for v in outs.values()],
            "ids": packed(main.ids)}


def joined_in(pieces, text, start, low, high, main):
    """The state of the piece from ``start`` on that reaches ``low``, the ids after it up to
    the first unit shared with ``main``, and that unit's number; None if it does not reach.
    """
    window = WINDOW
    while True:
        to = min(low + window, high)
        side = pieces.units(text[start:to], start)
        _, ours, theirs = np.intersect1d(side.codes, main.codes, return_indices=True)
        ours, theirs = ours[ours > 0], theirs[ours > 0]
        if len(ours) or to == high:
            break
        window *= 4
    if side.ends[0] < low:
        return None
    state = (int(side.starts[0]), int(side.ends[0]))
    if not len(ours):
        return state, None, None
    return state, side.slice(1, int(ours[0])), int(theirs[0])


def joined_out(pieces, text, end, low, high, main):
    """As ``joined_in`` for the piece that ends at ``end`` and begins before ``high``: its state,
    the number of the last unit shared with ``main`` and the ids after that.
    """
    window = WINDOW
    while True:
        since = max(high - window, low)
        side = pieces.units(text[since:end], since)
        _, ours, theirs = np.intersect1d(side.codes, main.codes, return_indices=True)
        if len(ours) or since == low:
            break
        window *= 4
    if side.starts[-1] >= high:
        return None
    state = (int(side.starts[-1]), int(side.ends[-1]))
    if not len(ours):
        return state, None, None
    return state, int(theirs[-1]), side.slice(int(ours[-1]) + 1, len(side))


def packed(ids: np.ndarray) -> bytes:
    """Ids as they are written between steps."""
    import zstandard

    return zstandard.compress(ids.astype("<i4").reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def path_ids(pieces: Pieces, chunk: dict, row: int, column: int) -> np.ndarray:
    """The ids of a chunk on the path between two of its states."""
    if (row, column) in chunk["direct"]:
        return chunk["direct"][row, column]
    before, i = chunk["before"][row]
    j, after = chunk["after"][column]
    main = Units(unpacked(chunk["ids"]), pieces.length, 0)
    return np.concatenate((before, main.slice(i, j + 1), after))


def combined(left: dict, right: dict) -> dict:
    """The max-plus product of two neighbours' matrices."""
    at = {state: i for i, state in enumerate(right["ins"])}
    pairs = [(i, at[state]) for i, state in enumerate(left["outs"]) if state in at]
    out = np.full((len(left["ins"]), len(right["outs"])), -np.inf)
    for i, j in pairs:
        np.maximum(out, left["matrix"][:, i, None] + right["matrix"][j], out=out)
    return {"ins": left["ins"], "outs": right["outs"], "matrix": out}


def states_within(parts: list[dict], start, end) -> list[tuple]:
    """The state before and after each of ``parts`` on the best path from ``start`` to ``end``."""
    weights = [{start: 0.0}]
    back = []
    for part in parts:
        reached, came = {}, {}
        for i, state in enumerate(part["ins"]):
            if state in weights[-1]:
                for j, to in enumerate(part["outs"]):
                    weight = weights[-1][state] + part["matrix"][i, j]
                    if weight > reached.get(to, -np.inf):
                        reached[to], came[to] = weight, state
        weights.append(reached)
        back.append(came)
    out, to = [], end
    for came in reversed(back):
        out.append((came[to], to))
        to = came[to]
    return out[::-1]


def only_matrix(chunk: dict) -> dict:
    return {k: chunk[k] for k in ("ins", "outs", "matrix")}


def kept_pieces(path: str) -> Pieces:
    """One model for the life of a Python worker, which Spark uses for many tasks."""
    import sentencepiece

    kept = vars(sentencepiece).setdefault("_kept_pieces", {})
    if path not in kept:
        kept[path] = Pieces(path)
    return kept[path]


def short_encoded(docs: DataFrame, path: str) -> DataFrame:
    """Texts of one chunk, encoded as they are read."""
    def encode(batches):
        pieces = kept_pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                ids = [np.array(i, "<i4").tobytes() for i in pieces.encode(text_values(part.column(1)))]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([1] * len(ids), pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "n_chunks", "ids"])

    return docs.filter(F.length("text") < CHUNK).mapInArrow(
        lean(encode), "doc_id long, n_chunks long, ids binary")


def giant_chunks(docs: DataFrame, path: str, size: int) -> DataFrame:
    """The chunks of longer texts with their paths, each encoded in a task of its own. The first of
    a text has its ``key``, a digest of the text.
    """
    def cut(batches):
        pieces = kept_pieces(path)
        halo = pieces.longest
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc_id, text, key in zip(batch.column(0).to_pylist(), text_values(batch.column(1)),
                                         batch.column(2).to_pylist(), strict=True):
                text = pieces.prefix + text
                count = -(-len(text) // size)
                for k in range(count):
                    low, high = k * size, min((k + 1) * size, len(text))
                    since = max(low - halo, 0)
                    yield pa.RecordBatch.from_pylist([{
                        "row": number, "doc_id": doc_id, "k": k, "count": count,
                        "since": since, "low": low, "high": high, "key": None if k else key,
                        "part": text[since:high + halo]}], schema=CUT_ARROW)
                number += 1

    def paths(batches):
        pieces = kept_pieces(path)
        for batch in batches:
            for row in batch.to_pylist():
                since, k = row["since"], row["k"]
                chunk = chunk_paths(pieces, row["part"], row["low"] - since, row["high"] - since,
                                    k == 0, k == row["count"] - 1)
                # States are places in the whole text.
                for side in ("ins", "outs"):
                    chunk[side] = [s if s is None else (s[0] + since, s[1] + since) for s in chunk[side]]
                yield pa.RecordBatch.from_pylist([{
                    "row": row["row"], "doc_id": row["doc_id"], "k": k, "count": row["count"], "key": row["key"],
                    "matrix": pickle.dumps(only_matrix(chunk)), "chunk": pickle.dumps(chunk)}],
                    schema=PATH_ARROW)

    giants = docs.mapInArrow(lean(cut), CUT_SPARK)
    return staged(giants.repartition("row", "k").mapInArrow(lean(paths), PATH_SPARK), "chunk-paths")


CUT_SPARK = "row long, doc_id long, k long, count long, since long, low long, high long, key string, part string"
CUT_ARROW = pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "k", "count", "since", "low", "high")]
                      + [("key", pa.string()), ("part", pa.string())])
PATH_SPARK = "row long, doc_id long, k long, count long, key string, matrix binary, chunk binary"
PATH_ARROW = pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "k", "count")]
                       + [("key", pa.string()), ("matrix", pa.binary()), ("chunk", pa.binary())])
STATES = "row long, k long, states binary"


def chosen_states(chunks: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """row, k and the states before and after each chunk, by an up and a down pass over a tree; and
    the rows that have no path through all their chunks, which get no states.
    """
    def combine(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [pickle.loads(m) for m in frame.sort_values("k")["matrix"]]
        total = parts[0]
        for part in parts[1:]:
            total = combined(total, part)
        return pd.DataFrame([{"row": frame["row"].iat[0], "k": frame["parent"].iat[0],
                              "matrix": pickle.dumps(total), "open": bool(np.isfinite(total["matrix"]).any())}])

    def descend(children: pd.DataFrame, parents: pd.DataFrame) -> pd.DataFrame:
        children = children.sort_values("k")
        start, end = pickle.loads(parents["states"].iat[0])
        found = states_within([pickle.loads(m) for m in children["matrix"]], start, end)
        return pd.DataFrame({"row": children["row"], "k": children["k"],
                             "states": [pickle.dumps(s) for s in found]})

    # Two numbers to the driver: how many levels the largest text needs, and how many tasks.
    most, number = chunks.agg(F.max("count"), F.count("*")).first()
    tasks = -(-number // TASK_CHUNKS) or 1
    levels, width = [chunks.select("row", "k", "matrix")], most or 0

    def by_parent(level: DataFrame) -> DataFrame:
        # A matrix is small, so tasks are counted by chunks and not by bytes.
        return level.withColumn("parent", F.floor(F.col("k") / FAN).cast("long")).repartition(tasks, "row", "parent")

    while width > 1:
        levels.append(staged(by_parent(levels[-1].select("row", "k", "matrix")).groupBy("row", "parent").applyInPandas(
            combine, "row long, k long, matrix binary, open boolean"), "combined-paths"))
        width = -(-width // FAN)
    top, lost = levels[-1], None
    if len(levels) > 1:
        top, lost = top.filter("open"), top.filter("NOT open").select("row")
    ends = pickle.dumps((None, None))
    states = top.select("row", "k", F.lit(ends).alias("states"))
    for level in reversed(levels[:-1]):
        below = level.select("row", "k", "matrix")
        if lost is not None:
            below = below.join(broadcast_if_small(lost), "row", "left_anti")
        states = staged(by_parent(below).groupBy("row", "parent").cogroup(
            states.withColumnRenamed("k", "parent").groupBy("row", "parent")
        ).applyInPandas(descend, STATES), "chunk-states")
    return states, lost


def giant_encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chunks and ids of giant texts; those without a path through their chunks are cut
    again into longer ones. A row that comes twice is cut anew each time it comes.
    """
    left = docs.filter(F.length("text") >= CHUNK).select("doc_id", "text", F.sha2("text", 256).alias("key"))
    size, done = CHUNK, None
    while True:
        chunks = giant_chunks(left, path, size)
        states, lost = chosen_states(chunks)
        found = encoded_chunks(chunks, states, path)
        done = found if done is None else done.union(found)
        if lost is None or lost.isEmpty():
            return done
        # Rows alike in id and text are alike in this as well.
        again = staged(chunks.filter("k = 0").join(lost, "row", "left_semi").select(
            F.col("doc_id").alias("id"), F.col("key").alias("digest")).distinct(), "uncut")
        left = left.join(broadcast_if_small(again), F.col("doc_id").eqNullSafe(F.col("id"))
                         & (F.col("key") == F.col("digest")), "left_semi")
        size *= GROW


def encoded_chunks(chunks: DataFrame, states: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chunks and ids of the texts that have ``states``: chunks read their pieces, and
    are put in order. What is gathered in one row is one document's ids, less than its text.
    """
    states = states.withColumnRenamed("row", "r").withColumnRenamed("k", "c")
    placed = chunks.join(broadcast_if_small(states),
                         (F.col("row") == F.col("r")) & (F.col("k") == F.col("c")))

    def read(batches):
        pieces = kept_pieces(path)
        for batch in batches:
            for row in batch.to_pylist():
                chunk = pickle.loads(row["chunk"])
                start, end = pickle.loads(row["states"])
                ids = path_ids(pieces, chunk, chunk["ins"].index(start), chunk["outs"].index(end))
                yield pa.RecordBatch.from_pylist([{
                    "row": row["row"], "doc_id": row["doc_id"], "k": row["k"], "count": row["count"],
                    "ids": packed(ids)}],
                    schema=pa.schema([(n, pa.int64()) for n in ("row", "doc_id", "k", "count")]
                                     + [("ids", pa.binary())]))

    parts = placed.select("row", "doc_id", "k", "count", "chunk", "states").mapInArrow(
        lean(read), "row long, doc_id long, k long, count long, ids binary")
    whole = parts.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.first("count").alias("n_chunks"),
        F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"))

    def join(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{
                    "doc_id": row["doc_id"], "n_chunks": row["n_chunks"],
                    "ids": b"".join(unpacked(p["ids"]).tobytes() for p in row["parts"])}],
                    schema=pa.schema([("doc_id", pa.int64()), ("n_chunks", pa.int64()), ("ids", pa.binary())]))

    return whole.select("doc_id", "n_chunks", "parts").mapInArrow(
        lean(join), "doc_id long, n_chunks long, ids binary")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_chunks and ids (little-endian 32-bit) of each row of ``docs``: the ids that the
    library gives for the whole text. A null text is empty and has none; rows that come
    twice are encoded twice; columns besides doc_id and text are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return short_encoded(rows, path).union(giant_encoded(rows, path))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` with the text that its ids spell; an empty text for no ids."""
    fields = encoded.schema

    def spell(batches):
        pieces = kept_pieces(path)
        at = fields.names.index("ids")
        for batch in batches:
            for low in range(0, batch.num_rows, 100):
                part = batch.slice(low, 100)
                texts = [pieces.decode(np.frombuffer(i, "<i4").tolist()) for i in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                 [*fields.names, "decoded"])

    return encoded.mapInArrow(lean(spell), type(fields)(list(fields.fields)).add("decoded", "string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_chunks, n_pieces, ids_crc32, decoded_sha256,
    decoded_chars. An empty table gives no rows.
    """
    return decode(encode(docs, path), path).select(
        "doc_id", "n_chunks", (F.octet_length("ids") / 4).cast("long").alias("n_pieces"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        F.length("decoded").cast("long").alias("decoded_chars"))
