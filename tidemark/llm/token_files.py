"""Token ids in binary shards of patched frame-of-reference blocks (operator 9).

A shard holds the ids of a range of documents, in ascending order of their ids:

    "TKF1"
    blocks      each of up to 1024 ids: u32 minimum, u16 count, u16 exceptions, u8 width,
                the packed low bits of id - minimum, u16 positions and u32 values of the
                exceptions
    documents   i64 doc_id, u8 present, u32 count, as three arrays
    starts      u64 offset of each block
    footer      u64 offset of documents, u64 documents, u64 blocks, u64 ids, "TKF1"

The width of a block is the number of bits that a share of its ids needs at most; ids
that need more are exceptions, stored whole beside it. ``starts`` finds the block of any
id without reading those before it.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SharedFiles, id_and_text
from tidemark.session import run_folder, staged

BLOCK = 1024
PERCENTILE = 90
MAGIC = b"TKF1"
HEAD, HEAD_SIZE = "<IHHB", struct.calcsize("<IHHB")
FOOTER, FOOTER_SIZE = "<QQQQ4s", struct.calcsize("<QQQQ4s")
GROUP = 1024  # blocks packed or unpacked at a time
END_ID = 2

# A single space between two characters that are not white space always begins a new pre-token
# of a byte-level tokenizer, and so does a full stop or comma after a letter: what lies between
# two such places is encoded alone.
WHITE = (r"\t\n\x0b\x0c\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
         r"\x{202f}\x{205f}\x{3000}")
CUT = "\x1e"
UNEVEN = rf"[{WHITE}] | [{WHITE}]|^ | $|{CUT}"  # texts in which other spaces come, or CUT
WORD = re.compile(r"(?<=\S)(?= \S)")
CACHED, LONG = 150_000, 64  # encoded pieces kept in each half of the cache, characters of one
JOINED = 100  # pieces encoded in one text


class Encoder:
    """Ids of texts, from pieces that the tokenizer encodes when they are first seen.

    The pieces seen of late are kept in two halves; when the younger is full it becomes the
    older, whose pieces are forgotten unless they came again.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for piece, i in vocabulary.items() if piece.startswith("\u0120")]] = True

    def encoded(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces, as bytes."""
        values = list(map(self.young.get, pieces))
        fresh: tuple[list[int], list[int]] = [], []
        for i, value in enumerate(values):
            if value is None:
                piece = pieces[i]
                value = self.old.get(piece)
                if value is None:
                    word = len(piece) > 1 and piece[0] == " " and not (
                        piece[1].isspace() or piece[-1].isspace())
                    fresh[word].append(i)
                else:
                    values[i] = self.young[piece] = value
        for of, encode in zip(fresh, (self._apart, self._words), strict=True):
            for at in range(0, len(of), 64 * JOINED):
                part = of[at:at + 64 * JOINED]
                for i, value in zip(part, encode([pieces[i] for i in part]), strict=True):
                    values[i] = value
                    if len(pieces[i]) <= LONG:
                        self.young[pieces[i]] = value
        if len(self.young) > CACHED:
            self.young, self.old = {}, self.young
        return values

    def _apart(self, pieces: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)
        return [np.array(e.ids, np.uint32).tobytes() for e in found]

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Pieces that begin with a space and have no other at either end, many in one text:
        in it only the first id of each stands for something that begins with a space.
        """
        out: list[bytes] = []
        joined = ["".join(pieces[i:i + JOINED]) for i in range(0, len(pieces), JOINED)]
        for n, encoding in enumerate(self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)):
            ids = np.array(encoding.ids, np.uint32)
            part = pieces[n * JOINED:(n + 1) * JOINED]
            cuts = np.flatnonzero(self.spaced[ids]).tolist()
            if len(cuts) == len(part) and not any(s in joined[n] for s in self.specials):
                data = ids.tobytes()
                out += [data[4 * low:4 * high] for low, high in
                        zip(cuts, [*cuts[1:], len(ids)], strict=True)]
            else:
                out += self._apart(part)
        return out

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        texts = pc.fill_null(texts, "")
        uneven = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        out: list = [None] * len(texts)
        for i in np.flatnonzero(uneven).tolist():
            words = WORD.split(texts[i].as_py())
            different = list(dict.fromkeys(words))
            found = dict(zip(different, self.encoded(different), strict=True))
            out[i] = np.frombuffer(b"".join([found[w] for w in words]), np.uint32)
        even = np.flatnonzero(~uneven)
        if len(even):
            for i, ids in zip(even.tolist(), self._even(texts.take(pa.array(even))), strict=True):
                out[i] = ids
        return out

    def _even(self, texts: pa.Array) -> list[np.ndarray]:
        """Texts whose spaces all part two words: each different piece is looked up once."""
        spaced = pc.replace_substring(texts, " ", CUT + " ")
        lists = pc.split_pattern(
            pc.replace_substring_regex(spaced, r"(\p{L})([.,])", rf"\1{CUT}\2"), CUT)
        starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
        pieces = lists.flatten().dictionary_encode()
        codes = pieces.indices.to_numpy()
        table = self.encoded(pieces.dictionary.to_pylist())
        sizes = np.fromiter(map(len, table), np.int64, len(table)) // 4
        flat = np.frombuffer(b"".join(table), np.uint32)
        lengths = sizes[codes]
        ends = lengths.cumsum()
        begins = (sizes.cumsum() - sizes)[codes] - (ends - lengths)
        ids = flat[np.repeat(begins, lengths) + np.arange(int(ends[-1]))]
        bounds = ends[np.append(starts[1:], len(codes)) - 1]
        return np.split(ids, bounds[:-1])


def kept_encoder(path: str) -> Encoder:
    """One encoder for the life of a Python worker, which Spark uses for many tasks."""
    import tokenizers

    kept = vars(tokenizers).setdefault("_kept_encoders", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def in_parts(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts, the second column, come to about ``size`` bytes."""
    for batch in batches:
        rows = max(1, min(batch.num_rows, batch.num_rows * size // max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def pack(ids: np.ndarray) -> list[bytes]:
    """Blocks of ``ids``, all but the last full."""
    out: list[bytes] = []
    for at in range(0, len(ids), BLOCK * GROUP):
        part = ids[at:at + BLOCK * GROUP].astype(np.int64)
        full = len(part) // BLOCK * BLOCK
        for rows in (part[:full].reshape(-1, BLOCK), part[full:].reshape(1, -1)):
            if rows.size:
                out += _pack_rows(rows)
    return out


def _pack_rows(rows: np.ndarray) -> list[bytes]:
    least = rows.min(axis=1)
    deltas = (rows - least[:, None]).astype("<u4")
    bits = np.zeros(deltas.shape, np.uint8)
    np.frexp(deltas.astype(np.float64))[1].astype(np.uint8, copy=False).clip(0, 32, out=bits)
    widths = np.percentile(bits, PERCENTILE, axis=1, method="higher").astype(int)
    blocks: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        of = np.flatnonzero(widths == width)
        if width:
            plain = np.unpackbits(deltas[of].view(np.uint8).reshape(len(of), -1, 4), axis=2,
                                  count=width, bitorder="little")
            packed = np.packbits(plain.reshape(len(of), -1), axis=1, bitorder="little")
        else:
            packed = np.zeros((len(of), 0), np.uint8)
        for i, low in zip(of.tolist(), packed, strict=True):
            odd = np.flatnonzero(bits[i] > width)
            blocks[i] = b"".join((
                struct.pack(HEAD, int(least[i]), rows.shape[1], len(odd), width), low.tobytes(),
                odd.astype("<u2").tobytes(), deltas[i][odd].tobytes()))
    return blocks


def unpack(data: bytes | memoryview, starts: list[int]) -> np.ndarray:
    """The ids of the blocks of ``data`` that begin at ``starts``."""
    heads = [struct.unpack_from(HEAD, data, at) for at in starts]
    sizes = np.array([0, *(h[1] for h in heads)], np.int64).cumsum()
    out = np.empty(int(sizes[-1]), np.uint32)
    shapes: dict[tuple[int, int], list[int]] = {}
    for i, (_, count, _, width) in enumerate(heads):
        shapes.setdefault((count, width), []).append(i)
    raw = np.frombuffer(data, np.uint8)
    for (count, width), of in shapes.items():
        length = (count * width + 7) // 8
        if width:
            packed = np.stack([raw[(a := starts[i] + HEAD_SIZE):a + length] for i in of])
            plain = np.unpackbits(packed, axis=1, count=count * width, bitorder="little")
            low = np.packbits(plain.reshape(len(of), count, width), axis=2, bitorder="little")
            wide = np.zeros((len(of), count, 4), np.uint8)
            wide[:, :, :low.shape[2]] = low
            values = wide.view("<u4")[:, :, 0]
        else:
            values = np.zeros((len(of), count), np.uint32)
        for row, i in zip(values, of, strict=True):
            least, _, odd, _ = heads[i]
            if odd:
                at = starts[i] + HEAD_SIZE + length
                row = row.copy()
                row[np.frombuffer(data, "<u2", odd, at)] = np.frombuffer(data, "<u4", odd, at + 2 * odd)
            out[sizes[i]:sizes[i + 1]] = row + np.uint32(least)
    return out


class ShardWriter:
    """Collects documents and yields the bytes of a shard as blocks fill up."""

    def __init__(self):
        self.ids, self.present, self.counts = [], [], []
        self.starts: list[int] = []
        self.at = len(MAGIC)
        self.total = 0

    def chunks(self, documents: Iterable[tuple[int | None, np.ndarray]]) -> Iterator[bytes]:
        yield MAGIC
        waiting, held = [], 0
        for doc_id, ids in documents:
            self.ids.append(doc_id or 0)
            self.present.append(doc_id is not None)
            self.counts.append(len(ids))
            waiting.append(ids)
            held += len(ids)
            if held >= BLOCK * GROUP:
                joined = np.concatenate(waiting)
                full = held // BLOCK * BLOCK
                yield self._blocks(joined[:full])
                waiting, held = [joined[full:]], held - full
        if held:
            yield self._blocks(np.concatenate(waiting))
        documents_at = self.at
        yield np.array(self.ids, "<i8").tobytes()
        yield np.array(self.present, "u1").tobytes()
        yield np.array(self.counts, "<u4").tobytes()
        yield np.array(self.starts, "<u8").tobytes()
        yield struct.pack(FOOTER, documents_at, len(self.ids), len(self.starts), self.total, MAGIC)

    def _blocks(self, ids: np.ndarray) -> bytes:
        self.total += len(ids)
        blocks = pack(ids)
        for block in blocks:
            self.starts.append(self.at)
            self.at += len(block)
        return b"".join(blocks)


class ShardReader:
    """Reads a shard: its documents, and any range of its ids by the block index."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        file.seek(size - FOOTER_SIZE)
        at, documents, blocks, self.total, magic = struct.unpack(FOOTER, file.read(FOOTER_SIZE))
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        file.seek(at)
        tail = file.read(size - FOOTER_SIZE - at)
        self.end = at
        self.doc_ids = np.frombuffer(tail, "<i8", documents)
        self.present = np.frombuffer(tail, "u1", documents, 8 * documents)
        self.counts = np.frombuffer(tail, "<u4", documents, 9 * documents)
        self.starts = np.frombuffer(tail, "<u8", blocks, 13 * documents).astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """The ids of the blocks from ``first`` to before ``last``."""
        if first >= last:
            return np.empty(0, np.uint32)
        at = int(self.starts[first])
        to = int(self.starts[last]) if last < len(self.starts) else self.end
        self.file.seek(at)
        data = self.file.read(to - at)
        return unpack(data, (self.starts[first:last] - at).tolist())

    def ids(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from place ``start`` of the shard; reads only their blocks."""
        first, last = start // BLOCK, -(-(start + count) // BLOCK)
        return self.blocks(first, last)[start - first * BLOCK:][:count]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, block = np.empty(0, np.uint32), 0
        for doc_id, present, count in zip(self.doc_ids.tolist(), self.present.tolist(),
                                          self.counts.tolist(), strict=True):
            while len(held) < count:
                more = self.blocks(block, min(block + GROUP, len(self.starts)))
                block += GROUP
                held = np.concatenate((held, more)) if len(held) else more
            yield (doc_id if present else None), held[:count]
            held = held[count:]


def write_token_files(docs: DataFrame, tokenizer_path: str) -> tuple[SharedFiles, DataFrame]:
    """Write the ids of ``docs`` to shards in ascending order of doc_id (null first; rows of
    one id in the order of their texts), each document followed by id 2.

    Returns the files and their list, one row per shard: shard, name, n_docs, n_tokens.
    A null text counts as empty. Texts are dealt out by ranges of doc_id and only then
    encoded, each in its own task; nothing is gathered.
    """
    files = SharedFiles(run_folder(docs.sparkSession, "token-files"))

    def write(batches):
        encoder = kept_encoder(tokenizer_path)
        end = np.array([END_ID], np.uint32)
        shard = TaskContext.get().partitionId()
        encoded = (pair for b in in_parts(batches) for pair in zip(
            b.column(0).to_pylist(), encoder.ids(b.column(1)), strict=True))
        first = next(encoded, None)
        if first is None:
            return
        writer, name = ShardWriter(), f"shard-{shard:06d}.tkf"
        documents = ((i, np.concatenate((ids, end))) for i, ids in chain((first,), encoded))
        files.write(name, writer.chunks(documents))
        yield pa.RecordBatch.from_pylist([{
            "shard": shard, "name": name, "n_docs": len(writer.ids), "n_tokens": writer.total}])

    ordered = id_and_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    written = ordered.mapInArrow(write, "shard long, name string, n_docs long, n_tokens long")
    return files, staged(written, "token-shards")


def read_token_files(files: SharedFiles, shards: DataFrame) -> DataFrame:
    """Read shards back: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select(
        "shard", "name", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with files.open(row["name"]) as file:
                    yield from _document_rows(ShardReader(file), row["base"])

    return placed.repartition(max(1, shards.count())).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _document_rows(reader: ShardReader, base: int, size: int = 4096):
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    types = [pa.int64()] * 4
    rows = []
    for doc_id, ids in reader.documents():
        rows.append((doc_id, base, len(ids), zlib.crc32(ids.astype("<u4", copy=False).tobytes())))
        base += len(ids)
        if len(rows) >= size:
            yield _batch(rows, names, types)
            rows = []
    if rows:
        yield _batch(rows, names, types)


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def token_files(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Encode, write and read back. An empty table gives no rows; an empty text one id, the
    end; a row that comes twice is written twice. Columns besides doc_id and text are not read.
    """
    return read_token_files(*write_token_files(docs, tokenizer_path))
