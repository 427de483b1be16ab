"""Documents whose sets of word shingles are alike, joined exactly (operator 7).

Two documents link when their sets have a Jaccard similarity of 0.75 or more, which asks
for an overlap T that follows from their sizes. This is T-occurrence search in the way of
DivideSkip: of the inverted lists of a document's shingles the short ones are merged, as
few as can still not miss a partner, and the long ones are only probed, by binary search
in the candidate's sorted set.

1. Equal sets, told by their digests, become one document.
2. Lists of the smallest hashes link near copies to the first and the last document
   of a list. What links is a component, within which nothing needs to be compared.
3. Of each set the third with the smallest hashes is listed. Linked documents n and m in size
   share at least 1/12 of the larger one's shingles there: T exceeds what lies outside of
   the third that ends first by that much.
4. The lists are counted; one that holds documents of a single component counts as that of a
   document's own shingle, as it cannot lead to another component. But for the longest 1/12 n - 1 of them, which are never merged, the
   lists of a document are short, and a partner stands in the same short list. A document
   with that many shingles of its own has no partner, so passages that many documents
   share cost nothing.
5. Short lists of few documents are merged across components, bounded by sizes, into pairs of
   candidates, which are probed.
6. Documents that stand in lists of more than MANY are dealt into chunks, those of the same
   longest list together. Chunks that share a list are compared as wholes, and only links
   leave the task, one for every two components: a group of thousands that are almost alike,
   but not enough, comes to no rows of pairs. Links are joined to components.

Sets are hashed from the texts again where they are needed, as they are larger than the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text, lean
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_sets
from tidemark.session import staged
from tidemark.sizing import broadcast_if_small

PERCENT = 75  # similarity of linked documents
FIRST = 12  # smallest hashes whose lists are used to link near copies
MEETINGS = 3  # of those lists in which a pair must meet to be probed
BLOCK = 250_000  # shingles of documents whose lists are asked for together
BUCKET = 250_000  # shingles whose lists are counted together
PART = 256 << 10  # bytes of texts hashed at a time
MANY = 32  # documents of a list whose pairs are listed
CHUNK = 512 << 10  # bytes of sets that are compared as a whole; a longer set is a chunk of its own
TILE = 4_096  # shingles counted at a time
EXACT = 128  # lengths of lists below this are told exactly

def hashed(docs: DataFrame, schema: str, row) -> DataFrame:
    """What ``row`` makes of each document's id and its sorted set of hashes."""
    names = [field.split()[0] for field in schema.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    arrow = [types[field.split()[1]] for field in schema.split(", ")]

    def batches(incoming):
        for batch in incoming:
            for part in parts_of(batch):
                made = [row(i, s) for i, s in zip(part.column(0).to_pylist(), shingle_sets(part.column(1)), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*made, strict=True), arrow, strict=True)], names)

    return id_and_text(docs).mapInArrow(lean(batches), schema)


def parts_of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about PART bytes, as hashing takes many times the memory of its texts."""
    rows = max(1, min(batch.num_rows, batch.num_rows * PART // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def digest_of(hashes: np.ndarray) -> bytes:
    return hashlib.md5(hashes.tobytes()).digest()


def known_sets(docs: DataFrame) -> DataFrame:
    """doc_id, the size and a digest of its set, and its smallest hashes; written."""
    return staged(hashed(docs, "doc_id long, n long, digest binary, first array<long>", lambda i, s: (
        i, len(s), digest_of(s), s[:FIRST].view(np.int64))), "shingle-sets")


def listed_part(n):
    """How many of the smallest hashes of a set of n are listed."""
    return n - 2 * n // 3


def longest_lists(n):
    """How many of the lists of a set of n, the longest, are not merged, plus one."""
    return -(-n // 12)


def overlap_needed(n, m) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil(F.lit(PERCENT) * (n + m) / (100 + PERCENT))


def probe(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of the pairs (x, y), x <> y, those that link. The smaller set is looked up in the larger.

    Each pair travels with one set at a time; a document in very many pairs is split by
    adaptive execution, as both sides of each join are plain.
    """
    ids = staged(pairs.select(F.explode(F.array("x", "y")).alias("wanted")).distinct(), "probed")
    texts = id_and_text(docs).join(broadcast_if_small(ids), F.col("doc_id") == F.col("wanted"), "left_semi")
    sets = hashed(texts, "doc_id long, hashes binary", lambda i, s: (i, s.tobytes()))
    left = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("hashes").alias("hx")), "x")
    both = left.join(sets.select(F.col("doc_id").alias("y"), F.col("hashes").alias("hy")), "y")

    def search(batches):
        for batch in batches:
            xs, ys = batch.column("x"), batch.column("y")
            hx, hy = batch.column("hx"), batch.column("hy")
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(h[i].as_buffer(), np.uint64) for h in (hx, hy))
                if not len(a) or not len(b):
                    keep.append(False)
                    continue
                small, large = (a, b) if len(a) <= len(b) else (b, a)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                met = int((large[at] == small).sum())
                keep.append(100 * met >= PERCENT * (len(a) + len(b) - met))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([xs.filter(mask), ys.filter(mask)], ["a", "b"])

    return both.select("x", "y", "hx", "hy").mapInArrow(lean(search), "a long, b long")


def near_copies(sets: DataFrame) -> DataFrame:
    """Pairs of a document with the first or last one in its lists of smallest hashes."""
    posts = staged(sets.select(
        "doc_id", "n", F.explode("first").alias("shingle")), "first-lists")
    ends = staged(posts.groupBy("shingle").agg(
        F.min(F.struct("doc_id", "n")).alias("low"), F.max(F.struct("doc_id", "n")).alias("high"),
    ).filter("low.doc_id < high.doc_id"), "list-ends")
    met = posts.join(ends, "shingle")
    pairs = met.select("doc_id", "n", F.explode(F.array("low", "high")).alias("end")).filter(
        F.col("doc_id") != F.col("end.doc_id")).select(
        F.least("doc_id", "end.doc_id").alias("x"), F.greatest("doc_id", "end.doc_id").alias("y"),
        F.least("n", "end.n").alias("least"), F.greatest("n", "end.n").alias("most"))
    pairs = pairs.filter(100 * F.col("least") >= PERCENT * F.col("most"))
    return pairs.groupBy("x", "y", "least").agg(F.count("*").alias("met")).filter(
        F.col("met") >= F.least(F.lit(MEETINGS), "least")).select("x", "y")


def blocks_of(docs: DataFrame, gone: DataFrame, known: DataFrame) -> DataFrame:
    """Documents in blocks of about BLOCK listed shingles: block, docs, components, sizes and hashes
    as bytes. A document that is not ``known`` is a component of its own.

    Those whose ids are in ``gone`` are left out. One step hashes and gathers, as every
    Python step of a task has a process of its own.
    """
    def gather(batches):
        number = TaskContext.get().partitionId() << 32
        docs, belong, sizes, hashes, held = [], [], [], [], 0
        for part in (p for batch in batches for p in parts_of(batch)):
            for doc_id, found, component in zip(part.column(0).to_pylist(), shingle_sets(part.column(1)),
                                                part.column(2).to_pylist(), strict=True):
                if doc_id is None or not len(found):
                    continue
                count = listed_part(len(found))
                docs.append(doc_id)
                belong.append(component)
                sizes.append(len(found))
                hashes.append(found[:count].tobytes())
                held += count
                if held >= BLOCK:
                    yield block_row(number, docs, belong, sizes, hashes)
                    number, docs, belong, sizes, hashes, held = number + 1, [], [], [], [], 0
        if docs:
            yield block_row(number, docs, belong, sizes, hashes)

    rows = id_and_text(docs).join(broadcast_if_small(gone), "doc_id", "left_anti").join(
        broadcast_if_small(known.withColumnRenamed("node", "doc_id")), "doc_id", "left").select(
        "doc_id", "text", F.coalesce("component", "doc_id").alias("component"))
    return staged(rows.mapInArrow(
        lean(gather), "block long, docs binary, components binary, sizes binary, hashes binary"), "shingle-blocks")


def block_row(number: int, docs: list, belong: list, sizes: list, hashes: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), pa.array([np.array(docs, np.int64).tobytes()]),
        pa.array([np.array(belong, np.int64).tobytes()]),
        pa.array([np.array(sizes, np.int64).tobytes()]), pa.array([b"".join(hashes)]),
    ], ["block", "docs", "components", "sizes", "hashes"])


def list_lengths(blocks: DataFrame, buckets: int) -> DataFrame:
    """block, bucket and a byte for each different shingle of the block, in order: a measure of
    how many documents have it, exact below EXACT and by powers of two above; 1 if all of
    them are of one component.

    A block asks once for each of its shingles, with the number of its own documents and the
    least and greatest of their components, so a shingle that a third of all documents share
    is one question per block.
    """
    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, counts = row["block"], listed_part(np.frombuffer(row["sizes"], np.int64))
                belong = np.repeat(np.frombuffer(row["components"], np.int64), counts)
                hashes = np.frombuffer(row["hashes"], np.uint64)
                order = np.argsort(hashes, kind="stable")
                unique, first, own = np.unique(hashes[order], return_index=True, return_counts=True)
                low, high = (f.reduceat(belong[order], first) for f in (np.minimum, np.maximum))
                at = ((unique >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                bounds = np.searchsorted(at, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(bounds))
                yield pa.RecordBatch.from_arrays([
                    pa.array(full), pa.array([block] * len(full), pa.int64()),
                    pa.array([unique[bounds[i]:bounds[i + 1]].tobytes() for i in full]),
                    pa.array([own[bounds[i]:bounds[i + 1]].astype(np.uint32).tobytes() for i in full]),
                    pa.array([low[bounds[i]:bounds[i + 1]].tobytes() for i in full]),
                    pa.array([high[bounds[i]:bounds[i + 1]].tobytes() for i in full]),
                ], ["bucket", "block", "shingles", "own", "low", "high"])

    def answer(frame: pd.DataFrame) -> pd.DataFrame:
        each = [np.frombuffer(s, np.uint64) for s in frame["shingles"]]
        values, inverse = np.unique(np.concatenate(each), return_inverse=True)
        low = np.full(len(values), np.iinfo(np.int64).max)
        high = np.full(len(values), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, np.frombuffer(b"".join(frame["low"]), np.int64))
        np.maximum.at(high, inverse, np.frombuffer(b"".join(frame["high"]), np.int64))
        own = np.frombuffer(b"".join(frame["own"]), np.uint32)
        total = np.bincount(inverse, own)[inverse]
        power = np.log2(np.maximum(total, EXACT)).astype(np.int64) - int(np.log2(EXACT)) + EXACT
        measure = np.where(total < EXACT, total, power).astype(np.uint8)
        measure[(low == high)[inverse]] = 1
        parts = np.split(measure, np.cumsum([len(s) for s in each])[:-1])
        return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"],
                             "lengths": [p.tobytes() for p in parts]})

    return blocks.select("block", "components", "sizes", "hashes").mapInArrow(
        lean(ask), "bucket long, block long, shingles binary, own binary, low binary, high binary"
    ).groupBy("bucket").applyInPandas(answer, "block long, bucket long, lengths binary")


def short_lists(blocks: DataFrame, buckets: int) -> DataFrame:
    """doc_id, n, shared, edge and one shingle of each of the document's short lists in which
    documents of other components stand.

    ``shared`` counts its listed shingles that other components list too, ``edge`` is the last hash that
    it lists, with the sign turned so that it is in order as a signed number.
    """
    def choose(block: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        row = block.iloc[0]
        docs, sizes = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["sizes"], np.int64)
        hashes = np.frombuffer(row["hashes"], np.uint64)
        measures = np.frombuffer(b"".join(answers.sort_values("bucket")["lengths"]), np.uint8)
        measure = measures[np.unique(hashes, return_inverse=True)[1]]
        counts = listed_part(sizes)
        starts = np.cumsum(counts) - counts
        shared = np.add.reduceat((measure > 1).astype(np.int64), starts)
        # The lists that no other component is in are the shortest.
        left = shared - longest_lists(sizes) + 1
        chosen, short = np.flatnonzero(left > 0), []
        for i in chosen.tolist():
            own, length = (x[starts[i]:starts[i] + counts[i]] for x in (hashes, measure))
            own, length = own[length > 1], length[length > 1]
            short.append(own[np.lexsort((own, length))[:left[i]]])
        each = [len(s) for s in short]
        edges = (hashes[starts + counts - 1] ^ np.uint64(1 << 63)).view(np.int64)
        return pd.DataFrame({
            "doc_id": np.repeat(docs[chosen], each), "n": np.repeat(sizes[chosen], each),
            "shared": np.repeat(shared[chosen], each), "edge": np.repeat(edges[chosen], each),
            "shingle": np.concatenate([np.empty(0, np.uint64), *short]).view(np.int64)})

    lengths = list_lengths(blocks, buckets)
    return staged(blocks.groupBy("block").cogroup(lengths.groupBy("block")).applyInPandas(
        choose, "doc_id long, n long, shared long, edge long, shingle long"), "short-lists")


def mixed_lists(posts: DataFrame, known: DataFrame) -> DataFrame:
    """Entries of short lists in which documents of several components stand, with their component,
    the largest one of the list and the number of documents in it; written.
    """
    placed = staged(posts.join(
        broadcast_if_small(known.withColumnRenamed("node", "doc_id")), "doc_id", "left"
    ).withColumn("component", F.coalesce("component", "doc_id")), "placed-lists")
    sizes = placed.groupBy("shingle", "component").agg(F.count("*").alias("size"))
    largest = staged(sizes.groupBy("shingle").agg(
        F.max(F.struct("size", "component")).alias("top"), F.count("*").alias("parts"), F.sum("size").alias("length")
    ).filter("parts > 1").select("shingle", F.col("top.component").alias("largest"), "length"), "mixed-lists")
    return staged(placed.join(largest, "shingle"), "mixed-posts")


def meeting(mixed: DataFrame) -> DataFrame:
    """Pairs of documents of different components that meet in a list of at most MANY and whose
    sizes and shared shingles leave room for the overlap they need.

    In each list the documents of its largest component are met by the others only, so that a
    list of near copies is read once.
    """
    few = mixed.filter(F.col("length") <= MANY)
    a, b = few.alias("a"), few.alias("b")
    # What one of them has beyond the listed part that ends first may be shared unseen.
    outside = F.when(F.col("a.edge") <= F.col("b.edge"), F.floor(2 * F.col("a.n") / 3)).otherwise(
        F.floor(2 * F.col("b.n") / 3))
    pairs = a.filter("a.component <> a.largest").join(b, (
        (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.component") != F.col("b.component"))
        & ((F.col("b.component") == F.col("b.largest")) | (F.col("a.doc_id") < F.col("b.doc_id")))
        & (100 * F.least("a.n", "b.n") >= PERCENT * F.greatest("a.n", "b.n"))
        & (F.least("a.shared", "b.shared") >= overlap_needed(F.col("a.n"), F.col("b.n")) - outside)))
    return pairs.select(F.least("a.doc_id", "b.doc_id").alias("x"),
                        F.greatest("a.doc_id", "b.doc_id").alias("y")).distinct()


CHUNKS = "chunk long, docs array<long>, components binary, sizes binary, hashes binary"


def chunks_of(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """The sets of documents in ``entries`` (doc_id, component, shingle, length) in chunks, in the
    order of their longest list and size; written.
    """
    wanted = staged(entries.groupBy(F.col("doc_id").alias("wanted")).agg(
        F.max(F.struct("length", "shingle")).alias("list"), F.first("component").alias("component")), "dense")
    texts = id_and_text(docs).join(broadcast_if_small(wanted.select("wanted")), F.col("doc_id") == F.col("wanted"), "left_semi")
    sets = hashed(texts, "doc_id long, n long, hashes binary", lambda i, s: (i, len(s), s.tobytes()))
    rows = sets.join(broadcast_if_small(wanted), F.col("doc_id") == F.col("wanted")).select(
        F.col("list.shingle").alias("shingle"), "n", "doc_id", "component", "hashes")
    order = ["shingle", "n", "doc_id"]

    def gather(batches):
        number = TaskContext.get().partitionId() << 32
        held: list = []
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("doc_id", "component", "n", "hashes")), strict=True):
                row = tuple(v.as_py() for v in row)
                if held and sum(len(h[3]) for h in held) + len(row[3]) > CHUNK:
                    yield chunk_row(number, held)
                    number, held = number + 1, []
                held.append(row)
        if held:
            yield chunk_row(number, held)

    return staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lean(gather), CHUNKS), "chunks")


def chunk_row(number: int, held: list) -> pa.RecordBatch:
    docs, components, sizes, hashes = zip(*held, strict=True)
    return pa.RecordBatch.from_arrays([
        pa.array([number], pa.int64()), pa.array([list(docs)], pa.list_(pa.int64())),
        *(pa.array([np.array(v, np.int64).tobytes()]) for v in (components, sizes)), pa.array([b"".join(hashes)]),
    ], ["chunk", "docs", "components", "sizes", "hashes"])


def overlaps(left: dict, right: dict) -> np.ndarray:
    """The sizes of all intersections of a set of one chunk with one of another."""
    a, b = (np.frombuffer(c["hashes"], np.uint64) for c in (left, right))
    mine, theirs = (np.repeat(np.arange(len(c["docs"])), np.frombuffer(c["sizes"], np.int64)) for c in (left, right))
    common = np.intersect1d(a, b)
    out = np.zeros((len(left["docs"]), len(right["docs"])), np.float32)
    for at in range(0, len(common), TILE):
        tile = common[at:at + TILE]
        sides = []
        for hashes, owner, count in ((a, mine, out.shape[0]), (b, theirs, out.shape[1])):
            place = np.minimum(np.searchsorted(tile, hashes), len(tile) - 1)
            inside = tile[place] == hashes
            side = np.zeros((count, len(tile)), np.float32)
            side[owner[inside], place[inside]] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    return out.astype(np.int64)


def links_between(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray]:
    """Documents of two chunks that link, one pair for every two components."""
    met = overlaps(left, right)
    n, m = (np.frombuffer(c["sizes"], np.int64) for c in (left, right))
    i, j = np.nonzero(100 * met >= PERCENT * (n[:, None] + m - met))
    p, q = np.frombuffer(left["components"], np.int64)[i], np.frombuffer(right["components"], np.int64)[j]
    apart = np.flatnonzero(p != q)
    _, first = np.unique(np.stack((p[apart], q[apart])), axis=1, return_index=True)
    keep = apart[first]
    return np.array(left["docs"])[i[keep]], np.array(right["docs"])[j[keep]]


def dense_links(mixed: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between documents that meet in lists of more than MANY."""
    entries = mixed.filter(F.col("length") > MANY)
    chunks = chunks_of(entries, docs)
    placed = entries.select("doc_id", "shingle").join(
        broadcast_if_small(chunks.select("chunk", F.explode("docs").alias("doc_id"))), "doc_id")
    lists = staged(placed.select("shingle", "chunk").distinct(), "chunk-lists")
    met = staged(lists.select("shingle", F.col("chunk").alias("x")).join(
        lists.select("shingle", F.col("chunk").alias("y")), "shingle").filter("x <= y").select("x", "y").distinct(),
        "chunk-pairs")

    def side(name: str, end: str) -> DataFrame:
        return chunks.select(F.col("chunk").alias(name), *[F.col(c).alias(f"{c}_{end}") for c in chunks.columns[1:]])

    def compare(batches):
        for batch in batches:
            for row in batch.to_pylist():
                left, right = ({k[:-2]: v for k, v in row.items() if k.endswith(end)} for end in ("_l", "_r"))
                x, y = links_between(left, right)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    # A pair travels with one of its chunks at a time, and with both only into the comparison.
    both = met.join(side("x", "l"), "x").join(side("y", "r"), "y")
    return both.drop("x", "y").mapInArrow(lean(compare), "a long, b long")


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n and component of each row of ``docs``, with ``digest`` of its set."""
    rows = known_sets(docs)
    full = rows.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    first = staged(full.groupBy("digest").agg(F.min("doc_id").alias("same")), "equal-sets")
    # Rows that are not the first of their set are known by their id and set.
    ids = full.select("doc_id", "digest")
    copies = staged(ids.join(first, "digest").filter("doc_id <> same").select("doc_id", "digest"), "copies")
    sets = full.join(broadcast_if_small(copies), ["doc_id", "digest"], "left_anti").select("doc_id", "n", "first")

    copied = probe(staged(near_copies(sets), "near-pairs"), docs)
    known = components(copied)
    total = full.agg(F.sum("n")).first()[0] or 0  # one number
    # An id that comes with another text as well is listed with all of them.
    gone = staged(copies.select("doc_id").distinct().join(
        sets.select("doc_id").distinct(), "doc_id", "left_anti"), "gone")
    lists = short_lists(blocks_of(docs, gone, known), max(1, -(-total // (3 * BUCKET))))
    mixed = mixed_lists(lists, known)
    more = probe(staged(meeting(mixed), "meeting-pairs"), docs).union(dense_links(mixed, docs))
    # Links between equal sets join the rest: an id may come with several texts.
    same = ids.join(first, "digest").select(F.col("doc_id").alias("a"), F.col("same").alias("b"))
    links = known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more).union(same)
    final = components(links)
    return rows.select("doc_id", "n", "digest").join(
        final.withColumnRenamed("node", "doc_id"), "doc_id", "left"
    ).withColumn("component", F.coalesce("component", "doc_id"))


def jaccard_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    A null or empty text, or one of white space, has no shingles and links with nothing; one of
    fewer than five words has a single shingle. Rows that repeat an id are one document
    with several texts; a null id links with nothing and has no component. Columns besides
    doc_id and text are not read, and an empty table gives no rows.
    """
    return linked(docs).select("doc_id", F.col("n").alias("n_shingles"),
                               F.col("component").alias("component_id"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id."""
    lost = staged(linked(docs).filter("component < doc_id").select(
        F.col("doc_id").alias("lost")).distinct(), "near-copies")
    return docs.join(broadcast_if_small(lost), docs["doc_id"].cast("long") == lost["lost"], "left_anti")
