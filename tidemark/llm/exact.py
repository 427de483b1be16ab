"""Exact duplicates against a minimal perfect hash of earlier digests (operator 4).

The distinct digests of the documents seen so far go into buckets by their first bytes. In
each bucket a minimal perfect hash gives every digest a slot of its own, which holds the
whole digest and the locator of the row that stays. A new digest is looked up in its
bucket: its slot is compared byte by byte, so that a digest which is not a member is never
taken for one. Members join the group of their slot, all others are grouped among
themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_views, lean
from tidemark.session import staged
from tidemark.sizing import broadcast_if_small

BUCKET_DIGESTS = 4_000  # distinct digests to a bucket, on average
LOAD = 2.0  # bits per digest on each level of the hash
LEVELS = 48
WORDS = 4  # 64-bit words of a digest
LEAST = -(1 << 63)  # stands for a null doc_id, which loses to any other


def mixed(keys: np.ndarray, level: int) -> np.ndarray:
    """A hash of each digest for one level; digests are uniform already, so two words do."""
    with np.errstate(over="ignore"):
        x = keys[:, 1] ^ (keys[:, 2] * np.uint64(2 * level + 1))
        x ^= x >> np.uint64(29)
        x *= np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Levels of bits: a digest's slot is the rank of the first bit that it alone has set.

    On each level a digest sets one bit; bits set by one digest only are kept, digests that
    met go on to the next level. What is left after the last level is listed as it is.
    """

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest
        kept = [int(b.sum()) for b in bits]
        self.before = np.concatenate(([0], np.cumsum(kept))).astype(np.int64)
        self.ranks = [np.cumsum(b, dtype=np.int64) - 1 for b in bits]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """Of distinct ``keys``, n rows of four 64-bit words."""
        bits: list[np.ndarray] = []
        while len(keys) and len(bits) < LEVELS:
            size = max(64, int(LOAD * len(keys)))
            at = (mixed(keys, len(bits)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            keys = keys[~alone[at]]
        return cls(bits, keys)

    def __len__(self) -> int:
        return int(self.before[-1]) + len(self.rest)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some that are not members. Others that are not get
        a slot all the same, which only comparing the digest it holds can tell.
        """
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, bits in enumerate(self.bits):
            if not len(open_):
                break
            at = (mixed(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[open_[hit]] = self.before[level] + self.ranks[level][at[hit]]
            open_ = open_[~hit]
        for i, key in enumerate(self.rest):
            same = open_[(keys[open_] == key).all(axis=1)]
            out[same] = self.before[-1] + i
        return out

    def to_bytes(self) -> bytes:
        sizes = np.array([len(self.bits), len(self.rest), *map(len, self.bits)], "<i8")
        return b"".join([sizes.tobytes(), *(np.packbits(b).tobytes() for b in self.bits),
                         self.rest.astype("<u8").tobytes()])

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        levels, rest = np.frombuffer(data, "<i8", 2).tolist()
        sizes, at, bits = np.frombuffer(data, "<i8", levels, 16).tolist(), 16 + 8 * levels, []
        for size in sizes:
            length = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, length, at), count=size).astype(bool))
            at += length
        return cls(bits, np.frombuffer(data, "<u8", WORDS * rest, at).reshape(-1, WORDS))


def with_digest(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` of ``docs``, then ``text_sha256``: 32 bytes, of the text in UTF-8 with A-Z
    in lower case; null counts as empty.
    """
    source = docs.select(*columns, F.col("text").cast("string").alias("__text"))
    names = [*columns, "__digest"]

    def digest(batches):
        for batch in batches:
            lower = pc.ascii_lower(batch.column(len(columns)))
            values = [hashlib.sha256(v).digest() for v in byte_views(lower)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(columns)], pa.array(values, pa.binary())], names)

    fields = [f for f in source.schema.fields if f.name != "__text"]
    schema = type(source.schema)(fields).add("__digest", "binary")
    return source.mapInArrow(lean(digest), schema)


def located(docs: DataFrame) -> DataFrame:
    """doc_id, digest and row, a number of the row in this table; written once."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return staged(with_digest(rows, ["doc_id"]).select(
        "doc_id", F.col("__digest").alias("digest"),
        F.monotonically_increasing_id().alias("row")), "digests")


def grouped(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays, by the largest doc_id and then the last row, and how many
    there are. Summed up before the shuffle, so a hot digest is one row per map task.
    """
    locator = F.struct(F.coalesce("doc_id", F.lit(LEAST)).alias("doc_id"), "row")
    return rows.groupBy("digest").agg(
        F.max(locator).alias("winner"), F.count("*").alias("group_size")
    ).select("digest", F.col("winner.doc_id").alias("keep_id"),
             F.col("winner.row").alias("keep_row"), "group_size")


def bucket(digest, buckets: int):
    return F.pmod(F.conv(F.substring(F.hex(digest), 1, 8), 16, 10).cast("long"), F.lit(buckets))


def words_of(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(digests), "<u8").reshape(-1, WORDS)


INDEX = ("bucket long, hash binary, digests binary, keep_id binary, keep_row binary, "
         "group_size binary")


def build_index(groups: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: the perfect hash, and in slot order the digests and locators."""
    def build(frame: pd.DataFrame) -> pd.DataFrame:
        keys = words_of(frame["digest"])
        hashed = PerfectHash.build(keys)
        order = np.argsort(hashed.slots(keys))
        numbers = {c: frame[c].to_numpy(np.int64)[order].tobytes()
                   for c in ("keep_id", "keep_row", "group_size")}
        return pd.DataFrame([{
            "bucket": frame["bucket"].iat[0], "hash": hashed.to_bytes(),
            "digests": keys[order].tobytes(), **numbers}])

    return staged(groups.withColumn("bucket", bucket("digest", buckets)).groupBy("bucket")
                  .applyInPandas(build, INDEX), "digest-index")


GROUPS = "digest binary, keep_id long, keep_row long, group_size long, member boolean"


def merge(index: DataFrame, fresh: DataFrame, buckets: int) -> DataFrame:
    """All groups after ``fresh`` ones came to those of ``index``. ``member`` tells whether a
    digest was in the index. Where the group goes on, its later winner stays.
    """
    def look_up(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        if old.empty:
            return new[["digest", "keep_id", "keep_row", "group_size"]].assign(member=False)
        row = old.iloc[0]
        digests = np.frombuffer(row["digests"], "<u8").reshape(-1, WORDS)
        held = {c: np.frombuffer(row[c], np.int64).copy() for c in ("keep_id", "keep_row", "group_size")}
        others = []
        if len(new):
            keys = words_of(new["digest"])
            slots = PerfectHash.from_bytes(row["hash"]).slots(keys)
            member = slots >= 0
            member[member] = (digests[slots[member]] == keys[member]).all(axis=1)
            others = [new[~member][["digest", "keep_id", "keep_row", "group_size"]].assign(member=False)]
            at, come = slots[member], new[member]
            ids, rows = come["keep_id"].to_numpy(), come["keep_row"].to_numpy()
            later = (ids > held["keep_id"][at]) | (
                (ids == held["keep_id"][at]) & (rows > held["keep_row"][at]))
            held["keep_id"][at[later]] = ids[later]
            held["keep_row"][at[later]] = rows[later]
            held["group_size"][at] += come["group_size"].to_numpy()
        raw = digests.astype("<u8").tobytes()
        mine = pd.DataFrame({"digest": [raw[i:i + 32] for i in range(0, len(raw), 32)], **held,
                             "member": True})
        return pd.concat([mine, *others], ignore_index=True)

    return index.groupBy("bucket").cogroup(
        fresh.withColumn("bucket", bucket("digest", buckets)).groupBy("bucket")
    ).applyInPandas(look_up, GROUPS)


def groups_of(rows: DataFrame) -> DataFrame:
    """The groups of equal digests of ``rows`` (from ``located``).

    The rows up to about the median id are the history, whose distinct digests are indexed;
    the newer ones are looked up in it. Buckets are sized by the side with more digests, so
    that none is large on either, however ids and copies are spread.
    """
    # One number; ids alone are read. Where it lies decides the time only.
    middle = rows.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    old = F.coalesce(F.col("doc_id") <= F.lit(middle).cast("long"), F.lit(True))
    history = staged(grouped(rows.filter(old)), "history")
    fresh = staged(grouped(rows.filter(~old)), "fresh")
    buckets = max(1, -(-max(history.count(), fresh.count()) // BUCKET_DIGESTS))
    return staged(merge(build_index(history, buckets), fresh, buckets), "groups")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays, and of rows that repeat that id just
    one; a null doc_id loses to any other and a null text is empty. An empty table gives no rows.

    Only groups of two and more are joined back, on the digest, against plain files on both
    sides, so that adaptive execution can split the partition of a hot digest.
    """
    rows = located(docs)
    copies = staged(groups_of(rows).filter("group_size > 1").drop("member"), "copies")
    return rows.join(copies, "digest", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id"))
        .otherwise(F.nullif("keep_id", F.lit(LEAST))).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one that ``exact_duplicates`` keeps."""
    rows = located(docs)
    copies = staged(groups_of(rows).filter("group_size > 1").select("digest", "keep_id"), "copies")
    known = F.coalesce("doc_id", F.lit(LEAST))
    members = rows.select(known.alias("id"), "digest").join(copies, "digest")
    lost = staged(members.filter("id <> keep_id").select("id", "digest").distinct(), "lost")
    again = staged(members.filter("id = keep_id").groupBy("id", "digest").agg(
        F.count("*").alias("times")).filter("times > 1").drop("times"), "repeated")
    marked = with_digest(docs, docs.columns).withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST)))

    def same(other):
        return (marked["__id"] == other["id"]) & (marked["__digest"] == other["digest"])

    left = marked.join(broadcast_if_small(lost), same(lost), "left_anti")
    once = left.join(broadcast_if_small(again), same(again), "left_anti")
    if again.limit(1).count():  # rows that repeat the id as well; of these one stays
        once = once.union(left.join(broadcast_if_small(again), same(again), "left_semi")
                          .dropDuplicates(["__id", "__digest"]))
    return once.select(*docs.columns)
