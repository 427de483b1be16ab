"""Mixing sources to target weights by Sainte-Laguë apportionment (operator 10).

All of it is DataFrame operations. The words of a source lie in shards; within a shard its
documents stand in a seeded order, cut into blocks of equally many words. Blocks go to
sources, and within a source to shards, by highest quotients, which gives integer quotas.
A quota is met by whole passes over the shard plus a seeded choice of its blocks, so what a document
gives follows from its place in the shard alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE
from tidemark.session import staged
from tidemark.sizing import broadcast_if_small

WEIGHTS = (5, 2, 1)  # by the order of the sources, repeating
SHARE = 1.5  # of all words
MOST = 2  # times a source, or a document, at most
BLOCK_WORDS = 8
SHARD_WORDS = 500_000
SEED = 20


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+")).cast("long")


def with_targets(sources: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST) -> DataFrame:
    """``sources`` (source, source_size) with weight and target.

    The targets share ``share`` of all words by weight. Those above ``most`` times their source
    stop there and the rest is shared again: sorted by how soon they fill up, a source is
    full where its share of what the earlier full ones left exceeds its bound.
    """
    # One row per source; windows without a partition see nothing else.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    soonest = Window.orderBy(F.col("bound") / F.col("weight"), F.col("place"))
    before = soonest.rowsBetween(Window.unboundedPreceding, -1)
    after = soonest.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    placed = (
        sources.withColumn("place", F.row_number().over(by_name) - 1)
        .withColumn("weight", cycle[(F.col("place") % len(weights)).cast("int")])
        .withColumn("bound", F.lit(float(most)) * F.col("source_size"))
    )
    left = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(
        F.sum("bound").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    ranked = placed.withColumn("level", level)
    full = F.col("bound") <= F.col("level") * F.col("weight")
    # Sources fill up in this order, so the first that is not full sets the level of the rest.
    common = F.min(F.when(~full, F.struct(F.col("bound") / F.col("weight"), "place", "level"))).over(every)
    return ranked.select(
        "source", "place", "source_size", F.col("weight"),
        F.when(full | common.isNull(), F.least("bound", F.col("level") * F.col("weight")))
        .otherwise(common["level"] * F.col("weight")).alias("target"))


def apportioned(rows: DataFrame, group: list[str], weight: str, seats: str, ties: list[str],
                into: str) -> DataFrame:
    """Give the ``seats`` of each ``group`` to its ``rows`` by highest quotients
    weight / (2 k + 1); equal quotients go in the order of ``ties``.

    Rounding each row's exact share comes within half a seat a row of the seats, and no
    row moves further from it than its share of that gap plus one. So only so many
    quotients are listed: about one and a half a row, whatever the number of seats.
    """
    every = Window.partitionBy(*group)
    base = (
        rows.withColumn("_sum", F.sum(weight).over(every))
        .withColumn("_n", F.count("*").over(every))
        .withColumn("_part", F.when(F.col("_sum") > 0, F.col(weight) / F.col("_sum")).otherwise(0.0))
        .withColumn("_rounded", F.floor(F.col("_part") * F.col(seats) + 0.5).cast("long"))
        .withColumn("_gap", F.col(seats) - F.sum("_rounded").over(every))
        .withColumn("_reach", F.ceil(F.col("_part") * F.col("_n") / 2).cast("int") + 1)
    )
    # Quotients of the seats that a row would get next, or of those that it would lose first.
    steps = F.when(F.col("_gap") > 0, F.transform(
        F.sequence(F.lit(0), F.col("_reach")),
        lambda k: F.struct(F.lit(1).alias("by"), (F.col(weight) / (2 * (F.col("_rounded") + k) + 1)).alias("quotient")),
    )).when(F.col("_gap") < 0, F.filter(F.transform(
        F.sequence(F.lit(1), F.col("_reach") + 1),
        lambda k: F.struct(F.when(F.col("_rounded") >= k, F.lit(-1)).otherwise(F.lit(0)).alias("by"),
                           (-F.col(weight) / (2 * (F.col("_rounded") - k) + 1)).alias("quotient")),
    ), lambda s: s["by"] < 0))
    order = Window.partitionBy(*group).orderBy(F.col("step.quotient").desc(), *ties)
    moved = (
        base.filter(F.col("_part") > 0).select(*group, *ties, "_gap", F.explode(steps).alias("step"))
        .withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= F.abs("_gap"))
        .groupBy(*dict.fromkeys([*group, *ties])).agg(F.sum("step.by").cast("long").alias("_by"))
    )
    keys = list(dict.fromkeys([*group, *ties]))
    return base.join(moved, keys, "left").withColumn(
        into, F.col("_rounded") + F.coalesce("_by", F.lit(0))
    ).drop("_sum", "_n", "_part", "_rounded", "_gap", "_reach", "_by")


def mix(docs: DataFrame, weights=WEIGHTS, share=SHARE, most=MOST, seed=SEED,
        block_words=BLOCK_WORDS, shard_words=SHARD_WORDS, columns: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, source.

    ``taken`` counts the words the mix takes from a document, repeats included, at most
    ``most`` times its size. A null text has no words; a null source is a source of its
    own, the last. Rows that come twice count twice. A document without words gives none,
    and an empty table no rows. Equal input gives equal results, however it is partitioned.
    """
    rows = staged(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        word_count(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("size")), "sizes")
    targets = staged(with_targets(
        rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
        .withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
        .withColumn("parts", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"))
        .withColumn("every", F.lit(0)).withColumn("seats", F.round(
            F.sum("target").over(Window.partitionBy("every")) / block_words).cast("long")),
        "targets")
    quotas = apportioned(targets, ["every"], "target", "seats", ["place"], "quota")

    # Shards hold about equally many words; a source with a third of all rows has a third of them.
    dealt = rows.join(
        targets.select(F.col("source").alias("of"), "place", "parts"),
        F.col("source").eqNullSafe(F.col("of"))
    ).select("doc_id", "source", "size", "place",
             F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("parts")).alias("shard"),
             F.xxhash64(F.lit(seed + 1), "doc_id").alias("draw"))
    ordered = Window.partitionBy("place", "shard").orderBy("draw", "doc_id", "size")
    dealt = staged(dealt.withColumn(
        "until", F.sum("size").over(ordered.rowsBetween(Window.unboundedPreceding, 0))), "dealt")

    shards = dealt.groupBy("place", "shard").agg(F.max("until").alias("words")).join(
        quotas.select("place", "source_size", "target", "quota"), "place")
    shards = apportioned(shards, ["place"], "words", "quota", ["shard"], "blocks")
    count = F.ceil(F.col("words") / block_words).cast("long")
    shards = staged(shards.select(
        F.col("place").alias("p"), F.col("shard").alias("s"), "source_size", "target",
        F.greatest(count, F.lit(1)).alias("n"), F.least("blocks", most * count).alias("quota")), "quotas")

    # Every block is taken `whole` times; `extra` blocks in a row, from a seeded one on and going on
    # at the first after the last, once more. Documents stand in a seeded order, so these are
    # a seeded choice of documents, whole but for the two at its ends.
    whole = F.floor(F.col("quota") / F.col("n"))
    first = F.pmod(F.xxhash64(F.lit(seed + 2), "place", "shard"), F.col("n")) * block_words
    last = first + (F.col("quota") - whole * F.col("n")) * block_words
    again = F.greatest(last - F.col("n") * block_words, F.lit(0))

    def taken_before(word: Column) -> Column:
        return whole * word + F.greatest(F.least(word, last) - first, F.lit(0)) + F.least(word, again)

    taken = taken_before(F.col("until")) - taken_before(F.col("until") - F.col("size"))
    return dealt.join(shards, (F.col("place") == F.col("p")) & (F.col("shard") == F.col("s"))).select(
        "doc_id", "size", "source_size", "target",
        F.when(F.col("size") == 0, F.lit(0)).otherwise(taken).cast("long").alias("taken"), "source")


def mixed(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` as the mix takes them: each row as many times as the nearest whole number of its
    passes, none, one or two. A document that the mix takes half of comes whole.

    Rows of one id, source and size are treated alike.
    """
    number = F.floor(F.col("taken") / F.greatest("size", F.lit(1)) + 0.5).cast("int")
    passes = staged(mix(docs, **settings).groupBy("doc_id", "source", "size").agg(
        F.min(number).alias("passes")), "passes").filter("passes > 0").select(
        F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"),
        F.col("passes").alias("__passes"))
    size = word_count(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("__words", size).join(broadcast_if_small(passes), (
        F.col("doc_id").cast("long").eqNullSafe(F.col("__id"))
        & F.col("source").cast("string").eqNullSafe(F.col("__source")) & (F.col("__words") == F.col("__size")))
    ).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__passes")))).select(*docs.columns)
