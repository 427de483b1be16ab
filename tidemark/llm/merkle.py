"""A Merkle manifest of a dataset, and proofs that climb it (operator 13).

Every row is a leaf; leaves of a language stand in the order of their ids, and every eight
nodes in a row have a parent until one is left, the language's root. Those are the leaves
of one more tree, whose last node is the root of the dataset. The levels are stored as node
rows, each with its children's digests and the link to its own parent. A recursive query
then takes every leaf up those links: at each node it lists the siblings met and folds the
digest of a row, tampered or not, into that of the node.

Upper nodes are met by many leaves. A node row comes once for every COPY leaves below it,
and a leaf goes to the copy that its number names, so that no task gets more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged

FAN = 8
COPY = 8_192  # leaves that meet one copy of a node row
TOP = -1  # number of the tree over the languages' roots
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 16 << 20
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def framed(value: Column) -> Column:
    """A field as it is hashed: `-` for null, else its count of bytes, a colon and itself."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(text: Column) -> Column:
    fields = [framed(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")]
    return digest(F.concat(*fields, framed(text)))


def tampered_with(doc_id: Column) -> Column:
    """Rows that the proof is tried on with a changed text: 3 divides the crc32 of their id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 0


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, lang, leaf and changed (the leaf of the tampered row, binary), as they are hashed."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       F.col("lang").cast("string").alias("lang"), F.col("n_chars").cast("long").alias("n_chars"),
                       F.col("text").cast("string").alias("text"))
    text = F.when(tampered_with(F.col("doc_id")), F.translate("text", CAPITALS, SMALL)).otherwise(F.col("text"))
    return rows.select("doc_id", "lang", F.unhex(leaf(F.col("text"))).alias("leaf"), F.unhex(leaf(text)).alias("changed"))


def bounded(rows: DataFrame) -> DataFrame:
    """A table to join, broadcast if at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes are counted."""
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("binary" if t == "binary" else "string")), F.lit(8))
                for c, t in rows.dtypes), F.lit(0))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(rows) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else rows


def dealt(rows: DataFrame, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in ranges of ``order``, written with ``at``, a number that grows with the order; and
    per partition (at's upper bits) and value of order's first column ``n`` and ``before``, the
    rows of that value in partitions before. Nothing is sorted in one task, whatever its size.
    """
    keys = [*order, "tie"]
    rows = rows.withColumn("tie", F.monotonically_increasing_id())  # so that equal rows can be split
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("tie")
    rows = staged(rows.withColumn("at", F.monotonically_increasing_id()), name)
    counts = rows.groupBy(F.shiftright("at", ROW_BITS).alias("part"), order[0]).agg(
        F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy(order[0]).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # As many rows as partitions and values together: a partition holds a range.
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return rows, staged(counts, f"{name}-counts")


def height(size) -> Column:
    """How many levels a tree over ``size`` leaves has above them."""
    return F.size(F.filter(F.sequence(F.lit(0), F.lit(20)), lambda h: F.call_function(
        "shiftleft", F.lit(1).cast("long"), h * 3) < size))


def placed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The leaves with the number of their tree, its size and height, and their place in it; and
    the trees. Trees are numbered in the order of the languages.
    """
    rows, counts = dealt(leaves(docs), ["lang", "doc_id", "leaf"], "leaves")
    langs = counts.groupBy("lang").agg(F.sum("n").alias("size"))
    langs, spread = dealt(langs.withColumn("all", F.lit(0)), ["all", "lang"], "languages")
    part = F.shiftright("at", ROW_BITS)
    trees = langs.join(bounded(spread.select("part", "first", "before")), part == F.col("part")).select(
        "lang", (F.col("at") - F.col("first") + F.col("before")).alias("tree"), "size",
        height(F.col("size")).alias("height"))
    trees = staged(trees, "trees")
    ranges = counts.withColumnRenamed("lang", "name").join(
        bounded(trees), F.col("name").eqNullSafe(F.col("lang"))).select(
        "part", "name", (F.col("before") - F.col("first")).alias("shift"), "tree", "size", "height")
    ranges = staged(ranges, "ranges")
    known = rows.join(bounded(ranges), (part == F.col("part")) & F.col("lang").eqNullSafe(F.col("name"))).select(
        "doc_id", "tree", "size", "height", (F.col("at") + F.col("shift")).alias("pos"), "leaf", "changed",
        F.col("at").alias("number"))
    return staged(known, "placed"), trees


NODE = ["tree", "level", "pos", "size", "height", "below", "hash", "children"]


def parents(level: DataFrame, number: int) -> DataFrame:
    """The nodes above those of ``level`` whose tree goes on: at most eight rows meet in each."""
    run = level.filter(F.col("height") >= number).groupBy(
        "tree", "size", "height", F.expr(f"pos DIV {FAN}").alias("up")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "hash", "below"))).alias("run"))
    return run.select(
        "tree", F.lit(number).alias("level"), F.col("up").alias("pos"), "size", "height",
        F.expr("aggregate(run, 0L, (a, c) -> a + c.below)").alias("below"),
        F.unhex(digest(F.concat_ws("", F.transform("run", lambda c: F.lower(F.hex(c["hash"])))))).alias("hash"),
        F.expr("aggregate(run, X'', (a, c) -> concat(a, c.hash))").alias("children"))


def built(bottom: DataFrame, name: str) -> DataFrame:
    """All nodes of the trees over ``bottom``, leaves left out, level by level; each level has an
    eighth of the rows of the one below.
    """
    top = bottom.agg(F.max("height")).first()[0] or 0
    levels = [bottom.withColumn("level", F.lit(0)).withColumn("children", F.lit(b"")).select(*NODE)]
    for number in range(1, top + 1):
        levels.append(staged(parents(levels[-1], number), f"{name}-{number}"))
    out = levels[0].limit(0)
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def linked(rows: DataFrame, over: DataFrame) -> DataFrame:
    """``rows`` (tree, level, pos, size, height, ...) with the link to their parent: up_tree, up_level,
    up_pos, the slot in it and its copies. ``over`` has that of each tree's last node.
    """
    up = F.expr(f"pos DIV {FAN}")
    full = F.expr("shiftleft(1L, 3 * (level + 1))")
    inner = rows.filter("level < height").select(
        *rows.columns, F.col("tree").alias("up_tree"), (F.col("level") + 1).alias("up_level"), up.alias("up_pos"),
        F.expr(f"CAST(pos % {FAN} AS INT)").alias("slot"),
        copies(F.least(full, F.col("size") - up * full)).alias("copies"))
    return inner.unionByName(rows.filter("level = height").join(bounded(over), "tree", "left").select(*inner.columns))


def copies(below: Column) -> Column:
    return (F.lit(1) + F.floor((below - 1) / COPY)).cast("int")


CLIMB = """
WITH RECURSIVE climb AS (
    SELECT number, 0 AS step, up_tree, up_level, up_pos, slot, copies, folded, X'' AS siblings FROM {start}
    UNION ALL
    SELECT c.number, c.step + 1, n.up_tree, n.up_level, n.up_pos, n.slot, n.copies,
           unhex(sha2(CAST(lower(hex(concat(
               substring(n.children, 1, 32 * c.slot), c.folded,
               substring(n.children, 32 * c.slot + 33)))) AS BINARY), 256)),
           concat(substring(n.children, 1, 32 * c.slot), substring(n.children, 32 * c.slot + 33))
    FROM climb AS c JOIN {nodes} AS n
      ON c.up_tree = n.tree AND c.up_level = n.level AND c.up_pos = n.pos AND c.number % c.copies = n.copy)
SELECT number, step, folded, siblings FROM climb
"""


def climbed(start: DataFrame, nodes: DataFrame) -> DataFrame:
    """number, folded and proof_sha256 (of the siblings in hex) of every leaf, as far up as there are nodes.

    A row of the recursion holds what one step adds; a leaf's steps are put in order at the end.
    Siblings are many times a leaf: they are hashed as they come, and only their digest is written.
    """
    spark = start.sparkSession
    # The row limit is for recursive queries that never end; this one ends with the tree.
    limit = "spark.sql.cteRecursionRowLimit"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        steps = spark.sql(CLIMB, start=start, nodes=nodes).groupBy("number").agg(
            F.max(F.struct("step", "folded"))["folded"].alias("folded"),
            F.sort_array(F.collect_list(F.struct("step", "siblings"))).alias("steps"))
        return staged(steps.select("number", "folded", digest(F.concat_ws(
            "", F.transform("steps", lambda s: F.lower(F.hex(s["siblings"]))))).alias("proof_sha256")), "climb")
    finally:
        spark.conf.set(limit, before)


def manifest(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Rows that repeat an id stand in the order of their leaves; equal rows share a leaf and stand in
    any order, each with its own proof. Null ids come first, a null language is a language of its
    own before all others, a null field differs from an empty one, and other columns are not
    read. An empty table gives no rows.
    """
    known, trees = placed(docs)
    bottom = known.select("tree", "size", "height", "pos", F.lit(1).cast("long").alias("below"), F.col("leaf").alias("hash"))
    nodes = staged(built(bottom, "nodes"), "nodes")

    ends = nodes.filter("level = height").select("tree", "hash").unionByName(
        bottom.filter("height = 0").select("tree", "hash"))
    count = trees.count()
    roots = staged(trees.select("tree", "size").join(bounded(ends), "tree"), "subroots")
    over = roots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(count).cast("long").alias("size"),
        height(F.lit(count)).alias("height"), F.col("tree").alias("pos"), F.col("size").alias("below"), "hash")
    top = staged(built(over, "top"), "top")
    ahead = top.select((F.col("level") - 1).alias("level"), F.col("pos").alias("up"), copies(F.col("below")).alias("many"))

    def link(rows: DataFrame, level) -> DataFrame:
        """In the tree over the languages the leaves below a node are known once it is built."""
        rows = rows.withColumn("up", F.expr(f"pos DIV {FAN}")).withColumn("level", level)
        return rows.join(bounded(ahead), ["level", "up"], "left").select(
            *(c for c in rows.columns if c != "up"), F.when(F.col("many").isNotNull(), TOP).cast("long").alias("up_tree"),
            (F.col("level") + 1).alias("up_level"), F.col("up").alias("up_pos"),
            F.expr(f"CAST(pos % {FAN} AS INT)").alias("slot"), F.col("many").alias("copies"))

    link_of = ["up_tree", "up_level", "up_pos", "slot", "copies"]
    above = staged(link(over, F.lit(0)).select(F.col("pos").alias("tree"), *link_of), "above")
    linked_nodes = linked(nodes, above).unionByName(link(top, F.col("level")).select(*NODE, *link_of))
    stored = staged(linked_nodes.withColumn("copy", F.explode(F.sequence(F.lit(0), copies(F.col("below")) - 1))), "links")
    start = linked(known.select("number", "tree", "size", "height", "pos", F.lit(0).alias("level"),
                                F.col("changed").alias("folded")), above)

    last = (top.filter("level = height") if count > 1 else roots).select(F.lower(F.hex("hash"))).first()
    root = F.lit(last[0] if last else None).cast("string")
    return known.join(climbed(start, stored), "number").join(bounded(roots.select("tree", F.col("hash").alias("subroot"))), "tree").select(
        "doc_id", F.lower(F.hex("leaf")).alias("leaf"), F.lower(F.hex("subroot")).alias("subroot"), root.alias("root"),
        "proof_sha256", F.lower(F.hex("folded")).alias("folded_root"),
        (F.lower(F.hex("folded")) == root).alias("verified"))
