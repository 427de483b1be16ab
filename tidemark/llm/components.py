"""Connected components of a graph whose edges are a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged


def components(edges: DataFrame) -> DataFrame:
    """node and component, the smallest node it is connected with, for the nodes of ``edges``
    (a, b).

    Every node in turn links its larger neighbours to its smallest one, then itself and its
    smaller ones, until only stars are left: a number of rounds that grows with the
    logarithm of the graph. Each round is a written table, so a lost executor costs no more
    than that round. Neighbours are never gathered: minima are summed up before the shuffle
    and joined back, and both sides of a join are plain files, so that adaptive
    execution can split the partition of a node with very many neighbours.
    """
    stars = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(
            F.col("a").alias("node"), F.least("a", "m").alias("m")), "least")
        large = staged(both.join(least, F.col("a") == F.col("node")).filter("b > a").select(
            F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-stars")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "node"), "least")
        stars = staged(
            large.join(least, F.col("a") == F.col("node")).filter("b <> m").select(
                F.col("b").alias("a"), F.col("m").alias("b"))
            .union(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).distinct(), "small-stars")
        # Two numbers to the driver.
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return staged(stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots),
                  "components")
