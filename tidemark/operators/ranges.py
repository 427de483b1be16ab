"""Orders over all rows without a task that sees them all: rows dealt out by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import staged

PLACE = "_at"
ROW_BITS = 33  # of monotonically_increasing_id, below the number of the partition


def dealt(rows: DataFrame, order: list[Column | str], name: str = "dealt") -> DataFrame:
    """``rows`` in ranges of ``order``, written, with ``_at``: a number that grows with the order.

    Its upper bits number the range (see ``part``). A last sort key of no meaning lets even rows
    that agree in the whole order be split, so a range holds about as many rows as any other.
    """
    tie = "_tie"
    tied = rows.withColumn(tie, F.monotonically_increasing_id())
    keys = [*order, tie]
    ranged = tied.repartitionByRange(*keys).sortWithinPartitions(*keys).drop(tie)
    return staged(ranged.withColumn(PLACE, F.monotonically_increasing_id()), name)


def part() -> Column:
    return F.shiftright(PLACE, ROW_BITS)


def ranked(rows: DataFrame, order: list[Column | str], rank: str = "rank") -> DataFrame:
    """``rows`` with their place in ``order``, from 1 on; rows that agree in it come in any order.

    What comes before a range is one count per range, summed up in a window over as many rows
    as there are ranges. An order that only a sort of the output shows is lost when it is
    written or joined; this column stays.
    """
    placed = dealt(rows, order, "ranked")
    counts = placed.groupBy(part().alias("_part")).agg(F.count("*").alias("_n"), F.min(PLACE).alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + 1
    # One row per range: a table as long as the number of partitions is always small.
    shifts = F.broadcast(counts.select("_part", shift.alias("_shift")))
    return placed.withColumn("_part", part()).join(shifts, "_part").select(
        *rows.columns, (F.col(PLACE) + F.col("_shift")).alias(rank))
