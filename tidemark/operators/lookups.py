"""Lookups in configuration tables: optional equalities, first or none, exactly one."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import staged
from tidemark.sizing import broadcast_if_small

TASK_ROWS = 8_000_000  # of an answer that one task gives
CELL = 2_048  # rows of one key, and requests for it, that meet in one place


def matching(rows: DataFrame, ignore_case: Sequence[str] = (), **wanted: object) -> DataFrame:
    """Rows equal to each given value; one that is None asks for nothing.

    Only what is asked for becomes a condition, so all of them reach the scan. Columns in
    ``ignore_case`` are compared in lower case, which a scan cannot do.
    """
    def equal(name: str, value: object) -> Column:
        if name in ignore_case:
            return F.lower(name) == F.lower(F.lit(value))
        return F.col(name) == F.lit(value)

    asked = [equal(n, v) for n, v in wanted.items() if v is not None]
    return rows.filter(reduce(lambda a, b: a & b, asked)) if asked else rows


def answered(rows: DataFrame, requests: DataFrame, request: str, columns: Sequence[str]) -> DataFrame:
    """For many requests at once: ``request`` and the rows that it asks for. In ``requests`` a NULL
    in one of ``columns`` asks for nothing.

    Requests are told apart by which columns they ask for, at most two to the power of their
    number, and each kind is an equi-join of its own; nothing is compared with everything.
    The answers to a kind may be far more than its rows and requests together: they are counted
    first, and dealt out over as many tasks as they need.
    """
    kinds = [[c for i, c in enumerate(columns) if kind >> i & 1] for kind in range(1, 1 << len(columns))]
    out = []
    for asked in kinds:
        nulls = [F.col(c).isNotNull() if c in asked else F.col(c).isNull() for c in columns]
        mine = requests.filter(reduce(lambda a, b: a & b, nulls)).select(request, *[F.col(c).alias(f"_{c}") for c in asked])
        out.append(_met(rows, mine, asked).select(request, *rows.columns))
    return reduce(DataFrame.unionByName, out)


def _met(rows: DataFrame, mine: DataFrame, asked: Sequence[str]) -> DataFrame:
    """``rows`` joined with the requests for them on the columns ``asked``, which requests have with
    an underscore before.

    Rows and requests of a key that have many answers are split into blocks, each pair of which is
    a cell: a row goes to a cell for each block of requests and the other way round.
    """
    theirs = [f"_{c}" for c in asked]
    equal = reduce(lambda a, b: a & b, [F.col(c) == F.col(t) for c, t in zip(asked, theirs, strict=True)])
    keys = rows.groupBy(*asked).agg(F.count("*").alias("_rows")).join(
        mine.groupBy(*theirs).agg(F.count("*").alias("_requests")), equal)
    total = keys.agg(F.sum(F.col("_rows") * F.col("_requests"))).first()[0] or 0
    if total <= TASK_ROWS:
        return rows.join(mine, equal)

    def blocks(counted: str) -> Column:
        return F.ceil(F.col(counted) / CELL)

    def block(counted: str) -> Column:
        return F.pmod(F.xxhash64("_number"), blocks(counted))

    def every(counted: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), blocks(counted) - 1))

    def numbered(of: DataFrame, name: str) -> DataFrame:
        return staged(of.withColumn("_number", F.monotonically_increasing_id()), name)

    keys = staged(keys.withColumn("_key", F.monotonically_increasing_id()), "lookup-keys")
    cell, parts = ["_key", "_row_block", "_request_block"], -(-total // TASK_ROWS)
    known = broadcast_if_small(keys.drop(*theirs))
    given = numbered(rows, "lookup-rows").join(known, list(asked)).withColumn("_row_block", block("_rows"))
    given = given.withColumn("_request_block", every("_requests")).select(*rows.columns, *cell)
    known = broadcast_if_small(keys.drop(*asked))
    wanted = numbered(mine, "lookup-requests").join(known, theirs).withColumn("_request_block", block("_requests"))
    wanted = wanted.withColumn("_row_block", every("_rows")).select(*mine.columns, *cell)
    # A number of parts that is asked for is kept: by their bytes they would be put together again.
    return given.repartition(parts, *cell).join(wanted.repartition(parts, *cell), cell)


def one_per_key(rows: DataFrame, key: Sequence[str], expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The rows that are alone with their key, and ``key, found`` of keys with another number of
    rows; with ``expected`` also those that have none.

    One row and a count per key are all that is kept of it, and both are combined before the
    shuffle, so a key that a third of all rows share costs one row per task.
    """
    others = [c for c in rows.columns if c not in key]
    counted = rows.groupBy(*key).agg(F.count("*").alias("found"), F.any_value(F.struct(*others)).alias("_row"))
    if expected is not None:
        counted = counted.join(expected.select(*key).distinct(), list(key), "full").withColumn(
            "found", F.coalesce("found", F.lit(0)))
    single = counted.filter("found = 1").select(
        *[F.col(f"_row.{c}").alias(c) if c in others else F.col(c) for c in rows.columns])
    return single, counted.filter("found <> 1").select(*key, "found")
