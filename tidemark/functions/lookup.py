from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def literal_lookup(table: Mapping[str, object], key: Column) -> Column:
    """Value of ``key`` in a small constant table, NULL when it is not listed."""
    entries = [F.lit(part) for pair in table.items() for part in pair]
    return F.try_element_at(F.create_map(*entries), key)
