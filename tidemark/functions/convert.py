"""Wire values to target values as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed

WIRE_CASTS = {
    "long": "bigint",
    "int": "int",
    "double": "double",
    "float": "float",
    "boolean": "boolean",
}


def epoch_timestamp(ms: Column) -> Column:
    """Epoch milliseconds to a UTC timestamp; NULL outside years 1 to 9999."""
    low, high = fixed.EPOCH_MS_RANGE
    return F.when(ms.between(F.lit(low), F.lit(high)), F.timestamp_millis(ms))


def epoch_date(ms: Column) -> Column:
    return epoch_timestamp(ms).cast("date")


def day_time(ms: Column) -> Column:
    """Milliseconds since midnight as ``HH:mm:ss.SSS``; NULL outside one day."""
    return F.when(
        (ms >= 0) & (ms < fixed.DAY_MS), F.date_format(F.timestamp_millis(ms), "HH:mm:ss.SSS")
    )


def day_time_interval(ms: Column) -> Column:
    """The same as a time span, for targets that store times that way."""
    seconds = (ms / F.lit(1000)).cast("decimal(18,6)")
    return F.when((ms >= 0) & (ms < fixed.DAY_MS), F.make_dt_interval(secs=seconds))


def replay_position(replay_id: Column) -> Column:
    """Big-endian long in the first eight bytes of a replay id."""
    return F.conv(F.hex(F.substring(replay_id, 1, 8)), 16, -10).cast("bigint")


Converter = Callable[[Column], Column]

# Converters by semantic type; extend a copy to plug in others.
DEFAULT_CONVERTERS: dict[str, Converter] = {
    "DateTime": epoch_timestamp,
    "DateOnly": epoch_timestamp,
    "TimeOnly": day_time,
}


WHOLE = ("long", "int")
DECIMAL = re.compile(r"Decimal\((\d+), ?(\d+)\)")

# What is wrong with a value that does not fit.
NO_TIME = "no time"
NO_NUMBER = "no number"
NO_TRUTH = "no truth value"
OUT_OF_RANGE = "out of range"
DIGITS_LOST = "digits lost"


def whole(value: Column, wire_type: str) -> Column:
    """A whole number, whatever the wire carries it as; NULL if it is none."""
    return value if wire_type in WHOLE else value.try_cast("bigint")


def precision(family: str | None) -> tuple[int, int] | None:
    """Digits in all and behind the point of ``Decimal(p, s)``."""
    found = DECIMAL.fullmatch(family or "")
    return (int(found[1]), int(found[2])) if found else None


def convert(
    value: Column,
    field_type: str,
    wire_type: str,
    family: str | None = None,
    converters: dict[str, Converter] | None = None,
) -> Column:
    """Convert by semantic type first, then by wire type. NULL stays NULL.

    ``family`` is the column family of the target, where known: a date goes into
    a date column as a date and as midnight anywhere else, and ``Decimal(p, s)`` rounds to its
    digits. The three types need not agree: a time that is carried as text is read as the
    number in it, and what cannot be converted becomes NULL, for ``problem`` to explain.
    """
    table = DEFAULT_CONVERTERS if converters is None else converters
    if field_type in table:
        known = table[field_type] is DEFAULT_CONVERTERS.get(field_type)
        out = table[field_type](whole(value, wire_type) if known else value)
        if family == "Date" and field_type in ("DateTime", "DateOnly"):
            return out.cast("date")
        if family == "Text":
            return out.cast("string")
        return out
    return cast_to_family(value.try_cast(WIRE_CASTS.get(wire_type, "string")), family)


def cast_to_family(value: Column, family: str | None) -> Column:
    """Adapt an already typed value to the target's column family."""
    digits = precision(family)
    if digits:
        return value.try_cast(f"decimal({digits[0]},{digits[1]})")
    if family == "Text":
        return value.cast("string")
    if family == "Integer":
        return value.try_cast("bigint")
    if family == "Boolean":
        return value.try_cast("boolean")
    return value


def problem(
    value: Column,
    field_type: str,
    wire_type: str,
    family: str | None = None,
    converters: dict[str, Converter] | None = None,
) -> Column:
    """Why ``convert`` makes NULL of a value, or that it loses digits; NULL where all is well."""
    table = DEFAULT_CONVERTERS if converters is None else converters
    made = convert(value, field_type, wire_type, family, converters)
    number = value.try_cast("decimal(38,10)")
    if field_type in DEFAULT_CONVERTERS:
        why = F.when(whole(value, wire_type).isNull(), NO_TIME).otherwise(OUT_OF_RANGE)
    elif family == "Boolean" or wire_type == "boolean":
        why = F.lit(NO_TRUTH)
    else:
        why = F.when(value.try_cast("double").isNull(), NO_NUMBER).otherwise(OUT_OF_RANGE)
    lost = F.lit(None).cast("string")
    if field_type not in table and (family == "Integer" or precision(family)) and wire_type != "boolean":
        lost = F.when(number != made.try_cast("decimal(38,10)"), DIGITS_LOST)
    return F.when(value.isNotNull() & made.isNull(), why).otherwise(lost)


def flag_value(deleted: Column, family: str) -> Column:
    """The soft-delete flag, as 0 and 1 where the target has no booleans."""
    return deleted.cast("int") if family == "Integer" else deleted
