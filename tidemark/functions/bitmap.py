"""Changed-field bitmaps as column expressions.

A bitmap entry is ``0x<hex>`` for the fields of the record itself, or
``<position>-0x<hex>`` for the children of the compound at that position. Bit
*i*, counted from the right end of the hex text, stands for field *i*. An entry
whose hex text is malformed names no field.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def hex_digits(entry: Column) -> Column:
    """Hex text of an entry: what follows its last ``x``."""
    return F.regexp_replace(entry, r"(?s)^.*x", "")


def is_nested(entry: Column) -> Column:
    return F.instr(entry, "-") > 1


def nested_parent(entry: Column) -> Column:
    """Position of the compound a nested entry refers to; NULL when it is not a number."""
    prefix = F.substring_index(entry, "-", 1)
    return F.when(is_nested(entry), F.trim(prefix).try_cast("int"))


def is_broken_entry(entry: Column) -> Column:
    """A nested entry without a numeric position makes its whole event unreadable."""
    return is_nested(entry) & nested_parent(entry).isNull()


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _entry_hex(entry: Column) -> Column:
    after_dash = F.substr(entry, F.instr(entry, "-") + F.lit(1))
    return F.lower(hex_digits(F.when(is_nested(entry), after_dash).otherwise(entry)))


def _well_formed(digits: Column) -> Column:
    return (F.length(digits) % 2 == 0) & digits.rlike(r"^[0-9a-f]+\z")


def _digit(digits: Column, at: Column) -> Column:
    """The hex digit ``at`` places from the right."""
    return F.substr(digits, F.length(digits) - at, F.lit(1))


def _bit(digit: Column, bit: Column) -> Column:
    value = F.position(digit, F.lit("0123456789abcdef")) - 1
    return F.getbit(value, bit) == 1


def positions(entry: Column) -> Column:
    """Sorted field positions an entry names, as ``array<int>``."""
    def of_digits(digits: Column) -> Column:
        places = F.filter(
            F.sequence(F.lit(0), F.length(digits) - 1), lambda n: _digit(digits, n) != "0"
        )
        bits = F.array(*[F.lit(b) for b in range(4)])
        return F.flatten(F.transform(places, lambda n: F.transform(
            F.filter(bits, lambda b: _bit(_digit(digits, n), b)), lambda b: n * 4 + b)))

    none = F.array().cast("array<int>")
    return _once(
        _entry_hex(entry), lambda d: F.when(_well_formed(d), of_digits(d)).otherwise(none)
    )


def parsed_entries(entries: Column) -> Column:
    """Well-formed entries as ``array<struct<owner, digits>>``; the owner of a
    top-level bitmap is -1. Parse once, then ask ``field_changed`` many times.
    """
    split = F.transform(entries, lambda e: F.struct(
        F.when(is_nested(e), nested_parent(e)).otherwise(F.lit(-1)).alias("owner"),
        _entry_hex(e).alias("digits")))
    return F.filter(split, lambda e: _well_formed(e["digits"]))


def field_changed(parsed: Column, parent: Column, position: Column) -> Column:
    """Does any parsed entry name this field?

    ``parent`` is -1 for a field of the record itself, else the position of the
    compound it belongs to. A NULL position (the field is not part of the
    event's schema revision) is never changed.
    """
    place, bit = F.floor(position / F.lit(4)).cast("int"), (position % F.lit(4)).cast("int")

    def hit(e: Column) -> Column:
        inside = F.length(e["digits"]) > place
        return (e["owner"] == parent) & inside & _bit(_digit(e["digits"], place), bit)

    return F.coalesce(F.exists(parsed, hit), F.lit(False))
