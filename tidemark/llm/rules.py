"""Quality rules as a short-circuit cascade (operator 3), all in DataFrame operations.

Each rule says when a document fails. On a bounded sample every rule is timed and its share
of failing documents counted; the cascade asks the rules in the order of rejections per
second, and a document that failed one is not put to the next. The order decides the
time only: a document is kept if no rule fails it, whichever comes first.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, id_and_text
from tidemark.session import staged

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
LEAST_WORDS = 50
MOST_REPEATED = 50  # percent of the words
SAMPLE_ROWS = 2_000  # to estimate costs and selectivities; results don't depend on it

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LETTERS = UPPER + UPPER.lower()


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Column


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def how_many(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(without(text, characters))


def rules() -> list[Rule]:
    """Rules over ``text`` and the counts of ``counted``; n_words is never 0 where they are asked."""
    text, words = F.col("text"), F.col("n_words")
    return [
        Rule("symbols", 100 * F.col("n_symbols") > 30 * words),
        Rule("repeated_lines", (F.col("n_dup_lines") >= 3)
             & (100 * F.col("n_dup_lines") > 30 * F.col("n_lines"))),
        Rule("short_words", F.col("word_chars") < 2 * words),
        Rule("long_words", F.col("word_chars") > 16 * words),
        Rule("capitals", 100 * how_many(text, UPPER) > 60 * (how_many(text, LETTERS) + 1)),
        Rule("exclamations", 100 * how_many(text, "!") > 50 * words),
        Rule("digits", 100 * how_many(text, "0123456789") > 30 * F.col("word_chars")),
    ]


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, text and the counts of each document.

    Words that stand in a window of three which comes twice are found within the row:
    windows are hashed, the hashes sorted with their places in one 64-bit number, and
    only windows whose hash comes again are compared word by word.
    """
    trimmed = F.expr(f"trim(BOTH '{BLANKS}' FROM text)".replace("\n", "\\n").replace("\r", "\\r")
                     .replace("\t", "\\t").replace("\x0b", "\\u000b").replace("\x0c", "\\u000c"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(f"[^{SPACE}]"))
    rows = (
        id_and_text(docs).withColumn("_trimmed", trimmed)
        .withColumn("_words", F.when(F.col("_trimmed") == "", F.array().cast("array<string>"))
                    .otherwise(F.split("_trimmed", f"[{SPACE}]+", -1)))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("_bits", F.length(F.bin("n_words")))
    )
    # The high bits of a window's hash above the place of its first word.
    keyed = rows.withColumn("_keys", F.when(F.col("n_words") >= 3, F.expr("""
        sort_array(transform(sequence(0L, n_words - 3), i -> shiftleft(xxhash64(
            _words[cast(i AS int)], _words[cast(i + 1 AS int)], _words[cast(i + 2 AS int)]), _bits) | i))
    """)).otherwise(F.array().cast("array<long>")))
    alike = keyed.withColumn("_alike", F.expr("""
        filter(_keys, (k, i) ->
            (i > 0 AND shiftright(k, _bits) = shiftright(get(_keys, i - 1), _bits))
            OR shiftright(k, _bits) = shiftright(get(_keys, i + 1), _bits))
    """))
    windows = alike.withColumn("_windows", F.expr("""
        sort_array(transform(_alike, k -> named_struct(
            'a', _words[cast(k & (shiftleft(1L, _bits) - 1) AS int)],
            'b', _words[cast((k & (shiftleft(1L, _bits) - 1)) + 1 AS int)],
            'c', _words[cast((k & (shiftleft(1L, _bits) - 1)) + 2 AS int)],
            'at', k & (shiftleft(1L, _bits) - 1))))
    """))
    same = ("(w.a = get(_windows, i {0} 1).a AND w.b = get(_windows, i {0} 1).b "
            "AND w.c = get(_windows, i {0} 1).c)")
    places = windows.withColumn("_places", F.expr(f"""
        sort_array(transform(
            filter(_windows, (w, i) -> (i > 0 AND {same.format('-')}) OR {same.format('+')}),
            w -> w.at))
    """))
    repeated = F.expr("""
        aggregate(transform(_places, (p, i) -> least(3L, coalesce(get(_places, i + 1) - p, 3L))),
                  0L, (total, n) -> total + n)
    """)
    return places.select(
        "doc_id", "text", "n_words",
        F.length(without(F.col("text"), BLANKS)).cast("long").alias("word_chars"),
        how_many(F.col("text"), SYMBOLS).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated.alias("n_repeat_words"))


def cascade(sample: DataFrame, asked: list[Rule]) -> list[Rule]:
    """``asked`` by rejections per second on ``sample``, the most first."""
    def seconds(*columns) -> tuple[float, int]:
        started = time.perf_counter()
        found = sample.agg(*columns).first()[0]
        return time.perf_counter() - started, found or 0

    seconds(F.count("*"))
    idle, total = seconds(F.count("*"))
    worth = {}
    for rule in asked:
        took, rejected = seconds(F.count_if(rule.fails))
        worth[rule.name] = rejected / max(total, 1) / max(took - idle, 1e-3)
    return sorted(asked, key=lambda rule: -worth[rule.name])


def sampled(docs: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of ``docs``, by a hash of id and text at a rate that follows from their number,
    so that how many files or partitions there are makes no difference.
    """
    total = docs.count()
    share = min(1.0, rows / max(total, 1))
    return docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int(share * (1 << 30)))


def quality_rules(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept.

    A null text has no words and fails like any short one. Rows that come twice are
    judged alike, columns besides doc_id and text are not read, and an empty table gives
    no rows.
    """
    rows = counted(docs)
    base = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    fails = F.when(base, F.lit(True))
    # Written before it is filtered: a filter would be pushed into the counts and repeat them.
    sample = staged(counted(sampled(docs, sample_rows)), "rule-sample").filter(~base)
    for rule in cascade(sample, rules()):
        fails = fails.when(rule.fails, F.lit(True))
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~fails.otherwise(F.lit(False))).alias("kept"))
