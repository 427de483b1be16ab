"""Personal data: plain patterns, and contexts learned from what they find (operator 5).

All of it is DataFrame operations. Emails, addresses, cards and phone numbers found by
their form are the seeds. The word before a seed is a lexical pattern. Patterns and the
values that follow them form a graph: a pattern is as sure as the share of all its
occurrences in the corpus that stand before sure values, and a value is as sure as the
patterns before it make it, taken together. Values that became sure bring in further
patterns, until none is added. The surest patterns mark identifiers of other forms, as
``context`` spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE
from tidemark.session import staged

MARK = "\x01"  # stands around matches; in a text it is first replaced, as no pattern has it
LOCAL = "A-Za-z0-9._%+-"
LABEL = "[A-Za-z0-9-]++"
# Each begins where its run of characters does, or where the match before it ended, and never
# gives back what it took, so time is in proportion to the text.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@{LABEL}(?:\.{LABEL})++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Texts without this have no match; looked for first as it is cheap.
NEEDED = {
    "email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": r"\+[0-9]",
}
KINDS = [*PATTERNS, "context"]
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
APART = rf"{SPACE}:="  # what words of contexts and values end at
TOKEN = rf"(?<![^{APART}])(?=[^{APART}]*[0-9@])[^{APART}]++"

ROUNDS = 3  # in which a pattern is scored, from the one that takes it in
LEAST_SEEDS = 3  # distinct sure values, seeds or found, before which a pattern must stand
LEAST_SURE = 0.6  # of a pattern that marks identifiers, and of a value that brings in patterns
LEAST_DIGITS = 4  # of an identifier without an at sign
SPANS = "array<struct<start: long, kind: int, end: long, value: string>>"
BLOCK = 256


def pieces(text: Column, pattern: str) -> Column:
    """What lies outside and inside of matches in turn, the outside first."""
    return F.split(F.regexp_replace(text, f"({pattern})", f"{MARK}$1{MARK}"), MARK, -1)


def with_starts(rows: DataFrame, name: str, into: str) -> DataFrame:
    """Add to each of the strings of array ``name`` where it starts: sums of lengths, first
    of blocks and then within one, so that a text with very many matches stays cheap.
    """
    return rows.withColumn(f"{into}_sizes", F.transform(name, lambda p: F.length(p).cast("long"))).withColumn(
        f"{into}_blocks", F.expr(f"""
            aggregate(sequence(0, greatest(size({into}_sizes) - 1, 0) div {BLOCK}), array(0L),
                (sums, b) -> concat(sums, array(sums[cast(b AS int)] + aggregate(
                    slice({into}_sizes, cast(b AS int) * {BLOCK} + 1, {BLOCK}), 0L, (s, x) -> s + x))))
        """)).withColumn(into, F.expr(f"""
            transform({name}, (p, i) -> named_struct('text', p, 'start',
                {into}_blocks[cast(i div {BLOCK} AS int)] + aggregate(
                    slice({into}_sizes, cast(i div {BLOCK} AS int) * {BLOCK} + 1, i % {BLOCK}),
                    0L, (s, x) -> s + x)))
        """)).drop(f"{into}_sizes", f"{into}_blocks")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(number: Column) -> Column:
    """Of a string of digits."""
    places = F.sequence(F.lit(1), F.length(number))
    turned = F.reverse(number)

    def add(total, place):
        digit = F.substring(turned, place, F.lit(1)).cast("int")
        doubled = F.when(digit > 4, 2 * digit - 9).otherwise(2 * digit)
        return total + F.when(place % 2 == 0, doubled).otherwise(digit)

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")
    if kind == "card":
        number = digits(value)
        return F.when(F.length(number).between(12, 19), passes_luhn(number)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def valid_matches(placed: str, number: int, kind: str) -> Column:
    inside = F.filter(placed, lambda p, i: (i % 2 == 1) & is_valid(kind, p["text"]))
    return F.transform(inside, lambda p: F.struct(
        p["start"].alias("start"), F.lit(number).alias("kind"),
        (p["start"] + F.length(p["text"])).alias("end"), p["text"].alias("value")))


def of_kind(spans: str, number: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == number)).cast("long")


def base_spans(rows: DataFrame) -> DataFrame:
    """``rows`` with ``spans``, those found by form, by their start and then their kind."""
    found = []
    for number, (kind, pattern) in enumerate(PATTERNS.items()):
        cut, placed = f"_{kind}_cut", f"_{kind}"
        rows = rows.withColumn(cut, F.when(
            F.col("text").rlike(NEEDED[kind]), pieces(F.col("text"), pattern)
        ).otherwise(F.array().cast("array<string>")))
        rows = with_starts(rows, cut, placed).drop(cut)
        found.append(valid_matches(placed, number, kind))
    return rows.withColumn("spans", F.sort_array(F.concat(*found)).cast(SPANS)).drop(
        *[f"_{kind}" for kind in PATTERNS])


def with_candidates(rows: DataFrame) -> DataFrame:
    """Add ``tokens``: words with a digit or an at sign, the word before each, however far, where they
    are without the signs around them, and whether a base span covers part of them.
    """
    rows = rows.withColumn("_cut", F.when(
        F.col("text").rlike("[0-9@]"), pieces(F.col("text"), TOKEN)
    ).otherwise(F.array().cast("array<string>")))
    return with_starts(rows, "_cut", "_token").withColumn("tokens", F.expr(rf"""
        filter(transform(_token, (p, i) -> named_struct(
            'pattern', if(i % 2 = 1, lower(regexp_extract(
                _token[i - 1].text, '(?<![^{APART}])([^{APART}]++)[{APART}]++$', 1)), ''),
            'start', p.start + length(regexp_extract(p.text, '^[^A-Za-z0-9+]*', 0)),
            'value', regexp_extract(p.text, '^[^A-Za-z0-9+]*(.*?)[^A-Za-z0-9]*$', 1))),
            t -> t.pattern != '' AND NOT rlike(t.pattern, '[0-9@]'))
    """.replace("\\", "\\\\"))).withColumn("tokens", F.expr("""
        transform(tokens, t -> named_struct(
            'pattern', t.pattern, 'start', t.start, 'end', t.start + length(t.value),
            'value', t.value,
            'seed', exists(spans, s -> s.start < t.start + length(t.value) AND t.start < s.end)))
    """)).drop("_cut", "_token")


def word_counts(docs: DataFrame) -> DataFrame:
    """How often each word comes in the corpus; summed up before the shuffle."""
    words = docs.select(F.explode(F.split(F.lower("text"), f"[{APART}]+", -1)).alias("pattern"))
    return words.filter("pattern != ''").groupBy("pattern").agg(F.count("*").alias("occurrences"))


def sure_patterns(tokens: DataFrame, docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Patterns that mark identifiers, from ``tokens`` (pattern, value, seed).

    A pattern is taken in once it stands before LEAST_SEEDS distinct values that are sure by
    then, and scored for ``rounds`` rounds; after them it keeps its score, as values that it
    found itself would raise it further. It goes on until all are scored and none is added.
    """
    edges = staged(tokens.groupBy("pattern", "value").agg(
        F.count("*").alias("n"), F.max("seed").alias("seed")), "pattern-edges")
    # A pattern before fewer values can never be taken in.
    wide = edges.groupBy("pattern").agg(F.count("*").alias("held")).filter(F.col("held") >= LEAST_SEEDS)
    counts = staged(wide.select("pattern").join(word_counts(docs), "pattern"), "pattern-counts")
    graph = staged(edges.join(counts, "pattern"), "graph")
    patterns, known, quiet = None, 0, 0
    while True:
        if patterns is None:
            scored = graph.withColumn("sure", F.col("seed").cast("double"))
        else:
            # Noisy or over the patterns before a value; a seed stays sure. The logarithm of
            # zero is left to the sum's smallest number.
            of = patterns.filter("age > 0").select("pattern", F.col("sure").alias("of"))
            values = graph.join(of, "pattern").groupBy("value").agg(
                F.round(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("of"), F.lit(1e-9))))), 9).alias("found"))
            scored = graph.join(values, "value", "left").withColumn(
                "sure", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("found", F.lit(0.0))))
        now = scored.groupBy("pattern").agg(
            # Rounded, as the order of a sum must not decide what is sure.
            F.round(F.least(F.sum(F.col("sure") * F.col("n")) / F.max("occurrences"), F.lit(1.0)), 9).alias("sure"),
            (F.count_if(F.col("sure") >= LEAST_SURE) >= LEAST_SEEDS).cast("int").alias("age"))
        if patterns is not None:
            before = patterns.select("pattern", F.col("sure").alias("was"), F.col("age").alias("past"))
            now = now.join(before, "pattern").select(
                "pattern", F.when(F.col("past") >= rounds, F.col("was")).otherwise(F.col("sure")).alias("sure"),
                F.when(F.col("past") > 0, F.col("past") + 1).otherwise(F.col("age")).alias("age"))
        patterns = staged(now, "scored-patterns")
        taken = patterns.filter("age > 0").count()
        known, quiet = taken, quiet + 1 if taken == known else 1
        if quiet >= rounds or not taken:
            return patterns.filter((F.col("age") > 0) & (F.col("sure") >= LEAST_SURE))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans,
    n_context.

    A null text is empty and an empty one has no spans; rows that come twice get the same
    spans, columns besides doc_id and text are not read, and an empty table gives no rows.
    Words of contexts end at white space, colons and equals signs, and so do values.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), MARK, "\x02").alias("text"))
    base = staged(with_candidates(base_spans(plain)).select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.transform("spans", lambda s: s.dropFields("value")).alias("spans"), "tokens"), "base-spans")
    tokens = base.select("row", F.explode("tokens").alias("t")).select("row", "t.*")
    patterns = sure_patterns(tokens.select("pattern", "value", "seed"), plain)
    identifiers = tokens.filter(~F.col("seed") & (
        F.col("value").contains("@") | (F.length(digits(F.col("value"))) >= LEAST_DIGITS)))
    found = identifiers.join(patterns, "pattern").groupBy("row").agg(F.sort_array(F.collect_list(
        F.struct("start", F.lit(len(PATTERNS)).alias("kind"), "end"))).alias("more"))
    joined = base.drop("tokens").join(staged(found, "context-spans"), "row", "left")
    none = F.array().cast("array<struct<start: long, kind: int, end: long>>")
    more = F.coalesce("more", none)
    return joined.select(
        "doc_id", *[of_kind("spans", k).alias(f"n_{kind}") for k, kind in enumerate(PATTERNS)],
        F.sha2(listed(F.col("spans")).cast("binary"), 256).alias("base_sha256"),
        listed(F.sort_array(F.concat("spans", more))).alias("spans"),
        F.size(more).cast("long").alias("n_context"))
