"""Spelling variants: words one edit apart, and the frequent form each belongs to (operator 11).

Two words one edit apart share the first half of the shorter one, or the second. So words meet
in groups of those that share a half: parts of the sorted vocabulary, read from the front or
from the back. A large group is parted again by halves of what its words do not share. In a
group every word is compared with the sorted others by the rows of an edit matrix, three cells
wide: rows stay valid as far as the next word begins like the last, and once a row holds nothing
below two, all words with that beginning are skipped.
"""

from __future__ import annotations

from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import id_and_text
from tidemark.session import staged

RUN = r"[A-Za-z\u00C0-\u00FF]+"
TYPOS = 199  # one occurrence in so many loses a code point, as its hash tells
LEAST_CHARS, LEAST_TIMES, RATIO = 6, 5, 5
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GROUP = 1_000  # words of a group that is parted no further
TASK_WORDS = 25_000  # words of groups compared in one task
FAR = 2  # stands for two edits and more


def occurrences(docs: DataFrame) -> DataFrame:
    """All runs of letters in lower case, one row each, those whose hash says so with a letter less."""
    rows = id_and_text(docs).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    rows = rows.select("id", F.translate("run", CAPITALS, SMALL).alias("run"))
    crc = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    rows = rows.select("run", crc.alias("crc"))
    at = F.col("crc") % F.char_length("run")
    shorter = F.concat(F.substring("run", F.lit(1), at.cast("int")), F.substring("run", at.cast("int") + 2, F.char_length("run")))
    return rows.select(F.when(F.col("crc") % TYPOS == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and n of all words long and frequent enough; counted before the shuffle, so a word that
    makes up a third of the corpus is one row per map task.
    """
    words = occurrences(docs).filter(F.char_length("word") >= LEAST_CHARS)
    return staged(words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_TIMES), "vocabulary")


def shared(length: Column, low: Column, high: Column) -> Column:
    """What a word keeps without its code points from ``low`` to ``high`` (from 0, end exclusive), as
    a number; words that differ in it only by chance meet once more and are told apart.
    """
    word = F.col("word")
    return F.xxhash64(length, low, F.substring(word, F.lit(1), low), F.substring(word, high + 1, F.char_length(word)))


def halves(words: DataFrame) -> DataFrame:
    """The groups of every word: one row for each half it may differ in, as it is and as a longer
    word of which a code point was deleted. ``length`` is that of the shorter word, ``low`` and
    ``high`` bound what is free in it, ``more`` is 1 for the longer.
    """
    own = F.char_length("word")
    rows = words.withColumn("more", F.explode(F.array(F.lit(0), F.lit(1))))
    rows = rows.withColumn("length", own - F.col("more"))
    middle = F.floor(F.col("length") / 2).cast("int")
    rows = rows.withColumn("free", F.explode(F.array(
        F.struct(F.lit(0).alias("low"), middle.alias("high")),
        F.struct(middle.alias("low"), F.col("length").alias("high")))))
    return keyed(rows.select("word", "more", "length", "free.low", "free.high"))


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", shared(F.col("length"), F.col("low"), F.col("high") + F.col("more")))


def parted(groups: DataFrame) -> DataFrame:
    """The same words in groups whose free part is half of that before."""
    middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    rows = groups.withColumn("free", F.explode(F.array(
        F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))))
    return keyed(rows.select("word", "more", "length", "free.low", "free.high"))


def grouped(words: DataFrame) -> DataFrame:
    """word, key and back (better read from the back) of all groups of two and more, none above GROUP
    words unless what is free in them is one code point, which only so many words as there are
    letters and pairs of them can fill.
    """
    done, rows, level = [], halves(words), 0
    while True:
        rows = staged(rows, f"groups-{level}")
        size = staged(rows.groupBy("key").agg(F.count("*").alias("size"), F.max(F.col("high") - F.col("low")).alias("wide"))
                      .filter("size > 1"), f"sizes-{level}")
        large = (F.col("size") > GROUP) & (F.col("wide") > 1)
        done.append(rows.join(size.filter(~large).select("key"), "key", "left_semi").select(
            "word", "key", (F.col("low") < F.col("length") - F.col("high")).alias("back")))
        if not size.filter(large).limit(1).count():
            break
        level += 1
        rows = parted(rows.join(size.filter(large).select("key"), "key", "left_semi"))
    out = done[0]
    for other in done[1:]:
        out = out.unionByName(other)
    return out


def common(a: str, b: str) -> int:
    """How many code points two words begin alike with."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        if a[:middle] == b[:middle]:
            low = middle
        else:
            high = middle
    return low


def near(words: list[str]) -> list[tuple[str, str]]:
    """All pairs of ``words``, sorted and distinct, that one edit tells apart, lesser first.

    Row d of the matrix of a word q and a beginning of d code points holds the edits to q[:d-1],
    q[:d] and q[:d+1], no more than FAR.
    """
    alike = [0, *(common(a, b) for a, b in zip(words, words[1:], strict=False))]
    found = []
    for i, q in enumerate(words[:-1]):
        size, j = len(q), i + 1
        keep = alike[j]
        # As far as the next word begins like q itself the rows need no looking at letters.
        rows = [(FAR, 0, 1), *([(1, 0, 1)] * keep)]
        if keep == size:
            rows[-1] = (1, 0, FAR)
        while j < len(words):
            word = words[j]
            for d in range(keep, len(word)):
                rows.append(following(rows[-1], q, size, d, word[d]))
                if min(rows[-1]) >= FAR:
                    break
            if min(rows[-1]) >= FAR:
                # No word that begins like this can be near: go on behind the last of them.
                start = word[:len(rows) - 1]
                ahead = bisect_left(words, True, j + 1, key=lambda w, start=start: not w.startswith(start))
            else:
                off = size - len(word) + 1
                if 0 <= off <= 2 and rows[-1][off] == 1:
                    found.append((q, word))
                ahead = j + 1
            if ahead < len(words):
                keep = alike[ahead] if ahead == j + 1 else common(word, words[ahead])
                del rows[keep + 1:]
            j = ahead
    return found


def following(row: tuple, q: str, size: int, d: int, letter: str) -> tuple:
    """The row after ``row``, number d, for one more ``letter``: edits to q[:d], q[:d+1], q[:d+2]."""
    a, b, c = row
    x = y = z = FAR
    if d <= size:
        x = min(b + 1, a + (d < 1 or q[d - 1] != letter), FAR)
    if d < size:
        y = min(b + (q[d] != letter), c + 1, x + 1, FAR)
    if d + 1 < size:
        z = min(c + (q[d + 1] != letter), y + 1, FAR)
    return x, y, z


PAIRS = "word string, other string"


def pairs(groups: DataFrame) -> DataFrame:
    """All pairs of words one edit apart, lesser first, each once or more; groups come one by one."""
    def compare(batches):
        key, held, back = None, set(), False

        def found():
            words = sorted(w[::-1] for w in held) if back else sorted(held)
            out = near(words)
            return [tuple(sorted((a[::-1], b[::-1]))) for a, b in out] if back else out

        for batch in batches:
            out = []
            for word, now, turned in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    out += found()
                    key, held, back = now, set(), turned
                held.add(word)
            yield table_of(out)
        yield table_of(found())

    def table_of(rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["word", "other"])

    # A pair costs time and few bytes, so tasks are counted by words, not by bytes.
    dealt = groups.repartition(-(-groups.count() // TASK_WORDS) or 1, "key").sortWithinPartitions("key")
    return dealt.select("word", "key", "back").mapInArrow(compare, PAIRS)


def roots(forms: DataFrame) -> DataFrame:
    """word and root of all words that have a form: links are followed twice as far each round.
    A form has RATIO times the occurrences of its word, so chains are short.
    """
    links = staged(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = links.join(ahead, "root", "left")
        links = staged(joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if not links.filter("moved").limit(1).count():
            return links.drop("moved")
        links = links.drop("moved")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """One row per word of at least LEAST_CHARS code points and LEAST_TIMES occurrences in ``docs``:
    word, form, root, n, n_near, form_n.

    A null text has no words and a null id counts as empty text; rows that come twice count
    twice, ties between forms go to the lesser word, columns besides doc_id and text are not
    read, texts and words are taken whole at any length, and an empty table gives no rows.
    """
    words = vocabulary(docs)
    found = staged(pairs(staged(grouped(words.select("word")), "groups")).distinct(), "near")
    both = found.unionByName(found.select(F.col("other").alias("word"), F.col("word").alias("other")))
    counted = both.join(words.select(F.col("word").alias("other"), F.col("n").alias("times")), "other")
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("times")).alias("less"), "other")).alias("best"))
    form = F.col("best.less") <= -RATIO * F.col("n")
    known = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(form, F.col("best.other")).alias("form"), F.when(form, -F.col("best.less")).alias("form_n")), "variants")
    return known.join(roots(known.filter("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
