import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tests.llm.conftest import prose
from tidemark.llm import merkle, spelling, toxicity


def bag(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


# 11 Spelling variant grouping

VARIANT = ("word", "form", "root", "n", "n_near", "form_n")


def test_near_pairs_of_sorted_words_are_all_found():
    rng = random.Random(1)
    for alphabet in ("ab", "abé", "aU\U0001F600"):
        for _ in range(150):
            words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(0, 7)))
                            for _ in range(rng.randint(1, 60))})
            want = [(a, b) for i, a in enumerate(words) for b in words[i + 1:] if brute.one_edit(a, b)]
            assert sorted(spelling.near(words)) == want


@pytest.mark.parametrize("group", [1_000, 10])
def test_variants(spark, docs, empty, plain_rows, monkeypatch, group):
    """With small groups most are parted again; the result is the same."""
    monkeypatch.setattr(spelling, "GROUP", group)
    rng = random.Random(5)
    rows = [(i, " ".join("".join(rng.choice("abé") for _ in range(rng.choice([6, 7, 8]))) for _ in range(60))
             + " Frequent" * (i % 40) + " frequemt frequente Frequeent x×y÷z"[: 9 * (i % 5)], "a") for i in range(120)]
    rows += [(i, text, source) for i, text, source in plain_rows] * 3
    made = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    got = bag(spelling.spelling_variants(made), *VARIANT)
    assert got == Counter(brute.variants([(i, t) for i, t, _ in rows]))
    assert any(form for _, form, *_ in got)
    assert spelling.spelling_variants(empty).count() == 0


def test_variants_of_very_long_words(spark):
    long = "a" * 20_000 + "bc"
    rows = [(i, f"{long} {long} {long[1:]} {long}d") for i in range(12)]
    got = bag(spelling.spelling_variants(spark.createDataFrame(rows, "doc_id LONG, text STRING")), *VARIANT)
    assert got == Counter(brute.variants(rows))


def test_roots_follow_forms_to_the_last(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "w4")], "word STRING, form STRING")
    assert {r.root for r in spelling.roots(forms).collect()} == {"w9"}


def test_no_group_of_words_is_large(spark):
    words = spark.createDataFrame([(f"prefix{i:06d}",) for i in range(4_000)], "word STRING")
    sizes = spelling.grouped(words).groupBy("key").count().agg(F.max("count")).first()[0]
    assert sizes <= spelling.GROUP


# 12 Toxicity

def toxic_rows(count):
    rng = random.Random(2)
    stems = ["badst", "worstl", "hatef"]
    for i in range(count):
        words = prose(1_000 + i, rng.randint(3, 80)).split(" ")
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(stems) + rng.choice(["a", "en", "ion", "e"])
        yield i, " ".join(words), int(toxic)


def test_toxic_words_are_learned_by_their_stems(spark, docs, empty):
    rows = list(toxic_rows(1_200))
    texts = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id LONG, text STRING")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id LONG, toxic INT")
    got = {r.doc_id: r for r in toxicity.toxicity(texts, labels).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 for r in got.values())
    kept_back = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in kept_back]) >= 0.95
    net = toxicity.train(texts, labels)
    unseen, clean = toxicity.logits(net, [b"some badstly words", b"some other words"])
    assert unseen > clean
    # No label of a kept back row, and no other column, has any influence.
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(texts.withColumn("lang", F.lit("xx")), flipped)
    assert {r.doc_id: r.score for r in again.collect()} == {i: r.score for i, r in got.items()}
    assert toxicity.toxicity(docs, labels).count() == docs.count()
    assert toxicity.toxicity(empty, labels).count() == 0


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id LONG, toxic INT")
    assert {round(r.score, 6) for r in toxicity.toxicity(docs, none).collect()} == {0.5}


def plain_logit(net, text):
    """The network by loops over words and windows."""
    words, word = [], bytearray()
    for byte in text.lower().encode() + b" ":
        if toxicity.IN_WORD[byte]:
            word.append(byte)
        elif word:
            words.append(bytes(word))
            word = bytearray()
    rows = [toxicity.buckets(toxicity.words(np.frombuffer(w, np.uint8))[1])[0] for w in words]
    vectors = [net.vectors[r].sum(axis=0) for r in rows] or [np.zeros(toxicity.VECTOR)]
    vectors += [np.zeros(toxicity.VECTOR)] * 2
    total = float(net.offset[0])
    for k, (width, filters) in enumerate(zip(toxicity.WIDTHS, net.filters, strict=True)):
        for f in range(toxicity.FILTERS):
            best = max(sum(float(vectors[i + j] @ filters[j, :, f]) for j in range(width))
                       for i in range(len(vectors) - 2))
            total += max(best + net.offsets[k * toxicity.FILTERS + f], 0) * net.weights[k * toxicity.FILTERS + f]
    return total


def test_network_equals_plain_loops_however_texts_are_cut(monkeypatch):
    rng = np.random.default_rng(4)
    net = toxicity.Network.fresh(rng)
    net.vectors[:-1] = rng.normal(0, 0.3, net.vectors[:-1].shape)
    net.offset[0] = 0.2
    texts = ["", "  ", "one", "Ärger über Öl", "a1 b2-c3", prose(1, 400), "x" * 3_000, "x" * 900 + " y " + prose(2, 90)]
    data = [t.encode() for t in texts]
    whole = toxicity.raw(net, toxicity.pooled(net, data)[0])
    want = [plain_logit(net, t) for t in texts]
    assert np.allclose(whole, want, atol=1e-4)
    # Words that fit into a piece are never cut; those that do not fit are read in pieces.
    monkeypatch.setattr(toxicity, "PART", 256)
    alone = np.array([toxicity.raw(net, toxicity.pooled(net, [d])[0])[0] for d in data])
    fits = [max(map(len, t.split() or [""])) < 200 for t in texts]
    assert np.allclose(alone[fits], whole[fits], atol=1e-4)
    assert np.isfinite(alone).all()


def test_language_is_told_from_the_text():
    net = toxicity.Network.fresh(np.random.default_rng(1))
    texts = ["the cat and the dog", "der Hund und die Katze", "le chat et les chiens", "el perro y los gatos", "12 xyz"]
    told = toxicity.pooled(net, [t.encode() for t in texts])[1]
    assert [toxicity.LANGUAGES[i] for i in told] == ["en", "de", "fr", "es", "other"]


def test_thresholds_lie_in_the_widest_of_the_best_gaps():
    assert toxicity.threshold(np.array([0.0, 1, 2, 6, 7]), np.array([0, 0, 0, 1, 1])) == 4
    assert toxicity.threshold(np.array([1.0, 1, 1]), np.array([0, 1, 0])) == 1


# 13 Merkle dataset manifest

PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
LEAF = "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING"


def test_manifest_of_all_kinds_of_rows(docs, empty):
    """Nulls in any column, empty and long texts, repeated ids and rows, other columns."""
    made = docs.withColumn("lang", F.col("source")).withColumn("n_chars", F.length("text"))
    rows = [tuple(r) for r in made.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert bag(merkle.manifest(made), *PROOF) == Counter(brute.manifest(rows))
    assert merkle.manifest(empty.withColumn("lang", F.lit("en")).withColumn("n_chars", F.lit(1))).count() == 0


@pytest.mark.parametrize("copy", [8_192, 16])
def test_manifest_of_many_leaves_and_languages(spark, monkeypatch, copy):
    monkeypatch.setattr(merkle, "COPY", copy)
    rows = [(i, "s", None if i % 17 == 0 else f"l{i % 19}", 4, f"Abc{i}") for i in range(700)]
    rows += [(5, "x", "l0", 2, "Q")] * 3 + [(None, None, None, None, None)] * 9
    got = bag(merkle.manifest(spark.createDataFrame(rows, LEAF).repartition(6)), *PROOF)
    assert got == Counter(brute.manifest(rows))
    assert {v for *_, v in got} == {True, False}


def test_manifest_of_one_row_and_of_one_language(spark):
    for rows in ([(1, "s", "en", 1, "A")], [(i, "s", "en", 1, "A") for i in range(9)]):
        assert bag(merkle.manifest(spark.createDataFrame(rows, LEAF)), *PROOF) == Counter(brute.manifest(rows))


def test_upper_nodes_are_met_in_copies(spark, monkeypatch):
    monkeypatch.setattr(merkle, "COPY", 16)
    below = spark.createDataFrame([(1,), (16,), (17,), (64,)], "below LONG")
    assert [r[0] for r in below.select(merkle.copies(F.col("below"))).collect()] == [1, 1, 2, 4]


def test_siblings_are_not_written(spark, monkeypatch):
    written = {}

    def staged(rows, name, real=merkle.staged):
        written[name] = rows.columns
        return real(rows, name)

    monkeypatch.setattr(merkle, "staged", staged)
    merkle.manifest(spark.createDataFrame([(i, None, "en", 1, "x") for i in range(20)], LEAF))
    assert written["climb"] == ["number", "folded", "proof_sha256"]
