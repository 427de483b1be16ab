import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.conftest import changed, prose
from tidemark.llm import (
    bytenet,
    exact,
    jaccard,
    mixing,
    personal,
    pieces,
    rules,
    secrets,
    token_files,
    warc,
)
from tidemark.llm.components import components
from tidemark.llm.shingles import shingle_sets

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def bag(df, *names):
    return Counter(tuple(r) for r in df.select(*names).collect())


# 1 Secrets

def test_secrets_base_spans(docs, plain_rows, empty):
    got = bag(secrets.secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
    want = Counter()
    for doc_id, text, _ in plain_rows:
        spans = brute.secrets(text)
        kinds = Counter(k for _, k, _ in spans)
        want[doc_id, kinds[0], kinds[1], kinds[2], brute.sha(brute.listed(spans, secrets.KINDS))] += 1
    assert got == want
    assert secrets.secrets(empty).count() == 0


def test_character_network_adds_only_what_looks_like_findings():
    rng = np.random.default_rng(3)
    hexes = ["".join(rng.choice(list("0123456789abcdef"), 24)) for _ in range(300)]
    mails = [f"mail{i % 10}.example{i}.com" for i in range(300)]
    windows = [secrets.seen(f"some words {v} and more", 11, 11 + len(v)) for v in hexes + mails]
    labels = [1] * 300 + [0] * 300
    net = secrets.fit(windows, labels, [2] * 300 + [0] * 300)
    sure = net.probability(np.frombuffer(b"".join(windows), np.uint8).reshape(-1, secrets.SIZE))
    added = sure >= np.take(net.thresholds, [2] * 300 + [0] * 300)
    # The threshold keeps 99 of 100 of the 60 findings set aside, so about as many of all.
    assert added[:300].mean() >= 0.93 and added[300:].mean() <= 0.02
    assert secrets.fit(windows[:3], [1] * 3, [2] * 3).thresholds == (2.0, 2.0, 2.0)


def test_all_of_every_run_is_looked_at():
    key = "Zk93qLx7VbT20pWmRs4Y"
    text = f"see //host/very/long/path/of/many/names/and/more/cfg.key={key} or {'0f' * 8}/{key} and NoDigitsInThisOne é"
    base, looked = secrets.examined(text)
    others = [text[s["start"]:s["end"]] for s in looked if s["label"] == 0]
    assert others == [text[4:text.index(" or ")], f"/{key}", "NoDigitsInThisOne"]
    assert [text[s["start"]:s["end"]] for s in base] == ["0f" * 8]
    codes = bytes(ord(c) - 31 for c in key)
    for at, width in ((0, 0), (1, 40), (40, 41), (60, 61), (300, 333)):
        whole = "q" * at + key + "/" * width
        windows = secrets.windows_of(whole, 0, len(whole))
        parts = [windows[i:i + secrets.SIZE] for i in range(0, len(windows), secrets.SIZE)]
        assert any(codes in p[secrets.BEFORE:secrets.BEFORE + secrets.INSIDE] for p in parts), at
    net = secrets.CharNet.fresh(np.random.default_rng(1))
    each = [s["windows"] for s in looked]
    want = [max(net.probability(np.frombuffer(w, np.uint8).reshape(-1, secrets.SIZE))) for w in each]
    assert net.surest(each) == pytest.approx(want, rel=1e-4) and len(each[1]) > secrets.SIZE


def test_thresholds_keep_the_asked_share_of_each_form():
    rng = np.random.default_rng(9)
    # Findings of form 1 look like the many other runs, so the network is not sure of them.
    sums = np.r_[rng.normal(4, 1, 200), rng.normal(-3, 1, 40), rng.normal(-4, 1, 2000)]
    y, forms = np.r_[np.ones(240), np.zeros(2000)], np.r_[np.full(200, 2), np.full(40, 1), np.zeros(2000)].astype(int)
    net = secrets.CharNet.fresh(rng)
    net.sums = lambda codes: sums
    secrets.calibrate(net, sums, y, forms, np.ones(2240, bool))
    sure = net.probability(sums)
    kept = sure >= np.take(net.thresholds, forms)
    assert sure[200:240].min() < 0.5
    assert kept[:200].mean() >= secrets.RECALL and kept[200:240].mean() >= secrets.RECALL
    assert net.recalls == (None, kept[200:240].mean(), kept[:200].mean())


@pytest.fixture(scope="module")
def many_findings(spark):
    """6,000 keys and 12,000 other runs, more of each than 4,000."""
    key = F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 24)
    mail = F.concat(F.lit("mail"), F.translate(F.substring(F.sha2(F.concat(F.lit("m"), "id"), 256), 1, 12), "0123456789", "ghijklmnop"),
                    F.lit(".example.com"))
    text = F.when(F.col("id") % 3 == 0, F.concat(F.lit("key "), key, F.lit(" and "), mail)).otherwise(
        F.concat(F.lit("mail to "), mail))
    return secrets.candidates(spark.range(18_000).select(F.col("id").alias("doc_id"), text.alias("text")).repartition(4)).cache()


def test_every_window_is_learned_from_or_set_aside(many_findings, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 1 << 11)
    given = {(bytes(w["windows"]), w["form"], w["label"]) for r in many_findings.collect() for w in r.seen}
    windows = secrets.different_windows(many_findings).cache()
    rows = windows.collect()
    assert {(bytes(r.window), r.form, r.label) for r in rows} == given and len(rows) == len(given) == 24_000
    rest, aside = [r for r in rows if not r.aside], [r for r in rows if r.aside]
    assert 4_300 < len(aside) < 5_300
    counts = dict(Counter(r.label for r in rest))
    blocks = secrets.dealt(windows.filter("not aside"), counts).collect()
    held = [(bytes(w.window), w.form, w.label) for b in blocks for w in b.windows]
    assert len(blocks) == -(-len(rest) // 2048) and sorted(held) == sorted((bytes(r.window), r.form, r.label) for r in rest)
    # Few of one label go to several blocks, and none of the other do.
    few = windows.filter("not aside and (label = 0 or conv(substring(hex(window), 49, 2), 16, 10) = '17')").cache()
    counts = dict(Counter(r.label for r in few.collect()))
    blocks = secrets.dealt(few, counts).collect()
    assert 0 < counts[1] < secrets.LEAST_RARE * len(blocks) / 2
    assert all(sum(w.label for w in b.windows) >= secrets.LEAST_RARE / 2 for b in blocks)
    assert sum(w.label == 0 for b in blocks for w in b.windows) == counts[0]


def test_network_and_thresholds_come_from_all_candidates(many_findings, monkeypatch):
    rounds = []
    one_round = secrets.one_round

    def spied(net, blocks, turn):
        rounds.append(blocks.select(F.explode("windows")).count())
        return one_round(net, blocks, turn)

    monkeypatch.setattr(secrets, "BLOCK", 1 << 13)
    monkeypatch.setattr(secrets, "one_round", spied)
    net = secrets.train(many_findings)
    rows = secrets.different_windows(many_findings).collect()
    aside = [r for r in rows if r.aside]
    assert rounds == [len(rows) - len(aside)] * secrets.ROUNDS
    codes = np.frombuffer(b"".join(bytes(r.window) for r in aside), np.uint8).reshape(-1, secrets.SIZE)
    y, forms = np.array([r.label for r in aside]), np.array([r.form for r in aside])
    want = net.with_numbers(net.numbers())
    secrets.calibrate(want, codes, y, forms, np.array([not r.later for r in aside]))
    assert (net.scale, net.shift) == pytest.approx((want.scale, want.shift), rel=1e-3)
    assert net.thresholds == pytest.approx(want.thresholds, rel=1e-3) and net.recalls == pytest.approx(want.recalls)
    added = net.probability(codes) >= np.take(net.thresholds, forms)
    assert added[y == 1].mean() >= secrets.RECALL - 1e-3 and added[y == 0].mean() <= 0.001
    again = secrets.train(many_findings)
    assert (again.numbers() == net.numbers()).all()


def test_ranks_are_exact(spark):
    rng = np.random.default_rng(4)
    values = np.r_[rng.normal(0, 1, 3000), np.full(500, 0.25), [-1e9, 1e9], rng.normal(0.25, 1e-9, 500)]
    sums = spark.createDataFrame([(float(v),) for v in values], "sum double").repartition(3).cache()
    for rank in (0, 1, 39, 1700, 2500, 4000, 4001):
        assert secrets.at_rank(sums, rank) == np.sort(values)[rank], rank


def test_gradients_of_the_character_network():
    rng = np.random.default_rng(2)
    net = secrets.CharNet.fresh(rng)
    codes, y = rng.integers(0, secrets.ALPHABET, (5, secrets.SIZE)).astype(np.uint8), np.array([1, 0, 1, 0, 0])

    def loss():
        p = bytenet.sigmoid(net.forward(codes)[-1])
        return -np.where(y == 1, np.log(p), np.log(1 - p)).mean()

    grads = secrets.gradients(net, codes, y)
    for name in secrets.PARTS:
        part = getattr(net, name).reshape(-1)
        for at in np.argsort(-np.abs(grads[name].ravel()))[:4]:
            part[at] += 1e-6
            more = loss()
            part[at] -= 2e-6
            assert (more - loss()) / 2e-6 == pytest.approx(grads[name].ravel()[at], rel=1e-3, abs=1e-7), name
            part[at] += 1e-6


# 2 Quality classifier

def texts_of_two_kinds(count):
    good = [prose(1000 + i, 60).encode() for i in range(count)]
    bad = [" ".join([w + "!!" for w in prose(5000 + i, 50).upper().split()]).encode() for i in range(count)]
    return good + bad, [1] * count + [0] * count


def test_network_tells_texts_apart_and_long_ones_alike():
    texts, labels = texts_of_two_kinds(60)
    net = bytenet.fit(texts, labels, 0.5)
    new, known = texts_of_two_kinds(90)
    score = bytenet.sigmoid(bytenet.logits(net, new[60:90] + new[150:]))
    assert (score[:30] > 0.5).all() and (score[30:] < 0.5).all(), known
    long = b" ".join(new) * 60
    assert len(long) > 2 * bytenet.PART
    assert bytenet.logits(net, [long])[0] == pytest.approx(
        net.scale * bytenet.means(net, [long])[0] + net.shift, rel=1e-4)
    assert bytenet.logits(net, [b"", b"x"]).shape == (2,)


def test_quality_covers_all_rows_and_learns_from_other_folds(spark, docs, empty, plain_rows):
    labels = spark.createDataFrame([(1, 1), (3, 1), (7, 1), (21, 0), (20, 0), (None, 1), (3, None), (5, 0), (5, 1)],
                                   "doc_id LONG, quality INT")
    rows = bytenet.quality(docs, labels).collect()
    assert len(rows) == len(plain_rows)
    for row in rows:
        text = "" if row.doc_id is None else str(row.doc_id)
        assert row.held_out == (zlib.crc32(text.encode()) % 5 == 0)
        assert 0 <= row.score <= 1 and row.predicted == (row.score >= 0.3)
    texts, known, _ = bytenet.labelled_sample(docs, labels)
    assert len(texts) == len(known) == sum(
        i in (1, 3, 7, 20, 21) for i in {1, 3, 7, 20, 21} if zlib.crc32(str(i).encode()) % 5)
    assert bytenet.quality(empty, labels).count() == 0
    assert {r.score for r in bytenet.quality(docs, labels.filter("false")).collect()} == {0.5}


# 3 Quality rules

def test_rules_count_and_keep(docs, empty, plain_rows):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    found = rules.quality_rules(docs).collect()
    want = Counter((i, *brute.rule_counts(t)) for i, t, _ in plain_rows)
    assert Counter((r.doc_id, *(r[n] for n in names)) for r in found) == want
    for r in found:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)
    assert not next(r for r in found if r.doc_id == 21).kept
    assert next(r for r in found if r.doc_id == 7).kept
    assert rules.quality_rules(empty).count() == 0


def test_the_sample_of_rules_is_no_share_of_partitions(spark):
    many = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")).repartition(40)
    assert 150 <= rules.sampled(many, 200).count() <= 260
    assert rules.sampled(many, 5_000).count() == 4_000
    assert rules.sampled(many.limit(0), 200).count() == 0
    again = rules.sampled(many.repartition(3), 200)
    assert {r[0] for r in again.select("doc_id").collect()} == {r[0] for r in rules.sampled(many, 200).select("doc_id").collect()}


def test_cascade_asks_the_rule_with_most_rejections_per_cost_first(spark):
    sample = spark.range(1000).select(F.col("id"))
    few, many = rules.Rule("few", F.col("id") < 10), rules.Rule("many", F.col("id") < 900)
    assert [r.name for r in rules.cascade(sample, [few, many])][0] == "many"


# 4 Exact dedup

def exact_want(rows):
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[(t or "").translate(brute.LOWER)].append(-1 if i is None else i)
    out = Counter()
    for i, t, *_ in rows:
        same = groups[(t or "").translate(brute.LOWER)]
        keep = max(same)
        out[i, None if keep < 0 else keep, len(same), brute.sha((t or "").translate(brute.LOWER))] += 1
    return out


def test_exact_groups(docs, empty, plain_rows):
    found = exact.exact_duplicates(docs)
    assert bag(found, "doc_id", "keep_id", "group_size", "text_sha256") == exact_want(plain_rows)
    kept = found.filter("kept")
    assert kept.count() == kept.select("text_sha256").distinct().count()
    assert kept.filter("NOT doc_id <=> keep_id").count() == 0
    assert exact.exact_duplicates(empty).count() == 0
    assert bag(exact.without_copies(docs), "doc_id", "text") == Counter(
        (r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()
        if (r.doc_id, r.text) in {(k, t) for k, t, _ in plain_rows if t is not None and k is not None
                                  and k == max(i or -1 for i, u, _ in plain_rows
                                               if (u or "").translate(brute.LOWER) == t.translate(brute.LOWER))}
        or r.doc_id is None and r.text) - Counter({(7, docs.filter("doc_id = 7").first().text): 1})
    assert exact.without_copies(empty).count() == 0


@pytest.mark.parametrize("rows", [
    [(i, f"few {i}") for i in range(5)] + [(10**18 + i, f"text {i % 900}") for i in range(1200)],
    [(i, "the same") for i in range(1000)] + [(2000 + i, f"text {i}") for i in range(900)],
])
def test_exact_buckets_stay_small_however_ids_lie(spark, monkeypatch, rows):
    sizes, merge = [], exact.merge

    def measured(index, fresh, buckets):
        of = exact.bucket("digest", buckets)
        sizes.extend(r["count"] for r in fresh.groupBy(of).count().collect())
        sizes.extend(len(r.digests) // 32 for r in index.collect())
        return merge(index, fresh, buckets)

    monkeypatch.setattr(exact, "BUCKET_DIGESTS", 50)
    monkeypatch.setattr(exact, "merge", measured)
    found = exact.exact_duplicates(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    assert bag(found, "doc_id", "keep_id", "group_size", "text_sha256") == exact_want(rows)
    assert max(sizes) <= 100


def test_perfect_hash_is_minimal_and_checked():
    keys = np.random.default_rng(1).integers(0, 1 << 63, (5000, 4), np.uint64)
    hashed = exact.PerfectHash.from_bytes(exact.PerfectHash.build(keys).to_bytes())
    assert sorted(hashed.slots(keys).tolist()) == list(range(5000))
    others = keys ^ np.uint64(1)
    slots = hashed.slots(others)
    held = keys[np.argsort(hashed.slots(keys))]
    assert not (held[slots[slots >= 0]] == others[slots >= 0]).all(axis=1).any()
    assert len(exact.PerfectHash.build(keys[:0])) == 0


# 5 Personal data

def test_personal_base_spans(docs, empty, plain_rows):
    got = bag(personal.personal_data(docs), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = Counter()
    for i, t, _ in plain_rows:
        spans = brute.personal(t)
        kinds = Counter(k for _, k, _ in spans)
        want[i, kinds[0], kinds[1], kinds[2], kinds[3], brute.sha(brute.listed(spans, personal.KINDS))] += 1
    assert got == want
    assert personal.personal_data(empty).count() == 0


def test_contexts_find_identifiers_of_another_form(spark):
    rows = [(i, f"{prose(i, 20)} reach: user{i}@host.example.org {prose(i + 50, 9)}") for i in range(12)]
    rows += [(20 + i, f"{prose(i, 8)} reach: AB-77{i}1-Q then {prose(i, 7)}") for i in range(2)]
    rows += [(40 + i, f"{prose(i, 9)} room 12345{i} {prose(i, 9)}") for i in range(9)]
    found = personal.personal_data(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    learned = {r.doc_id: r.spans for r in found.filter("n_context > 0").collect()}
    assert set(learned) == {20, 21}
    kind, start, end = learned[20].split(":")
    assert (kind, rows[12][1][int(start):int(end)]) == ("context", "AB-7701-Q")


def test_found_values_bring_in_further_patterns(spark):
    rows = [(i, f"reach: user{i}@host.example.org {prose(i, 9)}") for i in range(12)]
    rows += [(20 + i, f"{prose(i, 8)} reach: AB-77{i}1-Q then") for i in range(3)]
    rows += [(30 + i, f"{prose(i, 7)} konto AB-77{i % 3}1-Q and") for i in range(9)]
    rows += [(50, "the konto ZX-9999-K is new"), (51, "a room 12345 is none")]
    found = personal.personal_data(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    assert {r.doc_id: r.spans for r in found.filter("n_context > 0 AND doc_id >= 50").collect()} == {50: "context:10:19"}


def test_contexts_however_far_and_glued(spark):
    """A word of a context may be any number of blanks away, or joined by a colon or equals sign."""
    gaps = [" ", " " * 70, "\n\t" * 400, ":", "=", ": "]
    rows = [(i, f"{prose(i, 6)} mail user{i}@host.example.org and") for i in range(50)]
    rows += [(100 + i, f"{prose(i, 6)} mail{gap}AB-12345{i} and") for i, gap in enumerate(gaps)]
    rows += [(200, "12:30 mail room 17 a=b")]
    found = personal.personal_data(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    learned = {r.doc_id: r.spans.split(":") for r in found.filter("n_context > 0").collect()}
    texts = dict(rows)
    assert {i: texts[i][int(a):int(b)] for i, (_, a, b) in learned.items()} == {
        100 + i: f"AB-12345{i}" for i in range(len(gaps))}


def test_personal_spans_of_many_matches(spark):
    text = " ".join(f"u{i}@h.example 10.0.0.{i % 300} é" for i in range(700))
    found = personal.personal_data(spark.createDataFrame([(1, text)], "doc_id LONG, text STRING")).first()
    assert found.base_sha256 == brute.sha(brute.listed(brute.personal(text), personal.KINDS))


# 6 SentencePiece

def test_chunked_encoding_equals_the_library():
    rng = np.random.default_rng(5)
    mine, library = pieces.Pieces(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    alphabet = ["a", "th", "ing", " ", "  ", "\n", "é", "\U00020000", "梦", "\x00", "12", ".", "tion", "internationalization"]
    for n in range(300):
        text = mine.prefix + "".join(rng.choice(alphabet, rng.integers(1, 150)))
        size, parts = int(rng.choice([16, 17, 25, 40])), []
        count = -(-len(text) // size)
        for k in range(count):
            low, high = k * size, min((k + 1) * size, len(text))
            since = max(low - mine.longest, 0)
            chunk = pieces.chunk_paths(mine, text[since:high + mine.longest], low - since, high - since,
                                       k == 0, k == count - 1)
            for side in ("ins", "outs"):
                chunk[side] = [s if s is None else (s[0] + since, s[1] + since) for s in chunk[side]]
            parts.append(chunk)
        states = pieces.states_within(parts, None, None)
        ids = np.concatenate([pieces.path_ids(mine, c, c["ins"].index(a), c["outs"].index(b))
                              for c, (a, b) in zip(parts, states, strict=True)]).tolist()
        assert ids == library.encode(text[1:]), n
        half = len(parts) // 2
        if half:  # the product is associative
            def product(some):
                total = some[0]
                for part in some[1:]:
                    total = pieces.combined(total, part)
                return total
            both = pieces.combined(product(parts[:half]), product(parts[half:]))["matrix"]
            assert both[0, 0] == product(parts)["matrix"][0, 0] == -len(ids)


def test_encoding_and_decoding_of_all_rows(docs, empty, plain_rows, monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(pieces, "FAN", 2)
    encoded = pieces.encode(docs, PIECES)
    want = Counter((i, tuple(library.encode(t or ""))) for i, t, _ in plain_rows)
    rows = encoded.collect()
    assert Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<i4").tolist())) for r in rows) == want
    assert max(r.n_chunks for r in rows) >= 3
    decoded = pieces.decode(encoded, PIECES)
    assert bag(decoded, "doc_id", "decoded") == Counter(
        (i, (t or "").replace("▁", " ")) for i, t, _ in plain_rows)
    assert pieces.digests(empty, PIECES).count() == 0


@pytest.mark.parametrize("chunk", [100, 333])
def test_runs_over_borders_are_encoded_whole(spark, monkeypatch, chunk):
    """In long runs of one character chunks may share no state with the next."""
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    monkeypatch.setattr(pieces, "CHUNK", chunk)
    monkeypatch.setattr(pieces, "GROW", 4)
    monkeypatch.setattr(pieces, "FAN", 4)
    monkeypatch.setattr(pieces, "TASK_CHUNKS", 8)
    lengths = [*range(chunk - 3, chunk + 4), 2 * chunk, 2 * chunk + 1, 1_000, 4_321]
    texts = [c * n for c in ("a", " ", "=", "▁", "é", "ab") for n in lengths]
    texts += [prose(9, 40) + " " + "a" * 700 + " " + prose(10, 40), "x" + "-" * 900 + prose(11, 20)]
    rows = [(i % 5, t) for i, t in enumerate(texts)] + [(None, "a" * 900)] * 2
    got = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<i4").tolist()))
                  for r in pieces.encode(spark.createDataFrame(rows, "doc_id LONG, text STRING"), PIECES).collect())
    assert got == Counter((i, tuple(library.encode(t))) for i, t in rows)


def test_a_long_run_at_the_full_size(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    row = pieces.encode(spark.createDataFrame([(1, "a" * 40_000)], "doc_id LONG, text STRING"), PIECES).first()
    assert np.frombuffer(row.ids, "<i4").tolist() == library.encode("a" * 40_000)


# 7 Jaccard join

def test_jaccard_components(docs, empty, plain_rows):
    want = brute.jaccard_components([(i, t) for i, t, _ in plain_rows])
    assert len(set(want.values())) < len(want) - 4
    assert bag(jaccard.jaccard_groups(docs), "doc_id", "n_shingles", "component_id") == Counter(
        (i, len(brute.shingles(t)), want.get(i)) for i, t, _ in plain_rows)
    assert jaccard.jaccard_groups(empty).count() == 0
    kept = {r.doc_id for r in jaccard.without_near_copies(docs).select("doc_id").collect()}
    assert kept == {i for i in want if want[i] == i} | {None}


def test_jaccard_of_short_lists_near_the_bound(spark):
    """Texts made of shared passages, so that links are found in short lists only."""
    rng = np.random.default_rng(8)
    parts = [prose(i, 12) for i in range(40)]
    rows = [(n, " ".join(parts[i] for i in rng.choice(12, rng.integers(4, 9), replace=False).tolist())
             + f" own{n}" * (n % 4)) for n in range(150)]
    rows += [(200 + n, " ".join([*rows[n][1].split(" ")[:-(n % 9) or None], f"x{n}"])) for n in range(60)]
    found = jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id LONG, text STRING"))
    want = brute.jaccard_components(rows)
    assert {r.doc_id: r.component_id for r in found.collect()} == want


@pytest.mark.parametrize("many,chunk,tile", [(1, 4_000, 7), (3, 1, 4_096), (32, 512 << 10, 4_096)])
def test_jaccard_of_groups_that_are_almost_alike(spark, monkeypatch, many, chunk, tile):
    """Versions of a few texts near the bound, compared chunk by chunk."""
    monkeypatch.setattr(jaccard, "MANY", many)
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    monkeypatch.setattr(jaccard, "TILE", tile)
    rng = np.random.default_rng(8)
    rows = []
    for group in range(3):
        base = prose(700 + group, 90)
        rows += [(100 * group + i, changed(base, *rng.choice(90, int(rng.integers(0, 9)), replace=False).tolist()))
                 for i in range(30)]
    rows += [(900, rows[0][1]), (901, None), (902, "two words")]
    made = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(4)
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_groups(made).collect()}
    want = brute.jaccard_components(rows)
    assert {i: want.get(i, i) for i, _ in rows} == got
    assert 3 < len(set(got.values())) < len(rows) - 20


def test_overlaps_of_two_chunks():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, int(n)).astype(np.uint64)) for n in rng.integers(1, 50, 12)]

    def chunk(some):
        return {"docs": list(range(len(some))), "sizes": np.array([len(s) for s in some], np.int64).tobytes(),
                "hashes": b"".join(s.tobytes() for s in some)}

    met = jaccard.overlaps(chunk(sets[:5]), chunk(sets[5:]))
    assert met.tolist() == [[len(np.intersect1d(a, b)) for b in sets[5:]] for a in sets[:5]]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (300, 200), (200, 250)]
    found = components(spark.createDataFrame(edges, "a LONG, b LONG"))
    want = brute.components(edges, {n for e in edges for n in e})
    assert {r.node: r.component for r in found.collect()} == want
    assert components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0


def test_shingle_sets_of_slices(plain_rows):
    texts = pa.array([t for _, t, _ in plain_rows])
    sizes = [len(brute.shingles(t)) for _, t, _ in plain_rows]
    assert [len(s) for s in shingle_sets(texts)] == sizes
    assert [len(s) for s in shingle_sets(texts.slice(5, 9))] == sizes[5:14]


# 8 WARC

def page_rows():
    big, other = "<html>" + "é" * 200, "<p>" + "x" * 5000
    return [(3, "u", big), (2, None, big), (2, None, big), (5, "http://a b/\r\nX: y", big), (None, "n", big), (7, "s", "short"),
            (8, "s", "short"), (9, "e", None), (10, "e", ""), (11, "o", other), (12, "o", other.upper()), (13, "c", "\r\n\r\n" * 40)]


def test_archives_come_back(spark, monkeypatch):
    pages = spark.createDataFrame(page_rows(), "page_id LONG, url STRING, html STRING").withColumn(
        "digest", F.lit(1)).withColumn("refers_to", F.lit(2))
    want = Counter(brute.warc_rows([(i, h) for i, _, h in page_rows()]))
    assert bag(warc.archives(pages), *warc.COLUMNS) == want
    files, names = warc.write_archives(pages)
    whole = warc.read_archives(files, names, payload=True).collect()
    assert all(r.error is None for r in whole)
    assert Counter(bytes(r.payload).decode() for r in whole if r.record_type == "response" and r.page_id in (7, 8, 11, 12, 13)) \
        == Counter(h for i, _, h in page_rows() if i in (7, 8, 11, 12, 13))
    assert warc.archives(pages.filter("false")).count() == 0


def test_dictionary_and_broken_archives(tmp_path):
    records = [warc.page_record(i, f"http://x/{i}", (f"<html>{prose(i % 7, 300)}</html>").encode()) for i in range(900)]
    data = b"".join(warc.archive(iter(records)))
    assert int.from_bytes(data[4:8], "little") > 1000  # a dictionary was built
    path = tmp_path / "a.warc.zst"
    path.write_bytes(data)
    with path.open("rb") as file:
        assert list(warc.frames(file)) == records
    path.write_bytes(data[:-3])
    with path.open("rb") as file, pytest.raises(ValueError, match="cut short"):
        list(warc.frames(file))
    with pytest.raises(ValueError, match="length of the block"):
        warc.parse(records[0][:-10] + b"\r\n\r\n")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(records[0].replace(b"<html>", b"<HTML>"))
    with pytest.raises(ValueError, match="lacks"):
        warc.parse(records[0].replace(b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""))


# 9 Token files

def test_token_files_come_back(docs, empty, plain_rows):
    library = Tokenizer.from_file(BYTES)
    start, want = 0, Counter()
    for i, t, _ in sorted(plain_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want[i, start, len(ids), brute.crc(ids)] += 1
        start += len(ids)
    assert bag(token_files.token_files(docs, BYTES), "doc_id", "start", "n_tokens", "ids_crc32") == want
    assert token_files.token_files(empty, BYTES).count() == 0


def test_blocks_and_ranges(tmp_path):
    rng = np.random.default_rng(2)
    docs = [(n if n % 9 else None, np.where(rng.random(s) < 0.05, rng.integers(0, 1 << 32, s), rng.integers(5, 300, s)).astype(np.uint32))
            for n, s in enumerate([0, 1, 1023, 1024, 1025, 70_000, 5, 0, 3000])]
    docs.append((77, np.full(5000, 9, np.uint32)))
    path = tmp_path / "shard"
    path.write_bytes(b"".join(token_files.ShardWriter().chunks(docs)))
    whole = np.concatenate([i for _, i in docs])
    with path.open("rb") as raw:
        reader = token_files.ShardReader(pa.PythonFile(raw))
        got = list(reader.documents())
        assert [d for d, _ in got] == [d for d, _ in docs]
        assert all((a == b).all() for (_, a), (_, b) in zip(got, docs, strict=True))
        for at, count in ((0, 1), (1000, 100), (70_000, 5000), (len(whole) - 1, 1)):
            assert (reader.ids(at, count) == whole[at:at + count]).all()
    assert path.stat().st_size < 0.75 * whole.nbytes


def test_pieces_of_white_space(plain_rows):
    library, mine = Tokenizer.from_file(BYTES), token_files.Encoder(BYTES)
    texts = ["", None, " ", "a  b", "<|endoftext|>", " x<|endoftext|>.y , z", "don't. 's a.b,c", "\n a\n", "\xa0x y\x85 z", "²., Éc.d 12.5,3",
             "x\x1c y", "x\x1ey z", "  lead", " " * 50 + "q", "a b  c", *[t for _, t, _ in plain_rows]]
    for _ in range(2):  # the second time from what was kept
        got = mine.ids(pa.array(texts))
        assert [g.tolist() for g in got] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


# 10 Mixing

def test_mix_meets_its_targets(docs, empty, plain_rows):
    sizes = Counter()
    for _, t, s in plain_rows:
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    rows = mixing.mix(docs, shard_words=2000).collect()
    assert Counter((r.doc_id, r["size"]) for r in rows) == Counter((i, len(brute.words(t))) for i, t, _ in plain_rows)
    taken = Counter()
    for r in rows:
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        taken[r.source] += r.taken
    for source, target in want.items():
        assert abs(taken[source] - target) <= max(3 * mixing.BLOCK_WORDS, 0.01 * target)
    again = mixing.mix(docs.repartition(3), shard_words=2000).collect()
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))
    assert mixing.mix(empty).count() == 0


def test_seats_go_by_highest_quotients(spark):
    rng = np.random.default_rng(4)
    for n, seats in ((1, 7), (5, 23), (40, 11), (60, 5000), (3, 0)):
        weights = {i: float(w) for i, w in enumerate(rng.integers(1, 1000, n) ** 2)}
        rows = spark.createDataFrame([(0, i, w, seats) for i, w in weights.items()], "g INT, i INT, w DOUBLE, seats LONG")
        got = mixing.apportioned(rows, ["g"], "w", "seats", ["i"], "won")
        assert {r.i: r.won for r in got.collect()} == brute.apportion(weights, seats)


def test_mixed_rows_keep_their_columns(docs, plain_rows):
    found = mixing.mixed(docs, shard_words=2000)
    assert found.columns == docs.columns
    assert max(Counter((r.doc_id, r.text) for r in found.collect()).values()) <= 4
    assert mixing.mixed(docs.filter("false")).count() == 0
