"""A toxicity classifier over words: hashed vectors, filters of several widths (operator 12).

Each word is the sum of learned vectors that its hash and the hashes of its first bytes
select, so that an unseen ending of a known stem still speaks. Filters one, two and three
words wide slide over the whole text, the strongest answer of each is kept, and these are
weighed into one number. What the number has to reach is set per language, on documents
put aside; the language is told from function words of the text alone, and the score is
moved so that reaching it reads as CUT. Only the text is an input.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.bytenet import sigmoid
from tidemark.llm.common import byte_views, id_and_text
from tidemark.session import staged

SAMPLE_ROWS = 8_000  # labelled documents that the network is fitted on, half of each label
SAMPLE_BYTES = 64 << 20  # of their whole texts together
CUT = 0.7  # a score of at least this predicts label 1
FOLDS, FOLD = 3, 1  # the remainder of the id's crc32 that is held out

BUCKETS, VECTOR = 1 << 18, 8
PREFIXES = (4, 5, 6)  # bytes of a word's beginning that have a vector of their own
WIDTHS, FILTERS = (1, 2, 3), 12  # words; filters of each width
PART = 256 << 10  # bytes of text worked on at a time; a longer word is read in pieces
TIMES = 3  # fitted documents that a bucket needs to have a vector other than zero
LEAST = 20  # documents of a label put aside that a language needs for a threshold of its own
SEED = 12

# Frequent function words that tell these languages apart.
FUNCTION_WORDS = {
    "en": "the of and to is that for with was are this it",
    "de": "der die das und ist nicht mit von zu den dem auf",
    "fr": "le les des et est une du pas avec dans pour qui",
    "es": "el los las y del por con para se como su lo",
}
LANGUAGES = (*FUNCTION_WORDS, "other")

BASE = 0x9E3779B97F4A7C15 | 1  # of the polynomial that hashes bytes, modulo 2^64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[65:91] = IN_WORD[97:123] = IN_WORD[128:] = True


def powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


UP, DOWN = powers(BASE, PART + 1), powers(pow(BASE, -1, 1 << 64), PART + 1)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and the capitals of Latin-1, two bytes each in UTF-8, in lower case."""
    out = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    capital = (data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)
    out[second[capital]] += 32
    return out


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of at most PART bytes begins, and its hash with those of its prefixes,
    one row each; 64 bits.
    """
    data = lowered(data)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = IN_WORD[data]
    borders = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = borders[::2], borders[1::2]
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * UP[:len(data)], out=sums[1:])
        scale, first = DOWN[begin], sums[begin]
        out = np.empty((len(begin), 1 + len(PREFIXES)), np.uint64)
        out[:, 0] = (sums[end] - first) * scale
        for i, length in enumerate(PREFIXES):
            # The number of the prefix's kind keeps it apart from a word that spells the same.
            out[:, 1 + i] = (sums[np.minimum(begin + length, end)] - first) * scale + np.uint64(i + 1)
        out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return begin, out


def buckets(hashes: np.ndarray) -> np.ndarray:
    """Rows of the table of vectors; row BUCKETS is that of no word."""
    return (hashes & np.uint64(BUCKETS - 1)).astype(np.int32)


def hash_of(word: str) -> int:
    return int(words(np.frombuffer(word.encode(), np.uint8))[1][0, 0])


TOLD = np.array([hash_of(w) for ws in FUNCTION_WORDS.values() for w in ws.split()], np.uint64)
TOLD_LANGUAGE = np.array([i for i, ws in enumerate(FUNCTION_WORDS.values()) for _ in ws.split()])
TOLD_LANGUAGE = TOLD_LANGUAGE[np.argsort(TOLD)]
TOLD = np.sort(TOLD)


def pieces(text, size: int):
    """A text in pieces of at most ``size`` bytes, cut where no word is if there is such a place."""
    at = 0
    while len(text) - at >= size:
        ends = np.flatnonzero(~IN_WORD[np.frombuffer(text[at:at + size - 1], np.uint8)])
        cut = at + (int(ends[-1]) + 1 if len(ends) else size - 1)
        yield text[at:cut]
        at = cut
    yield text[at:]


def laid_out(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Short texts as one list of rows of buckets: each text's words, one row of no word where it
    has none, and as many rows of no word as keep windows from reaching into the next text.
    Also where each text begins, with the end, and how often words of each language occur.
    """
    data = np.zeros(sum(map(len, texts)) + len(texts), np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    for text, at in zip(texts, bounds.tolist(), strict=False):
        data[at:at + len(text)] = np.frombuffer(text, np.uint8)
    begin, hashes = words(data)
    owner = np.searchsorted(bounds, begin, "right") - 1
    counts = np.bincount(owner, minlength=len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.maximum(counts, 1) + max(WIDTHS) - 1, out=starts[1:])
    rows = np.full((starts[-1], hashes.shape[1]), BUCKETS, np.int32)
    before = np.cumsum(counts) - counts
    rows[np.arange(len(owner)) - before[owner] + starts[owner]] = buckets(hashes)
    place = np.minimum(np.searchsorted(TOLD, hashes[:, 0]), len(TOLD) - 1)
    known = TOLD[place] == hashes[:, 0]
    told = np.zeros((len(texts), len(LANGUAGES)), np.int64)
    np.add.at(told, (owner[known], TOLD_LANGUAGE[place[known]]), 1)
    return rows, starts, told


@dataclass
class Network:
    vectors: np.ndarray  # (BUCKETS + 1, VECTOR); rows of no and of rare words are zero
    filters: list[np.ndarray]  # per width (width, VECTOR, FILTERS)
    offsets: np.ndarray  # (len(WIDTHS) * FILTERS,)
    weights: np.ndarray
    offset: np.ndarray  # (1,)
    scale: float = 1.0
    shifts: dict[str, float] = field(default_factory=dict)  # per language, in logits

    @classmethod
    def fresh(cls, random: np.random.Generator) -> Network:
        return cls(np.zeros((BUCKETS + 1, VECTOR), np.float32),
                   [random.normal(0, (1 / (w * VECTOR)) ** 0.5, (w, VECTOR, FILTERS)).astype(np.float32)
                    for w in WIDTHS],
                   np.full(len(WIDTHS) * FILTERS, 0.1, np.float32),
                   random.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), np.zeros(1))


def answers(net: Network, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words' vectors, and what each filter says where its window begins."""
    seen = net.vectors[rows[:, 0]]
    for i in range(1, rows.shape[1]):
        seen += net.vectors[rows[:, i]]
    out = np.zeros((len(rows), len(WIDTHS) * FILTERS), np.float32)
    for k, (width, filters) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        of = out[:, k * FILTERS:(k + 1) * FILTERS]
        for j in range(width):
            of[:len(rows) - j] += seen[j:] @ filters[j]
    return seen, out


def strongest(net: Network, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    said = answers(net, rows)[1]
    for pad in range(1, max(WIDTHS)):
        said[starts[1:] - pad] = -np.inf
    return np.maximum.reduceat(said, starts[:-1], axis=0)


def pooled(net: Network, texts: list) -> tuple[np.ndarray, np.ndarray]:
    """The strongest answer of each filter in each text, and its language's number."""
    best = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, np.float32)
    told = np.zeros((len(texts), len(LANGUAGES)), np.int64)

    def work(run: list, of: list[int]):
        rows, starts, counts = laid_out(run)
        np.maximum.at(best, of, strongest(net, rows, starts))
        np.add.at(told, of, counts)

    run, of, held = [], [], 0
    for i, text in enumerate(texts):
        if len(text) + 1 > PART:
            long_text(net, text, best[i], told[i])
            continue
        if held + len(text) + 1 > PART:
            work(run, of)
            run, of, held = [], [], 0
        run.append(text)
        of.append(i)
        held += len(text) + 1
    if run:
        work(run, of)
    told[:, -1] = told.sum(axis=1) == 0
    return best, told.argmax(axis=1)


def tiles(text, size: int = PART):
    """A text's rows of buckets piece by piece, each with those of the last words of the one
    before, so that windows over the border are seen; and how often words of each language occur.
    """
    pad = max(WIDTHS) - 1
    none = np.full((1 + pad, 1 + len(PREFIXES)), BUCKETS, np.int32)
    carried, any_word = none[:0], False
    for piece in pieces(text, size):
        rows, starts, counts = laid_out([piece])
        rows = rows[:starts[1] - pad]
        rows = np.concatenate((carried, rows[rows[:, 0] != BUCKETS]))
        carried = rows[-pad:]
        if len(rows):
            any_word = True
            yield np.concatenate((rows, none[1:])), counts[0]
    if not any_word:
        yield none, np.zeros(len(LANGUAGES), np.int64)


def long_text(net: Network, text, best: np.ndarray, told: np.ndarray) -> None:
    for rows, counts in tiles(text):
        np.maximum(best, strongest(net, rows, np.array([0, len(rows)]))[0], out=best)
        told += counts


def raw(net: Network, best: np.ndarray) -> np.ndarray:
    return np.maximum(best + net.offsets, 0) @ net.weights + net.offset[0]


def logits(net: Network, texts: list) -> np.ndarray:
    best, language = pooled(net, texts)
    shifts = np.array([net.shifts.get(name, 0.0) for name in LANGUAGES])
    return net.scale * raw(net, best).astype(np.float64) + shifts[language]


def fit(texts: list[bytes], labels: list[int], prior: float, epochs: int = 8, steps: int = 150,
        batch: int = 32, rate: float = 0.05, seed: int = SEED) -> Network:
    """Fit a network by stochastic gradient descent (Adagrad) on the logistic loss of documents,
    in so many epochs and at least so many steps. A fifth of the documents is put aside for
    ``calibrate``. Labels of one kind only give their share as the score of every text.
    """
    random = np.random.default_rng(seed)
    net = Network.fresh(random)
    if len(set(labels)) < 2:
        net.weights[...] = 0
        shift = float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3)))
        net.shifts = dict.fromkeys(LANGUAGES, shift)
        return net
    y = np.asarray(labels, np.float64)
    order = random.permutation(len(texts))
    put = len(order) // 5 if len(order) >= 200 else 0
    aside, rest = (order[:put] if put else order), order[put:]
    known = [[rows for rows, _ in tiles(t)] for t in texts]
    seen = np.zeros((2, BUCKETS + 1), np.int64)
    for i in rest:
        seen[labels[i], np.unique(np.concatenate([t.ravel() for t in known[i]]))] += 1
    learned = seen.sum(axis=0) >= TIMES
    learned[BUCKETS] = False
    net.vectors[learned] = random.normal(0, 0.02, (learned.sum(), VECTOR))
    net.vectors[learned, 0] += leaning(seen[:, learned], np.bincount(y[rest].astype(int), minlength=2))
    past: dict[str, np.ndarray] = {}
    a_round = -(-len(rest) // batch)
    for _ in range(max(epochs, -(-steps // a_round))):
        random.shuffle(rest)
        for at in range(0, len(rest), batch):
            of = rest[at:at + batch]
            step(net, past, [known[i] for i in of], y[of], learned, rate)
    calibrate(net, [texts[i] for i in aside], y[aside])
    return net


def leaning(seen: np.ndarray, documents: np.ndarray) -> np.ndarray:
    """Where a vector's first number starts: how far a bucket leans to label 1, by the log of
    the odds in units of its error.
    """
    odds = np.log(seen + 0.5) - np.log(documents + 1)[:, None]
    return 0.1 * (odds[1] - odds[0]) / np.sqrt((1 / (seen + 0.5)).sum(axis=0))


def moved(past: dict, name: str, value: np.ndarray, grad: np.ndarray, rate: float, at=slice(None)) -> None:
    sums = past.setdefault(name, np.full(value.shape, 1e-6, np.float64))
    sums[at] += grad ** 2
    value[at] -= rate * grad / np.sqrt(sums[at])


def peak(net: Network, text: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The strongest answers in a text, and rows and vectors of the windows that gave them:
    (filters,), (filters, width, hashes), (filters, width, VECTOR).
    """
    wide, every = np.arange(max(WIDTHS)), np.arange(len(WIDTHS) * FILTERS)
    found = None
    for rows in text:
        seen, said = answers(net, rows)
        at = said[:len(rows) - wide[-1]].argmax(axis=0)
        mine = said[at, every], rows[at[:, None] + wide], seen[at[:, None] + wide]
        if found is None:
            found = mine
        else:
            better = mine[0] > found[0]
            for old, new in zip(found, mine, strict=True):
                old[better] = new[better]
    return found


def step(net: Network, past: dict, texts: list[list[np.ndarray]], y: np.ndarray, learned: np.ndarray,
         rate: float) -> None:
    """One step downhill; only the windows with the strongest answers pass anything back."""
    best, rows, seen = (np.stack(part) for part in zip(*[peak(net, t) for t in texts], strict=True))
    out = np.maximum(best + net.offsets, 0)
    slope = (sigmoid(out @ net.weights + net.offset[0]) - y) / len(texts)
    passed = slope[:, None] * net.weights * (out > 0)
    touched, shares = [], []
    for k, (width, filters) in enumerate(zip(WIDTHS, net.filters, strict=True)):
        of = slice(k * FILTERS, (k + 1) * FILTERS)
        back = passed[:, of, None, None] * filters.transpose(2, 0, 1)  # text, filter, place, vector
        touched.append(rows[:, of, :width].reshape(-1, rows.shape[-1]))
        shares.append(back.reshape(-1, VECTOR))
        grad = np.einsum("tf,tfwv->wvf", passed[:, of], seen[:, of, :width])
        moved(past, f"filters{k}", filters, grad, rate)
    rows_of, share = np.concatenate(touched), np.concatenate(shares)
    which, inverse = np.unique(rows_of, return_inverse=True)
    total = np.zeros((len(which), VECTOR))
    np.add.at(total, inverse.ravel(), np.repeat(share, rows_of.shape[1], axis=0))
    kept = learned[which]
    moved(past, "vectors", net.vectors, total[kept], rate, which[kept])
    moved(past, "weights", net.weights, out.T @ slope, rate)
    moved(past, "offsets", net.offsets, passed.sum(axis=0), rate)
    moved(past, "offset", net.offset, np.array([slope.sum()]), rate)


def threshold(scores: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest gap between scores among those cuts that mistake the fewest
    documents, each label having the same weight.
    """
    order = np.argsort(scores)
    s, t = scores[order], y[order]
    missed = np.concatenate(([0], np.cumsum(t))) / max(t.sum(), 1)
    wrong = (len(t) - t.sum() - np.concatenate(([0], np.cumsum(1 - t)))) / max((1 - t).sum(), 1)
    loss = (missed + wrong)[1:-1]
    gaps = np.diff(s)
    loss[gaps <= 0] = np.inf
    if not len(loss) or not np.isfinite(loss).any():
        return float(s.mean())
    least = np.flatnonzero(loss <= loss.min() + 1e-12)
    i = least[np.argmax(gaps[least])]
    return float((s[i] + s[i + 1]) / 2)


def calibrate(net: Network, texts: list[bytes], y: np.ndarray) -> None:
    """Move the logits of each language so that its threshold gets the score CUT. A language with
    fewer than LEAST documents of a label put aside has the threshold of all.
    """
    best, language = pooled(net, texts)
    scores = raw(net, best).astype(np.float64)
    net.scale = 4 / max(float(np.abs(scores - np.median(scores)).mean()), 1e-3)
    cut = float(np.log(CUT / (1 - CUT)))
    of_all = threshold(scores, y)
    for i, name in enumerate(LANGUAGES):
        mine = language == i
        enough = min((y[mine] == 1).sum(), (y[mine] == 0).sum()) >= LEAST
        net.shifts[name] = cut - net.scale * (threshold(scores[mine], y[mine]) if enough else of_all)


def held_out(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3, is 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == FOLD


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, size: int):
    """Texts and labels of at most ``rows`` labelled documents and ``size`` bytes, whole texts
    only, none held out, chosen by a hash of their id, half of each label as far as there
    are; and the share of label 1. Ids labelled both ways, null ids and null labels are left out.
    """
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    known = labels.select(doc_id, F.col("toxic").cast("int").alias("toxic"))
    known = known.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("other"))
    known = known.filter("toxic = other").select("doc_id", "toxic")
    ids, counts = [], []
    for label in (0, 1):
        of = known.filter(F.col("toxic") == label)
        counts.append(of.count())
        ids += of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2).collect()
    if not ids:
        return [], [], 0.5
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, toxic int")
    # At most ``rows`` ids: a bounded broadcast, and a bounded number of texts.
    found = staged(id_and_text(docs).join(F.broadcast(chosen), "doc_id")
                   .groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "labelled")
    so_far = F.sum(F.octet_length("text")).over(
        Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    taken = found.withColumn("so_far", so_far).filter(F.col("so_far") <= size).collect()
    taken.sort(key=lambda r: r["doc_id"])
    return ([r["text"].encode() for r in taken], [r["toxic"] for r in taken],
            counts[1] / max(sum(counts), 1))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> Network:
    return fit(*labelled_sample(docs, labels, rows, size))


def scored(docs: DataFrame, net: Network, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` and ``__score``, without a shuffle."""
    names = [*keep] if "text" in keep else [*keep, "text"]
    source = docs.select(*names)
    at = names.index("text")

    def score(batches):
        for batch in batches:
            values = sigmoid(logits(net, byte_views(batch.column(at))))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(keep)], pa.array(values, pa.float64())], [*keep, "__score"])

    fields = source.schema.fields[:len(keep)]
    return source.mapInArrow(score, type(source.schema)(fields).add("__score", "double"))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, size: int = SAMPLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null text scores as an empty one, rows that come twice score alike, columns besides
    doc_id and text are not read, and an empty table gives no rows. Texts are read whole, in
    pieces if long. Without labels of both kinds every document scores the share of label 1.
    """
    net = train(docs, labels, rows, size)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(ids, net, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= CUT).cast("int").alias("predicted"))
