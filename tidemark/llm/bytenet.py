"""A quality classifier over bytes: a small convolutional network in numpy (operator 2).

Every byte has a learned vector, next to two fixed channels that tell whether the bytes
before it repeat what stood a few bytes earlier. Learned filters slide over the bytes; the
text is covered by overlapping chunks, the strongest answer of each filter in a chunk is
kept, the chunks' answers are weighed into one number each, and their mean is the
probability of the document. Nothing but the bytes of the text is an input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import byte_views, held_out, id_and_text, lean

SAMPLE_ROWS = 4_000  # labelled documents that the network is fitted on, half of each label
CUT = 0.3  # a score of at least this predicts label 1

STRIDE, WIDTH = 4, 8  # bytes
STEP, OVERLAP = 896, 128  # a chunk is STEP + OVERLAP bytes
LAGS = range(2, 49)
RUNS = (8, 24)  # bytes that a repetition must last, a channel each
GAP = 64  # zero bytes at least between documents; more than any lag
VECTOR, FILTERS = 6, 24
PART = 256 << 10  # bytes worked on at a time
SEED = 7


@dataclass
class Network:
    vectors: np.ndarray  # (256, VECTOR)
    filters: np.ndarray  # (WIDTH * channels, FILTERS)
    offsets: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (FILTERS,)
    offset: float
    scale: float = 1.0  # calibration: probability = sigmoid(scale * mean + shift)
    shift: float = 0.0

    @classmethod
    def fresh(cls, random: np.random.Generator) -> Network:
        wide = WIDTH * (VECTOR + len(RUNS))
        return cls(random.normal(0, 0.5, (256, VECTOR)).astype(np.float32),
                   random.normal(0, (2 / wide) ** 0.5, (wide, FILTERS)).astype(np.float32),
                   np.zeros(FILTERS, np.float32),
                   random.normal(0, 0.3, FILTERS).astype(np.float32), 0.0)


def laid_out(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one array of bytes, each from a multiple of STEP on and followed by zeros;
    and how many chunks each has, at least one.
    """
    chunks = np.array([-(-(len(t) + GAP) // STEP) for t in texts])
    data = np.zeros(int(chunks.sum()) * STEP, np.uint8)
    at = 0
    for text, count in zip(texts, chunks.tolist(), strict=True):
        data[at:at + len(text)] = np.frombuffer(text, np.uint8)
        at += count * STEP
    return data, chunks


def repeats(data: np.ndarray) -> list[np.ndarray]:
    """For each of RUNS, where so many bytes up to here equal those some lag earlier."""
    out = [np.zeros(len(data), bool) for _ in RUNS]
    for lag in LAGS:
        same = np.zeros(len(data), bool)
        np.equal(data[lag:], data[:-lag], out=same[lag:])
        same &= data != 0
        length = 1
        for run, channel in zip(RUNS, out, strict=True):
            while length < run:
                more = min(length, run - length)
                same[more:] &= same[:-more]
                same[:more] = False
                length += more
            channel |= same
    return out


def channels(net: Network, data: np.ndarray) -> np.ndarray:
    """(bytes / STRIDE, STRIDE * channels)"""
    full = np.empty((len(data), VECTOR + len(RUNS)), np.float32)
    full[:, :VECTOR] = net.vectors[data]
    full[data == 0, :VECTOR] = 0
    for i, channel in enumerate(repeats(data)):
        full[:, VECTOR + i] = channel
    return full.reshape(len(data) // STRIDE, -1)


def answers(net: Network, rows: np.ndarray) -> np.ndarray:
    """What each filter says at each stride; WIDTH is two strides."""
    half = rows.shape[1]
    out = rows @ net.filters[:half] + net.offsets
    out[:-1] += rows[1:] @ net.filters[half:]
    return np.maximum(out, 0, out=out)


def pooled(said: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    """The strongest answer of each filter in each chunk; a chunk reaches into the next."""
    steps = said.reshape(-1, STEP // STRIDE, said.shape[1])
    best, head = steps.max(axis=1), steps[:, :OVERLAP // STRIDE].max(axis=1)
    follows = np.ones(len(steps), bool)
    follows[np.cumsum(chunks) - 1] = False
    inner = np.flatnonzero(follows)
    best[inner] = np.maximum(best[inner], head[inner + 1])
    return best


def means(net: Network, texts: list) -> np.ndarray:
    """The mean over each text's chunks of what the network makes of them."""
    data, chunks = laid_out(texts)
    each = pooled(answers(net, channels(net, data)), chunks) @ net.weights + net.offset
    return np.add.reduceat(each, np.concatenate(([0], np.cumsum(chunks)[:-1]))) / chunks


def parts(texts: list, size: int = PART):
    """Texts in runs of about ``size`` bytes; a longer one is cut where a chunk begins."""
    run, held = [], 0
    for i, text in enumerate(texts):
        if run and held + len(text) > size:
            yield run
            run, held = [], 0
        run.append(i)
        held += len(text) + STEP
    if run:
        yield run


def long_mean(net: Network, text) -> float:
    """As ``means`` for one text of any length, piece by piece; each piece also sees the bytes
    before it that a repetition may reach back to, and those after that its last chunk has.
    """
    total, count, span = 0.0, -(-(len(text) + GAP) // STEP), PART // STEP
    before = -(-(max(LAGS) + max(RUNS)) // STEP)
    for first in range(0, count, span):
        last = min(first + span, count)
        low, high = max(first - before, 0), min(last + 1, count)
        data = np.zeros((high - low) * STEP, np.uint8)
        piece = text[low * STEP:high * STEP]
        data[:len(piece)] = np.frombuffer(piece, np.uint8)
        best = pooled(answers(net, channels(net, data)), np.array([high - low]))
        each = best @ net.weights + net.offset
        total += float(each[first - low:last - low].sum())
    return total / count


def logits(net: Network, texts: list) -> np.ndarray:
    out = np.empty(len(texts), np.float64)
    short = [i for i, t in enumerate(texts) if len(t) <= PART]
    for run in parts([texts[i] for i in short]):
        of = [short[i] for i in run]
        out[of] = means(net, [texts[i] for i in of])
    for i, text in enumerate(texts):
        if len(text) > PART:
            out[i] = long_mean(net, text)
    return net.scale * out + net.shift


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(texts: list[bytes], labels: list[int], prior: float, epochs: int = 10, steps: int = 120,
        batch: int = 32, rate: float = 0.01, seed: int = SEED) -> Network:
    """Fit a network by stochastic gradient descent (Adam) on the logistic loss of documents,
    in so many epochs and at least so many steps.

    A tenth of the documents is left out of it and used to calibrate: the scale and shift of
    the mean are fitted on them, weighted so that label 1 has the share ``prior``.
    """
    random = np.random.default_rng(seed)
    net = Network.fresh(random)
    y = np.asarray(labels, np.float64)
    if len(set(labels)) < 2:
        return Network(net.vectors, net.filters, net.offsets, net.weights * 0, 0.0, 1.0,
                       float(np.log(max(prior, 1e-3) / max(1 - prior, 1e-3))))
    order = random.permutation(len(texts))
    aside = order[:len(order) // 10] if len(order) >= 200 else order
    rest = order[len(order) // 10:] if len(order) >= 200 else order
    names = ("vectors", "filters", "offsets", "weights")
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in names}
    bias, step = [0.0, 0.0], 0
    a_round = -(-len(rest) // batch)
    epochs = max(epochs, -(-steps // a_round))
    total = epochs * a_round
    for _ in range(epochs):
        random.shuffle(rest)
        for at in range(0, len(rest), batch):
            of = rest[at:at + batch]
            step += 1
            grads = gradients(net, [texts[i] for i in of], y[of])
            now = rate * (1 - step / (total + 1))
            for n in names:
                first, second = moments[n]
                first += 0.1 * (grads[n] - first)
                second += 0.01 * (grads[n] ** 2 - second)
                getattr(net, n)[...] -= now * (first / (1 - 0.9 ** step)) / (
                    np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
            bias[0] += 0.1 * (grads["offset"] - bias[0])
            bias[1] += 0.01 * (grads["offset"] ** 2 - bias[1])
            net.offset -= now * (bias[0] / (1 - 0.9 ** step)) / ((bias[1] / (1 - 0.99 ** step)) ** 0.5 + 1e-6)
    calibrate(net, logits(net, [texts[i] for i in aside]), y[aside], prior)
    return net


def gradients(net: Network, texts: list[bytes], y: np.ndarray) -> dict:
    data, chunks = laid_out(texts)
    rows = channels(net, data)
    said = answers(net, rows)
    best = pooled(said, chunks)
    each = best @ net.weights + net.offset
    owner = np.repeat(np.arange(len(texts)), chunks)
    mean = np.bincount(owner, each, len(texts)) / chunks
    slope = ((sigmoid(mean) - y) / len(texts) / chunks)[owner].astype(np.float32)
    grads = {"weights": best.T @ slope, "offset": float(slope.sum())}
    # Only the strides that gave the strongest answers pass anything back.
    steps = said.reshape(len(best), -1, FILTERS)
    at = steps.argmax(axis=1) + np.arange(len(best))[:, None] * (STEP // STRIDE)
    passed = slope[:, None] * net.weights * (np.take_along_axis(said, at, axis=0) > 0)
    width = rows.shape[1]
    grads["offsets"] = passed.sum(axis=0)
    grads["filters"] = np.empty_like(net.filters)
    grads["vectors"] = np.zeros_like(net.vectors)
    following = np.minimum(at + 1, len(rows) - 1)
    for f in range(FILTERS):
        seen = np.concatenate((rows[at[:, f]], rows[following[:, f]]), axis=1)
        grads["filters"][:, f] = seen.T @ passed[:, f]
        back = passed[:, f][:, None, None] * net.filters[:, f].reshape(1, WIDTH, -1)[:, :, :VECTOR]
        places = np.concatenate([at[:, f][:, None] * STRIDE + np.arange(STRIDE),
                                 following[:, f][:, None] * STRIDE + np.arange(STRIDE)], axis=1)
        np.add.at(grads["vectors"], data[places], back)
    grads["vectors"][0] = 0
    assert width * 2 == net.filters.shape[0]
    return grads


def calibrate(net: Network, mean: np.ndarray, y: np.ndarray, prior: float) -> None:
    weight = np.where(y == 1, prior / max(y.mean(), 1e-6), (1 - prior) / max(1 - y.mean(), 1e-6))
    a, b = 1.0, 0.0
    for _ in range(300):
        p = sigmoid(a * mean + b)
        error, curve = weight * (p - y), weight * p * (1 - p)
        # A Newton step, held back by a small pull towards no change.
        grad = np.array([(error * mean).sum() + 0.01 * (a - 1), error.sum() + 0.01 * b])
        hess = np.array([[(curve * mean * mean).sum() + 0.01, (curve * mean).sum()],
                         [(curve * mean).sum(), curve.sum() + 0.01]])
        move = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = max(a - move[0], 0.05), b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    net.scale, net.shift = a, b


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS):
    """Texts and labels of at most ``rows`` labelled documents that are not held out, half of
    each label as far as there are, chosen by a hash of their id; and the share of label 1
    among all that are not held out. Ids labelled both ways, null ids and null labels are left out.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter("quality IN (0, 1) AND doc_id IS NOT NULL").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = known.filter("quality = other").select("doc_id", "quality")
    ids, counts = [], []
    for label in (0, 1):
        of = known.filter(F.col("quality") == label)
        counts.append(of.count())
        ids += of.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2).collect()
    if not ids:
        return [], [], 0.5
    chosen = docs.sparkSession.createDataFrame(ids, "doc_id long, quality int")
    # At most SAMPLE_ROWS ids: a bounded broadcast, and a bounded number of texts to the driver.
    found = id_and_text(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).collect()
    found.sort(key=lambda r: r["doc_id"])
    return ([r["text"].encode() for r in found], [r["quality"] for r in found],
            counts[1] / max(sum(counts), 1))


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
    return source.mapInArrow(lean(score), type(source.schema)(fields).add("__score", "double"))


def good(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` that the classifier predicts label 1 for."""
    return scored(docs, train(docs, labels, rows), docs.columns).filter(
        F.col("__score") >= CUT).drop("__score")


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network:
    texts, known, prior = labelled_sample(docs, labels, rows)
    return fit(texts, known, prior)


def quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    A null text scores as an empty one, rows that come twice score alike, columns besides
    doc_id and text are not read, and an empty table gives no rows. Without labels of
    both kinds every document scores the share of label 1.
    """
    net = train(docs, labels, rows)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return scored(ids, net, ["doc_id"]).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
        (F.col("__score") >= CUT).cast("int").alias("predicted"))
