"""Secrets in texts: by form, and by a character network over every candidate (operator 1).

What three patterns find are labelled findings. A small convolutional network in numpy learns
from them and from runs of characters that no pattern took for a secret, or what patterns
leave of a run; it sees a candidate in windows that overlap, with the characters around each,
the latter hidden from it half of the time while it learns, so that it does not just learn key
words. All different windows but those set aside are learned from: they are dealt out into
blocks, in each round every block moves the network on its own, and what comes out is averaged.
A candidate is as sure as its surest window. The network's probabilities are calibrated on all
that is set aside, and for each form the threshold is the highest that still keeps the asked
share of the findings there. Candidates above it are added as ``learned`` spans.
"""

from __future__ import annotations

import codecs
import hashlib
import logging
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytenet import sigmoid
from tidemark.llm.common import text_values
from tidemark.session import staged

KINDS = ("assign", "access", "hex", "learned")
ASSIGN = re.compile(
    r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
RUN = re.compile(r"[A-Za-z0-9+/_.=-]{12,}")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_RUN = 12, 18, 12

BEFORE, INSIDE, AFTER = 24, 40, 8  # characters that the network sees
SIZE = BEFORE + INSIDE + AFTER
OVERLAP = 20  # of the characters inside with those of the next window
ALPHABET = 98  # printable ASCII, any other character, and none
VECTOR, WIDTH, FILTERS = 8, 5, 24
ASIDE = 5  # about every fifth candidate is set aside for calibration
BLOCK = 1 << 15  # windows that one learner takes in a round
LEAST_RARE = 256  # windows of the rarer label in a block, for which they may go to several
ROUNDS, LEAST_STEPS = 4, 100  # rounds, and steps of each learner in a round
CELLS = 4096  # in which one pass looks for a value by its rank
RECALL = 0.99  # of the findings set aside that a threshold must keep
LEAST_ASIDE = 20  # findings of one form, below which its threshold is at most that of all
SEED = 11


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """start, kind, end and where the secret itself begins, by start and then kind."""
    found = [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text)
             if m.end() - m.start(1) >= LEAST_ASSIGN]
    found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)
              if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


# The code of each byte in Latin-1: what lies beyond it is written as a byte that it does not print.
codecs.register_error("tidemark-other", lambda e: (b"\x80" * (e.end - e.start), e.end))
CODES = bytes(97 if c == 0 else c - 31 if 32 <= c <= 126 else 0 for c in range(256))


def seen(text: str, start: int, end: int) -> bytes:
    """The characters around and at the beginning of a candidate, at fixed places."""
    shown = "".join((text[max(start - BEFORE, 0):start].rjust(BEFORE, "\0"),
                     text[start:min(end, start + INSIDE)].ljust(INSIDE, "\0"),
                     text[end:end + AFTER].ljust(AFTER, "\0")))
    return shown.encode("latin-1", "tidemark-other").translate(CODES)


def windows_of(text: str, start: int, end: int) -> bytes:
    """All of a candidate, in windows of SIZE codes one after the other."""
    if end - start <= INSIDE:
        return seen(text, start, end)
    return b"".join(seen(text, at, min(end, at + INSIDE))
                    for at in range(start, end - OVERLAP, INSIDE - OVERLAP))


def form(value: str) -> int:
    """The form whose threshold holds for a candidate."""
    if re.fullmatch(r"[0-9a-f]+", value):
        return 2
    return 1 if re.fullmatch(r"[A-Z0-9]+", value) else 0


FOUND = ("doc_id long, base array<struct<start: long, kind: int, end: long>>, "
         "seen array<struct<start: long, end: long, form: int, label: int, windows: binary>>")
FOUND_ARROW = pa.schema([
    ("doc_id", pa.int64()),
    ("base", pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))),
    ("seen", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("form", pa.int32()),
                                 ("label", pa.int32()), ("windows", pa.binary())]))),
])


def examined(text: str) -> tuple[list[dict], list[dict]]:
    """The base spans of a text, and its findings (label 1) and other candidates (label 0)."""
    spans = base_spans(text)
    looked = [{"start": at, "end": end, "form": kind, "label": 1, "windows": windows_of(text, at, end)}
              for _, kind, end, at in spans]

    def look(start: int, end: int) -> None:
        if end - start >= LEAST_RUN:
            looked.append({"start": start, "end": end, "form": form(text[start:end]), "label": 0,
                           "windows": windows_of(text, start, end)})

    i = 0
    reach = 0
    for run in RUN.finditer(text):
        # Spans stand by their start; what none of them covers of a run is looked at.
        at = max(run.start(), reach)
        while i < len(spans) and spans[i][0] < run.end():
            look(at, spans[i][0])
            reach = max(reach, spans[i][2])
            at = max(at, reach)
            i += 1
        look(at, run.end())
    return [{"start": s, "kind": k, "end": e} for s, k, e, _ in spans], looked


def candidates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, its base spans and all that the network looks at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def find(batches):
        for batch in batches:
            held, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), text_values(batch.column(1)), strict=True):
                base, looked = examined(text)
                held.append({"doc_id": doc_id, "base": base, "seen": looked})
                size += len(looked) + sum(len(s["windows"]) for s in looked) // SIZE
                if len(held) >= 1000 or size > 20_000:
                    yield pa.RecordBatch.from_pylist(held, schema=FOUND_ARROW)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=FOUND_ARROW)

    return staged(rows.mapInArrow(find, FOUND), "secret-candidates")


PARTS = {"vectors": (ALPHABET, VECTOR), "filters": (WIDTH * VECTOR, FILTERS), "offsets": (FILTERS,),
         "weights": (FILTERS,), "offset": (1,)}


@dataclass
class CharNet:
    vectors: np.ndarray  # (ALPHABET, VECTOR)
    filters: np.ndarray  # (WIDTH * VECTOR, FILTERS)
    offsets: np.ndarray
    weights: np.ndarray
    offset: np.ndarray  # (1,)
    scale: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, float, float] = (2.0, 2.0, 2.0)  # above 1: nothing is added
    recalls: tuple = (None, None, None)  # of the findings of each form set aside, the share kept

    @classmethod
    def fresh(cls, random: np.random.Generator) -> CharNet:
        wide = WIDTH * VECTOR
        return cls(random.normal(0, 0.5, (ALPHABET, VECTOR)), random.normal(0, (2 / wide) ** 0.5, (wide, FILTERS)),
                   np.zeros(FILTERS), random.normal(0, 0.3, FILTERS), np.zeros(1))

    def numbers(self) -> np.ndarray:
        """All that is learned, in a row."""
        return np.concatenate([getattr(self, n).ravel() for n in PARTS]).astype(np.float32)

    def with_numbers(self, numbers: np.ndarray) -> CharNet:
        ends = np.cumsum([math.prod(shape) for shape in PARTS.values()])
        parts = np.split(np.array(numbers, np.float32), ends[:-1])
        return replace(self, **{n: v.reshape(PARTS[n]) for n, v in zip(PARTS, parts, strict=True)})

    def forward(self, codes: np.ndarray):
        """codes: (n, SIZE). What the filters see, the best place of each, and the sums."""
        vectors = self.vectors[codes].reshape(len(codes), -1)
        views = np.lib.stride_tricks.sliding_window_view(vectors, WIDTH * VECTOR, axis=1)[:, ::VECTOR]
        said = (views.reshape(-1, WIDTH * VECTOR) @ self.filters).reshape(len(codes), -1, FILTERS)
        best = said.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(said, best[:, None], axis=1)[:, 0] + self.offsets, 0)
        return views, best, pooled, pooled @ self.weights + self.offset[0]

    def sums(self, codes: np.ndarray) -> np.ndarray:
        """Those of ``forward``, in single precision and without where they come from."""
        out = np.empty(len(codes))
        vectors, filters = self.vectors.astype(np.float32), self.filters.astype(np.float32)
        for at in range(0, len(codes), 1000):
            given = vectors[codes[at:at + 1000]].reshape(-1, SIZE * VECTOR)
            views = np.lib.stride_tricks.sliding_window_view(given, WIDTH * VECTOR, axis=1)[:, ::VECTOR]
            said = (views.reshape(-1, WIDTH * VECTOR) @ filters).reshape(len(given), -1, FILTERS)
            out[at:at + 1000] = np.maximum(said.max(axis=1) + self.offsets, 0) @ self.weights + self.offset[0]
        return out

    def probability(self, codes: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.sums(codes) + self.shift)

    def surest(self, each: list[bytes]) -> list[float]:
        """The largest probability among the windows of each candidate."""
        if not each:
            return []
        sure = self.probability(np.frombuffer(b"".join(each), np.uint8).reshape(-1, SIZE))
        ends = np.cumsum([len(w) // SIZE for w in each])
        return np.maximum.reduceat(sure, np.r_[0, ends[:-1]]).tolist()


def gradients(net: CharNet, codes: np.ndarray, y: np.ndarray) -> dict:
    views, best, pooled, sums = net.forward(codes)
    slope = ((sigmoid(sums) - y) / len(y)).astype(pooled.dtype)
    passed = slope[:, None] * net.weights * (pooled > 0)
    rows = np.arange(len(codes))[:, None]
    back = passed[:, :, None] * net.filters.T
    characters = codes[rows[:, :, None], best[:, :, None] + np.arange(WIDTH)].astype(np.int64)
    places = characters[..., None] * VECTOR + np.arange(VECTOR)
    return {"weights": pooled.T @ slope, "offset": np.array([slope.sum()]), "offsets": passed.sum(axis=0),
            "filters": np.einsum("nfk,nf->kf", views[rows, best], passed),
            "vectors": np.bincount(places.ravel(), back.ravel(), ALPHABET * VECTOR).reshape(ALPHABET, VECTOR)}


def one_pass(y: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Places of all windows in a chance order, those of the rarer label as often as makes them
    about a quarter.
    """
    few, many = sorted((random.permutation(np.flatnonzero(y == label)) for label in (0, 1)), key=len)
    return random.permutation(np.r_[many, np.resize(few, max(len(few), len(many) // 3))]) if len(few) else many


def learn(net: CharNet, codes: np.ndarray, y: np.ndarray, turn: int, seed: object,
          batch: int = 64, rate: float = 0.01) -> CharNet:
    """``net`` moved by what these windows say, all of them at least once, in round ``turn``."""
    random = np.random.default_rng(seed)
    net = net.with_numbers(net.numbers())
    order = one_pass(y, random)
    while len(order) < LEAST_STEPS * batch:
        order = np.r_[order, one_pass(y, random)]
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in PARTS}
    around = np.r_[0:BEFORE, SIZE - AFTER:SIZE]
    for step, at in enumerate(range(0, len(order), batch), 1):
        of = order[at:at + batch]
        given = codes[of]
        hidden = np.flatnonzero(random.random(len(of)) < 0.5)
        given[np.ix_(hidden, around)] = 97
        grads = gradients(net, given, y[of])
        now = rate * (1 - (turn + at / len(order)) / ROUNDS)
        for n in PARTS:
            first, second = moments[n]
            first += 0.1 * (grads[n] - first)
            second += 0.01 * (grads[n] ** 2 - second)
            getattr(net, n)[...] -= now * (first / (1 - 0.9 ** step)) / (
                np.sqrt(second / (1 - 0.99 ** step)) + 1e-6)
    return net


def fit(windows: list[bytes], labels: list[int], forms: list[int], seed: int = SEED) -> CharNet:
    """What ``train`` does, over windows at hand, each of them a candidate of its own."""
    random = np.random.default_rng(seed)
    net = CharNet.fresh(random)
    y = np.asarray(labels)
    kept_back = np.isin(np.arange(len(y)), random.permutation(len(y))[::ASIDE])
    if len(set(y[~kept_back])) < 2:
        return net
    codes = np.frombuffer(b"".join(windows), np.uint8).reshape(-1, SIZE)
    for turn in range(ROUNDS):
        net = learn(net, codes[~kept_back], y[~kept_back], turn, (seed, turn))
    aside = np.flatnonzero(kept_back)
    calibrate(net, codes[aside], y[aside], np.asarray(forms)[aside], np.ones(len(aside), bool))
    return net


def scaled(totals: Callable[[float, float], tuple]) -> tuple[float, float]:
    """The logistic curve over the sums of what is set aside. ``totals`` adds up, for a curve, the
    errors times sums, the errors, and the curvatures times squared sums, times sums and alone.
    """
    a, b = 1.0, 0.0
    for _ in range(100):
        error_sums, errors, squares, mixed, curves = totals(a, b)
        move = np.clip(np.linalg.solve(np.array([[squares + 0.01, mixed], [mixed, curves + 0.01]]),
                                       np.array([error_sums + 0.01 * (a - 1), errors + 0.01 * b])), -1, 1)
        before, (a, b) = (a, b), (max(a - float(move[0]), 0.05), b - float(move[1]))
        if max(abs(a - before[0]), abs(b - before[1])) < 1e-9:
            break
    return a, b


def set_thresholds(net: CharNet, counts: tuple, ranked: Callable[[int | None, int], float],
                   reached: Callable[[int, float], int]) -> None:
    """Thresholds by form, from the number of findings of each, the sum of a form (or of all) at a
    rank from the lowest, and how many of a form reach a sum.
    """
    if not sum(counts):
        return

    def highest(kind: int | None, count: int) -> float:
        """The highest sum that keeps the asked share of these findings."""
        return ranked(kind, int((count - 1) * (1 - RECALL)))

    every = highest(None, sum(counts))
    least = [every if not n else highest(kind, n) if n >= LEAST_ASIDE else min(every, highest(kind, n))
             for kind, n in enumerate(counts)]
    net.thresholds = tuple(sigmoid(net.scale * np.array(least) + net.shift).tolist())
    net.recalls = tuple(reached(kind, least[kind]) / n if n else None for kind, n in enumerate(counts))


def calibrate(net: CharNet, codes: np.ndarray, y: np.ndarray, forms: np.ndarray, first: np.ndarray) -> None:
    """Scale and thresholds from windows at hand; ``first`` tells the first ones of findings, by
    which thresholds are set: a finding that its first window keeps is kept by the largest of all.
    """
    sums = net.sums(codes)

    def totals(a, b):
        p = sigmoid(a * sums + b)
        curve = p * (1 - p)
        return ((p - y) * sums).sum(), (p - y).sum(), (curve * sums ** 2).sum(), (curve * sums).sum(), curve.sum()

    net.scale, net.shift = scaled(totals)
    found = (y == 1) & first
    own = {kind: np.sort(sums[found & (forms == kind)]) for kind in range(3)} | {None: np.sort(sums[found])}
    set_thresholds(net, tuple(len(own[kind]) for kind in range(3)), lambda kind, rank: float(own[kind][rank]),
                   lambda kind, least: int((own[kind] >= least).sum()))


def at_rank(sums: DataFrame, rank: int) -> float:
    """The value of ``sum`` with this rank, 0 for the least, by counts in ever smaller cells."""
    value = F.col("sum")
    low, high = sums.agg(F.min(value), F.max(value)).first()
    while low < high:
        cell = F.least(F.floor((value - low) / (high - low) * CELLS), F.lit(CELLS - 1))
        cells = sums.filter(value.between(low, high)).groupBy(cell.alias("cell")).agg(
            F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        for c in sorted(cells, key=lambda c: c.cell):
            if rank < c.n:
                low, high = c.low, c.high
                break
            rank -= c.n
    return low


SUMS = "label int, form int, first boolean, sum double"


def calibrate_on(net: CharNet, aside: DataFrame) -> None:
    """``calibrate`` over all rows of ``aside`` (window, label, form, later), none of them collected."""
    def score(batches):
        for batch in batches:
            if len(batch):
                codes = np.frombuffer(b"".join(batch.column("window").to_pylist()), np.uint8).reshape(-1, SIZE)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label"), batch.column("form"), pc.invert(batch.column("later")),
                     pa.array(net.sums(codes))], ["label", "form", "first", "sum"])

    scored = staged(aside.select("window", "label", "form", "later").mapInArrow(score, SUMS), "secret-sums")
    value, found = F.col("sum"), scored.filter("label = 1 and first")

    def totals(a, b):
        p = 1 / (1 + F.exp(-(a * value + b)))
        curve, error = p * (1 - p), p - F.col("label")
        sums = scored.agg(F.sum(error * value), F.sum(error), F.sum(curve * value * value),
                          F.sum(curve * value), F.sum(curve)).first()
        return tuple(s or 0.0 for s in sums)

    net.scale, net.shift = scaled(totals)
    counts = {r["form"]: r["count"] for r in found.groupBy("form").count().collect()}

    def own(kind):
        return found if kind is None else found.filter(F.col("form") == kind)

    set_thresholds(net, tuple(counts.get(kind, 0) for kind in range(3)),
                   lambda kind, rank: at_rank(own(kind), rank),
                   lambda kind, least: own(kind).filter(value >= least).count())


def different_windows(found: DataFrame) -> DataFrame:
    """One row per window, form and label: whether it only comes behind the first of a finding,
    and whether the candidate that it is part of is set aside.
    """
    each = found.select(F.explode("seen").alias("s")).select("s.*")
    starts = F.sequence(F.lit(1), F.length("windows"), F.lit(SIZE))
    windows = each.select("label", "form", F.xxhash64("windows").alias("whole"), F.posexplode(F.transform(
        starts, lambda at: F.substring(F.col("windows"), at, F.lit(SIZE)))).alias("place", "window"))
    grouped = windows.groupBy("window", "form", "label").agg(
        F.min("whole").alias("whole"), F.min(F.col("place") > 0).alias("later"))
    return grouped.select("window", "form", "label", "later", (
        F.pmod(F.xxhash64("whole", F.lit(SEED)), F.lit(ASIDE)) == 0).alias("aside"))


def dealt(windows: DataFrame, counts: dict[int, int]) -> DataFrame:
    """``windows`` in blocks of about BLOCK, one row each. Those of the rarer label go to several
    where each block would else hold too few.
    """
    blocks = -(-sum(counts.values()) // BLOCK)
    rarer = min(counts, key=counts.get)
    copies = min(blocks, max(1, -(-LEAST_RARE * blocks // counts[rarer])))
    shifts = F.sequence(F.lit(0), F.when(F.col("label") == rarer, copies - 1).otherwise(0))
    block = F.explode(F.transform(shifts, lambda i: F.pmod(F.xxhash64("window", F.lit(SEED)) + i, F.lit(blocks))))
    return windows.withColumn("block", block).groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("window", "form", "label"))).alias("windows"))


LEARNED = "block long, weight long, numbers binary"


def one_round(net: CharNet, blocks: DataFrame, turn: int) -> CharNet:
    """The average of what the learner of each block makes of ``net``, by numbers of windows."""
    def move(batches):
        for batch in batches:
            for block, windows in zip(batch.column("block").to_pylist(), batch.column("windows"), strict=True):
                codes = np.frombuffer(b"".join(windows.values.field("window").to_pylist()), np.uint8).reshape(-1, SIZE)
                y = windows.values.field("label").to_numpy(zero_copy_only=False)
                moved = learn(net, codes, y, turn, (SEED, turn, block)).numbers().tobytes()
                yield pa.RecordBatch.from_pydict({"block": [block], "weight": [len(y)], "numbers": [moved]})

    learned = sorted(blocks.mapInArrow(move, LEARNED).collect(), key=lambda r: r["block"])
    return net.with_numbers(np.average([np.frombuffer(r["numbers"], np.float32) for r in learned], axis=0,
                                       weights=[r["weight"] for r in learned]))


def train(found: DataFrame) -> CharNet:
    """Learn from all different windows of candidates that are not set aside, then calibrate and
    set thresholds on all that are; without both labels nothing is ever added.
    """
    windows = staged(different_windows(found), "secret-windows")
    rest = windows.filter("not aside")
    net = CharNet.fresh(np.random.default_rng(SEED))
    counts = {r["label"]: r["count"] for r in rest.groupBy("label").count().collect()}
    if len(counts) < 2:
        return net
    blocks = staged(dealt(rest, counts), "secret-blocks")
    for turn in range(ROUNDS):
        net = one_round(net, blocks, turn)
    calibrate_on(net, windows.filter("aside"))
    return net


def listed(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


RESULT = ("doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, "
          "spans string, n_learned long")
RESULT_NAMES = [f.split()[0] for f in RESULT.split(", ")]


def secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_assign, n_access, n_hex, base_sha256, spans,
    n_learned.

    A null text is empty and has no spans; rows that come twice get the same spans; columns
    besides doc_id and text are not read; an empty table gives no rows.
    """
    found = candidates(docs)
    net = train(found)
    logging.getLogger(__name__).info(
        "thresholds by form %s, recall of findings set aside %s", net.thresholds, net.recalls)

    def judge(batches):
        for batch in batches:
            rows = batch.to_pylist()
            sure = iter(net.surest([s["windows"] for r in rows for s in r["seen"]]))
            out = []
            for row in rows:
                base = [(s["start"], s["kind"], s["end"]) for s in row["base"]]
                judged = [(s, next(sure)) for s in row["seen"]]
                learned = [(s["start"], 3, s["end"]) for s, p in judged
                           if s["label"] == 0 and p >= net.thresholds[s["form"]]]
                counts = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                out.append((row["doc_id"], *counts, hashlib.sha256(listed(base).encode()).hexdigest(),
                            listed(sorted(base + learned)), len(learned)))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) if i == 0 else pa.array(c)
                     for i, c in enumerate(zip(*out, strict=True))], RESULT_NAMES)

    return found.mapInArrow(judge, RESULT)
