"""Sets of five-word shingles as sorted 64-bit hashes, with numpy over a batch of texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.llm.common import bytes_and_bounds

WORDS = 5
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def constants(count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, count, np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the texts, A-Z in lower case, and how many each text has."""
    lower = pc.binary_join_element_wise(pc.ascii_lower(pc.fill_null(texts, "")), "", "\n")
    view, bounds = bytes_and_bounds(lower)
    raw = np.frombuffer(view, np.uint8)[bounds[0]:bounds[-1]]
    bounds = bounds - bounds[0]
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    # A text ends with white space, so no word reaches into the next.
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(raw) and not space[0]:
        edge = np.concatenate(([0], edge))
    starts, ends = edge[0::2], edge[1::2]
    counts = np.diff(np.searchsorted(starts, bounds))
    # Each word is a polynomial of its bytes: sums up to its end less those up to its start,
    # brought to the same power.
    powers = np.empty(len(raw) + 1, np.uint64)
    powers[0] = 1
    powers[1:] = MULTIPLIER
    np.cumprod(powers, out=powers)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(constants(256, 1)[raw] * powers[:-1], out=sums[1:])
    inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
    back = np.empty(len(raw) + 1, np.uint64)
    back[0] = 1
    back[1:] = inverse
    np.cumprod(back, out=back)
    return mixed((sums[ends] - sums[starts]) * back[starts]), counts


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; a text of fewer words has one,
    of all its words, and a text without words none.
    """
    words, counts = words_of(texts)
    factors = constants(WORDS, 2)
    windows = np.zeros(max(len(words) - WORDS + 1, 0), np.uint64)
    for i in range(WORDS):
        windows += words[i:i + len(windows)] * factors[i]
    windows = mixed(windows)
    at = 0
    for count in counts.tolist():
        if count >= WORDS:
            found = np.sort(windows[at:at + count - WORDS + 1])
            first = np.empty(len(found), bool)
            first[0] = True
            np.not_equal(found[1:], found[:-1], out=first[1:])
            yield found[first]
        elif count:
            short = (words[at:at + count] * factors[:count]).sum(dtype=np.uint64) + np.uint64(count)
            yield mixed(np.array([short], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        at += count
