"""Words of a text as numpy arrays: places and 64-bit hashes, without a Python loop over them."""

from __future__ import annotations

import numpy as np
import xxhash

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
LONG = 64  # bytes of a word that is hashed by itself
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n of eight bytes


def mixed(values: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that their order says nothing about them."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX[0]
    values = values ^ (values >> np.uint64(27))
    values = values * _MIX[1]
    return values ^ (values >> np.uint64(31))


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII blanks in UTF-8 bytes."""
    edges = np.flatnonzero(np.diff(np.concatenate(([True], BLANK[data], [True])).view(np.int8)))
    return edges[::2], edges[1::2]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word: eight bytes at a time, mixed between; long words one by one.

    The mixing is no sum, so words that differ by any pattern of letters have unrelated hashes.
    """
    lengths = (ends - starts).astype(np.uint64)
    if not len(starts):
        return lengths
    # Each place as the eight bytes from there on.
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(data) + 1, "<u8", padded.data, strides=(1,))
    out = mixed(lengths * BASE + _MIX[1])
    at, left = np.arange(len(starts)), lengths.astype(np.int64)
    long = left > LONG
    at = at[~long]
    place = starts[at]
    while len(at):
        chunk = eights[place] & _FIRST[np.minimum(left[at], 8)]
        out[at] = mixed((out[at] ^ chunk) * BASE + _MIX[0])
        left[at] -= 8
        more = left[at] > 0
        at, place = at[more], place[more] + 8
    raw = data.tobytes() if long.any() else b""
    for i in np.flatnonzero(long):
        out[i] = xxhash.xxh3_64_intdigest(raw[starts[i]:ends[i]], seed=int(_MIX[0]))
    return out


def word_hashes(text: str | None, lower: bool = False) -> np.ndarray:
    """Hashes of the words of a text; ``lower`` folds A-Z only."""
    raw = (text or "").encode()
    data = np.frombuffer(raw.lower() if lower else raw, np.uint8)
    return hashes(data, *spans(data))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``size`` words; fewer words are one run."""
    if not len(words):
        return words
    size = min(size, len(words))
    runs = np.zeros(len(words) - size + 1, np.uint64)
    for at in range(size):
        runs = mixed(runs * BASE + words[at : len(words) - size + 1 + at])
    return np.unique(runs)
