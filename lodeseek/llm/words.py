"""Words and runs of words of many texts at once, as numbers.

A word is ``[^\\x20\\x09-\\x0D]+``. Bytes of UTF-8 above 0x7F never match a separator, so words are
found on the bytes. Everything here works on the arrays of one record batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_CHUNK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_random = np.random.default_rng(20240501)
_LETTERS = _random.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _LETTERS.copy()
_FOLDED[65:91] = _LETTERS[97:123]
_WEIGHTS = _random.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h + np.uint64(seed)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(name: str, base: int, n: int) -> np.ndarray:
    held = _powers.get(name)
    if held is None or len(held) < n:
        row = np.full(max(n, _CHUNK + 4096), base % (1 << 64), np.uint64)
        row[0] = 1
        _powers[name] = held = np.cumprod(row, dtype=np.uint64)
    return held


class Words:
    """The words of a column of texts; a null text has none.

    ``at[d]:at[d + 1]`` are the words of text ``d``; ``starts`` and ``ends`` are byte places in ``data``.
    ``separators`` says which bytes are no part of a word.
    """

    def __init__(self, texts: pa.Array, separators: np.ndarray = SPACE) -> None:
        texts = texts.cast(pa.large_string()).fill_null("")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        whole = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
        self.data = whole[offsets[0]:offsets[-1]]
        self.offsets = offsets - offsets[0]
        n = len(self.data)
        inside = ~separators[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.r_[False, inside[:-1]] if n else inside
        after = np.r_[inside[1:], False] if n else inside
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.at = np.searchsorted(self.starts, self.offsets)

    def hashes(self, folded: bool = False) -> np.ndarray:
        """A number for each word; ``folded`` takes A-Z as a-z."""
        table = _FOLDED if folded else _LETTERS
        starts, ends = self.starts, self.ends
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            base = starts[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, base + _CHUNK, "right")))
            size = int(ends[hi - 1] - base)
            run = np.empty(size + 1, np.uint64)
            run[0] = 0
            np.cumsum(table[self.data[base:base + size]] * _power("up", _BASE, size)[:size], out=run[1:])
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            down = _power("down", pow(_BASE, -1, 1 << 64), size)
            out[lo:hi] = (run[e] - run[s]) * down[s]
            lo = hi
        return mix(out)


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """A number for each run of ``size`` words, by the place of its first word, whatever texts it spans."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total += words[k:k + n] * _WEIGHTS[k % 64]
    return mix(total, size)


def run_places(at: np.ndarray, size: int) -> np.ndarray:
    """The places where a run of ``size`` words stays inside its text."""
    lengths = np.maximum(np.diff(at) - size + 1, 0)
    total = int(lengths.sum())
    firsts = np.repeat(at[:-1] - np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    return np.arange(total) + firsts


def whole_run(words: np.ndarray) -> int:
    """A number for a text of fewer words than a run."""
    total = (words * _WEIGHTS[: len(words)]).sum(dtype=np.uint64)
    return int(mix(np.array([total], np.uint64), len(words))[0])
