"""Word shingles of whole Arrow batches as 64-bit hashes, without Python work per word.

A word is a maximal run of characters other than the six ASCII white-space characters, lower-cased.
A shingle is ``WIDTH`` consecutive words; a text of fewer words (but at least one) has its whole word
sequence as its only shingle, and a text without words has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
#: Bytes of text whose arrays are held at a time, unless one text is longer.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_RNG = np.random.default_rng(20_240_601)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _RNG.integers(1, 2**63, WIDTH, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Separators of letter runs: every ASCII character that is no letter.
LETTER_RUNS = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Word hashes of some texts: ``hashes``, and ``bounds`` so that text i has hashes[bounds[i]:bounds[i+1]]."""

    def __init__(self, texts: pa.Array, lower: bool = True, separators: np.ndarray = _IS_SPACE):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if lower:
            texts = pc.utf8_lower(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        space = separators[raw]
        begins = ~space
        begins[1:] &= space[:-1]
        cuts = offsets[1:-1]
        cuts = cuts[cuts < len(raw)]
        begins[cuts] = ~space[cuts]
        starts = np.flatnonzero(begins)
        ends_here = np.empty(len(raw), bool)
        if len(raw):
            ends_here[:-1] = space[1:] | begins[1:]
            ends_here[-1] = True
            ends_here &= ~space
        ends = np.flatnonzero(ends_here) + 1 if len(raw) else starts
        up, down = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
        self.hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        self.hashes[self.hashes == 0] = 1  # 0 marks an empty slot in word tables
        self.bounds = np.searchsorted(starts, offsets)
        self.raw, self.starts, self.ends = raw, starts, ends

    def word(self, i: int) -> str:
        return self.raw[self.starts[i] : self.ends[i]].tobytes().decode("utf-8", "replace")

    def shingles(self) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, bounds) of the shingles, in text order and with repeats."""
        words, bounds = self.hashes, self.bounds
        n = np.diff(bounds)
        count = np.where(n >= WIDTH, n - WIDTH + 1, np.minimum(n, 1))
        out_bounds = np.concatenate([[0], np.cumsum(count)])
        total = out_bounds[-1]
        first = np.repeat(bounds[:-1], count) + np.arange(total) - np.repeat(out_bounds[:-1], count)
        padded = np.concatenate([words, np.zeros(WIDTH, np.uint64)])
        left = np.repeat(bounds[1:], count) - first
        acc = np.zeros(total, np.uint64)
        for k in range(WIDTH):
            part = padded[first + k] * _PLACE[k]
            short = left <= k
            if short.any():
                part[short] = 0
            acc += part
        return mix(acc), out_bounds

    def sequence_keys(self) -> np.ndarray:
        """Two 64-bit hashes per text of its word sequence, for finding equal texts."""
        n = np.diff(self.bounds)
        place = np.arange(len(self.hashes)) - np.repeat(self.bounds[:-1], n)
        up, _ = powers(int(n.max(initial=0)) + 1)
        keys = np.zeros((len(n), 2), np.uint64)
        full = n > 0
        if full.any():
            at = self.bounds[:-1][full]
            keys[full, 0] = np.add.reduceat(self.hashes * up[place], at)
            keys[full, 1] = np.add.reduceat(mix(self.hashes + up[place]), at)
        keys[:, 1] += n.astype(np.uint64)
        return mix(keys)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one longer text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > limit:
            yield start, i
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield start, len(sizes)


def signatures(hashes: np.ndarray, bounds: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """MinHash values, texts x seeds; all ones for a text without shingles."""
    out = np.full((len(bounds) - 1, len(seeds)), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        at, buffer = bounds[:-1][full], np.empty(len(hashes), np.uint64)
        for k, seed in enumerate(seeds):
            np.multiply(hashes, seed, out=buffer)
            np.bitwise_xor(buffer, buffer >> np.uint64(29), out=buffer)
            out[full, k] = np.minimum.reduceat(buffer, at)
    return out


def seeds(n: int, salt: int = 0) -> np.ndarray:
    return np.random.default_rng(77 + salt).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)
