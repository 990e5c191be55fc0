"""Words of a whole Arrow column of texts as byte spans, found and hashed by numpy without a loop over words.

Nulls count as empty texts. Work goes in chunks of rows with a bounded number of bytes, so memory
doesn't depend on how many rows a batch holds; one text is never divided.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: The ASCII white space [\x20\x09-\x0D].
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
#: Everything in ASCII but letters and digits.
NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Everything in ASCII but letters.
NOT_LETTER = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])
#: A-Z to lower case, all else as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK = 2 << 20
#: The same where each word takes many values.
SMALL = 512 << 10
#: Bytes of words that are hashed at once, or one word.
PART = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.Generator(np.random.PCG64(2024)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that any of their bits may serve as a bucket."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd 64-bit constant."""
    out = np.full(n, _STEP)
    out[:1] = 1
    return np.multiply.accumulate(out)


@dataclass
class Words:
    """bytes: of the chunk's texts, end to end; starts, ends: of each word there; doc: the row of each word, within the chunk; bounds: of the texts."""

    bytes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        n = self.ends - self.starts
        done = np.concatenate(([0], np.cumsum(n)))
        out = np.zeros(len(n), np.uint64)
        lo = 0
        while lo < len(n):
            # some words at a time: several 64-bit values for each byte of all of them would be most of a worker's memory
            hi = max(lo + 1, int(np.searchsorted(done, done[lo] + PART, "right")) - 1)
            size, first = n[lo:hi], done[lo:hi] - done[lo]
            at = np.arange(int(done[hi] - done[lo])) - np.repeat(first, size)
            value = _BYTES[self.bytes[at + np.repeat(self.starts[lo:hi], size)]] * powers(int(size.max()))[at]
            out[lo:hi] = mix(np.add.reduceat(value, first) + size.astype(np.uint64))
            lo = hi
        return out

    def counts(self) -> np.ndarray:
        """How many words each text has."""
        return np.bincount(self.doc, minlength=len(self.bounds) - 1)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each begins and ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, bounds, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def words(texts: pa.Array, apart: np.ndarray = WHITE, case: np.ndarray | None = LOWER) -> Words:
    """apart: which bytes stand between words; case: what each byte becomes."""
    data, bounds = raw(texts)
    white = apart[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([True], white[:-1])) | edge[:-1] if len(data) else white
    after = np.concatenate((white[1:], [True])) | edge[1:] if len(data) else white
    starts, ends = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
    doc = np.searchsorted(bounds, starts, "right") - 1
    return Words(data if case is None else case[data], starts, ends, doc, bounds)


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most limit bytes each, or of one row."""
    _, bounds = raw(texts)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def release() -> None:
    """Give back to the system what finished batches held: a worker stays beside its executor's heap, idle or for later stages, after its task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; others have none
    if trim:
        trim(0)


class Lookup:
    """Distinct 64-bit keys to int32 values in an open-addressed numpy table; -1 where a key is missing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, at, self.probes = np.arange(len(keys)), self._place(keys), 0
        while len(left):
            free = self.values[at] < 0
            _, first = np.unique(at[free], return_index=True)
            took = np.flatnonzero(free)[first]
            self.keys[at[took]], self.values[at[took]] = keys[left[took]], values[left[took]]
            rest = np.setdiff1d(np.arange(len(left)), took, assume_unique=True)
            left, at = left[rest], (at[rest] + 1) & self.mask
            self.probes += 1

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0xD6E8FEB86659FD93)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._place(keys)
        out = np.where(self.keys[at] == keys, self.values[at], np.int32(-1))
        open_ = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & self.mask
            there = at[open_]
            hit = self.keys[there] == keys[open_]
            full = self.values[there] >= 0
            out[open_[hit & full]] = self.values[there[hit & full]]
            open_ = open_[~hit & full]
        return out
