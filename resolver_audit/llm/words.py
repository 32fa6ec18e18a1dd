"""Words and word n-grams of whole Arrow text columns, as NumPy arrays.

Texts are handled as UTF-8 bytes. Both word classes are decided by single ASCII bytes,
so no text is decoded and no Python loop runs over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are split at once; bounds a task's arrays (a longer single text is taken whole).
CHUNK_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32



def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z of UTF-8 bytes in lower case."""
    return _LOWER[data]


#: Letters and digits of ASCII, and everything beyond ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = True
ALNUM[128:] = True

#: Everything but ASCII white space.
VISIBLE = np.ones(256, dtype=bool)
VISIBLE[[32, *range(9, 14)]] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n - 1, modulo 2**64; kept for the life of the worker."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have)
        if size <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


@dataclass
class Words:
    """Words of some texts: text i has the words first[i] to first[i + 1] - 1."""

    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray
    _hashes: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def hashes(self) -> np.ndarray:
        """64-bit hash of each word's bytes."""
        if self._hashes is None:
            n = len(self.data)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum(_BYTE_VALUES[self.data] * _power_table(_BASE, n), out=sums[1:])
            raw = (sums[self.end] - sums[self.start]) * _power_table(_INVERSE, n + 1)[self.start]
            self._hashes = mix(raw + (self.end - self.start).astype(np.uint64))
        return self._hashes

    def text_of(self, i: int) -> list[bytes]:
        lo, hi = self.first[i], self.first[i + 1]
        data = self.data
        return [data[s:e].tobytes() for s, e in zip(self.start[lo:hi], self.end[lo:hi], strict=True)]

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def binary_parts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a text column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if len(texts) == 0:
        return np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint8)
    buffer = texts.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, dtype=np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


def split_words(texts: pa.Array, kind: np.ndarray) -> Words:
    """Lower-cases A-Z and takes the maximal runs of bytes that kind marks."""
    offsets, data = binary_parts(texts)
    data = _LOWER[data]
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = kind[data]
    begins = inside[1:-1] & ~inside[:-2]
    ends = inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    begins[edges] |= inside[1:-1][edges]
    ends[edges - 1] |= inside[1:-1][edges - 1]
    start = np.flatnonzero(begins)
    return Words(np.searchsorted(start, offsets), start, np.flatnonzero(ends) + 1, data)


_MULTIPLIERS = mix(np.arange(101, 164, dtype=np.uint64)) | np.uint64(1)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words; one entry per place where n words are left."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.full(len(hashes) - n + 1, n, dtype=np.uint64)
    for j in range(n):
        out += hashes[j : j + len(out)] * _MULTIPLIERS[j]
    return mix(out)


def grams_within(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (word numbers) whose n words lie in one text, and the hashes there."""
    grams = rolling(words.hashes, n)
    place = np.arange(len(grams))
    last = np.repeat(words.first[1:], words.counts)[: len(grams)]
    keep = place + n <= last
    return place[keep], grams[keep]


def phrase_hashes(phrase: str, n: int) -> list[int]:
    """The rolling hashes of a phrase, as signed 64-bit numbers."""
    words = split_words(pa.array([phrase]), ALNUM)
    return [int(h) for h in rolling(words.hashes, n).view(np.int64)]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about limit bytes of text each, and one row at least."""
    at = batch.schema.get_field_index(column)
    offsets, _ = binary_parts(batch.column(at))
    row = 0
    while row < batch.num_rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield batch.slice(row, to - row)
        row = to
    pa.default_memory_pool().release_unused()
