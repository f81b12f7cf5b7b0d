"""Words and word shingles of whole batches of texts as 64-bit hashes, without a loop over words.

A word is a maximal run of ASCII letters, ASCII digits and non-ASCII characters of the
lower-cased text. A shingle is ``size`` consecutive words; a shorter text that has words
is one shingle of all of them, and a text without words has none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from murmur.llm.inputs import flat_bytes

SHINGLE_WORDS = 5
BATCH_BYTES = 1 << 20  # keeps the arrays of a batch near the CPU's caches

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors, dtype=np.uint64)


_IN_WORD = _powers(0x9E3779B97F4A7C15 | 1, 1 << 16)
_IN_SHINGLE = _powers(0xD6E8FEB86659FD93 | 1, 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, offsets of the texts in it)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    data, offsets = flat_bytes(pc.utf8_lower(column))
    inside = _WORD_BYTE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # a text's first byte starts a word even behind another text's last
    starts[first] = inside[first]
    at = np.flatnonzero(starts)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    used = np.flatnonzero(inside)
    begin = np.searchsorted(used, at)
    length = np.diff(np.append(begin, len(used)))
    place = np.arange(len(used)) - np.repeat(begin, length)
    values = (data[used].astype(np.uint64) + np.uint64(1)) * _IN_WORD[place & 0xFFFF]
    return mix64(np.add.reduceat(values, begin) ^ length.astype(np.uint64)), np.searchsorted(at, offsets)


def shingles(column: pa.Array, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every shingle in text order, offsets of the texts in it)."""
    words, offsets = word_hashes(column)
    count = np.diff(offsets)
    whole = len(words) - size + 1
    rolled = np.zeros(len(words), np.uint64)
    for i in range(size):
        if whole > 0:
            rolled[:whole] += words[i : i + whole] * _IN_SHINGLE[i]
    short = np.flatnonzero((count < size) & (count > 0))
    for d in short:
        part = words[offsets[d] : offsets[d + 1]]
        rolled[offsets[d]] = (part * _IN_SHINGLE[: len(part)]).sum(dtype=np.uint64) + np.uint64(len(part))
    number = np.where(count >= size, count - size + 1, np.minimum(count, 1))
    ends = np.cumsum(number)
    keep = np.arange(ends[-1] if len(ends) else 0) + np.repeat(offsets[:-1] - (ends - number), number)
    return mix64(rolled[keep]), np.concatenate([[0], ends]).astype(np.int64)
