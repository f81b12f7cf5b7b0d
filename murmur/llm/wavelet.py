"""A wavelet matrix over token ids: bit-planes with rank directories in one block of bytes."""

from __future__ import annotations

import numpy as np

BLOCK = 512  # bits per entry of the rank directory
HEADER = np.dtype([("length", "<u8"), ("bits", "<u4"), ("words", "<u4")])


class WaveletMatrix:
    """Access, counting and occurrence lookup over a sequence of ids, from its bit-planes alone.

    Plane by plane, from the highest bit down, the sequence is parted stably into ids
    whose bit is 0 and ids whose bit is 1. ``planes`` holds the bits as 64-bit words,
    ``ranks`` the ones before each block of 512 bits, ``zeros`` the zeros of each plane.
    """

    def __init__(self, length: int, planes: np.ndarray, ranks: np.ndarray, zeros: np.ndarray):
        self.length, self.planes, self.ranks, self.zeros = length, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        n = len(ids)
        words = -(-n // BLOCK) * (BLOCK // 64)
        planes = np.zeros((bits, words), "<u8")
        zeros = np.zeros(bits, "<u8")
        level = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        for row in range(bits):
            bit = (level & level.dtype.type(1 << (bits - 1 - row))) != 0
            packed = np.packbits(bit, bitorder="little")
            planes[row].view(np.uint8)[: len(packed)] = packed
            low = level[~bit]
            zeros[row] = len(low)
            level = np.concatenate([low, level[bit]])
        return cls(n, planes, cls._directory(planes), zeros)

    @staticmethod
    def _directory(planes: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(planes).reshape(planes.shape[0], -1, BLOCK // 64).sum(axis=2, dtype=np.uint64)
        ranks = np.zeros((planes.shape[0], ones.shape[1] + 1), "<u4")
        ranks[:, 1:] = np.cumsum(ones, axis=1)
        return ranks

    def to_bytes(self) -> bytes:
        header = np.array([(self.length, self.planes.shape[0], self.planes.shape[1])], HEADER)
        return b"".join((header.tobytes(), self.zeros.tobytes(), self.ranks.tobytes(), self.planes.tobytes()))

    @classmethod
    def from_bytes(cls, blob: bytes) -> WaveletMatrix:
        length, bits, words = np.frombuffer(blob, HEADER, 1)[0].tolist()
        at = HEADER.itemsize
        zeros = np.frombuffer(blob, "<u8", bits, at)
        at += zeros.nbytes
        blocks = words * 64 // BLOCK + 1
        ranks = np.frombuffer(blob, "<u4", bits * blocks, at).reshape(bits, blocks)
        at += ranks.nbytes
        planes = np.frombuffer(blob, "<u8", bits * words, at).reshape(bits, words)
        return cls(length, planes, ranks, zeros)

    def _rank1(self, row: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position."""
        block = at // BLOCK
        ones = self.ranks[row][block].astype(np.int64)
        plane = np.append(self.planes[row], np.uint64(0))
        for i in range(BLOCK // 64):
            word = block * (BLOCK // 64) + i
            keep = np.clip(at - word * 64, 0, 64)
            mask = np.where(keep >= 64, ~np.uint64(0), (np.uint64(1) << keep.astype(np.uint64) % np.uint64(64)) - np.uint64(1))
            ones += np.bitwise_count(plane[np.minimum(word, len(plane) - 1)] & mask)
        return ones

    def _bit(self, row: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[row][at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1) == 1

    def access(self, positions) -> np.ndarray:
        """The ids at the given positions."""
        at = np.asarray(positions, np.int64)
        found = np.zeros(len(at), np.uint32)
        for row in range(len(self.planes)):
            bit = self._bit(row, at)
            ones = self._rank1(row, at)
            at = np.where(bit, int(self.zeros[row]) + ones, at - ones)
            found = (found << np.uint32(1)) | bit.astype(np.uint32)
        return found

    def _range(self, symbol: int, end: int) -> tuple[int, int]:
        low, high = np.int64(0), np.int64(end)
        bits = len(self.planes)
        for row in range(bits):
            ones = self._rank1(row, np.array([low, high]))
            if symbol >> (bits - 1 - row) & 1:
                low, high = int(self.zeros[row]) + ones
            else:
                low, high = low - ones[0], high - ones[1]
        return int(low), int(high)

    def count(self, symbol: int, end: int | None = None) -> int:
        """Occurrences of an id before ``end`` (default: all)."""
        if symbol >> len(self.planes) or not self.length:
            return 0
        low, high = self._range(symbol, self.length if end is None else end)
        return high - low

    def occurrences(self, symbol: int) -> np.ndarray:
        """All positions of an id, ascending."""
        if symbol >> len(self.planes) or not self.length:
            return np.zeros(0, np.int64)
        low, high = self._range(symbol, self.length)
        at = np.arange(low, high)
        bits = len(self.planes)
        for row in reversed(range(bits)):
            one = symbol >> (bits - 1 - row) & 1
            at = self._select(row, at - int(self.zeros[row]) if one else at, bool(one))
        return at

    def _select(self, row: int, order: np.ndarray, one: bool) -> np.ndarray:
        """Positions of the bits with the given 0-based orders among the ones (or zeros) of a plane."""
        ranks = self.ranks[row].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * BLOCK - ranks
        block = np.searchsorted(before, order, side="right") - 1
        bits = np.unpackbits(self.planes[row].view(np.uint8), bitorder="little").reshape(-1, BLOCK)[block]
        bits = bits if one else 1 - bits
        inside = np.cumsum(bits, axis=1, dtype=np.int32) > (order - before[block])[:, None]
        return block * BLOCK + inside.argmax(axis=1)

    def decode(self) -> np.ndarray:
        """The whole sequence: the partings undone from the lowest plane up."""
        bits = len(self.planes)
        kind = np.uint16 if bits <= 16 else np.uint32
        level = np.zeros(self.length, kind)
        for row in reversed(range(bits)):
            bit = np.unpackbits(self.planes[row].view(np.uint8), bitorder="little", count=self.length).view(bool)
            merged = np.empty_like(level)
            zeros = int(self.zeros[row])
            merged[~bit] = level[:zeros]
            merged[bit] = level[zeros:] | kind(1 << (bits - 1 - row))
            level = merged
        return level.astype("<u4")
