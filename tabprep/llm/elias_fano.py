"""Elias-Fano code of a sorted list of whole numbers: n * (2 + log2(range / n)) bits, with select.

The low bits of every number stand packed in one array; the high parts are written in unary in a bit vector, where the
i-th one bit stands at high(i) + i. Every SAMPLE-th one bit's position is kept, so select counts only a few bytes.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 256


def pack(values: np.ndarray, low_bits: int) -> bytes:
    if not low_bits or not len(values):
        return b""
    shifts = np.arange(low_bits, dtype=np.uint64)
    bits = (values.astype(np.uint64)[:, None] >> shifts) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def encode(values: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """(low bits, low array, high bit vector, select samples) of sorted numbers of at least 0."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    if not n:
        return 0, b"", b"", b""
    low_bits = max(0, (int(values[-1]) // n).bit_length() - 1)
    low = values & np.uint64((1 << low_bits) - 1)
    ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n, dtype=np.int64)
    high = np.zeros(int(ones[-1]) // 8 * 8 + 8, dtype=np.uint8)
    high[ones] = 1
    return low_bits, pack(low, low_bits), np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes()


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, samples: bytes) -> None:
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, dtype=np.uint8)
        self.high = np.frombuffer(high, dtype=np.uint8)
        self.samples = np.frombuffer(samples, dtype="<u4")

    def _low(self, i: int) -> int:
        start = i * self.low_bits
        end = start + self.low_bits
        word = int.from_bytes(self.low[start // 8 : -(-end // 8)].tobytes(), "little")
        return (word >> (start % 8)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // SAMPLE])
        left = i % SAMPLE  # one bits after the sample
        byte = at // 8
        here = int(self.high[byte]) >> (at % 8) << (at % 8)
        while left >= (ones := here.bit_count()):
            left -= ones
            byte += 1
            here = int(self.high[byte])
        for _ in range(left):
            here &= here - 1
        bit = byte * 8 + (here & -here).bit_length() - 1
        return (bit - i) << self.low_bits | self._low(i)

    def all(self) -> np.ndarray:
        """Every number, in one pass."""
        if not self.n:
            return np.zeros(0, dtype=np.uint64)
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if not self.low_bits:
            return high
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
        return high | (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
