"""Word shingles as 64-bit hashes, and their SuperMinHash signatures."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from .base import ascii_lower

HELD = 400_000  # word hashes held per Python process; a full memory starts anew
_U = np.uint64
_GOLDEN, _A, _B = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
_HALF = _U(32)
_LOW = _U(0xFFFFFFFF)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) >= HELD:
            self.clear()
        self[word] = value
        return value


_HASHES = _Hashes()


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = (x ^ (x >> _U(30))) * _A
    x = (x ^ (x >> _U(27))) * _B
    return x ^ (x >> _U(31))


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the text's word shingles, A-Z as a-z; with fewer words the whole sequence is one.

    Two different shingles share a hash with probability 2^-64.
    """
    words = ascii_lower(text).split()
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=n)
    width = min(size, n)
    out = np.full(n - width + 1, width, dtype=np.uint64)
    for i in range(width):
        out = mixed(out + hashes[i : n - width + 1 + i] + _GOLDEN)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def set_digest(elements: np.ndarray) -> bytes:
    """128 bits that name a set."""
    return hashlib.blake2b(elements.astype("<u8").tobytes(), digest_size=16).digest()


def super_minhash(elements: np.ndarray, m: int) -> np.ndarray:
    """Signature of m values, each (rank << 32 | random).

    Every element permutes the m places on its own (Fisher-Yates, driven by its hash): the place it ranks j-th gets the value
    j plus a random fraction, and each place keeps its least value. The elements advance rank by rank together; once every
    place holds a value below the next rank, no later rank can change any, and the work stops.
    """
    n = len(elements)
    out = np.full(m, np.iinfo(np.uint64).max, dtype=np.uint64)
    places = None
    rows = np.arange(n)
    swapped = None
    for j in range(m):
        x = mixed(elements + _U((int(_GOLDEN) * (j + 1)) % (1 << 64)))
        k = j + ((x & _LOW) * _U(m - j) >> _HALF).astype(np.int64)
        value = (_U(j) << _HALF) | (x >> _HALF)
        if j == 0:
            place, swapped = k, k
        else:
            if places is None:
                places = np.tile(np.arange(m, dtype=np.int16), (n, 1))
                places[rows, swapped] = 0
                places[:, 0] = swapped
            place = places[rows, k]
            places[rows, k] = places[:, j]
            places[:, j] = place
        np.minimum.at(out, place, value)
        if int(out.max()) < (j + 1) << 32:
            break
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One signed 64-bit key per band of the signature; the band's number is part of it."""
    rows = signature.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        key = mixed(key + rows[:, i] + _GOLDEN)
    return key.view(np.int64)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of two sorted distinct arrays."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    at = np.searchsorted(a, b)
    common = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
    return 100 * common >= percent * (len(a) + len(b) - common)
