"""Keys of 64-bit fingerprints from the binary (23, 12) Golay code."""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH = 23
#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the code.
GENERATOR = 0b110001110101
#: Where the segments of a fingerprint begin, and their lengths. The last is filled with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))


def _remainder(word: int) -> int:
    for bit in range(LENGTH - 1, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Remainder of every single bit; the error pattern of weight 3 or less of every remainder."""
    single = np.array([_remainder(1 << b) for b in range(LENGTH)], np.int64)
    errors = np.zeros(1 << 11, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(LENGTH), weight):
            errors[np.bitwise_xor.reduce(single[list(bits)])] = sum(1 << b for b in bits)
    return single, errors


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit number of the nearest codeword; every word is within 3 bits of exactly one."""
    single, errors = _tables()
    remainder = np.zeros(len(words), np.int64)
    for b in range(LENGTH):
        remainder ^= np.where(words >> b & 1, single[b], 0)
    return (words ^ errors[remainder]) >> 11


def nearby(words: np.ndarray) -> list[np.ndarray]:
    """Columns of codeword numbers, -1 where fewer: the nearest of a word and of its 23 neighbours.

    Two words that differ in at most 2 bits share one: some word is within 1 bit of both. A word
    has 1 number or, if 3 bits from its codeword, 6.
    """
    own = decode(words)
    found = np.stack([own] + [decode(words ^ (1 << b)) for b in range(LENGTH)], axis=1)
    found.sort(axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    columns = [np.full(len(words), -1, np.int64) for _ in range(6)]
    place = np.cumsum(fresh, axis=1) - 1
    for j in range(6):
        rows, at = np.nonzero(fresh & (place == j))
        columns[j][rows] = found[rows, at]
    return columns


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of uint64 fingerprints, and the place of the fingerprint that each belongs to.

    Two fingerprints that differ in at most 4 bits share a key. Their errors fall on three
    segments. If no segment has more than 2, all three share a codeword number each: a key is
    three numbers, 36 bits. Else one segment has 3 or 4 and the two others at most one in all: of
    these, one is equal and the other shares a number: a key is the equal segment and the number,
    30 or 35 bits.
    """
    parts = [((fingerprints >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    numbers = [nearby(p) for p in parts]
    out, owner, everyone = [], [], np.arange(len(fingerprints))

    def add(key: np.ndarray, right: np.ndarray, kind: int) -> None:
        out.append((key[right] | (kind << 40)))
        owner.append(everyone[right])

    for a in numbers[0]:
        for b in numbers[1]:
            pair, right = a << 24 | b << 12, (a >= 0) & (b >= 0)
            for c in numbers[2]:
                add(pair | c, right & (c >= 0), 0)
    kind = 1
    for equal in range(3):
        for shared in range(3):
            if equal == shared:
                continue
            for number in numbers[shared]:
                add(parts[equal] << 12 | number, number >= 0, kind)
            kind += 1
    return np.concatenate(out), np.concatenate(owner)
