"""Word shingles as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers that keep the places of a shingle's words apart.
_PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def words(text: bytes | None) -> list[bytes]:
    r"""The words `[^\x20\x09-\x0D]+` of a UTF-8 text, A-Z lower-cased: what bytes.split() cuts."""
    return text.lower().split() if text else []


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """The sorted distinct hashes of the text's k-word shingles.

    With fewer than k words, but not none, the whole sequence is the only shingle; without words
    the set is empty. Two different shingles share a hash with probability 2**-64.
    """
    found = words(text)
    if not found:
        return np.empty(0, np.uint64)
    if len(found) < k:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(found), seed=len(found))], dtype=np.uint64)
    each = np.array(list(map(xxhash.xxh3_64_intdigest, found)), dtype=np.uint64)
    n = len(each) - k + 1
    total = each[:n] * _PLACES[0]
    for i in range(1, k):
        total ^= each[i : i + n] * _PLACES[i]
        total *= _MIX
        total ^= total >> np.uint64(31)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def set_digest(shingles: np.ndarray) -> int:
    """A signed 64-bit name for the set."""
    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles)) - (1 << 63)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """The size of the intersection of two sorted arrays without repeats."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
