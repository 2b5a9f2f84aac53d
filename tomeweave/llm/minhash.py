"""Shingle sets and their SuperMinHash signatures (Ertl 2017).

An element of a set carries a random permutation of the registers and a random
number per rank. A register keeps the least ``rank + random`` over the elements that
reach it. The ranks of one element are a permutation, so one element never competes
with itself for a register, which gives estimates of lower variance than independent
hashes. Ranks are visited in rising order for all elements at once; no later rank can
change a signature whose registers are all below it, and the work stops there.
"""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
REGISTERS = 128
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
#: Elements whose permutations are held at once.
_CHUNK = 8192
#: Words that a task remembers; beyond, it starts afresh.
_REMEMBERED = 100_000
_seen: dict[bytes, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def forget() -> None:
    """At a task's end: its process stays, for tasks of other kinds."""
    _seen.clear()


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``words``-word shingles; the whole sequence where it is shorter; none without words.

    A-Z are lower-cased, words end at ASCII blanks.
    """
    parts = (text or "").encode().lower().split()  # bytes.lower() changes A-Z only
    if not parts:
        return np.empty(0, np.uint64)
    if len(_seen) > _REMEMBERED:
        _seen.clear()
    get, hashed = _seen.get, []
    for word in parts:
        h = get(word)
        if h is None:
            h = _seen[word] = xxhash.xxh3_64_intdigest(word)
        hashed.append(h)
    h = np.array(hashed, np.uint64)
    n = min(words, len(parts))
    m = len(parts) - n + 1
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = _mixed(out * _M[k % len(_M)] + h[k : k + m])
    return np.unique(out)


def signature(elements: np.ndarray, registers: int = REGISTERS) -> np.ndarray:
    """The registers, each rank << 56 | random; all ones for the empty set."""
    out = np.full(registers, np.uint64(0xFFFFFFFFFFFFFFFF))
    for begin in range(0, len(elements), _CHUNK):
        part = elements[begin : begin + _CHUNK]
        n = len(part)
        rows = np.arange(n)
        order = np.tile(np.arange(registers, dtype=np.uint8 if registers <= 256 else np.uint16), (n, 1))
        for rank in range(registers):
            if (out >> np.uint64(56)).max() < rank:
                break
            draw = _mixed(part + np.uint64(0x9E3779B97F4A7C15 * (rank + 1) & 0xFFFFFFFFFFFFFFFF))
            at = rank + ((draw >> np.uint64(32)) * np.uint64(registers - rank) >> np.uint64(32)).astype(np.int64)
            register = order[rows, at]
            order[rows, at] = order[:, rank]
            value = (np.uint64(rank) << np.uint64(56)) | (_mixed(draw ^ _M[1]) >> np.uint64(8))
            np.minimum.at(out, register, value)
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Elements in both of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
