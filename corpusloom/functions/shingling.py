"""Shingles of lower-cased texts as 64-bit hashes, whole slices of texts at a time in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_P, _Q = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_M64 = (1 << 64) - 1
#: Bytes of text that are hashed together.
SLICE_BYTES = 1_000_000

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True

_powers: list[np.ndarray] = []


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of an odd number and of its inverse."""
    if _powers and len(_powers[0]) >= n:
        return _powers
    tables = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        t = np.full(max(n, SLICE_BYTES), _U(base))
        t[0] = 1
        tables.append(np.multiply.accumulate(t))
    if n <= 2 * SLICE_BYTES:  # those of one very long text are not kept
        _powers[:] = tables
    return tables


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every run of a-z and 0-9."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.diff(np.r_[False, _WORD[buf]].view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(buf))
    total = np.r_[_U(0), np.cumsum((buf.astype(np.uint64) + _U(1)) * up[: len(buf)])]
    h = _mix((total[ends] - total[starts]) * down[starts] ^ ((ends - starts).astype(np.uint64) * _U(_Q)))
    first = np.cumsum([0, *[len(t) + 1 for t in texts]])
    return h, np.searchsorted(first, starts, side="right") - 1


def _runs(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each word on that has so many."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g += h[j : j + n] * _U(pow(_Q, j + 1, 1 << 64))
    return _mix(g ^ _U(k * 0x632BE59BD9B4E019 & _M64))


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends): the sorted distinct hashes of k words of each text, one text's after the other's; all words are one
    shingle where there are fewer, and a text without words has none."""
    h, of = _words(texts)
    g = _runs(h, k)
    whole = of[: len(g)] == of[k - 1 :] if len(g) else np.zeros(0, bool)
    g, owner = g[whole], of[: len(whole)][whole]
    first = np.searchsorted(of, np.arange(len(texts) + 1))
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < k))
    if len(short):
        g = np.r_[g, np.concatenate([_runs(h[first[i] : first[i + 1]], int(first[i + 1] - first[i])) for i in short])]
        owner = np.r_[owner, short]
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    if len(g):
        fresh = np.r_[True, (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])]
        g, owner = g[fresh], owner[fresh]
    return g, np.searchsorted(owner, np.arange(len(texts)), side="right")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(start, texts) of a string column in slices of about ``limit`` bytes; nulls are empty."""
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if texts:
        yield at, texts[at:]
