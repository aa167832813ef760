"""Words of UTF-8 texts as 64-bit hashes, whole slices of texts at a time in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .common import slices

_U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_Q = 0xD1342543DE82EF95 | 1
_M64 = (1 << 64) - 1
#: Bytes of text that are hashed together; temporary arrays take about 40 times as much.
SLICE_BYTES = 750_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _class(word) -> np.ndarray:
    return np.array([word(b) for b in range(256)], bool)


#: [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after A-Z became a-z); bytes of longer characters are all in words.
SPACED = _class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
ALNUM = _class(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)

_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 65_536)
        tables = []
        for base in (_P, pow(_P, -1, 1 << 64)):
            t = np.full(size, _U(base))
            t[0] = 1
            tables.append(np.multiply.accumulate(t))
        if size > 4 * SLICE_BYTES:  # of one very long text; not kept
            return tables
        _powers[:] = tables
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> _U(30))
    h *= _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def hash_words(texts: list[bytes], in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of the text) of every word of ``texts``, A-Z taken as a-z."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = in_word[buf]
    edge = np.diff(np.r_[False, inside].view(np.int8))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    up, down = _power_tables(len(buf) + 1)
    total = _LOWER[buf].astype(np.uint64)
    total += _U(1)
    total *= up[: len(buf)]
    total = np.r_[_U(0), np.cumsum(total)]
    h = (total[ends] - total[starts]) * down[starts]
    h = mix(h ^ ((ends - starts).astype(np.uint64) * _U(_Q)))
    first = np.cumsum(np.r_[0, [len(t) + 1 for t in texts]])
    return h, np.searchsorted(first, starts, side="right") - 1


_STEP = [_U(pow(_Q, j + 1, 1 << 64)) for j in range(64)]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on (positions with fewer words left are dropped)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n] * _STEP[0]
    for j in range(1, k):
        g += h[j : j + n] * _STEP[j]
    return mix(g ^ _U(int(k) * 0x632BE59BD9B4E019 & _M64))


def grams_at(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    g = h[at] * _STEP[0]
    for j in range(1, k):
        g += h[at + j] * _STEP[j]
    return mix(g ^ _U(int(k) * 0x632BE59BD9B4E019 & _M64))


def byte_slices(column: pa.Array, limit: int = SLICE_BYTES):
    """(start, texts) of a string column in slices of about ``limit`` bytes; nulls become empty."""
    texts = [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]
    for i, j in slices([len(t) for t in texts], limit):
        yield i, texts[i:j]


_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 57
_SHAPE[128:] = 97


def word_shapes(texts: list[bytes], in_word: np.ndarray) -> np.ndarray:
    """Hash of every word's shape: letters as a or A, digits as 9, signs as they are, each run of one of them once."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    inside = in_word[buf]
    edge = np.diff(np.r_[False, inside].view(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    shape = _SHAPE[buf]
    keep = inside & (np.r_[True, shape[1:] != shape[:-1]] | (edge == 1))
    place = np.r_[0, np.cumsum(keep)]
    shape = shape[keep].astype(np.uint64) + _U(1)
    up, down = _power_tables(len(buf) + 1)
    total = np.r_[_U(0), np.cumsum(shape * up[: len(shape)])]
    starts, ends = place[starts], place[ends]
    return mix((total[ends] - total[starts]) * down[starts])


def span_hashes(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span of the bytes ``low``; equal bytes have equal hashes wherever they stand."""
    up, down = _power_tables(len(low) + 1)
    total = low.astype(np.uint64)
    total += _U(1)
    total *= up[: len(low)]
    total = np.r_[_U(0), np.cumsum(total)]
    return mix((total[ends] - total[starts]) * down[starts] ^ ((ends - starts).astype(np.uint64) * _U(_Q)))
