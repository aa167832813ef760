"""Operator 4: token counts by rank-synchronous merging of ragged arrays.

Texts are split into pre-tokens by the library's pattern. Pre-tokens not seen before are held together as one ragged
numpy array of symbols; in every round each sequence finds its pair of lowest rank and all its occurrences are merged
at once, for all sequences simultaneously, until no pair has a rank. What survives is the count. A pair made by a merge
ranks after that merge, so taking all occurrences of the lowest pair at once gives what one merge at a time gives.

A pre-token over LONG_BYTES may need as many rounds as it has symbols, so it is merged on its own, by a heap that holds
its ranked pairs; no length makes a round dear for the others.

Counts of short pre-tokens are kept per worker in a table of bounded size, so frequent ones are merged once.

Defined results: null and empty texts have no tokens and no bytes. Special strings inside a text count as the library's
default has it: one token each. Nothing is truncated.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table

#: Vocabulary of the query; resolved on the executors, so only its name travels.
VOCABULARY = "byte_bpe_50k.json"
#: The library's pattern for byte-level pre-tokens (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most pre-tokens whose counts a worker keeps, and the longest that it keeps.
KEPT, KEPT_CHARS = 400_000, 64
#: Characters of text that are taken together, and bytes of symbols that are merged together.
SLICE_CHARS, MERGE_BYTES = 4_000_000, 2_000_000
#: Bytes of a pre-token beyond which it is merged on its own: rounds grow with a sequence's length.
LONG_BYTES = 512
_NONE = np.iinfo(np.int64).max


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """Merge ranks of a byte-level vocabulary file, as sorted arrays of pairs."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        chars = _byte_chars()
        self.first = np.zeros(256, np.int64)
        for c, b in chars.items():
            self.first[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        pair = left << 32 | right
        order = np.argsort(pair, kind="stable")
        self.pairs, self.ranks, self.made = pair[order], order.astype(np.int64), made[order]
        self.table = None
        self.special = [t["content"] for t in spec.get("added_tokens", []) if t.get("special")]

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """Surviving symbols of each pre-token."""
        out = np.zeros(len(tokens), np.int64)
        short = [k for k, t in enumerate(tokens) if len(t) <= LONG_BYTES]
        for a, b in slices([len(tokens[k]) for k in short], MERGE_BYTES):
            out[short[a:b]] = self._count([tokens[k] for k in short[a:b]])
        for k, t in enumerate(tokens):
            if len(t) > LONG_BYTES:
                out[k] = self.count_long(t)
        return out

    def count_long(self, token: bytes) -> int:
        """One long pre-token: a heap of ranked pairs, and links to the next living symbol, so that a merge touches its
        neighbours alone. The same merges in the same order, without walking the whole array in every round."""
        table = self._table()
        ids = self.first[np.frombuffer(token, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(table[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in table]
        heapq.heapify(heap)
        count = n
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i] if ids[i] >= 0 else -1
            found = table.get((ids[i], ids[j])) if j >= 0 else None
            if found is None or found[0] != rank:  # one of the two has been merged meanwhile
                continue
            ids[i], ids[j] = found[1], -1
            count -= 1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if after := table.get((ids[i], ids[k])):
                    heapq.heappush(heap, (after[0], i))
            h = left[i]
            if h >= 0 and (before := table.get((ids[h], ids[i]))):
                heapq.heappush(heap, (before[0], h))
        return count

    def _table(self) -> dict[tuple[int, int], tuple[int, int]]:
        if self.table is None:
            pairs = zip((self.pairs >> 32).tolist(), (self.pairs & 0xFFFFFFFF).tolist(), strict=True)
            self.table = dict(zip(pairs, zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        return self.table

    def _count(self, tokens: list[bytes]) -> np.ndarray:
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        out = sizes.copy()
        ids = self.first[np.frombuffer(b"".join(tokens), np.uint8)]
        row = np.repeat(np.arange(len(tokens)), sizes)
        while len(ids) > 1:
            key = ids[:-1] << 32 | ids[1:]
            at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            known = (self.pairs[at] == key) & (row[:-1] == row[1:])
            rank = np.where(known, self.ranks[at], _NONE)
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            best = np.minimum.reduceat(np.r_[rank, _NONE], starts)
            live = best != _NONE
            if not live.any():
                break
            length = np.diff(np.r_[starts, len(ids)])
            hit = known & (rank == np.repeat(best, length)[:-1])
            where = np.flatnonzero(hit)
            # A run of overlapping occurrences ("aaa") is merged from its left: every other one counts.
            fresh = np.r_[True, np.diff(where) > 1]
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
            where = where[(np.arange(len(where)) - run) % 2 == 0]
            ids[where] = self.made[at[where]]
            keep = np.ones(len(ids), bool)
            keep[where + 1] = False
            done = ~np.repeat(live, length)  # sequences without a ranked pair leave the array
            np.subtract.at(out, row[where], 1)
            keep &= ~done
            ids, row = ids[keep], row[keep]
        return out


class Counter:
    """Counts tokens of texts; keeps the counts of frequent pre-tokens."""

    def __init__(self, path: str):
        import regex

        self.merger = Merger(path)
        self.find = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(self.merger.special, key=len, reverse=True)))) if self.merger.special else None
        self.kept: dict[str, int] = {}

    def __call__(self, texts: list[str]) -> list[int]:
        parts, extra = [], []
        for t in texts:
            pieces = self.special.split(t) if self.special else [t]
            extra.append(len(pieces) - 1)
            parts.append([x for p in pieces for x in self.find(p)])
        seen = set().union(*parts)
        if len(self.kept) + len(seen) > KEPT:
            self.kept.clear()
        fresh = [t for t in seen if t not in self.kept]
        made = dict(zip(fresh, self.merger.count([t.encode() for t in fresh]).tolist(), strict=True))
        self.kept.update(made)
        get = self.kept.__getitem__
        counts = [sum(map(get, p)) + e for p, e in zip(parts, extra, strict=True)]
        for t in fresh:
            if len(t) > KEPT_CHARS:
                del self.kept[t]
        return counts


_COUNTERS: dict[str, Counter] = {}


def vocabulary_path(name: str) -> str:
    """The place of a vocabulary file on this machine; an absolute path stands for itself."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, *, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """key, n_bytes (UTF-8), n_tokens of every whole text, in one pass without a shuffle."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(vocabulary) or _COUNTERS.setdefault(vocabulary, Counter(vocabulary_path(vocabulary)))
        for b in batches:
            texts = b.column(1).to_pylist()
            texts = ["" if t is None else t for t in texts]
            tokens = []
            for i, j in slices([len(t) for t in texts], SLICE_CHARS):
                tokens += counter(texts[i:j])
            sizes = [len(t.encode()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64())], names=[key, "n_bytes", "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint")


def query(spark: SparkSession, sf_dir: str, limit: int = 512) -> DataFrame:
    out = count_tokens(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n_bytes", "n_tokens", f"n_tokens > {limit} as over_limit")


SQL = None  # merges of byte pairs have no SQL form; tests hold the counts against the library's own
