"""Byte-level BPE of a whole corpus with numpy.

Texts are cut into words by the tokenizer's pattern; every different word of a batch is
encoded once. Words are bucketed by length into padded matrices of symbols. In every round
each row merges its leftmost pair of least rank: pairs are looked up in a hash table of all
pairs that form a token, only the two pairs beside a merge anew, merged rows are compacted by
one place, and finished rows leave the matrix.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FOLDER = "/opt/tokenizers"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NONE = np.int32(2**31 - 1)
_TABLE_BITS = 20
_LONG = 512  # bytes; longer words are merged with a heap, for a matrix would take quadratic time
_KEPT = 300_000  # words a worker remembers


class Vocabulary:
    """Symbols of single bytes and the hash table of pairs: arrays that a broadcast carries."""

    def __init__(self, ranks: dict[bytes, int]):
        self.first = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.keys = np.full(1 << _TABLE_BITS, -1, np.int64)
        self.ranks = np.full(1 << _TABLE_BITS, NONE, np.int32)
        self.probes = 1
        left = np.array([a << 32 | b for a, b in pairs], np.int64)
        value = np.array(list(pairs.values()), np.int32)
        step = 0
        while len(left):  # linear probing, all open keys at once
            at = (self._slot(left) + step) & ((1 << _TABLE_BITS) - 1)
            free = self.keys[at] == -1
            self.keys[at[free]] = left[free]  # of keys that meet the last one stays
            won = self.keys[at] == left
            self.ranks[at[won]] = value[won]
            left, value = left[~won], value[~won]
            step += 1
        self.probes = step

    @staticmethod
    def _slot(key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it forms no token (also for padding, symbol -1)."""
        key = (a.astype(np.int64) << 32) | b.astype(np.int64)
        out = np.full(key.shape, NONE, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        at = self._slot(key.ravel()[open_])
        flat, keys = out.ravel(), key.ravel()[open_]
        for _ in range(self.probes):
            there = self.keys[at]
            hit = there == keys
            flat[open_[hit]] = self.ranks[at[hit]]
            go = ~hit & (there != -1)
            if not go.any():
                break
            open_, keys, at = open_[go], keys[go], (at[go] + 1) & ((1 << _TABLE_BITS) - 1)
        return flat.reshape(key.shape)


def load(folder: str = FOLDER, name: str = "byte_bpe_50k.tiktoken") -> Vocabulary:
    with open(os.path.join(folder, name), "rb") as f:
        return Vocabulary({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})


def _matrix(v: Vocabulary, words: list[bytes], width: int) -> list[np.ndarray]:
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    data = np.frombuffer(b"".join(words), np.uint8)
    ids = np.full((n, width), -1, np.int32)
    ids[np.arange(width) < lengths[:, None]] = v.first[data]
    out: list[np.ndarray | None] = [None] * n
    rows = np.arange(n)
    rank = v.lookup(ids[:, :-1], ids[:, 1:])
    while len(rows):
        at = rank.argmin(axis=1)  # the leftmost of the least
        r = np.arange(len(rows))
        best = rank[r, at]
        done = best == NONE
        if done.any():
            for i in np.flatnonzero(done):
                out[rows[i]] = ids[i][ids[i] >= 0]
            keep = ~done
            rows, ids, rank, at, best = rows[keep], ids[keep], rank[keep], at[keep], best[keep]
            if not len(rows):
                break
            r = np.arange(len(rows))
        ids[r, at] = best
        # Close the gap behind each merge.
        columns = np.arange(ids.shape[1] - 1)
        source = columns + (columns > at[:, None])
        ids = np.take_along_axis(ids, source, axis=1)
        if ids.shape[1] == 1:
            for i, row in zip(rows, ids):
                out[i] = row[row >= 0]
            break
        rank = np.take_along_axis(rank, source[:, :-1], axis=1)
        for d in (-1, 0):
            k = at + d
            ok = (k >= 0) & (k < rank.shape[1])
            rank[r[ok], k[ok]] = v.lookup(ids[r[ok], k[ok]], ids[r[ok], k[ok] + 1])
        widest = int((ids >= 0).sum(axis=1).max())
        if widest < ids.shape[1]:
            ids, rank = ids[:, :widest], rank[:, : widest - 1]
            if widest == 1:
                for i, row in zip(rows, ids):
                    out[i] = row
                break
    return out  # type: ignore[return-value]


def _heap(v: Vocabulary, word: bytes) -> np.ndarray:
    """The same merges for one very long word in n log n."""
    ids = v.first[np.frombuffer(word, np.uint8)].tolist()
    n = len(ids)
    after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
    ranks = v.lookup(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
    heap = [(int(ranks[i]), i, ids[i], ids[i + 1]) for i in np.flatnonzero(ranks != NONE).tolist()]
    heapq.heapify(heap)

    def push(i: int) -> None:
        j = after[i]
        if j >= 0:
            found = int(v.lookup(np.array([ids[i]], np.int32), np.array([ids[j]], np.int32))[0])
            if found != NONE:
                heapq.heappush(heap, (found, i, ids[i], ids[j]))

    while heap:
        rank, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j < 0 or ids[j] != b:
            continue
        ids[i], ids[j] = rank, -1
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return np.array([x for x in ids if x >= 0], np.int32)


def encode_words(v: Vocabulary, words: list[bytes]) -> list[np.ndarray]:
    out: list[np.ndarray | None] = [None] * len(words)
    buckets: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) == 1:
            out[i] = v.first[[w[0]]]
        elif len(w) > _LONG:
            out[i] = _heap(v, w)
        else:
            buckets.setdefault(next(b for b in (2, 3, 4, 5, 6, 7, 8, 10, 12, 16, 24, 32, 48, 64, 96, 128, 256, 512) if b >= len(w)), []).append(i)
    for width, at in buckets.items():
        step = max(1, (1 << 20) // width)
        for s in range(0, len(at), step):
            part = at[s : s + step]
            for i, ids in zip(part, _matrix(v, [words[i] for i in part], width)):
                out[i] = ids
    return out  # type: ignore[return-value]


class Encoder:
    def __init__(self, v: Vocabulary):
        import regex

        self.v, self.cut, self.known = v, regex.compile(PATTERN).findall, {}

    def batch(self, texts: list[str | None]) -> list[list[list[int]]]:
        """The ids of each text, by word."""
        cut = [self.cut(t) if t else [] for t in texts]
        new = list({w for words in cut for w in words if w not in self.known})
        if len(self.known) + len(new) > _KEPT:
            self.known, new = {}, list({w for words in cut for w in words})
        for w, ids in zip(new, encode_words(self.v, [w.encode("utf-8", "replace") for w in new])):
            self.known[w] = ids.tolist()
        return [[self.known[w] for w in words] for words in cut]


def _texts(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows with at most some MB of text."""
    values = b.column(at).to_pylist()
    start = size = 0
    for i, t in enumerate(values):
        size += len(t) if t else 0
        if size > 4 << 20:
            yield start, values[start : i + 1]
            start, size = i + 1, 0
    if start < len(values):
        yield start, values[start:]


def token_ids(df: DataFrame, key: str, text: str, v: Vocabulary) -> DataFrame:
    """``key`` and ``ids`` of every row; null and empty texts have an empty list."""
    shared = df.sparkSession.sparkContext.broadcast(v)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for b in batches:
            for start, texts in _texts(b, 1):
                docs = e.batch(texts)
                lengths = [sum(map(len, words)) for words in docs]
                offsets = np.zeros(len(docs) + 1, np.int32)
                np.cumsum(lengths, out=offsets[1:])
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(docs)), np.int32, int(offsets[-1]))
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), ids], [key, "ids"])

    return df.select(F.col(key).cast("long").alias(key), F.col(text)).mapInArrow(run, f"`{key}` long, ids array<int>")


def token_counts(df: DataFrame, keys: list[str], text: str, v: Vocabulary) -> DataFrame:
    """``keys`` and ``n_tokens`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(v)
    rows = df.select(*keys, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = Encoder(shared.value)
        for b in batches:
            counts = [sum(map(len, words)) for _, texts in _texts(b, len(keys)) for words in e.batch(texts)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keys))), pa.array(counts, pa.int64())], [*keys, "n_tokens"])

    return rows.mapInArrow(run, rows.drop("_text").schema.add("n_tokens", "long"))
