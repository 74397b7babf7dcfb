"""Records that differ in formatting only, collapsed into one each with the number of copies.

Three passes, none of which gathers texts:

1. Every task hashes its texts to a canonical bag hash (letter case, white space, order and
   punctuation without meaning have no weight) and writes two Bloom filters, as lists of set
   bits by filter block: hashes it met at least once, and more than once.
2. The filters are merged block by block: a bit is *repeated* if a task saw it repeatedly or
   two tasks saw it. A filter has 16 bits a row and at most ``filter_bits`` (32 MB).
3. Rows whose bits aren't all repeated are singletons and never shuffled. The others, possible
   repeats, are written canonically in full, and only their 128-bit hashes are shuffled and
   grouped exactly.

Where one filter would be too small, hashes are cut into ranges with a filter each. The hashes
alone (8 bytes a row) are written once by range, every range is built and tested against its
own filter, and what remains, the possible repeats' hashes, go into the filter for the texts,
again in as many ranges as it takes. So the rate of singletons taken for possible repeats
stays that of 16 bits a row, however large the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sqlloom.llm.canonical import canonical
from sqlloom.sources.scratch import written

HASHES = 3  # bits a hash sets
BITS_PER_ROW = 16
MAX_FILTER_BITS = 1 << 28
_BLOCK = 16  # a block has 2**16 bits, so that places in it fit two bytes
_CHUNK = 4 << 20  # bytes of text hashed at once


def _weights() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20250106))
    w = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
    w[0x80:] = 0
    for c in b' \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f;()"/':
        w[c] = 0
    w[ord("a") : ord("z") + 1] = w[ord("A") : ord("Z") + 1]
    return w


_WEIGHTS = _weights()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bag_hashes(texts: pa.Array) -> np.ndarray:
    """A hash of each text that all writings of one statement share; that of null is 0."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _CHUNK, "right")) - 1)
        end = min(end, n)
        lo = offsets[start]
        sums = np.zeros(int(offsets[end] - lo) + 1, np.uint64)
        np.cumsum(_WEIGHTS[data[lo : offsets[end]]], out=sums[1:])
        at = offsets[start : end + 1] - lo
        out[start:end] = sums[at[1:]] - sums[at[:-1]]
        start = end
    return _mix(out)


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    """The HASHES filter places of each hash, one row each."""
    step = _mix(h + np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) >> np.uint64(64 - bits) for k in range(HASHES)])


_PARTS = "block int, once binary, rep binary"


def _build(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := [bag_hashes(b.column(0)) for b in batches if len(b)]:
            yield from _parts(np.concatenate(parts), bits)

    return run


def _parts(hashes: np.ndarray, bits: int) -> Iterator[pa.RecordBatch]:
    """The filters of the hashes of one task, by block."""
    seen, count = np.unique(hashes, return_counts=True)
    once, rep = (np.unique(_places(h, bits).ravel()) for h in (seen, seen[count > 1]))
    rows = []
    cuts = np.flatnonzero(np.diff(once >> np.uint64(_BLOCK))) + 1
    for piece in np.split(once, cuts):
        block = int(piece[0]) >> _BLOCK
        lo, hi = np.searchsorted(rep, [np.uint64(block << _BLOCK), np.uint64((block + 1) << _BLOCK)])
        rows.append((block, (piece & np.uint64(0xFFFF)).astype(np.uint16).tobytes(), (rep[lo:hi] & np.uint64(0xFFFF)).astype(np.uint16).tobytes()))
    blocks, a, b = zip(*rows)
    yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["block", "once", "rep"])


def _merge(table: pa.Table) -> pa.Table:
    seen, rep = np.zeros(1 << _BLOCK, np.uint8), np.zeros(1 << _BLOCK, bool)
    for once, again in zip(table.column("once"), table.column("rep")):
        at = np.frombuffer(once.as_py(), np.uint16)
        seen[at] = np.minimum(seen[at] + 1, 2)
        rep[np.frombuffer(again.as_py(), np.uint16)] = True
    rep |= seen > 1
    if not rep.any():
        return pa.table({"block": pa.array([], pa.int32()), "rep": pa.array([], pa.binary())})
    return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "rep": pa.array([np.packbits(rep, bitorder="little").tobytes()], pa.binary())})


def _bits(rows: int, most: int) -> int:
    return max(_BLOCK, min((max(rows, 1) * BITS_PER_ROW - 1).bit_length(), most))


def _merged(made: DataFrame, bits: int) -> np.ndarray:
    """The repeated bits of a filter that tasks have built in parts."""
    whole = np.zeros(1 << (bits - 3), np.uint8)
    size = 1 << (_BLOCK - 3)
    for r in made.groupBy("block").applyInArrow(_merge, "block int, rep binary").toLocalIterator():
        whole[r.block * size : (r.block + 1) * size] = np.frombuffer(r.rep, np.uint8)
    return whole


def _held(whole: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    p = _places(h, bits)
    return ((whole[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _range(h: np.ndarray, ranges: int) -> np.ndarray:
    """The range of each hash, by other bits than those of the places."""
    return (_mix(h ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(ranges)).astype(np.int32)


def _hashes(ranges: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = bag_hashes(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(_range(h, ranges))], ["h", "range"])

    return run


def _from_hashes(make: Callable[[np.ndarray], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts := [b.column(0).to_numpy().view(np.uint64) for b in batches if len(b)]:
            yield from make(np.concatenate(parts))

    return run


def filters(texts: DataFrame, filter_bits: int) -> list[tuple[np.ndarray, int]]:
    """The filters of possible repeats among ``texts`` (one column), one for each range of hashes, with their sizes in bits."""
    most = filter_bits.bit_length() - 1
    rows = texts.count()
    if rows * BITS_PER_ROW <= filter_bits:
        bits = _bits(rows, most)
        return [(_merged(texts.mapInArrow(_build(bits), _PARTS), bits), bits)]
    ranges = -(-rows * BITS_PER_ROW // filter_bits)
    spark = texts.sparkSession
    hashes = written(texts.mapInArrow(_hashes(ranges), "h long, range int"), "range")
    kept = []
    for k in range(ranges):
        mine = hashes.where(F.col("range") == k).select("h")
        shared = spark.sparkContext.broadcast(_merged(mine.mapInArrow(_from_hashes(lambda h: _parts(h, most)), _PARTS), most))

        def test(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column(0).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[_held(shared.value, h, most)]).view(np.int64))], ["h"])

        kept.append(written(mine.mapInArrow(test, "h long").dropDuplicates(["h"])))
    again = reduce(DataFrame.unionByName, kept)
    ranges = max(1, -(-again.count() * BITS_PER_ROW // filter_bits))

    def group(h: np.ndarray) -> Iterator[pa.RecordBatch]:
        # Both bits of every hash are set: all of these are repeated.
        yield from _parts(np.repeat(h, 2), most)

    out = []
    for k in range(ranges):

        def mine(batches: Iterator[pa.RecordBatch], k=k) -> Iterator[pa.RecordBatch]:
            for b in batches:
                h = b.column(0).to_numpy().view(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(h[_range(h, ranges) == k].view(np.int64))], ["h"])

        part = again.mapInArrow(mine, "h long") if ranges > 1 else again
        out.append((_merged(part.mapInArrow(_from_hashes(group), _PARTS), most), most))
    return out


def sieve(df: DataFrame, key: str, text: str, filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``key`` and ``hash``: the canonical hash of possible repeats, null for certain singletons.

    Rows with null, blank or merely punctuating text are left out.
    """
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    ranges = filters(rows.select("text"), filter_bits)

    def one(k: int) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(ranges[k])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            repeated, bits = shared.value
            for b in batches:
                h = bag_hashes(b.column(1))
                if len(ranges) > 1:
                    mine = _range(h, len(ranges)) == k
                    b, h = b.filter(pa.array(mine)), h[mine]
                maybe = _held(repeated, h, bits)
                keys, texts, out = b.column(0), b.column(1), [None] * len(h)
                drop = np.zeros(len(h), bool)
                for i in np.flatnonzero(maybe):
                    form = canonical(texts[int(i)].as_py())
                    if form is None:
                        drop[i] = True
                    else:
                        out[i] = hashlib.blake2b(form.encode("utf-8", "surrogatepass"), digest_size=16).digest()
                for i in np.flatnonzero(~maybe):
                    if (t := texts[int(i)]).as_py().isspace() or not t.as_py():
                        drop[i] = True
                keep = pa.array(~drop)
                yield pa.RecordBatch.from_arrays([keys.filter(keep), pa.array(out, pa.binary()).filter(keep)], ["key", "hash"])

        return rows.mapInArrow(run, "key long, hash binary")

    return written(reduce(DataFrame.unionByName, map(one, range(len(ranges)))))


HOT = 1000  # a hash with more than one of so many possible repeats is hot; there are fewer than that


def members(df: DataFrame, key: str, text: str, filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """``keep_id`` and ``member_id`` for every member of a set of copies but the one with the smallest key.

    Equal keys count once. Null and blank texts are in no set; an empty table gives no rows.
    The sets are formed by a pre-aggregated minimum for each hash; no set is gathered in one task.
    Members of hot hashes find their set by a broadcast of those, which are fewer than ``HOT``.
    """
    rows = written(sieve(df, key, text, filter_bits).where("hash IS NOT NULL").dropDuplicates(["key", "hash"]))
    total = rows.count()
    keep = written(rows.groupBy("hash").agg(F.min("key").alias("keep_id"), F.count("*").alias("n")).where("n > 1"))
    hot = F.broadcast(keep.where(F.col("n") * HOT > total).select("hash", "keep_id"))
    cold = keep.where(F.col("n") * HOT <= total).select("hash", "keep_id")
    both = rows.join(hot, "hash").unionByName(rows.join(hot.select("hash"), "hash", "left_anti").join(cold, "hash"))
    return both.where("key <> keep_id").select("keep_id", F.col("key").alias("member_id"))


def collapsed(df: DataFrame, key: str, text: str, filter_bits: int = MAX_FILTER_BITS) -> DataFrame:
    """One row for each different record: the smallest key as ``keep_id``, and ``copies``, the number of different keys."""
    rows = sieve(df, key, text, filter_bits)
    many = rows.where("hash IS NOT NULL").dropDuplicates(["key", "hash"]).groupBy("hash").agg(F.min("key").alias("keep_id"), F.count("*").alias("copies")).drop("hash")
    return many.unionByName(rows.where("hash IS NULL").select(F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("copies")))
