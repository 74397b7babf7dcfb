"""Rows delivered more than once, and rows with a partner elsewhere, told apart without a shuffle of the rest.

Long texts should not be shuffled to drop one row in seventy. Hashes of the keys alone are
counted; those that matter go into a Bloom filter of bounded size, and only rows that hit it
are shuffled. What the filter lets through by mistake is sorted out there, so results are exact
however full it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlloom.sources.scratch import written

FILTER_BITS = 1 << 28  # 32 MB: 16 bits each for 16 million keys; with more it lets more rows through
_BLOCK = 16
_HASHES = 3


def _places(h: np.ndarray, bits: int) -> np.ndarray:
    h = h.view(np.uint64)
    step = ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return np.stack([(h + np.uint64(k) * step) >> np.uint64(64 - bits) for k in range(_HASHES)])


def _build(hashes: DataFrame, filter_bits: int) -> tuple[np.ndarray, int]:
    """A filter that holds a one-column table of 64-bit hashes."""
    n = hashes.count()
    bits = max(_BLOCK, min((max(n, 1) * 16 - 1).bit_length(), filter_bits.bit_length() - 1))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(_places(b.column(0).to_numpy(), bits).ravel())
            if len(at):
                block = (at >> np.uint64(_BLOCK)).astype(np.int32)
                cuts = np.flatnonzero(np.diff(block)) + 1
                places = [p.astype(np.uint16).tobytes() for p in np.split(at & np.uint64(0xFFFF), cuts)]
                yield pa.RecordBatch.from_arrays([pa.array(block[np.r_[0, cuts]]), pa.array(places, pa.binary())], ["block", "places"])

    def merge(t: pa.Table) -> pa.Table:
        on = np.zeros(1 << _BLOCK, bool)
        for p in t.column("places"):
            on[np.frombuffer(p.as_py(), np.uint16)] = True
        return pa.table({"block": t.column("block")[:1], "bits": pa.array([np.packbits(on, bitorder="little").tobytes()], pa.binary())})

    whole, size = np.zeros(1 << (bits - 3), np.uint8), 1 << (_BLOCK - 3)
    for r in hashes.mapInArrow(parts, "block int, places binary").groupBy("block").applyInArrow(merge, "block int, bits binary").toLocalIterator():
        whole[r.block * size : (r.block + 1) * size] = np.frombuffer(r.bits, np.uint8)
    return whole, bits


def _maybe(spark, hashes: DataFrame, filter_bits: int):
    shared = spark.sparkContext.broadcast(_build(hashes, filter_bits))

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        whole, bits = shared.value
        p = _places(h.to_numpy(np.int64), bits)
        return pd.Series(((whole[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0))

    return held


def split(df: DataFrame, key: str, hashes: DataFrame, filter_bits: int = FILTER_BITS) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is certainly not among those hashed, the others). ``hashes``: ``key_hash`` of keys, see there."""
    held = _maybe(df.sparkSession, hashes, filter_bits)
    flagged = df.withColumn("_maybe", held(key_hash(key)))
    return flagged.where("NOT _maybe").drop("_maybe"), flagged.where("_maybe").drop("_maybe")


def key_hash(key: str) -> Column:
    return F.coalesce(F.xxhash64(F.lit(11), F.col(key)), F.lit(0).cast("long"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Hashes of the keys that occur more than once."""
    return df.select(key_hash(key).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")


def first_of(df: DataFrame, key: str) -> DataFrame:
    """One row for each key: the least one by the other columns in their order. Shuffles all columns."""
    others = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*others)).alias("_first")).select(*(F.col(c) if c == key else F.col(f"_first.{c}").alias(c) for c in df.columns))


def once(df: DataFrame, key: str, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row for each key; of several the least by the other columns, compared in their order.

    Rows with null keys count as one key. An empty table gives none. Columns must be orderable.
    """
    again = written(repeated(df, key))
    if again.isEmpty():
        return df
    alone, maybe = split(df, key, again, filter_bits)
    return alone.unionByName(first_of(maybe, key))
