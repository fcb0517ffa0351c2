"""Helpers of several operators: Arrow streams, groups of sorted rows, word rules."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import groupby
from operator import itemgetter
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of one key that a task may take before the key is dealt out (see ``operators.joins``).
HOT_ROWS = 2000
# Bits of a bit set: 64 for each entry within these bounds (the most: 32 MB), in buckets of Spark's bitmap functions.
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 28
BUCKET = 1 << 15
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def texts_of(column: pa.Array) -> list[str]:
    """Python strings of an Arrow column, a missing text being empty."""
    return [t or "" for t in column.to_pylist()]


def texts_in_turn(column: pa.Array, rows: int = 256) -> Iterator[str]:
    """``texts_of``, some rows at a time: no second copy of a batch as Python strings."""
    for at in range(0, len(column), rows):
        yield from texts_of(column.slice(at, rows))


def table_of(names: Sequence[str], types: Sequence[pa.DataType], columns: Sequence) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], list(names))


def sorted_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[tuple, list[dict]]]:
    """The groups of a stream of rows sorted by ``keys``; one group is in memory at a time."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for key, group in groupby(rows, key=itemgetter(*keys)):
        yield (key if len(keys) > 1 else (key,)), list(group)


def grouped(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bring the rows of each key into one task, sorted, for ``sorted_groups``."""
    return df.repartition(*keys).sortWithinPartitions(*keys)


def text_key(text: str = "text") -> list:
    """Two 64-bit hashes that stand for a whole text (missing: empty)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(whole).alias("t1"), F.xxhash64(F.lit("second"), whole).alias("t2")]


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened where a column of ``df`` has them (whatever the case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def mixed(key: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The key of a sequence of names from that of its prefix (zeros: none) and the next name."""
    h = (key ^ names) * _K1
    h = (h ^ (h >> np.uint64(31))) * _K2
    return h ^ (h >> np.uint64(29))


class BitSet:
    """A set of keys of bounded size; it may hold others by chance, so an exact step has to follow."""

    def __init__(self, made: tuple[int, dict[int, bytes]]):
        bits, buckets = made
        self.mask = np.uint64(bits - 1)
        self.bits = np.zeros(bits // 8, np.uint8)
        size = BUCKET // 8
        for b, data in buckets.items():
            self.bits[b * size:(b + 1) * size] = np.frombuffer(data, np.uint8)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bit_set(names: DataFrame) -> tuple[int, dict[int, bytes]]:
    """The bit set of the sequences in the only column (``array<bigint>``): its size and its buckets, at most ``MOST_BITS`` bits in all."""
    bits_ = min(max(1 << (64 * names.count()).bit_length(), LEAST_BITS), MOST_BITS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.zeros(bits_ // 8, np.uint8)
        for batch in batches:
            column = batch.column(0)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            values = column.flatten().to_numpy().view(np.uint64)
            starts = np.cumsum(sizes) - sizes
            key = np.zeros(len(sizes), np.uint64)
            for i in range(int(sizes.max(initial=0))):
                on = np.flatnonzero(sizes > i)
                key[on] = mixed(key[on], values[starts[on] + i])
            at = key & np.uint64(bits_ - 1)
            np.bitwise_or.at(packed, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
        packed = packed.reshape(-1, BUCKET // 8)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([packed[b].tobytes() for b in some.tolist()], pa.binary())],
                                         ["bucket", "bits"])

    rows = names.mapInArrow(work, "bucket int, bits binary").groupBy("bucket").agg(F.expr("bitmap_or_agg(bits)").alias("bits"))
    return bits_, {r.bucket: bytes(r.bits) for r in rows.collect()}


def importable(spark: SparkSession) -> None:
    """Let Python workers import the library from where the driver has it, if it is not installed.

    On a cluster without a common path for it, ship the package with ``--py-files`` instead.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if root not in paths:
        env["PYTHONPATH"] = ":".join([root, *filter(None, paths)])
