"""Token ids in ORC files.

Documents are range-partitioned and sorted by id, so each file holds one range of ids and
the files follow each other. ORC stores the integers run-length encoded in stripes of
bounded size, with row indexes (least and largest id per stride) and Bloom filters on the
document ids: readers take the stripes in parallel and skip those that cannot hold an id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crosstie.llm.common import texts_in_turn
from crosstie.llm.tokens import encoder
from crosstie.session import scratch_path

END_ID = 0
STRIPE_BYTES = 16 << 20
STRIDE_ROWS = 1000
# Text of one range of ids, and so of one file.
RANGE_BYTES = 128 << 20
# Most files whose bases are sent to every task.
MOST_FILES = 1_000_000


def n_ranges(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> int:
    """Ranges of ids, so that their number grows with the texts (at least the shuffle partitions).

    The texts' bytes are counted in a pass of their own, which returns one row.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // range_bytes))


def tokenized(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
              range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``doc_id``, ``at`` (tokens of its partition before it), ``n_tokens``, ``ids``; sorted by id, files in order."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "at", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at, end = encoder(vocabulary, True), 0, end_id.to_bytes(4, "little")
        for batch in batches:
            raw = [coder.encode(t) + end for t in texts_in_turn(batch.column(1))]
            sizes = np.array([len(r) // 4 for r in raw], np.int64)
            ends = np.cumsum(sizes)
            ids = pa.Array.from_buffers(pa.int32(), int(sizes.sum()), [None, pa.py_buffer(b"".join(raw))])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at + ends - sizes), pa.array(sizes), lists], names)
            at += int(sizes.sum())

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    # Rows of one id are dealt by a hash, as the bounds of the ranges must not hold texts.
    return (rows.withColumn("hash", F.xxhash64("text")).repartitionByRange(n_ranges(rows, range_bytes), "doc_id", "hash")
            .sortWithinPartitions("doc_id", "hash", "text").drop("hash")
            .mapInArrow(run, f"doc_id {kind}, at bigint, n_tokens bigint, ids array<int>"))


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text",
                      end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES, stride_rows: int = STRIDE_ROWS) -> None:
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    # A range is one file whatever the session's limit: places count through the whole range.
    (tokenized(docs, vocabulary, doc_id, text, end_id).write.option("maxRecordsPerFile", 0)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.stripe.size", str(stripe_bytes)).option("orc.row.index.stride", str(stride_rows))
     .option("orc.create.index", "true").orc(path))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (tokens of all documents before it), ``n_tokens``, ``ids``.

    The base of each file comes from the narrow number column of all files; there is one row
    per file in the running sum. Up to ``MOST_FILES`` bases, which are counted first, are sent
    to the tasks, so that no ids are shuffled; a larger list is joined.
    """
    rows = spark.read.orc(path).withColumn("file", F.col("_metadata.file_name"))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    # Part numbers of more than five digits are longer names.
    before = Window.orderBy(F.length("file"), "file").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    if totals.count() <= MOST_FILES:
        bases = F.broadcast(bases)
    return rows.join(bases, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_documents(spark: SparkSession, path: str, ids: Sequence[int]) -> DataFrame:
    """Tokens of a few documents; row indexes and Bloom filters let the reader skip the other strides."""
    return spark.read.orc(path).where(F.col("doc_id").isin(list(ids))).select("doc_id", "n_tokens", "ids")


def digests(tokens: DataFrame) -> DataFrame:
    """``n_tokens`` and ``ids_crc32`` of the ids as read (little-endian unsigned 32-bit)."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            cuts = np.asarray(ids.offsets)
            raw = np.asarray(ids.values, "<i4").tobytes()
            sums = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(cuts).astype(np.int64)), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(
        run, f"doc_id {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all documents to token files in the shared folder and digest them as read back.

    A missing text is empty and has its end id only. Rows with a missing id come first,
    equal ids in an order that follows from their texts; repeated rows are all written. An empty table
    gives an empty result; other columns are ignored.
    """
    path = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary, doc_id, text)
    return digests(read_token_files(docs.sparkSession, path))
