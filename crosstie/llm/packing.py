"""Best-fit packing of token sequences with a bounded number of open bins.

Each task packs its documents as they come. It keeps at most ``open_bins`` sequences open;
a bitset has one bit for each amount of free space that an open sequence has, so the
tightest fit is the lowest set bit at or above the length. When nothing fits and no more
bins may be opened, the fullest open sequence is closed. What the tasks leave unfilled is
then packed again, whole part-filled sequences being the items, in fewer tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import texts_in_turn
from crosstie.llm.tokens import encoder
from crosstie.session import stored

LENGTH = 4096
OPEN_BINS = 256
END_ID = 1
# Sequences of one task are numbered from its partition's multiple of this.
PER_TASK = 1 << 40
# Part-filled sequences that one task of the second round packs.
SECOND_ROUND = 100_000


class BestFit:
    """Online best-fit into sequences of ``length``, numbered from ``first``."""

    def __init__(self, length: int = LENGTH, open_bins: int = OPEN_BINS, first: int = 0):
        self.length, self.open_bins, self.next = length, open_bins, first
        self.bits = 0
        self.by_space: dict[int, list[int]] = {}
        self.n_open = 0

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        found = bins.pop()
        if not bins:
            del self.by_space[space]
            self.bits ^= 1 << space
        self.n_open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        """Sequence and offset for an item of 1 to ``length`` tokens."""
        fits = self.bits >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            bin_id = self._take(space)
        else:
            if self.n_open == self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
            space, bin_id = self.length, self.next
            self.next += 1
        left = space - size
        if left:
            self.by_space.setdefault(left, []).append(bin_id)
            self.bits |= 1 << left
            self.n_open += 1
        return bin_id, self.length - space


def tokenized_pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text",
                     length: int = LENGTH, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """First round: every document's pieces with the sequence and offset its own task found."""
    ids = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    schema = f"doc_id {ids}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    kinds = [pa.int32()] + [pa.int64()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, bins, end = encoder(vocabulary, False), None, end_id.to_bytes(4, "little")
        for batch in batches:
            bins = bins or BestFit(length, open_bins, TaskContext.get().partitionId() * PER_TASK)
            rows, of = [], []
            for i, t in enumerate(texts_in_turn(batch.column(1))):
                raw = coder.encode(t) + end
                for piece, at in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[at:at + 4 * length]
                    n = len(part) // 4
                    rows.append((piece, at // 4, n, zlib.crc32(part), *bins.place(n)))
                    of.append(i)
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *columns], names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def packed_again(fills: DataFrame, length: int = LENGTH, open_bins: int = OPEN_BINS) -> DataFrame:
    """Second round: where each part-filled sequence (``sequence_id``, ``used``) goes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = None
        for batch in batches:
            # Numbers below zero cannot meet those of the first round.
            bins = bins or BestFit(length, open_bins, -(TaskContext.get().partitionId() + 1) * PER_TASK)
            found = [bins.place(n) for n in batch.column(1).to_pylist()]
            if found:
                to, shift = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(to, pa.int64()), pa.array(shift, pa.int64())],
                                                 ["sequence_id", "to", "shift"])

    tasks = max(1, -(-fills.count() // SECOND_ROUND))
    dealt = fills.repartition(tasks).sortWithinPartitions(F.desc("used"), "sequence_id")
    return dealt.mapInArrow(run, "sequence_id bigint, to bigint, shift bigint")


def pack(docs: DataFrame, vocabulary: str | None = None, doc_id: str = "doc_id", text: str = "text",
         length: int = LENGTH, open_bins: int = OPEN_BINS, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with sequence and offset; every token is placed once.

    A missing text is empty and still has its end id; repeated rows and missing ids are
    packed like others; an empty table gives no rows; other columns are ignored. Documents
    longer than ``length`` are cut into pieces of ``length``, the last may be shorter.

    The first round's rows (numbers only) are written once, so both rounds see the same
    sequences even if a task is rerun.
    """
    vocabulary = vocabulary or public_tokenizers.path("word_bpe_49k.json")
    first = stored(tokenized_pieces(docs, vocabulary, doc_id, text, length, open_bins, end_id), "pieces")
    fills = first.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    moved = packed_again(fills.where(F.col("used") < length), length, open_bins)
    return (first.join(moved, "sequence_id", "left")
            .withColumn("offset", F.col("offset") + F.coalesce(F.col("shift"), F.lit(0)))
            .withColumn("sequence_id", F.coalesce(F.col("to"), F.col("sequence_id")))
            .select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"))
