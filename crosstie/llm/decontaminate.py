"""Benchmark decontamination with one Aho-Corasick automaton over all test questions and answers.

Texts are normalised to words (letters A-Z lower-cased, all other ASCII signs but digits and
letters separate words). The automaton holds every window of consecutive item words, as a
sequence of word numbers, so a text is scanned once and a node stands for a word and not for
a letter. Words of a document inside any occurrence of a window are hit; their places are
mapped back to the original text.

The automaton is built in the workers from a broadcast list of at most ``SHARD`` windows. A
larger benchmark is dealt over several automata of that size, which scan the documents one
after another in the same pass, so memory is bounded whatever the benchmark's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.session import stored

WINDOW = 10
# Windows of one automaton: some 2 million nodes at most.
SHARD = 200_000

# Every ASCII character but digits and letters separates words; bytes of other characters stay.
_TO_WORDS = bytes(b if b > 0x7F or chr(b).isdigit() else b | 0x20 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A else 0x20
                  for b in range(256))
# The words of an original text, for their places.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a whole text (missing: none)."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """Distinct ``words`` (binary, joined by one space) and ``item`` (text) of all windows of all items."""
    names = ["words", "item"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = words_of(t)
                found = {b" ".join(words[i:i + window]) for i in range(max(1, len(words) - window + 1))} if words else set()
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array([item] * len(found), pa.string())], names)

    narrow = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))
    return narrow.mapInArrow(work, "words binary, item string").distinct()


class Scanner:
    """The automaton of a list of (window, item)."""

    def __init__(self, windows: list[tuple[bytes, str]]):
        self.numbers: dict[bytes, int] = {}
        self.items: list[list[str]] = []
        self.sizes: list[int] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        seen: dict[bytes, int] = {}
        for words, item in windows:
            if words not in seen:
                seen[words] = len(self.items)
                key = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words.split(b" "))
                self.automaton.add_word(key, len(self.items))
                self.items.append([])
                self.sizes.append(len(key))
            self.items[seen[words]].append(item)
        if windows:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs of hit words (first, end; merged, in order) and the items found."""
        known = self.numbers.get
        sequence = tuple([known(w, 0) for w in words])
        if not self.items or not any(sequence):
            return [], set()
        runs: list[tuple[int, int]] = []
        found = set()
        for last, number in self.automaton.iter(sequence):
            first, end = last + 1 - self.sizes[number], last + 1
            found.add(number)
            while runs and runs[-1][1] >= first:
                first = min(first, runs.pop()[0])
            runs.append((first, end))
        return runs, {i for n in found for i in self.items[n]}


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and out[-1][1] >= first:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((first, end))
    return out


def in_original(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word runs as code point ranges of the original text."""
    places = [m.span() for m in _WORD.finditer(text)]
    return [(places[first][0], places[end - 1][1]) for first, end in runs]


_SPANS = "array<struct<start:bigint,end:bigint>>"


def contaminated(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text", window: int = WINDOW, shard: int = SHARD) -> DataFrame:
    """Per document: ``doc_id``, ``n_words``, ``n_hit``, ``spans`` of hit words in the original text and ``items`` found.

    Spans are code point ranges, end exclusive, of runs of consecutive hit words; items are
    sorted as strings. Missing and empty texts have no words and no hits, missing, empty and
    wordless items no windows; an item without id counts under the empty id, repeated items
    once. Repeated rows and rows without id are returned each; an empty table gives an empty
    result, an empty benchmark no hits; other columns are ignored.
    """
    spark = docs.sparkSession
    windows = stored(item_windows(items, item_id, item_text, window), "windows")
    shards = max(1, -(-windows.count() // shard))
    place = F.pmod(F.xxhash64("words", "item"), F.lit(shards))
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.array().cast("array<bigint>").alias("runs"),
                       F.array().cast("array<string>").alias("items"))
    for n in range(shards):
        # At most about ``shard`` windows reach the driver at a time.
        part = sorted((bytes(r.words), r.item) for r in windows.where(place == n).collect())
        rows = _scanned(rows, spark.sparkContext.broadcast(part), kind, n == shards - 1)
    return rows


def _scanned(rows: DataFrame, windows, kind: str, last: bool) -> DataFrame:
    """One scan: adds its runs (first, end, first, end ...) and items, and after the last one gives the result."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(windows.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n_words, runs, items = [], [], []
            for t, before, known in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                words = words_of(t)
                own, found = scanner.scan(words)
                n_words.append(len(words))
                runs.append(merged([*own, *zip(before[::2], before[1::2], strict=True)]))
                items.append(sorted(found.union(known)))
            if last:
                spans = [[{"start": a, "end": e} for a, e in in_original(t, r)] if r else [] for t, r in zip(texts, runs, strict=True)]
                kind_ = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n_words, pa.int64()), pa.array([sum(e - a for a, e in r) for r in runs], pa.int64()),
                     pa.array(spans, kind_), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "spans", "items"])
            else:
                flat = [np.array(r, np.int64).ravel().tolist() for r in runs]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(flat, pa.list_(pa.int64())),
                                                  pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "runs", "items"])

    schema = (f"doc_id {kind}, n_words bigint, n_hit bigint, spans {_SPANS}, items array<string>" if last
              else f"doc_id {kind}, text string, runs array<bigint>, items array<string>")
    return rows.mapInArrow(work, schema)


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Counts, the digest of the items found and the verdict."""
    return contaminated(docs, items).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
