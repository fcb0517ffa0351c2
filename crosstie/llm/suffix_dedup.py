"""Removal of long byte strings that occur twice, by blockwise suffix sorting.

Only suffixes that may share ``LENGTH`` bytes with another one have to be sorted. Every
window of ``LENGTH`` bytes has an anchor, the block of ``ANCHOR`` bytes with the least
hash, and equal windows have equal anchors at equal places; so windows whose anchor occurs
once are unique. Consecutive windows with the same anchor are one run. Runs with an equal
context (the bytes of all their windows) are one class: a class of two or more is repeated
as a whole. The suffixes of the remaining runs are put into order, one block of buckets at
a time (a bucket: same anchor, same distance to it). They are sorted by their first
``PERIOD`` bytes; longer ties are resolved by the ranks of a difference-cover sample that
is sorted once per block. Neighbours that share ``LENGTH`` bytes are repeated.

A block is bounded in size. The contexts of an anchor with more classes than a block may
hold (a common passage in front of different texts) are dealt over several blocks. Each
sorts its own suffixes; of windows repeated there one goes on, of the others all do, in
pieces of neighbouring windows. Pieces whose common core occurs once end there; the windows of
the others meet again across blocks by their 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from crosstie.llm.common import HOT_ROWS, BitSet, bit_set, grouped, mixed, sorted_groups, unused
from crosstie.operators.joins import spread_join
from crosstie.session import discard, stored

LENGTH = 200
ANCHOR = 40
PERIOD = 32
BLOCK = 1024
# Windows, by their distance from the anchor, that are sent to other blocks together.
PIECE = 16
# Bytes of a text that are looked at in one go.
SEGMENT = 1 << 20
_RANDOM = np.random.default_rng(7)
_BYTE = _RANDOM.integers(0, 1 << 64, 256, np.uint64, endpoint=False)
_BASE = int(_RANDOM.integers(0, 1 << 62, dtype=np.uint64)) * 2 + 1
_LOW = np.uint64((1 << 23) - 1)


def difference_cover(period: int) -> list[int]:
    """Residues of which two differ by any given number, modulo ``period`` (greedy)."""
    cover, missing = [0], set(range(1, period))
    while missing:
        def gain(r: int) -> int:
            return len({(r - c) % period for c in cover} & missing) + len({(c - r) % period for c in cover} & missing)
        best = max((r for r in range(period) if r not in cover), key=gain)
        missing -= {(best - c) % period for c in cover} | {(c - best) % period for c in cover}
        cover.append(best)
    return sorted(cover)


COVER = difference_cover(PERIOD)


def anchor_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the ``ANCHOR`` bytes that begin at each place, by doubling."""
    powers, done, total, at = {1: _BYTE[data]}, 1, None, 0
    while 2 * done <= ANCHOR:
        h = powers[done]
        powers[2 * done] = h[:-done] * np.uint64(pow(_BASE, done, 1 << 64)) + h[done:]
        done *= 2
    for size in sorted(powers, reverse=True):
        if ANCHOR & size:
            part = powers[size][at:]
            total = part if total is None else total[:len(part)] * np.uint64(pow(_BASE, size, 1 << 64)) + part[:len(total)]
            at += size
    n = len(data) - ANCHOR + 1
    total = total[:n]
    total = (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return total ^ (total >> np.uint64(29))


def runs_of(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: text, first window, number of windows, anchor place and hash.

    ``cuts`` are the texts' ends within ``data``; no window crosses them.
    """
    none = (np.zeros(0, np.int64),) * 5
    if len(data) < LENGTH:
        return none
    hashed = anchor_hashes(data)
    # The least hash wins, of equal ones the last.
    order = (hashed & ~_LOW) | (_LOW - np.arange(len(hashed), dtype=np.uint64))
    width, done = LENGTH - ANCHOR + 1, 1
    while 2 * done <= width:
        order = np.minimum(order[:-done], order[done:])
        done *= 2
    if done < width:
        order = np.minimum(order[:done - width], order[width - done:])
    anchors = (_LOW - (order & _LOW)).astype(np.int64)
    begins = np.concatenate([[0], cuts[:-1]])
    of = np.repeat(np.arange(len(cuts)), np.maximum(cuts - begins - LENGTH + 1, 0))
    if not len(of):
        return none
    counts = np.bincount(of, minlength=len(cuts))
    windows = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[of]
    chosen = anchors[windows]
    first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (of[1:] != of[:-1])]))
    sizes = np.diff(np.concatenate([first, [len(of)]]))
    at = chosen[first]
    return of[first], windows[first], sizes, at, hashed[at].astype(np.int64)


def segments(texts: list[bytes]) -> Iterator[tuple[list[int], list[int], bytes, np.ndarray]]:
    """Texts together, long ones in pieces that overlap by a window: numbers, offsets in the text, bytes, ends."""
    of, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - LENGTH + 1), SEGMENT):
            part = t[at:at + SEGMENT + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if parts and size + len(part) > SEGMENT:
                yield of, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])
                of, offsets, parts, size = [], [], [], 0
            of.append(i)
            offsets.append(at)
            parts.append(part)
            size += len(part)
    if parts:
        yield of, offsets, b"".join(parts), np.cumsum([len(p) for p in parts])


def halves(data: bytes) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(data)
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def _raw(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, the text's hash ``t1`` and its bytes; rows of equal id and text are told apart nowhere."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(whole).alias("t1"), whole.cast("binary").alias("data"))


def _key(*columns: np.ndarray) -> np.ndarray:
    key = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        key = mixed(key, c.view(np.uint64))
    return key


def anchors(rows: DataFrame) -> DataFrame:
    """``h`` of the anchors with two runs or more, copies of a text included. Only hashes are shuffled, combined in the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, cuts in segments(_raw(batch.column(0))):
                h, n = np.unique(runs_of(np.frombuffer(data, np.uint8), cuts)[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "n"])

    found = rows.select("data").mapInArrow(work, "h bigint, n tinyint").groupBy("h").agg(F.sum("n").alias("n"))
    return found.where("n > 1").select("h")


def runs(rows: DataFrame, wanted=None) -> DataFrame:
    """Runs of all texts: ``doc_id``, ``t1``, ``start``, ``n``, ``shift`` (first window to anchor), anchor and context hashes.

    With ``wanted`` (a broadcast bit set of anchors) only those of its anchors, and a few others.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "t1", "start", "n", "shift", "h", "c1", "c2"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = BitSet(wanted.value) if wanted else None
        for batch in batches:
            for of, offsets, data, cuts in segments(_raw(batch.column(2))):
                begins = np.concatenate([[0], cuts[:-1]])
                text, start, n, at, h = runs_of(np.frombuffer(data, np.uint8), cuts)
                if keep:
                    on = keep.has(_key(h))
                    text, start, n, at, h = text[on], start[on], n[on], at[on], h[on]
                c = [halves(data[s:s + k + LENGTH - 1]) for s, k in zip(start.tolist(), n.tolist(), strict=True)]
                c1, c2 = zip(*c, strict=True) if c else ((), ())
                take = pa.array(np.array(of, np.int64)[text])
                place = start - begins[text] + np.array(offsets, np.int64)[text]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(place), pa.array(n, pa.int64()),
                     pa.array(at - start, pa.int64()), pa.array(h), pa.array(c1, pa.int64()), pa.array(c2, pa.int64())], names)

    return rows.mapInArrow(work, f"doc_id {kind}, t1 bigint, start bigint, n bigint, shift bigint, h bigint, c1 bigint, c2 bigint")


def texts_with(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose text hash is among ``keys`` (column ``t1``), and a few others: spares the others' texts a shuffle."""
    wanted = rows.sparkSession.sparkContext.broadcast(bit_set(keys.select(F.array("t1"))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = BitSet(wanted.value)
        for batch in batches:
            yield batch.filter(pa.array(keep.has(_key(batch.column(1).to_numpy()))))

    return rows.mapInArrow(work, rows.schema)


def contexts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The bytes of the wanted runs, cut out of their texts."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "t1", "start", "n", "shift", "h", "data"]
    lists = wanted.groupBy("doc_id", "t1").agg(F.collect_set(F.struct("start", "n", "shift", "h")).alias("wanted"))
    rows = texts_with(rows, wanted.select("t1").distinct())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, found = [], []
            for i, (data, runs_) in enumerate(zip(_raw(batch.column(2)), batch.column(3).to_pylist(), strict=True)):
                for r in runs_:
                    of.append(i)
                    found.append((r["start"], r["n"], r["shift"], r["h"], data[r["start"]:r["start"] + r["n"] + LENGTH - 1]))
            take = pa.array(of, pa.int64())
            columns = zip(*found, strict=True) if found else ([],) * 5
            kinds = [pa.int64()] * 4 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take),
                                              *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    joined = _with_text(rows, lists, "inner").select("doc_id", "t1", "data", "wanted")
    return joined.mapInArrow(work, f"doc_id {kind}, t1 bigint, start bigint, n bigint, shift bigint, h bigint, data binary")


def _with_text(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    lists = lists.withColumnsRenamed({"doc_id": "_id", "t1": "_t"})
    same = rows["doc_id"].eqNullSafe(lists["_id"]) & (rows["t1"] == lists["_t"])
    return rows.join(lists, same, how).drop("_id", "_t")


def _words(data: np.ndarray, places: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` bytes from each place as big-endian words, one row each."""
    return sliding_window_view(data, size)[places].view(">u8").astype(np.uint64)


def repeated_windows(parts: list[bytes], shifts: np.ndarray, ns: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which windows of a block's contexts are repeated, and which of these come first of their kind.

    Both are flags for all windows, context by context.

    Contexts are laid out with their anchors at multiples of the period, so the suffixes of
    a bucket have one residue and the same step to the next sampled place.
    """
    pad = -shifts % PERIOD
    sizes = np.array([len(p) for p in parts])
    spans = -(-(pad + sizes + LENGTH) // PERIOD) * PERIOD
    begins = np.concatenate([[0], np.cumsum(spans)[:-1]]) + pad
    data = np.zeros(int(spans.sum()) + LENGTH + PERIOD, np.uint8)
    for b, p in zip(begins.tolist(), parts, strict=True):
        data[b:b + len(p)] = np.frombuffer(p, np.uint8)
    # Sample: places with a residue of the cover from which a window may go on.
    of = np.repeat(np.arange(len(parts)), ns + PERIOD)
    step = np.arange(len(of)) - np.repeat(np.cumsum(ns + PERIOD) - (ns + PERIOD), ns + PERIOD)
    sample = begins[of] + step
    sample = sample[np.isin(sample % PERIOD, COVER)]
    keys = _words(data, sample, LENGTH)
    order = np.lexsort(keys.T[::-1])
    rank = np.zeros(len(data), np.int64)
    rank[sample[order]] = np.arange(len(order))
    # Suffixes: bucket by bucket, first bytes, then the rank of the next sampled place.
    of = np.repeat(np.arange(len(parts)), ns)
    step = np.arange(len(of)) - np.repeat(np.cumsum(ns) - ns, ns)
    places, distance = begins[of] + step, shifts[of] - step
    to_cover = np.array([min((c - r) % PERIOD for c in COVER) for r in range(PERIOD)])
    head = _words(data, places, PERIOD)
    order = np.lexsort((rank[places + to_cover[places % PERIOD]], *head.T[::-1], distance, bucket[of]))
    windows = np.ascontiguousarray(sliding_window_view(data, LENGTH)[places[order]]).view(np.uint64)
    same = ((windows[1:] == windows[:-1]).all(axis=1) & (distance[order][1:] == distance[order][:-1])
            & (bucket[of][order][1:] == bucket[of][order][:-1]))
    flags = np.zeros(len(of), bool)
    flags[order[1:]] |= same
    flags[order[:-1]] |= same
    later = np.zeros(len(of), bool)
    later[order[1:]] = same
    return flags, flags & ~later


class Block:
    """The contexts of whole buckets with the repeated windows among them."""

    def __init__(self, groups: list[list[dict]]):
        self.rows = [r for g in groups for r in g]
        bucket = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
        ns = np.array([r["n"] for r in self.rows])
        self.flags, self.first = repeated_windows([r["data"] for r in self.rows], np.array([r["shift"] for r in self.rows]), ns, bucket)
        self.of = np.repeat(np.arange(len(self.rows)), ns)
        self.step = np.arange(len(self.of)) - np.repeat(np.cumsum(ns) - ns, ns)
        self.start = np.array([r["start"] for r in self.rows])[self.of] + self.step

    def owners(self, windows: np.ndarray, doc_type: pa.DataType) -> list[pa.Array]:
        rows = [self.rows[i] for i in self.of[windows].tolist()]
        return [pa.array([r["doc_id"] for r in rows], doc_type), pa.array([r["t1"] for r in rows], pa.int64()),
                pa.array(self.start[windows], pa.int64())]

    def found(self) -> tuple[np.ndarray, np.ndarray]:
        """First window and length of each run of repeated windows of one context."""
        hits = np.flatnonzero(self.flags)
        if not len(hits):
            return hits, hits
        new = np.flatnonzero(np.concatenate([[True], (np.diff(hits) > 1) | (np.diff(self.of[hits]) > 0)]))
        return hits[new], np.diff(np.concatenate([new, [len(hits)]]))


def _doc_type(df: DataFrame) -> tuple[str, pa.DataType]:
    kind = df.schema["doc_id"].dataType
    return kind.simpleString(), to_arrow_type(kind)


def sorted_blocks(parts: DataFrame, block: int = BLOCK) -> DataFrame:
    """Repeated windows (``doc_id``, ``t1``, ``start``, ``n``) of all contexts, block by block."""
    kind, doc_type = _doc_type(parts)

    def result(groups: list[list[dict]]) -> pa.RecordBatch:
        done = Block(groups)
        first, n = done.found()
        return pa.RecordBatch.from_arrays([*done.owners(first, doc_type), pa.array(n, pa.int64())], ["doc_id", "t1", "start", "n"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for _, rows in sorted_groups(batches, ["h"]):
            waiting.append(rows)
            size += len(rows)
            if size >= block:
                yield result(waiting)
                waiting, size = [], 0
        if waiting:
            yield result(waiting)

    return grouped(parts, ["h"]).mapInArrow(work, f"doc_id {kind}, t1 bigint, start bigint, n bigint")


def crowded_blocks(parts: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The same for anchors with more contexts than a block; ``parts`` is a stored table. Also returns its own scratch table.

    Contexts are dealt over tasks of a block each. A task returns its runs of repeated
    windows, and those that may have partners in other blocks: neighbours together as a piece
    (``data``, ``on``: 1 for a window that goes on, 2 for one known to be repeated), with the
    hash of its core, the bytes that all windows at such distances from the anchor hold. Equal
    windows have equal cores, so only pieces whose core occurs twice are taken apart.
    """
    kind, doc_type = _doc_type(parts)
    names = ["doc_id", "t1", "start", "n", "w1", "w2", "data", "on"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for batch in batches for r in batch.to_pylist()), key=lambda r: r["h"])
        if not rows:
            return
        done = Block([list(g) for _, g in groupby(rows, key=lambda r: r["h"])])
        first, n = done.found()
        none = pa.nulls(len(first), pa.int64())
        empty = pa.nulls(len(first), pa.binary())
        yield pa.RecordBatch.from_arrays([*done.owners(first, doc_type), pa.array(n, pa.int64()), none, none, empty, empty], names)
        on = np.flatnonzero(~done.flags | done.first)
        shifts = np.array([r["shift"] for r in done.rows])
        piece = (shifts[done.of[on]] - done.step[on]) // PIECE
        new = np.flatnonzero(np.concatenate([[True], (np.diff(done.of[on]) > 0) | (np.diff(piece) != 0)])[:len(on)])
        columns: list[list] = [[], [], [], [], []]
        for a, z in zip(new.tolist(), [*new[1:].tolist(), len(on)], strict=True):
            data, steps, p = done.rows[done.of[on[a]]]["data"], done.step[on[a:z]], int(piece[a])
            anchor = int(shifts[done.of[on[a]]])
            low, high = int(steps[0]), int(steps[-1])
            marks = np.zeros(high - low + 1, np.uint8)
            marks[steps - low] = 1 + done.flags[on[a:z]]
            core = data[anchor - p * PIECE:anchor + LENGTH - (p + 1) * PIECE + 1]
            for c, v in zip(columns, [high - low + 1, *halves(core + b"%d" % p), data[low:high + LENGTH], marks.tobytes()], strict=True):
                c.append(v)
        kinds = [pa.int64()] * 3 + [pa.binary()] * 2
        yield pa.RecordBatch.from_arrays([*done.owners(on[new], doc_type), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = [i for i, m in enumerate(r["on"]) if m]
                pairs = [halves(r["data"][i:i + LENGTH]) for i in at]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["doc_id"]] * len(at), doc_type), pa.array([r["t1"]] * len(at), pa.int64()),
                     pa.array([r["start"] + i for i in at], pa.int64()), pa.array([a for a, _ in pairs], pa.int64()),
                     pa.array([b for _, b in pairs], pa.int64()), pa.array([r["on"][i] == 2 for i in at], pa.bool_())],
                    ["doc_id", "t1", "start", "w1", "w2", "known"])

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in sorted_groups(batches, ["w1", "w2"]):
            new = [r for r in rows if not r["known"]] if len(rows) > 1 else []
            if new:
                yield pa.RecordBatch.from_pylist([{"doc_id": r["doc_id"], "t1": r["t1"], "start": r["start"], "n": 1} for r in new], pa.schema(
                    [("doc_id", doc_type), *[(k, pa.int64()) for k in names[1:4]]]))

    tasks = max(1, -(-parts.count() // block))
    local = stored(parts.repartition(tasks).mapInArrow(
        work, f"doc_id {kind}, t1 bigint, start bigint, n bigint, w1 bigint, w2 bigint, data binary, on binary"), "crowds")
    pieces = local.where("w1 IS NOT NULL")
    twice = pieces.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("w1", "w2")
    shared = spread_join(pieces, twice, ["w1", "w2"], "left_semi", HOT_ROWS, ["doc_id", "t1", "start"])
    apart = shared.select("doc_id", "t1", "start", "data", "on").mapInArrow(
        windows, f"doc_id {kind}, t1 bigint, start bigint, w1 bigint, w2 bigint, known boolean")
    met = grouped(apart, ["w1", "w2"]).mapInArrow(across, f"doc_id {kind}, t1 bigint, start bigint, n bigint")
    return local.where("w1 IS NULL").select("doc_id", "t1", "start", "n").unionByName(met), local


def repeated(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Stored runs of repeated windows (``doc_id``, ``t1``, ``start``, ``n``) of all texts.

    The first pass over the texts counts anchors; the second one returns the runs of those
    that occur twice, told by a bit set of bounded size. An anchor that passes it by chance
    has one run, so it forms no class and is never sorted.
    """
    twice = stored(anchors(rows), "anchors")
    shared = stored(runs(rows, rows.sparkSession.sparkContext.broadcast(bit_set(twice.select(F.array("h"))))), "shared")
    classes = stored(shared.groupBy("h", "c1", "c2").agg(
        F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "t1", "start", "n", "shift")).alias("one")), "classes")
    whole = spread_join(shared, classes.where("m > 1").select("h", "c1", "c2"), ["h", "c1", "c2"], "left_semi", HOT_ROWS,
                        ["doc_id", "t1", "start"]).select("doc_id", "t1", "start", "n")
    sizes = classes.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h", (F.col("k") > block).alias("crowded"))
    wanted = stored(spread_join(classes.select("h", "one.*"), sizes, ["h"], "inner", HOT_ROWS, ["doc_id", "t1", "start"]), "wanted")
    cut = stored(contexts(rows, wanted), "contexts")
    crowd = wanted.where("crowded").select("h").distinct()
    others = spread_join(cut, crowd, ["h"], "left_anti", HOT_ROWS, ["doc_id", "t1", "start"])
    crowded = stored(spread_join(cut, crowd, ["h"], "left_semi", HOT_ROWS, ["doc_id", "t1", "start"]), "crowded")
    across, crowds = crowded_blocks(crowded, block)
    found = stored(whole.unionByName(sorted_blocks(others, block)).unionByName(across), "repeated")
    discard(twice, shared, classes, wanted, cut, crowded, crowds)
    return found


def _covered(size: int, found: list[dict]) -> np.ndarray:
    edges = np.zeros(size + 1, np.int32)
    for r in found:
        edges[r["start"]] += 1
        edges[min(size, r["start"] + r["n"] + LENGTH - 1)] -= 1
    return np.cumsum(edges[:-1]) > 0


def _kept(data: bytes, found: list[dict] | None) -> tuple[bytes, int]:
    """The bytes that stay and the number of removed runs."""
    if not found:
        return data, 0
    gone = _covered(len(data), found)
    spans = int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), spans


def _with_runs(docs: DataFrame, doc_id: str, text: str, block: int) -> DataFrame:
    rows = keyed(docs, doc_id, text)
    lists = repeated(rows, block).groupBy("doc_id", "t1").agg(F.collect_set(F.struct("start", "n")).alias("found"))
    return _with_text(rows, stored(lists, "found"), "left")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Per row: bytes, removed bytes, removed runs and the digest of the bytes that stay.

    A missing text is empty; texts under ``LENGTH`` bytes stay as they are; a text that
    occurs twice (also in a repeated row) goes as a whole. Missing ids are an id like
    others. An empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = _raw(batch.column(1))
            kept = [_kept(d, f) for d, f in zip(data, batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(d) for d in data], pa.int64()),
                 pa.array([len(d) - len(k) for d, (k, _) in zip(data, kept, strict=True)], pa.int64()),
                 pa.array([s for _, s in kept], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k, _ in kept])], names)

    return _with_runs(docs, doc_id, text, block).select("doc_id", "data", "found").mapInArrow(
        work, f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated strings taken out of ``text``; all rows and other columns stay.

    Bytes of a character that was cut in two are dropped with it. A missing text stays missing,
    an empty one empty; a text that occurs twice, also in a repeated row, goes in each. Missing
    ids are an id like others, an empty table gives an empty result, extra columns may have any
    names.
    """
    names = docs.columns
    own, id_, key, spans = unused(docs, "_t", "_id", "_t1", "_found")
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    lists = repeated(keyed(docs, doc_id, text)).groupBy("doc_id", "t1").agg(F.collect_set(F.struct("start", "n")).alias("found"))
    lists = stored(lists, "found").toDF(id_, key, spans)
    joined = rows.join(lists, rows[doc_id].eqNullSafe(lists[id_]) & (rows[own] == lists[key]), "left")
    at = names.index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, found = batch.column(at).to_pylist(), batch.column(len(names)).to_pylist()
            kept = [t if not f else _kept(t.encode(), f)[0].decode("utf-8", "ignore") for t, f in zip(texts, found, strict=True)]
            columns = list(batch.columns[:len(names)])
            columns[at] = pa.array(kept, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*[rows[f"`{c}`"] for c in names], spans).mapInArrow(work, docs.schema)
