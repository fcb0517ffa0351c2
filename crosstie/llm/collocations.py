"""Collocations by best-first growth of phrases, with admissible bounds from prefix counts.

A phrase's score is that of its worst cut: 1000 * a * n / (l * r) for a occurrences of the
phrase, l and r of its parts, n words. As a is at most r, no phrase that begins with a word
of f occurrences scores over 1000 * n / f: every prefix bounds all phrases grown from it, the
first word the best. So phrases are grown from the rarest frequent words first. A round
expands all words up to a count; it grows pairs, then triples, then longer phrases, each only
from prefixes that are frequent enough. A language is settled, and leaves the frontier, when
its last wanted score is above the bound of all words not yet expanded.

Words are named by 64-bit hashes. The texts are split once and stored as arrays of names, with
zeros for rare words and for the ends of pieces; every count is a scan of these arrays that
combines in the task before the shuffle. The arrays are stored compressed and unpacked one by
one in the task, so that Spark never holds the names of a file at length. Which phrases a scan
looks for is told by a bit set of fixed size: what passes it by chance is removed afterwards by
an exact join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosstie.llm.common import HOT_ROWS, BitSet, bit_set, mixed
from crosstie.operators.joins import spread_join
from crosstie.session import stored

LONGEST = 5
LEAST = 100
WANTED = 2000
NO_LANGUAGE = "und"
# Growth of the frontier: a round expands words of up to so many times the count of the round before.
GROWTH = 32
# Different words a task remembers, bytes of text that are split at a time, and words whose phrases are counted in one go.
MOST_KNOWN = 300_000
ROW_BYTES = 1 << 19
AT_ONCE = 1 << 20
# Phrases of a batch that a task returns: batches stand in full in the task and in the executor.
MOST_SENT = 1 << 15
# The names are written in small row groups and pages, which the scans read as a whole.
SMALL_GROUPS = {"parquet.block.size": 1 << 22, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}
_SPLIT = bytes(0x0A if c in b".,;:!?\n\x0b\x0c\r" else 0x20 if c == 0x09 else c | 0x20 if 0x41 <= c <= 0x5A else c for c in range(256))


def split_words(text: bytes) -> list[bytes]:
    """The words of a translated text in order; an end of line stands between pieces, empty strings are to be skipped."""
    return text.replace(b"\n", b" \n ").split(b" ")


def name_of(lang: str, word: bytes) -> int:
    """64-bit name of a word of a language, never zero."""
    return (xxhash.xxh3_64_intdigest(lang.encode() + b"\0" + word) or 1) - (1 << 63) or 1


def by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Translated texts (column 1) by language (column 0), some ``ROW_BYTES`` at a time; only ends of pieces are cut at."""
    for batch in batches:
        waiting: dict[str, list[bytes]] = {}
        sizes: Counter = Counter()
        # Bytes as they are, some rows at a time: no second copy of a batch as Python strings.
        texts = batch.column(1).cast(pa.binary())
        some = (r for i in range(0, batch.num_rows, 256) for r in texts.slice(i, 256).to_pylist())
        for lang, t in zip(batch.column(0).to_pylist(), some, strict=True):
            rest = (t or b"").translate(_SPLIT)
            while rest:
                cut = rest.find(b"\n", ROW_BYTES) if len(rest) > ROW_BYTES else -1
                part, rest = (rest, b"") if cut < 0 else (rest[:cut], rest[cut:])
                waiting.setdefault(lang, []).append(part)
                sizes[lang] += len(part)
                if sizes[lang] >= ROW_BYTES:
                    yield lang, b"\n".join(waiting.pop(lang))
                    del sizes[lang]
        for lang, parts in waiting.items():
            yield lang, b"\n".join(parts)


class Numbers:
    """Numbers of the different words of one language in a task; 0 is no word, 1 the end of a piece."""

    def __init__(self):
        self.of: dict[bytes, int] = {b"": 0, b"\n": 1}

    def numbers(self, words: list[bytes]) -> np.ndarray:
        known = self.of
        found = [known.get(w) for w in words]
        if None in found:
            for i, w in enumerate(words):
                if found[i] is None:
                    found[i] = known.setdefault(w, len(known))
        numbers = np.array(found, np.int64)
        return numbers[numbers > 0]


def _texts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANGUAGE)).alias("lang"), F.col(text).alias("text"))


def word_counts(texts: DataFrame) -> DataFrame:
    """``lang``, ``word``, ``name`` and the count ``f`` per task; a task's words are added up in it."""
    names = ["lang", "word", "name", "f"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Numbers] = {}
        counts: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, own in known.items():
                words = list(own.of)[2:]
                if words:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(words)), pa.array(words, pa.binary()), pa.array([name_of(lang, w) for w in words], pa.int64()),
                         pa.array(counts[lang][2:])], names)
            known.clear()
            counts.clear()

        for lang, found in by_language(batches):
            own = known.setdefault(lang, Numbers())
            new = np.bincount(own.numbers(split_words(found)))
            total = np.zeros(len(own.of), np.int64)
            old = counts.get(lang, total[:0])
            total[:len(old)] = old
            total[:len(new)] += new
            counts[lang] = total
            if sum(len(k.of) for k in known.values()) > MOST_KNOWN:
                yield from flush()
        yield from flush()

    return texts.mapInArrow(work, "lang string, word binary, name bigint, f bigint")


def packed(names: np.ndarray) -> bytes:
    """An array of names, compressed; only tasks unpack it."""
    return pa.Codec("zstd", compression_level=3).compress(names.tobytes(), asbytes=True)


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """The arrays of names (column 0, their sizes in column 1), one at a time."""
    codec = pa.Codec("zstd")
    for batch in batches:
        for data, size in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            yield np.frombuffer(codec.decompress(data.as_buffer(), decompressed_size=8 * size), np.int64)


def encoded(texts: DataFrame, frequent) -> DataFrame:
    """``names``: the texts as 64-bit names (``packed``, ``size`` of them), zero for words outside ``frequent`` and between pieces; no row cuts a piece."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = BitSet(frequent.value)
        known: dict[str, Numbers] = {}
        named: dict[str, np.ndarray] = {}

        for lang, found in by_language(batches):
            own = known.setdefault(lang, Numbers())
            before = named.get(lang, np.zeros(2, np.int64))
            numbers = own.numbers(split_words(found))
            if len(own.of) > len(before):
                new = np.array([name_of(lang, w) for w in islice(own.of, len(before), None)], np.int64)
                new[~keep.has(mixed(np.zeros(len(new), np.uint64), new.view(np.uint64)))] = 0
                named[lang] = before = np.concatenate([before, new])
            names = before[numbers]
            gap = names == 0
            names = names[~(gap & np.concatenate([[True], gap[:-1]]))]
            yield pa.RecordBatch.from_arrays([pa.array([packed(names)], pa.binary()), pa.array([len(names)], pa.int64())], ["names", "size"])
            if sum(len(k.of) for k in known.values()) > MOST_KNOWN:
                known.clear()
                named.clear()

    return texts.mapInArrow(work, "names binary, size bigint")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Several stored rows as one array, a zero before and after each."""
    waiting, size = [np.zeros(1, np.int64)], 0
    for names in unpacked(batches):
        waiting += [names, np.zeros(1, np.int64)]
        size += len(names)
        if size >= AT_ONCE:
            names = np.concatenate(waiting)
            waiting, size = [np.zeros(1, np.int64)], 0
            yield names
    if size:
        yield np.concatenate(waiting)


def _found(names: np.ndarray, base: int, longest: int, wanted: BitSet, every: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Sizes and first places of phrases: grown from wanted prefixes of ``base`` words, or (``every``) the wanted ones themselves."""
    unsigned = names.view(np.uint64)
    at = np.flatnonzero(names)
    key = mixed(np.zeros(len(at), np.uint64), unsigned[at])
    for size in range(1, longest + 1):
        if size > 1:
            on = names[at + size - 1] != 0
            at, key = at[on], key[on]
            key = mixed(key, unsigned[at + size - 1])
        if every and size >= base:
            yield size, at[wanted.has(key)]
        elif not every and size == base:
            on = wanted.has(key)
            at, key = at[on], key[on]
        elif not every and size > base:
            yield size, at


def _groups(names: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Group numbers of the phrases of ``size`` names at the places, and one place of each group. Names are compared as they are."""
    _, group = np.unique(names[at], return_inverse=True)
    for i in range(1, size):
        _, other = np.unique(names[at + i], return_inverse=True)
        _, group = np.unique(group * (int(other.max(initial=0)) + 1) + other, return_inverse=True)
    first = np.zeros(int(group.max(initial=-1)) + 1, np.int64)
    first[group] = at
    return group, first


def _phrases(names: np.ndarray, first: np.ndarray, size: int) -> pa.Array:
    values = names[first[:, None] + np.arange(size)].ravel()
    return pa.ListArray.from_arrays(pa.array(np.arange(len(first) + 1, dtype=np.int32) * size), pa.array(values))


def _sent(names: np.ndarray, first: np.ndarray, size: int, measures: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The phrases of ``size`` names at the places with their measures, some at a time."""
    for i in range(0, len(first), MOST_SENT):
        some = slice(i, i + MOST_SENT)
        yield pa.RecordBatch.from_arrays([_phrases(names, first[some], size), *[pa.array(m[some]) for m in measures.values()]], ["codes", *measures])


def grown(corpus: DataFrame, prefixes, base: int, longest: int, least: int) -> DataFrame:
    """``codes`` and count ``a`` of the phrases of ``base`` + 1 to ``longest`` words on the given prefixes, at least ``least`` times."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = BitSet(prefixes.value)
        for names in _joined(batches):
            for size, at in _found(names, base, longest, wanted, False):
                if len(at):
                    group, first = _groups(names, at, size)
                    yield from _sent(names, first, size, {"a": np.bincount(group)})

    # Plain columns are narrower in the shuffle than arrays.
    cols = [f"c{i}" for i in range(longest)]
    parts = corpus.mapInArrow(work, "codes array<bigint>, a bigint").select(*[F.get("codes", F.lit(i)).alias(c) for i, c in enumerate(cols)], "a")
    total = parts.groupBy(*cols).agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return total.select(F.array_compact(F.array(*cols)).alias("codes"), "a")


def measured(corpus: DataFrame, phrases: DataFrame, wanted, longest: int) -> DataFrame:
    """``codes``, count ``a`` and ``alone`` of the given phrases of two words or more.

    ``alone`` is false when the same frequent word stands before, or after, every occurrence
    within its piece: then the longer phrase occurs as often.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = BitSet(wanted.value)
        for names in _joined(batches):
            for size, at in _found(names, 2, longest, keep, True):
                if not len(at):
                    continue
                group, first = _groups(names, at, size)
                measures = {"a": np.bincount(group)}
                for column, side in (("b", names[at - 1]), ("n", names[at + size])):
                    low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
                    np.minimum.at(low, group, side)
                    np.maximum.at(high, group, side)
                    measures |= {f"{column}1": low, f"{column}2": high}
                yield from _sent(names, first, size, measures)

    parts = corpus.mapInArrow(work, "codes array<bigint>, a bigint, b1 bigint, b2 bigint, n1 bigint, n2 bigint")
    total = parts.groupBy("codes").agg(F.sum("a").alias("a"), F.min("b1").alias("b1"), F.max("b2").alias("b2"),
                                       F.min("n1").alias("n1"), F.max("n2").alias("n2"))
    same = ((F.col("b1") == F.col("b2")) & (F.col("b1") != 0)) | ((F.col("n1") == F.col("n2")) & (F.col("n1") != 0))
    return total.join(phrases, "codes", "left_semi").select("codes", "a", (~same).alias("alone"))


def scored(candidates: DataFrame, counts: DataFrame) -> DataFrame:
    """``codes``, ``a``, ``n`` with ``l``, ``r`` and ``score`` of the worst cut (ties: the first); products are decimals."""
    cuts = candidates.select("codes", "a", "n", F.explode(F.sequence(F.lit(1), F.size("codes") - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("codes", F.lit(1), F.col("k")).alias("left"),
                       F.slice("codes", F.col("k") + 1, F.size("codes") - F.col("k")).alias("right"))
    for side, out in (("left", "l"), ("right", "r")):
        own = counts.select(F.col("codes").alias(side), F.col("f").alias(out))
        cuts = spread_join(cuts, own, [side], "inner", HOT_ROWS, ["codes", "k"])
    big = "decimal(38,0)"
    score = F.expr(f"CAST(CAST(1000 AS {big}) * CAST(a AS decimal(19,0)) * CAST(n AS decimal(19,0)) "
                   "div (CAST(l AS decimal(19,0)) * CAST(r AS decimal(19,0))) AS bigint)")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("codes", "a", "n").agg(worst.alias("w")).select("codes", "a", "n", "w.l", "w.r", "w.score")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", longest: int = LONGEST, least: int = LEAST,
                 wanted: int = WANTED, growth: int = GROWTH) -> DataFrame:
    """The ``wanted`` best phrases of two to ``longest`` words per language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Phrases occur at least ``least`` times, overlaps included. One that stands inside a longer
    phrase of as many occurrences is left out. Ties of score go by ``a``, then by the phrase's
    bytes. Missing and empty texts have no words, texts without language are of language
    ``und``, repeated rows count each time; an empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    texts = _texts(docs, lang, text)
    every = stored(word_counts(texts), "word-counts")
    totals = stored(every.groupBy("lang").agg(F.sum("f").alias("n")), "word-totals")
    # Few rows of a wide shuffle are left here and below: ``rebalance`` keeps them from lying in a tiny file for each of its tasks.
    words = stored(every.groupBy("lang", "word", "name").agg(F.sum("f").alias("f")).where(F.col("f") >= least).hint("rebalance"), "words")
    one = F.array("name").alias("codes")
    corpus = stored(encoded(texts, sc.broadcast(bit_set(words.select(one)))), "names", "uncompressed", SMALL_GROUPS)
    known = words.select(one, "f")
    # Languages are few: one row each.
    open_ = totals
    low, high = least - 1, least * growth
    done: DataFrame | None = None
    while True:
        firsts = stored(words.join(F.broadcast(open_), "lang").where(f"f > {low} AND f <= {high}")
                        .select("name", "lang", "n"), "frontier")
        found = None
        prefixes, base = firsts.select(one), 1
        for upto in ([2, 3, longest] if longest > 3 else range(2, longest + 1)):
            new = stored(grown(corpus, sc.broadcast(bit_set(prefixes)), base, upto, least).hint("rebalance"), "grown")
            found = new if found is None else found.union(new)
            prefixes, base = new.where(F.size("codes") == upto).select("codes"), upto
        first = F.get("codes", F.lit(0)).alias("name")
        candidates = stored(spread_join(found.select("codes", "a", first), firsts, ["name"], "inner", HOT_ROWS, ["codes"]), "candidates")
        # Prefixes of a candidate are candidates, so with its suffixes all parts are there.
        parts = F.explode(F.transform(F.sequence(F.lit(1), F.size("codes") - 1),
                                      lambda k: F.slice("codes", k, F.size("codes") - k + 1))).alias("codes")
        needed = stored(candidates.select(parts).distinct(), "needed")
        counts = stored(measured(corpus, needed, sc.broadcast(bit_set(needed)), longest).hint("rebalance"), "counts")
        rated = scored(candidates.select("codes", "a", "n"), counts.select("codes", F.col("a").alias("f")).union(known))
        alone = (F.size("codes") == longest) | F.col("alone")
        kept = rated.join(counts.select("codes", "alone"), "codes").where(alone)
        kept = spread_join(kept.withColumn("name", F.get("codes", F.lit(0))), firsts.select("name", "lang"), ["name"], "inner", HOT_ROWS, ["codes"])
        kept = stored(kept.select("lang", "codes", "a", "l", "r", "n", "score"), "kept")
        done = kept if done is None else done.union(kept)
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
        done = stored(done.withColumn("k", F.rank().over(order)).where(F.col("k") <= wanted), "best").drop("k")
        last = done.groupBy("lang").agg(F.count(F.lit(1)).alias("k"), F.min("score").alias("last")).where(F.col("k") >= wanted)
        bound = F.expr(f"CAST(1000 AS decimal(20,0)) * n div {high + 1}")
        ends = words.groupBy("lang").agg(F.max("f").alias("top"))
        open_ = stored(open_.join(ends.where(F.col("top") > high).select("lang"), "lang").join(last, "lang", "left")
                       .where(F.col("last").isNull() | (F.col("last") <= bound)).select("lang", "n"), "open")
        if open_.isEmpty():
            break
        low, high = high, high * growth
    return _named(done, words, wanted)


def _named(best: DataFrame, words: DataFrame, wanted: int) -> DataFrame:
    """Spells the phrases and numbers them; few rows a language are left."""
    spelled = best.select("lang", "codes", F.posexplode("codes").alias("i", "name"))
    spelled = spread_join(spelled, words.select("name", F.col("word").cast("string").alias("word")), ["name"], "inner", HOT_ROWS, ["codes", "i"])
    pairs = F.array_sort(F.collect_list(F.struct("i", "word")))
    texts = spelled.groupBy("codes").agg(F.array_join(F.transform(pairs, lambda p: p["word"]), " ").alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (best.join(texts, "codes").withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= wanted)
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))

