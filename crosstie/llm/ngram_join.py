"""N-gram Jaccard join with Bayesian pruning of candidates.

Texts are sets of five-word shingles. Equal texts are one (a class with members); MinHash
bands find candidates; the MinHash values of a pair are then compared a few at a time, and
the pair is dropped as soon as the posterior probability that its Jaccard similarity
reaches the threshold is below the tolerance. What remains is verified on the shingles.

Pairs never leave a task: it returns, per text, the number of its links and the least text
linked with it, so the result of a bucket is as long as the bucket. A large bucket is cut
into chunks and each two chunks meet in a task of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import HOT_ROWS, grouped, sorted_groups, text_key, texts_of, unused
from crosstie.operators.joins import spread_join
from crosstie.session import stored

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
STEP = 16
# 20 bands of 4 values: a pair at the threshold misses all bands with probability 3e-5, at 0.9 with 5e-10.
BANDS, BAND_ROWS = 20, 4
TOLERANCE = 1e-6
CHUNK = 512
_RANDOM = np.random.default_rng(20_240_601)
_MULTIPLY = _RANDOM.integers(1, 1 << 63, HASHES, np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RANDOM.integers(0, 1 << 63, HASHES, np.uint64)
_PLACE = _RANDOM.integers(1, 1 << 63, SHINGLE, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; fewer words than five make one shingle."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.array([xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
    size = min(SHINGLE, len(words))
    n = len(words) - size + 1
    total = np.full(n, size, np.uint64)
    for i in range(size):
        total ^= codes[i:i + n] * _PLACE[i]
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(total ^ (total >> np.uint64(32)))


def minhash(items: np.ndarray) -> np.ndarray:
    least = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(items), 2048):
        mixed = items[i:i + 2048, None] * _MULTIPLY + _ADD
        least = np.minimum(least, (mixed >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return least


@lru_cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """Matches needed after each step of values for the pair to stay.

    With a uniform prior the similarity after m matches of n is Beta(m + 1, n - m + 1); its
    tail above the threshold is the chance of at most m successes in n + 1 trials.
    """
    needed = []
    for n in range(STEP, HASHES + 1, STEP):
        chance, tail, m = (1 - threshold) ** (n + 1), 0.0, 0
        while True:
            tail += chance
            if tail >= tolerance:
                break
            chance *= (n + 1 - m) / (m + 1) * threshold / (1 - threshold)
            m += 1
        needed.append(m)
    return tuple(needed)


def sketched(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id``, text hashes, number of shingles and the MinHash values of every row."""
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "t1", "t2", "n_shingles", "sketch"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t) for t in texts_of(batch.column(3))]
            sketches = [minhash(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array(sketches, pa.binary())], names)

    return (docs.select(F.col(doc_id).alias("doc_id"), *text_key(text), F.col(text).alias("text"))
            .mapInArrow(work, f"doc_id {kind}, t1 bigint, t2 bigint, n_shingles bigint, sketch binary"))


def buckets(texts: DataFrame) -> DataFrame:
    """Members (``band``, ``value``, ``n``, ``t1``, ``t2``) of the distinct buckets of two or more texts.

    Buckets of several bands with the same members (same number and same exclusive-or of
    their 128-bit keys) are one, that of the first band.
    """
    size = 4 * BAND_ROWS
    value = F.xxhash64(F.substr("sketch", F.col("band") * size + 1, F.lit(size)))
    bands = (texts.where(F.col("sketch").isNotNull()).withColumn("band", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
             .select("band", value.alias("value"), "t1", "t2"))
    sizes = (bands.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("t1").alias("x1"), F.bit_xor("t2").alias("x2"))
             .where("n > 1"))
    first = sizes.groupBy("n", "x1", "x2").agg(F.min(F.struct("band", "value")).alias("b")).select("b.band", "b.value", "n")
    return spread_join(bands, first, ["band", "value"], "inner", HOT_ROWS, ["t1", "t2"])


def chunk_pairs(members: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Members once for every two chunks (``a`` <= ``b``) of their bucket that they are part of, with their chunk ``c``."""
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = members.withColumn("k", chunks).withColumn("c", F.pmod(F.xxhash64("t2", "t1"), F.col("k")).cast("int"))
    every = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return every.select("band", "value", F.least("c", "o").alias("a"), F.greatest("c", "o").alias("b"), "c", "t1", "t2")


def links_in(sets: list[np.ndarray], sketches: np.ndarray, side: np.ndarray, band: int,
             threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links per member and its component's root, over the pairs whose first common band is ``band``.

    ``side`` tells the chunks apart; with two of them only pairs across count.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    names, ids = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    needed = least_matches(threshold, tolerance)
    before, own = sketches[:, :band * BAND_ROWS], sketches[:, band * BAND_ROWS:(band + 1) * BAND_ROWS]
    links, root = np.zeros(n, np.int64), np.arange(n)
    mark = np.zeros(len(names), np.int32)
    across = len(set(side.tolist())) > 1

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n - 1):
        other = np.arange(i + 1, n)
        if across:
            other = other[side[other] != side[i]]
        other = other[(own[other] == own[i]).all(axis=1)]
        if band and len(other):
            same = (before[other] == before[i]).reshape(len(other), band, BAND_ROWS).all(axis=2).any(axis=1)
            other = other[~same]
        matches = np.zeros(len(other), np.int64)
        for step, need in enumerate(needed):
            if not len(other):
                break
            part = slice(step * STEP, (step + 1) * STEP)
            matches = matches + (sketches[other, part] == sketches[i, part]).sum(axis=1)
            stay = matches >= need
            other, matches = other[stay], matches[stay]
        if not len(other):
            continue
        mine = ids[cuts[i]:cuts[i] + sizes[i]]
        mark[mine] = 1
        if len(other) * 4 > n:
            common = np.add.reduceat(mark[ids], cuts)[other]
        else:
            common = np.array([mark[ids[cuts[j]:cuts[j] + sizes[j]]].sum() for j in other])
        mark[mine] = 0
        for j in other[common >= threshold * (sizes[i] + sizes[other] - common) - 1e-9].tolist():
            links[i] += 1
            links[j] += 1
            low, high = sorted((find(i), find(j)))
            root[high] = low
    return links, np.array([find(i) for i in range(n)])


def compared(work: DataFrame) -> DataFrame:
    """Per text and bucket: its number of links and the least member linked with it (``r1``, ``r2``)."""
    names = ["t1", "t2", "links", "r1", "r2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (band, *_), rows in sorted_groups(batches, ["band", "value", "a", "b"]):
            rows.sort(key=lambda r: (r["t1"], r["t2"]))
            sets = [shingles(r["text"]) for r in rows]
            sketches = np.array([np.frombuffer(r["sketch"], np.uint32) for r in rows])
            links, root = links_in(sets, sketches, np.array([r["c"] for r in rows]), band)
            linked = np.flatnonzero(links).tolist()
            if linked:
                columns = [[rows[i]["t1"] for i in linked], [rows[i]["t2"] for i in linked], links[linked],
                           [rows[root[i]]["t1"] for i in linked], [rows[root[i]]["t2"] for i in linked]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return grouped(work, ["band", "value", "a", "b"]).mapInArrow(run, "t1 bigint, t2 bigint, links bigint, r1 bigint, r2 bigint")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and the least node (``label``) of its component, for undirected ``u``, ``v``.

    Labels take the least one of their neighbours and then the label of their label, until
    none changes; every round is written to the shared folder. Hubs are dealt out.
    """
    both = stored(edges.select("u", "v").union(edges.select("v", "u")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    while True:
        seen = spread_join(both.withColumnRenamed("v", "node"), labels, ["node"], "inner", HOT_ROWS, ["u"])
        near = seen.groupBy("u").agg(F.min("label").alias("near")).withColumnRenamed("u", "node")
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("old"),
                                                         F.least("label", F.coalesce("near", "label")).alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("next"))
        new = stored(spread_join(lower, jump, ["low"], "left", HOT_ROWS, ["node"])
                     .select("node", F.least("low", F.coalesce("next", "low")).alias("label"), "old"), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def jaccard_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``class_id`` (least id of its class), ``n_links`` and ``n_copies`` of every row, with the text hashes.

    Links join different texts with a Jaccard similarity of at least ``THRESHOLD``; classes
    are their connected components with all copies. ``n_copies`` counts the rows of the same
    text. Missing and empty texts have no shingles: they are copies of each other and have
    no links. Rows without id take part; a class of such rows only has no id. An empty table
    gives an empty result; other columns are ignored.
    """
    known = text_classes(docs, doc_id, text)
    ids = known.groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = spread_join(known, ids, ["label"], "left", HOT_ROWS, ["t1", "t2"]).select(
        "t1", "t2", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    keyed = docs.select(F.col(doc_id).alias("doc_id"), *text_key(text))
    return spread_join(keyed, classes, ["t1", "t2"], "left", HOT_ROWS, ["doc_id"])


def text_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every different text once: hashes ``t1``, ``t2``, least id ``rep``, ``n_copies``, ``n_links`` and its class ``label``.

    A label is the least text (hashes) of the class, so classes of texts without id, or of
    different texts with one id, stay apart.
    """
    rows = sketched(docs, doc_id, text)
    texts = stored(rows.groupBy("t1", "t2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n_copies"),
                                                F.first("sketch").alias("sketch")), "texts")
    members = stored(buckets(texts), "buckets")
    need = members.select("t1", "t2").distinct().join(texts.select("t1", "t2", "rep", "sketch"), ["t1", "t2"])
    whole = docs.select(F.col(doc_id).alias("rep"), *text_key(text), F.col(text).alias("text"))
    own = need["rep"].eqNullSafe(whole["rep"]) & (need["t1"] == whole["t1"]) & (need["t2"] == whole["t2"])
    found = whole.join(need, own).select(need["t1"], need["t2"], "sketch", "text").dropDuplicates(["t1", "t2"])
    linked = stored(compared(chunk_pairs(members).join(stored(found, "members"), ["t1", "t2"])), "links")
    degrees = linked.groupBy("t1", "t2").agg(F.sum("links").alias("n_links"))
    edges = linked.select(F.struct("t1", "t2").alias("u"), F.struct(F.col("r1").alias("t1"), F.col("r2").alias("t2")).alias("v"))
    labels = components(edges).select("node.t1", "node.t2", "label")
    known = (texts.select("t1", "t2", "rep", "n_copies").join(degrees, ["t1", "t2"], "left").join(labels, ["t1", "t2"], "left")
             .withColumn("label", F.coalesce("label", F.struct("t1", "t2"))))
    return stored(known, "known")


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without near-duplicates: of each class one row stays, all columns unchanged, whatever their names.

    It is the row of the least id of the class; a class without any id keeps its least text.
    Of rows with that id and text one stays. Missing and empty texts are copies of one another;
    texts are compared whole; an empty table gives an empty result.
    """
    names = docs.columns
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "t1", "t2")).alias("own")
    kept = text_classes(docs, doc_id, text).groupBy("label").agg(first).select("own.rep", "own.t1", "own.t2")
    t1, t2, rep, k1, k2 = unused(docs, "_t1", "_t2", "_rep", "_k1", "_k2")
    kept = kept.toDF(rep, k1, k2)
    own = text_key(text)
    rows = docs.withColumns({t1: own[0], t2: own[1]})
    same = rows[doc_id].eqNullSafe(kept[rep]) & (rows[t1] == kept[k1]) & (rows[t2] == kept[k2])
    found = rows.join(kept, same, "left_semi")
    return found.dropDuplicates([doc_id, t1, t2]).select(*[F.col(f"`{c}`") for c in names])
