"""Quality rules at host level.

Documents are measured one by one; rule failures are then added up by host (the domain
or source of a document), the hosts' failure rates are shrunk towards the corpus rate
with a beta prior fitted to all hosts, and the verdict on a host is joined back to its
documents. A host with few documents thus needs more evidence than a large one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import HOT_ROWS, texts_in_turn, unused
from crosstie.operators.joins import spread_join
from crosstie.session import stored

WINDOW = 5
# Fixed values of the base rules.
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
SYMBOLS = b"#*$%&|<>"
# Further rules, counted for the host only: symbols per hundred word characters, repeated lines per hundred lines.
MOST_SYMBOL_PERCENT = 25
MOST_DUP_LINE_PERCENT = 50
# Shrunken share of failing documents above which a host is rejected.
MOST_FAILING = 0.5

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # Name each window by the pair (name of its first words, next word): names stay exact, no hash is involved.
    names = codes[:n]
    for i in range(1, window):
        _, names = np.unique(names * len(ids) + codes[i:i + n], return_inverse=True)
    twice = np.bincount(names)[names] > 1
    if not twice.any():
        return 0
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(twice)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """The numbers of ``MEASURES`` for one whole text. Words are split at space and U+0009 to U+000D."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    chars = len(text) - (len(raw) - sum(map(len, words)))
    lines = [line for line in raw.split(b"\n") if line.split()]
    return (len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)),
            repeated_words(words), len(lines))


def measured(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """``doc_id``, ``host`` and the measures of every document, without the text."""
    ids = docs.schema[doc_id].dataType.simpleString()
    schema = f"doc_id {ids}, host string, t1 bigint, " + ", ".join(f"{m} bigint" for m in MEASURES)
    names = ["doc_id", "host", "t1", *MEASURES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in texts_in_turn(batch.column(3))]
            values = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *values], names)

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"),
                         F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("t1"), F.col(text).alias("text"))
    return narrow.mapInArrow(run, schema)


def base_failed():
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


def any_failed():
    return (base_failed() | (100 * F.col("n_symbols") > MOST_SYMBOL_PERCENT * F.col("word_chars"))
            | (100 * F.col("n_dup_lines") > MOST_DUP_LINE_PERCENT * F.col("n_lines")))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """Beta parameters by moments over all hosts (columns ``n``, ``bad``): four sums, one row.

    The spread of the host rates beyond what chance explains sets the strength. Without
    any spread, or with a corpus rate of 0 or 1, the prior is so strong that every host
    takes the corpus rate.
    """
    rate = F.col("bad") / F.col("n")
    s = hosts.agg(F.count(F.lit(1)).alias("h"), F.sum("n").alias("n"), F.sum("bad").alias("bad"),
                  F.sum(F.col("n").cast("double") * F.col("n")).alias("nn"), F.sum(F.col("n") * rate * rate).alias("pp")).first()
    if not s.n:
        return 1.0, 1.0
    m = s.bad / s.n
    spread = m * (1 - m)
    room = spread * (s.n - s.nn / s.n - (s.h - 1))
    rho = ((s.pp - s.n * m * m) - spread * (s.h - 1)) / room if room > 0 else 0.0
    strength = 1 / min(max(rho, 1e-6), 1 - 1e-6) - 1
    return m * strength, (1 - m) * strength


def host_verdicts(measures: DataFrame, most_failing: float = MOST_FAILING) -> DataFrame:
    """Per host: documents, failing ones, shrunken rate and whether the host is rejected.

    A host is rejected when its shrunken rate and its plain rate both exceed ``most_failing``,
    so a bad corpus does not condemn a clean host.
    """
    hosts = measures.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.count_if(any_failed()).alias("bad"))
    a, b = beta_prior(hosts)
    shrunk = (F.col("bad") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    return hosts.withColumn("host_rate", shrunk).withColumn(
        "host_rejected", (shrunk > most_failing) & (F.col("bad") / F.col("n") > most_failing))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text",
                  most_failing: float = MOST_FAILING) -> DataFrame:
    """Measures, base verdict, host verdict and ``kept`` of every document.

    A missing or empty text has no words and fails. Documents without host form one host of
    their own. Repeated rows are judged each; an empty table gives an empty result. Other
    columns of ``docs`` are ignored. ``t1`` is the hash of the text, for joins back.

    The measures are written once to the shared folder (they are narrow), so texts are read
    once. The join with the verdicts deals hot hosts over several tasks.
    """
    measures = stored(measured(docs, doc_id, host, text), "quality")
    verdicts = host_verdicts(measures, most_failing).select("host", "host_rate", "host_rejected")
    judged = spread_join(measures, verdicts, ["host"], "left", HOT_ROWS, ["doc_id", "t1"])
    return judged.withColumn("base_failed", base_failed()).withColumn(
        "kept", ~F.col("base_failed") & ~F.col("host_rejected"))


def kept_documents(docs: DataFrame, doc_id: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, all columns unchanged, whatever their names.

    Rows of equal id, host and text share their verdict, so repeated rows stay or go together.
    Missing and empty texts have too few words and go; missing ids and hosts are like others;
    texts are read whole; an empty table gives an empty result.
    """
    kept = quality_rules(docs, doc_id, host, text).where("kept").select("doc_id", "host", "t1")
    own, *right = unused(docs, "_t", "_id", "_host", "_t1")
    kept = kept.toDF(*right)
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    same = (rows[doc_id].eqNullSafe(kept[right[0]]) & rows[host].cast("string").eqNullSafe(kept[right[1]]) & (rows[own] == kept[right[2]]))
    return rows.join(kept, same, "left_semi").drop(own)
