"""Order MinHash fingerprints of texts, with DataFrame functions only.

Words (runs of up to 16 characters other than white space) make k-mers, which are numbered
by occurrence, so that repeats count. A hash of k-mer and number deals them over bins; of
each bin the ``TUPLE`` least are kept, put back into text order and hashed as a tuple. Two
texts agree in a bin when they share its least k-mers in the same order, which makes the
share of agreeing bins sensitive to moves and edits and not only to the set of k-mers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 3
TUPLE = 2
BIN_BITS = 5
BINS = 1 << BIN_BITS
# The place of a k-mer takes the low bits of a hash; later places in longer texts wrap around.
PLACE_BITS = 24
PLACES = (1 << PLACE_BITS) - 1


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _with_place(hashed: Column, place: Column) -> Column:
    return hashed.bitwiseAND(F.lit(~PLACES)).bitwiseOR(place.cast("bigint").bitwiseAND(F.lit(PLACES)))


def _name(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _occurrences(packed: Column) -> Column:
    """How many equal k-mers stand before each one, for a sorted array of (k-mer, place).

    The start of each run of equal ones is spread over the run by taking maxima at doubling
    distances.
    """
    def starts(a: Column) -> Column:
        return F.transform(a, lambda x, i: F.when((i > 0) & (_name(F.get(a, i - 1)) == _name(x)), 0).otherwise(i))

    def spread(a: Column) -> Column:
        steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(a).cast("double") + 1)).cast("int"))
        return F.aggregate(steps, starts(a), lambda acc, j: _let(acc, lambda s: F.transform(
            s, lambda x, i: F.greatest(x, F.coalesce(F.get(s, i - F.pow(F.lit(2.0), j).cast("int")), F.lit(0))))))

    return _let(packed, lambda a: F.transform(spread(a), lambda x, i: i - x))


def signature(text: Column, k: int = K, size: int = TUPLE) -> Column:
    """``BINS`` hashes; a bin without k-mers is missing. A text of fewer than k words is one k-mer, an empty text none."""
    words = F.transform(F.regexp_extract_all(text, F.lit(r"\S{1,16}"), F.lit(0)), lambda w: F.xxhash64(w))

    def kmers(w: Column) -> Column:
        last = F.greatest(F.size(w) - k, F.lit(0))
        places = F.when(F.size(w) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: _with_place(F.xxhash64(*[F.get(w, i + j) for j in range(k)]), i))

    def hashed(a: Column) -> Column:
        repeats = F.exists(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))),
                           lambda i: _name(F.get(a, i)) == _name(F.get(a, i - 1)))
        plain = F.transform(a, lambda x: _with_place(F.xxhash64(_name(x), F.lit(0)), x))
        numbered = F.zip_with(a, _occurrences(a), lambda x, n: _with_place(F.xxhash64(_name(x), n), x))
        return F.when(F.coalesce(repeats, F.lit(False)), numbered).otherwise(plain)

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - BIN_BITS)

    def least(a: Column) -> Column:
        return F.filter(a, lambda x, i: (i < size) | (bin_of(F.get(a, i - size)) != bin_of(x)))

    def tuples(a: Column) -> Column:
        in_order = F.array_sort(F.transform(a, lambda x: F.struct(x.bitwiseAND(F.lit(PLACES)).alias("place"), x.alias("x"))))
        return _let(in_order, lambda s: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: _let(
            F.filter(s, lambda e: bin_of(e["x"]) == b),
            lambda own: F.when(F.size(own) > 0, F.xxhash64(F.transform(own, lambda e: _name(e["x"])))))))

    return _let(words, lambda w: _let(F.sort_array(kmers(w)), lambda a: _let(
        F.sort_array(hashed(a)), lambda h: tuples(least(h)))))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bins among those that either text has; 1 for two texts without words."""
    used = F.size(F.filter(F.zip_with(a, b, lambda x, y: x.isNotNull() | y.isNotNull()), lambda u: u))
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), lambda e: e))
    return F.when(used == 0, 1.0).otherwise(same / used).cast("double")


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.coalesce(F.lower(F.lpad(F.hex(x), 16, "0")), F.lit("-"))), ".")


def in_slices(docs: DataFrame) -> DataFrame:
    """Rows (``doc_id``, ``text``, ``t1``) with a slice of the id range, and each slice's following row as a guest.

    The slices are cut at approximate quantiles, a number per slice; there are twice as many
    as shuffle partitions. The first row of a slice (in descending order) follows the last
    row of the next higher slice that has rows; that of the highest follows the very last row.
    """
    slices = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.approxQuantile("doc_id", [i / slices for i in range(1, slices)], 0.25 / slices)))
    edges = F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<double>")
    rows = docs.withColumn("slice", F.size(F.filter(edges, lambda e: e < F.col("doc_id"))))
    first = rows.groupBy("slice").agg(F.max_by(F.struct("doc_id", "text", "t1"), F.struct("doc_id", "t1")).alias("row"))
    above, lowest = F.lead("slice").over(Window.orderBy("slice")), F.min("slice").over(Window.partitionBy())
    guests = first.select("row.*", F.coalesce(above, lowest).alias("slice"), F.lit(True).alias("guest"))
    return rows.withColumn("guest", F.lit(False)).unionByName(guests)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and likenesses to that form and to the next text.

    The edited form replaces the last third of a text by the beginning of the next document
    in descending id order; the first follows the last. Missing texts are empty, missing
    ids come last, rows of one id are ordered by the hash of their texts. An only document
    is its own next. An empty table gives an empty result; other columns are ignored.

    The texts are shuffled once, by slices of the id range.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = in_slices(docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.xxhash64(whole).alias("t1")))
    order = Window.partitionBy("slice").orderBy(F.col("guest"), F.desc_nulls_last("doc_id"), F.desc("t1"))
    rows = rows.withColumn("next_text", F.lead("text").over(order))
    n, cut = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr("next_text", F.lit(1), cut))
    rows = rows.withColumn("edited", F.coalesce(edited, F.lit("")))
    rows = rows.select("doc_id", "slice", "guest", "t1", n.cast("bigint").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
                       signature(F.col("text")).alias("sig"), signature(F.col("edited")).alias("edited_sig"))
    rows = rows.withColumn("next_sig", F.lead("sig").over(order)).where(~F.col("guest"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"),
                       as_text(F.col("edited_sig")).alias("edited_fingerprint"),
                       likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"),
                       likeness(F.col("sig"), F.col("next_sig")).alias("near_next"))
