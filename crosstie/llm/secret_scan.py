"""Secret scanning over a trigram inverted index, with DataFrame functions only.

From each rule's regular expression follows a Boolean query of the trigrams that a match
must contain. The index lists, block by block, the documents of each of these trigrams;
the postings are intersected and united as the query says, and only the documents that
remain are searched with the expression. A rule without mandatory trigrams is searched for
in every document.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as ops
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import text_key, unused

# Documents per block of the index, on average: bounds the postings that meet in one row.
BLOCK_DOCS = 4096
# Alternatives of a query; an expression with more has no useful trigrams.
MOST_ALTERNATIVES = 256


@dataclass(frozen=True)
class Rule:
    """``pattern`` is read by Java on Spark; a match counts when group ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, in their order.
BASE_RULES = [
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    # Runs are taken whole, so a bound inside the expression is the same as one on the match.
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
]
MORE_RULES = [
    Rule("private_key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[opsu]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abps]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[A-Za-z]{2,12}://[^\s/:@]{1,64}:[^\s/:@]{3,64}@[A-Za-z0-9.-]+"),
]
RULES = BASE_RULES + MORE_RULES


def _grams(run: str) -> frozenset[str]:
    return frozenset(run[i:i + 3] for i in range(len(run) - 2))


def _step(states: set, op, arg) -> set:
    """Follow one element of an expression. A state is (trigrams so far, literal run that may go on)."""
    cut = {(grams | _grams(run), "") for grams, run in states}
    if op is ops.LITERAL:
        return {(grams, run + chr(arg).lower()) for grams, run in states}
    if op is ops.IN and len(arg) <= 4 and all(o is ops.LITERAL for o, _ in arg):
        return {s for _, c in arg for s in _step(states, ops.LITERAL, c)}
    if op is ops.SUBPATTERN:
        return _walk(states, arg[3])
    if op is ops.BRANCH:
        return {s for part in arg[1] for s in _walk(states, part)}
    if op is ops.MAX_REPEAT:
        least, most, part = arg
        if most == 1:
            return states | _walk(states, part)
        if least == 0:
            return cut
        once = _walk(states, part)
        return {(grams | _grams(run), "") for grams, run in once}
    return cut


def _walk(states: set, parts) -> set:
    for op, arg in parts:
        states = _step(states, op, arg)
        if len(states) > MOST_ALTERNATIVES:
            return {(frozenset(), "")}
    return states


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Alternatives of lower-case trigrams, one of which every match contains in full; None if a match needs none."""
    states = _walk({(frozenset(), "")}, parser.parse(re.sub(r"^\(\?i\)", "", pattern)))
    found = {grams | _grams(run) for grams, run in states}
    if frozenset() in found:
        return None
    return sorted((f for f in found if not any(g < f for g in found)), key=sorted)


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(doc_id).alias("doc_id"), whole.alias("text"), F.xxhash64(F.col(doc_id), whole).alias("key"))


def trigram_index(rows: DataFrame, trigrams: list[str], block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Postings (``block``, ``gram``, ``keys``) of the given trigrams over all rows (``text``, ``key``).

    A key stands for a row's id and text; equal rows share one, and a posting lists it once.
    The blocks follow the keys' hash, so no posting grows beyond a block.
    """
    blocks = max(1, -(-rows.count() // block_docs))
    low = F.lower("text")
    grams = F.array_compact(F.array(*[F.when(F.contains(low, F.lit(g)), F.lit(g)) for g in trigrams]))
    return (rows.select("key", F.explode(grams).alias("gram"))
            .groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.collect_set("key").alias("keys")))


def candidates(index: DataFrame, queries: dict[int, list[frozenset[str]]]) -> DataFrame:
    """``key`` and the numbers of the rules (``rules``) whose trigram query it meets.

    Per block, rule and alternative the postings of all its trigrams are intersected; the
    alternatives of a rule are united. The queries are a table of the program's own rules.
    """
    wanted = [F.struct(F.lit(n).alias("rule"), F.lit(alt).alias("alt"), F.lit(gram).alias("gram"), F.lit(len(grams)).alias("need"))
              for n, q in queries.items() for alt, grams in enumerate(q) for gram in sorted(grams)]
    # A list of literals: rows made from Python objects would start a second set of Python workers beside that of the other stages.
    table = index.sparkSession.range(1).select(F.inline(F.array(*wanted)))
    lists = (index.join(F.broadcast(table), "gram").groupBy("block", "rule", "alt")
             .agg(F.collect_list("keys").alias("lists"), F.first("need").alias("need")).where(F.size("lists") == F.col("need")))
    common = F.aggregate(F.slice("lists", 2, F.col("need")), F.get("lists", F.lit(0)), F.array_intersect)
    return lists.select("rule", F.explode(common).alias("key")).groupBy("key").agg(F.collect_set("rule").alias("rules"))


def _found(rule: Rule, number: int) -> Column:
    """All counting matches as (start, number, end) in code points.

    Splitting at the matches gives the text between them; adding up the lengths of both gives
    the places.
    """
    pattern = F.lit(rule.pattern)
    text = F.col("text")
    parts = F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("match"),
                         F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("body"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,rule:int,end:int>>").alias("spans"))

    def step(acc: Column, part: Column) -> Column:
        begin = acc["at"] + F.length(part["gap"])
        end = begin + F.length(F.coalesce(part["match"], F.lit("")))
        span = F.struct(begin.alias("start"), F.lit(number).alias("rule"), end.alias("end"))
        counts = F.coalesce(F.length(part["body"]), F.lit(-1)) >= rule.least
        return F.struct(end.alias("at"), F.when(counts, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(parts, start, step)["spans"]


def secret_spans(docs: DataFrame, rules: list[Rule] | None = None, doc_id: str = "doc_id", text: str = "text",
                 block_docs: int = BLOCK_DOCS) -> DataFrame:
    """Every row's ``doc_id``, ``text`` (missing: empty), and ``found``: its spans by start, then rule.

    Rows without secrets, with missing ids and repeated rows are all returned; an empty table
    gives an empty result; other columns are ignored. Documents meet their candidacy by a
    key that differs from row to row, so large groups of copies do not meet in one task
    (unless their ids are equal as well).
    """
    rules = rules or RULES
    rows = _keyed(docs, doc_id, text)
    queries = {n: trigram_query(r.pattern) for n, r in enumerate(rules)}
    some = {n: q for n, q in queries.items() if q is not None}
    none = F.array().cast("array<struct<start:int,rule:int,end:int>>")
    if some:
        grams = sorted({g for q in some.values() for conj in q for g in conj})
        rows = rows.join(candidates(trigram_index(rows, grams, block_docs), some), "key", "left")
    else:
        rows = rows.withColumn("rules", F.array().cast("array<int>"))
    per_rule = [F.when(F.coalesce(F.array_contains("rules", n), F.lit(False)) if n in some else F.col("text").rlike(r.pattern),
                       _found(r, n)).otherwise(none) for n, r in enumerate(rules)]
    return rows.select("doc_id", "text", F.array_sort(F.concat(*per_rule)).alias("found"))


def span_list(spans: Column, rules: list[Rule]) -> Column:
    """``kind:start:end`` joined by commas."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(kinds, s["rule"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and the list of all spans."""
    spans = secret_spans(docs, RULES, doc_id, text)

    def n(rule: int) -> Column:
        return F.size(F.filter("found", lambda s: s["rule"] == rule)).cast("bigint")

    base = F.filter("found", lambda s: s["rule"] < len(BASE_RULES))
    return spans.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
                        F.sha2(span_list(base, RULES), 256).alias("base_sha256"), span_list(F.col("found"), RULES).alias("spans"))


def masked(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", mask: str = "[secret]") -> DataFrame:
    """``docs`` with every found span replaced by ``mask``; all other columns stay as they are.

    Overlapping spans are replaced as one. A missing text stays missing, an empty one empty;
    texts are read whole; rows without id and repeated rows are masked each; an empty table
    gives an empty result; extra columns may have any names.
    """
    t1, t2 = text_key(text)
    spans = secret_spans(docs.select(doc_id, text), None, doc_id, text).where(F.size("found") > 0)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr("text", acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        joined = s["start"] < acc["at"]
        parts = F.when(joined, acc["parts"]).otherwise(F.concat(acc["parts"], F.array(gap, F.lit(mask))))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), parts.alias("parts"))

    def end(acc: Column) -> Column:
        rest = F.substr("text", acc["at"] + 1, F.length("text"))
        return F.concat(F.array_join(acc["parts"], ""), rest)

    o1, o2, *right = unused(docs, "_t1", "_t2", "_id", "_k1", "_k2", "_clean")
    clean = spans.select("doc_id", *text_key("text"), F.aggregate("found", start, step, end).alias("clean"))
    clean = clean.groupBy("doc_id", "t1", "t2").agg(F.first("clean")).toDF(*right)
    keyed = docs.withColumns({o1: t1, o2: t2})
    id_, k1, k2, new = (clean[c] for c in right)
    joined = keyed.join(clean, keyed[doc_id].eqNullSafe(id_) & (keyed[o1] == k1) & (keyed[o2] == k2), "left")
    return joined.select(*[F.coalesce(new, keyed[f"`{c}`"]).alias(c) if c == text else keyed[f"`{c}`"] for c in docs.columns])
