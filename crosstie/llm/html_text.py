"""Main text of web pages: markup first, then a suffix array of each host's token streams.

Markup settles most blocks: what stands in an article is text; menus, footers, forms and
the like are not. The other blocks of a page (those without a telling element) are judged
by the host's suffix array: the token streams of its pages are concatenated, that of a page's frame (all
blocks outside of articles) and that of its articles, and a run of
tokens that begins in suffixes of two or more distinct pages with a common prefix of
``RUN`` tokens or more is boilerplate. Its tokens are removed, the unique runs stay; so does an article's text, repeated or not. A run that
reaches into a block from its neighbour by fewer than ``RUN`` tokens and ends there only
shares the block's first or last words with it; those stay.

A host may hold a third of all pages, so its suffix array is not built in one task. Suffixes are cut to their first
``RUN`` tokens; a longer run is a chain of such prefixes. Short keys of all suffixes of all pages are sorted bucket by bucket; those that
stand twice, and in a block to be judged, go into a bit set. The
suffixes it holds are shuffled by host and whole prefix. Equal
prefixes are then one interval of the array; the interval's least and greatest page tell
whether distinct pages share it, and both combine before the shuffle. What passes the bit set by chance forms no interval of distinct pages.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosstie.llm.common import HOT_ROWS, BitSet, bit_set, grouped, mixed, sorted_groups, texts_of
from crosstie.operators.joins import spread_join
from crosstie.session import discard, stored

RUN = 8
# Bits of a suffix's short key, keys that a task holds before it sends them, pages parsed at a time.
KEY_BITS, HELD, SLICE = 40, 1 << 21, 256
# Bytes of html whose suffixes make a bucket of sorted keys, and the least number of buckets.
BUCKET_BYTES, LEAST_BUCKETS = 8 << 20, 32
# Fixed values of the HTML vocabulary.
RAW = "script|style|template|noscript|iframe|svg|textarea|select|button|object|canvas|math"
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
          "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
IMPLIED_END = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "thead", "tbody", "tfoot"}
ARTICLE = {"article", "main"}
NEVER_TEXT = {"head", "nav", "footer", "aside", "form", "dialog", "menu"}
NEVER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "form", "menu", "menubar"}
# Names of classes and ids. Those of the layout may also stand for a page's frame, so an article inside wins over them.
NEVER_NAME = {"ad", "ads", "advert", "adverts", "advertisement", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie",
              "cookies", "disqus", "gdpr", "login", "modal", "newsletter", "notice", "popup", "promo", "related", "replies", "reply",
              "share", "sharing", "social", "sponsor", "sponsored", "subscribe"}
LAYOUT_NAME = {"banner", "footer", "header", "menu", "nav", "navbar", "navigation", "sidebar", "toolbar", "widget"}
# First parts of names that say how an element is laid out and not what it is; of an article's title; of reader comments.
HAS = {"has", "with", "no", "without", "is", "not", "show", "hide"}
TITLE = {"entry", "post", "article", "content"}
READERS = {"comment", "comments", "reply", "replies"}
MARKUP = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?:({RAW})\b[^>]*>.*?(?:</\1\s*>|\Z))|<(/?)([a-z][a-z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>"
    r"|<(/?)([a-z][a-z0-9:-]*)([^>]*)>|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|itemprop)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
NAME_PART = re.compile(r"[a-z]+")


def _named(value: str, tag: str, in_article: bool) -> str:
    """What the class names or the id of an element tell: ``out``, ``layout`` or nothing.

    A name counts as a whole or by its first or last part (``site-footer``, ``ad-slot``), but not
    where it describes a layout (``has-sidebar``); ``entry-header`` and the like are titles.
    """
    kind = ""
    for name in value.split():
        parts = NAME_PART.findall(name)
        if not parts or parts[0] in HAS:
            continue
        ends = {parts[0], parts[-1]}
        if tag in ARTICLE:
            if parts[0] in READERS:
                return "out"
        elif ends & NEVER_NAME:
            return "out"
        elif ends & LAYOUT_NAME and not (ends & {"header", "banner"} and (in_article or parts[0] in TITLE)):
            kind = "layout"
    return kind


def _kind(tag: str, attributes: str, in_article: bool) -> str:
    """``out`` for an element that is never text, ``layout`` for one that is not unless it holds an article, ``in`` for an article, else empty."""
    if tag in NEVER_TEXT or (tag == "header" and not in_article):
        return "out"
    kind = "in" if tag in ARTICLE else ""
    if attributes and tag not in ("html", "body"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values).lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value in NEVER_ROLE):
                return "out"
            if name in ("class", "id"):
                told = _named(value, tag, in_article)
                if told == "out":
                    return "out"
                kind = kind or told
            if (name == "role" and value == "main") or (name == "itemprop" and value == "articlebody"):
                kind = "in"
    return kind


def blocks(page: str) -> list[tuple[str, str]]:
    """The page's blocks in order as (zone, text): ``in`` an article, ``out``, or undecided (empty zone)."""
    found: list[tuple[str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, str]] = []
    zone, at = "", 0

    def close() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            found.append((zone, text))

    def settle() -> str:
        kinds = [k for _, k in stack if k]
        if not kinds or "out" in kinds:
            return "out" if kinds else ""
        return "in" if kinds[-1] == "in" else "out"

    for m in MARKUP.finditer(page):
        if m.start() > at:
            parts.append(page[at:m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag or tag in INLINE:
            continue
        close()
        if m[2] or m[5]:
            places = [i for i, (t, _) in enumerate(stack) if t == tag]
            if places:
                del stack[places[-1]:]
        elif tag not in VOID:
            if tag in IMPLIED_END and stack and stack[-1][0] == tag:
                stack.pop()
            elif stack and stack[-1][0] == "p":
                stack.pop()
            if not (m[4] or m[7] or "").endswith("/"):
                stack.append((tag, _kind(tag, m[4] or m[7] or "", zone == "in")))
        zone = settle()
    parts.append(page[at:])
    close()
    return found


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2] or (url or "")
    return re.split(r"[/?#]", rest, maxsplit=1)[0].rpartition("@")[2].lower()


class Parsed:
    """A page's article text (None without an article), its undecided blocks (only without) and its token streams.

    ``tokens`` holds the frame's stream (``cut`` tokens) and then the articles'; ``places`` the number of
    each token of the frame among the tokens of ``rest``, or -1.
    """

    def __init__(self, page: str, url: str | None):
        found = blocks(page)
        self.host = host_of(url)
        self.text = " ".join([t for z, t in found if z == "in"]) or None
        self.rest = [t for z, t in found if not z] if self.text is None else []
        self.tokens, self.places, n = [], [], 0
        for z, t in found:
            if z != "in":
                words = t.split(" ")
                mine = self.text is None and not z
                self.tokens += words
                self.places += range(n, n + len(words)) if mine else [-1] * len(words)
                n += len(words) * mine
        self.cut = len(self.tokens)
        if self.text is not None:
            self.tokens += self.text.split(" ")


def parsed_slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[Parsed]]]:
    """Some rows of a batch at a time (``html`` and ``url`` are its first columns), with their parsed form."""
    for i in range(0, batch.num_rows, SLICE):
        rows = batch.slice(i, SLICE)
        yield rows, [Parsed(p, u) for p, u in zip(texts_of(rows.column(0)), rows.column(1).to_pylist(), strict=True)]


def suffix_keys(pages: list[Parsed], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Short keys of the host and the first ``run`` tokens of all suffixes that have them, with their page's number and their first token's."""
    sizes = np.array([n for p in pages for n in (p.cut, len(p.tokens) - p.cut)], np.int64)
    codes = np.array([c for p in pages for c in map(xxhash.xxh3_64_intdigest, p.tokens)], np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(pages)), sizes.reshape(-1, 2).sum(axis=1))
    keys = np.array([xxhash.xxh3_64_intdigest(p.host) for p in pages], np.uint64)[owner]
    n = max(len(codes) - run + 1, 0)
    keys, owner = keys[:n], owner[:n]
    for j in range(run):
        keys = mixed(keys, codes[j:n + j])
    at = np.flatnonzero((np.repeat(ends, sizes) - np.arange(len(codes)))[:n] >= run)
    owner = owner[at]
    return keys[at] >> np.uint64(64 - KEY_BITS), owner, at - np.concatenate([[0], ends[1::2]])[owner]


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, by planes of bytes of which the high ones are nearly empty."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    return pa.compress(steps.view(np.uint8).reshape(-1, 8).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(n: int, data: bytes) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, 8 * n, codec="zstd", asbytes=True), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, n).T).view("<u8").ravel(), dtype=np.uint64)


def keys_found_twice(pages: DataFrame, run: int = RUN) -> DataFrame:
    """Short keys (``key``) of suffixes that stand in two or more places of a host's pages and in a block to be judged.

    All suffixes' keys are dealt over buckets by their first bits and sorted there.
    """
    size = pages.agg(F.sum(F.octet_length("html"))).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, 1 << (size // BUCKET_BYTES).bit_length())
    firsts = np.arange(n_buckets + 1, dtype=np.uint64) * np.uint64((1 << KEY_BITS) // n_buckets)
    names = ["bucket", "n", "keys", "asked"]

    def send(held: list[np.ndarray], asked: bool) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        if not asked:
            keys = np.repeat(keys, np.minimum(counts, 2))
        bounds = np.searchsorted(keys, firsts).tolist()
        rows = [(b, y - x, packed(keys[x:y]), asked) for b, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.binary(), pa.bool_()), strict=True)], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, asked, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], 0
        for batch in batches:
            for _, found in parsed_slices(batch):
                keys, owner, at = suffix_keys(found, run)
                # Pages with blocks to be judged have no article, so each of their tokens has a place.
                sizes = [len(p.places) if p.rest else 0 for p in found]
                firsts_of = np.cumsum([0, *sizes[:-1]])
                places = np.array([i for p in found if p.rest for i in p.places], np.int64)
                on = np.flatnonzero(np.array(sizes)[owner] > 0)
                held.append(keys)
                asked.append(keys[on[places[(firsts_of[owner] + at)[on]] >= 0]])
                n += len(keys)
                if n > HELD:
                    yield from send(held, False)
                    yield from send(asked, True)
                    held, asked, n = held[:1], asked[:1], 0
        yield from send(held, False)
        yield from send(asked, True)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in sorted_groups(batches, ["bucket"]):
            keys, asked = (np.sort(np.concatenate([np.zeros(0, np.uint64), *(unpacked(r["n"], r["keys"]) for r in rows if r["asked"] == a)])) for a in (False, True))
            yield pa.RecordBatch.from_arrays([pa.array(np.intersect1d(keys[1:][keys[1:] == keys[:-1]], asked).astype(np.int64))], ["key"])

    dealt = pages.select("html", "url").mapInArrow(deal, "bucket int, n bigint, keys binary, asked boolean")
    return grouped(dealt, ["bucket"]).mapInArrow(merge, "key bigint")


def parsed(pages: DataFrame, seen: tuple[int, dict[int, bytes]], run: int = RUN) -> DataFrame:
    """Each page's article text (missing without an article) and what its host's suffix array needs.

    ``rest`` holds the undecided blocks of a page without article, ``suffixes`` the hashes of
    the first ``run`` tokens of those suffixes of all its tokens that the bit set holds, ``places`` the
    number of such a suffix's first token among the tokens of ``rest``, or -1.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    names = ["page_id", "url", "page", "host", "text", "rest", "suffixes", "places"]
    schema = (f"page_id {kind}, url string, page bigint, host string, text string, rest array<string>, "
              "suffixes array<struct<g1:bigint,g2:bigint>>, places array<int>")
    gram = pa.struct([("g1", pa.int64()), ("g2", pa.int64())])

    def one(page: Parsed, begins: list[int]):
        hashes = [xxhash.xxh3_128_digest("\0".join(page.tokens[i:i + run])) for i in begins]
        pairs = [{"g1": int.from_bytes(h[:8], "little", signed=True), "g2": int.from_bytes(h[8:], "little", signed=True)} for h in hashes]
        # A run of the page counts from each of its places, those of other blocks serve as evidence only.
        return page.host, page.text, page.rest, pairs, [page.places[i] if i < page.cut else -1 for i in begins]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = BitSet(seen)
        for batch in batches:
            for rows, found in parsed_slices(batch):
                begins: list[list[int]] = [[] for _ in found]
                if seen[1]:
                    keys, owner, at = suffix_keys(found, run)
                    on = bits.has(mixed(np.uint64(0), keys))
                    for p, i in zip(owner[on].tolist(), at[on].tolist(), strict=True):
                        begins[p].append(i)
                host, text, rest, suffixes, places = zip(*map(one, found, begins), strict=True)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(2), rows.column(1), rows.column(3), pa.array(host, pa.string()), pa.array(text, pa.string()),
                     pa.array(rest, pa.list_(pa.string())), pa.array(suffixes, pa.list_(gram)), pa.array(places, pa.list_(pa.int32()))], names)

    return pages.select("html", "url", "page_id", "page").mapInArrow(work, schema)


def repeated_runs(pages: DataFrame) -> DataFrame:
    """Intervals of the hosts' suffix arrays that hold suffixes of two or more distinct pages (``host``, ``g1``, ``g2``)."""
    suffixes = pages.select("host", "page", F.explode("suffixes").alias("s")).select("host", "page", "s.g1", "s.g2")
    return (suffixes.groupBy("host", "g1", "g2").agg(F.min("page").alias("low"), F.max("page").alias("high"))
            .where("low < high").drop("low", "high"))


def unique_text(rest: list[str], begins: list[int], run: int = RUN) -> str:
    """The blocks' tokens outside of the runs of ``run`` tokens that begin at the given places.

    Of a block covered in part, stretches at its edges go only if they have ``run`` tokens of it.
    """
    n = sum(t.count(" ") + 1 for t in rest)
    gone = bytearray(n + run)
    for b in begins:
        gone[b:b + run] = b"\1" * run
    kept, at = [], 0
    for t in rest:
        words = t.split(" ")
        mine = gone[at:at + len(words)]
        at += len(words)
        head, tail = mine.find(0), len(words) - 1 - mine.rfind(0)
        if 0 < head < run:
            mine[:head] = bytes(head)
        if head >= 0 and 0 < tail < run:
            mine[-tail:] = bytes(tail)
        own = [w for w, g in zip(words, mine, strict=True) if not g]
        if own:
            kept.append(" ".join(own))
    return " ".join(kept)


def main_text(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", run: int = RUN) -> DataFrame:
    """``page_id``, ``url``, ``text`` and ``n_chars`` of every page.

    A missing or empty page has an empty text. Pages without url share one host; repeated rows
    count as one page and each gets the text. An empty table gives an empty result; other
    columns are ignored.
    """
    pages = pages.select(F.col(html).alias("html"), F.col(url).alias("url"), F.col(page_id).alias("page_id"), F.xxhash64(page_id, url, html).alias("page"))
    twice = stored(keys_found_twice(pages, run), "keys")
    seen = bit_set(twice.select(F.array("key").alias("key")))
    discard(twice)
    pages = stored(parsed(pages, seen, run), "parsed", "zstd")
    settled = pages.where(F.col("text").isNotNull()).select("page_id", "url", "text")
    open_pages = pages.where(F.col("text").isNull())
    own = (open_pages.select("page", "host", F.explode(F.arrays_zip("suffixes", "places")).alias("s"))
           .select("page", "host", "s.suffixes.g1", "s.suffixes.g2", "s.places").where("places >= 0").distinct())
    hits = spread_join(own, repeated_runs(pages), ["host", "g1", "g2"], "left_semi", HOT_ROWS, ["page", "places"])
    begins = hits.groupBy("page").agg(F.collect_list("places").alias("begins"))
    kind = pages.schema["page_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [unique_text(r or [], b or [], run) for r, b in
                     zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    judged = (open_pages.select("page", "page_id", "url", "rest").join(begins, "page", "left")
              .select("page_id", "url", "rest", "begins").mapInArrow(work, f"page_id {kind}, url string, text string"))
    return settled.unionByName(judged).withColumn("n_chars", F.length("text").cast("bigint"))
