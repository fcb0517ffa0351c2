"""Bounds of memory and shuffles, plain versions of fingerprints and markup rules."""

import collections
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from crosstie.llm import byte_bpe, common, html_text, order_minhash, packing, secret_scan, token_files, tokens, warc_zip

TEXTS = [f"text number {i} " + "word " * (i % 7) for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    common.importable(spark)
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string").repartition(3)


# Words that workers remember

def test_long_words_are_not_kept():
    known = byte_bpe.Known(len, most=100, longest=8)
    assert known["x" * 9] == 9 and not known
    for i in range(1000):
        assert known[f"w{i}"] == len(f"w{i}")
        assert sum(len(w) + 8 for w in known) <= 100 + 16


def test_common_words_are_encoded_once():
    """A full memory forgets what was not asked for lately, not all of it."""
    asked = []
    known = byte_bpe.Known(lambda w: asked.append(w) or w, most=400, longest=8)
    for i in range(500):
        assert known["the"] == "the" and known[f"w{i}"] == f"w{i}"
        assert sum(len(w) + 8 for w in {**known, **known.older}) <= 400 + 32
    assert asked.count("the") == 1 and len(asked) == 501


def test_short_ways_of_the_encoder_follow_the_library():
    """Letters with a mark behind them skip the pattern; ids are those of the whole pipeline."""
    for path, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        coder = tokens.Encoder(public_tokenizers.path(path), spaced)
        for w in ["tion", "tion.", "tion;", "é!", "Été?", "ĳ:", "ªº", "İx", "ŉ.", "ß", "a1.", "a..", "'s", "'s.", "x's", "s'", ".", "..", "a-b", "ab,c", "AB."]:
            for plain in (w, " " + w, w + " " + w):
                assert coder.encode(plain) == coder.whole([plain])[0], plain
            assert coder.split(w) == coder.pieces(w) and (not spaced or coder.split(" " + w) == coder.pieces(" " + w)), w


def test_pipeline_starts_one_set_of_python_workers(spark, docs):
    """Rows made from Python objects are read back by workers of their own, beside those of the operators."""
    df = spark.createDataFrame([(1, "password = abcdefgh1")], "doc_id bigint, text string")
    rows = secret_scan._keyed(df, "doc_id", "text").select("text", "key")
    grams = {0: [frozenset({"pas", "ass"})], 1: [frozenset({"tok"}), frozenset({"wor"})]}
    found = secret_scan.candidates(secret_scan.trigram_index(rows, ["ass", "pas", "tok", "wor"]), grams)
    assert [sorted(r.rules) for r in found.collect()] == [[0, 1]]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 1  # the test's own rows


def test_texts_with_unusual_space_are_not_kept():
    coder = byte_bpe.byte_bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    both = [coder, tokens.encoder(public_tokenizers.path("byte_bpe_50k.json"), True), tokens.encoder(public_tokenizers.path("word_bpe_49k.json"), False)]
    for c in both:
        c.encode("one  two " * 20_000 + "\n\n")
        c.encode("日本語" * 5000)
        assert max(map(len, c.known), default=0) <= byte_bpe.LONGEST_KNOWN


# Token files

def starts(rows):
    at, out = 0, {}
    for r in sorted(rows, key=lambda r: r.doc_id):
        out[r.doc_id] = at
        at += r.n_tokens
    return out


def test_file_limit_of_the_session_does_not_move_places(spark, docs):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", 5)
    try:
        found = token_files.round_trip(docs).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert len(found) == 60 and {r.doc_id: r.start for r in found} == starts(found)


def test_ranges_grow_with_the_texts(spark, docs):
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = sum(len(t) for t in TEXTS)
    assert token_files.n_ranges(docs) == parts
    assert token_files.n_ranges(docs, 20) == -(-size // 20) > parts
    assert token_files.n_ranges(docs.limit(0)) == parts


def test_equal_ids_are_dealt_over_ranges(spark, docs):
    same = docs.withColumn("doc_id", F.lit(1).cast("bigint"))
    rows = token_files.tokenized(same, public_tokenizers.path("byte_bpe_50k.json"), range_bytes=20)
    assert rows.select(F.spark_partition_id()).distinct().count() > 10
    found = token_files.round_trip(same).orderBy("start").collect()
    at = 0
    for r in found:
        assert r.start == at
        at += r.n_tokens


@pytest.mark.parametrize("most", [token_files.MOST_FILES, 0])
def test_reading_shuffles_no_ids(spark, docs, tmp_path, monkeypatch, most):
    monkeypatch.setattr(token_files, "MOST_FILES", most)
    path = str(tmp_path / "tokens")
    token_files.write_token_files(docs, path)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = token_files.read_token_files(spark, path)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        found = rows.select("doc_id", "start", "n_tokens").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert ("SortMergeJoin" in plan) == (most == 0)
    assert {r.doc_id: r.start for r in found} == starts(found)


# Packing

def test_second_round_in_several_tasks(spark, docs, monkeypatch):
    monkeypatch.setattr(packing, "SECOND_ROUND", 1)
    found = packing.pack(docs, length=16).collect()
    used = collections.defaultdict(list)
    for r in found:
        used[r.sequence_id].append((r.offset, r.length))
    for spans in used.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 16


# Packages

def test_packages_go_where_spark_writes(spark, tmp_path):
    assert warc_zip.qualified(spark, f"{tmp_path}/a b") == f"file://{tmp_path}/a%20b"
    assert warc_zip.qualified(spark, f"file:{tmp_path}/a") == f"file://{tmp_path}/a"
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    before = hadoop.get("fs.defaultFS")
    hadoop.set("fs.defaultFS", "viewfs://shared/")
    hadoop.set("fs.viewfs.mounttable.shared.link./scratch", f"file:{tmp_path}")
    try:
        assert warc_zip.qualified(spark, "/scratch/warc") == "viewfs://shared/scratch/warc"
    finally:
        hadoop.set("fs.defaultFS", before or "file:///")


# Markup

def zones(page):
    return [(z, t) for z, t in html_text.blocks(page)]


def test_names_count_whole():
    assert zones('<div class="layout has-sidebar"><article><p>Text</p></article></div>') == [("in", "Text")]
    assert zones('<article><div class="entry-header"><h1>Title</h1></div><p>Text</p></article>') == [("in", "Title"), ("in", "Text")]
    assert zones('<article><p>Text</p><div class="ad-slot">Buy</div><div id="share_buttons">Share</div></article>') == [
        ("in", "Text"), ("out", "Buy"), ("out", "Share")]
    assert zones('<div class="site-footer">Imprint</div><div class="adverse headers">Text</div>') == [("out", "Imprint"), ("", "Text")]


def test_an_inner_article_wins_over_the_frame_but_not_over_comments():
    assert zones('<div id="sidebar"><p>Aside</p><article><p>Text</p></article><p>More</p></div>') == [
        ("out", "Aside"), ("in", "Text"), ("out", "More")]
    assert zones('<article><p>Text</p><div class="sidebar">Links</div></article>') == [("in", "Text"), ("out", "Links")]
    assert zones('<aside><article>Teaser</article></aside><ol class="comment-list"><li><article>Me first</article></li></ol>') == [
        ("out", "Teaser"), ("out", "Me first")]
    assert zones('<article class="post">Text</article><article class="comment-body">I say</article>') == [("in", "Text"), ("out", "I say")]


# Order MinHash

def plain_signature(text, k=3, size=2):
    def chain(parts, seed=42):
        for p in parts:
            seed = xxhash.xxh64_intdigest(p, seed)
        return seed - (1 << 64) if seed >= 1 << 63 else seed

    def long(v):
        return v.to_bytes(8, "little", signed=True)

    low = (1 << 24) - 1
    words = [chain([w.encode()]) for w in re.findall(r"\S{1,16}", text, re.ASCII)]
    seen, bins = collections.Counter(), collections.defaultdict(list)
    for i in range(max(len(words) - k, 0) + 1 if words else 0):
        name = chain(map(long, words[i:i + k])) >> 24
        x = chain([long(name), seen[name].to_bytes(4, "little")])
        seen[name] += 1
        bins[(x % (1 << 64)) >> 59].append((x & ~low) | i)
    out = [None] * 32
    for b, own in bins.items():
        kept = sorted(sorted(own)[:size], key=lambda x: (x & low, x))
        out[b] = chain([long(x >> 24) for x in kept])
    return out


def test_signatures_equal_a_plain_version(spark):
    rng = random.Random(5)
    vocabulary = ["a", "b", "word", "été", "日本", "x" * 40, " ", "🙂"]
    texts = ["", " \n", "one", "one two"] + [" ".join(rng.choices(vocabulary[:rng.randrange(1, 9)], k=rng.randrange(1, 120))) for _ in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "i bigint, text string")
    found = df.select("i", order_minhash.signature(F.col("text")).alias("s")).collect()
    for r in found:
        assert r.s == plain_signature(texts[r.i]), texts[r.i]
    signs = [plain_signature(t) for t in texts]
    pairs = [(i, rng.randrange(len(texts))) for i in range(len(texts))]
    likes = spark.createDataFrame([(signs[i], signs[j]) for i, j in pairs], "a array<bigint>, b array<bigint>").select(
        order_minhash.likeness(F.col("a"), F.col("b")).alias("l")).collect()
    for (i, j), r in zip(pairs, likes, strict=True):
        used = [(x, y) for x, y in zip(signs[i], signs[j], strict=True) if x is not None or y is not None]
        assert r.l == (sum(x == y for x, y in used) / len(used) if used else 1.0)


# Suffix arrays of hosts

def plain_repeats(pages, run):
    """Of each page, the tokens of its frame in repeated runs, by sorted suffixes of whole streams and their common prefixes."""
    suffixes, repeated = collections.defaultdict(list), collections.defaultdict(set)
    for n, (_, url, page) in enumerate(pages):
        found = html_text.blocks(page)
        for framed in (True, False):
            tokens = [w for z, t in found if (z != "in") == framed for w in t.split(" ")]
            suffixes[html_text.host_of(url)] += [(tokens[i:], n, framed, i) for i in range(len(tokens))]
    for array in suffixes.values():
        group = []
        for s in [*sorted(array), ([], -1, False, 0)]:
            if group and (len(s[0]) < run or s[0][:run] != group[-1][0][:run]):
                if len({n for _, n, _, _ in group}) > 1:
                    for _, n, framed, i in group:
                        repeated[n, framed].update(range(i, i + run))
                group = []
            if len(s[0]) >= run:
                group.append(s)
    return repeated


def random_pages(seed=5):
    rng = random.Random(seed)
    parts = [" ".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(12)]
    pages = []
    for i in range(80):
        out = []
        for _ in range(rng.randrange(1, 4)):
            text = " ".join(rng.choices(parts, k=rng.randrange(1, 3)) + rng.choices("abcdefgh", k=rng.randrange(4)))
            out.append(("<article>%s</article><nav>%s</nav>" % (text, text[:9]) if i % 2 else "<div>%s</div>" % text))
        pages.append((i, f"http://h{i % 3}.example/{i}", "".join(out)))
    return pages


def test_all_tokens_enter_the_suffix_arrays_of_their_hosts(spark):
    common.importable(spark)
    pages, run = random_pages(), 6
    repeated = plain_repeats(pages, run)
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5)
    found = {r.page_id: r.text for r in html_text.main_text(df, run=run).collect()}
    cut = 0
    for n, (i, _, page) in enumerate(pages):
        rest, gone = [t for _, t in html_text.blocks(page)], repeated[n, True]
        if i % 2:
            assert found[i] == " ".join(t for z, t in html_text.blocks(page) if z == "in")
        else:
            assert found[i] == html_text.unique_text(rest, [p for p in gone if set(range(p, p + run)) <= gone], run)
            cut += found[i] != " ".join(rest)
    assert 10 < cut < 40 and len(found) == len(pages)


def test_articles_are_evidence_and_stay_whole(spark):
    common.importable(spark)
    passage = "one two three four five six seven eight nine"
    pages = [(i, f"http://h.example/{i}", f"<nav>Home</nav><article><p>{w}</p><p>{passage}</p></article>") for i, w in enumerate(["Red", "Blue"])]
    pages += [(2, "http://h.example/2", f"<div>Own words</div><div>{passage}</div>"), (3, "http://other.example/", f"<div>{passage}</div>")] * 2
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    assert sorted((r.page_id, r.text) for r in html_text.main_text(df).collect()) == [
        (0, f"Red {passage}"), (1, f"Blue {passage}"), (2, "Own words"), (2, "Own words"), (3, passage), (3, passage)]


def test_keys_are_unpacked_as_packed():
    for keys in ([], [0], [0, 0, 5, 1 << 39, 1 << 39]):
        keys = np.array(keys, np.uint64)
        assert (html_text.unpacked(len(keys), html_text.packed(keys)) == keys).all()
