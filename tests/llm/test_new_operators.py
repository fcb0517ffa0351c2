"""Centroid clustering, collocations and decontamination against plain versions, on odd rows and empty tables."""

import collections
import hashlib
import math
import random
import re
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from crosstie.llm import centroids, collocations, common, decontaminate
from crosstie.session import stored


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    common.importable(spark)


def upper_down(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


# Centroids

def plain_clusters(vectors, dims=64, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(x)) for x in e]) for i, e in vectors
            if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) for x in e)]
    if not kept:
        return []
    named = sorted((i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    x, c = np.array([v for _, v in kept], np.int64), np.array([v for *_, v in named[:k]], np.int64)
    for r in range(rounds + 1):
        d = np.stack([((x - y) ** 2).sum(axis=1) for y in c], axis=1)
        own = d.argmin(axis=1)
        if r < rounds:
            c = np.array([[int(s) // int((own == j).sum()) for s in x[own == j].sum(axis=0)] if (own == j).any() else c[j] for j in range(len(c))])
    d = d.min(axis=1)
    return [(i, int(j), int(y), int(d[own == j].sum()), int(d.sum()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())
            for (i, _), j, y in zip(kept, own, d, strict=True)]


def odd_vectors(n=300, seed=4):
    rng = random.Random(seed)
    made = [[rng.choice((-1.5, 0.25, 2.0)) + rng.gauss(0, 0.3) for _ in range(64)] for _ in range(n)]
    bad = [None, [], made[0][:63], made[1] + [0.0], [*made[2][:63], None], [*made[3][:63], math.nan], [*made[4][:63], math.inf]]
    same = [[0.5] * 64] * 40
    return [*enumerate(made + bad + same), (None, made[5]), (None, made[6]), (7, made[7]), (7, made[8]), (10 ** 6, [-1e5] * 64)]


def test_clusters_equal_plain_ones(spark):
    data = [(i, None if e is None else e, 1, "x") for i, e in odd_vectors()]
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>, block int, cluster string")
    found = collections.Counter(map(tuple, centroids.report(df).collect()))
    assert found == collections.Counter(plain_clusters([(i, e) for i, e, *_ in data]))
    assert centroids.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("block, chunk", [(64, 7), (10, 50)])
def test_shards_do_not_change_the_clusters(spark, block, chunk):
    data = odd_vectors(120, 9)
    df = spark.createDataFrame(data, "vec_id bigint, embedding array<double>")
    found, _ = centroids.clusters(df, block=block, chunk=chunk)
    assert collections.Counter(map(tuple, found.collect())) == collections.Counter(r[:3] for r in plain_clusters(data))


def test_few_vectors_and_text_ids(spark):
    df = spark.createDataFrame([("a", [0.0] * 64), ("b", [1.0] * 64)], "vec_id string, embedding array<float>")
    assert {r.vec_id: r.distance for r in centroids.report(df).collect()} == {"a": 0, "b": 0}


def test_huge_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64)], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="would not fit in 64 bits"):
        centroids.report(df)


def test_tiles_are_not_shuffled_again(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = centroids.stored(centroids.integer_vectors(spark.createDataFrame(odd_vectors(), "vec_id bigint, embedding array<double>")), "vectors")
        table = centroids.tiles(rows)
        centres = centroids.stored(centroids.first_centroids(rows), "centroids")
        nearest = centroids.stored(centroids.assigned(table, centres, True), "nearest")
        plan = centroids.moved(table, centres, nearest, 4)._jdf.queryExecution().optimizedPlan()
        physical = centroids.moved(table, centres, nearest, 4)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Exchanges: assignments, sums, the two sides of the last join; none above the tiles' scan.
    assert plan is not None and "Bucketed: true" in physical
    above = physical[:physical.index("Bucketed: true")].splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
    scan = above[-1]
    path, level = [], depth(scan)
    for line in reversed(above[:-1]):
        if depth(line) < level:
            path.append(line)
            level = depth(line)
    upto = next(i for i, line in enumerate(path) if "Join" in line)
    assert not any("Exchange" in line for line in path[:upto])


# Collocations

def plain_phrases(rows, least=100, wanted=2000, longest=5):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, t in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", upper_down(t)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            f[lang or "und"].update(tuple(w[i:i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        long = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = {q[i:i + m] for q, a in long.items() for m in range(2, len(q)) for i in range(len(q) - m + 1) if a >= long[q[i:i + m]]}
        rated = []
        for p in long.keys() - inside:
            score, k = min((1000 * c[p] * n[lang] // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rated.append((-score, -c[p], " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rated)[:wanted], 1)]  # noqa: E741
    return out


def phrase_rows(seed=3):
    rng = random.Random(seed)
    words = ["The", "of", "Ä", "ä", "in\x1cx", "new", "york", "city", "a", "b", " ", "z-z"]
    rows = []
    for i in range(150):
        text = "".join(rng.choices(words, range(len(words), 0, -1))[0] + rng.choice((" ", " ", " ", "  ", "\t", ". ", "\n", ";", "!? ")) for _ in range(rng.randrange(60)))
        rows.append((rng.choice(("en", "en", None, "de")), f"{text} new york city hall {'x ' * (i % 9)}", i, "clash"))
    return [*rows, ("en", None, 0, ""), (None, "", 0, ""), ("fr", " . ", 0, ""), ("en", "lonely", 0, ""), rows[0], rows[0]]


@pytest.mark.parametrize("least, wanted, growth", [(3, 2000, 32), (3, 12, 8)])
def test_phrases_equal_plain_ones(spark, least, wanted, growth):
    rows = phrase_rows()
    df = spark.createDataFrame(rows, "lang string, text string, name bigint, codes string")
    found = collocations.collocations(df, least=least, wanted=wanted, growth=growth).collect()
    assert sorted(map(tuple, found)) == sorted(plain_phrases([r[:2] for r in rows], least, wanted))
    assert found


def test_scans_hold_little_at_once(spark):
    """The stored names are small, in small row groups, and come back as they were; phrases leave a task in small batches."""
    lines = [" ".join(f"w{(i * j) % 97}" for j in range(60)) for i in range(3000)]
    texts = spark.createDataFrame([("en", "\n".join(lines[i % 7:])) for i in range(40)], "lang string, text string").coalesce(1)
    sc = spark.sparkContext
    one = collocations.word_counts(texts).select(F.array("name").alias("codes")).distinct()
    corpus = stored(collocations.encoded(texts, sc.broadcast(common.bit_set(one))), "names", "uncompressed", collocations.SMALL_GROUPS)
    (file,) = Path(corpus.scratch.removeprefix("file:")).glob("*.parquet")
    rows = pq.read_table(file)
    names = list(collocations.unpacked(rows.to_batches()))
    n = sum(int(np.count_nonzero(x)) for x in names)
    assert n == sum(60 * (3000 - i % 7) for i in range(40))
    assert 4 * rows.column("names").nbytes < 8 * n
    found = collocations.grown(corpus, sc.broadcast(common.bit_set(one)), 1, 2, 1).collect()
    assert sum(r.a for r in found) == n - n // 60
    groups = pq.ParquetFile(file).metadata
    assert all(groups.row_group(i).total_byte_size < 3 * collocations.SMALL_GROUPS["parquet.block.size"] for i in range(groups.num_row_groups))

    many = np.arange(1, 2 * collocations.MOST_SENT + 10)
    sent = list(collocations._sent(many, np.arange(len(many) - 1), 2, {"a": many[:-1]}))
    assert max(b.num_rows for b in sent) <= collocations.MOST_SENT
    assert [r for b in sent for r in b.to_pylist()] == [{"codes": [i, i + 1], "a": i} for i in many[:-1].tolist()]


def test_no_phrases(spark):
    df = spark.createDataFrame([("en", "few words"), (None, None)], "lang string, text string")
    assert collocations.collocations(df).count() == 0
    assert collocations.collocations(df.limit(0)).count() == 0


def test_large_products_are_exact(spark):
    a, n, left, right = 3 * 10 ** 9 + 7, 9 * 10 ** 17 + 1, 3 * 10 ** 9 + 11, 4 * 10 ** 9 + 1
    cands = spark.createDataFrame([([1, 2], a, n)], "codes array<bigint>, a bigint, n bigint")
    counts = spark.createDataFrame([([1], left), ([2], right)], "codes array<bigint>, f bigint")
    assert collocations.scored(cands, counts).first().score == 1000 * a * n // (left * right)


def test_bounds_hold_for_all_extensions():
    """No phrase scores over 1000 n / f of its first word: what the frontier relies on."""
    rows = [r[:2] for r in phrase_rows(8)]
    first = collections.Counter()
    for lang, t in rows:
        first.update((lang or "und", w) for w in re.findall(r"[^\x20\x09.,;:!?\x0a-\x0d]+", upper_down(t)))
    for lang, _, p, *_, n, score in plain_phrases(rows, 2):
        assert score <= 1000 * n // first[lang, p.split(" ")[0]]


# Decontamination

def plain_hits(docs, items, window=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", upper_down(t))
    windows = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k:k + window])].add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for size in {len(p) for p in windows}:
            for k in range(len(w) - size + 1):
                if own := windows.get(tuple(w[k:k + size])):
                    hit.update(range(k, k + size))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def leak_tables(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcé9", k=rng.randrange(1, 4)))
    text = lambda n: "".join(word() + rng.choice((" ", ", ", "-", "\n", "_")) for _ in range(n))
    items = [(i, text(rng.randrange(30))) for i in range(30)] + [(40, "One"), (41, "Two words!"), (42, None), (43, ""), (44, "--"), (None, text(12)),
                                                                  (7, "seven Again"), (45, "日本 語 É")]
    items += [items[3], (50, items[4][1])]
    docs = []
    for i in range(60):
        parts = [text(20)] + [items[rng.randrange(len(items))][1] or "" for _ in range(i % 4)] + [text(8)]
        docs.append((i, " ".join(parts).upper() if i % 5 == 0 else "; ".join(parts)))
    docs += [(100, None), (101, ""), (None, "one TWO words"), (3, "日本. 語 É"), (3, "日本. 語 É"), (102, "x" * 100_000 + " one " + "seven, again " * 3000)]
    return docs, items


@pytest.mark.parametrize("shard", [200_000, 60])
def test_hits_equal_plain_ones(spark, shard):
    docs, items = leak_tables()
    d = spark.createDataFrame([(*r, "c", 1) for r in docs], "doc_id bigint, text string, items string, runs int")
    b = spark.createDataFrame([(*r, 2) for r in items], "item_id bigint, text string, words int")
    expected = collections.Counter(plain_hits(docs, items))
    found = decontaminate.contaminated(d, b, shard=shard).collect()
    own = collections.Counter((r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in found)
    assert own == expected and any(r.n_hit for r in found)
    texts = collections.defaultdict(list)
    for i, t in docs:
        texts[i].append(t or "")
    for r in found:
        # The spans, cut out of an original text of that id, hold exactly the hit words.
        assert any(sum(len(decontaminate.words_of(t[s.start:s.end])) for s in r.spans) == r.n_hit
                   and all(s.end <= len(t) and not t[s.start:s.end].startswith(" ") for s in r.spans) for t in texts[r.doc_id])


def test_empty_benchmark_and_documents(spark):
    docs, items = leak_tables()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    assert {(r.n_hit, r.n_items, r.contaminated) for r in decontaminate.report(d, b.limit(0)).collect()} == {(0, 0, False)}
    assert decontaminate.report(d.limit(0), b).count() == 0
