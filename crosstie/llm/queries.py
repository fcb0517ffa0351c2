"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crosstie.llm import (
    byte_bpe,
    centroids,
    collocations,
    decontaminate,
    html_text,
    ngram_join,
    order_minhash,
    packing,
    quality,
    secret_scan,
    suffix_dedup,
    token_files,
    warc_zip,
)
from crosstie.llm.common import importable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf_dir, "documents"))


def op8_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash.fingerprints(table(spark, sf_dir, "documents"))


def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(table(spark, sf_dir, "pages"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(table(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.report(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_ngram_join, op2_html_text, op3_byte_bpe, op4_quality_rules, op5_secret_scan, op6_best_fit_packing, op7_token_orc, op8_order_minhash, op9_warc_zip,
        op10_suffix_dedup, op11_centroids, op12_collocations, op13_decontamination)}

# The measures are written with the same rules: words by the white-space class, windows of
# five words, lines with a word; host rates with a beta prior by moments.
QUALITY_FEATURES = r"""
  texts AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM {documents}),
  lists AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
                   list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM texts),
  words AS (SELECT rid, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM lists),
  grams AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, word, w2, w3, w4, w5) AS n, w5
            FROM (SELECT *, lead(word, 1) OVER v AS w2, lead(word, 2) OVER v AS w3, lead(word, 3) OVER v AS w4,
                            lead(word, 4) OVER v AS w5 FROM words WINDOW v AS (PARTITION BY rid ORDER BY pos))),
  marks AS (SELECT rid, max(CASE WHEN w5 IS NOT NULL AND n > 1 THEN 1 ELSE 0 END)
                          OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS hit FROM grams),
  again AS (SELECT rid, sum(hit) AS n_repeat_words FROM marks GROUP BY rid),
  measures AS (SELECT lists.rid, doc_id, source, len(w)::BIGINT AS n_words,
                      coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
                      (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
                      coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines
               FROM lists LEFT JOIN again USING (rid)),
  judged AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM measures),
  hosts AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed OR 100 * n_symbols > 25 * word_chars
                                                            OR 100 * n_dup_lines > 50 * n_lines) AS bad FROM judged GROUP BY source),
  sums AS (SELECT count(*) AS h, sum(n)::DOUBLE AS n, sum(bad)::DOUBLE / sum(n) AS m, sum(n::DOUBLE * n) AS nn,
                  sum(n * (bad::DOUBLE / n) * (bad::DOUBLE / n)) AS pp FROM hosts),
  fit AS (SELECT m, CASE WHEN m * (1 - m) * (n - nn / n - (h - 1)) > 0
                         THEN ((pp - n * m * m) - m * (1 - m) * (h - 1)) / (m * (1 - m) * (n - nn / n - (h - 1))) ELSE 0 END AS rho FROM sums),
  prior AS (SELECT m, 1 / least(greatest(rho, 1e-6), 1 - 1e-6) - 1 AS strength FROM fit),
  verdicts AS (SELECT source, (bad + m * strength) / (n + strength) > 0.5 AND bad::DOUBLE / n > 0.5 AS host_rejected FROM hosts, prior)"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _centroid_sql() -> str:
    """Three rounds of Lloyd's method and a last assignment, one CTE a step. Centroids are lists, distances sums over zipped lists."""
    steps = ["""kept AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
             """c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR), v) - 1 AS cluster, v AS c FROM kept
    ORDER BY sha256('1:' || vec_id::VARCHAR), v LIMIT 16)"""]
    far = "list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT"
    for i in range(4):
        steps.append(f"""d{i} AS (SELECT row, vec_id, v, min(struct_pack(distance := {far}, cluster := cluster)) AS best FROM kept, c{i} GROUP BY row, vec_id, v)""")
        if i < 3:
            steps.append(f"""s{i} AS (SELECT cluster, dim, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT best.cluster AS cluster, unnest(v) AS x, generate_subscripts(v, 1) AS dim FROM d{i}) GROUP BY 1, 2)""")
            steps.append(f"""c{i + 1} AS (SELECT o.cluster, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY dim) AS c FROM s{i} GROUP BY 1) m USING (cluster))""")
    return "WITH " + ",\n  ".join(steps) + """
  SELECT vec_id, best.cluster::INTEGER AS cluster, best.distance AS distance, (sum(best.distance) OVER (PARTITION BY best.cluster))::BIGINT AS cluster_inertia,
         (sum(best.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
  FROM d3 JOIN c3 ON c3.cluster = best.cluster"""


ORACLES: dict[str, str] = {
    "op11_centroids": _centroid_sql(),
    "op12_collocations": rf"""
  WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
       lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
       totals AS (SELECT lang, sum(len(w)) AS n FROM lists GROUP BY 1),
       starts AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM lists, (SELECT unnest([1, 2, 3, 4, 5]) AS m)),
       counts AS (SELECT lang, list_slice(w, i, i + m - 1) AS words, count(*) AS f FROM starts GROUP BY 1, 2),
       long AS (SELECT *, array_to_string(words, ' ') AS phrase FROM counts WHERE len(words) > 1 AND f >= 100),
       cuts AS (SELECT g.*, unnest(range(1, len(words))) AS k FROM long g),
       rated AS (SELECT g.lang, g.phrase, g.f, t.n, g.k, x.f AS l, y.f AS r, (1000::HUGEINT * g.f * t.n) // (x.f::HUGEINT * y.f) AS score
                 FROM cuts g JOIN totals t USING (lang) JOIN counts x ON x.lang = g.lang AND x.words = list_slice(g.words, 1, g.k)
                 JOIN counts y ON y.lang = g.lang AND y.words = list_slice(g.words, g.k + 1, len(g.words))),
       worst AS (SELECT lang, phrase, f, n, min(struct_pack(score := score, k := k, l := l, r := r)) AS w FROM rated GROUP BY 1, 2, 3, 4),
       kept AS (SELECT * FROM worst p WHERE NOT EXISTS (SELECT 1 FROM long q WHERE q.lang = p.lang AND q.f >= p.f AND q.phrase <> p.phrase
                AND contains(' ' || q.phrase || ' ', ' ' || p.phrase || ' '))),
       ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY w.score DESC, f DESC, phrase) AS rank FROM kept)
  SELECT lang, rank, phrase, f AS a, w.l AS l, w.r AS r, n::BIGINT AS n, w.score::BIGINT AS score FROM ranked WHERE rank <= 2000""",
    "op13_decontamination": rf"""
  WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
       items AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
       places AS (SELECT item, w, least(len(w), 10) AS size, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0),
       windows AS (SELECT DISTINCT item, size, list_slice(w, i, i + size - 1) AS words FROM places),
       sizes AS (SELECT DISTINCT size FROM windows),
       grams AS (SELECT rid, size, i, list_slice(w, i, i + size - 1) AS words
                 FROM (SELECT rid, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, sizes)),
       found AS (SELECT rid, size, i, item FROM grams JOIN windows USING (size, words)),
       hit AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + size)) AS pos FROM found) GROUP BY 1),
       named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM found) GROUP BY 1)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
         sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
  FROM docs LEFT JOIN hit USING (rid) LEFT JOIN named USING (rid)""",
    "op4_quality_rules": "WITH" + QUALITY_FEATURES.format(documents="documents") + """
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
         NOT base_failed AND NOT host_rejected AS kept
  FROM judged JOIN verdicts ON judged.source IS NOT DISTINCT FROM verdicts.source""",
    "op9_warc_zip": """
  WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
       s AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS payload_digest,
                    max(page_id) OVER (PARTITION BY html) AS first FROM p)
  SELECT page_id, payload_bytes, payload_digest,
         CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
         CASE WHEN payload_bytes >= 1000 AND first <> page_id THEN first END AS refers_to
  FROM s""",
}
