"""Registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (bag_minhash, byte_pair, compression_rules, cotraining, decontaminate, language_id, lexical_search,
               line_dedup, packing, periodic_runs, secret_scan, sharding, substring_dedup)
from .common import documents


def op1_minimax_sharding(spark, sf_dir):
    return sharding.shard(documents(spark, sf_dir), 16)


def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir), 1024, 2)


def op3_cross_parsing_language(spark, sf_dir):
    return language_id.identify(documents(spark, sf_dir))


def op4_fuzzy_line_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs, counts=True).select("doc_id", "n_lines", "n_removed", "text")


def op5_cotraining_quality(spark, sf_dir):
    return cotraining.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_relative_lz_substring_dedup(spark, sf_dir):
    return (substring_dedup.remove_repeats(documents(spark, sf_dir), with_text=False)
            .select("doc_id", "n_words", "n_removed", "kept_sha256"))


def op7_bag_minhash_near_dedup(spark, sf_dir):
    return bag_minhash.near_duplicates(documents(spark, sf_dir))


def op8_compression_bands(spark, sf_dir):
    return compression_rules.judge(documents(spark, sf_dir))


def op9_aho_corasick_decontamination(spark, sf_dir):
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.decontaminate(documents(spark, sf_dir), bench).drop("spans")


def op10_recursive_secret_scan(spark, sf_dir):
    return secret_scan.scan_secrets(documents(spark, sf_dir))


def op11_rank_array_bpe(spark, sf_dir):
    coded = byte_pair.encode(documents(spark, sf_dir).select("doc_id", "text"))
    both = byte_pair.decode(coded.select("doc_id", "ids"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_blocked_lexical_search(spark, sf_dir):
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def with_periodic_tails(docs):
    """The contract's input of operator 13: doc_id and text.

    With h = crc32(doc_id), g = h div 10 and n words, a text of h % 10 = 0
    repeats from word a = g % n on with period 1 + (n - a) div (3 + g % 8).
    """
    words = F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)")))
    parts = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    for name, made in (("w", words), ("n", F.size("w")), ("a", F.expr("cast((h div 10) % nullif(n, 0) as int)")),
                       ("p", F.expr("cast(1 + (n - a) div (3 + (h div 10) % 8) as int)"))):
        parts = parts.withColumn(name, made)
    again = F.expr("slice(concat(slice(w, 1, a), "
                   "flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int)))), 1, n)")
    return parts.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op13_maximal_pair_runs(spark, sf_dir):
    found = periodic_runs.find_runs(with_periodic_tails(documents(spark, sf_dir))).drop("text")
    line = lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"),
                                 F.concat(r["period"].cast("string"), F.lit("\n")))
    found = found.withColumn("best", F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))))
    length, period = -F.col("best.less"), F.col("best.period")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), length.alias("length"),
        period.alias("period"), F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"),
        F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"))


def queries():
    return {name: f for name, f in globals().items() if name.startswith("op")}


SUBSTRING_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w)),
dup AS (
  SELECT doc_id, s FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1),
gone AS (SELECT DISTINCT doc_id, s + j AS p FROM dup, (SELECT unnest(range(0, 20)) AS j)),
word AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t, count(*) AS n
  FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""

DECONTAMINATION_SQL = r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
iwin AS (
  SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[s:s + least(10, len(ws)) - 1], ' ') AS k
  FROM (SELECT item_id, ws, unnest(range(1, greatest(1, len(ws) - 9) + 1)) AS s FROM item WHERE len(ws) > 0)),
doc AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
sizes AS (SELECT DISTINCT n FROM iwin),
dwin AS (
  SELECT doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM doc, sizes WHERE len(ws) >= n)),
hit AS (SELECT doc_id, s, dwin.n AS n, item_id FROM dwin JOIN iwin ON dwin.k = iwin.k AND dwin.n = iwin.n),
words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id),
ids AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)
"""


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
size AS (SELECT count(*) AS big_n, CAST(sum(len(ts)) AS BIGINT) AS big_l FROM d WHERE len(ts) > 0),
doc AS (SELECT doc_id, t, count(*) AS tf, any_value(n) AS n
        FROM (SELECT doc_id, CAST(len(ts) AS BIGINT) AS n, unnest(ts) AS t FROM d) GROUP BY doc_id, t),
df AS (SELECT t, count(*) AS df FROM doc GROUP BY t),
item AS (
  SELECT item_id, t, count(*) AS qtf FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark) GROUP BY item_id, t),
weighted AS (
  SELECT item_id, t, qtf * CAST(floor(1000 * ln((2.0::DOUBLE * big_n + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
  FROM item JOIN df USING (t), size),
scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM weighted JOIN doc USING (t), size GROUP BY item_id, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_relative_lz_substring_dedup": SUBSTRING_SQL,
            "op9_aho_corasick_decontamination": DECONTAMINATION_SQL,
            "op12_blocked_lexical_search": SEARCH_SQL}
