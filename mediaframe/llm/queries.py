"""The operators' queries over whole tables, and their SQL where SQL can express them."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediaframe.llm import decontamination, exact_dedup, html_text, lexical_search, license_scan, lm_scoring, packing, quality_classifier, quality_rules, simhash, substring_dedup, target_resampling, url_filter
from mediaframe.plans.lineage import shared_folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where the installed public tokenizer file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_scoring(spark, sf_dir):
    return lm_scoring.score_texts(_table(spark, sf_dir, "documents"), lm_scoring.crc_split())


def op2_quality_rules(spark, sf_dir):
    return quality_rules.apply_rules(_table(spark, sf_dir, "documents")).drop("failed_rule")


def op3_html_extraction(spark, sf_dir):
    return html_text.extract_text(_table(spark, sf_dir, "pages"))


def op4_substring_dedup(spark, sf_dir):
    kept = substring_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path)


def op7_license_scans(spark, sf_dir):
    return license_scan.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_url_filters(spark, sf_dir):
    return url_filter.judge_urls(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op9_benchmark_decontamination(spark, sf_dir):
    return decontamination.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_quality_classifier(spark, sf_dir):
    return quality_classifier.judge_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op11_target_resampling(spark, sf_dir):
    return target_resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_exact_dedup(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))  # of an index that begins empty
    index = exact_dedup.DigestIndex(spark, f"{shared_folder(spark)}/digests-{uuid.uuid4().hex}", docs.schema["doc_id"].dataType, buckets)
    return exact_dedup.deduplicate(docs, index)


def op13_ranked_search(spark, sf_dir):
    return lexical_search.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def queries():
    return {f.__name__: f for f in (op1_lm_scoring, op2_quality_rules, op3_html_extraction, op4_substring_dedup, op5_simhash_near_dedup, op6_best_fit_packing, op7_license_scans, op8_url_filters, op9_benchmark_decontamination, op10_quality_classifier,
                                    op11_target_resampling, op12_exact_dedup, op13_ranked_search)}


_SPACE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_ALNUM_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP2_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_SPACE_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM d, unnest(range(1, greatest(len(w) - 1, 1))) t(i))),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM g, range(3) o(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM d)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, d.text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, len(string_split(text, chr(10))) AS n_lines
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
 (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR n_symbols > 0.1 * n_words OR word_chars < 2 * n_words OR word_chars > 25 * n_words
  OR (2 * n_dup_lines > n_lines AND n_lines > 3) OR 2 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > length(text)
  OR 4 * (length(text) - length(replace(text, '!!', '!'))) > n_words) AS kept
FROM m
"""

OP4_SQL = rf"""
WITH d AS (SELECT doc_id, {_SPACE_WORDS} AS w FROM documents),
x AS (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM d, unnest(range(1, greatest(len(w) - 33, 1))) t(i))),
r AS (SELECT DISTINCT doc_id, i + k AS i FROM x, range(35) o(k) WHERE n > 1),
k AS (SELECT d.doc_id, t.i, w[t.i] AS word, r.i IS NOT NULL AS gone FROM d CROSS JOIN unnest(range(1, len(w) + 1)) t(i) LEFT JOIN r ON r.doc_id = d.doc_id AND r.i = t.i)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
 sha256(coalesce(string_agg(word, ' ' ORDER BY k.i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id, w
"""

OP8_SQL = r"""
WITH s AS (SELECT page_id, coalesce(url, '') AS u, strpos(coalesce(url, ''), '://') AS p FROM pages),
h AS (SELECT page_id, CASE WHEN p > 0 THEN regexp_extract(substr(u, p + 3), '^[^/?#]*') ELSE '' END AS raw, CASE WHEN p > 0 THEN substr(u, p + 3) ELSE '' END AS rest FROM s),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
f AS (SELECT page_id, host, path, max(struct_pack(a := length(rh), b := length(rp), v := v, r := rh || rp)) FILTER (WHERE rh IS NOT NULL) AS best
  FROM q LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id, host, path)
SELECT page_id, host, path, best.r AS rule, coalesce(best.v, 'allow') AS verdict FROM f
"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) t(i)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win FROM d, (SELECT DISTINCT n FROM bw) s, unnest(range(1, greatest(len(w) - n + 2, 1))) t(i)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(range(n)) o(k) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

#: CRC-32 by a table made from its polynomial, byte by byte of each distinct feature.
OP11_SQL = rf"""
WITH tab AS MATERIALIZED (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark),
df AS (SELECT doc_id, array_to_string(w[i:i + k - 1], ' ') AS f FROM d, range(1, 4) n(k), unnest(range(1, greatest(len(w) - k + 2, 1))) t(i)),
bf AS (SELECT array_to_string(w[i:i + k - 1], ' ') AS f FROM b, range(1, 4) n(k), unnest(range(1, greatest(len(w) - k + 2, 1))) t(i)),
both_ AS (SELECT f, sum(s) AS s, sum(t) AS t FROM (SELECT f, 1 AS s, 0 AS t FROM df UNION ALL SELECT f, 0, 1 FROM bf) GROUP BY f),
named AS MATERIALIZED (SELECT f, s, t, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(f), 2 * i + 1, 2))::BIGINT)),
  lambda c, x: xor(crc[(xor(c, x) & 255) + 1], c >> 8))) % 10000 AS bucket FROM both_, tab),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000))))::BIGINT AS gain FROM
  (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM named GROUP BY bucket), (SELECT sum(s)::DOUBLE AS big_s, sum(t)::DOUBLE AS big_t FROM named)),
wt AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM df JOIN named USING (f) JOIN g USING (bucket) GROUP BY doc_id),
sc AS (SELECT doc_id, len(w) AS n, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN wt USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM sc WHERE n >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank FROM sc LEFT JOIN r USING (doc_id)
"""

OP12_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WINDOW same AS (PARTITION BY t)
"""

OP13_SQL = rf"""
WITH d AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY doc_id, term),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM len),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN len USING (doc_id), c GROUP BY item_id, doc_id)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 10
"""


def oracle_sql():
    return {"op2_quality_rules": OP2_SQL, "op4_substring_dedup": OP4_SQL, "op8_url_filters": OP8_SQL, "op9_benchmark_decontamination": OP9_SQL, "op11_target_resampling": OP11_SQL, "op12_exact_dedup": OP12_SQL, "op13_ranked_search": OP13_SQL}
