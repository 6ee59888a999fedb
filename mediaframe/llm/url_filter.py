"""URL rules by host suffix and path prefix, joined on short digests."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def url_host(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; '' without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://([^/?#]*)", 1)
    return F.when(F.length(rest) == F.octet_length(rest), F.lower(rest)).otherwise(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def url_path(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def _short(expression: Column) -> Column:
    return F.crc32(expression.cast("binary"))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules written out as a table of SQL values."""
    if not rules:
        return spark.sql("SELECT '' AS rule_host, '' AS rule_path, '' AS rule_verdict WHERE false")
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({', '.join(map(quoted, r))})" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(rule_host, rule_path, rule_verdict)")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", keys: tuple[str, ...] = ("page_id",),
               default: str = "allow", max_broadcast_rules: int = 100_000) -> DataFrame:
    """`keys`, host, path, rule (host and path of the one that decides; else null), verdict.

    A rule fits its host and all subdomains if the path starts with the rule's. The longest
    rule wins (host, then path); of equal ones 'block'. Without a rule the verdict is `default`.
    Each URL is expanded only to the host suffixes and path prefixes whose number of labels
    and characters some rule has. Expressions and rules meet on a 32-bit integer hash, the only key
    of the join; of those that met, the full SHA-256 digests decide. One row per input row, repeated
    rows each, an empty table or rule table included; null urls have an empty host and path and meet
    no rule; urls of any length are taken whole. The rule table is broadcast only when a count shows it is small.
    """
    r = rules.where("rule_host is not null and rule_path is not null").groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict")).select(
        F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict", F.length("rule_host").alias("rule_host_len"), F.length("rule_path").alias("rule_path_len"),
        F.size(F.split("rule_host", r"\.")).alias("rule_labels"), F.concat("rule_host", F.lit("\n"), "rule_path").alias("x")).withColumn("rule_digest", F.sha2("x", 256)).withColumn("rule_prefix", _short(F.col("x"))).drop("x")
    shape = r.agg(F.count("*"), F.collect_set("rule_labels"), F.collect_set("rule_path_len")).first()
    labels, lengths = F.array(*map(F.lit, sorted(shape[1]))).cast("array<int>"), F.array(*map(F.lit, sorted(shape[2]))).cast("array<int>")
    if 0 < shape[0] <= max_broadcast_rules:
        r = F.broadcast(r)

    split = pages.select(F.monotonically_increasing_id().alias("_row"), *[F.col(k) for k in keys], url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.call_function("substring_index", F.col("host"), F.lit("."), -n))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, F.lit("\n"), p))))
    asked = split.withColumn("_x", F.explode_outer(expressions)).withColumn("_prefix", _short(F.col("_x")))
    met = asked.join(r, F.col("_prefix") == F.col("rule_prefix"), "left")
    confirmed = F.sha2("_x", 256) == F.col("rule_digest")  # computed for the few that met a rule
    best = F.max(F.when(F.col("rule").isNotNull() & confirmed, F.struct("rule_host_len", "rule_path_len", "rule_verdict", "rule"))).alias("_best")
    return met.groupBy("_row", *keys, "host", "path").agg(best).select(*keys, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.rule_verdict", F.lit(default)).alias("verdict"))
