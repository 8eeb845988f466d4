"""URL filters: host and path rules, then a blocked Bloom filter in front of an exact join with a block list.

The filter is a table with one row per block of eight 64-bit words. A URL's hash names its block and
one bit in each word. Building it is an aggregation (bit_or), probing it a join on the block; a small
filter is broadcast, a larger one is shuffled like any other table. Possible hits alone go to the exact join,
which removes the false positives.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ontoloom.llm.common import Saved, lower_ascii

WORDS = 8
#: Bits of the filter per listed URL; about one false positive in 250.
BITS_PER_URL = 16

#: (action, host, path prefix).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: Words whose presence in a host label puts the host's URLs on the block list of the query below.
SPAM_WORDS = ("spam", "pills", "casino", "bets", "ads")


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty without '://' or for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; empty without '://' or for null."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """host and path without a leading 'www.' or 'm.', a default port, an '.html' ending and final slashes; queries and fragments are dropped.

    Null for an empty host: such a URL is on no list.
    """
    bare = F.regexp_replace(F.regexp_replace(host, r"^(www|m)\.", ""), r":(80|443)$", "")
    return F.when(host != "", F.concat(bare, F.regexp_replace(path, r"(\.html)?/*$", "")))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...]) -> tuple[Column, Column]:
    """The longest rule that fits (host and subdomains; the path starts with the rule's) and its action, or nulls."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name, action = F.when(fits, rule_host + rule_path).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def _block_and_masks(key: Column, blocks: int) -> tuple[Column, list[Column]]:
    place, bits = F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)
    # A Column shift count isn't accepted by the Python functions, so the SQL form is used.
    masks = [F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(bits, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(WORDS)]
    return F.pmod(place, F.lit(blocks)), masks


def build_filter(keys: DataFrame, column: str, n_keys: int) -> tuple[Saved, int]:
    """The filter's table (block, w0..w7) for the distinct values of a column, and its number of blocks."""
    blocks = max(1, -(-n_keys * BITS_PER_URL // (64 * WORDS)))
    block, masks = _block_and_masks(F.col(column), blocks)
    rows = keys.where(F.col(column).isNotNull()).select(block.alias("block"), *[m.alias(f"m{k}") for k, m in enumerate(masks)])
    table = rows.groupBy("block").agg(*[F.bit_or(f"m{k}").alias(f"w{k}") for k in range(WORDS)])
    return Saved(table, "bloom"), blocks


def probe(rows: DataFrame, column: str, table: Saved, blocks: int) -> DataFrame:
    """rows with maybe_listed: false means that the value (or null) is certainly not among the filter's keys."""
    block, masks = _block_and_masks(F.col(column), blocks)
    # Nulls go to blocks of their own, spread out, so that they don't meet in one task.
    key = F.coalesce(block, -1 - F.pmod(F.monotonically_increasing_id(), F.lit(1024)))
    joined = rows.withColumn("_block", key).join(table.sized(), F.col("_block") == F.col("block"), "left")
    hit = reduce(lambda a, b: a & b, [F.col(f"w{k}").bitwiseAND(m) == m for k, m in enumerate(masks)])
    return joined.withColumn("maybe_listed", F.coalesce(hit, F.lit(False))).drop("_block", "block", *[f"w{k}" for k in range(WORDS)])


def filter_urls(pages: DataFrame, listed: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """One row per row of pages (page_id, url): page_id, host, path, rule, verdict, listed.

    listed has a column url_key of canonical URLs; nulls and repeats in it don't matter. The verdict is that of the
    longest rule that fits, else 'block' for a listed URL and 'allow' for any other. Null or malformed URLs
    have an empty host and path, fit no rule and are allowed. Repeated rows stay repeated; empty tables give an
    empty result, an empty list blocks nothing. Other columns are ignored.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("rule", rule).withColumn("action", action).withColumn("url_key", canonical(F.col("host"), F.col("path")))
    keys = Saved(listed.select("url_key").where(F.col("url_key").isNotNull()).distinct(), "url-list")
    table, blocks = build_filter(keys.df, "url_key", keys.df.count())
    probed = probe(parts, "url_key", table, blocks)
    clear = probed.where(~F.col("maybe_listed")).withColumn("listed", F.lit(False))
    exact = keys.sized().select(F.col("url_key").alias("listed_key"))
    possible = probed.where("maybe_listed").join(exact, F.col("url_key") == F.col("listed_key"), "left")
    possible = possible.withColumn("listed", F.col("listed_key").isNotNull()).drop("listed_key")
    verdict = F.coalesce(F.col("action"), F.when(F.col("listed"), "block").otherwise("allow"))
    return clear.unionByName(possible).withColumn("verdict", verdict).select("page_id", "host", "path", "rule", "verdict", "listed")


def spam_urls(pages: DataFrame) -> DataFrame:
    """The block list of the query: canonical URLs of the pages on hosts with a spam word."""
    host = host_of(F.col("url"))
    spam = host.rlike(rf"(^|[.-])({'|'.join(SPAM_WORDS)})([.-]|$)")
    return pages.where(spam).select(canonical(host, path_of(F.col("url"))).alias("url_key"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, spam_urls(pages))


OP8_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '(\.html)?/*$', '') END AS url_key,
    CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts),
listed AS (SELECT DISTINCT url_key FROM keyed WHERE regexp_matches(host, '(^|[.-])(spam|pills|casino|bets|ads)([.-]|$)'))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN url_key IN (SELECT url_key FROM listed WHERE url_key IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict,
  coalesce(url_key IN (SELECT url_key FROM listed WHERE url_key IS NOT NULL), false) AS listed
FROM keyed
"""
