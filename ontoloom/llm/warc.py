"""WARC revisits: a not-modified record is completed from the latest earlier full response for its URL.

The as-of join by URL is done in two levels, so that a URL with a large share of all records isn't one window:
records are put in time buckets, each (URL, bucket) is one window of its own, and what a bucket carries over
from the buckets before it comes from a table with a row per (URL, bucket).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ontoloom.llm.urlfilter import canonical, host_of, path_of

#: Time buckets over the whole range of capture times.
TIME_BUCKETS = 256

#: Headers that a 304 may update in the stored response (RFC 9110, section 15.4.5); all others stay the response's.
MERGED_HEADERS = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def resolve_revisits(records: DataFrame, buckets: int = TIME_BUCKETS) -> DataFrame:
    """One row per revisit record: record_id, url_key, refers_to, status, headers, payload_digest.

    records: record_id, url_key, ts (long), kind ('response' or 'revisit'), headers map (lower-case names), payload_digest.
    refers_to is the latest response of the same URL with a smaller ts (ties: the larger record_id). status:
    'resolved' if a validator of the revisit agrees with the response's and none contradicts it: the entity tag
    (weak comparison) first, else last-modified, else the payload digest; 'mismatch' if one contradicts; 'unverified'
    if they share none; 'orphan' without an earlier response. A resolved row has the response's headers, updated by
    the revisit's for MERGED_HEADERS, and the response's digest; any other row its own.

    A null url_key or ts: 'orphan'. Other kinds and null kinds are ignored. Null headers count as empty. Repeated revisits
    each give a row; repeated responses count once. An empty table gives an empty result; extra columns are ignored.
    """
    rows = records.where(F.col("kind").isin("response", "revisit")).select("record_id", "url_key", "ts", "kind", F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "payload_digest")
    usable = F.col("url_key").isNotNull() & F.col("ts").isNotNull()
    dated = rows.where(usable)
    span = dated.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    low, high = (span["low"] or 0, span["high"] or 0)
    width = max(1, -(-(high - low + 1) // buckets))
    dated = dated.withColumn("bucket", F.floor((F.col("ts") - F.lit(low)) / F.lit(width)).cast("int"))
    found = F.when(F.col("kind") == "response", F.struct("ts", "record_id", "headers", "payload_digest"))
    key = F.when(F.col("kind") == "response", F.struct("ts", "record_id"))
    # Rows of a bucket that share a time: a revisit sees only strictly earlier responses, hence the range frame.
    inside = Window.partitionBy("url_key", "bucket").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    local = dated.withColumn("near", F.max_by(found, key).over(inside)).where(F.col("kind") == "revisit")
    ends = dated.where(F.col("kind") == "response").groupBy("url_key", "bucket").agg(F.max_by(found, key).alias("end"))
    wanted = local.where(F.col("near").isNull()).select("url_key", "bucket").distinct()
    before = Window.partitionBy("url_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(wanted.withColumn("asked", F.lit(True)), ["url_key", "bucket"], "full_outer")
    carried = carried.withColumn("far", F.last("end", ignorenulls=True).over(before)).where("asked").select("url_key", "bucket", "far")
    joined = local.join(carried, ["url_key", "bucket"], "left").withColumn("base", F.coalesce("near", "far")).drop("near", "far", "bucket")
    lost = rows.where(~usable & (F.col("kind") == "revisit")).withColumn("base", F.lit(None).cast(joined.schema["base"].dataType))
    joined = joined.unionByName(lost)

    own, base = F.col("headers"), F.col("base.headers")
    tag = lambda h: F.regexp_replace(header(h, "etag"), "^W/", "")
    agrees = F.coalesce(tag(own) == tag(base), header(own, "last-modified") == header(base, "last-modified"), F.col("payload_digest") == F.col("base.payload_digest"))
    status = F.when(F.col("base").isNull(), "orphan").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("mismatch")
    permitted = F.map_filter(own, lambda k, v: k.isin(*MERGED_HEADERS) & v.isNotNull())
    merged = F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(permitted), k)), permitted)
    done = joined.withColumn("status", status)
    return done.select(
        "record_id",
        "url_key",
        F.col("base.record_id").alias("refers_to"),
        "status",
        F.when(F.col("status") == "resolved", merged).otherwise(own).alias("headers"),
        F.when(F.col("status") == "resolved", F.col("base.payload_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"),
    )


def crawl_records(pages: DataFrame) -> DataFrame:
    """The crawl that the query resolves: each page is a full response at time 2 * page_id and, as it was fetched again, a revisit at 2 * page_id + 1001.

    The revisit carries the page's validators, so that it agrees with a later capture of the URL only if that
    capture has the same body. Pages of other schemes and hosts than the list's keep their canonical URL.
    """
    url_key = canonical(host_of(F.col("url")), path_of(F.col("url")))
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")))
    known = pages.select("page_id", url_key.alias("url_key"), digest.alias("payload_digest"))
    tag = F.concat(F.lit('"'), F.substring("payload_digest", 1, 16), F.lit('"'))
    day = F.col("page_id").cast("string")
    full = F.create_map(F.lit("etag"), tag, F.lit("date"), day, F.lit("content-type"), F.lit("text/html"), F.lit("server"), F.lit("origin"))
    again = F.create_map(F.lit("etag"), F.concat(F.lit("W/"), tag), F.lit("date"), F.concat(day, F.lit("+")), F.lit("server"), F.lit("cache"))
    response = known.select((F.col("page_id") * 2).alias("record_id"), "url_key", (F.col("page_id") * 2).alias("ts"), F.lit("response").alias("kind"), full.alias("headers"), "payload_digest")
    revisit = known.select((F.col("page_id") * 2 + 1).alias("record_id"), "url_key", (F.col("page_id") * 2 + 1001).alias("ts"), F.lit("revisit").alias("kind"), again.alias("headers"), F.lit(None).cast("string").alias("payload_digest"))
    return response.unionByName(revisit)


def op3_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    done = resolve_revisits(crawl_records(pages))
    return done.select("record_id", "url_key", "refers_to", "status", "payload_digest", header(F.col("headers"), "server").alias("server"), header(F.col("headers"), "date").alias("date"), header(F.col("headers"), "content-type").alias("content_type"))


OP3_SQL = r"""
WITH parts AS (
  SELECT page_id, sha1(coalesce(html, '')) AS digest,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
keyed AS (
  SELECT page_id, digest, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^(www|m)\.', ''), ':(80|443)$', '') || regexp_replace(path, '(\.html)?/*$', '') END AS url_key FROM parts),
paired AS (
  SELECT v.page_id AS id, v.url_key, v.digest, r.page_id AS base, r.digest AS base_digest, row_number() OVER (PARTITION BY v.page_id ORDER BY r.page_id DESC NULLS LAST) AS k
  FROM keyed v LEFT JOIN keyed r ON v.url_key = r.url_key AND 2 * r.page_id < 2 * v.page_id + 1001)
SELECT 2 * id + 1 AS record_id, url_key, 2 * base AS refers_to,
  CASE WHEN base IS NULL THEN 'orphan' WHEN substr(digest, 1, 16) = substr(base_digest, 1, 16) THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN base IS NOT NULL AND substr(digest, 1, 16) = substr(base_digest, 1, 16) THEN base_digest END AS payload_digest,
  CASE WHEN base IS NOT NULL AND substr(digest, 1, 16) = substr(base_digest, 1, 16) THEN 'origin' ELSE 'cache' END AS server,
  CAST(id AS VARCHAR) || '+' AS date,
  CASE WHEN base IS NOT NULL AND substr(digest, 1, 16) = substr(base_digest, 1, 16) THEN 'text/html' END AS content_type
FROM paired WHERE k = 1
"""
