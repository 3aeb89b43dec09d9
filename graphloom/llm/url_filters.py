"""Operator 9: URL filters as a temporal list join.

A list is a log of dated entries (key, listed_at, action, category); the key is a host or any parent domain
of hosts. The log becomes validity intervals [listed_at, next entry of the key), and an as-of join evaluates
every capture against the interval that holds at its fetch time, for its host and each parent domain. The
most specific key with an active entry decides.

Defined results: every capture gives exactly one row, repeated ones too. A URL that is NULL or has no host,
and a capture without a fetch time, match nothing (verdict ``none``). Entries with a NULL key or date are
ignored. URLs of any length are read whole. Of entries of one key on one date the last in order of (action, category) counts. An action
``remove`` ends the key's validity. An empty list or capture table gives no matches or no rows. Only the
named columns are read, so further columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import table

HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
FLAGGED = "(adult|spam|casino|phish|malware|warez|xxx|porn)"


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, HOST, 1))


def parent_keys(host: Column) -> Column:
    """The host and every parent domain of two labels or more; a host of one label is its own only key."""
    parts = F.split(host, r"\.")
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host != "", many)


def validity(entries: DataFrame) -> DataFrame:
    """(key, action, category, valid_from, valid_to); valid_to is NULL for the entry that still holds."""
    clean = entries.select("key", F.col("listed_at").cast("date").alias("valid_from"), "action", "category").filter("key IS NOT NULL AND valid_from IS NOT NULL")
    one = clean.groupBy("key", "valid_from").agg(F.max(F.struct("action", "category")).alias("e"))
    until = F.lead("valid_from").over(W.partitionBy("key").orderBy("valid_from"))
    return one.select("key", "valid_from", "e.action", "e.category", until.alias("valid_to")).filter("action <> 'remove'")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, host, verdict, matched_key, category and since (date of the deciding entry) of every capture.

    The join runs on distinct (host, fetch date) pairs, so a page fetched again and again is matched once.
    Its list side is left to Spark's own size-checked broadcast, with a shuffle join beyond.
    """
    seen = captures.select("page_id", host_of(F.col("url")).alias("host"), F.col("fetched_at").cast("date").alias("day"))
    cases = seen.filter("host <> '' AND day IS NOT NULL").select("host", "day").distinct()
    tried = cases.select("host", "day", F.explode(parent_keys(F.col("host"))).alias("key"))
    active = tried.join(validity(entries), "key").filter("day >= valid_from AND (valid_to IS NULL OR day < valid_to)")
    best = active.groupBy("host", "day").agg(F.max(F.struct(F.length("key").alias("n"), "key", "action", "category", "valid_from")).alias("m"))
    return seen.join(best, ["host", "day"], "left").select(
        "page_id",
        F.nullif("host", F.lit("")).alias("host"),
        F.coalesce("m.action", F.lit("none")).alias("verdict"),
        F.col("m.key").alias("matched_key"),
        F.col("m.category").alias("category"),
        F.col("m.valid_from").cast("string").alias("since"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """The page table has no fetch time; the id spreads the captures over the days of 2024."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_at"))


def flagged_list(pages: DataFrame) -> DataFrame:
    """A dated list over all hosts of the pages: those with a flagged word, and a third of all others by their MD5 sum,
    without their first service label, are blocked, lifted and, as some other category, blocked again; and one subdomain
    of each is allowed for a time. (No table holds a list, so the query has to make one; any other can be given.)"""
    bare = F.regexp_replace(host_of(F.col("url")), r"^(www|m|blog)\.", "")
    third = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 8), 16, 10).cast("bigint") % 3 == 0
    hosts = pages.select(bare.alias("key")).filter("key <> ''").distinct().filter(F.col("key").rlike(FLAGGED) | third)
    start = (F.length("key") * 37) % 180
    log = hosts.select("key", F.explode(F.array(
        F.struct(F.col("key").alias("k"), start.alias("d"), F.lit("block").alias("a"), F.lit("flagged").alias("c")),
        F.struct(F.col("key").alias("k"), (start + 60).alias("d"), F.lit("remove").alias("a"), F.lit("appeal").alias("c")),
        F.struct(F.col("key").alias("k"), (start + 120).alias("d"), F.lit("block").alias("a"), F.lit("repeat").alias("c")),
        F.struct(F.concat(F.lit("blog."), F.col("key")).alias("k"), (start + 150).alias("d"), F.lit("allow").alias("a"), F.lit("reviewed").alias("c")),
    )).alias("e"))
    return log.select(F.col("e.k").alias("key"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("e.d").cast("int")).alias("listed_at"), F.col("e.a").alias("action"), F.col("e.c").alias("category"))


def op9_temporal_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return evaluate(captures_of(pages), flagged_list(pages))


SQL = f"""
WITH c AS (SELECT page_id, lower(regexp_extract(url, '{HOST}', 1)) AS host, DATE '2024-01-01' + (((page_id % 366) + 366) % 366)::INT AS day FROM pages),
h AS (SELECT DISTINCT regexp_replace(host, '^(www|m|blog)\\.', '') AS key FROM c WHERE host <> '' AND (regexp_matches(regexp_replace(host, '^(www|m|blog)\\.', ''), '{FLAGGED}') OR ('0x' || substr(md5(regexp_replace(host, '^(www|m|blog)\\.', '')), 1, 8))::BIGINT % 3 = 0)),
s AS (SELECT key, (length(key) * 37) % 180 AS d FROM h),
e AS (SELECT key, d, 'block' AS action, 'flagged' AS category FROM s UNION ALL SELECT key, d + 60, 'remove', 'appeal' FROM s
      UNION ALL SELECT key, d + 120, 'block', 'repeat' FROM s UNION ALL SELECT 'blog.' || key, d + 150, 'allow', 'reviewed' FROM s),
v AS (SELECT key, action, category, DATE '2024-01-01' + d::INT AS valid_from, lead(DATE '2024-01-01' + d::INT) OVER (PARTITION BY key ORDER BY d) AS valid_to
      FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key, d ORDER BY action DESC, category DESC) = 1)),
m AS (SELECT c.page_id, c.host, c.day, v.key, v.action, v.category, v.valid_from FROM c JOIN v
      ON (c.host = v.key OR ends_with(c.host, '.' || v.key)) AND v.action <> 'remove' AND c.day >= v.valid_from AND (v.valid_to IS NULL OR c.day < v.valid_to)
      QUALIFY row_number() OVER (PARTITION BY c.page_id ORDER BY length(v.key) DESC, v.key DESC) = 1)
SELECT c.page_id, nullif(c.host, '') AS host, coalesce(m.action, 'none') AS verdict, m.key AS matched_key, m.category, m.valid_from::VARCHAR AS since
FROM c LEFT JOIN m ON m.page_id = c.page_id
"""
