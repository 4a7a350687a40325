"""URL filters whose list entries are dated: an as-of join of captures with validity intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: Days of a join bucket; hot hosts fall apart into as many parts as captures span buckets.
BUCKET_DAYS = 30


def host_of(url: Column) -> Column:
    """Lower-case host without port and final dot; empty if there is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""), F.lit(""))


def domain_keys(host: Column) -> Column:
    """The host and its parent domains of two labels or more; an address of four numbers has no parents."""
    labels = F.split(host, r"\.")
    last = F.when(host.rlike("^[0-9.]+$"), 1).otherwise(F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity_intervals(events: DataFrame) -> DataFrame:
    """key, category, since, until (null: still active) from dated events (key, day, action, category).

    An `add` holds from its day until the key's next event; `remove` ends it; a second `add`
    replaces the entry. Of several events on a day the last by (action, category) counts: `remove` after `add`.
    """
    per_key = Window.partitionBy("key").orderBy("day", "action", "category")
    spans = events.filter("key IS NOT NULL AND day IS NOT NULL").select("key", "category", "action", F.col("day").alias("since"), F.lead("day").over(per_key).alias("until"))
    return spans.filter("action = 'add' AND (until IS NULL OR until > since)").drop("action")


def filter_captures(captures: DataFrame, intervals: DataFrame, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """page_id, url, day, blocked, matched, category, since, until for each distinct capture (page_id, url, day).

    A capture is blocked if its host or a parent domain has an entry active on its day;
    the longest such key is named. Intervals are cut into buckets of days and joined on (key, bucket), so each
    pair that is compared shares a key and a month. Null urls, urls without a host and null days match nothing.
    """
    span = captures.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    lo, hi = (span["lo"] or 0, span["hi"] or 0)
    caps = captures.select("page_id", "url", "day", F.explode(domain_keys(host_of(F.col("url")))).alias("key")).withColumn("bucket", F.floor(F.col("day") / bucket_days))
    first = F.greatest(F.col("since"), F.lit(lo))
    last = F.least(F.coalesce(F.col("until") - 1, F.lit(hi)), F.lit(hi))
    parts = intervals.filter(first <= last).withColumn("bucket", F.explode(F.sequence(F.floor(first / bucket_days), F.floor(last / bucket_days))))
    c, i = caps.alias("c"), parts.alias("i")
    on = (F.col("c.key") == F.col("i.key")) & (F.col("c.bucket") == F.col("i.bucket")) & (F.col("c.day") >= F.col("i.since")) & (F.col("i.until").isNull() | (F.col("c.day") < F.col("i.until")))
    hit = F.when(F.col("i.key").isNotNull(), F.struct(F.length("i.key").alias("n"), F.col("i.key").alias("matched"), F.col("i.category").alias("category"), F.col("i.since").alias("since"), F.col("i.until").alias("until")))
    best = c.join(i, on, "left").groupBy("c.page_id", "c.url", "c.day").agg(F.max(hit).alias("m"))
    return best.select("page_id", "url", "day", F.col("m").isNotNull().alias("blocked"), "m.matched", "m.category", "m.since", "m.until")


def _hex(digest: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(digest, at, n), 16, 10).cast("int")


def list_events(pages: DataFrame) -> DataFrame:
    """Dated list events drawn from the pages' own hosts and domains, as the tables hold no list.

    The md5 of a key decides: three eighths of the keys are listed, on a day of 0 to 599; half of these are
    removed later, and half of those are added again, under another category, 100 days on.
    """
    keys = pages.select(F.explode(domain_keys(host_of(F.col("url")))).alias("key")).filter("key <> ''").distinct()
    d = F.md5("key")
    chosen = keys.select("key", d.alias("d")).filter(_hex(F.col("d"), 1, 1) < 6)
    added, gone = _hex(F.col("d"), 2, 4) % 600, _hex(F.col("d"), 6, 4) % 200 + 1
    kind = F.when(_hex(F.col("d"), 10, 1) < 8, F.lit("spam")).otherwise(F.lit("adult"))
    removed, again = _hex(F.col("d"), 11, 1) < 8, _hex(F.col("d"), 12, 1) < 8
    e = lambda day, action, cat: F.struct(day.cast("int").alias("day"), F.lit(action).alias("action"), cat.alias("category"))
    events = F.array_compact(F.array(e(added, "add", kind), F.when(removed, e(added + gone, "remove", kind)), F.when(removed & again, e(added + gone + 100, "add", F.lit("returned")))))
    return chosen.select("key", F.inline(events))


def capture_days(pages: DataFrame) -> DataFrame:
    """page_id, url, day: a fetch day of 0 to 729 from the md5 of page_id, as the table holds none; null for a null id."""
    return pages.select("page_id", "url", (_hex(F.md5(F.col("page_id").cast("string")), 1, 6) % 730).alias("day"))


ORACLE = r"""
WITH h AS (
  SELECT page_id, url, CAST(('0x' || substr(md5(CAST(page_id AS VARCHAR)), 1, 6)) AS INTEGER) % 730 AS day,
    coalesce(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', ''), '') AS host
  FROM pages),
k AS (
  SELECT page_id, url, day, unnest(list_transform(range(1, CASE WHEN regexp_matches(host, '^[0-9.]+$') THEN 2 ELSE greatest(len(string_split(host, '.')) - 1, 1) + 1 END),
    lambda i: array_to_string(string_split(host, '.')[i:], '.'))) AS key
  FROM h),
d AS (SELECT key, md5(key) AS m FROM (SELECT DISTINCT key FROM k WHERE key <> '')),
x AS (
  SELECT key, CAST(('0x' || substr(m, 1, 1)) AS INTEGER) AS listed, CAST(('0x' || substr(m, 2, 4)) AS INTEGER) % 600 AS added,
    CAST(('0x' || substr(m, 6, 4)) AS INTEGER) % 200 + 1 AS gone,
    CASE WHEN CAST(('0x' || substr(m, 10, 1)) AS INTEGER) < 8 THEN 'spam' ELSE 'adult' END AS category,
    CAST(('0x' || substr(m, 11, 1)) AS INTEGER) < 8 AS removed, CAST(('0x' || substr(m, 12, 1)) AS INTEGER) < 8 AS again
  FROM d),
v AS (
  SELECT key, category, added AS since, CASE WHEN removed THEN added + gone END AS until FROM x WHERE listed < 6
  UNION ALL
  SELECT key, 'returned', added + gone + 100, NULL FROM x WHERE listed < 6 AND removed AND again),
j AS (
  SELECT k.page_id, k.url, k.day, v.key, v.category, v.since, v.until,
    row_number() OVER (PARTITION BY k.page_id, k.url, k.day ORDER BY length(v.key) DESC NULLS LAST, v.key DESC) AS n
  FROM k LEFT JOIN v ON k.key = v.key AND k.day >= v.since AND (v.until IS NULL OR k.day < v.until))
SELECT page_id, url, CAST(day AS INTEGER) AS day, key IS NOT NULL AS blocked, key AS matched, category, CAST(since AS INTEGER) AS since, CAST(until AS INTEGER) AS until
FROM j WHERE n = 1
"""
