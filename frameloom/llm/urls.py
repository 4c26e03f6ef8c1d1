"""URL filters: captures against dated block and allow lists.

A list is a log of dated entries: a key (a host, or a host with leading path
segments) is added with a verdict, or removed. Entries become validity
intervals, and a capture meets those active at its fetch time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .rows import packed, unpacked

#: (key, action, category, day): the list that the query applies.
ENTRIES = [
    ("spam-farm.example.org", "block", "spam", "2024-01-01"),
    ("spam-farm.example.org", "remove", None, "2024-09-01"),
    ("cheap-pills.example.com", "block", "pharma", "2024-02-01"),
    ("cheap-pills.example.com", "allow", "appeal", "2024-05-15"),
    ("cheap-pills.example.com", "block", "pharma", "2024-06-01"),
    ("tionsh.example.net", "block", "mirror", "2024-03-10"),
    ("tionsh.example.net", "remove", None, "2024-03-20"),
    ("blog.tionsh.example.net", "allow", "blog", "2024-03-01"),
    ("tiontion.example.com/en", "block", "scraper", "2024-04-01"),
    ("example.org/de", "block", "region", "2024-07-01"),
    ("example.org/de", "remove", None, "2024-08-01"),
    ("ththth.example.net", "block", "spam", "2024-10-01"),
]
FIRST_DAY = "2024-01-01"


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(key, action, category, valid_from, valid_to) from dated ``entries``.

    An entry holds from its day until the next entry of its key (exclusive; null:
    open). Of entries of one key and day the last by action, then category,
    counts. Entries without key, action or day are void; repeated ones merge.
    """
    e = entries.select(F.lower("key").alias("key"), "action", "category", F.col("day").cast("date").alias("valid_from"))
    e = e.filter("key IS NOT NULL AND action IS NOT NULL AND valid_from IS NOT NULL")
    e = e.groupBy("key", "valid_from").agg(F.max(F.struct("action", "category")).alias("e"))
    nxt = F.lead("valid_from").over(W.partitionBy("key").orderBy("valid_from"))
    e = e.select("key", "e.action", "e.category", "valid_from", nxt.alias("valid_to"))
    return e.filter("action IN ('block', 'allow')")


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)


def site_keys(host: Column, path: Column, depth: int) -> Column:
    """The host and its parents, each alone and with 1 to ``depth`` path segments."""
    labels = F.split(host, "\\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat_ws(".", F.slice(labels, i, F.size(labels))))
    parts = F.slice(F.array_remove(F.split(path, "/"), ""), 1, depth) if depth else F.array().cast("array<string>")
    heads = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.lit("/"), F.concat_ws("/", F.slice(parts, 1, i)))))
    heads = F.concat(F.array(F.lit("")), F.coalesce(heads, F.array().cast("array<string>")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.flatten(F.transform(hosts, lambda h: F.transform(heads, lambda p: F.concat(h, p)))))
    )


def url_filter(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """``captures`` with host, blocked, action, category and matched_key.

    Among the entries active on the day of ``fetched``, the longest key decides
    (it is the most specific), then the later entry, then action and key. No
    entry, a null url or day, or a url without host: not blocked. Work is done
    once per distinct (site prefix, day), so a hot host costs one row each day; the list
    is broadcast only where its size stays below Spark's threshold. Repeated
    captures keep their rows, extra columns stay (one with the name of an added column
    gives way to it), empty tables give none.
    """
    spans = validity_intervals(entries)
    depth = F.size(F.split("key", "/")) - 1
    deepest = entries.agg(F.max(depth)).head()[0] or 0
    # deeper segments than any key has cannot match
    head = F.slice(F.array_remove(F.split(path_of(F.col(url)), "/"), ""), 1, deepest) if deepest else F.array().cast("array<string>")
    c = captures.select(packed(captures), host_of(F.col(url)).alias("host"), F.concat(F.lit("/"), F.concat_ws("/", head)).alias("path"), F.col(fetched).cast("date").alias("day"))
    c = c.select("row", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "day")
    sites = c.select("host", "path", "day").distinct()
    keys = sites.select("host", "path", "day", F.explode(site_keys(F.col("host"), F.col("path"), deepest)).alias("key"))
    hit = keys.join(spans, "key").filter("valid_from <= day AND (valid_to IS NULL OR day < valid_to)")
    best = F.max(F.struct(F.length("key").alias("n"), "valid_from", "action", "key", "category")).alias("e")
    verdict = hit.groupBy("host", "path", "day").agg(best)
    out = c.join(verdict, ["host", "path", "day"], "left")
    out = out.select("row", "host", F.coalesce(F.col("e.action") == "block", F.lit(False)).alias("blocked"), "e.action", "e.category", F.col("e.key").alias("matched_key"))
    return out.select(*unpacked(captures.columns, "host", "blocked", "action", "category", "matched_key"))


def entry_table(spark: SparkSession, entries=ENTRIES) -> DataFrame:
    """A local relation, so that Catalyst knows its size."""
    return spark.sql("SELECT * FROM VALUES " + ", ".join(map(_row, entries)) + " AS e(key, action, category, day)")


def _row(e) -> str:
    return "(" + ", ".join("CAST(NULL AS STRING)" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for x in e) + ")"


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages carry no fetch time: the day of page p is p mod 366 days into 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    pages = pages.withColumn("fetched", F.date_add(F.lit(FIRST_DAY).cast("date"), F.pmod("page_id", F.lit(366)).cast("int")))
    return url_filter(pages, entry_table(spark))


SQL = rf"""
WITH e AS (SELECT key, action, category, CAST(day AS DATE) AS valid_from FROM (VALUES {', '.join(map(_row, ENTRIES))}) v(key, action, category, day)),
s AS (SELECT *, lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from) AS valid_to FROM e),
p AS (SELECT page_id, url, CAST(DATE '{FIRST_DAY}' + CAST(page_id % 366 AS INTEGER) AS DATE) AS fetched,
    coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1)), '') AS host,
    coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '') AS path FROM pages),
n AS (SELECT *, '/' || array_to_string(list_filter(string_split(path, '/'), lambda x: x <> ''), '/') || '/' AS whole FROM p),
m AS (SELECT page_id, url, action, category, key, row_number() OVER (PARTITION BY page_id, url ORDER BY length(key) DESC, valid_from DESC, action DESC, key DESC) AS k
  FROM n JOIN s ON (valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to)) AND action <> 'remove'
    AND (host = split_part(key, '/', 1) OR ends_with(host, '.' || split_part(key, '/', 1)))
    AND (key NOT LIKE '%/%' OR starts_with(whole, substr(key, strpos(key, '/')) || '/')))
SELECT n.page_id, n.url, n.fetched, n.host, coalesce(m.action = 'block', false) AS blocked, m.action, m.category, m.key AS matched_key
FROM n LEFT JOIN m ON n.page_id = m.page_id AND n.url = m.url AND m.k = 1"""
