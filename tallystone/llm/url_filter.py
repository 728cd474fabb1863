"""URL filters with dated lists: entries become validity intervals, captures are joined as of their fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, saved, shared_dir

#: Lists of at most so many entries are broadcast; larger ones are joined by key.
BROADCAST_ENTRIES = 50_000
#: In the join by key, how many tasks share the captures of one key.
SALTS = 16

#: A small list for the query below: list, kind of key, key, action, date. An entry counts from its date on.
ENTRIES = (
    ("ads", "domain", "ads-track.example.com", "add", "2024-01-15"),
    ("ads", "domain", "ads-track.example.net", "add", "2024-02-01"),
    ("ads", "domain", "ads-track.example.org", "add", "2023-11-01"),
    ("ads", "domain", "ads-track.example.org", "remove", "2024-06-30"),
    ("gambling", "domain", "casino-win.example.org", "add", "2024-03-01"),
    ("gambling", "domain", "casino-win.example.net", "add", "2024-03-01"),
    ("gambling", "domain", "casino-win.example.com", "add", "2024-03-01"),
    ("gambling", "domain", "free-bets.example.net", "add", "2024-01-01"),
    ("gambling", "domain", "free-bets.example.com", "add", "2024-01-01"),
    ("gambling", "domain", "free-bets.example.com", "remove", "2024-04-01"),
    ("gambling", "domain", "free-bets.example.com", "add", "2024-08-01"),
    ("spam", "domain", "spam-farm.example.org", "add", "2023-06-01"),
    ("spam", "domain", "spam-farm.example.com", "add", "2023-06-01"),
    ("spam", "host", "www.cheap-pills.example.com", "add", "2024-05-01"),
    ("spam", "host", "blog.cheap-pills.example.net", "add", "2024-05-01"),
    ("spam", "domain", "cheap-pills.example.org", "add", "2024-05-01"),
    ("adult", "domain", "adult-x.example.net", "add", "2024-01-01"),
    ("adult", "domain", "adult-x.example.com", "add", "2024-07-01"),
    ("adult", "domain", "adult-x.example.org", "add", "2024-07-01"),
    ("low", "prefix", "tionsh.example.net/de", "add", "2024-09-01"),
)


def host_of(url: Column) -> Column:
    """Lower-case host without user, port or final dots; null where there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    return F.nullif(host, F.lit(""))


def path_of(url: Column) -> Column:
    """The path's segments, as they are written: no query, no fragment, no empty segment."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.array_remove(F.split(path, "/"), "")


def keys_of(host: Column, path: Column, labels: int) -> Column:
    """What a list entry can name: the host, each domain it lies in that has at least so many labels, and each beginning of host and path."""
    parts = F.split(host, r"\.")
    n, key = F.size(parts), lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    domain = F.transform(F.sequence(F.lit(1), n - (labels - 1)), lambda k: key("domain", F.array_join(F.slice(parts, k, n), ".")))
    domain = F.when(n >= labels, domain).otherwise(F.array().cast("array<struct<kind:string,value:string>>"))
    prefix = F.transform(F.sequence(F.lit(0), F.size(path)), lambda k: key("prefix", F.array_join(F.concat(F.array(host), F.slice(path, 1, k)), "/")))
    return F.array_distinct(F.concat(domain, F.array(key("host", host)), prefix))


def entry_value(kind: Column, value: Column) -> Column:
    """An entry's key in the form of keys_of: hosts in lower case, paths as they are written, no final slash."""
    parts = F.array_remove(F.split(value, "/"), "")
    return F.when(kind == "prefix", F.array_join(F.concat(F.array(F.lower(F.element_at(parts, 1))), F.slice(parts, 2, F.size(parts))), "/")).otherwise(F.lower(value))


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, value, since, until of the times at which an entry is active.

    Of several actions on a key at one time, "remove" wins; repeated actions change
    nothing. Rows with a null or another action, or a null in any other column, are void,
    and so are prefixes without a host.
    """
    e = only(entries, "list", "kind", "value", "action", "at").where("kind <> 'prefix' OR value RLIKE '[^/]'")
    e = e.select("list", "kind", entry_value(F.col("kind"), F.col("value")).alias("value"), "action", F.col("at").cast("timestamp").alias("at"))
    e = e.where("action IN ('add', 'remove')").dropna().groupBy("list", "kind", "value", "at").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list", "kind", "value").orderBy("at")
    e = e.withColumn("until", F.lead("at").over(w)).where("action = 'add'")
    return e.select("list", "kind", "value", F.col("at").alias("since"), "until")


def filter_urls(captures: DataFrame, entries: DataFrame, broadcast_entries: int = BROADCAST_ENTRIES) -> DataFrame:
    """id, host, n_active, lists, blocked for every row of captures (id, url, fetch_time).

    n_active counts the entries that name the URL and were active at fetch_time; lists are
    their lists, sorted, with commas between; blocked says whether there is one. A host or
    domain is compared without regard to case. A prefix is a host and some segments of a
    path: it names URLs that begin with just these whole segments, of any number, the
    path in the case in which it is written. A null or malformed URL or a null fetch_time
    is never blocked. Repeated rows stay repeated; empty tables are no special case; other
    columns are ignored, whatever their names.
    """
    active = saved(intervals(entries), shared_dir(captures.sparkSession) + "/active")
    # The check reads no more than the bound; a longer list takes the way by key.
    small = active.limit(broadcast_entries + 1).count() <= broadcast_entries
    # Domains of fewer labels than any entry has (a bare "com") would be hot keys without a partner.
    reach = active.agg(F.min(F.when(F.col("kind") == "domain", F.size(F.split("value", r"\.")))).alias("labels"), F.max(F.when(F.col("kind") == "prefix", F.size(F.split("value", "/")) - 1)).alias("depth")).first()
    salts = 1 if small else SALTS
    active = F.broadcast(active.withColumn("salt", F.lit(0))) if small else active.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    rows = only(captures, "id", "url", "fetch_time").select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.col("fetch_time").cast("timestamp").alias("fetch_time"))
    path = F.slice(path_of(F.col("url")), 1, reach["depth"] or 0)
    rows = rows.select("id", host_of(F.col("url")).alias("host"), path.alias("path"), "fetch_time")
    # One lookup for each host, beginning of a path and fetch time, however many captures share them.
    asked = rows.where("host IS NOT NULL AND fetch_time IS NOT NULL").groupBy("host", "path", "fetch_time").agg(F.lit(1).alias("one"))
    keyed = asked.select("host", "path", "fetch_time", F.explode(keys_of(F.col("host"), F.col("path"), reach["labels"] or 2**20)).alias("key"))
    keyed = keyed.select("host", "path", "fetch_time", F.pmod(F.xxhash64("host", "path", "fetch_time"), F.lit(salts)).cast("int").alias("salt"), "key.kind", "key.value")
    k, a = keyed.alias("k"), active.alias("a")
    same = (F.col("k.salt") == F.col("a.salt")) & (F.col("k.kind") == F.col("a.kind")) & (F.col("k.value") == F.col("a.value"))
    hits = k.join(a, same & (F.col("k.fetch_time") >= F.col("a.since")) & (F.col("a.until").isNull() | (F.col("k.fetch_time") < F.col("a.until"))))
    found = hits.groupBy("host", "path", "fetch_time").agg(F.count(F.lit(1)).alias("n_active"), F.array_join(F.array_sort(F.collect_set("a.list")), ",").alias("lists"))
    out = rows.join(found, ["host", "path", "fetch_time"], "left")
    n = F.coalesce("n_active", F.lit(0)).cast("long")
    return out.select("id", "host", n.alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), (n > 0).alias("blocked"))


def entries_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(e) for e in ENTRIES], "list string, kind string, value string, action string, at string")


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    """All pages against ENTRIES. The table has no fetch times: they follow from page_id, over the year 2024."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    start = F.lit("2024-01-01").cast("timestamp")
    time = start + F.make_dt_interval((F.col("page_id") % 366).cast("int"), F.lit(0), (F.col("page_id") * 37 % 1440).cast("int"))
    out = filter_urls(pages.select(F.col("page_id").alias("id"), "url", time.alias("fetch_time")), entries_table(spark))
    return out.withColumnRenamed("id", "page_id")


_VALUES = ",\n".join(str(e) for e in ENTRIES)
SQL = {
    "op8_url_filter": rf"""
WITH e(list, kind, value, action, day) AS (VALUES {_VALUES}),
i AS (SELECT list, kind, value, action, CAST(day AS TIMESTAMP) AS since,
             lead(CAST(day AS TIMESTAMP)) OVER (PARTITION BY list, kind, value ORDER BY day) AS until FROM e),
c AS (SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 366 AS INTEGER)) + to_minutes(CAST(page_id * 37 % 1440 AS INTEGER)) AS fetch_time,
             lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS host,
             array_to_string(list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''), '/') AS path FROM pages),
h AS (SELECT c.page_id, i.list FROM c JOIN i ON i.action = 'add' AND c.fetch_time >= i.since AND (i.until IS NULL OR c.fetch_time < i.until)
      AND ((i.kind = 'host' AND c.host = i.value) OR (i.kind = 'domain' AND (c.host = i.value OR c.host LIKE '%.' || i.value))
           OR (i.kind = 'prefix' AND starts_with(c.host || '/' || c.path || '/', i.value || '/')))),
g AS (SELECT page_id, count(*) AS n, string_agg(DISTINCT list, ',' ORDER BY list) AS lists FROM h GROUP BY page_id)
SELECT c.page_id, c.host, coalesce(g.n, 0) AS n_active, coalesce(g.lists, '') AS lists, coalesce(g.n, 0) > 0 AS blocked
FROM c LEFT JOIN g ON g.page_id = c.page_id"""
}
