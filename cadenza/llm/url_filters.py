"""URL filters as a temporal join with dated lists.

A list is a log of dated entries: an entry (a domain with all its subdomains, a host, or a host with a
leading part of its path) is added or removed. The log becomes validity intervals, and every capture is
evaluated against the entries that were active when it was fetched.

A URL meets the entries that cover it by equality: it is spelled out as its host, the parent domains and
the leading parts of its path, so the join is one on keys, with the interval as a condition. It is made for
distinct pairs of URL and time. The lists are broadcast only when they are counted to be small.

Defined results: a URL is lower-cased up to its path, without scheme, user, port, query, fragment, a final
dot of the host and final slashes of the path; null or hostless URLs and captures without a time match
nothing; keys of entries are normalised in the same way (lower case up to the path, no final dots of the host,
no final slashes); entries that lack a key, a date or a known action are ignored; of entries of one day for one key
a removal counts; repeated captures are evaluated one by one; other columns are ignored; a URL of any length is
spelled out whole, in as many keys as its host and path have parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: List entries up to which the lists are broadcast; more are shuffled.
BROADCAST_ROWS = 100_000
ENTRY_SCHEMA = "list string, kind string, key string, day date, action string"


def normal_key(key: Column) -> Column:
    """The key of an entry as URLs are spelled out: host in lower case without final dots, path without final slashes."""
    host, path = F.regexp_extract(F.trim(key), "^[^/]*", 0), F.regexp_extract(F.trim(key), "^[^/]*(.*)$", 1)
    return F.concat(F.regexp_replace(F.lower(host), r"\.+$", ""), F.regexp_replace(path, "/+$", ""))


def intervals(entries: DataFrame) -> DataFrame:
    """list, kind, key, since, until: when an entry was active, from `since` to before `until` (null: still is)."""
    clean = (
        entries.select("list", "kind", normal_key(F.col("key")).alias("key"), F.col("day").cast("date").alias("day"), "action")
        .where("key != '' and day is not null and action in ('add', 'remove') and kind in ('domain', 'host', 'path')")
        .groupBy("list", "kind", "key", "day")
        .agg(F.max("action").alias("action"))
    )
    w = Window.partitionBy("list", "kind", "key").orderBy("day")
    changes = clean.withColumn("before", F.lag("action").over(w)).where("before is null or before != action")
    return (
        changes.withColumn("until", F.lead("day").over(w))
        .where("action = 'add'")
        .select("list", "kind", "key", F.col("day").alias("since"), "until")
    )


def host_of(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))
    return F.regexp_replace(host, r"\.+$", "")


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//[^/?#]*([^?#]*)", 1)
    return F.regexp_replace(path, "/+$", "")


def keys_of(url: Column) -> Column:
    """(kind, key) of every entry that would cover a URL."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    steps = F.split(path, "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.concat(host, F.array_join(F.slice(steps, F.lit(1), i), "/")))
    entry = lambda kind: lambda k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    all_ = F.concat(F.array(entry("host")(host)), F.transform(domains, entry("domain")), F.transform(F.filter(paths, lambda p: p != host), entry("path")))
    return F.when(host != "", all_)


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched") -> DataFrame:
    """id, url, fetched, blocked, n_entries (active entries that cover the URL), lists (their names, in
    order), first_since, for each row."""
    spans = intervals(entries)
    if spans.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        spans = F.broadcast(spans)
    rows = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).cast("date").alias("fetched"))
    asked = rows.where("url is not null and fetched is not null").select("url", "fetched").distinct()
    spelled = asked.select("url", "fetched", F.explode(keys_of(F.col("url"))).alias("k")).select("url", "fetched", "k.kind", "k.key")
    met = (
        spelled.join(spans, ["kind", "key"])
        .where("fetched >= since and (until is null or fetched < until)")
        .groupBy("url", "fetched")
        .agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("since").alias("first_since"))
    )
    return rows.join(met, ["url", "fetched"], "left").select(
        "page_id",
        "url",
        "fetched",
        F.col("n").isNotNull().alias("blocked"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_entries"),
        F.coalesce("lists", F.lit("")).alias("lists"),
        "first_since",
    )


#: The lists of the query, as a log.
ENTRIES = (
    ("spam", "domain", "spam-farm.example.org", "2024-01-01", "add"),
    ("spam", "domain", "cheap-pills.example.com", "2024-03-01", "add"),
    ("spam", "domain", "cheap-pills.example.com", "2024-09-01", "remove"),
    ("spam", "domain", "cheap-pills.example.com", "2024-11-01", "add"),
    ("review", "host", "blog.tionsh.example.net", "2024-02-15", "add"),
    ("review", "host", "blog.tionsh.example.net", "2024-04-01", "remove"),
    ("review", "domain", "tiontion.example.com", "2024-06-01", "add"),
    ("legal", "path", "thther.example.org/fr", "2024-01-10", "add"),
    ("legal", "path", "thther.example.org/fr", "2024-10-10", "remove"),
    ("legal", "domain", "theres.example.com", "2023-01-01", "add"),
    ("legal", "domain", "theres.example.com", "2023-06-01", "remove"),
)


def entries(spark: SparkSession, log: tuple = ENTRIES) -> DataFrame:
    return spark.createDataFrame(list(log), "list string, kind string, key string, day string, action string").withColumn("day", F.col("day").cast("date"))
