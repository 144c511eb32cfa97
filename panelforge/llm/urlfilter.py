"""URL filters whose lists change over time.

List entries are dated: an entry adds or removes a host (with its subdomains) or a URL prefix from a date
on. Entries of one key in order of date become validity intervals, and every capture is judged against
the intervals that hold at its fetch time: an equi-join on the keys that a URL has (its host, the host's
parents, its path's prefixes) with an as-of condition. A key of many captures is dealt over ``SALTS`` tasks,
each of which gets the key's intervals. A URL gets keys only as deep as the lists' deepest, so that a long path
has no more than they can match.

Cases: a null, empty or unparsable URL and a null fetch time match nothing and are not blocked; at one
date a removal wins over an addition; an addition repeated changes nothing; entries with a null list, key
or date are ignored; rows that repeat are judged each; empty tables give no rows or no blocks; columns
of captures stay, but those named as the result's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tasks over which the captures of one key are dealt; the lists' intervals are repeated as often.
SALTS = 16


def host_of(url: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def url_keys(url: Column, labels: int | None = None, depth: int | None = None) -> Column:
    """Keys of a URL: ``h:`` with its host and each parent that has a dot, ``p:`` with host and path prefixes by segment.

    With bounds, only the keys of at most ``labels`` parts of a host and of at most ``depth`` segments of a path.
    """
    host = host_of(url)
    parts = F.split(host, r"\.")
    last = F.greatest(F.size(parts) - 2, F.lit(0))
    first = F.lit(0) if labels is None else F.greatest(F.size(parts) - labels, F.lit(0))
    of = lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "."))
    hosts = F.when(first <= last, F.transform(F.sequence(F.least(first, last), last), of)).otherwise(F.array().cast("array<string>"))
    segments = F.filter(F.split(path_of(url), "/"), lambda s: s != "")
    segments = segments if depth is None else F.slice(segments, 1, depth)
    prefixes = F.transform(segments, lambda _, i: F.concat(F.lit("p:"), host, F.lit("/"), F.array_join(F.slice(segments, 1, i + 1), "/")))
    return F.when(host.isNull(), F.array().cast("array<string>")).otherwise(F.concat(hosts, prefixes))


def validity(entries: DataFrame) -> DataFrame:
    """Entries (list, key, action 'add' or 'remove', effective_at) as intervals [valid_from, valid_to); an open end is null."""
    rows = entries.select("list", "key", "action", "effective_at").dropna(subset=["list", "key", "effective_at"])
    last = rows.groupBy("list", "key", "effective_at").agg(F.max("action").alias("action"))  # 'remove' after 'add'
    order = W.partitionBy("list", "key").orderBy("effective_at")
    changed = last.withColumn("_was", F.lag("action").over(order)).where("_was is null or _was <> action")
    ends = changed.withColumn("valid_to", F.lead("effective_at").over(order))
    return ends.where("action = 'add'").select("list", "key", F.col("effective_at").alias("valid_from"), "valid_to")


def evaluate(captures: DataFrame, entries: DataFrame, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """``captures`` with host, n_active (entries that hold at the fetch time), lists (their names, in order) and blocked."""
    held = validity(entries)
    of = F.split("key", "/")
    deepest = held.agg(F.max(F.size(F.split(of[0], r"\."))).alias("labels"), F.max(F.size(of) - 1).alias("depth")).first()
    labels, depth = deepest["labels"] or 0, deepest["depth"] or 0
    held = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    asked = captures.select(F.col(url).alias("_url"), F.col(fetched).alias("_at")).dropna().distinct()  # a URL fetched twice at once is judged once
    keys = asked.select("_url", "_at", F.pmod(F.xxhash64("_url", "_at"), F.lit(SALTS)).cast("int").alias("_salt"), F.explode(F.array_distinct(url_keys(F.col("_url"), labels, depth))).alias("_key"))
    holds = (F.col("valid_from") <= F.col("_at")) & (F.col("valid_to").isNull() | (F.col("_at") < F.col("valid_to")))
    found = keys.join(held, (F.col("_key") == F.col("key")) & (keys["_salt"] == held["_salt"]) & holds)
    judged = found.groupBy("_url", "_at").agg(F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("_lists"))
    kept = captures.drop("host", "n_active", "lists", "blocked")
    # captures without URL or time match nothing wherever they are sent, so they are spread
    spread = F.when(kept[url].isNull() | kept[fetched].isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0))
    rows = kept.select(*[kept[c].alias(f"_c{k}") for k, c in enumerate(kept.columns)], kept[url].alias("_u"), kept[fetched].alias("_f"), spread.alias("_spread"))
    judged = judged.withColumn("_zero", F.least("_n", F.lit(0)))
    out = rows.join(judged, (F.col("_u") == F.col("_url")) & (F.col("_f") == F.col("_at")) & (F.col("_spread") == F.col("_zero")), "left")
    return out.select(
        *[F.col(f"_c{k}").alias(c) for k, c in enumerate(kept.columns)],
        host_of(F.col("_u")).alias("host"),
        F.coalesce("_n", F.lit(0).cast("long")).alias("n_active"),
        F.coalesce("_lists", F.lit("")).alias("lists"),
        (F.coalesce("_n", F.lit(0)) > 0).alias("blocked"),
    )
