"""URL filters as a temporal list join (DataFrame operations only).

A list is a log of dated entries: at ``day`` the rule ``key`` of ``list`` was added or removed. Successive
entries of a rule become validity intervals [valid_from, valid_to). A capture has candidate keys: its host, all
parent domains, and its host with each path prefix. It is as-of joined with the rules that were
valid on the day it was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import save

FAR = 1 << 30


def host(url: Column) -> Column:
    """Lower-case host of an http(s) URL without user, port and a leading ``www.``; '' where there is none."""
    name = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[hH][tT][tT][pP][sS]?://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    return F.regexp_replace(name, r"^www\.", "")


def path(url: Column) -> Column:
    """The path of a URL without query, fragment, or slashes at its ends."""
    return F.regexp_replace(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z]+://[^/?#]*/([^?#]*)", 1), r"^/+|/+$", "")


def keys(host_: Column, path_: Column) -> Column:
    """Candidate keys: ``domain`` and its parents of two labels or more, then ``domain/prefix`` for every path prefix."""
    labels = F.split(host_, r"\.")
    n = F.size(labels)
    parents = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), n - 1)), lambda i: F.array_join(F.slice(labels, i, n), "."))
    parts = F.split(path_, "/")
    m = F.size(parts)
    prefixes = F.when(path_ == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), m), lambda i: F.concat(host_, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"))))
    return F.when(host_ == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(parents, prefixes)))


def intervals(entries: DataFrame) -> DataFrame:
    """``entries(list, key, day, action)`` to (list, key, valid_from, valid_to); action is 'add' or 'remove'.

    Of several entries of a rule on one day the removal counts; repeats change nothing; entries with a null are dropped.
    """
    clean = entries.where("list is not null and key is not null and day is not null and action in ('add', 'remove')")
    daily = clean.groupBy("list", "key", "day").agg(F.max(F.col("action") == "remove").alias("gone"))
    w = Window.partitionBy("list", "key").orderBy("day")
    return daily.withColumn("valid_to", F.coalesce(F.lead("day").over(w), F.lit(FAR))).where("not gone").select("list", "key", F.col("day").alias("valid_from"), "valid_to")


def apply(captures: DataFrame, entries: DataFrame, salts: int = 16) -> DataFrame:
    """Evaluate ``captures(page_id, url, day)`` against the entries that were active on the day of the fetch.

    Returns one row per capture: page_id, url_host, n_active (pairs of list and key), lists (their names, sorted, comma-joined),
    first_day (least start of those), blocked. A null or malformed URL and a null day match nothing. Keys of
    hot hosts are salted by page; rules are repeated for each salt, their number does not depend on the captures.
    Rows that repeat are evaluated as often as they come; without captures there are no rows, without entries nothing is blocked.
    """
    # saved, as the numbers of rows must not change when a lost task is run again
    named = save(captures.select("page_id", "day", host(F.col("url")).alias("url_host"), path(F.col("url")).alias("p"), F.monotonically_increasing_id().alias("row")), "captures")
    probe = named.select("row", "day", F.explode(keys(F.col("url_host"), F.col("p"))).alias("key")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    rules = intervals(entries).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    hits = probe.join(rules, ["key", "salt"]).where((F.col("day") >= F.col("valid_from")) & (F.col("day") < F.col("valid_to")))
    per = hits.groupBy("row").agg(F.count("*").alias("n_active"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"), F.min("valid_from").alias("first_day"))
    out = named.join(per, "row", "left")
    return out.select("page_id", "url_host", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("lists", F.lit("")).alias("lists"), "first_day", F.col("n_active").isNotNull().alias("blocked"))
