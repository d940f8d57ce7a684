"""URL filters by temporal list join (operator 2).

A block list is a table of dated entries: from ``effective_at`` on, a host is
blocked or allowed.  The entries of one host become validity intervals (an entry
holds until the host's next one), and an as-of join evaluates every capture of a
page against the entry that was active when the page was fetched.  Entries cover
subdomains; of a capture's host and its parent domains, the most specific one
with an active entry decides.

The as-of join is a scan over ranges of (host, time): entries and asked moments lie in
one order, each range finds the last entry up to every moment, and what is active where
a range begins comes from one summary row per host and range.  A host with a third of
all captures is spread over a third of the ranges, and no window holds a whole host's
rows.  Moments are asked once per host and time, however many captures share them.  The
intervals' ends are found by ranges of (host, time), too.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociweave.operators.ordered import last_value, next_value


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without port and user; null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(host != "", host)


def intervals(entries: DataFrame) -> DataFrame:
    """(host, valid_from, valid_to, action) of dated list entries (host, effective_at, action).

    Of entries with one host and time, the greatest action counts; valid_to is the next
    entry's time, null for the last one.  Rows with a null are left out.
    """
    clean = entries.dropna(subset=["host", "effective_at", "action"]).groupBy("host", "effective_at").agg(F.max("action").alias("action"))
    return next_value(clean.withColumnRenamed("effective_at", "valid_from"), ["host"], "valid_from", "valid_to").select("host", "valid_from", "valid_to", "action")


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """(page_id, host, fetched_at, matched_host, valid_from, valid_to, action, blocked) of every capture.

    captures: (page_id, url, fetched_at); entries: (host, effective_at, action) with
    action "block" or "allow".  An entry holds from its own moment on.  A capture without a
    host or a fetch time matches no entry and is not blocked.  Rows that repeat a page_id
    are judged one by one; extra columns are left out; without captures the result is
    empty, without entries nothing is blocked.
    """
    wanted = captures.select(F.col("page_id").cast("long").alias("page_id"), host_of(F.col("url")).alias("own_host"), F.col("fetched_at").cast("timestamp").alias("fetched_at"))
    labels = F.split("own_host", "[.]")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    moments = wanted.filter("own_host is not null and fetched_at is not null").select("own_host", F.col("fetched_at").alias("at")).distinct()
    asked = moments.select("own_host", F.posexplode(suffixes).alias("depth", "host"), "at", F.lit(1).alias("turn"), F.lit(None).cast("struct<valid_from:timestamp,valid_to:timestamp,action:string>").alias("entry"))
    listed = intervals(entries.withColumn("effective_at", F.col("effective_at").cast("timestamp")))
    listed = listed.select(F.lit(None).cast("string").alias("own_host"), F.lit(None).cast("int").alias("depth"), "host", F.col("valid_from").alias("at"), F.lit(0).alias("turn"), F.struct("valid_from", "valid_to", "action").alias("entry"))
    judged = last_value(asked.unionByName(listed), ["host"], ["at", "turn"], F.col("entry"), "active").filter("depth is not null and active is not null")
    best = judged.groupBy("own_host", "at").agg(F.min(F.struct("depth", "host", "active")).alias("b"))
    best = best.select(F.col("own_host").alias("b_host"), F.col("at").alias("b_at"), F.col("b.host").alias("matched_host"), "b.active.valid_from", "b.active.valid_to", "b.active.action")
    on = (wanted["own_host"] == best["b_host"]) & (wanted["fetched_at"] == best["b_at"])
    return wanted.join(best, on, "left").select("page_id", F.col("own_host").alias("host"), "fetched_at", "matched_host", "valid_from", "valid_to", "action", F.coalesce(F.col("action") == "block", F.lit(False)).alias("blocked"))
