"""Address lists over time: dated entries become intervals, captures are judged by the entries active at fetch time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Of several entries of one domain on one day the last in this order holds.
ACTIONS = ["remove", "block", "allow"]


def host_of(url: Column) -> Column:
    """The host of an address in lower case; null where there is none."""
    return F.nullif(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1), F.lit(""))


def month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def domains_of(host: Column) -> Column:
    """The host and all domains above it that have two labels or more."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """``domain, action, valid_from, valid_to`` (exclusive, null while open) from ``domain, listed_on, action``.

    An entry holds until the next one of its domain; ``remove`` ends a listing and holds nothing. Entries with
    a null, or with an unknown action, are not entries. Repeated entries count once.
    """
    known = entries.select(F.lower("domain").alias("domain"), F.col("listed_on").cast("date").alias("day"), F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")).alias("rank"))
    daily = known.filter("domain IS NOT NULL AND day IS NOT NULL AND rank > 0").groupBy("domain", "day").agg(F.max("rank").cast("int").alias("rank"))
    following = F.lead("day").over(Window.partitionBy("domain").orderBy("day"))
    action = F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("rank"))
    rows = daily.select("domain", action.alias("action"), F.col("day").alias("valid_from"), following.alias("valid_to"))
    return rows.filter(F.col("action") != "remove")


def judged(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", fetched_col: str = "fetched_on") -> DataFrame:
    """Every capture with ``host, n_active, decided_by, action, blocked``.

    All entries of the host and of the domains above it that are active on the day of the fetch count; the
    one of the longest domain decides. A capture without host or day has no active entries and is not blocked.
    Captures are kept as they are, repeated ones too.

    Captures of one host and day are judged once. Intervals are cut at months, so that host and month find the
    few intervals that can hold; no domain's captures have to stand in one task.
    """
    source = captures.select(F.col(f"`{id_col}`").alias("page_id"), host_of(F.col(f"`{url_col}`")).alias("host"), F.col(f"`{fetched_col}`").cast("date").alias("fetched_on"))
    asked = source.filter("host IS NOT NULL AND fetched_on IS NOT NULL").select("host", "fetched_on").distinct()
    bounds = asked.agg(F.min(month(F.col("fetched_on"))), F.max(month(F.col("fetched_on")))).first()
    first, last = bounds if bounds[0] is not None else (0, -1)
    begin, end = F.greatest(month(F.col("valid_from")), F.lit(first)), F.least(F.coalesce(month(F.col("valid_to")), F.lit(last)), F.lit(last))
    monthly = intervals(entries).filter(begin <= end).withColumn("month", F.explode(F.sequence(begin, end)))
    places = asked.withColumn("month", month(F.col("fetched_on"))).withColumn("domain", F.explode(domains_of(F.col("host"))))
    active = places.join(monthly, ["domain", "month"]).filter("valid_from <= fetched_on AND (valid_to IS NULL OR fetched_on < valid_to)")
    best = F.max_by(F.struct("domain", "action"), F.length("domain"))
    decided = active.groupBy("host", "fetched_on").agg(F.count("*").alias("n_active"), best.alias("best"))
    rows = source.join(decided, ["host", "fetched_on"], "left")
    return rows.select(
        "page_id", "host", "fetched_on", F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"),
        F.col("best.domain").alias("decided_by"), F.col("best.action").alias("action"), F.coalesce(F.col("best.action") == "block", F.lit(False)).alias("blocked"),
    )
