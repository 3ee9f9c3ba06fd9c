"""Request rates and latency over the event log, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.checks.tables import load
from plumbline.functions.fixed import SLOW_SECONDS
from plumbline.session import drop_path, fresh_path
from plumbline.streaming import files, latency, rates

# Event types as request classes with limits that are reached.
_LIMITS = {"error": 1, "click": 2}


def _log(spark, sf):
    return load(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")


def _str1(spark, sf):
    out = rates.rate_flags(_log(spark, sf), "event_type", "ts", "event_type", 600, _LIMITS, 3)
    return out.select("event_id", "event_type", "in_window", "max_requests", "exceeded")


def _str1_minute(spark, sf):
    out = rates.rate_flags(_log(spark, sf), "event_type", "ts")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), F.sum("in_window").alias("total"), F.max("in_window").alias("peak"))


def _str1_decisions(spark, sf):
    return rates.rate_decisions(_log(spark, sf), "event_type", "ts", "event_id", "event_type", 600, _LIMITS, 3).drop("ts")


def _stream(spark, sf):
    schema = load(spark, sf, "events").schema
    return files.read_stream(spark, sf, schema, glob="events.parquet")


def _str1_stream(spark, sf):
    count = lambda log: rates.rate_counts_stream(log, "event_type", "ts", "1 hour", "15 minutes", limit=3)
    out = files.run_to_end(_stream(spark, sf), count, "ts")
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "requests", "exceeded")


def _decisions(spark, sf, log):
    decide = lambda rows: rates.rate_decisions_stream(rows, "event_type", "ts", "event_id", "event_type", 600, _LIMITS, 3)
    out = files.run_to_end(log, decide, "ts")
    return out.select(F.col("tie").cast("bigint").alias("event_id"), F.get_json_object("pair", "$[0]").alias("event_type"), "max_requests", "allowed")


def _str1_stream_decisions(spark, sf):
    return _decisions(spark, sf, _stream(spark, sf))


def _str1_stream_files(spark, sf):
    """The same log as ten files that arrive one after the other, each decided with what the ones before have left."""
    path, dealt, events = fresh_path(spark, "event-files"), fresh_path(spark, "event-parts"), load(spark, sf, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    low, high = events.agg(F.min(micros), F.max(micros)).first()
    part = F.least(F.lit(9), F.floor((micros - low) * 10 / max(1, high - low)))
    events.withColumn("__part", part).write.partitionBy("__part").parquet(dealt)
    parts = spark.read.parquet(dealt)
    try:
        for k in range(10):
            parts.filter(F.col("__part") == k).drop("__part").coalesce(1).write.mode("append").parquet(path)
        return _decisions(spark, sf, files.read_stream(spark, path, events.schema, files_per_trigger=1))
    finally:
        drop_path(spark, path)
        drop_path(spark, dealt)


def _str1_one_pair(spark, sf):
    """All events as requests of one caller, above its limit most of the time, decided in slices of a few hundred."""
    log = _log(spark, sf).withColumn("caller", F.lit("one"))
    out = rates.rate_decisions(log, "caller", "ts", "event_id", None, 86400, {}, 40, slice_rows=300)
    return out.select("event_id", "max_requests", "allowed")


def _str2(spark, sf):
    log = _stream(spark, sf).withColumn("seconds", F.col("value") / 100)
    out = files.run_to_end(log, lambda rows: latency.latency_stream(rows, "event_type", "seconds", "ts", "1 day"), "ts")
    return out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


_ABOVE = sorted(SLOW_SECONDS.items(), key=lambda x: x[1])
_SLOW = {name: f"value / 100 > {low}" + (f" AND value / 100 <= {_ABOVE[k + 1][1]}" if k + 1 < len(_ABOVE) else "") for k, (name, low) in enumerate(_ABOVE)}
_LIMIT_CASE = "CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END"


def _decided_sql(pair, top, window):
    """Requests of a pair one after the other: a list carries the allowed times that the next request still sees."""
    return f"""WITH RECURSIVE log AS MATERIALIZED (
        SELECT event_id, user_id, event_type, {pair} AS pair, epoch_us(ts) AS us, CAST({top} AS INTEGER) AS max_requests, row_number() OVER (PARTITION BY {pair} ORDER BY ts, event_id) AS k FROM events
    ), walk(pair, k, recent, allowed) AS (
        SELECT pair, 0::BIGINT, []::BIGINT[], false FROM (SELECT DISTINCT pair FROM log)
        UNION ALL
        SELECT pair, k, CASE WHEN len(live) < max_requests THEN list_append(live, us) ELSE live END, len(live) < max_requests
        FROM (SELECT log.pair, log.k, us, max_requests, list_filter(recent, lambda t: t > us - {window} * 1000000::BIGINT) AS live FROM walk JOIN log ON log.pair = walk.pair AND log.k = walk.k + 1)
    ), decided AS (SELECT event_id, user_id, event_type, max_requests, allowed FROM log JOIN walk USING (pair, k))"""


QUERIES = {
    "str1": _str1,
    "str1_minute": _str1_minute,
    "str1_decisions": _str1_decisions,
    "str1_stream": _str1_stream,
    "str1_stream_decisions": _str1_stream_decisions,
    "str1_stream_files": _str1_stream_files,
    "str1_one_pair": _str1_one_pair,
    "str2": _str2,
}

SQL = {
    "str1": """SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW) AS in_window,
        CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS max_requests,
        count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 600 SECONDS PRECEDING AND CURRENT ROW)
            > CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS exceeded FROM events""",
    "str1_minute": """SELECT event_type, count(*) AS rows, sum(n)::BIGINT AS total, max(n) AS peak FROM (SELECT event_type,
        count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events) GROUP BY 1""",
    "str1_stream": """WITH s AS (SELECT event_type, to_timestamp(floor(epoch(ts) / 900) * 900 - k * 900) AT TIME ZONE 'UTC' AS w FROM events, range(4) r(k))
        SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS requests, count(*) > 3 AS exceeded
        FROM s GROUP BY 1, 2""",
    "str1_decisions": f"{_decided_sql('event_type', _LIMIT_CASE, 600)} SELECT event_id, user_id, event_type, max_requests, allowed FROM decided",
    "str1_stream_decisions": f"{_decided_sql('event_type', _LIMIT_CASE, 600)} SELECT event_id, event_type, max_requests, allowed FROM decided",
    "str1_stream_files": f"{_decided_sql('event_type', _LIMIT_CASE, 600)} SELECT event_id, event_type, max_requests, allowed FROM decided",
    "str1_one_pair": f"""{_decided_sql("'one'", '40', 86400)} SELECT event_id, max_requests, allowed FROM decided""",
    "str2": f"""SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS count,
        {", ".join(f"round(quantile_disc(value / 100, {q}) * 1000, 2) AS p{int(q * 100)}_ms" for q in (0.5, 0.95, 0.99))},
        round(min(value / 100) * 1000, 2) AS min_ms, round(max(value / 100) * 1000, 2) AS max_ms, round(avg(value / 100) * 1000, 2) AS avg_ms,
        {", ".join(f"count(*) FILTER ({c}) AS slow_{n}" for n, c in _SLOW.items())} FROM events GROUP BY 1, 2""",
}
