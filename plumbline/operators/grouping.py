"""Grouped aggregates, SQL over a table, summaries, chart data and latency statistics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import SLOW_SECONDS
from plumbline.functions.kinds import kinds, numeric_columns, ref
from plumbline.functions.text import as_number
from plumbline.operators.correlation import pearson_matrix
from plumbline.operators.ordering import value_ranks
from plumbline.operators.wide import collect_wide, stack_rows


def _number(df: DataFrame, column: str) -> Column:
    """The numeric value of a cell; text that is not a number is ignored by every aggregate."""
    kind = kinds(df)[column]
    if kind == "string":
        return as_number(ref(column))
    return ref(column) if kind in ("integer", "float") else F.lit(None).cast("double")


def aggregate(df: DataFrame, function: str, column: str) -> Column:
    name = function.upper()
    if name == "COUNT":
        return F.count(F.lit(1))
    value = _number(df, column)
    zero = F.lit(0)
    made = {
        "SUM": lambda: F.coalesce(F.sum(value), zero),
        "AVG": lambda: F.coalesce(F.avg(value), F.lit(0.0)),
        "MIN": lambda: F.coalesce(F.min(value), zero),
        "MAX": lambda: F.coalesce(F.max(value), zero),
    }
    if name not in made:
        raise ValueError(f"unknown aggregate {function!r}")
    return made[name]()


def group_aggregate(
    df: DataFrame,
    keys: Sequence[str],
    aggregates: Mapping[str, tuple[str, str]],
    order_by: Sequence[Column | str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """``aggregates`` maps an output name to ``(function, column)``.

    COUNT counts rows; SUM, AVG, MIN and MAX of no numbers are 0. The limit takes the first
    groups in the given order, by default that of the keys.
    """
    grouped = df.groupBy(*[ref(k) for k in keys]).agg(
        *[aggregate(df, f, c).alias(name) for name, (f, c) in aggregates.items()]
    )
    return grouped if limit is None else grouped.orderBy(*(order_by or [ref(k) for k in keys])).limit(limit)


def sql_query(df: DataFrame, sql: str, name: str = "dataset") -> DataFrame:
    """Run one SELECT over the table, which the statement calls ``name``.

    The table is registered as a temporary view of that name. Anything but a query is refused.
    """
    first = sql.strip().split(None, 1)[0].upper() if sql.strip() else ""
    if first not in ("SELECT", "WITH"):
        raise ValueError("only a SELECT statement can be run")
    df.createOrReplaceTempView(name)
    return df.sparkSession.sql(sql)


def summarize_all(df: DataFrame) -> DataFrame:
    """Average, total, extremes and count of every numeric column in one row, with the row count."""
    own = kinds(df)
    texts = [c for c, k in own.items() if k == "string"]
    seen = collect_wide(df, {c: F.count(as_number(ref(c))) for c in texts}) if texts else {}
    columns = [c for c, k in own.items() if k in ("integer", "float") or seen.get(c)]
    if not columns:
        return df.sparkSession.createDataFrame([("No numeric columns to aggregate",)], "message string")
    out = []
    for c in columns:
        v = _number(df, c)
        out += [
            F.round(F.avg(v), 2).alias(f"avg_{c}"),
            F.round(F.sum(v), 2).alias(f"total_{c}"),
            F.min(v).alias(f"min_{c}"),
            F.max(v).alias(f"max_{c}"),
            F.count(v).alias(f"count_{c}"),
        ]
    return df.agg(*out, F.count(F.lit(1)).alias("total_rows"))


def kpi_cards(df: DataFrame, k: int | None = None) -> DataFrame:
    """Average of each numeric column, or of the first ``k``, one row per card."""
    columns = numeric_columns(df)[:k]
    wide = df.agg(*[F.avg(ref(c)).alias(f"a{i}") for i, c in enumerate(columns)])
    return stack_rows(
        wide,
        [{"card": F.lit(i), "column": F.lit(c), "aggregation": F.lit("avg"), "value": F.col(f"a{i}")} for i, c in enumerate(columns)],
    )


def dataset_summary(df: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    found = relationships.count() if relationships is not None else 0
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.lit(len(df.columns)).alias("column_count"),
        F.lit(len(numeric_columns(df))).alias("numeric_count"),
        F.lit(found).alias("relationship_count"),
    )


def chart_series(df: DataFrame, x: str, y: str, kind: str = "bar", fraction: float | None = None) -> DataFrame:
    """Points of a chart: totals per ``x`` for bar, line, area and pie, raw pairs for scatter.

    A pie adds each share of the grand total. A scatter may be thinned by ``fraction``. A heatmap
    is the correlation matrix of the numeric columns.
    """
    if kind == "heatmap":
        return pearson_matrix(df)
    if kind == "scatter":
        points = df.select(ref(x).alias("x"), ref(y).alias("y"))
        return points.sample(fraction, 42) if fraction else points
    if kind not in ("bar", "line", "area", "pie"):
        raise ValueError(f"unsupported chart type {kind!r}")
    totals = df.groupBy(ref(x).alias("x")).agg(F.sum(ref(y)).alias("y"))
    if kind != "pie":
        return totals.orderBy("x")
    whole = df.agg(F.sum(ref(y)).alias("whole")).first()["whole"]
    return totals.withColumn("share", F.try_divide(F.col("y").cast("double"), F.lit(whole).cast("double"))).orderBy("x")


def slow_class(seconds: Column) -> Column:
    return (
        F.when(seconds > SLOW_SECONDS["severe"], "severe")
        .when(seconds > SLOW_SECONDS["critical"], "critical")
        .when(seconds > SLOW_SECONDS["warning"], "warning")
    )


def latency_stats(
    log: DataFrame,
    endpoint: str,
    seconds: str,
    status: str | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Per endpoint: count, nearest-rank p50, p95 and p99, extremes, mean, deviation in ms.

    Ranks come from counts per (endpoint, value) in ordered buckets, so an endpoint with a third
    of all requests is spread over many tasks. With a status column the share of statuses below
    500 is added. Slow requests are counted per class.
    """
    size = {"rows_per_bucket": rows_per_bucket} if rows_per_bucket else {}
    ranks = value_ranks(log, [seconds], [endpoint], **size)

    def at(position: Column) -> Column:
        hit = (F.col("below") <= position) & (position < F.col("below") + F.col("n"))
        return F.round(F.max(F.when(hit, ref(seconds))) * 1000, 2)

    total = F.col("total")
    quantiles = ranks.groupBy(ref(endpoint).alias("__e")).agg(
        at(F.floor(total / 2)).alias("p50_ms"),
        at(F.floor(total * 0.95)).alias("p95_ms"),
        at(F.floor(total * 0.99)).alias("p99_ms"),
    )
    v = ref(seconds)
    kind = slow_class(v)
    basics = [
        F.count(v).alias("count"),
        F.round(F.min(v) * 1000, 2).alias("min_ms"),
        F.round(F.max(v) * 1000, 2).alias("max_ms"),
        F.round(F.avg(v) * 1000, 2).alias("avg_ms"),
        F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)) * 1000, 2).alias("std_dev_ms"),
        *[F.count_if(kind == name).alias(f"slow_{name}") for name in SLOW_SECONDS],
    ]
    if status:
        basics.append(F.round(F.try_divide(F.count_if(ref(status) < 500) * 100.0, F.count(ref(status))), 1).alias("success_rate"))
    moments = log.filter(v.isNotNull()).groupBy(ref(endpoint)).agg(*basics)
    return moments.join(quantiles, moments[endpoint].eqNullSafe(quantiles["__e"])).drop("__e")
