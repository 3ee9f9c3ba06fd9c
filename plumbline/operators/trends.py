"""Trends over time: date columns, range, linear trend, period aggregates, seasonality and spikes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.fixed import TREND_DATE_FORMATS
from plumbline.functions.kinds import kinds, numeric_columns, ref, temporal_columns
from plumbline.functions.student_t import correlation_p_value
from plumbline.functions.text import matches_any, parse_time
from plumbline.operators.ordering import directional_fill
from plumbline.operators.wide import per_column

PERIODS = ("day", "week", "month", "quarter", "year")


def date_columns(df: DataFrame, least_share: float = 0.0) -> DataFrame:
    """Columns that hold dates by type, or text columns in which some value is written as a date.

    ``least_share`` is the share of a column's values that have to be; by default one is enough.
    """
    own = kinds(df)
    patterns = [p for p, _ in TREND_DATE_FORMATS]
    counts = per_column(
        df,
        df.columns,
        {
            "date_values": lambda c: (
                F.count(ref(c)) if own[c] == "datetime"
                else F.count_if(matches_any(ref(c), patterns)) if own[c] == "string"
                else F.lit(0).cast("bigint")
            ),
            "values": lambda c: F.count(ref(c)),
        },
    )
    by_type = F.col("column").isin(temporal_columns(df) or [""])
    return counts.withColumn("is_date", by_type | (F.col("date_values") > 0) & (F.col("date_values") >= F.col("values") * least_share)).select("position", "column", "is_date", "date_values")


def first_date_column(df: DataFrame, least_share: float = 0.0) -> str | None:
    row = date_columns(df, least_share).filter("is_date").orderBy("position").first()
    return row["column"] if row else None


def parsed_dates(column: Column) -> Column:
    """A date text as a time, by the first format whose pattern the value matches."""
    return F.coalesce(*[F.when(column.rlike(p), parse_time(column, fmt)) for p, fmt in TREND_DATE_FORMATS])


def as_time(df: DataFrame, column: str) -> DataFrame:
    return df if kinds(df)[column] == "datetime" else df.withColumn(column, parsed_dates(ref(column)))


def date_range(df: DataFrame, column: str) -> DataFrame:
    """First and last time and the whole days between them."""
    t = ref(column).cast("timestamp_ntz")
    return as_time(df, column).agg(F.min(t).alias("start"), F.max(t).alias("end")).withColumn(
        "span_days", F.extract(F.lit("DAY"), F.col("end") - F.col("start")).cast("int")
    )


def linear_trend(df: DataFrame, order_by: Sequence[str], columns: Sequence[str] | None = None, rows_per_bucket: int | None = None) -> DataFrame:
    """Slope over the row number in time order after filling gaps forward, one row per column.

    ``order_by`` starts with the time column; further columns break ties.
    """
    columns = list(columns or [c for c in numeric_columns(df) if c != order_by[0]])
    size = {"rows_per_bucket": rows_per_bucket} if rows_per_bucket else {}
    rows = df.select(*dict.fromkeys([*order_by, *columns]))
    rows = directional_fill(rows, [c for c in columns if c not in order_by], order_by, index="x", **size)
    x = F.col("x").cast("double")
    v = lambda c: ref(c).cast("double")
    found = per_column(
        rows,
        columns,
        {
            "n": lambda c: F.count(ref(c)),
            "slope": lambda c: F.regr_slope(v(c), x),
            "r_squared": lambda c: F.regr_r2(v(c), x),
            "first": lambda c: F.min_by(v(c), F.when(ref(c).isNotNull(), F.col("x"))),
            "last": lambda c: F.max_by(v(c), F.when(ref(c).isNotNull(), F.col("x"))),
        },
    ).collect()
    out = []
    for r in found:
        if r["n"] < 3 or r["slope"] is None:
            continue
        slope, r2 = r["slope"], r["r_squared"] if r["r_squared"] is not None else 0.0
        p = correlation_p_value(min(r2, 1.0) ** 0.5, r["n"]) if slope else 1.0
        change = (r["last"] - r["first"]) / abs(r["first"]) * 100 if r["first"] else 0.0
        direction = "increasing" if slope > 0 else "decreasing" if slope < 0 else "stable"
        out.append((r["column"], direction, round(slope, 4), round(r2, 4), round(p, 6), p < 0.05, round(change, 2)))
    return df.sparkSession.createDataFrame(
        out,
        "column string, direction string, slope double, r_squared double, p_value double, significant boolean, change_pct double",
    )


def aggregate_by_period(df: DataFrame, time: str, columns: Sequence[str], period: str = "month", keys: Sequence[str] = ()) -> DataFrame:
    """Count, sum and mean of each column per period."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}")
    start = F.date_trunc(period, ref(time).cast("timestamp_ntz")).cast("timestamp_ntz")
    aggregates = [f(ref(c)).alias(f"{n}_{c}") for c in columns for n, f in (("sum", F.sum), ("avg", F.avg))]
    return df.groupBy(*[ref(k) for k in keys], start.alias("period")).agg(F.count(F.lit(1)).alias("rows"), *aggregates)


def seasonality(df: DataFrame, time: str, column: str) -> DataFrame:
    """Mean of a column by month, quarter and day of the week (1 is Sunday), in long form."""
    t = ref(time)
    seasons = F.array(
        *[
            F.struct(F.lit(name).alias("season"), part.alias("slot"))
            for name, part in (("month", F.month(t)), ("quarter", F.quarter(t)), ("day_of_week", F.dayofweek(t)))
        ]
    )
    return (
        df.select(F.explode(seasons).alias("s"), ref(column).alias("v"))
        .groupBy("s.season", "s.slot")
        .agg(F.count("v").alias("rows"), F.avg("v").alias("average"))
    )


def spikes(df: DataFrame, time: str, column: str, period: str = "day", threshold: float = 3.0) -> DataFrame:
    """Periods whose total lies more than ``threshold`` deviations from the mean of all periods."""
    totals = aggregate_by_period(df, time, [column], period).select("period", F.col(f"sum_{column}").alias("total"))
    level = totals.agg(F.avg("total").alias("mean"), F.stddev_pop("total").alias("std")).first()
    if level["std"] is None:
        return totals.withColumn("z_score", F.lit(None).cast("double")).filter("false")
    z = F.try_divide(F.col("total") - F.lit(level["mean"]), F.lit(level["std"]))
    return totals.withColumn("z_score", z).filter(F.abs("z_score") > threshold)


def first_rows_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; tasks keep ``n`` rows per key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*[ref(k) for k in keys]).orderBy(*order))
    return df.withColumn("__rn", rank).filter(F.col("__rn") <= n).drop("__rn")
