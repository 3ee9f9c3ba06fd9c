"""Outliers by interquartile range and by z-score."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import IQR_MULTIPLIER, ZSCORE_THRESHOLD
from plumbline.functions.kinds import numeric_columns, ref
from plumbline.operators.quantiles import PERCENTILE_ROWS, quantile_table
from plumbline.operators.wide import per_column


def iqr_bounds(
    df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = IQR_MULTIPLIER, rows: int | None = None, percentile_rows: int = PERCENTILE_ROWS
) -> DataFrame:
    """``column, q1, q3, iqr, lower_bound, upper_bound`` for columns that hold values."""
    columns = list(columns or numeric_columns(df))
    quartiles = quantile_table(df, columns, {"q1": 0.25, "q3": 0.75}, rows, percentile_rows)
    iqr = F.col("q3") - F.col("q1")
    return quartiles.filter(F.col("q1").isNotNull()).select(
        "column", "q1", "q3", iqr.alias("iqr"),
        (F.col("q1") - iqr * multiplier).alias("lower_bound"),
        (F.col("q3") + iqr * multiplier).alias("upper_bound"),
    )


def collect_bounds(bounds: DataFrame) -> dict[str, tuple[float, float]]:
    """Bounds by column on the driver: one small row per column."""
    return {r["column"]: (r["lower_bound"], r["upper_bound"]) for r in bounds.collect()}


def outside(column: str, bounds: tuple[float, float]) -> Column:
    value = ref(column).cast("double")
    return F.coalesce((value < F.lit(bounds[0])) | (value > F.lit(bounds[1])), F.lit(False))


def outlier_counts(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    return per_column(
        df,
        list(bounds),
        {
            "count": lambda c: F.count(ref(c)),
            "outlier_count": lambda c: F.count_if(outside(c, bounds[c])),
        },
    )


def outliers_iqr(df: DataFrame, columns: Sequence[str] | None = None, multiplier: float = IQR_MULTIPLIER, percentile_rows: int = PERCENTILE_ROWS) -> DataFrame:
    """Bounds, number and share of values strictly outside them, one row per column."""
    rows = iqr_bounds(df, columns, multiplier, percentile_rows=percentile_rows).collect()
    limits = {r["column"]: (r["lower_bound"], r["upper_bound"]) for r in rows}
    schema = "column string, q1 double, q3 double, iqr double, lower_bound double, upper_bound double"
    table = df.sparkSession.createDataFrame(rows, schema)
    if not limits:
        return table.selectExpr("*", "0L as outlier_count", "0D as outlier_percentage", "'iqr' as method")
    return table.join(F.broadcast(outlier_counts(df, limits)), "column").select(
        "column", "q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_count",
        F.round(F.try_divide(F.col("outlier_count") * 100.0, F.col("count")), 2).alias("outlier_percentage"),
        F.lit("iqr").alias("method"),
    )


def flag_outliers_iqr(df: DataFrame, column: str, multiplier: float = IQR_MULTIPLIER, name: str = "is_outlier") -> DataFrame:
    limits = collect_bounds(iqr_bounds(df, [column], multiplier))
    flag = outside(column, limits[column]) if column in limits else F.lit(False)
    return df.withColumn(name, flag)


def _z_parameters(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple]:
    rows = per_column(
        df,
        columns,
        {
            "n": lambda c: F.count(ref(c)),
            "mean": lambda c: F.avg(ref(c).cast("double")),
            "std": lambda c: F.stddev_pop(ref(c).cast("double")),
        },
    ).collect()
    return {r["column"]: (r["n"], r["mean"], r["std"]) for r in rows}


def _z_score(column: str, parameters: tuple) -> Column:
    _, mean, std = parameters
    return F.try_divide(F.abs(ref(column).cast("double") - F.lit(mean)), F.lit(std))


def outliers_zscore(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = ZSCORE_THRESHOLD) -> DataFrame:
    """Number and share of values whose distance from the mean exceeds ``threshold`` deviations.

    Columns with fewer than two values are left out; a constant column has no outliers.
    """
    columns = list(columns or numeric_columns(df))
    known = {c: p for c, p in _z_parameters(df, columns).items() if p[0] >= 2}
    if not known:
        return df.sparkSession.createDataFrame(
            [], "column string, threshold double, outlier_count bigint, outlier_percentage double, max_zscore double, method string"
        )
    found = per_column(
        df,
        [c for c in columns if c in known],
        {
            "count": lambda c: F.count(ref(c)),
            "outlier_count": lambda c: F.count_if(_z_score(c, known[c]) > threshold),
            "max_zscore": lambda c: F.coalesce(F.max(_z_score(c, known[c])), F.lit(0.0)),
        },
    )
    return found.select(
        "column", F.lit(float(threshold)).alias("threshold"), "outlier_count",
        F.round(F.col("outlier_count") * 100.0 / F.col("count"), 2).alias("outlier_percentage"),
        "max_zscore", F.lit("zscore").alias("method"),
    )


def flag_outliers_zscore(df: DataFrame, column: str, threshold: float = ZSCORE_THRESHOLD, name: str = "is_outlier") -> DataFrame:
    parameters = _z_parameters(df, [column])[column]
    if parameters[0] < 2:
        return df.withColumn(name, F.lit(False))
    return df.withColumn(name, F.coalesce(_z_score(column, parameters) > threshold, F.lit(False)))
