"""Column profiles: schema, types, univariate statistics and confidence bands."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.fixed import (
    DATE_TEXT_PATTERNS,
    DATETIME_TEXT_PATTERNS,
    INFERRED_FORMATS,
)
from plumbline.functions.kinds import comparable_text, kind_of, kinds, numeric_columns, plain_text, ref
from plumbline.functions.text import as_number, is_missing, matches_any
from plumbline.operators.quantiles import PERCENTILE_ROWS, order_statistics, quantile_table
from plumbline.operators.wide import at_hand, chunks, is_plain_scan, per_column, per_item, spread, stack_rows


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    """``part`` as a rounded percentage of ``whole``; 0 when there is nothing to divide by."""
    return F.coalesce(F.round(F.try_divide(part * 100.0, whole), digits), F.lit(0.0))


def first_values(df: DataFrame, columns: Sequence[str], order_by: Sequence[str], k: int = 5) -> DataFrame:
    """The first ``k`` non-null values of each column in the given order, as text.

    Each column is a top-k that keeps ``k`` rows per task, so nothing but the samples is shuffled.
    """
    place = {c: i for i, c in enumerate(df.columns)}
    types = {f.name: f.dataType for f in df.schema.fields}
    parts = []
    for c in columns:
        top = (
            df.filter(ref(c).isNotNull())
            .select(*[ref(o).alias(f"o{i}") for i, o in enumerate(order_by)], plain_text(ref(c), types[c]).alias("v"))
            .orderBy(*[f"o{i}" for i in range(len(order_by))], "v")
            .limit(k)
        )
        pairs = F.sort_array(F.collect_list(F.struct(*[f"o{i}" for i in range(len(order_by))], "v")))
        parts.append(
            top.agg(F.transform(pairs, lambda p: p["v"]).alias("samples")).select(
                F.lit(place[c]).alias("position"), F.lit(c).alias("column"), "samples"
            )
        )
    return reduce(DataFrame.unionByName, parts)


def _cell_bytes(column: Column, data_type: T.DataType) -> Column:
    """Approximate size of a value: type width, or the length of text."""
    widths = {T.ByteType: 1, T.BooleanType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4}
    if isinstance(data_type, T.StringType):
        return F.octet_length(column)
    if kind_of(data_type) in ("list", "struct", "other"):
        return F.octet_length(F.to_json(F.struct(column.alias("v"))))
    return F.when(column.isNotNull(), F.lit(widths.get(type(data_type), 8)))


def _distinct_key(df: DataFrame, c: str) -> Column:
    data_type = df.schema[c].dataType
    if kind_of(data_type) in ("list", "struct", "other"):
        return F.when(ref(c).isNotNull(), comparable_text(ref(c), data_type))
    return ref(c)


def cardinality(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Distinct non-null values per column: exact, or by HyperLogLog without a shuffle of values.

    Exact counts of a stored table read and group each column by itself. On a derived table, which
    would be computed once per column that way, they come from one pass that multiplies its rows.
    """
    columns = list(columns or df.columns)
    if approximate or not is_plain_scan(df):
        count = F.approx_count_distinct if approximate else F.count_distinct
        return per_column(df, columns, {"distinct_values": lambda c: count(_distinct_key(df, c))})
    place = {c: i for i, c in enumerate(df.columns)}
    parts = [
        df.select(_distinct_key(df, c).alias("v")).distinct().agg(F.count("v").alias("distinct_values"))
        .select(F.lit(place[c]).alias("position"), F.lit(c).alias("column"), "distinct_values")
        for c in columns
    ]
    return reduce(DataFrame.unionByName, parts)


def profile_schema(
    df: DataFrame, order_by: Sequence[str] | None = None, samples: int = 5, approximate: bool = False
) -> DataFrame:
    """One row per column: type, nulls, cardinality (null counts as a value), size and flags.

    Samples are added when an order is given, because rows have no order of their own.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    measures = {
        "rows": lambda c: F.count(F.lit(1)),
        "null_count": lambda c: F.count_if(ref(c).isNull()),
        "size_bytes": lambda c: F.coalesce(F.sum(_cell_bytes(ref(c), types[c])), F.lit(0)),
    }
    stats = per_column(df, df.columns, measures).join(F.broadcast(cardinality(df, approximate=approximate).drop("position")), "column")
    labels = _labels(
        "column", {c: (f"{t.simpleString()}", kind_of(t)) for c, t in types.items()}, ("dtype", "dtype_category")
    )
    unique = F.col("distinct_values") + (F.col("null_count") > 0).cast("bigint")
    out = stats.select(
        "position",
        "column",
        *labels,
        "rows",
        "null_count",
        percent(F.col("null_count"), F.col("rows")).alias("null_percentage"),
        unique.alias("cardinality"),
        percent(unique, F.col("rows")).alias("cardinality_ratio"),
        "size_bytes",
        F.col("column").isin(numeric_columns(df) or [""]).alias("is_numeric"),
        ((unique >= 1) & (unique <= 20)).alias("is_categorical"),
        F.col("column").isin([c for c, k in kinds(df).items() if k == "datetime"] or [""]).alias("is_datetime"),
    )
    if order_by:
        found = first_values(df, df.columns, order_by, samples)
        out = out.join(F.broadcast(found.select("column", "samples")), "column", "left")
    return out


def _labels(key: str, values: dict[str, tuple], names: Sequence[str]) -> list[Column]:
    """Constant labels per key as map lookups."""
    return [
        F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v[i])])[F.col(key)].alias(n)
        for i, n in enumerate(names)
    ]


def schema_summary(profile: DataFrame) -> DataFrame:
    """Table-level counts from the rows of :func:`profile_schema`."""
    text = ~F.col("is_numeric") & ~F.col("is_categorical") & ~F.col("is_datetime")
    return profile.agg(
        F.count(F.lit(1)).alias("total_columns"),
        F.count_if("is_numeric").alias("numeric_columns"),
        F.count_if("is_categorical").alias("categorical_columns"),
        F.count_if("is_datetime").alias("datetime_columns"),
        F.count_if(text).alias("text_columns"),
        F.round(F.avg("null_percentage"), 2).alias("null_percentage_total"),
        F.round(F.avg("cardinality"), 1).alias("avg_cardinality"),
    )


QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
TAILS = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def univariate_stats(
    df: DataFrame, columns: Sequence[str] | None = None, quantiles: dict[str, float] | None = None, percentile_rows: int = PERCENTILE_ROWS
) -> DataFrame:
    """Moments, extremes and quartiles of every numeric column; columns without values are left out.

    Skewness and excess kurtosis are the population forms, 0 for fewer than three values and null
    for a constant column, where they are undefined. ``quantiles`` adds further named fractions.
    """
    columns = list(columns or numeric_columns(df))
    x = lambda c: ref(c).cast("double")
    place = {c: i for i, c in enumerate(df.columns)}
    measures = {
        "mean": lambda c: F.avg(x(c)),
        "std": lambda c: F.coalesce(F.stddev_samp(x(c)), F.lit(0.0)),
        "variance": lambda c: F.coalesce(F.var_samp(x(c)), F.lit(0.0)),
        "min": lambda c: F.min(x(c)),
        "max": lambda c: F.max(x(c)),
        "skewness": lambda c: F.when(F.count(ref(c)) <= 2, F.lit(0.0)).otherwise(F.skewness(x(c))),
        "kurtosis": lambda c: F.when(F.count(ref(c)) <= 2, F.lit(0.0)).otherwise(F.kurtosis(x(c))),
        "zero_count": lambda c: F.count_if(x(c) == 0),
        "inf_count": lambda c: F.count_if(F.abs(x(c)) == float("inf")),
        "null_count": lambda c: F.count_if(ref(c).isNull()),
        "count": lambda c: F.count(ref(c)),
    }
    with spread(df, columns) as rows:
        stats = at_hand(per_item(rows, columns, lambda c: {"position": F.lit(place[c]), "column": F.lit(c)}, measures))
        counts = {r["column"]: (r["count"], r["count"] + r["null_count"]) for r in stats.select("column", "count", "null_count").collect()}
        known = {c: n for c, (n, _) in counts.items()}
        total = max(n for _, n in counts.values())
        fractions = at_hand(quantile_table(rows, columns, {**QUARTILES, **(quantiles or {})}, total, percentile_rows, counts=known))
    out = (
        stats.filter(F.col("count") > 0)
        .join(F.broadcast(fractions), "column")
        .withColumn("iqr", F.col("q3") - F.col("q1"))
    )
    return out if quantiles else out.drop("inf_count")


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table of numeric values: ``column, value, n``. Copies collapse before the shuffle."""
    parts = []
    for chunk in chunks(list(columns), 100):
        rows = [{"column": F.lit(c), "value": ref(c).cast("double")} for c in chunk]
        parts.append(stack_rows(df, rows).filter(F.col("value").isNotNull()))
    return reduce(DataFrame.unionByName, parts).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def modes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value of each numeric column and its count; the smallest value wins a tie."""
    best = F.min(F.struct((-F.col("n")).alias("m"), F.col("value"))).alias("b")
    if is_plain_scan(df):
        counts = [
            df.select(ref(c).cast("double").alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count(F.lit(1)).alias("n"))
            for c in columns
        ]
        found = reduce(DataFrame.unionByName, [n.agg(best).select(F.lit(c).alias("column"), "b") for c, n in zip(columns, counts)])
    else:
        found = value_counts(df, columns).groupBy("column").agg(best)
    return found.select("column", F.col("b.value").alias("mode"), (-F.col("b.m")).alias("mode_count"))


def univariate_detailed(df: DataFrame, columns: Sequence[str] | None = None, percentile_rows: int = PERCENTILE_ROWS) -> DataFrame:
    """:func:`univariate_stats` with variation, range, mode, outer percentiles and infinities.

    Computed for columns with at least two values.
    """
    columns = list(columns or numeric_columns(df))
    variation = F.coalesce(F.round(F.try_divide(F.col("std"), F.abs(F.col("mean"))), 4), F.lit(0.0))
    return (
        univariate_stats(df, columns, TAILS, percentile_rows)
        .filter(F.col("count") >= 2)
        .join(F.broadcast(modes(df, columns)), "column")
        .withColumns({"cv": variation, "range": F.col("max") - F.col("min")})
    )


def univariate_stats_nearest(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Statistics rounded to 4 digits with quartiles taken at a rank, not interpolated."""
    columns = list(columns or numeric_columns(df))
    counts, values = order_statistics(
        df, {c: lambda n: [n // 4, 3 * n // 4, n // 2, max(n // 2 - 1, 0)] for c in columns}
    )
    quartiles = []
    for c in columns:
        n = counts[c]
        if not n:
            continue
        q1, q3, upper = values[(c, n // 4)], values[(c, 3 * n // 4)], values[(c, n // 2)]
        median = (values[(c, n // 2 - 1)] + upper) / 2 if n % 2 == 0 else upper
        quartiles.append((c, float(q1), float(median), float(q3)))
    x = lambda c: ref(c).cast("double")
    stats = per_column(
        df,
        columns,
        {
            "mean": lambda c: F.round(F.avg(x(c)), 4),
            "std": lambda c: F.round(F.coalesce(F.stddev_samp(x(c)), F.lit(0.0)), 4),
            "min": lambda c: F.round(F.min(x(c)), 4),
            "max": lambda c: F.round(F.max(x(c)), 4),
            "null_count": lambda c: F.count_if(ref(c).isNull()),
            "count": lambda c: F.count(ref(c)),
        },
    )
    ranks = df.sparkSession.createDataFrame(quartiles, "column string, q1 double, median double, q3 double")
    return stats.join(F.broadcast(ranks), "column").select(
        "position", "column", "mean", F.round("median", 4).alias("median"), "std", "min", "max",
        F.round("q1", 4).alias("q1"), F.round("q3", 4).alias("q3"),
        F.round(F.col("q3") - F.col("q1"), 4).alias("iqr"), "null_count", "count",
    )


def _first_text(c: str, data_type: T.DataType, order_by: Sequence[str]) -> Column:
    """Aggregate: the text of the first non-null value in the given order."""
    return F.min_by(
        plain_text(ref(c), data_type), F.when(ref(c).isNotNull(), F.struct(*[ref(o) for o in order_by]))
    )


def column_types(df: DataFrame, order_by: Sequence[str], samples: int = 5) -> DataFrame:
    """Type of each column by its cells: boolean, number, date, string or unknown, in that order.

    Text columns count as boolean or number when every non-null value is one; a date is recognised
    by the first value in the given order.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def all_cells(c: str, kind: str) -> Column:
        own = kind_of(types[c])
        if own == "string":
            cell = ref(c).isin("true", "false") if kind == "boolean" else as_number(ref(c)).isNotNull()
            return F.count_if(cell) == F.count(ref(c))
        return F.lit(own == "boolean" if kind == "boolean" else own in ("integer", "float"))

    def type_of(c: str) -> Column:
        dated = (
            F.lit(True) if kind_of(types[c]) == "datetime"
            else _first_text(c, types[c], order_by).rlike(r"^\d{4}-\d{2}-\d{2}")
        )
        return (
            F.when(F.count(ref(c)) == 0, "unknown")
            .when(all_cells(c, "boolean"), "boolean")
            .when(all_cells(c, "number"), "number")
            .when(dated, "date")
            .otherwise("string")
        )

    stats = per_column(
        df,
        df.columns,
        {
            "dtype": type_of,
            "null_count": lambda c: F.count_if(ref(c).isNull()),
            "rows": lambda c: F.count(F.lit(1)),
        },
    ).join(F.broadcast(cardinality(df).drop("position").withColumnRenamed("distinct_values", "cardinality")), "column")
    out = stats.select(
        "position", "column", "dtype", "null_count",
        percent(F.col("null_count"), F.col("rows")).alias("null_percentage"), "cardinality",
    )
    found = first_values(df, df.columns, order_by, samples)
    return out.join(F.broadcast(found.select("column", "samples")), "column")


def infer_types(df: DataFrame, order_by: Sequence[str], samples: int = 5) -> DataFrame:
    """Logical type of each column with a confidence, a date format, nullability and samples.

    Date texts are recognised by the first value in the given order; the numeric test looks at
    every value.
    """
    types = {f.name: f.dataType for f in df.schema.fields}

    def text_only(c: str, make) -> Column:
        return make(ref(c)) if kind_of(types[c]) == "string" else F.lit(None)

    stats = per_column(
        df,
        df.columns,
        {
            "rows": lambda c: F.count(F.lit(1)),
            "values": lambda c: F.count(ref(c)),
            "first_value": lambda c: _first_text(c, types[c], order_by),
            "avg_length": lambda c: F.avg(text_only(c, F.length).cast("double")),
            "numbers": lambda c: F.count(text_only(c, lambda v: as_number(F.regexp_replace(v, "[,$€]", ""))).cast("double")),
        },
    ).join(F.broadcast(cardinality(df).drop("position")), "column")
    kind = _labels("column", {c: (kind_of(t),) for c, t in types.items()}, ("kind",))[0]
    ratio = F.coalesce(F.try_divide(F.col("distinct_values"), F.col("values")), F.lit(0.0))
    first = F.coalesce(F.col("first_value"), F.lit(""))
    is_text = F.col("kind") == "string"
    rules = [
        ((F.col("kind") == "integer") & (F.col("distinct_values") <= 2) & (F.col("rows") > 0), "boolean", 0.85),
        (F.col("kind") == "integer", "int", 0.95),
        (F.col("kind") == "float", "float", 0.95),
        (F.col("kind") == "boolean", "boolean", 0.98),
        ((F.col("kind") == "datetime") & F.col("column").isin([c for c, t in types.items() if isinstance(t, T.DateType)] or [""]), "date", 0.90),
        (F.col("kind") == "datetime", "datetime", 0.90),
        (is_text & matches_any(first, DATE_TEXT_PATTERNS), "date", 0.70),
        (is_text & matches_any(first, DATETIME_TEXT_PATTERNS), "datetime", 0.70),
        (is_text & (ratio < 0.1) & (F.col("distinct_values") <= 20), "categorical", 0.85),
        (is_text & (F.col("numbers") == F.col("values")), "float", 0.60),
        (is_text & ((F.coalesce("avg_length", F.lit(0.0)) > 50) | (ratio > 0.8)), "text", 0.75),
        (is_text, "str", 0.80),
    ]
    detected, confidence = F.lit("unknown"), F.lit(0.30)
    for condition, name, score in reversed(rules):
        detected = F.when(condition, F.lit(name)).otherwise(detected)
        confidence = F.when(condition, F.lit(score)).otherwise(confidence)
    spec = F.lit(None).cast("string")
    for pattern, fmt in reversed(INFERRED_FORMATS):
        spec = F.when(first.rlike(pattern), F.lit(fmt)).otherwise(spec)
    out = stats.withColumn("kind", kind).select(
        "position",
        "column",
        detected.alias("detected_type"),
        F.when(detected.isin("date", "datetime") & is_text, spec).alias("format_spec"),
        confidence.alias("confidence"),
        (F.col("values") < F.col("rows")).alias("nullable"),
    )
    found = first_values(df, df.columns, order_by, samples)
    return out.join(F.broadcast(found.select("column", "samples")), "column")


def overall_confidence(df: DataFrame, column: str = "confidence") -> DataFrame:
    return df.agg(F.round(F.coalesce(F.avg(ref(column)), F.lit(0.0)), 4).alias("overall_confidence"))


def confidence_level(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.90, "high")
        .when(confidence >= 0.70, "medium")
        .when(confidence >= 0.50, "low")
        .otherwise("very_low")
    )


def badge_color(confidence: Column) -> Column:
    return (
        F.when(confidence >= 0.90, "green")
        .when(confidence >= 0.70, "yellow")
        .when(confidence >= 0.50, "orange")
        .otherwise("red")
    )


def with_confidence_level(df: DataFrame, column: str = "confidence") -> DataFrame:
    return df.withColumn("level", confidence_level(ref(column))).withColumn("color", badge_color(ref(column)))


def confidence_levels(df: DataFrame, column: str = "confidence") -> DataFrame:
    """Rows per confidence level."""
    return with_confidence_level(df, column).groupBy("level", "color").agg(F.count(F.lit(1)).alias("sections"))


def numeric_profile(df: DataFrame) -> DataFrame:
    """Per column: values, how many of them are numbers (text included), and whether all or some are."""
    own = kinds(df)

    def numbers(c: str) -> Column:
        if own[c] in ("integer", "float"):
            return F.count(ref(c))
        return F.count(as_number(ref(c))) if own[c] == "string" else F.lit(0).cast("bigint")

    counts = per_column(df, df.columns, {"values": lambda c: F.count(ref(c)), "numbers": numbers})
    return counts.withColumns(
        {
            "all_numbers": (F.col("values") > 0) & (F.col("numbers") == F.col("values")),
            "some_number": F.col("numbers") > 0,
        }
    )


def loose_numeric_columns(df: DataFrame, strict: bool = True) -> list[str]:
    """Columns of numbers, text columns included: every value (strict) or some value is a number."""
    own = kinds(df)
    texts = [c for c, k in own.items() if k == "string"]
    flag = "all_numbers" if strict else "some_number"
    found = {r["column"] for r in numeric_profile(df.select(*[ref(c) for c in texts])).collect() if r[flag]} if texts else set()
    return [c for c, k in own.items() if k in ("integer", "float") or c in found]


def missing_counts(df: DataFrame, treat_empty_as_null: bool = False) -> DataFrame:
    own = kinds(df)
    return per_column(
        df,
        df.columns,
        {
            "rows": lambda c: F.count(F.lit(1)),
            "null_count": lambda c: F.count_if(is_missing(ref(c), own[c] == "string", treat_empty_as_null)),
        },
    )
