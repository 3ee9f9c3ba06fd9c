"""Data quality: missing cells, duplicates, outliers and personal data, and the scores from them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.kinds import comparable_text, numeric_columns, plain_text, ref, string_columns
from plumbline.operators.outliers import collect_bounds, iqr_bounds, outside
from plumbline.operators.pii import PROFILE_TYPES
from plumbline.functions.fixed import PII_PATTERNS
from plumbline.functions.text import matches_any
from plumbline.operators.profile import cardinality, first_values, missing_counts, percent
from plumbline.operators.wide import per_column


def row_groups(df: DataFrame) -> DataFrame:
    """Copies per distinct row. Copies collapse before the shuffle, however many there are."""
    types = {f.name: f.dataType for f in df.schema.fields}
    keys = [
        comparable_text(ref(c), types[c]).alias(c) if isinstance(types[c], T.MapType) else ref(c) for c in df.columns
    ]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__copies"))


def table_profile(df: DataFrame) -> DataFrame:
    """One row for the whole table: rows, columns, bytes of its values as text, and whether rows repeat."""
    types = {f.name: f.dataType for f in df.schema.fields}
    size = reduce(add, [F.coalesce(F.octet_length(plain_text(ref(c), types[c])), F.lit(0)) for c in df.columns])
    copies = F.col("__copies")
    return row_groups(df).agg(
        F.coalesce(F.sum(copies), F.lit(0)).alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.coalesce(F.sum(size * copies), F.lit(0)).alias("bytes"), F.coalesce(F.max(copies) > 1, F.lit(False)).alias("has_duplicate_rows"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows that belong to a duplicated group, surplus copies, and whether there are any."""
    copies = F.col("__copies")
    rows = F.coalesce(F.sum(copies), F.lit(0))
    return row_groups(df).agg(
        rows.alias("rows"),
        F.coalesce(F.sum(F.when(copies > 1, copies)), F.lit(0)).alias("duplicate_count"),
        F.coalesce(F.sum(copies - 1), F.lit(0)).alias("surplus_copies"),
        percent(F.coalesce(F.sum(F.when(copies > 1, copies)), F.lit(0)), rows).alias("duplicate_percentage"),
        F.coalesce(F.max(copies) > 1, F.lit(False)).alias("has_duplicate_rows"),
    )


def quality_columns(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """One row per column: nulls, cardinality, IQR outliers and whether personal data was found."""
    numbers, texts = numeric_columns(df), set(string_columns(df))
    bounds = collect_bounds(iqr_bounds(df, numbers)) if numbers else {}
    patterns = [PII_PATTERNS[t] for t in PROFILE_TYPES]
    stats = per_column(
        df,
        df.columns,
        {
            "rows": lambda c: F.count(F.lit(1)),
            "null_count": lambda c: F.count_if(ref(c).isNull()),
            "outlier_count": lambda c: F.count_if(outside(c, bounds[c])) if c in bounds else F.lit(0).cast("bigint"),
            "has_pii": lambda c: (
                F.coalesce(F.max(matches_any(ref(c), patterns)), F.lit(False)) if c in texts else F.lit(False)
            ),
        },
    ).join(F.broadcast(cardinality(df).drop("position")), "column")
    unique = F.col("distinct_values") + (F.col("null_count") > 0).cast("bigint")
    out = stats.select(
        "position", "column", "rows", "null_count",
        percent(F.col("null_count"), F.col("rows")).alias("null_percentage"),
        unique.alias("cardinality"),
        F.coalesce(F.round(F.try_divide(unique, F.col("rows") - F.col("null_count")), 4), F.lit(0.0)).alias("cardinality_ratio"),
        "outlier_count", "has_pii",
    )
    if order_by:
        found = first_values(df, df.columns, order_by, 3)
        out = out.join(F.broadcast(found.select("column", "samples")), "column", "left")
    return out


def score(missing: Column, outliers: Column, duplicates: Column, pii: Column, cells: Column, columns: Column) -> Column:
    """Quality between 0 and 1 from shares of missing cells, outliers, duplicates and PII columns."""
    share = lambda part: F.coalesce(F.try_divide(part.cast("double"), F.greatest(cells, F.lit(1))), F.lit(0.0))
    penalty = (
        share(missing) * 0.4
        + F.least(share(outliers), F.lit(0.1)) * 0.3
        + F.least(share(duplicates), F.lit(0.1)) * 0.2
        + F.coalesce(F.try_divide(pii.cast("double"), F.greatest(columns, F.lit(1))), F.lit(0.0)) * 0.1
    )
    return F.round(F.greatest(F.lit(0.0), F.lit(1.0) - penalty), 4)


def _side_by_side(*rows: DataFrame) -> DataFrame:
    """Tables of one row each as one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), rows)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def quality_summary(columns: DataFrame, duplicates: DataFrame) -> DataFrame:
    """One row for the table from :func:`quality_columns` and :func:`duplicate_rows`."""
    totals = columns.agg(
        F.sum("rows").alias("total_cells"),
        F.sum("null_count").alias("total_missing"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_missing"),
        F.sum("outlier_count").alias("total_outliers"),
        F.count_if("has_pii").alias("pii_columns"),
        F.count(F.lit(1)).alias("total_columns"),
    )
    return _side_by_side(totals, duplicates.select("duplicate_count", "duplicate_percentage")).select(
        "total_cells", "total_missing",
        percent(F.col("total_missing"), F.col("total_cells")).alias("missing_percentage"),
        "columns_with_missing", "total_outliers", "duplicate_count", "duplicate_percentage", "pii_columns",
        score(
            F.col("total_missing"), F.col("total_outliers"), F.col("duplicate_count"), F.col("pii_columns"),
            F.col("total_cells"), F.col("total_columns"),
        ).alias("quality_score"),
    )


def quality_profile(df: DataFrame, order_by: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Per-column rows and the one-row table summary."""
    columns = quality_columns(df, order_by)
    return columns, quality_summary(columns, duplicate_rows(df))


def quality_metrics(df: DataFrame) -> DataFrame:
    """The variant that counts empty text as missing and only surplus copies as duplicates."""
    cells = missing_counts(df, treat_empty_as_null=True).agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_cells"),
        F.coalesce(F.sum("null_count"), F.lit(0)).alias("total_missing"),
        F.count_if(F.col("null_count") > 0).alias("columns_with_missing"),
    )
    copies = duplicate_rows(df).select("rows", F.col("surplus_copies").alias("duplicate_rows"))
    missing = percent(F.col("total_missing"), F.col("total_cells"))
    spread = F.coalesce(F.try_divide(F.col("duplicate_rows"), F.col("rows")), F.lit(0.0)) * 0.1
    return _side_by_side(cells, copies).select(
        "total_cells", "total_missing", missing.alias("missing_percentage"), "columns_with_missing", "duplicate_rows",
        F.greatest(F.lit(0.0), F.round(1 - missing / 100 - spread, 4)).alias("quality_score"),
    )
