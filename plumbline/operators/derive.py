"""Derived columns and their validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.kinds import kind_of, numeric_columns, quoted, ref
from plumbline.operators.audit import AuditEntry, audit_frame
from plumbline.operators.wide import per_item

MAX_RATIOS = 5


@dataclass(frozen=True)
class DerivedColumn:
    name: str
    expression: str
    data_type: str = "double"
    rules: Sequence[str] = field(default_factory=tuple)


def derive(df: DataFrame, name: str, expression: str) -> DataFrame:
    """Add a column from a SQL expression over the row.

    Analysis rejects unknown columns; an aggregate or a generator is not one value per row and is
    rejected as well.
    """
    out = df.withColumn(name, F.expr(expression))
    plan = out._jdf.queryExecution().analyzed()
    if plan.nodeName() != "Project" or plan.children().head().nodeName() == "Generate":
        raise ValueError(f"{expression!r} is not one value per row")
    return out


def derive_all(df: DataFrame, specs: Sequence[DerivedColumn]) -> tuple[DataFrame, DataFrame]:
    """Add columns one after the other; one that cannot be analysed is recorded and left out."""
    result, entries = df, []
    for spec in specs:
        try:
            result = derive(result, spec.name, spec.expression)
            entries.append(AuditEntry("derive", spec.name, "derived column", spec.expression))
        except (PySparkException, ValueError) as error:
            entries.append(
                AuditEntry("derive", spec.name, "derived column", spec.expression, "failed", error=str(error).split("\n")[0])
            )
    return result, audit_frame(df.sparkSession, entries)


def ratio_specs(columns: Sequence[str], k: int = MAX_RATIOS) -> list[DerivedColumn]:
    """``a_to_b_ratio`` of neighbouring numeric columns, at most ``k``."""
    return [
        DerivedColumn(f"{a}_to_{b}_ratio", f"try_divide({quoted(a)}, {quoted(b)})", "double", ("no_zero_denominator",))
        for a, b in list(zip(columns, columns[1:]))[:k]
    ]


def derive_ratios(df: DataFrame, columns: Sequence[str] | None = None, k: int = MAX_RATIOS) -> DataFrame:
    """Division by zero gives null."""
    columns = list(columns or numeric_columns(df))
    return df.withColumns({s.name: F.expr(s.expression) for s in ratio_specs(columns, k)})


def difference_spec(columns: Sequence[str]) -> DerivedColumn:
    a, b = columns[:2]
    return DerivedColumn(f"{a}_minus_{b}", f"{quoted(a)} - {quoted(b)}")


def derive_difference(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    spec = difference_spec(list(columns or numeric_columns(df)))
    return df.withColumn(spec.name, F.expr(spec.expression))


def row_average_spec(columns: Sequence[str]) -> DerivedColumn:
    chosen = columns[:3]
    total = " + ".join(f"coalesce(cast({quoted(c)} as double), 0D)" for c in chosen)
    present = " + ".join(f"cast({quoted(c)} is not null as int)" for c in chosen)
    return DerivedColumn("avg_top_3_numeric", f"try_divide({total}, {present})")


def derive_row_average(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean of the present values among the first three numeric columns of each row."""
    spec = row_average_spec(list(columns or numeric_columns(df)))
    return df.withColumn(spec.name, F.expr(spec.expression))


def suggest_derived(df: DataFrame, k: int = MAX_RATIOS) -> list[DerivedColumn]:
    """Ratios first; difference and row average only while there is room."""
    columns = numeric_columns(df)
    specs = ratio_specs(columns, k)
    if len(columns) >= 2 and len(specs) < k:
        specs.append(difference_spec(columns))
    if len(columns) >= 2 and len(specs) < k:
        specs.append(row_average_spec(columns))
    return specs


def bin_label(column: Column, breaks: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval ``(low, high]`` that holds the value; null outside all of them."""
    if len(labels) != len(breaks) - 1:
        raise ValueError("one label per interval is needed")
    out = F.lit(None).cast("string")
    for low, high, label in reversed(list(zip(breaks, breaks[1:], labels))):
        out = F.when((column > low) & (column <= high), F.lit(label)).otherwise(out)
    return out


def derive_bins(df: DataFrame, column: str, breaks: Sequence[float], labels: Sequence[str], name: str | None = None) -> DataFrame:
    return df.withColumn(name or f"{column}_bin", bin_label(ref(column), breaks, labels))


def validate_columns(
    df: DataFrame,
    specs: Sequence[DerivedColumn],
    expected_rows: int | None = None,
    denominators: Mapping[str, str] | None = None,
) -> DataFrame:
    """Check all derived columns in one pass: type, NaN, infinity, nulls and the rules of each.

    ``no_zero_denominator`` tests the result for zeros; with ``denominators`` (derived name to
    column) the zeros of the denominator are counted too. Unknown rules pass.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    by_name = {s.name: s for s in specs}
    denominators = denominators or {}
    none = F.lit(0).cast("bigint")

    def number(c: str, condition) -> Column:
        return F.count_if(condition(ref(c))) if kind_of(types[c]) in ("integer", "float") else none

    counts = per_item(
        df,
        [s.name for s in specs],
        lambda c: {
            "column": F.lit(c),
            "actual_type": F.lit(types[c].simpleString()),
            "type_matches": F.lit(by_name[c].data_type.lower() in types[c].simpleString()),
            "rules": F.array(*[F.lit(r) for r in by_name[c].rules]).cast("array<string>"),
        },
        {
            "rows": lambda c: F.count(F.lit(1)),
            "null_count": lambda c: F.count_if(ref(c).isNull()),
            "nan_count": lambda c: number(c, lambda v: F.isnan(v.cast("double"))),
            "inf_count": lambda c: number(c, lambda v: F.abs(v.cast("double")) == float("inf")),
            "zero_count": lambda c: number(c, lambda v: v == 0),
            "negative_count": lambda c: number(c, lambda v: v < 0),
            "zero_denominators": lambda c: number(denominators[c], lambda v: v == 0) if c in denominators else none,
        },
    )
    asked = lambda rule: F.array_contains("rules", rule)
    errors = F.array_compact(
        F.array(
            F.when(~F.col("type_matches"), "type_mismatch"),
            F.when(F.lit(expected_rows is not None) & (F.col("rows") != F.lit(expected_rows or 0)), "length_mismatch"),
            F.when(F.col("nan_count") > 0, "nan_values"),
            F.when(F.col("inf_count") > 0, "infinite_values"),
            F.when(F.col("null_count") == F.col("rows"), "all_null"),
            F.when(asked("no_zero_denominator") & (F.col("zero_count") > 0), "no_zero_denominator"),
            F.when(asked("no_zero_denominator") & (F.col("zero_denominators") > 0), "zero_in_denominator"),
            F.when(asked("non_negative") & (F.col("negative_count") > 0), "non_negative"),
            F.when(asked("no_null") & (F.col("null_count") > 0), "no_null"),
        )
    )
    return counts.withColumn("errors", errors).withColumn("passed", F.size("errors") == 0)
