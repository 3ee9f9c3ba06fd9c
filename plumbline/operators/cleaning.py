"""Imputation, capping, duplicate removal and the cleaning plan."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import CONFIDENCE_GATE
from plumbline.functions.kinds import kinds, numeric_columns, ref
from plumbline.functions.text import is_missing
from plumbline.operators.audit import AuditEntry, audit_frame
from plumbline.operators.ordering import directional_fill
from plumbline.operators.pii import mask_pii, mask_pii_values
from plumbline.operators.profile import loose_numeric_columns
from plumbline.operators.quantiles import PERCENTILE_ROWS, quantile_table
from plumbline.operators.wide import per_column

STRATEGIES = ("mean", "median", "mode", "zero", "forward", "backward")


@dataclass(frozen=True)
class CleaningOperation:
    column: str
    strategy: str
    issue: str = ""
    parameters: Mapping = field(default_factory=dict)
    confidence: float = 1.0


def most_frequent(df: DataFrame, columns: Sequence[str], ignore_empty: bool = False) -> dict:
    """Most frequent non-null value of each column; the smallest value wins a tie.

    Values collapse to counts before the shuffle and the best pair is found by a partial
    aggregate, so neither a hot value nor a column of distinct values gathers in one task.
    """
    texts = {c for c, k in kinds(df).items() if k == "string"}
    found = {}
    for c in columns:
        kept = df.filter(~is_missing(ref(c), c in texts, ignore_empty)).select(ref(c).alias("v"))
        counts = kept.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        best = counts.agg(F.min(F.struct((-F.col("n")).alias("m"), "v")).alias("b")).first()["b"]
        found[c] = best["v"] if best is not None else None
    return found


def _means(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[int, float | None]]:
    rows = per_column(
        df,
        columns,
        {"nulls": lambda c: F.count_if(ref(c).isNull()), "mean": lambda c: F.avg(ref(c).cast("double"))},
    ).collect()
    return {r["column"]: (r["nulls"], r["mean"]) for r in rows}


def fill_constants(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls by one value per column; a fractional value makes an integer column double."""
    own = kinds(df)
    out = {}
    for c, value in values.items():
        if value is None:
            continue
        column = ref(c).cast("double") if own[c] == "integer" and isinstance(value, float) else ref(c)
        out[c] = F.coalesce(column, F.lit(value))
    return df.withColumns(out) if out else df


def impute(
    df: DataFrame,
    strategy: str = "mean",
    columns: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    percentile_rows: int = PERCENTILE_ROWS,
) -> DataFrame:
    """Fill nulls. Mean, median and zero apply to numeric columns; others stay as they are.

    ``forward`` and ``backward`` need ``order_by``, because rows have no order of their own.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown imputation strategy: {strategy}")
    columns = list(columns or df.columns)
    numbers = [c for c in columns if c in set(numeric_columns(df))]
    if strategy in ("forward", "backward"):
        if not order_by:
            raise ValueError(f"{strategy} imputation needs order_by")
        return directional_fill(df, columns, order_by, partition_by, strategy)
    if strategy == "zero":
        return df.withColumns({c: F.coalesce(ref(c), F.lit(0)) for c in numbers})
    if strategy == "mode":
        return fill_constants(df, most_frequent(df, columns))
    if not numbers:
        return df
    means = _means(df, numbers)
    holed = [c for c in numbers if means[c][0] > 0]
    if strategy == "mean":
        return fill_constants(df, {c: means[c][1] for c in holed})
    if not holed:
        return df
    medians = {r["column"]: r["median"] for r in quantile_table(df, holed, {"median": 0.5}, percentile_rows=percentile_rows).collect()}
    return fill_constants(df, medians)


def cap(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Move values outside the bounds to the nearest bound; nulls stay null."""
    return df.withColumns(
        {
            c: F.when(ref(c) < low, F.lit(float(low))).when(ref(c) > high, F.lit(float(high))).otherwise(ref(c).cast("double"))
            for c, (low, high) in bounds.items()
        }
    )


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one copy of each whole row; which copy does not matter, since they are equal."""
    return df.dropDuplicates()


def transform(df: DataFrame, column: str, expression: str) -> DataFrame:
    """Replace a column by a SQL expression over the row."""
    return df.withColumn(column, F.expr(expression))


def impute_all(df: DataFrame) -> DataFrame:
    """Fill missing cells, empty text included: numbers by the mean to 2 digits, others by the mode."""
    own = kinds(df)
    numbers = set(numeric_columns(df))
    blanked = df.withColumns({c: F.when(ref(c) != "", ref(c)) for c, k in own.items() if k == "string"})
    number_texts = [c for c in loose_numeric_columns(blanked) if c not in numbers]
    stats = per_column(
        blanked,
        df.columns,
        {
            "nulls": lambda c: F.count_if(ref(c).isNull()),
            "values": lambda c: F.count(ref(c)),
            "mean": lambda c: F.round(F.avg(ref(c).try_cast("double")), 2)
            if c in numbers or c in number_texts
            else F.lit(None).cast("double"),
        },
    ).collect()
    holed = {r["column"]: r for r in stats if r["nulls"] and r["values"]}
    fills: dict[str, object] = {}
    for c, r in holed.items():
        if c in numbers:
            fills[c] = r["mean"]
        elif c in number_texts:
            fills[c] = f"{r['mean']:.15g}"
    fills.update(most_frequent(blanked, [c for c in holed if c not in fills]))
    empty = {r["column"] for r in stats if not r["values"]}
    source = df.withColumns({c: F.when(ref(c) != "", ref(c)) for c, k in own.items() if k == "string" and c not in empty})
    return fill_constants(source, fills)


def clean(df: DataFrame) -> DataFrame:
    """Fixed order: mask personal values, drop duplicate rows, fill missing cells."""
    return impute_all(drop_duplicates(mask_pii_values(df)))


def cleaning_plan(quality: DataFrame, df: DataFrame, bounds: Mapping[str, tuple[float, float]], duplicate_count: int) -> list[CleaningOperation]:
    """Rule-based plan from the rows of the quality profile (one small row per column)."""
    rows = sorted(quality.collect(), key=lambda r: r["position"])
    numbers = set(numeric_columns(df))
    plan = []
    for r in rows:
        if r["null_count"]:
            number = r["column"] in numbers
            plan.append(
                CleaningOperation(
                    r["column"], "impute", f"Missing values ({r['null_percentage']}%)",
                    {"strategy": "mean" if number else "mode"}, 0.85 if number else 0.75,
                )
            )
    for r in rows:
        if r["outlier_count"]:
            low, high = bounds[r["column"]]
            plan.append(
                CleaningOperation(
                    r["column"], "cap", f"Outliers ({r['outlier_count']} values)",
                    {"lower_bound": low, "upper_bound": high}, 0.80,
                )
            )
    for r in rows:
        if r["has_pii"]:
            plan.append(CleaningOperation(r["column"], "mask", "PII detected", {"mask_char": "*", "preserve_last": 4}, 0.95))
    if duplicate_count:
        plan.append(CleaningOperation("*", "remove", f"Duplicate rows ({duplicate_count})", {"keep": "first"}, 0.90))
    return plan


def accepted(plan: Sequence[CleaningOperation], min_confidence: float = CONFIDENCE_GATE) -> list[CleaningOperation]:
    """Operations at or above the gate; the whole plan when none reaches it."""
    passed = [op for op in plan if op.confidence >= min_confidence]
    return passed or list(plan)


def _apply(df: DataFrame, op: CleaningOperation, order_by: Sequence[str]) -> DataFrame:
    parameters = dict(op.parameters)
    if op.column != "*" and op.strategy != "transform" and op.column not in df.columns:
        raise ValueError(f"no column {op.column!r}")
    if op.strategy == "impute":
        columns = None if op.column == "*" else [op.column]
        return impute(df, parameters.get("strategy", "mean"), columns, order_by)
    if op.strategy == "cap":
        if parameters.get("lower_bound") is None:
            return df
        return cap(df, {op.column: (parameters["lower_bound"], parameters["upper_bound"])})
    if op.strategy == "mask":
        return mask_pii(df, None if op.column == "*" else [op.column])
    if op.strategy == "remove":
        return drop_duplicates(df) if op.column == "*" else df
    if op.strategy == "transform":
        return transform(df, op.column, parameters["expression"]) if parameters.get("expression") else df
    raise ValueError(f"unknown strategy {op.strategy!r}")


def apply_plan(
    df: DataFrame,
    plan: Sequence[CleaningOperation],
    min_confidence: float | None = CONFIDENCE_GATE,
    order_by: Sequence[str] = (),
    count_rows: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Apply a plan in order to the running table; returns the table and its audit rows.

    Operations that are approved by hand are applied as given with ``min_confidence=None``. An
    operation that fails leaves the table as it was and is recorded as failed. Imputations by mean
    that follow each other share one statistics pass.
    """
    chosen = list(plan) if min_confidence is None else accepted(plan, min_confidence)
    rows = df.count() if count_rows and chosen else None
    result, entries = df, []
    means = _shared_means(df, chosen)
    for op in chosen:
        entry = dict(
            step="clean", column=op.column, description=f"{op.strategy}: {op.issue}",
            expression=json.dumps(dict(op.parameters)), rows_before=rows,
        )
        try:
            if op in means:
                result = fill_constants(result, {op.column: means[op]})
            else:
                result = _apply(result, op, order_by)
            result.schema
            if op.strategy == "remove" and rows is not None:
                rows = result.count()
            entries.append(AuditEntry(**entry, status="completed", rows_after=rows))
        except (PySparkException, ValueError, KeyError) as error:
            entries.append(AuditEntry(**entry, status="failed", rows_after=rows, error=str(error).split("\n")[0]))
    return result, audit_frame(df.sparkSession, entries)


def _shared_means(df: DataFrame, plan: Sequence[CleaningOperation]) -> "_ByIdentity":
    """Means for the leading run of mean imputations on distinct columns, from one pass."""
    leading: list[CleaningOperation] = []
    for op in plan:
        fits = op.strategy == "impute" and op.column != "*" and op.column in df.columns
        if not fits or any(op.column == o.column for o in leading):
            break
        leading.append(op)
    numbers = set(numeric_columns(df))
    means = [op for op in leading if op.parameters.get("strategy", "mean") == "mean" and op.column in numbers]
    found = _means(df, [op.column for op in means]) if means else {}
    return _ByIdentity({id(op): found[op.column][1] if found[op.column][0] else None for op in means})


class _ByIdentity:
    """Lookup of operations by identity: their parameters need not be hashable."""

    def __init__(self, values: dict):
        self.values = values

    def __contains__(self, op) -> bool:
        return id(op) in self.values

    def __getitem__(self, op):
        return self.values[id(op)]
