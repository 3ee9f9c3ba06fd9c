"""Relationships between columns: shared values, candidates, classification and validation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.fixed import CONFIDENCE_GATE, CORRELATION_THRESHOLD, OVERLAP_THRESHOLD, STRONG_THRESHOLD
from plumbline.functions.kinds import comparable_text, family_of, numeric_columns, ref
from plumbline.operators.correlation import pearson_matrix, spearman_matrix
from plumbline.operators.wide import MAX_COUNTERS, chunks, spread, stack_rows
from plumbline.session import stored

# Columns per bit word of a value's membership.
WORD = 62

VALID_TYPES = ["one-to-one", "one-to-many", "many-to-many", "self-referential"]


def value_membership(columns: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Distinct non-null values with bit words telling which of the columns hold them.

    Columns may come from different tables. Copies of a value collapse before the shuffle, so a
    value that fills a third of a table costs one row per task.
    """
    words = (len(columns) + WORD - 1) // WORD
    parts = []
    by_table: dict[int, tuple[DataFrame, list[tuple[int, str]]]] = {}
    for i, (df, c) in enumerate(columns):
        by_table.setdefault(id(df), (df, []))[1].append((i, c))
    for df, members in by_table.values():
        types = {f.name: f.dataType for f in df.schema.fields}
        rows = [
            {
                "family": F.lit(family_of(types[c])),
                "value": comparable_text(ref(c), types[c]),
                **{f"w{w}": F.lit(1 << (i % WORD) if i // WORD == w else 0).cast("bigint") for w in range(words)},
            }
            for i, c in members
        ]
        parts.append(stack_rows(df, rows).filter(F.col("value").isNotNull()))
    return (
        reduce(DataFrame.unionByName, parts)
        .groupBy("family", "value")
        .agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in range(words)])
    )


def _holds(i: int) -> Column:
    return F.col(f"w{i // WORD}").bitwiseAND(F.lit(1 << (i % WORD)).cast("bigint")) != 0


def overlap_counts(columns: Sequence[tuple[DataFrame, str]], pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """``source, target`` (positions), shared and own distinct values of the wanted pairs.

    Values with the same membership are counted together first; what remains is one row per
    combination of columns that occurs. From it one aggregate gives, per column, how many of its
    values each other column holds: one row per column, from which the pairs are read off.
    """
    members = value_membership(columns)
    words = [c for c in members.columns if c.startswith("w")]
    combos = members.groupBy(*words).agg(F.count(F.lit(1)).alias("values"))
    if len(columns) > MAX_COUNTERS:
        # Read once for each so many columns.
        combos = stored(combos, "memberships")
    holders = F.array_compact(F.array(*[F.when(_holds(i), F.lit(i)) for i in range(len(columns))]))
    held = combos.select(*words, "values", F.explode(holders).alias("source"))
    shared: dict[int, dict[int, int]] = {}
    for chunk in chunks(list(range(len(columns))), MAX_COUNTERS):
        sums = [F.sum(F.when(_holds(j), F.col("values"))).alias(f"t{j}") for j in chunk]
        for row in held.groupBy("source").agg(*sums).collect():
            shared.setdefault(row["source"], {}).update({j: row[f"t{j}"] or 0 for j in chunk})
    count = lambda i, j: shared.get(i, {}).get(j, 0)
    rows = [(i, j, count(i, j), count(i, i), count(j, j)) for i, j in pairs]
    schema = "source int, target int, overlap_count bigint, unique_values_1 bigint, unique_values_2 bigint"
    return columns[0][0].sparkSession.createDataFrame(rows, schema)


def value_overlap(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = OVERLAP_THRESHOLD) -> DataFrame:
    """Column pairs whose shared distinct values reach ``threshold`` of the smaller column."""
    columns = list(columns or df.columns)
    with spread(df, columns) as rows:
        counts = overlap_counts([(rows, c) for c in columns], list(combinations(range(len(columns)), 2)))
    names = F.array(*[F.lit(c) for c in columns])
    ratio = F.try_divide(F.col("overlap_count"), F.least("unique_values_1", "unique_values_2"))
    return (
        counts.withColumn("ratio", ratio)
        .filter(F.col("ratio") >= threshold)
        .select(
            F.element_at(names, F.col("source") + 1).alias("source_column"),
            F.element_at(names, F.col("target") + 1).alias("target_column"),
            "overlap_count", "unique_values_1", "unique_values_2",
            F.round("ratio", 4).alias("overlap_ratio"),
        )
    )


def shared_values(left: DataFrame, left_column: str, right: DataFrame, right_column: str) -> DataFrame:
    """Distinct values that both columns hold."""
    return left.select(ref(left_column).alias("value")).intersect(right.select(ref(right_column).alias("value")))


def correlation_candidates(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = CORRELATION_THRESHOLD) -> DataFrame:
    """Pairs in name order whose absolute Pearson correlation reaches the threshold."""
    columns = list(columns or numeric_columns(df))
    pearson = pearson_matrix(df, columns).withColumnRenamed("r", "pearson_r")
    spearman = spearman_matrix(df, columns).withColumnRenamed("r", "spearman_r")
    return (
        pearson.join(F.broadcast(spearman), ["source_column", "target_column"])
        .filter((F.col("source_column") < F.col("target_column")) & (F.abs("pearson_r") >= threshold))
        .select("source_column", "target_column", F.lit("correlation").alias("evidence"), "pearson_r", "spearman_r", F.abs("pearson_r").alias("strength"))
    )


def relationship_candidates(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Correlated pairs, then overlapping pairs that are not among them, strongest first."""
    correlated = correlation_candidates(df, [c for c in numeric_columns(df) if not columns or c in columns])
    overlaps = value_overlap(df, columns).select(
        "source_column", "target_column", F.lit("value_overlap").alias("evidence"), "overlap_ratio", "overlap_count",
        F.col("overlap_ratio").alias("strength"),
    )
    both = correlated.unionByName(overlaps, allowMissingColumns=True)
    first = Window.partitionBy("source_column", "target_column").orderBy("evidence")
    return sort_by_strength(both.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn"))


def sort_by_strength(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("strength"), "source_column", "target_column")


def candidate_summary(candidates: DataFrame, numeric: int) -> DataFrame:
    return candidates.agg(
        F.lit(numeric).alias("total_numeric_columns"),
        F.count(F.lit(1)).alias("total_candidates"),
        F.count_if(F.col("strength") > STRONG_THRESHOLD).alias("strong_candidates"),
    )


def top_k(df: DataFrame, by: Sequence[Column], k: int | None) -> DataFrame:
    """The first ``k`` rows in the given order, each task keeping only ``k`` rows; all rows without ``k``."""
    return df.orderBy(*by) if k is None else df.orderBy(*by).limit(k)


def classify_relationships(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """Type, confidence and chart hint of the candidates, of the ``k`` strongest if that is given."""
    best = top_k(candidates, [F.desc("strength"), F.col("source_column"), F.col("target_column")], k)
    correlated = F.col("evidence") == "correlation"
    size = F.abs("pearson_r")
    return best.select(
        "source_column",
        "target_column",
        F.when(~correlated, "one-to-many").when(F.col("pearson_r") < -0.7, "many-to-many").otherwise("one-to-one").alias("relationship_type"),
        F.round(F.least(F.lit(0.85), F.greatest(F.lit(0.65), F.col("strength"))), 2).alias("confidence"),
        F.when(correlated & (size > 0.5), "scatter").when(correlated & (size > 0.3), "heatmap").otherwise("bar").alias("chart_hint"),
        F.col("pearson_r").alias("correlation_coefficient"),
    )


def classify_correlated(candidates: DataFrame, k: int | None = None) -> DataFrame:
    """The variant for correlated pairs only, with confidence equal to the strength."""
    best = top_k(candidates, [F.desc("strength"), F.col("source_column"), F.col("target_column")], k)
    size = F.abs("pearson_r")
    return best.select(
        "source_column",
        "target_column",
        F.when(size > 0.7, "one-to-one").otherwise("one-to-many").alias("relationship_type"),
        F.round("strength", 2).alias("confidence"),
        F.when(size > 0.5, "scatter").otherwise("bar").alias("chart_hint"),
    )


def validate_relationships(relationships: DataFrame, columns: Sequence[str], gate: float = CONFIDENCE_GATE, minimum: int = 1) -> DataFrame:
    """One row per check with the number of violations and whether it passed."""
    known = list(columns)
    unknown = ~F.col("source_column").isin(known) | ~F.col("target_column").isin(known)
    seen = relationships.groupBy("source_column", "target_column").agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(F.col("confidence") < gate).alias("low"),
        F.count_if(~F.coalesce(F.col("relationship_type"), F.lit("unknown")).isin(VALID_TYPES)).alias("invalid"),
        F.count_if(unknown).alias("unknown"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    counts = seen.agg(
        F.greatest(F.lit(minimum) - total("copies"), F.lit(0)).cast("bigint").alias("minimum_relationships"),
        total("low").alias("confidence_gate"),
        total("invalid").alias("valid_type"),
        total(F.col("copies") - 1).alias("no_duplicates"),
        total("unknown").alias("columns_exist"),
    )
    return stack_rows(
        counts, [{"check": F.lit(c), "violations": F.col(c), "passed": F.col(c) == 0} for c in counts.columns]
    )
