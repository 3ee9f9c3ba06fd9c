"""Audit rows of the steps applied to a table, and the comparison of two versions of a table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.kinds import comparable_text, kind_of, plain_text, quoted, ref
from plumbline.operators.wide import stack_rows
from plumbline.session import stored

# Leaves among which the keys of two versions are dealt to be compared by hashes first.
LEAVES = 1 << 16

AUDIT_SCHEMA = (
    "sequence int, step string, column string, description string, expression string, status string, "
    "rows_before bigint, rows_after bigint, error string"
)


@dataclass(frozen=True)
class AuditEntry:
    step: str
    column: str
    description: str = ""
    expression: str = ""
    status: str = "completed"
    rows_before: int | None = None
    rows_after: int | None = None
    error: str | None = None


def audit_frame(spark: SparkSession, entries: Sequence[AuditEntry], start: int = 0) -> DataFrame:
    """Entries as rows; one per applied step, so they are few."""
    rows = [
        (start + i, e.step, e.column, e.description, e.expression, e.status, e.rows_before, e.rows_after, e.error)
        for i, e in enumerate(entries)
    ]
    return spark.createDataFrame(rows, AUDIT_SCHEMA)


def append_audit(*trails: DataFrame) -> DataFrame:
    """Concatenate trails in the order given."""
    numbered = [t.withColumn("trail", F.lit(i)) for i, t in enumerate(trails)]
    return reduce(DataFrame.unionByName, numbered)


class Comparison(NamedTuple):
    """Two versions of a table matched by key.

    ``differing`` has a row for each key whose rows differ: the key as ``k0, k1, ...``, the rows of both versions (``n_before``,
    ``n_after``), those of them that have no equal row on the other side (``left_before``, ``left_after``) and one row of
    each version as ``b`` and ``a`` with the fields ``v0, v1, ...`` in the order of ``shared``.
    """

    shared: list[str]
    rows_before: int
    rows_after: int
    differing: DataFrame

    @property
    def changes(self) -> DataFrame:
        """Keys that both versions hold once, with different rows."""
        return self.differing.filter("n_before = 1 AND n_after = 1")

    def repeated(self) -> tuple[int, int]:
        """Rows of both versions that differ under keys that a version holds more than once; they can't be matched."""
        row = self.differing.filter("n_before > 1 OR n_after > 1").agg(F.sum("left_before"), F.sum("left_after")).first()
        return row[0] or 0, row[1] or 0


def _hashable(column: Column, own: T.DataType, other: T.DataType) -> Column:
    """An expression that is equal on both sides when the values are, whatever their types."""
    kinds_of = {kind_of(own), kind_of(other)}
    if kinds_of <= {"integer", "float"}:
        # Adding zero makes the negative zero the positive one.
        return column if kinds_of == {"integer"} else column.cast("double") + F.lit(0.0)
    return column if own == other and kinds_of <= {"string", "boolean", "datetime"} else comparable_text(column, own)


def compare_versions(before: DataFrame, after: DataFrame, key: Sequence[str]) -> Comparison:
    """Match the rows of two versions by key; null keys match each other.

    Keys are dealt by hash to leaves, and each leaf has a count and sums of row hashes of each version. Leaves that agree
    in all are left out, so that only rows near a difference are shuffled. Of the others equal rows of a key cancel out as
    counted multisets: the work is linear in the rows, however often a key is repeated, and a frequent key collapses before
    the shuffle. What differs is stored, so that all figures read it from there.
    """
    shared = [c for c in before.columns if c in after.columns and c not in key]
    types = [{f.name: f.dataType for f in df.schema.fields} for df in (before, after)]
    empty = [F.lit(None).cast(T.StructType([T.StructField(f"v{i}", own[c]) for i, c in enumerate(shared)])) for own in types]
    sides = []
    for side, df in enumerate((before, after)):
        own, other = types[side], types[1 - side]
        keys = [_hashable(ref(k), own[k], other[k]) for k in key]
        values = [_hashable(ref(c), own[c], other[c]) for c in shared]
        row = F.struct(*[ref(c).alias(f"v{i}") for i, c in enumerate(shared)]) if shared else F.struct(F.lit(0).alias("v"))
        rows = list(empty) if shared else [F.lit(None).cast("struct<v:int>")] * 2
        rows[side] = row
        sides.append(df.select(
            *[k.alias(f"k{i}") for i, k in enumerate(keys)], F.lit(side).alias("side"), F.pmod(F.xxhash64(*keys), F.lit(LEAVES)).cast("int").alias("leaf"),
            # A second hash of the same values in another order, behind a constant.
            F.xxhash64(*keys, *values).alias("h1"), F.xxhash64(F.lit("second"), *reversed(values), *keys).alias("h2"), rows[0].alias("b"), rows[1].alias("a"),
        ))
    both = sides[0].unionAll(sides[1])
    is_before = F.col("side") == 0
    sums = [F.sum(F.when(is_before, F.col(h)).otherwise(-F.col(h).cast("decimal(20,0)"))).alias(f"off_{h}") for h in ("h1", "h2")]
    digest = stored(both.groupBy("leaf").agg(F.count_if(is_before).alias("n_before"), F.count_if(~is_before).alias("n_after"), *sums), "leaves")
    totals = digest.agg(F.sum("n_before"), F.sum("n_after")).first()
    off = digest.filter("n_before <> n_after OR off_h1 <> 0 OR off_h2 <> 0").select("leaf")
    by_key = [f"k{i}" for i in range(len(key))]
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    # There is at most one row for each leaf, of which there are LEAVES.
    copies = both.join(F.broadcast(off), "leaf", "left_semi").groupBy(*by_key, "h1", "h2").agg(
        F.count_if(is_before).alias("n_before"), F.count_if(~is_before).alias("n_after"), first("b"), first("a")
    )
    gone, new = F.greatest(F.col("n_before") - F.col("n_after"), F.lit(0)), F.greatest(F.col("n_after") - F.col("n_before"), F.lit(0))
    found = copies.groupBy(*by_key).agg(
        F.sum("n_before").alias("n_before"), F.sum("n_after").alias("n_after"), F.sum(gone).alias("left_before"), F.sum(new).alias("left_after"), first("b"), first("a")
    )
    differing = stored(found.filter("left_before > 0 OR left_after > 0"), "differing")
    return Comparison(shared, totals[0] or 0, totals[1] or 0, differing)


def _changed(i: int) -> Column:
    return F.col(f"b.v{i}").isNotNull() & ~F.col(f"b.v{i}").eqNullSafe(F.col(f"a.v{i}"))


def _filled(i: int) -> Column:
    return F.col(f"b.v{i}").isNull() & F.col(f"a.v{i}").isNotNull()


def diff_columns(before: DataFrame, after: DataFrame, key: Sequence[str], found: Comparison | None = None) -> DataFrame:
    """Cells per shared column that changed, and cells that were null and got a value, among the rows matched by key."""
    found = found or compare_versions(before, after, key)
    cells = [{"column": F.lit(c), "changed": _changed(i), "filled": _filled(i)} for i, c in enumerate(found.shared)]
    columns = before.sparkSession.createDataFrame([(c,) for c in found.shared], "column string")
    counts = stack_rows(found.changes, cells).groupBy("column").agg(F.count_if("changed").alias("changed_count"), F.count_if("filled").alias("filled_count")) if cells else columns.selectExpr("column", "0L AS changed_count", "0L AS filled_count")
    share = F.try_divide(F.col("changed_count") * 100.0, F.greatest(F.col("rows_before"), F.lit(1)))
    return columns.join(counts, "column", "left").fillna(0, ["changed_count", "filled_count"]).select(
        "column", F.lit(found.rows_before).cast("bigint").alias("rows_before"), F.lit(found.rows_after).cast("bigint").alias("rows_after"), "changed_count", "filled_count"
    ).withColumn("change_percentage", F.round(share, 2))


def diff_samples(before: DataFrame, after: DataFrame, key: Sequence[str], k: int = 5) -> DataFrame:
    """Up to ``k`` changed or filled cells per column, the smallest keys first."""
    types_before = {f.name: f.dataType for f in before.schema.fields}
    types_after = {f.name: f.dataType for f in after.schema.fields}
    found = compare_versions(before, after, key)
    keys = {f"key_{name}": F.col(f"k{i}") for i, name in enumerate(key)}
    rows = [
        {
            "column": F.when(_changed(i) | _filled(i), F.lit(c)),
            **keys,
            "before": plain_text(F.col(f"b.v{i}"), types_before[c]),
            "after": plain_text(F.col(f"a.v{i}"), types_after[c]),
        }
        for i, c in enumerate(found.shared)
    ]
    cells = stack_rows(found.changes, rows).filter(F.col("column").isNotNull())
    order = Window.partitionBy("column").orderBy(*[F.col(quoted(k)) for k in keys])
    return cells.withColumn("sample", F.row_number().over(order)).filter(F.col("sample") <= k)


def diff_summary(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows and columns of both versions with the number of changes.

    ``repeated_before`` and ``repeated_after`` count the rows that differ under keys that a version holds more than once.
    Such rows have no partner, so their cells are not compared.
    """
    found = compare_versions(before, after, key)
    repeated = found.repeated()
    touched = (F.col("changed_count") > 0) | (F.col("filled_count") > 0)
    return diff_columns(before, after, key, found).agg(
        F.lit(found.rows_before).cast("bigint").alias("original_rows"),
        F.lit(found.rows_after).cast("bigint").alias("cleaned_rows"),
        F.lit(len(before.columns)).alias("original_columns"),
        F.lit(len(after.columns)).alias("cleaned_columns"),
        F.coalesce(F.sum("changed_count"), F.lit(0)).alias("total_changes"),
        F.coalesce(F.sum("filled_count"), F.lit(0)).alias("total_filled"),
        F.count_if(touched).alias("columns_changed"),
        F.lit(repeated[0]).cast("bigint").alias("repeated_before"),
        F.lit(repeated[1]).cast("bigint").alias("repeated_after"),
    )
