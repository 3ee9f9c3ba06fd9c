"""Global order without a one-task window: ordered buckets, row index, ranks and directional fill.

Rows are dealt to buckets by ranges of all order columns together and stored with their bucket. Every
bucket is processed on its own and a small table with one row per bucket carries counts (or last values)
from bucket to bucket. The bucket is stored with the row, so a recomputed task gives the same answer.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.kinds import quoted, ref
from plumbline.session import stored

ROWS_PER_BUCKET = 1_000_000

BUCKET = "__bucket"


def _bucket_count(df: DataFrame, rows: int, rows_per_bucket: int) -> int:
    """Buckets for about ``rows_per_bucket`` rows each, and enough of them to use all cores."""
    return max(1, math.ceil(rows / rows_per_bucket), min(df.sparkSession.sparkContext.defaultParallelism, rows))


def with_buckets(df: DataFrame, order_by: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``df`` plus a bucket column whose order follows ``order_by`` (ascending, nulls first).

    Ranges are cut over the whole tuple of order columns, so a frequent first value, or texts with a
    long common beginning, are divided like any others. Only rows with equal tuples stay together.
    """
    buckets = _bucket_count(df, df.count(), rows_per_bucket)
    dealt = df.repartitionByRange(buckets, *[ref(c).asc_nulls_first() for c in order_by])
    return stored(dealt.withColumn(BUCKET, F.spark_partition_id()), "ordered")


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    """A null-safe equality of the key columns of two frames."""
    condition = F.lit(True)
    for k in keys:
        condition = condition & left[quoted(k)].eqNullSafe(right[quoted("__k_" + k)])
    return condition


def _join_carry(rows: DataFrame, carry: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Attach the per-bucket carry. Without keys it holds one row per bucket, which is bounded."""
    on = [*keys, BUCKET]
    small = carry.select(*[ref(k).alias("__k_" + k) for k in on], *[ref(v) for v in values])
    if not keys:
        small = F.broadcast(small)
    joined = rows.join(small, _same(rows, small, on), "left")
    return joined.drop(*["__k_" + k for k in on])


def row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index", rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Number the rows 0..n-1 in the order of ``order_by``, which must be unique to be stable."""
    rows = with_buckets(df, order_by, rows_per_bucket)
    inside = Window.partitionBy(BUCKET).orderBy(*[ref(c) for c in order_by])
    earlier = Window.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(BUCKET)
        .agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn("__offset", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    )
    numbered = rows.withColumn("__place", F.row_number().over(inside) - 1)
    return (
        _join_carry(numbered, offsets, [], ["__offset"])
        .withColumn(name, F.col("__offset") + F.col("__place"))
        .drop(BUCKET, "__place", "__offset")
    )


def value_ranks(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET, counters: Mapping[str, Column] | None = None
) -> DataFrame:
    """Distinct values with ``n`` (copies), ``below`` (rows before) and ``total`` per key.

    A value is one column or several that are ordered together; rows where the first is null are
    left out. Equal values collapse before the shuffle, so a value that holds a third of all rows
    is one row here; a key that does is spread over the buckets of its values. ``counters`` names
    further conditions: the rows that meet one are counted like all rows, as ``n_name``,
    ``below_name`` and ``total_name``.
    """
    keys, columns = list(keys), list(columns)
    by_key = [ref(k) for k in keys]
    tags = ["", *[f"_{name}" for name in counters or {}]]
    sums = [F.count(F.lit(1)).alias("n"), *[F.count_if(c).alias(f"n_{name}") for name, c in (counters or {}).items()]]
    rows = df.filter(ref(columns[0]).isNotNull())
    counts = stored(rows.groupBy(*by_key, *[ref(c) for c in columns]).agg(*sums), "value-counts")
    placed = with_buckets(counts, [*columns, *keys], rows_per_bucket)
    inside = (
        Window.partitionBy(*by_key, BUCKET).orderBy(*[ref(c) for c in columns]).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = placed.withColumns({f"__inside{t}": F.coalesce(F.sum(f"n{t}").over(inside), F.lit(0)) for t in tags})
    whole = Window.partitionBy(*by_key)
    earlier = whole.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy(*by_key, BUCKET)
        .agg(*[F.sum(f"n{t}").alias(f"__rows{t}") for t in tags])
        .withColumns({f"__offset{t}": F.coalesce(F.sum(f"__rows{t}").over(earlier), F.lit(0)) for t in tags})
        .withColumns({f"total{t}": F.sum(f"__rows{t}").over(whole) for t in tags})
    )
    return (
        _join_carry(local, offsets, keys, [f"{c}{t}" for t in tags for c in ("__offset", "total")])
        .withColumns({f"below{t}": F.col(f"__offset{t}") + F.col(f"__inside{t}") for t in tags})
        .drop(BUCKET, *[f"{c}{t}" for t in tags for c in ("__inside", "__offset")])
    )


def running_sum(df: DataFrame, value: str, order_by: str, keys: Sequence[str], name: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add the sum of ``value`` over the rows of the same key up to the place of a row, rows with an equal place included."""
    by_key = [ref(k) for k in keys]
    rows = with_buckets(df, [*keys, order_by], rows_per_bucket)
    inside = Window.partitionBy(*by_key, BUCKET).orderBy(ref(order_by).asc_nulls_first()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*by_key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*by_key, BUCKET).agg(F.sum(ref(value)).alias("__sum"))
    carry = sums.select(*by_key, BUCKET, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__before"))
    summed = _join_carry(rows.withColumn("__inside", F.sum(ref(value)).over(inside)), carry, keys, ["__before"])
    return summed.withColumn(name, F.col("__before") + F.col("__inside")).drop(BUCKET, "__inside", "__before")


def directional_fill(
    df: DataFrame,
    columns: Sequence[str],
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    direction: str = "forward",
    rows_per_bucket: int = ROWS_PER_BUCKET,
    index: str | None = None,
) -> DataFrame:
    """Replace nulls by the last (forward) or next (backward) non-null value in the given order.

    ``index`` names a column for the row number 0..n-1 of each key in that direction, which comes
    from the same pass.
    """
    if direction not in ("forward", "backward"):
        raise ValueError(f"unknown direction {direction!r}")
    forward = direction == "forward"
    keys = list(partition_by)
    rows = with_buckets(df, order_by, rows_per_bucket)
    order = [ref(c).asc_nulls_first() if forward else ref(c).desc_nulls_last() for c in order_by]
    block = F.col(BUCKET).asc() if forward else F.col(BUCKET).desc()
    inside = (
        Window.partitionBy(*[ref(k) for k in keys], BUCKET)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = Window.partitionBy(*[ref(k) for k in keys]).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    place = F.struct(*[ref(c) for c in order_by])
    edge = F.max_by if forward else F.min_by
    ends = rows.groupBy(*[ref(k) for k in keys], BUCKET).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[edge(ref(c), F.when(ref(c).isNotNull(), place)).alias(f"__end_{i}") for i, c in enumerate(columns)],
    )
    carry = ends.withColumns(
        {f"__carry_{i}": F.last(f"__end_{i}", ignorenulls=True).over(earlier) for i in range(len(columns))}
        | ({"__offset": F.coalesce(F.sum("__rows").over(earlier), F.lit(0))} if index else {})
    )
    filled = rows.withColumns({f"__in_{i}": F.last(ref(c), ignorenulls=True).over(inside) for i, c in enumerate(columns)})
    carried = [f"__carry_{i}" for i in range(len(columns))]
    if index:
        numbering = Window.partitionBy(*[ref(k) for k in keys], BUCKET).orderBy(*order)
        filled = filled.withColumn("__place", F.row_number().over(numbering) - 1)
        carried.append("__offset")
    joined = _join_carry(filled, carry, keys, carried)
    number = [(F.col("__offset") + F.col("__place")).alias(index)] if index else []
    which = {c: i for i, c in enumerate(columns)}
    return joined.select(
        *[
            F.coalesce(F.col(f"__in_{which[c]}"), F.col(f"__carry_{which[c]}")).alias(c) if c in which else ref(c)
            for c in df.columns
        ],
        *number,
    )
