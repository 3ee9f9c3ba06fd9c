"""Pearson and Spearman correlation of all column pairs, with significance."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.kinds import kinds, numeric_columns, ref
from plumbline.functions.student_t import correlation_p_value
from plumbline.operators.gram import column_moments, matrix_sums, pair_sums
from plumbline.operators.ordering import value_ranks
from plumbline.operators.ranges import cut, ordered_codes, rank_products
from plumbline.operators.wide import MAX_COUNTERS, chunks, collect_wide, is_plain_scan, spread, stack_rows
from plumbline.session import drop_path, fresh_path

# Share of the mean square below which a difference of two sums is measured again without that difference.
LOST_DIGITS = 1e-9
# Ranks of a column up to which its table is sent to every task.
LARGE_RANKS = 100_000
# Columns whose ranks are gathered at a time.
GATHERED_COLUMNS = 24
# Ranks of all pairs that are multiplied at a time.
RANK_CELLS = 1 << 22


def _null_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    return collect_wide(df, {c: F.count_if(ref(c).isNull()) for c in columns})


_MOMENTS = ("cov", "vx", "vy", "n")


def _moments(x: Column, y: Column, x_complete: bool, y_complete: bool) -> dict[str, tuple]:
    """Aggregates for one pair over the rows where both are present.

    A variance that does not depend on the partner is keyed by its column alone, so that it is
    computed once for all partners.
    """
    return {
        "cov": ("pair", F.covar_pop(x, y)),
        "vx": ("x", F.var_pop(x)) if y_complete else ("pair", F.var_pop(F.when(y.isNotNull(), x))),
        "vy": ("y", F.var_pop(y)) if x_complete else ("pair", F.var_pop(F.when(x.isNotNull(), y))),
        "n": ("pair", F.count_if(x.isNotNull() & y.isNotNull())),
    }


def _coefficients(df: DataFrame, pairs: Sequence[tuple], columns: dict, complete: dict) -> dict[tuple, tuple[float | None, int]]:
    """Correlation and pair count of each ``(left, right)`` pair of column expressions."""
    wanted: dict = {}
    use: dict = {}
    for a, b in pairs:
        left, right = columns[(a, b)]
        for name, (scope, expression) in _moments(left, right, complete[a], complete[b]).items():
            key = {"pair": (name, a, b), "x": ("v", a), "y": ("v", b)}[scope]
            wanted.setdefault(key, expression)
            use[(name, a, b)] = key
    found = collect_wide(df, wanted) if wanted else {}
    out = {}
    for a, b in pairs:
        cov, vx, vy, n = (found[use[(name, a, b)]] for name in _MOMENTS)
        r = None
        if cov is not None and vx and vy and not any(math.isnan(v) for v in (cov, vx, vy)):
            r = max(-1.0, min(1.0, cov / math.sqrt(vx * vy)))
        out[(a, b)] = (r, n)
    return out


def pearson_pairs(df: DataFrame, columns: Sequence[str]) -> dict[tuple, tuple[float | None, int]]:
    """``{(a, b): (r, n)}`` for a before b; r is None where it is undefined.

    Few columns are measured by one aggregate. For more, one pass gives the mean of every column and another one the sums
    of products of all pairs, as one matrix.
    """
    columns = list(columns)
    pairs = list(combinations(columns, 2))
    if len(pairs) * len(_MOMENTS) > MAX_COUNTERS:
        return _gram_pairs(df, columns, pairs)
    complete = {c: n == 0 for c, n in _null_counts(df, columns).items()}
    return _coefficients(df, pairs, _doubles_of(pairs), complete)


def _doubles_of(pairs: Sequence[tuple]) -> dict[tuple, tuple[Column, Column]]:
    return {(a, b): (ref(a).cast("double"), ref(b).cast("double")) for a, b in pairs}


def _gram_pairs(df: DataFrame, columns: Sequence[str], pairs: Sequence[tuple]) -> dict[tuple, tuple[float | None, int]]:
    moments = column_moments(df, columns)
    sums = pair_sums(df, columns, moments)
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        mx, my = sums.x / sums.n, sums.y / sums.n
        vx, vy, cov = sums.xx / sums.n - mx**2, sums.yy / sums.n - my**2, sums.xy / sums.n - mx * my
        r = cov / np.sqrt(vx * vy)
        # Where a variance is next to nothing beside the distance from the mean of all rows, rounding has taken its digits.
        lost = (vx <= LOST_DIGITS * sums.xx / sums.n) | (vy <= LOST_DIGITS * sums.yy / sums.n)
    undefined = (sums.n == 0) | (sums.odd > 0) | (moments.low == moments.high)[:, None] | (moments.low == moments.high)[None, :]
    at = {c: i for i, c in enumerate(columns)}
    again = [(a, b) for a, b in pairs if lost[at[a], at[b]] and not undefined[at[a], at[b]]]
    out = _coefficients(df, again, _doubles_of(again), dict.fromkeys(columns, False)) if again else {}
    for a, b in pairs:
        i, j = at[a], at[b]
        known = not undefined[i, j] and math.isfinite(r[i, j])
        out.setdefault((a, b), (max(-1.0, min(1.0, float(r[i, j]))) if known else None, int(sums.n[i, j])))
    return out


def _value(df: DataFrame, column: str) -> tuple[Column, Column]:
    """A value as a double, and its exact integer where a double could merge neighbours."""
    exact = ref(column).cast("bigint") if kinds(df)[column] == "integer" else F.lit(0).cast("bigint")
    return ref(column).cast("double"), exact


RANK_SCHEMA = "variant int, at double, exact bigint, counts array<bigint>, ranks array<double>"


def _write_ranks(rows: DataFrame, columns: Sequence[str], partners: Sequence[str], path: str) -> None:
    """Average ranks of the values of all columns, one folder per column, from one pass over the rows.

    A value has its rank among all rows and, for each partner, its rank among the rows where the partner is present too,
    with the number of copies in each. Ranks are written as distances from the mean rank.
    """
    with_partner = {f"p{j}": ref(c).isNotNull() for j, c in enumerate(partners)}
    stacked = []
    for i, column in enumerate(columns):
        position, exact = _value(rows, column)
        stacked.append({"variant": F.lit(i), "at": position, "exact": exact, **with_partner})
    found = value_ranks(stack_rows(rows, stacked), ["at", "exact"], ["variant"], counters={name: F.col(name) for name in with_partner})
    tags = ["", *[f"_{name}" for name in with_partner]]
    centred = F.array(*[F.col(f"below{t}") + (F.col(f"n{t}") - F.col(f"total{t}")) / 2.0 for t in tags])
    table = found.select("variant", "at", "exact", F.array(*[F.col(f"n{t}") for t in tags]).alias("counts"), centred.alias("ranks"))
    table.write.partitionBy("variant").parquet(path)


def _with_rank(rows: DataFrame, ranks: DataFrame, column: str, name: str) -> DataFrame:
    """Attach the ranks of each value; the table has at most about ``LARGE_RANKS`` of them and is sent to every task."""
    position, exact = _value(rows, column)
    table = ranks.select("at", "exact", F.col("ranks").alias(name))
    keyed = rows.withColumns({"__at": position, "__exact": exact})
    same = (F.col("__at") == F.col("at")) & (F.col("__exact") == F.col("exact"))
    return keyed.join(F.broadcast(table), same, "left").drop("at", "exact", "__at", "__exact")


def _cross_sums(ranked: DataFrame, tag: Sequence[int]) -> np.ndarray:
    """Sums of products of the ranks of each pair of columns, each ranked among the rows of the pair.

    ``ranked`` has the rank lists of all columns; ``tag`` is the place in any of these of the rank among the rows with a column.
    """
    k = len(tag)
    pairs = list(combinations(range(k), 2))
    out = np.zeros((k, k))
    if len(pairs) <= MAX_COUNTERS:
        products = {(i, j): F.sum(F.get(ranked[i], F.lit(tag[j])) * F.get(ranked[j], F.lit(tag[i]))) for i, j in pairs}
        for (i, j), total in collect_wide(ranked, products).items():
            out[i, j] = out[j, i] = total or 0.0
        return out
    place = np.array(tag)

    def product(batch: pa.RecordBatch) -> np.ndarray:
        of = np.zeros((batch.num_rows, k, k))
        for i in range(k):
            column = batch.column(i)
            there = pc.is_valid(column).to_numpy(zero_copy_only=False)
            if there.any():
                of[there, i] = pc.list_flatten(column).to_numpy(zero_copy_only=False).reshape(int(there.sum()), -1)[:, place]
        return np.einsum("nij,nji->ij", of, of)

    return matrix_sums(ranked, (k, k), product, max(1, RANK_CELLS // k**2))


def _gathered(rows: DataFrame, columns: Sequence[str], large: Sequence[int], present: Sequence[int], total: int, path: str) -> dict[tuple, tuple[float | None, int]]:
    """The pairs of ``columns``, of which those at the places ``large`` have rank tables too large for every task.

    No table of values is made: ranks are found in ranges of sorted cells and go back to their block of rows, see
    :mod:`plumbline.operators.ranges`. More columns than are gathered at a time are taken in halves, a pass for each two halves.
    """
    coded = ordered_codes(rows, columns)
    if not is_plain_scan(coded):
        # Rows are read several times and must be the same in the same order each time.
        coded.write.parquet(f"{path}-rows")
        coded = rows.sparkSession.read.schema(coded.schema).parquet(f"{path}-rows")
    out: dict[tuple, tuple[float | None, int]] = {}
    halves = list(chunks(range(len(columns)), GATHERED_COLUMNS // 2))
    for used in [list(range(len(columns)))] if len(columns) <= GATHERED_COLUMNS else [[*a, *b] for a, b in combinations(halves, 2)]:
        partners = [x for x, i in enumerate(used) if present[i] < total]
        some = coded.select(*[f"v{i}" for i in used])
        ranges = cut(some, total, [present[i] for i in used], partners, [i not in large for i in used])
        cross, own = rank_products(some, ranges, partners)
        for (x, i), (y, j) in combinations(enumerate(used), 2):
            n = int(ranges.count[x][:, 1 + partners.index(y) if y in partners else 0].sum())
            defined = own[x, y] > 0 and own[y, x] > 0
            r = float(cross[x, y] / math.sqrt(own[x, y]) / math.sqrt(own[y, x])) if defined else None
            out[(columns[i], columns[j])] = (None if r is None else max(-1.0, min(1.0, r)), n)
    return out


def spearman_pairs(df: DataFrame, columns: Sequence[str]) -> dict[tuple, tuple[float | None, int]]:
    """Correlation of average ranks, ranked within the rows where both columns are present.

    Where every column has few values, it has one table of these with their ranks among all rows and among the rows of each
    column with gaps, and rows are joined with one table per column. Otherwise ranks are gathered by row.
    """
    columns = list(columns)
    if len(columns) < 2:
        return {}
    with spread(df, columns) as rows:
        return _rank_pairs(rows, columns)


def _rank_pairs(rows: DataFrame, columns: Sequence[str]) -> dict[tuple, tuple[float | None, int]]:
    spark = rows.sparkSession
    path = fresh_path(spark, "ranks")
    try:
        found = collect_wide(rows, {("rows", ""): F.count(F.lit(1)), **{("present", c): F.count(ref(c)) for c in columns}, **{("values", c): F.approx_count_distinct(ref(c)) for c in columns}})
        total, present = found[("rows", "")], [found[("present", c)] for c in columns]
        partners = [c for c, n in zip(columns, present) if n < total]
        large = [i for i, c in enumerate(columns) if found[("values", c)] * (len(partners) + 1) > LARGE_RANKS]
        if large:
            return _gathered(rows, columns, large, present, total, path)
        tag = [1 + partners.index(c) if c in partners else 0 for c in columns]
        _write_ranks(rows, columns, partners, path)
        table = spark.read.schema(RANK_SCHEMA).parquet(path)
        each = table.select("variant", F.posexplode(F.arrays_zip("counts", "ranks")).alias("tag", "v"))
        squares = each.groupBy("variant", "tag").agg(F.sum("v.counts").alias("n"), F.sum(F.col("v.counts") * F.col("v.ranks") ** 2).alias("s"))
        about = {(r["variant"], r["tag"]): (r["n"], r["s"]) for r in squares.collect()}
        ranked = rows
        for i, c in enumerate(columns):
            ranked = _with_rank(ranked, table.filter(F.col("variant") == i), c, f"__rank_{i}")
        cross = _cross_sums(ranked.select(*[f"__rank_{i}" for i in range(len(columns))]), tag)
        out = {}
        for i, j in combinations(range(len(columns)), 2):
            (n, x), (_, y) = about.get((i, tag[j]), (0, 0.0)), about.get((j, tag[i]), (0, 0.0))
            r = float(cross[i, j]) / math.sqrt(x * y) if n and x and y else None
            out[(columns[i], columns[j])] = (None if r is None else max(-1.0, min(1.0, r)), n)
        return out
    finally:
        drop_path(spark, path)
        drop_path(spark, f"{path}-rows")


def _cell(r: float | None, n: int) -> float:
    return 0.0 if n < 3 or r is None else round(r, 4)


def _matrix(df: DataFrame, columns: Sequence[str], found: dict) -> DataFrame:
    rows = [(a, b, 1.0 if a == b else _cell(*found.get((a, b), found.get((b, a))))) for a in columns for b in columns]
    return df.sparkSession.createDataFrame(rows, "source_column string, target_column string, r double")


def pearson_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """All ordered pairs; 1 on the diagonal, 0 where undefined or with fewer than three pairs."""
    columns = list(columns or numeric_columns(df))
    return _matrix(df, columns, pearson_pairs(df, columns))


def spearman_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or numeric_columns(df))
    return _matrix(df, columns, spearman_pairs(df, columns))


def correlation_strength(r: Column) -> Column:
    size = F.abs(r)
    return (
        F.when(size >= 0.8, "very_strong")
        .when(size >= 0.6, "strong")
        .when(size >= 0.4, "moderate")
        .when(size >= 0.2, "weak")
        .otherwise("very_weak")
    )


def bivariate(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Both correlations of every ordered pair with p-value, sample size and strength."""
    columns = list(columns or numeric_columns(df))
    pearson, spearman = pearson_pairs(df, columns), spearman_pairs(df, columns)
    present = collect_wide(df, {c: F.count(ref(c)) for c in columns})
    rows = []
    for a in columns:
        for b in columns:
            if a == b:
                rows.append((a, b, 1.0, 1.0, 0.0 if present[a] > 2 else 1.0, present[a]))
                continue
            key = (a, b) if (a, b) in pearson else (b, a)
            r, n = pearson[key]
            rows.append((a, b, _cell(r, n), _cell(*spearman[key]), round(correlation_p_value(r, n), 6), n))
    table = df.sparkSession.createDataFrame(
        rows,
        "source_column string, target_column string, pearson_r double, spearman_r double, p_value double, sample_size bigint",
    )
    return table.withColumn("significant", F.col("p_value") < 0.05).withColumn(
        "strength", correlation_strength(F.col("pearson_r"))
    )
