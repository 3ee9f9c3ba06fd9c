"""Exact order statistics and quantiles of whole columns.

Small tables use Spark's exact ``percentile``, which keeps one map entry per distinct value. That
map would not fit one task on a large column, so beyond a checked row count the exact value is
found by narrowing a bracket around the wanted rank: a sample proposes the bracket, a counting
pass proves that the rank lies inside, and only the values strictly inside the final bracket are
ordered. The two ends are known values, however many copies of them there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.kinds import ref
from plumbline.operators.sketches import Distribution, distributions
from plumbline.operators.wide import chunks, collect_wide, per_item, stack_rows

# Tables up to this size use the built-in aggregate.
PERCENTILE_ROWS = 100_000
# A bracket is ordered once it holds at most this many values.
BRACKET_ROWS = 1_000_000
MAX_ROUNDS = 12


class _Target:
    """Neighbouring ranks of one column and the bracket of values known to contain them."""

    def __init__(self, column: str, ranks: Sequence[int], count: int):
        self.column, self.open, self.count = column, list(ranks), count
        self.values: dict[int, float] = {}
        self.reopen()

    def reopen(self) -> None:
        # NaN orders above every number, so an open upper end is written as NaN.
        self.low, self.high = -math.inf, math.nan
        self.upto_low, self.between = 0, self.count

    def number(self):
        return ref(self.column).cast("double")

    def inside(self):
        return (self.number() > F.lit(self.low)) & (self.number() < F.lit(self.high))

    def counters(self) -> dict:
        n, low, high = self.number(), F.lit(self.low), F.lit(self.high)
        return {
            "below": F.count_if(n < low),
            "at_low": F.count_if(n == low),
            "between": F.count_if(self.inside()),
            "at_high": F.count_if(n == high),
        }

    def propose(self, dist: Distribution) -> None:
        """Narrow the bracket to sampled values whose rank surrounds the wanted ones."""
        first, last = self.open[0] - self.upto_low, self.open[-1] - self.upto_low
        if not len(dist.values):
            return
        if first - dist.slack > 0:
            self.low = dist.near(first - dist.slack)
        if last + dist.slack < self.between - 1:
            self.high = dist.near(last + dist.slack)

    def classify(self, seen: Mapping[str, int]) -> None:
        """Use the exact counts: settle ranks that fall on an end, reopen a bracket that misses."""
        self.upto_low = seen["below"] + seen["at_low"]
        self.between = seen["between"]
        upto_high = self.upto_low + self.between
        still = []
        for rank in self.open:
            if rank < seen["below"] or rank >= upto_high + seen["at_high"]:
                self.reopen()
                return
            if rank < self.upto_low:
                self.values[rank] = self.low
            elif rank < upto_high:
                still.append(rank)
            else:
                self.values[rank] = self.high
        self.open = still


def _targets(column: str, ranks: Sequence[int], count: int) -> list[_Target]:
    groups: list[list[int]] = []
    for rank in sorted(set(ranks)):
        if groups and rank - groups[-1][-1] <= 1:
            groups[-1].append(rank)
        else:
            groups.append([rank])
    return [_Target(column, g, count) for g in groups]


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Callable[[int], Sequence[int]]],
    bracket_rows: int = BRACKET_ROWS,
    counts: Mapping[str, int] | None = None,
) -> tuple[dict[str, int], dict[tuple[str, int], float]]:
    """Values at 0-based ranks of numeric columns, as ``({column: count}, {(column, rank): value})``.

    ``ranks[column]`` gets the number of non-null values and returns the ranks it wants. ``counts`` are
    these numbers when the caller knows them already.
    """
    columns = list(ranks)
    found = distributions(df, {c: ref(c).cast("double") for c in columns}, counts)
    counts = {c: found[c].count for c in columns}
    targets = [t for c in columns if counts[c] for t in _targets(c, ranks[c](counts[c]), counts[c])]
    for t in targets:
        t.propose(found[t.column])
    for _ in range(MAX_ROUNDS):
        pending = [t for t in targets if t.open]
        if not pending:
            break
        seen = collect_wide(df, {(i, k): e for i, t in enumerate(pending) for k, e in t.counters().items()})
        for i, t in enumerate(pending):
            t.classify({k: seen[(i, k)] for k in t.counters()})
        pending = [t for t in pending if t.open]
        _settle(df, [t for t in pending if t.between <= bracket_rows])
        wide = [t for t in pending if t.open and t.between > bracket_rows]
        if wide:
            finer = distributions(
                df,
                {str(i): F.when(t.inside(), t.number()) for i, t in enumerate(wide)},
                {str(i): t.between for i, t in enumerate(wide)},
            )
            for i, t in enumerate(wide):
                t.propose(finer[str(i)])
    unsettled = [t for t in targets if t.open]
    if unsettled:
        raise RuntimeError(f"bracket of {unsettled[0].column} did not narrow in {MAX_ROUNDS} rounds")
    return counts, {(t.column, rank): value for t in targets for rank, value in t.values.items()}


def _layers(targets: Sequence[_Target]) -> list[list[int]]:
    """Split targets into groups of one column whose brackets do not overlap."""
    above = lambda t: math.inf if math.isnan(t.high) else t.high
    layers: list[list[int]] = []
    for i in sorted(range(len(targets)), key=lambda i: (targets[i].column, targets[i].low)):
        for layer in layers:
            last = targets[layer[-1]]
            if last.column == targets[i].column and above(last) <= targets[i].low and above(last) < math.inf:
                layer.append(i)
                break
        else:
            layers.append([i])
    return layers


def _settle(df: DataFrame, targets: Sequence[_Target]) -> None:
    """Order the values of small brackets and read off the wanted ranks."""
    for chunk in chunks(list(targets), 64):
        rows = []
        for layer in _layers(chunk):
            number = chunk[layer[0]].number()
            which = F.lit(None).cast("int")
            for i in layer:
                which = F.when(chunk[i].inside(), F.lit(i)).otherwise(which)
            rows.append({"t": which, "v": number})
        candidates = df.filter(reduce(or_, [t.inside() for t in chunk]))
        values = stack_rows(candidates, rows).filter(F.col("t").isNotNull()).groupBy("t", "v").agg(F.count(F.lit(1)).alias("n"))
        upto = Window.partitionBy("t").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        first = F.element_at(F.array(*[F.lit(t.open[0] - t.upto_low).cast("bigint") for t in chunk]), F.col("t") + 1)
        last = F.element_at(F.array(*[F.lit(t.open[-1] - t.upto_low).cast("bigint") for t in chunk]), F.col("t") + 1)
        hits = (
            values.withColumn("upto", F.sum("n").over(upto))
            .filter((F.col("upto") > first) & (F.col("upto") - F.col("n") <= last))
            .collect()
        )
        for hit in hits:
            t = chunk[hit["t"]]
            for rank in list(t.open):
                if hit["upto"] - hit["n"] <= rank - t.upto_low < hit["upto"]:
                    t.values[rank] = hit["v"]
        for t in chunk:
            t.open = [rank for rank in t.open if rank not in t.values]


def _linear_ranks(fractions: Sequence[float]) -> Callable[[int], list[int]]:
    def wanted(n: int) -> list[int]:
        places = [(n - 1) * f for f in fractions]
        return [math.floor(p) for p in places] + [math.ceil(p) for p in places]

    return wanted


def _between(lower: float, upper: float, place: float) -> float:
    """The value at a fractional place between two neighbours, as ``percentile`` computes it."""
    if lower == upper or place == math.floor(place):
        return lower
    return (math.ceil(place) - place) * lower + (place - math.floor(place)) * upper


def quantile_table(
    df: DataFrame,
    columns: Sequence[str],
    fractions: Mapping[str, float],
    rows: int | None = None,
    percentile_rows: int = PERCENTILE_ROWS,
    bracket_rows: int = BRACKET_ROWS,
    counts: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row per column with linearly interpolated quantiles named by the keys of ``fractions``.

    ``rows`` is the row count, and ``counts`` those of the non-null values, when the caller knows them already.
    """
    columns, names = list(columns), list(fractions)
    if rows is None:
        rows = df.count()
    if rows <= percentile_rows:
        wide = per_item(
            df,
            columns,
            lambda c: {"column": F.lit(c)},
            {"q": lambda c: F.percentile(ref(c).cast("double"), F.array(*[F.lit(fractions[n]) for n in names]))},
        )
        return wide.select("column", *[F.col("q")[i].alias(n) for i, n in enumerate(names)])
    counts, values = order_statistics(
        df, {c: _linear_ranks([fractions[n] for n in names]) for c in columns}, bracket_rows, counts
    )
    out = []
    for c in columns:
        row: list = [c]
        for n in names:
            if not counts[c]:
                row.append(None)
                continue
            place = (counts[c] - 1) * fractions[n]
            lower, upper = values[(c, math.floor(place))], values[(c, math.ceil(place))]
            row.append(_between(lower, upper, place))
        out.append(tuple(row))
    return df.sparkSession.createDataFrame(out, "column string, " + ", ".join(f"{n} double" for n in names))
