"""Approximate distribution of columns, used to choose split points and brackets, never results."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.wide import collect_wide

# Values per column that a sample may bring to the driver, and the total over all columns.
SAMPLE_VALUES = 200_000
SAMPLE_TOTAL = 4_000_000
SMALL_SAMPLE = 50_000
SEED = 42


@dataclass
class Distribution:
    """Exact non-null count of a column and a sorted sample of its values."""

    count: int
    values: np.ndarray

    def near(self, rank: float) -> float:
        """A value whose rank is close to ``rank``."""
        place = int(rank / max(self.count, 1) * len(self.values))
        return float(self.values[min(max(place, 0), len(self.values) - 1)])

    @property
    def slack(self) -> float:
        """Five standard errors of the rank of a sampled value."""
        return 5 * self.count / (2 * math.sqrt(max(len(self.values), 1))) + 2


def distributions(
    df: DataFrame, columns: Mapping[str, Column], counts: Mapping[str, int] | None = None
) -> dict[str, Distribution]:
    """Count and sample each named double expression; nulls are left out.

    The counting pass and the sampling pass read only the columns of the expressions, and the
    driver receives a bounded number of values however large the table is.
    """
    names = list(columns)
    if counts is None:
        counts = collect_wide(df, {n: F.count(columns[n]) for n in names})
    rows = max(counts.values(), default=0)
    if not rows:
        return {n: Distribution(0, np.array([])) for n in names}
    wanted = min(SAMPLE_VALUES, SAMPLE_TOTAL // len(names), max(SMALL_SAMPLE, rows // 50))
    picked = df.select(*[columns[n].cast("double").alias(f"v{i}") for i, n in enumerate(names)])
    present = F.coalesce(*[F.col(f"v{i}") for i in range(len(names))]).isNotNull()
    picked = picked.filter(present)
    if wanted < rows:
        picked = picked.sample(wanted / rows, SEED)
    table = picked.toArrow()
    return {
        n: Distribution(counts[n], np.sort(table.column(i).drop_null().to_numpy()))
        for i, n in enumerate(names)
    }
