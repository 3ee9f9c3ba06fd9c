"""Sums of products of many columns in one pass: each task multiplies its rows as matrices, Spark adds the matrices up.

A task turns its batches into one matrix and sends it row by row. Rows with the same number are added as vectors inside
the JVM, before and after the shuffle, so what is shuffled and collected depends on the number of columns only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.kinds import ref
from plumbline.operators.wide import chunks

#: Columns that one pass covers with all their pairs; more are taken in halves of this, a pass for each two halves.
PASS_COLUMNS = 400
#: Rows that are multiplied at a time.
BATCH_ROWS = 1 << 14


def matrix_sums(rows: DataFrame, shape: tuple[int, int], product: Callable[[pa.RecordBatch], np.ndarray], batch_rows: int = BATCH_ROWS) -> np.ndarray:
    """The sum over all batches of the matrices that ``product`` makes of them; zeros for an empty table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        seen = False
        for batch in batches:
            for start in range(0, batch.num_rows, batch_rows):
                total += product(batch.slice(start, batch_rows))
                seen = True
        if seen:
            flat = pa.ListArray.from_arrays(pa.array(np.arange(shape[0] + 1, dtype=np.int32) * shape[1]), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0], dtype=np.int32)), flat], names=["row", "sums"])

    return sum_matrices(rows.mapInArrow(run, "row int, sums array<double>"), shape)


def sum_matrices(parts: DataFrame, shape: tuple[int, int]) -> np.ndarray:
    """The sum of matrices given row by row, as ``row`` and ``sums``."""
    out = np.zeros(shape)
    for r in parts.groupBy("row").agg(Summarizer.sum(array_to_vector("sums")).alias("sums")).collect():
        out[r["row"]] = r["sums"].toArray()
    return out


class Moments(NamedTuple):
    """What one pass tells about each column: present and non-finite values, mean, least and greatest finite value."""

    present: np.ndarray
    odd: np.ndarray
    mean: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _values(batch: pa.RecordBatch, positions: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Values and presence of columns, a column of each matrix per position."""
    present = np.empty((batch.num_rows, len(positions)), bool)
    x = np.empty((batch.num_rows, len(positions)))
    for k, i in enumerate(positions):
        column = batch.column(i)
        present[:, k] = pc.is_valid(column).to_numpy(zero_copy_only=False)
        x[:, k] = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)
    return x, present


def _doubles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[ref(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)])


def column_moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """Counts, means and extremes of all columns in one pass."""
    k = len(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, odd, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k)
        low, high = np.full(k, np.inf), np.full(k, -np.inf)
        for batch in batches:
            x, there = _values(batch, range(k))
            fine = there & np.isfinite(x)
            present += there.sum(0)
            odd += (there & ~fine).sum(0)
            total += np.where(fine, x, 0).sum(0)
            low, high = np.minimum(low, np.where(fine, x, np.inf).min(0, initial=np.inf)), np.maximum(high, np.where(fine, x, -np.inf).max(0, initial=-np.inf))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(present), pa.array(odd), pa.array(total), pa.array(low), pa.array(high)], names=["at", "present", "odd", "total", "low", "high"])

    parts = _doubles(df, columns).mapInArrow(run, "at int, present bigint, odd bigint, total double, low double, high double")
    found = parts.groupBy("at").agg(*[F.sum(c).alias(c) for c in ("present", "odd", "total")], F.min("low").alias("low"), F.max("high").alias("high")).collect()
    out = Moments(np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(k), np.full(k, np.inf), np.full(k, -np.inf))
    for r in found:
        i = r["at"]
        out.present[i], out.odd[i], out.low[i], out.high[i] = r["present"], r["odd"], r["low"], r["high"]
        out.mean[i] = r["total"] / max(1, r["present"] - r["odd"])
    return out


class PairSums(NamedTuple):
    """Over the rows where both columns of a pair are present: their number, and sums of values less the columns' means."""

    n: np.ndarray
    odd: np.ndarray
    x: np.ndarray
    y: np.ndarray
    xx: np.ndarray
    yy: np.ndarray
    xy: np.ndarray


def pair_sums(df: DataFrame, columns: Sequence[str], moments: Moments) -> PairSums:
    """Sums for all pairs of columns; entry ``[i, j]`` has ``i`` as x and ``j`` as y."""
    k = len(columns)
    out = PairSums(*[np.zeros((k, k)) for _ in PairSums._fields])
    halves = list(chunks(range(k), PASS_COLUMNS // 2))
    passes = [list(range(k))] if k <= PASS_COLUMNS else [[*a, *b] for a, b in combinations(halves, 2)]
    for used in passes:
        found = _sums_of(df, [columns[i] for i in used], moments.mean[used], bool(moments.odd[used].any()))
        for whole, part in zip(out, found):
            whole[np.ix_(used, used)] = part
    return out


def _sums_of(df: DataFrame, columns: Sequence[str], mean: np.ndarray, odd_ones: bool) -> PairSums:
    k = len(columns)

    def product(batch: pa.RecordBatch) -> np.ndarray:
        x, present = _values(batch, range(k))
        fine = present & np.isfinite(x)
        x = np.where(fine, x, mean) - mean
        there = present.astype(float)
        parts = [np.hstack([x.T @ x, x.T @ there]), np.hstack([(x * x).T @ there, there.T @ there])]
        if odd_ones:
            odd = (present & ~fine).astype(float)
            parts.append(np.hstack([odd.T @ there, there.T @ odd]))
        return np.vstack(parts)

    total = matrix_sums(_doubles(df, columns), ((3 if odd_ones else 2) * k, 2 * k), product)
    part = lambda i, j: total[i * k : (i + 1) * k, j * k : (j + 1) * k]
    odd = part(2, 0) + part(2, 1) if odd_ones else np.zeros((k, k))
    return PairSums(part(1, 1), odd, part(0, 1), part(0, 1).T, part(1, 0), part(1, 0).T, part(0, 0))
