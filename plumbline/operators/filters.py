"""Fetching rows by conditions, panel filters, newest rows, limits, and pattern scans of text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import PATTERN_SETS
from plumbline.functions.kinds import plain_text, ref
from plumbline.operators.wide import per_item


def matching(df: DataFrame, conditions: Mapping[str, object]) -> DataFrame:
    """Rows that equal every given value; a condition on None asks for null."""
    tests = [ref(c).isNull() if v is None else ref(c) == F.lit(v) for c, v in conditions.items()]
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def fetch(
    df: DataFrame,
    conditions: Mapping[str, object] | None = None,
    order_by: Sequence[Column | str] = (),
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Filter, order, skip ``offset`` rows and take ``limit``. Order by a unique key to page."""
    out = matching(df, conditions or {})
    if order_by:
        out = out.orderBy(*order_by)
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def fetch_one(df: DataFrame, conditions: Mapping[str, object], order_by: Sequence[Column | str] = ()) -> DataFrame:
    return fetch(df, conditions, order_by, 1)


def filter_panel(
    df: DataFrame,
    confidence: str | None = None,
    min_confidence: float = 0.0,
    text: str | None = None,
    search: str = "",
    date: str | None = None,
    date_from=None,
    date_to=None,
) -> DataFrame:
    """Numeric threshold, text contained without regard to case, and a date range, all optional."""
    tests = []
    if confidence and min_confidence > 0:
        tests.append(ref(confidence) >= min_confidence)
    if text and search:
        tests.append(F.lower(ref(text)).contains(search.lower()))
    if date and date_from is not None:
        tests.append(ref(date) >= F.lit(date_from).cast(df.schema[date].dataType))
    if date and date_to is not None:
        tests.append(ref(date) <= F.lit(date_to).cast(df.schema[date].dataType))
    return df.filter(reduce(lambda a, b: a & b, tests)) if tests else df


def latest(df: DataFrame, by: str, conditions: Mapping[str, object] | None = None, n: int = 50, ties: Sequence[Column | str] = ()) -> DataFrame:
    """The newest ``n`` matching rows; every task keeps only ``n`` rows."""
    return fetch(df, conditions, [ref(by).desc(), *ties], n)


def preview(df: DataFrame, order_by: Sequence[Column | str], n: int = 20, width: int = 50) -> DataFrame:
    """The first ``n`` rows with every cell as text cut to ``width``; null becomes empty text."""
    types = {f.name: f.dataType for f in df.schema.fields}
    cells = [F.substring(F.coalesce(plain_text(ref(c), types[c]), F.lit("")), 1, width).alias(c) for c in df.columns]
    return df.orderBy(*order_by).limit(n).select(*cells)


def limit(df: DataFrame, n: int, order_by: Sequence[Column | str] = ()) -> DataFrame:
    return fetch(df, None, order_by, n)


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def pattern_hits(column: Column, pattern_set: str) -> Column:
    """Numbers (from 1) of the patterns of a set that occur in a text."""
    found = [F.when(column.rlike(f"(?i){p}"), F.lit(i)) for i, p in enumerate(PATTERN_SETS[pattern_set], 1)]
    return F.array_compact(F.array(*found))


def scan_patterns(df: DataFrame, column: str, sets: Sequence[str] = tuple(PATTERN_SETS)) -> DataFrame:
    """Rows with at least one hit, with the hits of each set."""
    hits = df.withColumns({f"{s}_hits": pattern_hits(ref(column), s) for s in sets})
    return hits.filter(reduce(lambda a, b: a | b, [F.size(f"{s}_hits") > 0 for s in sets]))


def pattern_counts(df: DataFrame, column: str, sets: Sequence[str] = tuple(PATTERN_SETS)) -> DataFrame:
    """Rows per pattern: every pattern is tested on every whole text in one pass."""
    items = [(s, i, p) for s in sets for i, p in enumerate(PATTERN_SETS[s], 1)]
    return per_item(
        df,
        items,
        lambda item: {"pattern_set": F.lit(item[0]), "pattern_no": F.lit(item[1])},
        {"rows": lambda item: F.count_if(ref(column).rlike(f"(?i){item[2]}"))},
    )
