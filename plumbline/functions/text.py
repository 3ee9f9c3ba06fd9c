"""Expressions on text: numbers written as text, missing values, date formats."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.fixed import NULL_TOKENS, NUMBER_TEXT, STRPTIME_LETTERS


def as_number(column: Column) -> Column:
    """The number written in a text value, or null. Type suffixes such as ``1d`` are not numbers."""
    return F.when(column.rlike(NUMBER_TEXT), F.trim(column).try_cast("double"))


def without_null_tokens(column: Column, tokens: Sequence[str] = NULL_TOKENS) -> Column:
    return F.when(~column.isin(list(tokens)), column)


def is_missing(column: Column, is_text: bool, treat_empty_as_null: bool) -> Column:
    if is_text and treat_empty_as_null:
        return column.isNull() | (column == "")
    return column.isNull()


def matches_any(column: Column, patterns: Sequence[str]) -> Column:
    found = F.lit(False)
    for pattern in patterns:
        found = found | column.rlike(pattern)
    return found


def spark_format(strptime: str) -> str:
    """``%Y-%m-%d`` as ``yyyy-MM-dd``; letters outside directives are quoted."""
    out, i = "", 0
    while i < len(strptime):
        directive = strptime[i : i + 2]
        if directive in STRPTIME_LETTERS:
            out, i = out + STRPTIME_LETTERS[directive], i + 2
        else:
            out, i = out + (f"'{strptime[i]}'" if strptime[i].isalpha() else strptime[i]), i + 1
    return out


def parse_time(column: Column, strptime: str) -> Column:
    return F.try_to_timestamp(column, F.lit(spark_format(strptime))).cast("timestamp_ntz")
