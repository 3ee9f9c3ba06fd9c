"""Personal data: detection by pattern over whole columns, masking inside text, masking of values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import PII_MASKS, PII_PATTERNS, PII_VALUE_PATTERNS
from plumbline.functions.kinds import ref, string_columns
from plumbline.operators.wide import per_column

PROFILE_TYPES = ("email", "phone", "ssn")


def detect_pii(df: DataFrame, columns: Sequence[str] | None = None, types: Sequence[str] = tuple(PII_PATTERNS)) -> DataFrame:
    """Values per text column that contain each type of personal data; every value is looked at."""
    columns = list(columns or string_columns(df))
    return per_column(
        df,
        columns,
        {
            "values": lambda c: F.count(ref(c)),
            **{f"{t}_count": (lambda c, p=PII_PATTERNS[t]: F.count_if(ref(c).rlike(p))) for t in types},
        },
    )


def pii_report(df: DataFrame, columns: Sequence[str] | None = None, types: Sequence[str] = tuple(PII_PATTERNS)) -> DataFrame:
    """Columns that hold personal data with the list of types found."""
    found = F.array_compact(F.array(*[F.when(F.col(f"{t}_count") > 0, F.lit(t)) for t in types]))
    return detect_pii(df, columns, types).select("column", found.alias("pii_types")).filter(F.size("pii_types") > 0)


def pii_columns(df: DataFrame, types: Sequence[str] = PROFILE_TYPES) -> list[str]:
    if not string_columns(df):
        return []
    return [r["column"] for r in pii_report(df, types=types).collect()]


def mask_text(column: Column) -> Column:
    """Mask every card, social security, phone and email occurrence inside a text.

    The longer digit forms go first, so that a card number is not taken for a phone number.
    """
    for pattern, shown in PII_MASKS:
        column = F.regexp_replace(column, pattern, shown)
    return column


def mask_pii(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or string_columns(df))
    return df.withColumns({c: mask_text(ref(c)) for c in columns})


def value_type(column: Column) -> Column:
    """Type of a value that is personal data as a whole, the most specific form first, or null."""
    digits = F.regexp_replace(column, r"[\s()-]", "")
    return (
        F.when(column.rlike(PII_VALUE_PATTERNS["email"]), "email")
        .when(column.rlike(PII_VALUE_PATTERNS["ssn"]), "ssn")
        .when(column.rlike(PII_VALUE_PATTERNS["credit_card"]), "credit_card")
        .when(column.rlike(PII_VALUE_PATTERNS["phone"]) & digits.rlike(r"\d{7,}"), "phone")
    )


def mask_value(column: Column) -> Column:
    """Mask a value that is an email, social security number, card or phone number as a whole."""
    domain = F.substring_index(column, "@", -1)
    kind = value_type(column)
    return (
        F.when(
            kind == "email",
            F.concat(F.substring(column, 1, 1), F.lit("***@***"), _from_first_dot(domain)),
        )
        .when(kind == "ssn", F.concat(F.lit("***-**-"), F.right(column, F.lit(4))))
        .when(kind == "credit_card", F.concat(F.lit("****-****-****-"), F.right(F.regexp_replace(column, r"[\s-]", ""), F.lit(4))))
        .when(kind == "phone", F.concat(F.lit("*******"), F.right(F.regexp_replace(column, r"[\s()-]", ""), F.lit(4))))
        .otherwise(column)
    )


def _from_first_dot(domain: Column) -> Column:
    return F.substring(domain, F.instr(domain, "."), F.length(domain))


def mask_pii_values(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    columns = list(columns or string_columns(df))
    return df.withColumns({c: mask_value(ref(c)) for c in columns})
