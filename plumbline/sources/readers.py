"""Readers for CSV, TSV, JSON and Parquet, and the application of an inferred schema."""

from __future__ import annotations

import codecs
from collections.abc import Mapping, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.fixed import INTEGER_TEXT, ISO_TIME_TEXT, NULL_TOKENS
from plumbline.functions.kinds import kinds, ref
from plumbline.functions.text import as_number, parse_time, without_null_tokens
from plumbline.operators.wide import per_column
from plumbline.sources.records import detect_encoding, read_records

# Encodings whose lines are lines of bytes and that Spark's functions decode, by their names in Python.
CHARSETS = {"utf-8": "utf-8", "iso8859-1": "iso-8859-1", "ascii": "us-ascii"}
# Suffix to reader format and options.
FORMATS = {
    ".csv": ("csv", {"sep": ","}),
    ".tsv": ("csv", {"sep": "\t"}),
    ".json": ("json", {}),
    ".parquet": ("parquet", {}),
}


def _text_table(spark: SparkSession, path: str | Sequence[str], encoding: str | None, header: bool, sep: str, multi_line: bool = False) -> DataFrame:
    """All columns as text. Fields beyond the header are dropped, missing ones are null."""
    reader = (
        spark.read.option("header", header)
        .option("sep", sep)
        .option("quote", '"')
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .option("inferSchema", False)
        .option("multiLine", multi_line)
    )
    tried = [e for e in (encoding, "utf-8") if e]
    for name in tried:
        try:
            codecs.lookup(name)
            return reader.option("encoding", name).csv(path)
        except (LookupError, PySparkException):
            if name == tried[-1]:
                raise
    raise AssertionError("unreachable")


def read_csv(spark: SparkSession, path: str | Sequence[str], encoding: str | None = None, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """A CSV file with a header row, every column as text and null tokens as null.

    Types are applied afterwards from a profile of the whole column (:func:`apply_schema`), not
    from a sample at read time. Without an encoding the bytes of all lines tell whether the files are
    UTF-8; if not, they are read as ISO-8859-1. An unknown encoding counts as none. ``multi_line``
    allows line breaks inside quoted fields, see :mod:`plumbline.sources.records`; files in other encodings than those of
    ``CHARSETS`` are then read by one task each.
    """
    try:
        name = codecs.lookup(encoding).name if encoding else None
    except LookupError:
        encoding = name = None
    if multi_line and name in (None, *CHARSETS):
        table = read_records(spark, path, CHARSETS.get(name), sep)
    else:
        table = _text_table(spark, path, encoding or detect_encoding(spark, path), True, sep, multi_line)
    return table.select(*[without_null_tokens(ref(c), NULL_TOKENS).alias(c) for c in table.columns])


def read_csv_rows(spark: SparkSession, path: str | Sequence[str], has_header: bool = True, sep: str = ",") -> DataFrame:
    """A CSV file in which number-like columns become double; without a header names are ``col_0``…

    A column turns into numbers only when every non-empty value is one.
    """
    table = _text_table(spark, path, None, has_header, sep)
    if not has_header:
        table = table.toDF(*[f"col_{i}" for i in range(len(table.columns))])
    trimmed = table.select(*[F.when(F.trim(ref(c)) != "", F.trim(ref(c))).alias(c) for c in table.columns])
    rows = per_column(
        trimmed,
        trimmed.columns,
        {"values": lambda c: F.count(ref(c)), "numbers": lambda c: F.count(as_number(ref(c)))},
    ).collect()
    numeric = {r["column"] for r in rows if r["values"] and r["values"] == r["numbers"]}
    return trimmed.select(*[(as_number(ref(c)) if c in numeric else ref(c)).alias(c) for c in trimmed.columns])


def type_texts(df: DataFrame) -> DataFrame:
    """Text columns as whole numbers, numbers or truth values where every value of the column is one.

    Whole columns decide, not a sample, so no value is lost; columns without values stay text.
    """
    own = kinds(df)
    texts = [c for c in df.columns if own[c] == "string"]
    if not texts:
        return df
    found = per_column(
        df, texts,
        {
            "values": lambda c: F.count(ref(c)),
            "integers": lambda c: F.count(F.when(ref(c).rlike(INTEGER_TEXT), ref(c).try_cast("bigint"))),
            "numbers": lambda c: F.count(as_number(ref(c))),
            "truths": lambda c: F.count_if(F.lower(ref(c)).isin("true", "false")),
        },
    ).collect()
    casts = {}
    for r in found:
        c, n = r["column"], r["values"]
        if n and r["integers"] == n:
            casts[c] = ref(c).try_cast("bigint")
        elif n and r["numbers"] == n:
            casts[c] = as_number(ref(c))
        elif n and r["truths"] == n:
            casts[c] = ref(c).try_cast("boolean")
    return df.select(*[casts.get(c, ref(c)).alias(c) for c in df.columns])


def apply_schema(df: DataFrame, inferred: Sequence[Mapping]) -> DataFrame:
    """Cast columns to their inferred types in one projection; values that do not fit become null.

    A fractional number is no ``int``. :func:`cast_losses` counts what a cast would empty.

    ``inferred`` holds mappings with ``column``, ``detected_type`` and ``format_spec``; columns
    that the table lacks are skipped, and other types leave the column as it is.
    """
    own = kinds(df)
    changes = {}
    for item in inferred:
        name, wanted, spec = item["column"], item["detected_type"], item.get("format_spec")
        if name not in own:
            continue
        if wanted == "int":
            if own[name] == "string":
                number = ref(name).try_cast("double")
                whole = F.when(number == F.floor(number), number.try_cast("bigint"))
                changes[name] = F.coalesce(F.when(ref(name).rlike(INTEGER_TEXT), ref(name).try_cast("bigint")), whole)
            else:
                changes[name] = ref(name).try_cast("bigint")
        elif wanted == "float":
            changes[name] = ref(name).try_cast("double")
        elif wanted in ("date", "datetime") and own[name] == "string":
            # Fractions of a second and a blank before the time are read as well.
            iso = F.when(ref(name).rlike(ISO_TIME_TEXT), ref(name).try_cast("timestamp_ntz"))
            if spec:
                changes[name] = F.coalesce(parse_time(ref(name), spec), iso)
            elif wanted == "datetime":
                changes[name] = iso
    return df.select(*[changes.get(c, ref(c)).alias(c) for c in df.columns])


def cast_losses(before: DataFrame, after: DataFrame) -> DataFrame:
    """``column, values, lost``: values of each column of ``before`` that ``after`` no longer has, by count."""
    shared = [c for c in before.columns if c in after.columns]
    had = per_column(before, shared, {"values": lambda c: F.count(ref(c))})
    has = per_column(after, shared, {"kept": lambda c: F.count(ref(c))}).drop("position")
    return had.join(F.broadcast(has), "column").select("column", "values", (F.col("values") - F.col("kept")).alias("lost"))


def read_table(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A table in one of the accepted formats, chosen by suffix unless given."""
    suffix = "." + fmt.lstrip(".").lower() if fmt else "." + path.rsplit(".", 1)[-1].lower()
    if suffix not in FORMATS:
        raise ValueError(f"unsupported format {suffix!r}; accepted: {', '.join(FORMATS)}")
    name, options = FORMATS[suffix]
    if name == "csv":
        return read_csv(spark, path, sep=options["sep"])
    return spark.read.json(path) if name == "json" else spark.read.parquet(path)
