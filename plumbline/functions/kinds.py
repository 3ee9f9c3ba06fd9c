"""Type families: which columns count as numbers, text, times, and how values are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)

# The largest magnitude below which a double holds every integer and casts safely to bigint.
_BIGINT_SAFE = 9.0e18


def kind_of(data_type: T.DataType) -> str:
    """integer, float, boolean, datetime, string, list, struct or other."""
    if isinstance(data_type, INTEGRAL):
        return "integer"
    if isinstance(data_type, FRACTIONAL):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, TEMPORAL):
        return "datetime"
    if isinstance(data_type, T.StringType):
        return "string"
    if isinstance(data_type, T.ArrayType):
        return "list"
    if isinstance(data_type, T.StructType):
        return "struct"
    return "other"


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind_of(f.dataType) for f in df.schema.fields}


def numeric_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k in ("integer", "float")]


def string_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k == "string"]


def temporal_columns(df: DataFrame) -> list[str]:
    return [c for c, k in kinds(df).items() if k == "datetime"]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ref(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col(quoted(name))


def plain_text(column: Column, data_type: T.DataType) -> Column:
    """The value as text, with integral doubles printed without a fraction (1.0 becomes ``1``)."""
    kind = kind_of(data_type)
    if kind == "float":
        number = column.cast("double")
        integral = (F.abs(number) < _BIGINT_SAFE) & (number == F.floor(number))
        return F.when(integral, F.when(integral, number).cast("bigint").cast("string")).otherwise(
            number.cast("string")
        )
    if kind in ("list", "struct", "other"):
        return F.to_json(F.struct(column.alias("v")))
    return column.cast("string")


def family_of(data_type: T.DataType) -> str:
    """Values compare as equal only inside one family: numbers (and booleans), text, dates, times."""
    kind = kind_of(data_type)
    if kind in ("integer", "float", "boolean"):
        return "number"
    if kind == "datetime":
        return "date" if isinstance(data_type, T.DateType) else "time"
    return kind


def comparable_text(column: Column, data_type: T.DataType) -> Column:
    """Text that is equal exactly when two values of the same family are equal."""
    if isinstance(data_type, T.BooleanType):
        return column.cast("int").cast("string")
    return plain_text(column, data_type)


def sort_position(column: Column, data_type: T.DataType) -> Column:
    """A double that never decreases when the value increases; nulls come first.

    Used only to place rows in ordered buckets. Values that share a position share a bucket and
    are ordered there by their own type, so the rounding of a double does no harm.
    """
    kind = kind_of(data_type)
    if kind in ("integer", "float"):
        position = column.cast("double")
    elif kind == "boolean":
        position = column.cast("int").cast("double")
    elif isinstance(data_type, T.DateType):
        position = F.unix_date(column).cast("double")
    elif isinstance(data_type, T.TimestampType):
        position = F.unix_micros(column).cast("double")
    elif isinstance(data_type, T.TimestampNTZType):
        seconds = F.hour(column) * 3600 + F.minute(column) * 60 + F.extract(F.lit("SECOND"), column)
        position = F.unix_date(F.to_date(column)) * F.lit(86400.0) + seconds.cast("double")
    elif kind == "string":
        head = F.rpad(F.hex(F.substring(F.encode(column, "UTF-8"), 1, 6)), 12, "0")
        position = F.conv(head, 16, 10).cast("double")
    else:
        raise TypeError(f"cannot order by {data_type.simpleString()}")
    return F.coalesce(position, F.lit(float("-inf")))
