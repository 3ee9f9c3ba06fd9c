"""Version history of rows, reverting, and keeping the newest entries per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.kinds import ref


def keep_last_n(df: DataFrame, key: str, order: str, n: int = 20) -> DataFrame:
    """The newest ``n`` rows per key; tasks drop older rows of a key before the shuffle."""
    newest = Window.partitionBy(ref(key)).orderBy(ref(order).desc())
    return df.withColumn("__rn", F.row_number().over(newest)).filter(F.col("__rn") <= n).drop("__rn")


def version_history(versions: DataFrame, key: str, value: object, created_at: str, ties: Sequence[Column | str] = ()) -> DataFrame:
    """All versions of one key, newest first."""
    return versions.filter(ref(key) == F.lit(value)).orderBy(ref(created_at).desc(), *ties)


# ---- fixed values: days from one run of a schedule to the next -------------------------------
RUN_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}


def next_run(frequency: Column, last: Column) -> Column:
    """The day of the next run after ``last``; null for an unknown frequency."""
    days = F.lit(None).cast("int")
    for name, step in RUN_DAYS.items():
        days = F.when(frequency == name, F.lit(step)).otherwise(days)
    return F.date_add(last.cast("date"), days)


def current_versions(versions: DataFrame, key: str, created_at: str, tie: str) -> DataFrame:
    """The newest version of every key, found by a partial aggregate rather than a window."""
    others = [c for c in versions.columns if c != key]
    newest = F.max_by(F.struct(*[ref(c) for c in others]), F.struct(ref(created_at), ref(tie)))
    return versions.groupBy(ref(key)).agg(newest.alias("__row")).select(ref(key), "__row.*")


def revert_to(versions: DataFrame, key: str, value: object, version: str, version_id: object, created_at: str, now) -> DataFrame:
    """Append the payload of an old version as the newest one; nothing is lost by reverting."""
    old = versions.filter((ref(key) == F.lit(value)) & (ref(version) == F.lit(version_id)))
    next_id = versions.agg((F.max(ref(version)) + 1).alias("next")).first()["next"]
    restored = old.withColumns(
        {
            version: F.lit(next_id).cast(versions.schema[version].dataType),
            created_at: F.lit(now).cast(versions.schema[created_at].dataType),
        }
    )
    return versions.unionByName(restored)
