"""Versioned snapshots, keyed datasets, and detection of identical files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.kinds import ref


def snapshot_version(stage: str, at: datetime) -> str:
    return f"v1.0-cleaned-{stage}-{at:%Y%m%d%H%M%S}"


def save_snapshot(df: DataFrame, root: str, dataset_id: str, version: str) -> str:
    """Write a version as snappy Parquet and return its key. A version is written once."""
    key = f"{dataset_id}/{version}"
    df.write.mode("errorifexists").option("compression", "snappy").parquet(f"{root.rstrip('/')}/{key}")
    return key


def load_snapshot(spark: SparkSession, root: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{key}")


def store_dataset(df: DataFrame, root: str, key_column: str, key: object) -> None:
    """Replace the rows of one key, or add them; other keys are not touched or read."""
    (
        df.withColumn(key_column, F.lit(key))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(key_column)
        .parquet(root)
    )


def load_dataset(spark: SparkSession, root: str, key_column: str, key: object) -> DataFrame:
    return spark.read.parquet(root).filter(ref(key_column) == F.lit(key))


def duplicate_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files with equal content, by MD5 of the whole file. Only the digests are shuffled."""
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    digests = reader.load(path).select("path", F.md5("content").alias("digest"))
    # The list of paths of one digest can be long, so copies stay rows: a count is joined back.
    counts = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return digests.join(counts, "digest")


def duplicate_contents(df: DataFrame, column: str, key: str) -> DataFrame:
    """Digests that occur more than once with their number of copies and smallest key."""
    return (
        df.select(F.md5(ref(column).cast("binary")).alias("digest"), ref(key).alias("key"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("copies"), F.min("key").alias("first_key"))
        .filter("copies > 1")
    )
