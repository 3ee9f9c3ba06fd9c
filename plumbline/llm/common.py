"""What several operators of this subpackage share: stored tables, Arrow helpers and word hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import drop_path, fresh_path, stored

__all__ = ["Scratch", "column_field", "narrowed", "slices", "stored", "texts_of", "whole_rows"]


class Scratch:
    """Tables stored on the way to a result, each until it is dropped by its name."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Store a table under a name that is free, and read it back."""
        path = self.paths[name] = fresh_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more."""
        for name in names:
            if name in self.paths:
                drop_path(self.spark, self.paths.pop(name))


def narrowed(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the given names; whatever else the table holds cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def whole_rows(df: DataFrame):
    """All columns of a row as one, so that names with dots or of an operator's own columns do no harm."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def texts_of(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    """The text column of a batch, which may be part of the whole ``row``."""
    return batch.column("row").field(text_col) if "row" in batch.schema.names else batch.column("text")


def slices(batch: pa.RecordBatch, text_col: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about ``limit`` bytes of text each (one row at least)."""
    sizes = pc.fill_null(pc.binary_length(texts_of(batch, text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes + 1)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def column_field(df: DataFrame, name: str):
    """The field of a column, to carry its type through Arrow."""
    return next(f for f in df.schema.fields if f.name == name)
