"""Streams over folders of files."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import drop_path, fresh_path

#: The time of the row that closes an input, later than any real one and early enough to add a window to.
END_OF_TIME = datetime.datetime(9000, 1, 1)
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    reader = spark.readStream.format("parquet").schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def _process(stream: DataFrame, target: str, mode: str, timeout: float | None) -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("checkpointLocation", f"{target}-progress")
        .trigger(availableNow=True)
        .start(target)
    )
    if not (query.awaitTermination(timeout) if timeout is not None else query.awaitTermination() or True):
        query.stop()
        raise TimeoutError("the stream did not finish in time")


def run_available(stream: DataFrame, mode: str = "append", timeout: float | None = None) -> DataFrame:
    """Process everything that is there now, write it as Parquet and read the result back.

    Windows that the watermark has not passed stay open: more input may come. ``timeout``: seconds after which
    the run is stopped and fails; as long as it takes without.
    """
    spark = stream.sparkSession
    target = fresh_path(spark, "stream")
    try:
        _process(stream, target, mode, timeout)
    finally:
        drop_path(spark, f"{target}-progress")
    return spark.read.schema(stream.schema).parquet(target)


def run_to_end(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], ts: str, timeout: float | None = None) -> DataFrame:
    """The whole output of a streaming operator over an input that has come to its end.

    After all that is there a last row arrives that has nothing but a time, later than all others. It carries the watermark
    past every open window and every timer, so what still waits is put out by the operator itself. Its own window stays
    open. Streams that the operator groups by time see rows of one stream, so there is one watermark.
    """
    spark = stream.sparkSession
    target, closing = fresh_path(spark, "stream"), fresh_path(spark, "closing")
    kind = stream.schema[ts].dataType
    nothing = spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in stream.schema.fields])
    nothing.write.parquet(closing)
    marked = stream.unionByName(read_stream(spark, closing, nothing.schema))
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKS_DB)
    try:
        out = operator(marked)
        _process(out, target, "append", timeout)
        last = spark.range(1).select(*[(F.lit(END_OF_TIME).cast(kind) if f.name == ts else F.lit(None).cast(f.dataType)).alias(f.name) for f in stream.schema.fields])
        last.write.mode("append").parquet(closing)
        _process(operator(marked), target, "append", timeout)
    finally:
        spark.conf.set(STATE_STORE, before)
        drop_path(spark, f"{target}-progress")
        drop_path(spark, closing)
    return spark.read.schema(out.schema).parquet(target)
