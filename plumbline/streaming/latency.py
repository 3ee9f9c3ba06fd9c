"""Latency statistics of a request log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import SLOW_SECONDS
from plumbline.functions.kinds import ref
from plumbline.operators.grouping import slow_class

#: Up to about this many values in a window and group the percentiles are exact.
ACCURACY = 10_000


def latency_stream(
    log: DataFrame, endpoint: str, seconds: str, ts: str, window: str = "1 hour", lateness: str = "10 minutes", accuracy: int = ACCURACY
) -> DataFrame:
    """Count, approximate percentiles, extremes and slow requests per endpoint and time window.

    A window is emitted once the watermark has passed it; rows that come later are dropped. What is still open when the
    input ends is emitted by :func:`plumbline.streaming.files.run_to_end`.
    """
    v = ref(seconds)
    timed = log.withColumn("__ts", ref(ts).cast("timestamp")).withWatermark("__ts", lateness)
    quantiles = F.percentile_approx(v, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)), F.lit(accuracy))
    kind = slow_class(v)
    stats = timed.groupBy(F.window("__ts", window).alias("w"), ref(endpoint)).agg(
        F.count(v).alias("count"),
        quantiles.alias("q"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("avg"),
        *[F.count_if(kind == name).alias(f"slow_{name}") for name in SLOW_SECONDS],
    )
    ms = lambda c: F.round(c * 1000, 2)
    return stats.select(
        F.col("w.start").alias("window_start"),
        ref(endpoint),
        "count",
        *[ms(F.col("q")[i]).alias(n) for i, n in enumerate(("p50_ms", "p95_ms", "p99_ms"))],
        ms(F.col("min")).alias("min_ms"),
        ms(F.col("max")).alias("max_ms"),
        ms(F.col("avg")).alias("avg_ms"),
        *[f"slow_{name}" for name in SLOW_SECONDS],
    )
