"""Connected components of a graph that is held in tables only."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import Scratch


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``id, component`` (the least id reachable) for every end of the edges ``a, b``.

    Rounds of large-star and small-star: every node sends its larger, then its smaller neighbours to the
    least one it knows. The number of edges never grows, a node with very many neighbours is only ever
    joined with one row, and each round's edges are stored in the shared folder, those of earlier rounds removed.
    """
    scratch, last = Scratch(edges.sparkSession), f"{name}-0"
    edges = scratch.keep(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), last)
    state = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state()
    for k in count(1):
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        large = scratch.keep(large, f"{name}-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = scratch.keep(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), f"{name}-{k}")
        scratch.drop(last, f"{name}-large")
        last, now = f"{name}-{k}", state()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots.select("id", F.col("id").alias("component")))
