"""Centroid clustering in whole numbers: every vector picks its centroid in a tournament of bisecting planes.

For two centroids the points nearer to the one lie on one side of the plane halfway between them. Its normal and threshold
are whole numbers where the centroids are, so that the sign of one linear form says exactly which of the two is nearer. A
vector starts with centroid 0 and meets the others in turn; the loser leaves, after k - 1 signs the winner is the nearest
of all, and only its distance is computed. A zero is a tie and keeps the smaller number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import column_field, narrowed, stored

#: Components beyond this could take a squared distance of some vectors out of 64 bits.
MOST = 1 << 27
#: Bytes of normals that a task may hold.
PLANE_BYTES = 256 << 20
#: Vectors that are compared at a time.
BLOCK = 2048


class Planes(NamedTuple):
    """The centroids, and for each pair (winner so far, challenger) the plane between them."""

    centroids: np.ndarray
    normals: np.ndarray
    thresholds: np.ndarray


def planes(centroids: np.ndarray) -> Planes:
    """Normals and thresholds of all pairs; a point is beyond the plane where the form is above the threshold."""
    squares = (centroids * centroids).sum(1)
    return Planes(centroids, 2 * (centroids[None, :, :] - centroids[:, None, :]), squares[None, :] - squares[:, None])


def nearest(x: np.ndarray, field: Planes) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest centroid of each row, the smaller one on a tie, and the squared distance."""
    winner = np.zeros(len(x), np.int64)
    for challenger in range(1, len(field.centroids)):
        form = np.einsum("ij,ij->i", x, field.normals[winner, challenger])
        winner[form > field.thresholds[winner, challenger]] = challenger
    off = x - field.centroids[winner]
    return winner, np.einsum("ij,ij->i", off, off)


def whole_numbers(vectors: DataFrame, dimensions: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x``, the components as ``floor(scale * component)``, of every vector that can be clustered.

    Vectors that are null, have another number of components, or a component that is null, not a number or infinite, are
    left out. ``x`` is null where a component is beyond ``MOST``: no 64-bit distance could be given to such a vector.
    """
    source = narrowed(vectors, vec_id=id_col, vector=vector_col).withColumn("vector", F.col("vector").cast("array<double>"))
    schema = T.StructType([column_field(source, "vec_id"), T.StructField("x", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector = batch.column("vector")
            batch = batch.filter(pc.fill_null(pc.equal(pc.list_value_length(vector), dimensions), False))
            values = pc.list_flatten(batch.column("vector"))
            data = pc.fill_null(values, float("nan")).to_numpy(zero_copy_only=False).reshape(-1, dimensions)
            fit = np.isfinite(data).all(1)
            with np.errstate(over="ignore"):
                x = np.floor(scale * data[fit])
            inside = (np.abs(x) <= MOST).all(1)
            ends = pa.array(np.r_[0, np.cumsum(inside) * dimensions].astype(np.int32))
            lists = pa.ListArray.from_arrays(ends, pa.array(x[inside].astype(np.int32).ravel()), mask=pa.array(~inside))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").filter(pa.array(fit)), lists], names=["vec_id", "x"])

    return source.mapInArrow(run, schema)


def seeds(whole: DataFrame, k: int, seed: int = 2) -> np.ndarray:
    """The vectors whose ids have the least hashes, in the order of these; equal hashes are ordered by the vectors.

    A null id counts as an empty text. With fewer than ``k`` vectors all of them are taken. Only ``k`` rows reach the driver.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.filter("x IS NOT NULL").select(digest.alias("h"), "x").orderBy("h", "x").limit(k).collect()
    return np.array([r["x"] for r in rows], np.int64)


def _blocks(batch: pa.RecordBatch, dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for start in range(0, batch.num_rows, BLOCK):
        part = batch.slice(start, BLOCK)
        yield part, pc.list_flatten(part.column("x")).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: means of their vectors, rounded down; those without a vector stay.

    A task adds up its vectors and sends a row for each centroid. These rows are added up by Spark, and one row for each
    centroid reaches the driver.
    """
    k, dimensions = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = planes(centroids)
        sums, counts = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            for _, x in _blocks(batch, dimensions):
                winner, _ = nearest(x, field)
                order = np.argsort(winner, kind="stable")
                found, starts = np.unique(winner[order], return_index=True)
                sums[found] += np.add.reduceat(x[order], starts, axis=0)
                counts += np.bincount(winner, minlength=k)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), *[pa.array(sums[some, i]) for i in range(dimensions)]], names=["cluster", "n", *[f"s{i}" for i in range(dimensions)]])

    parts = whole.filter("x IS NOT NULL").select("x").mapInArrow(run, ", ".join(["cluster bigint", "n bigint", *[f"s{i} bigint" for i in range(dimensions)]]))
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", *[f"s{i}" for i in range(dimensions)])]
    out = centroids.copy()
    for r in parts.groupBy("cluster").agg(*exact).collect():
        out[r["cluster"]] = [int(r[f"s{i}"]) // int(r["n"]) for i in range(dimensions)]
    return out


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``vec_id, cluster, distance`` of every vector; both are null where ``x`` is."""
    dimensions = centroids.shape[1]
    schema = T.StructType([column_field(whole, "vec_id"), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = planes(centroids)
        for batch in batches:
            for part, x in _blocks(batch, dimensions):
                winner, distance = nearest(x, field)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(winner.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    found = whole.filter("x IS NOT NULL").mapInArrow(run, schema)
    beyond = whole.filter("x IS NULL").select("vec_id", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("bigint").alias("distance"))
    return found.unionAll(beyond)


def _digest(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dimensions: int = 64, scale: int = 256, seed: int = 2, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """Per vector ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` after ``rounds`` moves of ``k`` centroids.

    All arithmetic is exact. Centroids begin as the vectors of :func:`seeds`; in each round every vector goes to the nearest
    one (the smaller number on a tie) and every centroid with vectors moves to their mean, rounded down. Then all are
    assigned once more. Vectors that :func:`whole_numbers` leaves out have no row; one out of range has a row without a
    cluster. Equal vectors share a cluster, repeated ids are rows of their own, and an empty table gives no rows. An inertia
    beyond 64 bits is null.

    The whole numbers are written to the shared folder once and read in each round. Nothing but ``k`` centroids is sent to
    tasks and nothing but ``k`` rows returns; a table of planes over ``PLANE_BYTES`` is refused.
    """
    if k < 1 or k * k * dimensions * 8 > PLANE_BYTES:
        raise ValueError(f"{k} centroids of {dimensions} components: the planes between them would take more than {PLANE_BYTES} bytes")
    whole = stored(whole_numbers(vectors, dimensions, scale, id_col, vector_col), "whole-vectors")
    centroids = seeds(whole, k, seed)
    if not len(centroids):
        centroids = np.zeros((1, dimensions), np.int64)
    for _ in range(rounds):
        centroids = moved(whole, centroids)
    found = stored(assigned(whole, centroids), "assigned-vectors")
    long = lambda c: F.expr(f"try_cast({c} AS bigint)")
    sums = found.filter("cluster IS NOT NULL").groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"))
    by_number = {int(r["cluster"]): int(r["s"]) for r in sums.collect()}
    table = [(c, str(by_number[c]), str(sum(by_number.values())), _digest(centroids[c])) for c in by_number]
    facts = found.sparkSession.createDataFrame(table, "number int, own string, total string, centroid_sha256 string")
    return found.join(F.broadcast(facts), F.col("cluster") == F.col("number"), "left").select(
        "vec_id", "cluster", "distance", long("own").alias("cluster_inertia"), long("total").alias("inertia"), "centroid_sha256"
    )
