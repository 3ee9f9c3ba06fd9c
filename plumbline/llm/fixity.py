"""Fixity audit of archive replicas with Merkle trees over ordered offset ranges.

A leaf covers a fixed range of offsets of one archive file and hashes the records that begin in it, in order;
a node hashes its children. Ranges are fixed, so the trees of two replicas line up even where records are
missing. The audit compares roots and follows only branches that differ, down to single records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import stored

LEAF_BYTES = 1 << 16
FANOUT = 16


def records(pages: DataFrame, pages_per_file: int = 500, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """Archive records of pages: ``file, offset, record, page_id``.

    Pages of neighbouring ids share a file and follow each other by id, then content. A null id goes to files
    chosen by content, and null texts are empty.
    """
    body, url = F.coalesce(F.col(f"`{body_col}`"), F.lit("")), F.coalesce(F.col(f"`{url_col}`"), F.lit(""))
    page = F.col(f"`{id_col}`").cast("long")
    stray = -1 - F.pmod(F.xxhash64(url, body), F.lit(1 << 12))
    rows = pages.select(
        page.alias("page_id"), F.coalesce(F.floor(page / pages_per_file), stray).cast("string").alias("file"),
        F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), url,
            F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
        ).alias("record"),
    )
    # One archive file is one window; the caller bounds it by ``pages_per_file``.
    size = F.octet_length("record").cast("long")
    before = "sum(size) OVER (PARTITION BY file ORDER BY page_id, sha2(record, 256) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size"
    return rows.withColumn("size", size).withColumn("offset", F.expr(before)).select("file", "offset", "record", "page_id")


def digests(replica: DataFrame) -> DataFrame:
    """``file, offset, length, sha256`` of every place of a replica.

    A null record is empty, a null file has the name "", a null offset is -1. Rows that repeat a place are one
    record whose digest is made from all of theirs with their counts.
    """
    record = F.coalesce(F.col("record").cast("binary"), F.lit(b""))
    rows = replica.select(
        F.coalesce(F.col("file").cast("string"), F.lit("")).alias("file"), F.coalesce(F.col("offset").cast("long"), F.lit(-1)).alias("offset"),
        F.octet_length(record).cast("long").alias("length"), F.sha2(record, 256).alias("sha256"),
    )
    counted = rows.groupBy("file", "offset", "length", "sha256").agg(F.count("*").alias("n"))
    all_of = F.array_sort(F.collect_list(F.concat_ws(":", "sha256", "n")))
    places = counted.groupBy("file", "offset").agg(F.max("length").alias("length"), F.first("sha256").alias("one"), F.sum("n").alias("n"), all_of.alias("all"))
    return places.select("file", "offset", "length", F.when(F.col("n") == 1, F.col("one")).otherwise(F.sha2(F.concat_ws(",", "all"), 256)).alias("sha256"))


def leaves(places: DataFrame, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``file, node, hash`` of the offset ranges of ``leaf_bytes``; a range holds few records, as each has a header."""
    entry = F.struct("offset", F.concat_ws(":", F.col("offset").cast("string"), F.col("length").cast("string"), "sha256").alias("text"))
    rows = places.groupBy("file", F.floor(F.col("offset") / leaf_bytes).alias("node")).agg(F.array_sort(F.collect_list(entry)).alias("own"))
    return rows.select("file", "node", F.sha2(F.concat(F.lit("leaf:"), F.array_join("own.text", ",")), 256).alias("hash"))


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The next level: each node hashes up to ``fanout`` children with their places."""
    entry = F.struct("node", F.concat_ws(":", F.col("node").cast("string"), "hash").alias("text"))
    rows = nodes.groupBy("file", F.floor(F.col("node") / fanout).alias("node")).agg(F.array_sort(F.collect_list(entry)).alias("own"))
    return rows.select("file", "node", F.sha2(F.concat(F.lit("node:"), F.array_join("own.text", ",")), 256).alias("hash"))


def tree(places: DataFrame, top: int, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of all files' trees, leaves first; level ``top`` has one node for the offsets from 0 of each file."""
    levels = [stored(leaves(places, leaf_bytes), "merkle")]
    for _ in range(top):
        levels.append(stored(parents(levels[-1], fanout), "merkle"))
    return levels


def _differing(left: DataFrame, right: DataFrame) -> DataFrame:
    both = left.withColumnRenamed("hash", "l").join(right.withColumnRenamed("hash", "r"), ["file", "node"], "full")
    return both.filter(~F.col("l").eqNullSafe(F.col("r"))).select("file", "node")


def audit(left: DataFrame, right: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Records in which two replicas (``file, offset, record``) differ.

    Returns ``file, offset, status`` (changed; missing or extra on the right), both lengths and both digests.
    Equal replicas and empty ones give no rows. Only hashes are shuffled, and below a pair of equal nodes
    nothing is read again but their level.
    """
    sides = [stored(digests(x), "digests") for x in (left, right)]
    last = max(s.agg(F.max("offset")).first()[0] or 0 for s in sides) // leaf_bytes
    top = 0
    while fanout**top <= last:
        top += 1
    trees = [tree(s, top, leaf_bytes, fanout) for s in sides]
    open_nodes = _differing(trees[0][top], trees[1][top])
    for level in range(top - 1, -1, -1):
        under = open_nodes.select("file", F.col("node").alias("parent"))
        below = [
            t[level].withColumn("parent", F.floor(F.col("node") / fanout)).join(under, ["file", "parent"], "left_semi").select("file", "node", "hash")
            for t in trees
        ]
        open_nodes = stored(_differing(*below), "merkle-open")
    suspects = [
        s.withColumn("node", F.floor(F.col("offset") / leaf_bytes)).join(open_nodes, ["file", "node"], "left_semi").select("file", "offset", *[F.col(c).alias(f"{side}_{c}") for c in ("length", "sha256")])
        for s, side in zip(sides, ("left", "right"))
    ]
    both = suspects[0].join(suspects[1], ["file", "offset"], "full").filter(~F.col("left_sha256").eqNullSafe(F.col("right_sha256")))
    status = F.when(F.col("right_sha256").isNull(), "missing").when(F.col("left_sha256").isNull(), "extra").otherwise("changed")
    return both.select("file", "offset", status.alias("status"), "left_length", "right_length", "left_sha256", "right_sha256")
