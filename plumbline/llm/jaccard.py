"""Exact Jaccard join of documents on word shingles, with signature trees.

Two documents link when the overlap of their shingle sets is at least ``percent`` of the union. Linked sets
share one of the first ``n - ceil(percent n) + 1`` shingles of each under any common order, so sets meet in
the lists of those shingles. In every list a dual traversal of signature trees finds the pairs that bitmaps
and sizes cannot rule out, as few as connect all such pairs; their components are a coarse grouping that no
link leaves. Within each coarse group the traversal runs again on the exact sets. Equal sets are one item
throughout, and pairs that are connected already are neither compared nor written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import Scratch, column_field, narrowed, slices, stored
from plumbline.llm.graph import components
from plumbline.llm.signatures import bitmap, linked
from plumbline.llm.words import VISIBLE, gram_hashes, mixed, word_hashes

#: Sets of one comparison; larger lists and coarse groups are compared block by block.
BLOCK = 1000
#: Bytes of list entries that one task sorts.
BUCKET_BYTES = 8 << 20
#: Shingles in at least this share of a sample are put last in the order, which keeps lists short.
FREQUENT_SHARE, FREQUENT_SAMPLE, FREQUENT_MOST = 0.005, 2000, 20_000

ENTRY = np.dtype([("key", "<u4"), ("low", "<u8"), ("high", "<u8")])


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted hashes of the distinct shingles of each text; a shorter text is one shingle, an empty one none."""
    hashes, counts = word_hashes(texts, VISIBLE)
    grams = gram_hashes(hashes, words)
    out, end = [], np.cumsum(counts)
    for stop, n in zip(end.tolist(), counts.tolist()):
        if n >= words:
            out.append(np.unique(grams[stop - n : stop - words + 1]))
        else:
            out.append(gram_hashes(hashes[stop - n : stop], n) if n else np.zeros(0, np.uint64))
    return out


def set_id(hashes: np.ndarray) -> bytes:
    """A name of 128 bits for a set, whatever order its members come in."""
    odd = mixed(hashes + np.uint64(0x5851F42D4C957F2D))
    return np.array([mixed(hashes).sum(dtype=np.uint64), odd.sum(dtype=np.uint64)]).tobytes()


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def links(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = overlap(a, b)
    return 100 * common >= percent * (len(a) + len(b) - common)


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles of many texts of a sample of at most about FREQUENT_SAMPLE rows; they only order the others."""
    total = docs.count()
    rate = min(1.0, FREQUENT_SAMPLE / max(1, total))
    drawn = docs.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_003)) < F.lit(rate * 1_000_003)).select("text")

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingle_sets(part.column("text").to_pylist(), words)
                keys, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    counted = drawn.mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    least = max(3, FREQUENT_SHARE * FREQUENT_SAMPLE * min(1.0, total / FREQUENT_SAMPLE))
    kept = counted.filter(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(FREQUENT_MOST)
    return np.sort(np.array([r["key"] for r in kept.collect()], np.int64).view(np.uint64))


def described(docs: DataFrame, words: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """For every row: ``doc_id, text_hash, n, id`` of its set, the bitmap ``bits`` and the first shingles ``keys``."""
    schema = T.StructType([
        column_field(docs, "doc_id"), T.StructField("text_hash", T.LongType()), T.StructField("n", T.LongType()),
        T.StructField("id", T.BinaryType()), T.StructField("bits", T.BinaryType()), T.StructField("keys", T.BinaryType()),
    ])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                n, ids, bits, keys = [], [], [], []
                for own in shingle_sets(part.column("text").to_pylist(), words):
                    n.append(len(own))
                    ids.append(set_id(own))
                    bits.append(bitmap(own) if len(own) else b"")
                    late = np.zeros(len(own), bool) if not len(frequent) else frequent[np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)] == own
                    first = len(own) - -(-percent * len(own) // 100) + 1
                    keys.append(np.r_[own[~late], own[late]][:first].tobytes() if len(own) else b"")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_hash"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(bits, pa.binary()), pa.array(keys, pa.binary())],
                    names=schema.names,
                )

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, schema)


def memberships(sets: DataFrame, buckets: int) -> DataFrame:
    """``list, id`` for every first shingle that two or more sets have.

    A list is named after its members, so the many shingles that the same sets share make one list.
    """

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            own = list(dict(zip(batch.column("id").to_pylist(), batch.column("keys").to_pylist())).items())
            keys = np.frombuffer(b"".join(k for _, k in own), np.uint64)
            ids = np.repeat(np.frombuffer(b"".join(i for i, _ in own), [("low", "<u8"), ("high", "<u8")]), [len(k) // 8 for _, k in own])
            where = (keys % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(where, kind="stable")
            rows = np.empty(len(keys), ENTRY)
            rows["key"], rows["low"], rows["high"] = (keys >> np.uint64(32))[order], ids["low"][order], ids["high"][order]
            names, begins = np.unique(where[order], return_index=True)
            blobs = [rows[a:b].tobytes() for a, b in zip(begins, [*begins[1:], len(rows)])]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])

    def gather(key, table):
        rows = np.unique(np.frombuffer(b"".join(table.column("entries").to_pylist()), ENTRY))
        same = np.diff(rows["key"].astype(np.int64), prepend=-1) == 0
        shared = same | np.r_[same[1:], False]
        rows = rows[shared]
        begins = np.flatnonzero(np.diff(rows["key"].astype(np.int64), prepend=-1))
        names = np.zeros(0, np.int64)
        if len(rows):
            sums = np.add.reduceat(mixed(rows["low"] ^ mixed(rows["high"])), begins, dtype=np.uint64)
            names = np.repeat(sums.view(np.int64), np.diff(np.append(begins, len(rows))))
        ids = np.stack([rows["low"], rows["high"]], axis=1).tobytes()
        return pa.table({"list": names, "id": pa.array([ids[k : k + 16] for k in range(0, len(ids), 16)], pa.binary())})

    dealt = sets.select("id", "keys").mapInArrow(deal, "bucket long, entries binary")
    return dealt.groupBy("bucket").applyInArrow(gather, "list long, id binary").distinct()


EDGE = "a binary, b binary"


def edges_table(edges: list[tuple[bytes, ...]], names: str = "ab") -> pa.Table:
    return pa.table({name: pa.array([e[k] for e in edges], pa.binary()) for k, name in enumerate(names)})


def stars(edges: DataFrame) -> DataFrame:
    """``a, b``: every end of the edges ``a, b, c`` with ``c``."""
    return edges.select("a", F.col("c").alias("b")).unionAll(edges.select(F.col("b").alias("a"), F.col("c").alias("b")))


def coarse_edges(members: DataFrame, signs: DataFrame, percent: int, shards: int, block: int) -> DataFrame:
    """Pairs ``a, b`` of one list that the signature trees leave open, as few as connect all of them; ``c`` is the least of those connected.

    A list above ``block`` is dealt by blocks. Each block is compared in itself; where that and the other lists
    leave its members in several components, every two blocks that differ in them meet in one task.
    """

    def compare(key, table):
        table = table.sort_by([("list", "ascending"), ("low", "ascending"), ("high", "ascending"), ("id", "ascending")])
        group = list(zip(*(table.column(c).to_pylist() for c in ("list", "low", "high"))))
        ids, own, known, bits = (table.column(c).to_pylist() for c in ("id", "block", "known", "bits"))
        sizes = table.column("n").to_numpy()
        begins = [k for k in range(len(group)) if not k or group[k] != group[k - 1]]
        found: set[tuple[bytes, ...]] = set()
        for a, b in zip(begins, [*begins[1:], len(group)]):
            _, low, high = group[a]
            sides = None if low == high else np.array([int(x == high) for x in own[a:b]])
            _, first, label = np.unique(np.array([k.hex() for k in known[a:b]]), return_index=True, return_inverse=True)
            result = linked(bits[a:b], sizes[a:b], percent, None, sides, first[label])
            found.update((ids[a + x], ids[a + y], ids[a + result.labels[x]]) for x, y in result.edges)
        return edges_table(sorted(found), "abc")

    def compared(rows: DataFrame) -> DataFrame:
        """Edges of ``list, id, block, low, high, known``."""
        rows = rows.select("list", "id", "block", "low", "high", "known").join(signs, "id")
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("list", "low", "high"), F.lit(shards)))
        return rows.groupBy("shard").applyInArrow(compare, EDGE + ", c binary")

    large = stored(members.groupBy("list").agg(F.count("*").alias("size")).filter(F.col("size") > block), "shingle-large-lists")
    if large.isEmpty():
        zero = F.lit(0)
        return compared(members.select("list", "id", zero.alias("block"), zero.alias("low"), zero.alias("high"), F.col("id").alias("known")))
    sized = members.join(large, "list", "left").withColumn("blocks", F.ceil(F.coalesce("size", F.lit(1)) / block).cast("int"))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("list", "id"), F.col("blocks")).cast("int"))
    inside = stored(compared(sized.select("list", "id", "block", F.col("block").alias("low"), F.col("block").alias("high"), F.col("id").alias("known"))).distinct(), "shingle-inside")
    known = stored(components(stars(inside)), "shingle-inside-groups").withColumnRenamed("component", "known")
    labelled = members.join(large.select("list"), "list").join(known, "id", "left").withColumn("known", F.coalesce("known", "id"))
    counts = stored(labelled.groupBy("list", "known").agg(F.count("*").alias("n")), "shingle-list-parts")
    # Members of the largest component of a list need no comparison with each other: they have the first blocks, all others the rest.
    parts = counts.groupBy("list").agg(F.max(F.struct("n", "known")).alias("main"), F.sum("n").alias("all"))
    parts = parts.filter(F.col("main.n") < F.col("all"))
    parts = parts.select("list", F.col("main.known").alias("main"), F.ceil(F.col("main.n") / block).cast("int").alias("first"), F.ceil((F.col("all") - F.col("main.n")) / block).cast("int").alias("rest"))
    rows = labelled.join(parts, "list").withColumn("is_main", F.col("known") == F.col("main"))
    rows = rows.withColumn("block", F.when(F.col("is_main"), F.pmod(F.xxhash64("list", "id"), F.col("first"))).otherwise(F.col("first") + F.pmod(F.xxhash64("list", "id"), F.col("rest"))).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("is_main"), F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("rest") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return inside.unionAll(compared(rows))


def exact_edges(sets: DataFrame, percent: int, shards: int, block: int) -> DataFrame:
    """Exactly linked sets and the least set they are connected to, for each coarse group; ``sets`` has ``id, component, hashes, known`` and the group's ``size``.

    A group above ``block`` is dealt by blocks, and every two blocks meet in one task; what is ``known`` to be
    connected is not compared again.
    """
    blocks = F.ceil(F.col("size") / block).cast("int")
    rows = sets.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).drop("other", "size")
    single = F.pmod(F.xxhash64("component"), F.lit(shards))
    rows = rows.withColumn("shard", F.when(F.col("blocks") > 1, F.xxhash64("component", "low", "high")).otherwise(single))

    def compare(key, table):
        table = table.sort_by([("component", "ascending"), ("low", "ascending"), ("high", "ascending"), ("id", "ascending")])
        group = list(zip(*(table.column(c).to_pylist() for c in ("component", "low", "high"))))
        ids, own, hashes, known = (table.column(c).to_pylist() for c in ("id", "block", "hashes", "known"))
        begins = [k for k in range(len(group)) if not k or group[k] != group[k - 1]]
        found = []
        for a, b in zip(begins, [*begins[1:], len(group)]):
            arrays = [np.frombuffer(h, np.uint64) for h in hashes[a:b]]
            _, low, high = group[a]
            sides = None if low == high else np.array([int(x == high) for x in own[a:b]])
            _, first, label = np.unique(np.array([k.hex() for k in known[a:b]]), return_index=True, return_inverse=True)
            accept = lambda x, y, s=arrays: links(s[x], s[y], percent)
            result = linked([bitmap(s) for s in arrays], np.array([len(s) for s in arrays]), percent, accept, sides, first[label])
            found += [(ids[a + x], ids[a + y]) for x, y in enumerate(result.labels.tolist()) if x != y]
        return edges_table(found)

    return rows.groupBy("shard").applyInArrow(compare, EDGE)


def exact_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``id, hashes`` of the wanted sets, taken from one row of each."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes = [own.tobytes() for own in shingle_sets(part.column("text").to_pylist(), words)]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(hashes, pa.binary())], names=["id", "hashes"])

    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    same = F.col("w.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("w.text_hash") == F.col("t.text_hash"))
    rows = texts.alias("t").join(wanted.alias("w"), same).select("w.id", "t.text")
    return rows.mapInArrow(run, "id binary, hashes binary").dropDuplicates(["id"])


def verified(edges: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The edges whose sets do link."""

    def run(batches):
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("left", "right"))
            keep = [links(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(left, right)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    pairs = edges.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("left")), "a")
    pairs = pairs.join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("right")), "b")
    return pairs.select("a", "b", "left", "right").mapInArrow(run, EDGE)


def join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, keep_text_hash: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``, with ``keep_text_hash`` also ``component, text_hash``.

    Words are lower-cased (A to Z) runs of visible characters, a set holds the distinct shingles of
    ``words`` words; a shorter text is one shingle. ``component_id`` is the least ``doc_id`` reachable
    by links, itself included. A null or empty text has no shingles and links with nothing; a null id
    takes part like any other row and names no component. Repeated rows and equal sets are one item
    and get one component. Whole texts are used, no list or group is cut, and an empty table gives an
    empty result. Sets are told apart by hashes of 64 bits a shingle and 128 bits a set.
    """
    rows = narrowed(docs, doc_id=id_col, text=text_col)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    described_rows = stored(described(rows, words, percent, frequent_shingles(rows, words)), "shingle-rows")
    some = described_rows.filter("n > 0")
    entries = some.agg(F.sum(F.length("keys"))).first()[0] or 0
    shards = max(parts, entries // 8 * ENTRY.itemsize // BUCKET_BYTES + 1)
    scratch = Scratch(spark)
    members = scratch.keep(memberships(some, shards), "shingle-lists")
    named = members.select("id").distinct()
    signs = some.groupBy("id").agg(F.first("n").alias("n"), F.first("bits").alias("bits")).join(named, "id", "left_semi")
    coarse = scratch.keep(coarse_edges(members, signs, percent, shards, block).distinct(), "shingle-pairs")
    scratch.drop("shingle-lists")
    groups = scratch.keep(components(stars(coarse)), "shingle-groups")
    wanted = some.join(groups.select("id"), "id", "left_semi").groupBy("id").agg(F.min(F.struct("doc_id", "text_hash")).alias("row"))
    sets = scratch.keep(exact_sets(rows, wanted.select("id", "row.doc_id", "row.text_hash"), words), "shingle-sets")
    sizes = scratch.keep(groups.groupBy("component").agg(F.count("*").alias("size")), "shingle-sizes")
    grouped = groups.join(sizes, "component")
    if sizes.filter(F.col("size") > block).isEmpty():
        exact = exact_edges(grouped.join(sets, "id").withColumn("known", F.col("id")), percent, shards, block)
    else:
        # Very large groups: the coarse pairs are checked first; where all of them hold, nothing is left to compare.
        of_large = coarse.select("a", "b").distinct().join(grouped.filter(F.col("size") > block).select(F.col("id").alias("a")), "a", "left_semi")
        sure = scratch.keep(verified(of_large, sets, percent), "shingle-links")
        known = scratch.keep(components(sure), "shingle-known").withColumnRenamed("component", "known")
        labelled = grouped.join(known, "id", "left").withColumn("known", F.coalesce("known", "id"))
        split = labelled.groupBy("component").agg((F.min("known") < F.max("known")).alias("open")).filter("open").select("component")
        left = labelled.join(split, "component", "left_semi").join(sets, "id")
        exact = exact_edges(left, percent, shards, block).unionAll(sure)
    final = stored(components(exact), "shingle-components")
    scratch.drop("shingle-pairs", "shingle-groups", "shingle-sets", "shingle-sizes", "shingle-links", "shingle-known")
    placed = described_rows.filter("n > 0").select("doc_id", "n", "id", "text_hash").join(final, "id", "left")
    placed = placed.withColumn("component", F.coalesce("component", "id"))
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    wordless = described_rows.filter("n = 0").withColumn("component", F.col("id")).withColumn("component_id", F.col("doc_id"))
    names = ["doc_id", F.col("n").alias("n_shingles"), "component_id"] + (["component", "text_hash"] if keep_text_hash else [])
    return placed.join(least, "component").select(*names).unionAll(wordless.select(*names))
