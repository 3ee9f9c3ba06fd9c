"""Removal of byte runs that occur more than once in a collection of documents.

Equal runs must meet in one task. Every run of ``length`` bytes is dealt by its anchor, the least hash of the
grams inside it: equal runs have equal anchors. Consecutive runs with one anchor form a segment, cut out with
the bytes its last run needs. Anchors found once can hold no repeat; the segments of the others are collected,
equal ones as one, and each task builds the sorted suffixes and common prefixes of its segments column by
column. Places where the common prefix with a neighbour reaches ``length`` start a repeated run.

A shard whose segments are too many for one task (a passage that very many documents share has few anchors but
differing bytes around it) is not sorted: each of its runs is dealt by the hash of all its bytes and counted.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import column_field, narrowed, slices, stored
from plumbline.llm.suffixes import repeated_starts
from plumbline.llm.words import byte_gram_hashes, mixed

GRAM = 64
#: Bytes of anchors that one task sorts, and of segments that one task builds suffixes of.
ANCHOR_BYTES, SEGMENT_BYTES = 8 << 20, 2 << 20
#: Bytes of segments above which the runs of a shard are counted by their hashes.
CROWDED_BYTES = 2 * SEGMENT_BYTES

LOW_HALF = np.uint64(0xFFFFFFFF)
ANCHOR = np.dtype([("anchor", "<u8"), ("text", "<u8"), ("start", "<u4"), ("runs", "u1")])
SEGMENT = np.dtype([("start", "<u4"), ("runs", "u1"), ("anchor", "<u8")])
RUN = np.dtype([("high", "<u8"), ("low", "<u8"), ("number", "<u8"), ("place", "<u4")])
PLACE = np.dtype([("number", "<u8"), ("place", "<u4")])


def sliding_least(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    step = 1
    while 2 * step <= size:
        values = np.minimum(values[:-step], values[step:])
        step *= 2
    return np.minimum(values[: len(values) - (size - step)], values[size - step :]) if step < size else values


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, text number, first run and number of runs of every segment, all of whose runs have one and the same gram as anchor."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    runs = np.maximum(0, sizes - length + 1)
    if not runs.any():
        return np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3
    hashes = byte_gram_hashes(np.frombuffer(b"".join(texts), np.uint8), GRAM)
    # The least gram of a run is told by the upper half of its hash, and of several by the last one.
    place = np.arange(len(hashes), dtype=np.uint64)
    least = sliding_least(hashes & ~LOW_HALF | LOW_HALF - place, length - GRAM + 1)
    at = (LOW_HALF - (least & LOW_HALF)).astype(np.int64)
    own = np.flatnonzero(runs)
    inside = np.zeros(len(at) + 1, np.int32)
    np.add.at(inside, begins[own], 1)
    np.add.at(inside, begins[own] + runs[own], -1)
    first = np.r_[True, at[1:] != at[:-1]]
    first[begins[own]] = True
    starts = np.flatnonzero(first & (np.cumsum(inside[:-1]) > 0))
    text = np.searchsorted(ends, starts, "right")
    stops = np.minimum(np.r_[starts[1:], len(at)], begins[text] + runs[text])
    return hashes[at[starts]], text, starts - begins[text], stops - starts


def anchors(docs: DataFrame, length: int, buckets: int) -> DataFrame:
    """``bucket, entries``: the anchors of all texts, dealt by anchor; texts met before in a batch are left out."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                known = dict(zip(part.column("k1").to_pylist(), part.column("text").to_pylist()))
                names = np.array(list(known), np.int64).view(np.uint64)
                anchor, text, start, runs = segments([t.encode("utf-8", "replace") if t else b"" for t in known.values()], length)
                rows = np.empty(len(anchor), ANCHOR)
                rows["anchor"], rows["text"], rows["start"], rows["runs"] = anchor, names[text] if len(text) else 0, start, runs
                where = (anchor % np.uint64(buckets)).astype(np.int64)
                yield dealt(rows, where)

    return docs.select("k1", "text").mapInArrow(run, "bucket long, entries binary")


def dealt(rows: np.ndarray, where: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, with its entries packed."""
    order = np.argsort(where, kind="stable")
    names, begins = np.unique(where[order], return_index=True)
    rows = rows[order]
    blobs = [rows[a:b].tobytes() for a, b in zip(begins, [*begins[1:], len(rows)])]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "entries"])


def shared_segments(found: DataFrame, buckets: int) -> DataFrame:
    """``k1, segments``: for each text the segments whose anchor is found more than once."""

    def keep(key, table):
        rows = np.unique(np.frombuffer(b"".join(table.column("entries").to_pylist()), ANCHOR))
        same = np.r_[False, rows["anchor"][1:] == rows["anchor"][:-1]]
        rows = rows[same | np.r_[same[1:], False]]
        return pa.Table.from_batches([dealt(rows, (rows["text"] % np.uint64(buckets)).astype(np.int64))])

    def by_text(key, table):
        rows = np.frombuffer(b"".join(table.column("entries").to_pylist()), ANCHOR)
        rows = rows[np.lexsort((rows["start"], rows["text"]))]
        own = np.empty(len(rows), SEGMENT)
        for name in SEGMENT.names:
            own[name] = rows[name]
        names, begins = np.unique(rows["text"], return_index=True)
        blobs = [own[a:b].tobytes() for a, b in zip(begins, [*begins[1:], len(own)])]
        return pa.table({"k1": pa.array(names.view(np.int64)), "segments": pa.array(blobs, pa.binary())})

    kept = found.groupBy("bucket").applyInArrow(keep, "bucket long, entries binary")
    return kept.groupBy("bucket").applyInArrow(by_text, "k1 long, segments binary")


CUT = "shard long, contents binary, size long, k1 long, k2 long, occurrences array<struct<start: int, content: binary>>"


def cut_out(rows: DataFrame, length: int, shards: int) -> DataFrame:
    """The bytes of the segments of ``k1, k2, text, segments``, by shard; and, in rows of their own, where each text has which."""
    occurrence = pa.list_(pa.struct([("start", pa.int32()), ("content", pa.binary())]))

    def run(batches):
        last = None
        for batch in batches:
            for part in slices(batch, "text"):
                contents: dict[int, dict[bytes, list]] = {}
                texts, where = [], []
                for k1, k2, text, blob in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "text", "segments"))):
                    if (k1, k2) == last:
                        continue
                    last = (k1, k2)
                    raw, own = text.encode("utf-8", "replace"), []
                    for start, runs, anchor in np.frombuffer(blob, SEGMENT).tolist():
                        content = raw[start : start + runs + length - 1]
                        if len(content) < length:
                            continue  # of another text with the same first hash
                        name = hashlib.blake2b(content, digest_size=16).digest()
                        entry = contents.setdefault(anchor % shards, {}).setdefault(name, [content, 0])
                        entry[1] = min(2, entry[1] + 1)
                        own.append({"start": start, "content": name})
                    texts.append((k1, k2))
                    where.append(own)
                sizes = [sum(len(c) for c, _ in own.values()) for own in contents.values()]
                packed = [
                    zlib.compress(b"".join([np.array([len(own), *[len(c) for c, _ in own.values()], *[n for _, n in own.values()]], "<u4").tobytes(), *own, *[c for c, _ in own.values()]]), 1)
                    for own in contents.values()
                ]
                n, m = len(packed), len(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*contents, *[None] * m], pa.int64()), pa.array([*packed, *[None] * m], pa.binary()), pa.array([*sizes, *[None] * m], pa.int64()),
                        pa.array([*[None] * n, *[t[0] for t in texts]], pa.int64()), pa.array([*[None] * n, *[t[1] for t in texts]], pa.int64()),
                        pa.array([*[None] * n, *where], occurrence),
                    ],
                    names=["shard", "contents", "size", "k1", "k2", "occurrences"],
                )

    return rows.mapInArrow(run, CUT)


def unpacked(blob: bytes) -> list[tuple[bytes, bytes, int]]:
    """Name, bytes and count of each content of a packed row."""
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    numbers = np.frombuffer(raw, "<u4", 2 * n, 4).tolist()
    at, out = 4 + 8 * n + 16 * n, []
    for k in range(n):
        name = raw[4 + 8 * n + 16 * k : 4 + 8 * n + 16 * k + 16]
        out.append((name, raw[at : at + numbers[k]], numbers[n + k]))
        at += numbers[k]
    return out


def repeated_runs(packed: DataFrame, length: int) -> DataFrame:
    """``content, first, last``: the stretches of places in each content where repeated runs start."""

    def run(key, table):
        counts: dict[bytes, int] = {}
        contents: dict[bytes, bytes] = {}
        for blob in table.column("contents").to_pylist():
            for name, content, n in unpacked(blob):
                contents[name] = content
                counts[name] = counts.get(name, 0) + n
        names = sorted(contents)
        out, first, last = [], [], []
        for name, mask in zip(names, repeated_starts([contents[x] for x in names], length)):
            if counts[name] > 1:
                mask = np.arange(len(mask)) <= len(mask) - length
            edge = np.flatnonzero(np.diff(mask.astype(np.int8), prepend=0, append=0))
            out += [name] * (len(edge) // 2)
            first += edge[::2].tolist()
            last += (edge[1::2] - 1).tolist()
        return pa.table({"content": pa.array(out, pa.binary()), "first": pa.array(first, pa.int32()), "last": pa.array(last, pa.int32())})

    return packed.groupBy("shard").applyInArrow(run, STARTS)


STARTS = "content binary, first int, last int"


def run_hashes(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every run of ``length`` bytes: all its bytes, and its halves mixed in their order."""
    half = byte_gram_hashes(data, length // 2)
    rest = half[length - length // 2 :]
    return byte_gram_hashes(data, length), mixed(mixed(half[: len(rest)]) * np.uint64(3) + rest)


def counted_runs(packed: DataFrame, length: int, parts: int) -> DataFrame:
    """As :func:`repeated_runs`, for shards of any size: equal runs meet by their hashes, not by their anchor.

    Of equal runs of one batch only one is sent on, so a run that very many segments have is no large group.
    """

    def unpack(batches):
        for batch in batches:
            for blob in batch.column("contents").to_pylist():
                names, contents, counts = zip(*unpacked(blob))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(contents, pa.binary()), pa.array(counts, pa.int64())], names=["content", "bytes", "n"])

    each = packed.select("contents").mapInArrow(unpack, "content binary, bytes binary, n long")
    each = each.groupBy("content").agg(F.first("bytes").alias("bytes"), F.sum("n").alias("n"))
    each = stored(each.withColumn("number", F.monotonically_increasing_id()), "repeat-crowded")
    total = each.agg(F.sum(F.octet_length("bytes") - length + 1)).first()[0] or 0
    buckets = max(parts, total * RUN.itemsize // ANCHOR_BYTES + 1)

    def by_number(rows):
        own = np.empty(len(rows), PLACE)
        own["number"], own["place"] = rows["number"], rows["place"]
        return own, (own["number"] % np.uint64(buckets)).astype(np.int64)

    def several(rows):
        """The runs in order of their hashes, which of them have an equal before, and which have any."""
        rows = rows[np.lexsort((rows["low"], rows["high"]))]
        same = np.r_[False, (rows["high"][1:] == rows["high"][:-1]) & (rows["low"][1:] == rows["low"][:-1])][: len(rows)]
        return rows, same, same | np.r_[same[1:], False][: len(rows)]

    def tagged(batch, known):
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([known] * batch.num_rows, pa.bool_())], names=["bucket", "entries", "known"])

    def deal(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                contents = part.column("text").to_pylist()
                sizes = np.array([len(c) for c in contents], np.int64)
                begins = np.cumsum(sizes) - sizes
                high, low = run_hashes(np.frombuffer(b"".join(contents), np.uint8), length)
                runs = sizes - length + 1
                place = np.arange(int(runs.sum())) - np.repeat(np.cumsum(runs) - runs, runs)
                at = np.repeat(begins, runs) + place
                rows = np.empty(len(at), RUN)
                rows["high"], rows["low"], rows["place"] = high[at], low[at], place
                rows["number"] = np.repeat(part.column("number").to_numpy(zero_copy_only=False), runs)
                rows, same, more = several(rows)
                yield tagged(dealt(*by_number(rows[more])), True)
                rows = rows[~same]
                yield tagged(dealt(rows, (rows["high"] % np.uint64(buckets)).astype(np.int64)), False)

    def meet(key, table):
        rows, _, more = several(np.frombuffer(b"".join(table.column("entries").to_pylist()), RUN))
        return pa.Table.from_batches([dealt(*by_number(rows[more]))])

    def stretches(key, table):
        rows = np.unique(np.frombuffer(b"".join(table.column("entries").to_pylist()), PLACE))
        new = np.r_[True, (rows["number"][1:] != rows["number"][:-1]) | (rows["place"][1:] != rows["place"][:-1] + 1)][: len(rows)]
        begins = np.flatnonzero(new)
        ends = np.r_[begins[1:], len(rows)][: len(begins)] - 1
        return pa.table({"number": rows["number"][begins].astype(np.int64), "first": rows["place"][begins].astype(np.int32), "last": rows["place"][ends].astype(np.int32)})

    sent = stored(each.select("number", F.col("bytes").alias("text")).mapInArrow(deal, "bucket long, entries binary, known boolean"), "repeat-hashes")
    met = sent.filter("NOT known").select("bucket", "entries").groupBy("bucket").applyInArrow(meet, "bucket long, entries binary")
    places = met.unionAll(sent.filter("known").select("bucket", "entries")).groupBy("bucket").applyInArrow(stretches, "number long, first int, last int")
    once = each.filter("n = 1").select("content", "number").join(places, "number").select("content", "first", "last")
    return once.unionAll(each.filter("n > 1").select("content", F.lit(0).alias("first"), (F.octet_length("bytes") - length).alias("last")))


def starts_of(packed: DataFrame, length: int, parts: int, crowded_bytes: int) -> DataFrame:
    """``content, first, last`` of all shards, each by the way its size calls for."""
    crowded = stored(packed.groupBy("shard").agg(F.sum("size").alias("size")).filter(F.col("size") > crowded_bytes).select("shard"), "repeat-shards")
    if crowded.isEmpty():
        return repeated_runs(packed, length)
    few = repeated_runs(packed.join(F.broadcast(crowded), "shard", "left_anti"), length)
    return few.unionAll(counted_runs(packed.join(F.broadcast(crowded), "shard", "left_semi"), length, parts))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered places; spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def find(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, spans`` of every row: the maximal runs of bytes (first, end exclusive) covered by repeated runs.

    A run of ``length`` UTF-8 bytes is repeated if it also starts anywhere else, in the same text too; runs
    never cross texts and overlaps count. A null text is empty. Of rows with equal texts each has the other's
    runs elsewhere, so all bytes of such a text of ``length`` bytes or more are covered; for other texts they
    count once. Whole texts are used and nothing is capped. Texts are told apart by two 64-bit hashes and
    segments by one of 128 bits.
    """
    source = narrowed(docs, doc_id=id_col, text=text_col).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.reverse("text"), F.lit(length)))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # Of n grams in a window about 2 in n + 1 are the least of some window.
    buckets = max(parts, int(size * 2 / (length - GRAM + 2) * ANCHOR.itemsize) // ANCHOR_BYTES + 1)
    shared = stored(shared_segments(anchors(source, length, buckets), buckets), "repeat-anchors")
    total = shared.agg(F.sum(F.octet_length("segments"))).first()[0] or 0
    shards = max(parts, total // SEGMENT.itemsize * (length + (length - GRAM) // 2) // SEGMENT_BYTES + 1)
    cut = stored(cut_out(source.join(shared, "k1").select("k1", "k2", "text", "segments"), length, shards), "repeat-segments")
    starts = stored(starts_of(cut.filter("shard IS NOT NULL").select("shard", "contents", "size"), length, parts, CROWDED_BYTES), "repeat-runs")
    places = cut.filter("k1 IS NOT NULL").select("k1", "k2", F.explode("occurrences").alias("o")).select("k1", "k2", "o.start", "o.content")
    covered = places.join(starts, "content").select("k1", "k2", F.struct((F.col("start") + F.col("first")).alias("a"), (F.col("start") + F.col("last") + length).alias("b")).alias("span"), F.lit(False).alias("copied"))
    copied = source.groupBy("k1", "k2").agg(F.count("*").alias("n")).filter("n > 1")
    none = F.lit(None).cast("struct<a: int, b: int>")
    known = covered.unionAll(copied.select("k1", "k2", none.alias("span"), F.lit(True).alias("copied")))
    by_text = known.groupBy("k1", "k2").agg(F.collect_list("span").alias("spans"), F.max("copied").alias("copied"))
    rows = source.join(by_text, ["k1", "k2"], "left").select("doc_id", "text", "spans", "copied")
    return rows


def cleaned(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans, kept`` of every row: the covered runs of bytes, and the bytes that are left, joined."""
    return _finished(find(docs, length, id_col, text_col), length, digest=False)


def digests(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of every row."""
    return _finished(find(docs, length, id_col, text_col), length, digest=True)


def _finished(found: DataFrame, length: int, digest: bool) -> DataFrame:
    fields = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())] if digest else [("spans", T.ArrayType(T.ArrayType(T.LongType()))), ("kept", T.BinaryType())]
    schema = T.StructType([column_field(found, "doc_id"), *[T.StructField(n, t) for n, t in fields]])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                out = []
                for text, spans, copied in zip(*(part.column(c).to_pylist() for c in ("text", "spans", "copied"))):
                    raw = text.encode("utf-8", "replace") if text else b""
                    own = [(0, len(raw))] if copied and len(raw) >= length else merged([(s["a"], s["b"]) for s in spans or []])
                    kept = b"".join(raw[a:b] for a, b in zip([0, *[b for _, b in own]], [*[a for a, _ in own], len(raw)]))
                    out.append((len(raw), len(raw) - len(kept), len(own), hashlib.sha256(kept).hexdigest()) if digest else ([list(s) for s in own], kept))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] if digest else [pa.list_(pa.list_(pa.int64())), pa.binary()]
                columns = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=schema.names)

    return found.mapInArrow(run, schema)
