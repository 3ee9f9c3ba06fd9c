"""Packing documents into sequences: large items are matched in pairs, small ones best-fit the gaps.

Lengths are whole numbers up to the capacity, so the packing depends only on how many pieces have each
length. That histogram has at most ``capacity`` entries at any corpus size; the plan is made from it,
and every piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import column_field, narrowed, slices, stored

#: Pieces of one length that are ranked together.
RANKED = 2_000
#: How the byte-level tokenizer splits a text before it merges bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_of_letter() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: visible Latin-1 stands for itself, the rest follows from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@cache
def encoder(path: str, special: bool = False):
    """A function from a text to its packed ids under a tokenizer file with a byte-level BPE model.

    The ids are those of the `tokenizers` library. With ``special`` its added tokens get their own ids wherever
    a text holds their strings, as by that library's default; without, they are ordinary text.
    Its vocabulary is numbered in the order of the merges, so the merges can be left to `tiktoken`,
    which takes a third of the time.
    """
    import tiktoken
    from tokenizers import Tokenizer

    letters = byte_of_letter()
    with open(path, encoding="utf-8") as file:
        settings = json.load(file)
    vocabulary, added = settings["model"]["vocab"], {t["content"]: t["id"] for t in settings["added_tokens"]}
    if special and any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in settings["added_tokens"]):
        raise ValueError("added tokens that take in what stands beside them are not supported")
    ranks = {bytes(map(letters.__getitem__, token)): n for token, n in vocabulary.items() if all(c in letters for c in token)}
    for token in added:
        ranks.pop(token.encode(), None)
    encoding = tiktoken.Encoding("byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=added if special else {})
    allowed = set(added) if special else set()

    def encode(text: str) -> bytes:
        try:
            return encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=()).astype("<u4").tobytes()
        except ValueError:  # a very long run of white space is too deep for its regular expressions
            tokenizer = Tokenizer.from_file(path)
            tokenizer.encode_special_tokens = not special
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    return encode


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document: ``doc_id, piece, start, length, ids_crc32``.

    A document is its ids and ``end_id``; a null text counts as empty. Only longer documents are cut,
    into pieces of ``capacity`` ids, and what is left over comes first. Repeated rows give repeated pieces.
    """
    source = narrowed(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([
        column_field(source, "doc_id"), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    ])

    def cut(batches):
        encode, end = encoder(tokenizer_path, special=True), np.array([end_id], dtype="<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, at, piece, start, length, crc = batch.column("doc_id"), [], [], [], [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    ids = encode(text or "") + end
                    n = len(ids) // 4
                    for k, stop in enumerate(range(n % capacity or capacity, n + 1, capacity)):
                        at.append(row)
                        piece.append(k)
                        start.append(max(0, stop - capacity) if k else 0)
                        length.append(stop - start[-1])
                        crc.append(zlib.crc32(ids[4 * start[-1] : 4 * stop]))
                yield pa.RecordBatch.from_arrays(
                    [rows.take(pa.array(at, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return source.mapInArrow(cut, schema)


def packing_plan(counts: dict[int, int], capacity: int) -> dict[int, list[tuple[int, int, int]]]:
    """For each length the runs ``(first rank, first sequence, offset)`` of its pieces in the packing.

    Pieces above a third of the capacity share a sequence with at most one other of their kind: the
    longest left is matched with the longest that still fits. Shorter pieces, longest first, go where
    the least room stays free, and open a sequence only where nothing fits. Sequences that are filled
    alike are kept as one group with a count, so the work depends on ``capacity`` alone.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    groups: list[tuple[list[int], int]] = []
    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        b = large[k] if k >= 0 else None
        if b is None or (b == a and left[a] == 1):
            if b is not None and k > 0:
                b = large[k - 1]
            else:
                groups.append(([a], left[a]))
                left[a] = 0
                large.pop()
                continue
        n = left[a] // 2 if a == b else min(left[a], left[b])
        groups.append(([a, b], n))
        left[a] -= n
        left[b] -= n
        large = [x for x in large if left[x]]
    free: dict[int, list[tuple[list[int], int]]] = {}
    gaps: list[int] = []

    def add(items: list[int], n: int) -> None:
        gap = capacity - sum(items)
        if gap not in free:
            free[gap] = []
            insort(gaps, gap)
        free[gap].append((items, n))

    for items, n in groups:
        add(items, n)
    for size in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        n = left[size]
        while n:
            k = bisect_left(gaps, size)
            if k < len(gaps):
                gap = gaps[k]
                items, bins = free[gap].pop()
                if not free[gap]:
                    del free[gap]
                    gaps.pop(k)
            else:
                gap, items, bins = capacity, [], -(-n // (capacity // size))
            each = gap // size
            full = min(bins, n // each)
            if full:
                add(items + [size] * each, full)
            n -= full * each
            if full < bins and n:
                add(items + [size] * n, 1)
                n, full = 0, full + 1
            if full < bins and items:
                add(items, bins - full)
    runs: dict[int, list[tuple[int, int, int]]] = {}
    placed: dict[int, int] = {}
    sequence = 0
    for gap in sorted(free):
        for items, n in free[gap]:
            offset = 0
            for size in items:
                runs.setdefault(size, []).append((placed.get(size, 0), sequence, offset))
                placed[size] = placed.get(size, 0) + n
                offset += size
            sequence += n
    return runs


def ranked(rows: DataFrame, key: str, order: list[str], counts: dict[int, int]) -> DataFrame:
    """``rank``: the place, from 0, of each row among those with its key.

    ``counts`` has the rows of each key. A key is dealt by hashes of ``order`` into buckets of about ``RANKED`` rows, which
    are ordered one by one; so tasks stay alike however many rows have one key.
    """
    dealt = [F.lit(x) for k, n in counts.items() if n > RANKED for x in (k, -(-n // RANKED))]
    buckets = F.coalesce(F.create_map(*dealt)[F.col(key)], F.lit(1)) if dealt else F.lit(1)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), buckets).cast("long"))
    sizes = rows.groupBy(key, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(key, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy(key, "bucket").orderBy(*order)) - 1
    return rows.withColumn("within", within).join(bases, [key, "bucket"]).withColumn("rank", F.col("base") + F.col("within"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of :func:`pieces` with ``sequence_id`` and ``offset``; places in a sequence have no gaps.

    Every piece is placed. Rows that are alike in all columns may swap places, which changes nothing.
    An empty table gives an empty result. Pieces of one length are ranked in buckets whose number grows with theirs. Token ids are stored in no place; a piece is found again by
    its document, start and length.
    """
    cut = stored(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = {size: [np.array(x, dtype=np.int64) for x in zip(*sorted(runs))] for size, runs in packing_plan(counts, capacity).items()}
    rows = ranked(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], counts)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    schema = T.StructType([cut.schema[c] for c in names] + [T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            size = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            order = np.argsort(size, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(size[order])) + 1) if len(order) else []:
                first, begins, offsets = plan[int(size[own[0]])]
                run = np.searchsorted(first, rank[own], "right") - 1
                sequence[own] = begins[run] + rank[own] - first[run]
                offset[own] = offsets[run]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return rows.select(*names, "rank").mapInArrow(place, schema)
