"""CSV records with line breaks inside quotes, read by many tasks, and the encoding of text files.

A line break ends a record where the number of quotes before it is even. A first pass counts quotes, and lines that are not
UTF-8, in each byte range of a file. The counts of the ranges before it tell whether a range begins inside quotes, so the
second pass cuts all ranges into records at the same time. A record that goes on beyond its range is put together from the
pieces of both, of which a range has two at most.
"""

from __future__ import annotations

import codecs
import csv
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.kinds import quoted
from plumbline.session import stored

UTF8, SINGLE_BYTE = "utf-8", "iso-8859-1"


def _lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The bytes of every line with its file and the start of its byte range."""
    rows = spark.read.option("lineSep", "\n").text(path)
    return rows.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def ranges(spark: SparkSession, path: str | Sequence[str], quote: str = '"') -> DataFrame:
    """``file, start, quotes, valid, inside``: byte ranges, their quotes, whether all their lines are UTF-8, and whether they begin inside quotes."""
    quotes = F.octet_length("value") - F.octet_length(F.replace(F.col("value"), F.lit(quote), F.lit("")))
    found = _lines(spark, path).groupBy("file", "start").agg(F.sum(quotes).alias("quotes"), F.every(F.is_valid_utf8("value")).alias("valid"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return stored(found.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1), "csv-ranges")


def encoding_of(known: DataFrame) -> str:
    """UTF-8 where all lines of all ranges are, otherwise the single-byte encoding in which every byte is a character."""
    return UTF8 if known.agg(F.every("valid")).first()[0] in (True, None) else SINGLE_BYTE


def detect_encoding(spark: SparkSession, path: str | Sequence[str]) -> str:
    """The encoding of text files, from all of their lines."""
    valid = _lines(spark, path).agg(F.every(F.is_valid_utf8("value"))).first()[0]
    return UTF8 if valid in (True, None) else SINGLE_BYTE


# Whole records, ends of a record of an earlier range, records left open, and the first record of a file.
WHOLE, HEAD, OPEN, FIRST = 0, 1, 2, 3


def _cut(quote: bytes):
    """Lines of byte ranges to pieces: whole records, what belongs to a record of an earlier range, and a record left open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, carry, inside, fresh, begins = None, [], False, True, False

        def piece(kind: int) -> pa.RecordBatch:
            return _pieces([b"\n".join(carry)], [kind], at)

        for batch in batches:
            files, starts = batch.column("file"), batch.column("start").to_numpy()
            codes = pc.dictionary_encode(files).indices.to_numpy()
            edges = np.flatnonzero((np.diff(starts) != 0) | (np.diff(codes) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if a == b:
                    continue
                here = (files[a].as_py(), int(starts[a]))
                if here != at:
                    if carry:
                        yield piece(HEAD if fresh else OPEN)
                    at, carry, inside, begins = here, [], batch.column("inside")[a].as_py(), here[1] == 0
                    fresh = inside
                lines = batch.column("value").slice(a, b - a)
                odd = pc.count_substring(lines, quote).to_numpy(zero_copy_only=False) % 2
                after = (np.cumsum(odd) + inside) % 2
                ends = np.flatnonzero(after == 0)
                if not len(ends):
                    carry += lines.to_pylist()
                    inside = bool(after[-1])
                    continue
                # The first record may have begun before; the others lie between two ends.
                first = b"\n".join([*carry, *lines.slice(0, ends[0] + 1).to_pylist()])
                yield _pieces([first], [HEAD if fresh else FIRST if begins else WHOLE], at)
                fresh = begins = False
                if len(ends) > 1:
                    offsets = pa.array(np.r_[ends + 1].astype(np.int32))
                    whole = pc.binary_join(pa.ListArray.from_arrays(offsets, lines), b"\n")
                    yield _pieces(whole, [WHOLE] * len(whole), at)
                carry, inside = lines.slice(ends[-1] + 1).to_pylist(), bool(after[-1])
        if carry:
            yield piece(HEAD if fresh else OPEN)

    return run


def _pieces(texts, kinds: list[int], at: tuple[str, int]) -> pa.RecordBatch:
    values = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.binary())
    return pa.RecordBatch.from_arrays(
        [values, pa.array(kinds, pa.int32()), pa.array([at[0]] * len(kinds), pa.string()), pa.array([at[1]] * len(kinds), pa.int64())], names=["value", "kind", "file", "start"]
    )


def csv_records(spark: SparkSession, path: str | Sequence[str], known: DataFrame, quote: str = '"') -> DataFrame:
    """``value, first``: the bytes of every record of CSV files, and whether it is the first of its file.

    ``known`` are the :func:`ranges` of the files. They are broadcast: there is one row for each range of
    ``spark.sql.files.maxPartitionBytes``, and lines have to stay in their order.
    """
    lines = _lines(spark, path).join(F.broadcast(known.select("file", "start", "inside")), ["file", "start"])
    lines = lines.select(F.col("value").cast("binary").alias("value"), "file", "start", "inside")
    # Stored, as pieces of records are put together from what another range has left.
    pieces = stored(lines.mapInArrow(_cut(quote.encode()), "value binary, kind int, file string, start bigint"), "csv-pieces")
    whole = pieces.filter(F.col("kind").isin(WHOLE, FIRST)).select("value", (F.col("kind") == FIRST).alias("first"))
    # An open record goes on with the heads of the ranges after it, up to the next open one.
    order = Window.partitionBy("file").orderBy("start", "kind")
    named = pieces.filter(F.col("kind").isin(HEAD, OPEN)).withColumn("record", F.sum((F.col("kind") == OPEN).cast("int")).over(order))
    parts = F.sort_array(F.collect_list(F.struct("start", "kind", F.decode("value", SINGLE_BYTE).alias("value"))))
    text = F.array_join(F.transform(parts, lambda p: p["value"]), "\n")
    return whole.unionAll(named.groupBy("file", "record").agg(F.encode(text, SINGLE_BYTE).alias("value")).select("value", F.lit(False)))


def read_records(spark: SparkSession, path: str | Sequence[str], encoding: str | None = None, sep: str = ",") -> DataFrame:
    """CSV files with a header as a table of text; the encoding is found where it is not given.

    Line breaks inside quotes stay in their fields, and files are read by as many tasks as without them.
    """
    known = ranges(spark, path)
    encoding = encoding or encoding_of(known)
    text = F.col("value").cast("string") if codecs.lookup(encoding).name == "utf-8" else F.decode("value", encoding)
    # The mark of the byte order is no part of the first name, nor is the carriage return of a line end part of a record.
    text = F.regexp_replace(F.regexp_replace(text, "\r$", ""), "^\\uFEFF", "")
    records = csv_records(spark, path, known).select(text.alias("value"), "first")
    head = records.filter("first").first()
    if head is None:
        return spark.createDataFrame([], "")
    names = [name or f"_c{i}" for i, name in enumerate(next(csv.reader([head["value"]], delimiter=sep), [""]))]
    schema = ", ".join(f"{quoted(n)} string" for n in names)
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    rows = records.filter("NOT first AND value <> ''").select(F.from_csv("value", schema, options).alias("row"))
    return rows.select("row.*")
