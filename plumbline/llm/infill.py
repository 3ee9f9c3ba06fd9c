"""Fill-in-the-middle: texts are cut in three and put together again with markers in front of each part.

A text stays UTF-8 bytes. A sparse index lists only its characters of more than one byte: where each lies, counted in
characters and in bytes, and how many bytes beyond the first all characters so far take. A cut is changed from
characters to bytes, or back, by a binary search in that list; between its entries the two differ by a constant. Text in
ASCII has an empty list and costs nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import narrowed, slices

PLAIN, PSM, SPM = "plain", "psm", "spm"
UNITS = ("lines", "chars")


class Markers(NamedTuple):
    """The strings in front of prefix, suffix and middle."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Wide(NamedTuple):
    """The characters of more than one byte: their first bytes, and the bytes beyond the first up to each, itself included."""

    first_bytes: np.ndarray
    places: np.ndarray
    excess: np.ndarray


def index(data: np.ndarray) -> Wide:
    """The sparse index of one text; ``data`` are its bytes."""
    first_bytes = np.flatnonzero(data >= 0xC0)
    lead = data[first_bytes]
    excess = np.cumsum(1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0))
    return Wide(first_bytes, first_bytes - np.r_[0, excess[:-1]] if len(excess) else first_bytes, excess)


def _before(wide: Wide, k: int) -> int:
    return int(wide.excess[k - 1]) if k else 0


def to_bytes(wide: Wide, chars: int) -> int:
    """The byte at which a character begins; the number of all characters gives the length in bytes."""
    return chars + _before(wide, int(np.searchsorted(wide.places, chars)))


def to_chars(wide: Wide, at: int) -> int:
    """The number of characters before a byte that begins one, or before the end."""
    return at - _before(wide, int(np.searchsorted(wide.first_bytes, at)))


def cuts(data: np.ndarray, wide: Wide, unit: str, first: int, second: int) -> tuple[int, tuple[int, int] | None]:
    """The number of units of a text, and the bytes that end its prefix and its middle.

    ``first`` and ``second`` are any numbers; their remainders say after how many units the text is cut.
    """
    if unit == "chars":
        n = to_chars(wide, len(data))
        low, high = sorted((first % (n + 1), second % (n + 1)))
        return n, (to_bytes(wide, low), to_bytes(wide, high))
    ends = np.flatnonzero(data == 10) + 1
    n = len(ends) + (len(data) > (int(ends[-1]) if len(ends) else 0))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    place = lambda k: 0 if k == 0 else int(ends[k - 1]) if k <= len(ends) else len(data)
    return n, (place(low), place(high))


def arranged(prefix: bytes, middle: bytes, suffix: bytes, form: str, markers: Markers = Markers()) -> bytes:
    """The three parts in the order of ``form``, each behind its marker."""
    p, s, m = (x.encode() for x in markers)
    if form == PSM:
        return b"".join((p, prefix, s, suffix, m, middle))
    return b"".join((s, suffix, p, prefix, m, middle))


def restored(output: bytes, form: str, markers: Markers = Markers()) -> bytes:
    """The text that was arranged, from nothing but the output and its form."""
    if form == PLAIN:
        return output
    p, s, m = (x.encode() for x in markers)
    one, two = (p, s) if form == PSM else (s, p)
    first, rest = output[len(one) :].split(two, 1)
    second, middle = rest.split(m, 1)
    return b"".join((first, middle, second) if form == PSM else (second, middle, first))


def checked(markers: Markers) -> Markers:
    """Markers that can't arise where a part of the text meets one: ``<`` and ``>`` only at their ends."""
    if len(set(markers)) < 3 or any(len(m) < 3 or m[0] != "<" or m[-1] != ">" or set("<>") & set(m[1:-1]) for m in markers):
        raise ValueError("markers are three different texts in angle brackets")
    return Markers(*markers)


def _arrange(text: bytes, numbers: list[int], unit: str, rate: int, spm: int, markers: Markers) -> tuple:
    """Units, form, bytes of the output, characters of prefix and middle (None if plain)."""
    data = np.frombuffer(text, np.uint8)
    wide = index(data)
    n, (low, high) = cuts(data, wide, unit, numbers[0], numbers[1])
    if not text or numbers[2] % 100 >= rate or any(m.encode() in text for m in markers):
        return n, PLAIN, text, None, None
    form = SPM if numbers[3] % 100 < spm else PSM
    first = to_chars(wide, low)
    return n, form, arranged(text[:low], text[low:high], text[high:], form, markers), first, to_chars(wide, high) - first


def transform(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "lines", rate: int = 100, spm: int = 50, seed: int = 7, markers: Markers = Markers(), digests: bool = False
) -> DataFrame:
    """Per row ``doc_id, n, form, prefix_chars, middle_chars`` and ``output``, the arranged text.

    A text is cut after whole lines (a line keeps its line feed) or after any characters. Where it is cut and which form it
    takes follows from ``seed`` and the row's id alone (a null id counts as an empty one), so reruns agree and rows of one
    id are cut by the same numbers. Of hundred texts ``rate`` are arranged, and ``spm`` of those with the suffix in front.
    Empty and null texts (null counts as empty, ``n`` is 0) and texts that contain a marker stay plain: their output is the
    text and both counts are null. ``digests`` gives ``output_sha256`` and ``restored_sha256`` in place of the output, the
    latter of the text rebuilt from output and form. Whole texts count, one row in gives one row out, nothing is shuffled,
    and a task holds about a megabyte of text, or one text, at a time.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {UNITS}")
    markers = checked(markers)
    rows = narrowed(docs, doc_id=id_col, text=text_col).select(
        "doc_id", F.col("text").cast("string").alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("hash")
    )
    kind = rows.schema["doc_id"].dataType.simpleString()
    last = "output_sha256 string, restored_sha256 string" if digests else "output string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n", "form", "prefix_chars", "middle_chars"] + (["output_sha256", "restored_sha256"] if digests else ["output"])
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64()] + ([pa.string()] * (2 if digests else 1))
        for batch in batches:
            for part in slices(batch):
                out = []
                texts = part.column("text").cast(pa.binary())
                for text, digest in zip(texts, part.column("hash").to_pylist()):
                    numbers = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
                    n, form, output, first, middle = _arrange(text.as_py() or b"", numbers, unit, rate, spm, markers)
                    shown = (hashlib.sha256(output).hexdigest(), hashlib.sha256(restored(output, form, markers)).hexdigest()) if digests else (output.decode(),)
                    out.append((n, form, first, middle, *shown))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], names=["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, {last}")
