"""Finding benchmark passages in documents by winnowing.

Of every run of windows the least k-gram hash is kept, on both sides. A shared span of ``window`` words
holds ``window - k + 1`` k-grams, and the least of them is kept wherever the span stands, so the
fingerprints of document and item must meet in it. Every meeting is extended word by word in both
directions; spans of at least ``window`` words count. An item shorter than that is one window and meets
documents by the hash of all its words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import narrowed, slices, stored, texts_of, whole_rows
from plumbline.llm.words import ALPHANUMERIC, gram_hashes, word_hashes

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
GRAM = 5
#: Benchmark text of one pass over the documents; a larger benchmark is taken in several passes.
BLOCK_BYTES = 64 << 20


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A to Z lower-cased; null has none."""
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def least_of_windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """True where a hash is the least of some run of ``size`` (of all, if there are fewer); ties are all kept."""
    size = min(size, len(hashes))
    if not size:
        return np.zeros(0, bool)
    least = hashes[: len(hashes) - size + 1].copy()
    for k in range(1, size):
        np.minimum(least, hashes[k : k + len(least)], out=least)
    kept = np.zeros(len(hashes), bool)
    for k in range(size):
        kept[k : k + len(least)] |= hashes[k : k + len(least)] == least
    return kept


@dataclass
class Index:
    """Fingerprints of a block of benchmark texts; equal word sequences are one entry with all its item ids."""

    window: int
    sequences: list[list[bytes]] = field(default_factory=list)
    items: list[list[str]] = field(default_factory=list)
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    places: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    short: dict[int, dict[int, int]] = field(default_factory=dict)

    @classmethod
    def build(cls, rows: list[tuple[str, str]], window: int) -> Index:
        index, numbers = cls(window), {}
        for item, text in rows:
            words = tuple(words_of(text))
            if words and (number := numbers.setdefault(words, len(numbers))) == len(index.items):
                index.sequences.append(list(words))
                index.items.append([item])
            elif words:
                index.items[number].append(item)
        index.items = [sorted(set(names)) for names in index.items]
        hashes, places = [], []
        for number, words in enumerate(index.sequences):
            own, _ = word_hashes([b" ".join(words).decode("utf-8", "replace")], ALPHANUMERIC)
            if len(words) < window:
                index.short.setdefault(len(words), {})[int(gram_hashes(own, len(words))[0])] = number
                continue
            grams = gram_hashes(own, GRAM)
            at = np.flatnonzero(least_of_windows(grams, window - GRAM + 1))
            hashes.append(grams[at])
            places.append(np.stack([np.full(len(at), number), at], axis=1))
        if hashes:
            found = np.concatenate(hashes)
            order = np.argsort(found, kind="stable")
            index.hashes, index.places = found[order], np.concatenate(places)[order]
        return index

    def meetings(self, hashes: np.ndarray, counts: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
        """By text: (place in the text, sequence, place in the sequence) of every equal fingerprint."""
        out: dict[int, list[tuple[int, int, int]]] = {}
        ends = np.cumsum(counts)

        def collect(grams: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
            text = np.searchsorted(ends, at, "right")
            return np.stack([text, at - (ends - counts)[text]], axis=1)[at + n <= ends[text]] if len(at) else np.zeros((0, 2), np.int64)

        if len(self.hashes) and len(hashes) >= GRAM:
            grams = gram_hashes(hashes, GRAM)
            # Grams that cross two texts only add windows, and so only add fingerprints.
            at = np.flatnonzero(least_of_windows(grams, self.window - GRAM + 1))
            at = at[self.hashes[np.minimum(np.searchsorted(self.hashes, grams[at]), len(self.hashes) - 1)] == grams[at]]
            for text, place in collect(grams, at, GRAM).tolist():
                gram = grams[ends[text] - counts[text] + place]
                a, b = np.searchsorted(self.hashes, gram, "left"), np.searchsorted(self.hashes, gram, "right")
                out.setdefault(text, []).extend((place, int(s), int(q)) for s, q in self.places[a:b])
        for n, known in self.short.items():
            if len(hashes) >= n:
                grams = gram_hashes(hashes, n)
                at = np.flatnonzero(np.isin(grams, np.array(list(known), np.uint64)))
                for text, place in collect(grams, at, n).tolist():
                    out.setdefault(text, []).append((place, known[int(grams[ends[text] - counts[text] + place])], 0))
        return out

    def spans(self, words: list[bytes], meetings: list[tuple[int, int, int]]) -> set[tuple[int, int, int]]:
        """(sequence, first word, end) of the shared spans; words are compared themselves, not their hashes."""
        out: set[tuple[int, int, int]] = set()
        reach: dict[tuple[int, int], int] = {}
        for p, number, q in sorted(meetings, key=lambda m: m[0]):
            other = self.sequences[number]
            if reach.get((number, p - q), -1) > p:
                continue
            low = 0
            while low < min(p, q) and words[p - low - 1] == other[q - low - 1]:
                low += 1
            high, most = 0, min(len(words) - p, len(other) - q)
            while high < most and words[p + high] == other[q + high]:
                high += 1
            reach[number, p - q] = p + high
            if low + high >= min(self.window, len(other)):
                out.add((number, p - low, p + high))
        return out


HITS = T.ArrayType(T.StructType([T.StructField("item_id", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
ARROW_HITS = pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in lists of at most about ``block_bytes`` of text; items without id or text are left out."""
    rows, size = [], 0
    named = benchmark.select(F.col("item_id").cast("string"), "text").filter("item_id IS NOT NULL AND text IS NOT NULL")
    for item, text in named.distinct().toLocalIterator():
        rows.append((item, text))
        size += len(text)
        if size >= block_bytes:
            yield rows
            rows, size = [], 0
    yield rows


def _scan(rows: DataFrame, index: Index, text_col: str) -> DataFrame:
    """``rows``, whose last columns are n_words, n_hit and hits, with the hits of one block of items added."""
    names = rows.columns
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        own = shared.value
        for batch in batches:
            for part in slices(batch, text_col):
                texts = texts_of(part, text_col).to_pylist()
                hashes, counts = word_hashes(texts, ALPHANUMERIC)
                hits = part.column(part.num_columns - 1).to_pylist()
                n_hit = part.column(part.num_columns - 2).to_pylist()
                for row, met in own.meetings(hashes, counts).items():
                    for number, start, end in sorted(own.spans(words_of(texts[row]), met)):
                        hits[row] = (hits[row] or []) + [{"item_id": item, "start": start, "end": end} for item in own.items[number]]
                    n_hit[row] = covered([(s["start"], s["end"]) for s in hits[row] or []])
                yield pa.RecordBatch.from_arrays([*part.columns[:-3], pa.array(counts.astype(np.int64)), pa.array(n_hit, pa.int64()), pa.array(hits, ARROW_HITS)], names=names)

    return rows.mapInArrow(run, rows.schema)


def find(docs: DataFrame, benchmark: DataFrame, window: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES, keep: bool = False) -> DataFrame:
    """``doc_id, text`` (with ``keep`` the whole ``row``) and ``n_words, n_hit, hits`` of every row: the spans of words it shares with benchmark items.

    A span (``item_id, start, end`` in words, end exclusive) is as long as both sides agree and has
    ``window`` words at least, or is a whole shorter item. ``hits`` is empty or null where nothing is
    shared. Null and empty texts have no words; items without id, text or words are never found; an id
    that stands for several texts is found by each of them. Repeated rows are kept. The benchmark is
    broadcast in blocks of ``block_bytes``, so that no block grows with it; each block is one pass.
    """
    if window < GRAM:
        raise ValueError(f"window must be at least {GRAM}")
    source = docs.select(whole_rows(docs).alias("row")) if keep else narrowed(docs, doc_id=id_col, text=text_col)
    rows = source.select("*", F.lit(None).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.lit(None).cast(HITS).alias("hits"))
    for k, block in enumerate(item_blocks(narrowed(benchmark, item_id=item_col, text=item_text_col), block_bytes)):
        rows = _scan(stored(rows, "winnowed") if k else rows, Index.build(block, window), text_col)
    return rows


def covered(spans: list[tuple[int, int]]) -> int:
    """Words inside any of the spans."""
    total = last = 0
    for start, end in sorted(spans):
        total += max(0, end - max(start, last))
        last = max(last, end)
    return total


def marked(found: DataFrame) -> DataFrame:
    """The rows of :func:`find` with ``n_items, items_sha256, contaminated`` in place of the hits.

    ``contaminated``: at least a twentieth of the words, and at least one, stand in shared spans.
    """
    items = F.array_sort(F.array_distinct(F.coalesce(F.transform("hits", lambda h: h["item_id"]), F.array().cast("array<string>"))))
    hit = F.col("n_hit")
    return found.select(
        *[F.col(c) for c in found.columns[:-1]], F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )


def summaries(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from :func:`find`."""
    return marked(found.select("doc_id", "n_words", "n_hit", "hits"))
