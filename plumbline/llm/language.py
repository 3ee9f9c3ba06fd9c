"""Language identification by prediction by partial matching under frozen statistics.

Each language has a tree of byte contexts of up to three bytes with the counts of the byte that followed.
A text's code length under a language adds, byte by byte, what the longest known context charges; a byte
it has not seen costs an escape and is charged by the next shorter context (escape method C), down to a
uniform charge over all 256 bytes. The language with the shortest code wins.

The counts of all languages are turned into one table of charges, ``(context, byte) -> bits by language``,
so that scoring a text is two table look-ups a byte, whatever the number of languages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import narrowed, slices, texts_of, whole_rows

ORDER = 3
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"
#: Charges are kept as whole 1/64 bits.
UNIT = 64


@dataclass
class Model:
    """Frozen statistics; ``second`` and ``third`` number the known contexts of two and three bytes."""

    languages: list[str]
    first: np.ndarray
    second: np.ndarray
    third: np.ndarray
    symbols: np.ndarray
    charges: np.ndarray

    def code_lengths(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Bits of each text by language; ``data`` holds the texts one after the other, each led by ORDER zero bytes."""
        pair = self.second[data[:-3].astype(np.int32) * 256 + data[1:-2]]
        context = self.third[pair * 256 + data[2:-1]]
        bits = self.charges[context.astype(np.int64) * (int(self.symbols.max()) + 1) + self.symbols[data[3:]]]
        total = np.zeros((len(ends), len(self.languages)), np.int64)
        begins = np.r_[0, ends[:-1]]
        own = ends - begins - ORDER
        some = own > 0
        if some.any():
            # Positions that belong to the leading zeros of the next text are cut out by the ends of each range.
            edges = np.stack([begins[some], begins[some] + own[some]], axis=1).ravel()
            edges[-1] = min(edges[-1], len(bits))
            sums = np.add.reduceat(bits, edges[:-1] if edges[-1] == len(bits) else edges, axis=0, dtype=np.int64)
            total[some] = sums[::2]
        return total / UNIT


def context_counts(docs: DataFrame) -> DataFrame:
    """``lang, gram, n``: how often each context of three bytes with its next byte occurs, packed in a number."""
    schema = "lang string, gram long, n long"

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                langs = np.array(part.column("lang").to_pylist(), dtype=object)
                texts = part.column("text").to_pylist()
                for lang in dict.fromkeys(langs):
                    data = np.frombuffer(b"".join(b"\0" * ORDER + t.encode("utf-8", "replace") for t, l in zip(texts, langs) if l == lang), np.uint8).astype(np.int64)
                    if len(data) <= ORDER:
                        continue
                    grams, n = np.unique((data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:], return_counts=True)
                    # A zero byte that follows is the lead of the next text.
                    seen = (grams & 255) > 0
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * int(seen.sum()), pa.string()), pa.array(grams[seen]), pa.array(n[seen])], names=["lang", "gram", "n"])

    return docs.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def training_rows(docs: DataFrame, docs_per_language: int, max_languages: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """At most about ``docs_per_language`` rows of each language, chosen by a hash of the id and the text."""
    rows = narrowed(docs, doc_id=id_col, text=text_col, lang=lang_col).filter("text IS NOT NULL AND lang IS NOT NULL")
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).limit(max_languages + 1).collect()
    if len(counts) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003))
    chosen = F.lit(False)
    for lang, n in sorted(counts):
        chosen |= (F.col("lang") == lang) & (drawn < int(min(1.0, docs_per_language / n) * 1_000_003))
    return rows.filter(chosen).select("lang", "text")


def fit(docs: DataFrame, docs_per_language: int = 400, max_languages: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Count contexts over a bounded sample of labelled rows and freeze the charges.

    The sample is bounded by ``docs_per_language`` whole texts of each language; more than
    ``max_languages`` languages are refused. Rows without text or language teach nothing. A table
    without any teaching row gives a model without languages.
    """
    rows = context_counts(training_rows(docs, docs_per_language, max_languages, id_col, text_col, lang_col))
    table = rows.toPandas()
    return freeze(sorted(table["lang"].unique()), table["lang"].to_numpy(), table["gram"].to_numpy(np.int64), table["n"].to_numpy(np.int64))


def freeze(languages: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray) -> Model:
    """Charges of every known context for every byte, by language."""
    if not languages:
        return Model([], np.zeros(0), np.zeros(65536, np.int32), np.zeros(256, np.int32), np.zeros(256, np.uint8), np.zeros((1, 0), np.int32))
    pairs = np.unique(gram >> 16)
    triples = np.unique(gram >> 8)
    heard = np.unique(gram & 255)
    symbols = np.zeros(256, np.int64)
    symbols[heard] = np.arange(1, len(heard) + 1)  # 0 stands for every byte that was never seen
    width = len(heard) + 1
    # Context numbers: 0 none, then last bytes, pairs and triples of bytes.
    last = np.unique(gram >> 8 & 255)
    short = np.unique(gram >> 8 & 65535)
    n_last, n_pair, n_triple = len(last), len(short), len(triples)
    first = np.zeros(256, np.int64)
    first[last] = np.arange(1, n_last + 1)
    two = np.zeros(65536, np.int64)
    two[:] = np.tile(first, 256)
    two[short] = 1 + n_last + np.arange(n_pair)
    # The first two bytes of a triple pick a row, its last byte the context.
    second = np.zeros(65536, np.int32)
    second[pairs] = np.arange(1, len(pairs) + 1)
    third = two.reshape(256, 256)  # by the last two bytes
    rows = np.zeros((len(pairs) + 1, 256), np.int32)
    rows[0] = first
    rows[1:] = third[pairs & 255]
    rows[second[triples >> 8], triples & 255] = 1 + n_last + n_pair + np.arange(n_triple)
    # Pairs that were never seen before a byte fall back to the last two bytes through their own row.
    unseen = np.setdiff1d(np.arange(65536), pairs)
    seconds = np.unique(unseen & 255)
    extra = np.zeros(256, np.int32)
    extra[seconds] = len(pairs) + 1 + np.arange(len(seconds))
    rows = np.vstack([rows, third[seconds].astype(np.int32)])
    second[unseen] = extra[unseen & 255]
    charges = np.empty((1 + n_last + n_pair + n_triple, width, len(languages)), np.float32)
    for k, name in enumerate(languages):
        own = lang == name
        charges[:, :, k] = _charges(gram[own], n[own], symbols, width, first, two, last, short, triples)
    scaled = np.minimum(np.rint(charges * UNIT), 32_000).astype(np.int16)
    return Model(languages, first, second, rows.ravel(), symbols, scaled.reshape(-1, len(languages)))


def _charges(gram, n, symbols, width, first, two, last, short, triples) -> np.ndarray:
    """Bits by (context, symbol) for one language; a context it does not know charges like the next shorter one."""
    symbol = symbols[gram & 255]

    def level(keys: np.ndarray, count: int, parent: np.ndarray) -> np.ndarray:
        seen = np.zeros((count, width))
        np.add.at(seen, (keys, symbol), n)
        kinds, total = (seen > 0).sum(1, keepdims=True), seen.sum(1, keepdims=True)
        known = total[:, 0] > 0
        share = np.divide(seen, total + kinds, out=np.zeros_like(seen), where=total > 0)
        escape = np.divide(kinds, total + kinds, out=np.ones_like(total), where=total > 0)
        bits = np.where(share > 0, -np.log2(np.maximum(share, 1e-300)), parent - np.log2(escape))
        return np.where(known[:, None], bits, parent)

    zero = np.zeros(len(gram), np.int64)
    base = level(zero, 1, np.full((1, width), 8.0))
    ones = level(first[gram >> 8 & 255] - 1, len(last), np.repeat(base, len(last), 0))
    twos = level(np.searchsorted(short, gram >> 8 & 65535), len(short), ones[first[short & 255] - 1])
    threes = level(np.searchsorted(triples, gram >> 8), len(triples), twos[np.searchsorted(short, triples & 65535)])
    return np.vstack([base, ones, twos, threes]).astype(np.float32)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """``lang_pred, score, bits_per_byte`` of every row after its ``doc_id`` (with ``keep`` after the whole ``row``).

    ``score`` is the share of the best language if all were equally likely before: 1 divided by the sum of
    ``2 ** -(its code length over the best)``. A null text, or one without any letter, is ``und`` with score 0
    and no bits; so is every text under a model without languages. Rows are neither merged nor dropped.
    """
    source = docs.select(whole_rows(docs).alias("row")) if keep else narrowed(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([source.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    frozen = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = frozen.value
        for batch in batches:
            for part in slices(batch, text_col):
                texts = texts_of(part, text_col).to_pylist()
                coded = [b"\0" * ORDER + t.encode("utf-8", "replace") if own.languages and t and LETTER.search(t) else b"" for t in texts]
                sizes = np.array([max(0, len(c) - ORDER) for c in coded], np.int64)
                ends = np.cumsum([len(c) for c in coded])
                asked = np.flatnonzero(sizes)
                best, score, bpb = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
                if len(asked):
                    bits = own.code_lengths(np.frombuffer(b"".join(coded), np.uint8), ends[asked])
                    won = bits.argmin(1)
                    shortest = bits[np.arange(len(asked)), won]
                    for row, k in zip(asked, won):
                        best[row] = own.languages[k]
                    score[asked] = 1 / np.exp2(-np.minimum(bits - shortest[:, None], 1000)).sum(1)
                    bpb[asked] = shortest / sizes[asked]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.string()), pa.array(score), pa.array(bpb, from_pandas=True)], names=schema.names)

    return source.mapInArrow(run, schema)
