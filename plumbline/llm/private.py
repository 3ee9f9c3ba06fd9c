"""Personal data in texts: patterns propose spans, validators confirm them, context words move the score.

The four base kinds (email, ip, card, phone) keep every proposal that its validator confirms. Further
kinds are added only where the score, made of the kind's own weight, a passed checksum and words nearby,
reaches ``min_score`` and no base span covers the place.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from plumbline.llm.common import column_field, narrowed, whole_rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn", "local_phone")

LOCAL_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, which keeps the scan linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
LOCAL_PHONE = re.compile(r"(?<![0-9(+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[-.\x20])[0-9]{3}[-.\x20][0-9]{4}(?![0-9-])")

CONTEXT = {
    "email": {"email", "mail", "contact", "e-mail"},
    "ip": {"ip", "host", "server", "address"},
    "card": {"card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"},
    "iban": {"iban", "account", "bank", "konto", "compte", "cuenta"},
    "ssn": {"ssn", "social", "security"},
    "local_phone": {"phone", "tel", "call", "mobile", "fax", "contact"},
}
OWN_WEIGHT = {"email": 0.7, "ip": 0.6, "card": 0.5, "phone": 0.5, "iban": 0.5, "ssn": 0.4, "local_phone": 0.4}
CHECKSUM_WEIGHT = 0.3
CONTEXT_WEIGHT = 0.3
CONTEXT_CHARS = 40
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The checksum of payment cards: every second digit from the right doubled, the sum a multiple of ten."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        n = int(digit) * (1 + place % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The checksum of bank accounts: moved by four places and spelt in digits, the rest of 97 is one."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """Leftmost matches: what stands before an ``@`` is the whole run of name characters since the last match."""
    at, last = text.find("@"), 0
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(LOCAL_CHARS))
        found = DOMAIN.match(text, at) if start < at else None
        last = found.end() if found else at + 1
        if found:
            yield start, last
        at = text.find("@", last)


def _base(text: str):
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end, False
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m[0].split(".")):
            yield "ip", m.start(), m.end(), False
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield "card", m.start(), m.end(), True
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end(), False


def _added(text: str):
    for m in IBAN.finditer(text):
        if 15 <= len(plain := m[0].replace(" ", "")) <= 34 and mod97(plain):
            yield "iban", m.start(), m.end(), True
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end(), False
    for m in LOCAL_PHONE.finditer(text):
        yield "local_phone", m.start(), m.end(), False


def _scored(text: str, kind: str, start: int, end: int, checked: bool) -> Span:
    near = text[max(0, start - CONTEXT_CHARS) : start] + " " + text[end : end + CONTEXT_CHARS // 2]
    named = not CONTEXT[kind].isdisjoint(w.lower() for w in WORD.findall(near))
    return Span(kind, start, end, round(min(1.0, OWN_WEIGHT[kind] + CHECKSUM_WEIGHT * checked + CONTEXT_WEIGHT * named), 2))


def find_spans(text: str | None, min_score: float = 0.6) -> list[Span]:
    """Spans of one text by start, then kind; null is an empty text. Base spans may overlap each other."""
    if not text:
        return []
    spans = [_scored(text, *found) for found in _base(text)]
    covered = sorted((s.start, s.end) for s in spans)
    for found in _added(text):
        span = _scored(text, *found)
        if span.score >= min_score and not any(a < span.end and span.start < b for a, b in covered):
            spans.append(span)
            covered.append((span.start, span.end))
    return sorted(spans, key=lambda s: (s.start, KINDS.index(s.kind)))


SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()),
]))


def detect(docs: DataFrame, min_score: float = 0.6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` (kind, start, end, score) of every row; places are in code points, ends exclusive.

    Rows stay as they are, repeated ones too; a null text has no spans. Nothing is shuffled.
    """
    source = narrowed(docs, doc_id=id_col, text=text_col)
    schema = T.StructType([column_field(source, "doc_id"), T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [[s._asdict() for s in find_spans(text, min_score)] for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], names=["doc_id", "spans"])

    return source.mapInArrow(run, schema)


def redact(text: str | None, min_score: float = 0.6) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans count as one, under the first's kind."""
    out, last = [], 0
    for span in find_spans(text, min_score):
        if span.start >= last:
            out += [text[last : span.start], f"[{span.kind.upper()}]"]
        last = max(last, span.end)
    return "".join([*out, text[last:]]) if out else text


def mask(docs: DataFrame, min_score: float = 0.6, text_col: str = "text") -> DataFrame:
    """The same rows and columns with the personal data of the text column replaced; nulls stay null."""
    rows = docs.select(whole_rows(docs).alias("row"))

    def run(batches):
        for batch in batches:
            row = batch.column("row")
            texts = pa.array([redact(t, min_score) for t in row.field(text_col).to_pylist()], row.type.field(text_col).type)
            columns = [texts if f.name == text_col else row.field(f.name) for f in row.type]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(columns, fields=list(row.type))], schema=batch.schema)

    return rows.mapInArrow(run, rows.schema).select("row.*")


def joined(spans: list) -> str:
    return ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in spans)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text, from :func:`detect`."""
    schema = T.StructType([
        found.schema["doc_id"], *[T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS],
        T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType()),
    ])

    def run(batches):
        for batch in batches:
            rows = batch.column("spans").to_pylist()
            base = [[s for s in row if s["kind"] in BASE_KINDS] for row in rows]
            counts = [pa.array([sum(s["kind"] == k for s in row) for row in base], pa.int64()) for k in BASE_KINDS]
            shas = [hashlib.sha256(joined(row).encode()).hexdigest() for row in base]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(shas, pa.string()), pa.array([joined(r) for r in rows], pa.string())], names=schema.names)

    return found.mapInArrow(run, schema)
