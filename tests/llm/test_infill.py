import hashlib
import random
import re

import numpy as np
import pytest
from edges import by_row, edge_texts, table
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import infill


def brute(doc_id, text, units=r"[^\n]*\n|[^\n]+", rate=100, spm=50):
    text = text or ""
    u = re.findall(units, text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(u), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ROWS = edge_texts() + [
    (40 + k, t) for k, t in enumerate(["a\nb\nc", "a\nb\n", "\n", "\n\n\n", "é\n漢字 x\n𝔘𝔫𝔦 y\n", "<P>\nx", "a<S", "<\nS>\n<\n", "x <M> y\nz", "<P\n>\nS>", "\r\n a\x00b\n", "漢\n" * 500, "last line has no end\n𝔘"])
]


def test_lines_are_cut_and_put_together_as_by_plain_python(spark):
    out = infill.transform(table(spark, ROWS))
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert by_row(out, *names) == sorted(((i, *brute(i, t)) for i, t in ROWS), key=repr)
    assert infill.transform(table(spark, [])).count() == 0
    forms = {r["form"] for r in out.collect()}
    assert forms == {"plain", "psm", "spm"}


def test_digests_are_those_of_output_and_text(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = infill.transform(table(spark, ROWS), digests=True)
    assert by_row(out, "doc_id", "output_sha256", "restored_sha256") == sorted(((i, sha(brute(i, t)[4]), sha(t or "")) for i, t in ROWS), key=repr)


def test_characters_and_shares(spark):
    out = infill.transform(table(spark, ROWS), unit="chars", rate=60, spm=30)
    names = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output")
    assert by_row(out, *names) == sorted(((i, *brute(i, t, r"(?s:.)", 60, 30)) for i, t in ROWS), key=repr)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_places_convert_both_ways(text):
    data = np.frombuffer(text.encode(), np.uint8)
    wide = infill.index(data)
    assert len(wide.places) == sum(ord(c) > 127 for c in text)
    for k in range(len(text) + 1):
        at = len(text[:k].encode())
        assert infill.to_bytes(wide, k) == at and infill.to_chars(wide, at) == k


def test_any_text_without_markers_comes_back():
    rng = random.Random(5)
    for _ in range(2000):
        parts = ["".join(rng.choice("<PSM> \n") for _ in range(rng.randint(0, 6))) for _ in range(3)]
        text = "".join(parts)
        if any(m in text for m in infill.Markers()):
            continue
        for form in (infill.PSM, infill.SPM):
            assert infill.restored(infill.arranged(*[p.encode() for p in parts], form), form).decode() == text


def test_settings_are_checked(spark):
    with pytest.raises(ValueError):
        infill.transform(table(spark, []), unit="words")
    for markers in (("<P>", "<P>", "<M>"), ("P", "S", "M"), ("<a<>", "<b>", "<c>")):
        with pytest.raises(ValueError):
            infill.transform(table(spark, []), markers=markers)
