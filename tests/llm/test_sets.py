import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
from edges import by_row, edge_texts, prose, table

from plumbline.llm import graph, jaccard, language, repeats, winnowing
from plumbline.llm.signatures import Links, bitmap, linked
from plumbline.llm.suffixes import repeated_starts

VISIBLE = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def roots(n, pairs):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    return [find(k) for k in range(n)]


def brute_join(rows, words, percent):
    sets = []
    for _, t in rows:
        w = VISIBLE.findall((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    group = roots(len(rows), pairs)
    least = {}
    for (i, _), g in zip(rows, group):
        least[g] = min([x for x in (least.get(g), i) if x is not None], default=None)
    return sorted(((i, len(s), i if not s else least[g]) for (i, _), s, g in zip(rows, sets, group)), key=repr)


def variants(seed, groups):
    rng, rows = random.Random(seed), []
    for _ in range(groups):
        words = prose(rng, rng.choice([3, 8, 40, 200])).split()
        for _ in range(rng.randint(1, 6)):
            own = words.copy()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = prose(rng, 1)
            rows.append((1000 + len(rows), " ".join(own)))
    return rows


def test_join_equals_all_pairs(spark):
    rows = edge_texts() + variants(4, 25)
    docs = table(spark, rows)
    for words, percent, block in ((4, 85, 1000), (3, 60, 3)):
        got = by_row(jaccard.join(docs, words, percent, block=block), "doc_id", "n_shingles", "component_id")
        assert got == brute_join(rows, words, percent)


def test_join_below_a_half_compares_sets_of_all_widths(spark):
    rng = random.Random(21)
    long = prose(rng, 400).split()
    rows = [(k, " ".join(long[:n])) for k, n in enumerate((35, 68, 130, 260, 400))] + [(9, prose(rng, 30))]
    for percent in (40, 20):
        got = by_row(jaccard.join(table(spark, rows), 4, percent), "doc_id", "n_shingles", "component_id")
        assert got == brute_join(rows, 4, percent) and len({g for _, _, g in got}) == 2


def test_no_list_is_compared_in_one_task_above_a_block(spark, monkeypatch, tmp_path):
    rng = random.Random(12)
    base = prose(rng, 120).split()
    rows = []
    for k in range(90):
        own = base.copy()
        own[60 + k % 50] = f"own{k}"
        rows.append((k, " ".join(own if k % 9 else own[:40] + prose(rng, 70).split())))
    def counted(bitmaps, sizes, percent, accept=None, *rest):
        if accept is None:
            with open(f"{tmp_path}/{os.getpid()}", "a") as file:
                file.write(f"{len(sizes)}\n")
        return linked(bitmaps, sizes, percent, accept, *rest)

    monkeypatch.setattr(jaccard, "linked", counted)
    got = by_row(jaccard.join(table(spark, rows), 4, 85, block=10), "doc_id", "n_shingles", "component_id")
    assert got == brute_join(rows, 4, 85)
    assert 10 < max(int(n) for f in tmp_path.iterdir() for n in f.read_text().split()) < 50


def test_a_chain_of_links_rewrites_labels_seldom():
    result = Links(3000, 85)
    writes = []
    refresh = result._refresh
    result._refresh = lambda: writes.append(1) or refresh()
    result._settle(np.arange(2999), np.arange(1, 3000))
    result._refresh()
    assert not result.labels.any() and len(writes) == 1 and len(result.edges) == 2999


def test_join_of_an_empty_table(spark):
    assert jaccard.join(table(spark, [])).count() == 0


def test_trees_lose_no_link():
    rng = np.random.default_rng(3)
    for _ in range(15):
        sets = []
        for _ in range(rng.integers(1, 20)):
            base = np.unique(rng.integers(0, 2**63, rng.integers(1, 150), dtype=np.uint64))
            for _ in range(rng.integers(1, 10)):
                own = base.copy()
                m = rng.integers(0, len(own) // 6 + 1)
                own[rng.choice(len(own), m, replace=False)] = rng.integers(0, 2**63, m, dtype=np.uint64)
                sets.append(np.unique(own))
        accept = lambda i, j: jaccard.links(sets[i], sets[j], 85)
        found = linked([bitmap(s) for s in sets], np.array([len(s) for s in sets]), 85, accept)
        assert found.labels.tolist() == roots(len(sets), [(a, b) for a in range(len(sets)) for b in range(a) if accept(a, b)])


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = dict(by_row(graph.components(spark.createDataFrame(edges, "a long, b long")), "id", "component"))
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 140)} | {200: 200, 201: 200}


def test_suffixes_find_all_repeats():
    rng = np.random.default_rng(1)
    for _ in range(40):
        length, letters = int(rng.choice([8, 16, 24])), int(rng.integers(1, 4))
        base = bytes(rng.integers(97, 97 + letters, 120, dtype=np.uint8))
        strings = []
        for _ in range(rng.integers(1, 10)):
            a = int(rng.integers(0, 80))
            strings.append(base[a : a + int(rng.integers(0, 60))] if rng.random() < 0.5 else bytes(rng.integers(97, 97 + letters, rng.integers(0, 70), dtype=np.uint8)))
        n = Counter(s[i : i + length] for s in strings for i in range(len(s) - length + 1))
        for s, got in zip(strings, repeated_starts(strings, length)):
            assert got.tolist() == [i + length <= len(s) and n[s[i : i + length]] > 1 for i in range(len(s))]


def brute_repeats(rows, length):
    data = [(t or "").encode() for _, t in rows]
    n = Counter(b[k : k + length] for b in data for k in range(len(b) - length + 1))
    out = []
    for (i, _), b in zip(rows, data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if n[b[k : k + length]] > 1:
                gone[k : k + length] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_repeats_equal_brute_force(spark):
    rng = random.Random(8)
    passage = prose(rng, 60)
    rows = edge_texts() + [(50 + k, prose(rng, 40) + passage[k * 7 : k * 7 + 230] + prose(rng, 30)) for k in range(6)] + [(60, "é" * 150 + prose(rng, 9) + "é" * 150), (61, prose(rng, 50) * 3)]
    got = repeats.digests(table(spark, rows))
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 200)
    assert repeats.digests(table(spark, [])).count() == 0


def test_segments_of_a_common_passage_do_not_meet_in_one_task(spark, monkeypatch):
    rng = random.Random(9)
    passage = prose(rng, 70)[:300]
    rows = [(k, prose(rng, 40) + passage + prose(rng, 40)) for k in range(120)] + [(200, passage), (201, prose(rng, 9) + passage[:150] + prose(rng, 40)), (202, "é" * 300)] + edge_texts()
    whole, most = repeats.repeated_runs, []

    def recorded(packed, length):
        sizes = Counter()
        for r in packed.collect():
            sizes[r["shard"]] += sum(len(c) for _, c, _ in repeats.unpacked(r["contents"]))
        most.append(max(sizes.values(), default=0))
        return whole(packed, length)

    monkeypatch.setattr(repeats, "repeated_runs", recorded)
    for bound in (8000, 0):
        monkeypatch.setattr(repeats, "CROWDED_BYTES", bound, raising=False)
        got = repeats.digests(table(spark, rows))
        assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_repeats(rows, 200)
        assert most.pop() <= bound


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_decontaminate(rows, items):
    words = lambda t: WORDS.findall((t or "").translate(LOWER))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if n and item is not None else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(item))
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if own := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def test_winnowing_equals_all_windows(spark):
    rng = random.Random(9)
    texts = [prose(rng, n) for n in (1, 2, 5, 12, 13, 14, 40, 200)] + ["ab " * 30]
    items = list(enumerate(texts)) + [(3, texts[6]), (70, texts[6]), (71, None), (None, texts[5]), (72, "!!"), (5, texts[5])]
    rows = edge_texts()
    for k in range(40):
        own, other = texts[rng.randrange(len(texts))].split(), prose(rng, rng.randint(0, 30)).split()
        a = rng.randrange(len(own))
        rows.append((100 + k, " ".join(other + own[a : a + rng.randint(1, 30)] + other[::-1]).title() + "."))
    benchmark = spark.createDataFrame([(*x, "t", 1) for x in items], "item_id long, text string, hits string, n_words int")
    docs = table(spark, rows)
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    want = brute_decontaminate(rows, items)
    assert by_row(winnowing.summaries(winnowing.find(docs, benchmark)), *names) == want
    assert by_row(winnowing.summaries(winnowing.find(docs, benchmark, block_bytes=100)), *names) == want
    assert winnowing.find(table(spark, []), benchmark).count() == 0
    assert winnowing.summaries(winnowing.find(docs, benchmark.limit(0))).filter("n_hit > 0").count() == 0


def brute_bits(taught, text):
    contexts = {}
    for t in taught:
        data = b"\0\0\0" + t.encode()
        for i in range(3, len(data)):
            for o in range(4):
                contexts.setdefault(data[i - o : i], Counter())[data[i]] += 1
    data, bits = b"\0\0\0" + text.encode(), 0.0
    for i in range(3, len(data)):
        for o in (3, 2, 1, 0, -1):
            if o < 0:
                bits += 8
                break
            c = contexts.get(data[i - o : i])
            if c:
                total = sum(c.values()) + len(c)
                if data[i] in c:
                    bits -= math.log2(c[data[i]] / total)
                    break
                bits -= math.log2(len(c) / total)
    return bits


def test_code_lengths_equal_context_trees(spark):
    taught = {"en": ["the cat sat on the mat and the dog", "a dog and a cat"], "de": ["der hund und die katze sind hier", "ein hund"]}
    rows = [(k, t, lang) for k, (lang, t) in enumerate((lang, t) for lang, ts in taught.items() for t in ts)] + [(90, None, "en"), (91, "not taught", None), (92, "", "de")]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, lang string, score string")
    model = language.fit(docs)
    texts = ["the dog und", "zzzé 漢", "hund", "x", "katze " * 500]
    asked = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, None, "", "12 !?"])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(asked, model).collect()}
    for k, text in enumerate(texts):
        bits = {lang: brute_bits(ts, text) for lang, ts in taught.items()}
        best = min(bits, key=bits.get)
        assert got[k]["lang_pred"] == best and abs(got[k]["bits_per_byte"] * len(text.encode()) - bits[best]) < 0.02 * len(text.encode())
        assert abs(got[k]["score"] - 1 / sum(2.0 ** -min(1000, b - bits[best]) for b in bits.values())) < 0.05
    assert [got[k]["lang_pred"] for k in (5, 6, 7)] == ["und"] * 3 and got[5]["score"] == 0
    nothing = language.fit(docs.limit(0))
    assert {r["lang_pred"] for r in language.predict(asked, nothing).collect()} == {"und"}
    assert language.predict(table(spark, edge_texts()), model, keep=True).count() == len(edge_texts())
