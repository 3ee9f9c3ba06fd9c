import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
from edges import by_row, edge_texts, table
from tokenizers import Tokenizer

from plumbline.llm import packing, private, quality, rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_rules(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n = Counter(windows)
    repeated = {p for k, w in enumerate(windows) if n[w] > 1 for p in (k, k + 1, k + 2)}
    failed = len(words) < 50 or 100 * len(repeated) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_rules_count_like_plain_python(spark):
    rows = edge_texts() + [(40, "a b c a b c\n\nx # y\r\nx # y\n x # y\nA B C " * 9), (41, "a a a a"), (42, "a\x0bb\x1fc d a\x0bb\x1fc")]
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert by_row(rules.judged(table(spark, rows)), *names) == sorted(((i, *brute_rules(t)) for i, t in rows), key=repr)
    assert rules.judged(table(spark, [])).count() == 0


def test_rules_name_what_failed_and_keep_good_text(spark):
    good = "the cat of the house and a dog in it was seen on this day with some more plain words that follow each other here "
    text = good + " ".join(f"word{k} is the other{k} of" for k in range(20))
    rows = {r["doc_id"]: r for r in rules.judged(table(spark, [(1, text), (2, text.upper()), (3, " ".join(w + "###" for w in text.split())), (4, "")])).collect()}
    assert rows[1]["kept"] and rows[1]["failed_rules"] == []
    assert rows[2]["failed_rules"] == ["capitals"] and not rows[2]["kept"]
    assert "symbols" in rows[3]["failed_rules"] and rows[4]["failed_rules"][0] == "few_words"


def test_rules_run_without_python(spark):
    plan = rules.judged(table(spark, edge_texts()))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_base(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    def luhn(d):
        return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    tests = {
        "email": (EMAIL, lambda s: True), "ip": (IP, lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (CARD, lambda s: 12 <= len(digits(s)) <= 19 and luhn(digits(s))), "phone": (PHONE, lambda s: 9 <= len(digits(s)) <= 15),
    }
    out = [(m.start(), k, m.end()) for k, (p, ok) in tests.items() for m in p.finditer(text or "") if ok(m[0])]
    return [f"{k}:{a}:{b}" for a, k, b in sorted(out, key=lambda x: (x[0], list(tests).index(x[1])))]


PRIVATE = [
    "mail a.b+c@x-y.example.com, @no.com a@b@c.de x@y z@..", "é 10.0.0.1 999.1.1.1 1.2.3.4.5.6.7.8 0001.02.3.255 1.2.3", "card 4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111",
    "+1 (555) 123-4567 x +12 +1........2 +49 30 1234567890123456", "a@b.c.d@e.f", "4111 1111 1111 1111 10.0.0.1 +1 415 555 2671", "1" * 5000, "a" * 50000, "@" * 300, "+1" + " " * 3000,
]


def test_base_spans_equal_plain_regular_expressions(spark):
    rows = edge_texts() + list(enumerate(PRIVATE, 100))
    found = private.digests(private.detect(table(spark, rows)))
    want = []
    for i, t in rows:
        base = brute_base(t)
        want.append((i, *[sum(s.startswith(k + ":") for s in base) for k in private.BASE_KINDS], hashlib.sha256(",".join(base).encode()).hexdigest()))
    assert by_row(found, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)


def test_method_adds_confirmed_spans_only():
    kinds = lambda t: [s.kind for s in private.find_spans(t)]
    assert kinds("my iban DE89 3704 0044 0532 0130 00") == ["iban"]
    assert kinds("my iban DE89 3704 0044 0532 0130 01") == []
    assert kinds("ssn 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert kinds("call 415-555-2671") == ["local_phone"] and kinds("order 415-555-2671") == []


def test_masking_keeps_rows_and_columns(spark):
    docs = table(spark, edge_texts() + [(100, "a@b.cd, 10.0.0.1!")])
    masked = private.mask(docs)
    assert masked.columns == docs.columns and masked.count() == docs.count()
    assert masked.filter("doc_id = 100").first()["text"] == "[EMAIL], [IP]!"
    assert masked.filter("doc_id = 0").first()["text"] is None


PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_ids_equal_the_tokenizer(spark):
    encode, tokenizer = packing.encoder(PATH), Tokenizer.from_file(PATH)
    tokenizer.encode_special_tokens = True
    odd = ["", " a", "a ", "a  \n b", "\n\nx\ty", "don't x'RE", "½ a² 1_2", "日本語 <|endoftext|>", "a\x85b c", "a\x1cb", "€5 – “q” …", "é" * 300]
    for text in odd + [t or "" for _, t in edge_texts()]:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_special_tokens_have_their_own_ids(spark):
    import zlib

    encode, tokenizer = packing.encoder(PATH, special=True), Tokenizer.from_file(PATH)
    texts = ["x <|endoftext|> y", "<|endoftext|>", "a  <|endoftext|><|endoftext|>\n\n b", "<|endoftext|", "it<|endoftext|>'s", "<|endoftext|> " + " " * 200_000 + "x"]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    want = [(k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for k, ids in enumerate(tokenizer.encode(t, add_special_tokens=False).ids + [2] for t in texts[:5])]
    assert by_row(packing.pack(table(spark, list(enumerate(texts[:5]))), PATH), "doc_id", "length", "ids_crc32") == sorted(want, key=repr)


def test_packing_places_every_piece_without_gaps(spark):
    import zlib

    rows, capacity = edge_texts(), 64
    tokenizer = Tokenizer.from_file(PATH)
    packed = packing.pack(table(spark, rows), PATH, capacity).collect()
    want = Counter()
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in packed) == want
    sequences = {}
    for r in packed:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= capacity
    assert len(sequences) <= 1.02 * sum(r["length"] for r in packed) / capacity + 2
    assert packing.pack(table(spark, []), PATH).count() == 0


def test_pieces_of_one_length_are_ranked_in_buckets_that_grow_with_them(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 10)
    rows = spark.createDataFrame([(k, 7 if k < 150 else 3, k % 40) for k in range(160)], "doc_id long, length long, piece int")
    out = packing.ranked(rows, "length", ["doc_id", "piece"], {7: 150, 3: 10}).collect()
    assert sorted(r["rank"] for r in out if r["length"] == 7) == list(range(150))
    assert sorted(r["rank"] for r in out if r["length"] == 3) == list(range(10))
    assert len({r["bucket"] for r in out if r["length"] == 7}) > 10 and {r["bucket"] for r in out if r["length"] == 3} == {0}


def test_plan_is_no_worse_than_first_fit_decreasing():
    rng = np.random.default_rng(0)
    for capacity in (10, 37, 100):
        for _ in range(20):
            sizes = rng.integers(1, capacity + 1, rng.integers(1, 200)).tolist()
            runs = packing.packing_plan(dict(Counter(sizes)), capacity)
            bins = Counter()
            for size, own in runs.items():
                own = sorted(own)
                for rank in range(sizes.count(size)):
                    first, sequence, _ = max(r for r in own if r[0] <= rank)
                    bins[sequence + rank - first] += size
            assert sum(bins.values()) == sum(sizes) and max(bins.values()) <= capacity
            free = []
            for s in sorted(sizes, reverse=True):
                k = next((k for k, f in enumerate(free) if f >= s), None)
                if k is None:
                    free.append(capacity - s)
                else:
                    free[k] -= s
            assert len(bins) <= len(free) + 1


def test_classifier_tells_held_out_junk_from_prose(spark):
    import random

    from edges import prose

    rng = random.Random(1)
    good = [(k, prose(rng, 80) + ".\n" + prose(rng, 30)) for k in range(160)]
    bad = [(200 + k, " ".join(w + "###" for w in prose(rng, 80).split())) for k in range(60)]
    docs = table(spark, good + bad + [(900, None), (901, ""), (5, good[5][1])])
    labels = spark.createDataFrame([(k, 1, 0) for k in range(80)] + [(200 + k, 0, 0) for k in range(30)] + [(None, 1, 0), (3, None, 0), (4, 0, 0)], "doc_id long, quality int, score int")
    model = quality.fit(docs, labels)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert quality.score(docs, model).count() == docs.count() and all(0 <= s <= 1 for s in scores.values())
    assert np.mean([scores[k] >= 0.3 for k in range(80, 160)]) > 0.95 and np.mean([scores[k] < 0.3 for k in range(230, 260)]) > 0.95
    empty = quality.fit(table(spark, []), labels.limit(0))
    assert {r["score"] for r in quality.score(docs, empty).collect()} == {0.5}


def test_risk_never_rewards_negative_estimates():
    rng = np.random.default_rng(2)
    p, u = rng.normal(1, 1, (50, quality.N_FEATURES)), np.vstack([rng.normal(1, 1, (80, quality.N_FEATURES)), rng.normal(-1, 1, (40, quality.N_FEATURES))])
    model = quality.train(p, u, 2 / 3)
    scores = model.score(u)
    assert scores[:80].mean() > 0.8 and scores[80:].mean() < 0.2
