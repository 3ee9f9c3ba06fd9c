import math
import random
import re
from collections import Counter, defaultdict

import pytest

from plumbline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
NAMES = "doc_id long, text string, source string, size long, n int, m int, tilt double, `a.b` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 9, 9, 9, 0.1, "x") for i, t, s in rows], NAMES)


def corpus(seed=2, hot=200):
    rng = random.Random(seed)
    text = lambda n: " ".join(["w"] * n)
    rows = [(k, text(int(rng.lognormvariate(3, 1))), "hot") for k in range(hot)]
    rows += [(1000 + k, text(rng.randint(0, 60)), rng.choice(["b", "c", "é", "z", None, ""])) for k in range(150)]
    rows += [(2000, None, "b"), (2001, "", "none"), (2002, " \t\n", "none"), (2003, text(3000), "c"), (2004, text(7), "one"), (None, text(12), "b"), (None, text(12), "b")]
    rows += [(3000, text(20), "same")] * 9 + [(4000 + k, text(30), "copies") for k in range(40)]
    return rows


def brute_targets(rows, weights=(3, 1, 2), share=1.5, most=2):
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    names = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None] * (None in size)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, full = share * sum(size.values()), set()
    while True:
        level = (total - sum(most * size[s] for s in full)) / max(1, sum(weight[s] for s in names if s not in full))
        above = {s for s in names if s not in full and level * weight[s] >= most * size[s]}
        if not above:
            return size, {s: most * size[s] if s in full else level * weight[s] for s in names}
        full |= above


def test_targets_and_copies(spark):
    rows = corpus()
    size, target = brute_targets(rows)
    found = mixing.mix(frame(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _, _ in rows)
    taken, longest = Counter(), Counter()
    for r in found:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-12)
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    assert all(abs(taken[s] - target[s]) < max(1, 2 * longest[s]) for s in target)
    assert all(r["taken"] == 2 * r["size"] for r in found if target[r["source"]] == 2 * size[r["source"]])


def test_rates_are_the_tilted_ones(spark):
    rows = corpus(5)
    size, target = brute_targets(rows)
    docs = frame(spark, rows)
    sizes = mixing.sized(docs).groupBy("source", "size").agg({"m": "sum"}).withColumnRenamed("sum(m)", "n").cache()
    wanted = spark.createDataFrame([(s, size[s], float(t)) for s, t in target.items()], "source string, source_size long, target double")
    tilted = {r["source"]: r for r in mixing.tilts(sizes, wanted, 2).collect()}
    by_source = defaultdict(list)
    for _, t, s in rows:
        by_source[s].append(len(WORD.findall(t or "")))
    for s, all_sizes in by_source.items():
        tilt = tilted[s]["tilt"]
        if tilt is None:
            assert target[s] in (0, 2 * size[s])
            continue
        mean = sum(all_sizes) / sum(x > 0 for x in all_sizes)
        assert math.isclose(sum(x * min(2, math.exp(tilt * x / mean)) for x in all_sizes), target[s], rel_tol=1e-8)


def test_order_of_rows_and_parts_of_a_size_change_nothing_else(spark, monkeypatch):
    rows = corpus(7)
    shown = lambda df: sorted(((r["doc_id"], r["source"], r["taken"]) for r in df.collect()), key=repr)
    first = shown(mixing.mix(frame(spark, rows)))
    assert first == shown(mixing.mix(frame(spark, rows[::-1]).repartition(5)))
    monkeypatch.setattr(mixing, "RANKED", 4)
    monkeypatch.setattr(mixing, "WRITTEN", 2)
    dealt = shown(mixing.mix(frame(spark, rows)))
    words = lambda found: {s: sum(t for _, o, t in found if o == s) for s in {o for _, o, _ in found}}
    assert words(first) == words(dealt) and len(first) == len(dealt)


def test_weights_of_a_table_and_whole_documents(spark):
    rows = [(k, "a b c d", "x" if k < 30 else "y") for k in range(60)] + [(99, "q r", "left out")]
    weights = spark.createDataFrame([("x", 3.0), ("y", 1.0), ("absent", 9.0)], "source string, weight double")
    docs = frame(spark, rows)
    taken = Counter()
    for r in mixing.mix(docs, weights, share=0.5).collect():
        taken[r["source"]] += r["taken"]
    assert abs(taken["x"] - 0.375 * 242) <= 8 and abs(taken["y"] - 0.125 * 242) <= 8 and taken["left out"] == 0
    out = mixing.mixture(docs, weights, share=0.5)
    assert out.columns == docs.columns
    assert Counter({s: 4 * n for s, n in Counter(r["source"] for r in out.collect()).items()}) == +taken


def test_whole_documents_of_repeated_ids(spark):
    rows = corpus(9)
    docs = frame(spark, rows)
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    got = Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in mixing.mixture(docs).collect())
    assert got == +want


def test_empty_tables_wordless_texts_and_settings(spark):
    assert mixing.mix(frame(spark, [])).count() == 0
    assert [r["taken"] for r in mixing.mix(frame(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]
    with pytest.raises(ValueError):
        mixing.mix(frame(spark, []), most=1.5)


def test_mixing_runs_without_python(spark):
    plan = mixing.mix(frame(spark, [(1, "a b", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BatchEvalPython" not in plan
