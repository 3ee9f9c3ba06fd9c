"""Correlation of many columns at once, against plain computation for each pair."""

import math
import random
from itertools import combinations

import numpy as np
import pytest

from plumbline.operators import correlation, gram


def columns_of(n, rows, seed=1):
    """Columns with gaps, ties, copies, constants, far means, an empty one, and values that are not finite."""
    rng = random.Random(seed)
    base = [rng.gauss(0, 1) for _ in range(rows)]
    out = []
    for k in range(n):
        kind = k % 9
        values = [
            [b * (k + 1) + rng.gauss(0, 1) for b in base], [float(rng.randint(0, 4)) for _ in base], [1e9 + b for b in base], [7.5] * rows, [-b for b in base],
            [float(int(b * 3)) for b in base], [None] * rows, [rng.random() for _ in base], [b * 1e-6 for b in base],
        ][kind]
        if k % 2:
            values = [v if rng.random() < 0.7 else None for v in values]
        out.append(values)
    if n > 15:
        out[10][3] = math.nan
        out[12][5] = math.inf
        out[14] = [v if i < 2 else None for i, v in enumerate(out[14])]
        # Constant among the rows of its partner, though not among all.
        out[15] = [5.0 if base[i] > 0 else -3.0 - i for i in range(rows)]
        out[11] = [b if b > 0 else None for b in base]
    return out


def frame(spark, columns):
    names = [f"c {k}.x" for k in range(len(columns))]
    return spark.createDataFrame(list(zip(*columns)), ", ".join(f"`{n}` double" for n in names)), names


def ranks(values):
    order = sorted(values)
    first, last = {}, {}
    for i, v in enumerate(order, 1):
        first.setdefault(v, i)
        last[v] = i
    return [(first[v] + last[v]) / 2 for v in values]


def plain(x, y, by_rank):
    both = [(a, b) for a, b in zip(x, y) if a is not None and b is not None]
    if not both or (not by_rank and not all(math.isfinite(v) for p in both for v in p)):
        return None, len(both)
    xs, ys = zip(*both)
    if by_rank:
        xs, ys = ranks(xs), ranks(ys)
    if len(set(xs)) == 1 or len(set(ys)) == 1:
        return None, len(both)
    xs, ys = np.array(xs) - np.mean(xs), np.array(ys) - np.mean(ys)
    return float((xs * ys).sum() / math.sqrt((xs * xs).sum() * (ys * ys).sum())), len(both)


def same(found, columns, names, by_rank=False):
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        r, n = plain(columns[i], columns[j], by_rank)
        assert found[(a, b)][1] == n, (a, b)
        assert (found[(a, b)][0] is None) == (r is None), (a, b, found[(a, b)], r)
        assert r is None or found[(a, b)][0] == pytest.approx(r, abs=1e-6), (a, b)


@pytest.mark.parametrize("pass_columns", [400, 8])
def test_many_columns_by_matrices(spark, monkeypatch, pass_columns):
    monkeypatch.setattr(gram, "PASS_COLUMNS", pass_columns)
    columns = columns_of(20, 60)
    df, names = frame(spark, columns)
    same(correlation.pearson_pairs(df.repartition(3), names), columns, names)


def test_many_columns_by_ranks(spark):
    columns = [c for k, c in enumerate(columns_of(18, 40, 3)) if k not in (10, 12)]
    df, names = frame(spark, columns)
    assert len(names) * (len(names) - 1) // 2 <= 120
    same(correlation.spearman_pairs(df.repartition(3), names), columns, names, True)


def test_more_pairs_of_ranks_than_one_aggregate_takes(spark, monkeypatch):
    monkeypatch.setattr(correlation, "MAX_COUNTERS", 3)
    columns = columns_of(6, 50, 4)
    df, names = frame(spark, columns)
    same(correlation.spearman_pairs(df.repartition(3), names), columns, names, True)


def test_one_join_for_each_column(spark, monkeypatch):
    seen = []
    real = correlation._cross_sums
    monkeypatch.setattr(correlation, "_cross_sums", lambda ranked, tag: seen.append(ranked._jdf.queryExecution().optimizedPlan().toString()) or real(ranked, tag))
    df, names = frame(spark, columns_of(5, 20, 2))
    correlation.spearman_pairs(df, names)
    assert seen[0].count("Join ") == 5


def test_no_rows(spark):
    df, names = frame(spark, [[1.0]] * 9)
    empty = correlation.pearson_pairs(df.limit(0), names)
    assert set(empty.values()) == {(None, 0)}
    assert set(correlation.spearman_pairs(df.limit(0), names[:3]).values()) == {(None, 0)}


@pytest.mark.parametrize("large", [0, 20, 10**6])
def test_spearman_with_large_rank_tables_gathered_by_row(spark, monkeypatch, large):
    """Whether ranks are gathered by row for all columns, for those with many values, or joined one after the other."""
    rng = random.Random(11)
    rows = [(rng.random(), float(rng.randrange(900)) if rng.random() < 0.7 else None, rng.randrange(3), rng.gauss(0, 1) if rng.random() < 0.5 else None, None) for _ in range(60)]
    rows += [(None, None, None, None, None)] * 2 + rows[:3]
    df = spark.createDataFrame(rows, "`a.b` double, c double, d int, e double, f double")
    monkeypatch.setattr(correlation, "LARGE_RANKS", large)
    gathered, whole = [], correlation._gathered
    monkeypatch.setattr(correlation, "_gathered", lambda *a: gathered.append(a[2]) or whole(*a))
    found = correlation.spearman_pairs(df, df.columns)
    assert gathered == {0: [[0, 1, 2, 3]], 20: [[0, 1, 3]], 10**6: []}[large]
    for i, j in combinations(range(5), 2):
        full = [(float(r[i]), float(r[j])) for r in rows if r[i] is not None and r[j] is not None]
        r, n = found[(df.columns[i], df.columns[j])]
        assert n == len(full)
        if n:
            ranks = [[sum(v < x for v in of) + (sum(v == x for v in of) + 1) / 2 for x in of] for of in zip(*full)]
            assert r == pytest.approx(np.corrcoef(*ranks)[0, 1], abs=1e-9)
        else:
            assert r is None


@pytest.mark.parametrize("stored", [False, True])
@pytest.mark.parametrize("gathered_columns", [24, 6])
def test_ranks_in_many_ranges_and_blocks(spark, monkeypatch, tmp_path, stored, gathered_columns):
    """Frequent values, values that are not finite, both zeros, integers that a double merges, and gaps, over several ranges and blocks."""
    from plumbline.operators import ranges

    columns = columns_of(9, 400, 5)
    rng = random.Random(2)
    columns[0][7], columns[0][9], columns[4][3], columns[4][11] = math.nan, math.nan, math.inf, -math.inf
    columns[1] = [None if v is None else rng.choice([0.0, -0.0, v]) for v in columns[1]]
    columns.append([2**60 + rng.randrange(9) if rng.random() < 0.8 else None for _ in range(400)])
    names = [f"c {k}.x" for k in range(10)]
    df = spark.createDataFrame(list(zip(*columns)), ", ".join(f"`{n}` double" for n in names[:-1]) + f", `{names[-1]}` bigint")
    if stored:
        df.repartition(5).write.parquet(f"{tmp_path}/rows")
        df = spark.read.parquet(f"{tmp_path}/rows")
    monkeypatch.setattr(correlation, "LARGE_RANKS", 500)
    monkeypatch.setattr(correlation, "GATHERED_COLUMNS", gathered_columns)
    monkeypatch.setattr(ranges, "RANGE_CELLS", 40)
    monkeypatch.setattr(ranges, "BLOCK_RANKS", 1500)
    cuts, whole = [], correlation.cut
    monkeypatch.setattr(correlation, "cut", lambda *a: cuts.append(whole(*a)) or cuts[-1])
    found = correlation.spearman_pairs(df, names)
    nan_last = [[(1, 0) if isinstance(v, float) and math.isnan(v) else v if v is None else (0, v) for v in c] for c in columns]
    for (i, a), (j, b) in combinations(enumerate(names), 2):
        r, n = plain(nan_last[i], nan_last[j], True)
        assert found[(a, b)][1] == n
        assert (found[(a, b)][0] is None) == (r is None), (a, b)
        assert r is None or found[(a, b)][0] == pytest.approx(r, abs=1e-9), (a, b)
    assert max(len(c) for c in cuts[0].cuts) > 5 and any(s.any() for s in cuts[0].single)


def test_ranks_are_sent_in_few_bytes_for_each_column_with_gaps(spark, tmp_path):
    """A cell is sent with a byte or two for each column with gaps, in place of a table of eight bytes and more for each."""
    from plumbline.operators import ranges

    rows, k = 3000, 12
    rng = random.Random(3)
    names = [f"c{i}" for i in range(k)]
    data = [[rng.random() if rng.random() < 0.9 else None for _ in names] for _ in range(rows)]
    spark.createDataFrame(data, ", ".join(f"{n} double" for n in names)).repartition(5).write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    coded, present = ranges.ordered_codes(df, names), [sum(r[i] is not None for r in data) for i in range(k)]
    found = ranges.cut(coded, rows, present, range(k), [False] * k)
    cells = coded.mapInArrow(ranges._dealt(found, range(k), 10**5), ranges._CELLS)
    placed = cells.groupBy("at", "part").applyInArrow(ranges._placed(k), ranges._CELLS)
    assert cells.selectExpr("sum(length(data))").first()[0] < rows * k * 12
    assert placed.selectExpr("sum(length(data))").first()[0] < rows * k * (4 + k)
