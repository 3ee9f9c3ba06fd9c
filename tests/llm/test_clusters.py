import hashlib
import math
import random

import numpy as np
import pytest

from plumbline.llm import bisectors

NAMES = "vec_id long, embedding array<double>, label int, x int, cluster string, `a.b` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "c", "d") for i, v in rows], NAMES)


def brute(rows, k, rounds, dimensions):
    """Ids with cluster, distance, inertia of the cluster and of all, and the digest of the centroid, in plain whole numbers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centroids = [x for _, x in sorted((name(i), x) for i, x in kept)][:k]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    pick = lambda x: min((far(x, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(pick(x)[1], []).append(x)
        centroids = [[sum(col) // len(members[n]) for col in zip(*members[n])] if n in members else c for n, c in enumerate(centroids)]
    found = [(i, *pick(x)[::-1]) for i, x in kept]
    own = {n: sum(d for _, m, d in found if m == n) for _, n, _ in found}
    digest = lambda n: hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()
    return sorted(((i, n, d, own[n], sum(own.values()), digest(n)) for i, n, d in found), key=repr)


def rows_of(df):
    return sorted(map(tuple, df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def test_clusters_are_those_of_plain_whole_numbers(spark):
    rng = random.Random(4)
    rows = [(k, [rng.choice((-1, 1)) * rng.random() for _ in range(6)]) for k in range(120)]
    rows += [(k, [rng.choice((0.0, 0.25, 0.5)) for _ in range(6)]) for k in range(200, 260)]  # many ties
    rows += [(300, rows[0][1]), (0, rows[5][1]), (0, rows[0][1]), (None, rows[3][1]), (None, [0.0] * 6)]
    rows += [(400, None), (401, []), (402, [1.0] * 5), (403, [1.0] * 7), (404, [None] + [1.0] * 5), (405, [math.nan] + [1.0] * 5), (406, [math.inf] * 6), (407, [-0.0] * 6)]
    for k, rounds in ((7, 3), (1, 2), (500, 1)):
        assert rows_of(bisectors.cluster(frame(spark, rows), k, rounds, 6)) == brute(rows, k, rounds, 6)


def test_all_vectors_alike_and_empty_tables(spark):
    rows = [(k, [0.1, -0.3]) for k in range(50)]
    found = rows_of(bisectors.cluster(frame(spark, rows), 4, 3, 2))
    assert found == brute(rows, 4, 3, 2) and {r[1] for r in found} == {0}
    assert rows_of(bisectors.cluster(frame(spark, []), 4, 3, 2)) == []
    assert rows_of(bisectors.cluster(frame(spark, [(1, None), (2, [1.0])]), 4, 3, 2)) == []


def test_large_components_stay_exact_and_larger_ones_have_no_cluster(spark):
    rows = [(k, [(-1.0) ** k * 524000.0 + k, 1.0 * k]) for k in range(20)] + [(90, [1e30, 0.0]), (91, [0.0, -1.7e308])]
    found = rows_of(bisectors.cluster(frame(spark, rows), 5, 2, 2))
    assert [r for r in found if r[0] < 90] == brute(rows[:20], 5, 2, 2)
    assert [r for r in found if r[0] >= 90] == [(90, *[None] * 5), (91, *[None] * 5)]


def test_a_tournament_is_a_search_of_all(spark):
    rng = np.random.default_rng(1)
    x, c = rng.integers(-4, 5, (500, 3)), rng.integers(-4, 5, (30, 3))
    winner, distance = bisectors.nearest(x, bisectors.planes(c))
    every = ((x[:, None, :] - c[None, :, :]) ** 2).sum(2)
    assert (winner == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_too_many_centroids_are_refused(spark):
    with pytest.raises(ValueError):
        bisectors.cluster(frame(spark, []), 5000)
