"""Contributions of features against sums over all subsets."""

import math
import random
from itertools import combinations

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from plumbline.operators import contributions, learning

NUMBERS = ["a", "b.c", "d"]


@pytest.fixture(scope="module")
def things(spark):
    rng = random.Random(3)
    rows = []
    for k in range(260):
        a, b, d, site = rng.gauss(0, 1), rng.randint(0, 4), rng.random(), rng.choice("xxyyzw")
        y = 3 * a - (b if site == "x" else 0) + 5 * (d > 0.5) * (site == "y") + rng.gauss(0, 0.2)
        rows.append((k, a if k % 17 else None, b, d, site if k % 19 else None, y, "high" if y > 1 else "low" if y < -1 else "middle"))
    return spark.createDataFrame(rows, "id int, a double, `b.c` int, d double, site string, y double, kind string").cache()


def expectation(tree, at, row, known):
    node = tree[at]
    if node.question is None:
        return node.value
    left, right = node.children
    if node.question.slot in known:
        q, x = node.question, row[node.question.slot]
        return expectation(tree, left if (x <= q.threshold if q.categories is None else x in q.categories) else right, row, known)
    return sum(tree[c].rows / node.rows * expectation(tree, c, row, known) for c in (left, right))


def by_subsets(trees, row, n):
    value = lambda known: sum(w * expectation(t, 0, row, set(known)) for w, t in trees)
    out = []
    for i in range(n):
        others = [j for j in range(n) if j != i]
        out.append(sum(
            math.factorial(k) * math.factorial(n - k - 1) / math.factorial(n) * (value((*s, i)) - value(s)) for k in range(n) for s in combinations(others, k)
        ))
    return value(()), out


@pytest.mark.parametrize("learner", ["DecisionTreeRegressor", "RandomForestRegressor", "GBTRegressor"])
def test_trees_equal_sums_over_subsets(things, learner):
    model = learning.train_best(things.select(*[f"`{c}`" for c in NUMBERS], "y"), "y", learners=[learner])
    trees = contributions.read_trees(model.pipeline.stages[-1])
    filled = things.fillna(things.approxQuantile("a", [0.5], 0)[0], ["a"])
    rows = learning.contributions(model, filled.limit(12)).collect()
    for r in rows:
        base, want = by_subsets(trees, [r["a"], r["b.c"], r["d"]], 3)
        assert r["base"] == pytest.approx(base) and r["contributions"] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("learner", ["LinearRegression", "DecisionTreeRegressor", "RandomForestRegressor", "GBTRegressor"])
def test_contributions_add_up_to_the_prediction(things, learner):
    df = things.drop("id", "kind")
    model = learning.train_best(df, "y", learners=[learner])
    out = learning.contributions(model, df)
    assert out.columns == [*df.columns, "base", "contributions", "output"]
    scored = {tuple(r)[:5]: r["prediction_label"] for r in learning.predict(df, model).collect()}
    for r in out.collect():
        assert r["output"] == pytest.approx(scored[tuple(r)[:5]], abs=1e-6)
        assert r["base"] + sum(r["contributions"]) == pytest.approx(r["output"])


@pytest.mark.parametrize("learner, output", [("LogisticRegression", "rawPrediction"), ("DecisionTreeClassifier", "probability"), ("RandomForestClassifier", "probability"), ("NaiveBayes", "rawPrediction"), ("GBTClassifier", "rawPrediction")])
def test_contributions_add_up_to_the_score_of_a_class(things, learner, output):
    df = things.drop("y").withColumn("kind", F.when(F.col("kind") == "middle", "low").otherwise(F.col("kind")) if learner == "GBTClassifier" else F.col("kind"))
    model = learning.train_best(df.drop("id"), "kind", learners=[learner])
    ready = learning._model_ready(df, model.features)
    steps = [s for s in model.pipeline.stages if not learning._is_label(s)]
    for s in steps:
        ready = s.transform(ready)
    want = {r["id"]: r["s"] for r in ready.select("id", vector_to_array(output)[0].alias("s")).collect()}
    for r in learning.contributions(model, df).collect():
        assert r["output"] == pytest.approx(want[r["id"]], rel=1e-6, abs=1e-6)


def test_importance_is_the_mean_size_of_contributions(things):
    df = things.drop("id", "kind")
    model = learning.train_best(df, "y", learners=["LinearRegression"])
    shares = learning.explain(model, df).collect()
    assert sum(r.importance for r in shares) == pytest.approx(1) and shares[0].feature == "a"
    assert {r.feature: r.impact_direction for r in shares}["b.c"] == "negative"
    sizes = [[abs(v) for v in r["contributions"]] for r in learning.contributions(model, df).collect()]
    for i, feature in enumerate(model.features):
        assert {r.feature: r.contribution for r in shares}[feature] == pytest.approx(sum(s[i] for s in sizes) / len(sizes))
    assert len(learning.explain(model, df, k=2).collect()) == 2


def test_frequent_values_have_slots_of_their_own(spark):
    rows = [(f"v{k % 3}", f"u{k}", float(k % 3)) for k in range(3000)]
    df = spark.createDataFrame(rows, "often string, once string, y double")
    model = learning.train_best(df, "y", learners=["DecisionTreeRegressor"])
    assert learning.slot_features(model) == [0] * 4 + [1] * 2
    assert {r["prediction_label"] for r in learning.predict(df.filter("often = 'v1'"), model).collect()} == {1.0}
    unseen = spark.createDataFrame([("new", "new", 0.0)], df.schema)
    assert learning.predict(unseen, model).count() == 1


def test_a_model_of_very_few_rows(spark):
    df = spark.createDataFrame([(1.0, "a")], "x double, kind string")
    assert learning.train_best(df, "kind", learners=["DecisionTreeClassifier"]).rows_trained == 1
