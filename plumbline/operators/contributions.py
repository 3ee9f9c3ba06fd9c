"""What each feature adds to a prediction: exact Shapley values of Spark's trees, linear models and naive Bayes.

For trees the value of a set of features is the expectation along the paths: where a node asks for another feature, both
children count by their share of the training rows. A leaf is then a product over the features of its path, of 1 or 0 for
one that is in the set, and of those shares for one that is not. Its Shapley values depend on a row only through the
features whose questions the row answers towards the leaf, so they are computed once for each such pattern. For models that
add up a function of each feature, a feature contributes its function less the mean of that over the rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import factorial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import drop_path, fresh_path

#: Rows that are explained at a time.
BATCH_ROWS = 1 << 13


class Question(NamedTuple):
    """A split of a tree: values up to ``threshold``, or those among ``categories``, go left."""

    slot: int
    threshold: float
    categories: tuple[float, ...] | None

    def left(self, x: np.ndarray) -> np.ndarray:
        values = x[:, self.slot]
        return values <= self.threshold if self.categories is None else np.isin(values, self.categories)


class Leaf(NamedTuple):
    """A leaf: its value, and for each feature of its path the questions with the wanted answers and the share of rows."""

    value: float
    slots: list[int]
    questions: list[list[tuple[Question, bool]]]
    shares: list[float]


class Node(NamedTuple):
    value: float
    rows: float
    question: Question | None
    children: tuple[int, int]


Tree = dict[int, Node]


def read_trees(model, class_index: int = 0) -> list[tuple[float, Tree]]:
    """Weight and nodes of every tree of a tree model, as Spark stores them; values are those of one class in classifiers.

    Single classifiers and forests predict shares of classes, boosted ones a margin that is turned for the first class.
    """
    name = type(model).__name__
    boosted, several = name.startswith("GBT"), hasattr(model, "trees")
    votes = "Classif" in name and not boosted
    spark = SparkSession.active()
    path = fresh_path(spark, "trees")
    try:
        model.write().save(path)
        rows = spark.read.parquet(f"{path}/data").collect()
    finally:
        drop_path(spark, path)
    trees: dict[int, Tree] = {}
    for r in rows:
        d = r["nodeData"] if several else r
        stats, split = np.array(d["impurityStats"]), d["split"]
        question = None
        if d["leftChild"] >= 0:
            categorical = split["numCategories"] >= 0
            values = tuple(split["leftCategoriesOrThreshold"])
            question = Question(split["featureIndex"], 0.0 if categorical else values[0], values if categorical else None)
        rows_in = float(stats.sum() if votes else stats[0])
        value = float(stats[class_index] / stats.sum()) if votes else float(d["prediction"])
        trees.setdefault(r["treeID"] if several else 0, {})[d["id"]] = Node(value, rows_in, question, (d["leftChild"], d["rightChild"]))
    weights = list(model.treeWeights) if boosted else [1.0 / len(trees)] * len(trees)
    sign = -1.0 if boosted and "Classif" in name and class_index == 0 else 1.0
    return [(sign * weights[k], trees[k]) for k in sorted(trees)]


def leaves(tree: Tree) -> list[Leaf]:
    """All leaves with what their paths ask."""
    out, open_ = [], [(0, {})]
    while open_:
        at, path = open_.pop()
        node = tree[at]
        if node.question is None:
            slots = sorted(path)
            out.append(Leaf(node.value, slots, [path[s][0] for s in slots], [path[s][1] for s in slots]))
            continue
        slot = node.question.slot
        for child, answer in zip(node.children, (True, False)):
            asked, share = path.get(slot, ([], 1.0))
            open_.append((child, {**path, slot: ([*asked, (node.question, answer)], share * tree[child].rows / node.rows)}))
    return out


def leaf_contributions(shares: Sequence[float], met: Sequence[bool]) -> np.ndarray:
    """Shapley values of a product of ones (met), zeros (not met), and shares where a feature is unknown."""
    d = len(shares)
    weight = np.array([factorial(k) * factorial(d - k - 1) / factorial(d) for k in range(d)])
    out = np.zeros(d)
    for i in range(d):
        sums = np.zeros(d)
        sums[0] = 1.0
        for j in range(d):
            if j != i:
                # Sets with and without feature j, by their number of features.
                sums = sums * shares[j] + np.r_[0.0, sums[:-1]] * met[j]
        out[i] = (float(met[i]) - shares[i]) * (weight * sums).sum()
    return out


class Additive(NamedTuple):
    """A model that adds up ``square * x**2 + slope * x`` of every slot and a constant."""

    square: np.ndarray
    slope: np.ndarray
    constant: float


def additive(model, class_index: int = 0) -> Additive:
    """The additive form of a linear model, of one class of a logistic one (its margin) or of Gaussian naive Bayes (its log likelihood but for the constant of all classes)."""
    name = type(model).__name__
    if name == "LinearRegressionModel":
        slope = model.coefficients.toArray()
        return Additive(np.zeros_like(slope), slope, float(model.intercept))
    if name == "LogisticRegressionModel":
        matrix, constants = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        single = len(matrix) == 1
        sign = -1.0 if single and class_index == 0 else 1.0
        row = 0 if single else class_index
        return Additive(np.zeros(matrix.shape[1]), sign * matrix[row], sign * float(constants[row]))
    if name == "NaiveBayesModel" and model.getModelType() == "gaussian":
        centre, spread = model.theta.toArray()[class_index], model.sigma.toArray()[class_index]
        constant = float(model.pi.toArray()[class_index] - 0.5 * (np.log(spread) + centre**2 / spread).sum())
        return Additive(-0.5 / spread, centre / spread, constant)
    raise ValueError(f"{name} has no additive form")


def explained(ready: DataFrame, features: str, model, groups: Sequence[int], class_index: int = 0) -> DataFrame:
    """``ready`` plus ``base, contributions, output``: base and contributions add up to the output of the model.

    ``groups`` says to which feature each slot of the vector belongs; the contributions of its slots are added up. The
    output is the prediction of a regression, the share of the class in trees and forests, and else its raw score.
    """
    n_groups = max(groups, default=-1) + 1
    group = np.array(groups, int)
    if "Tree" in type(model).__name__ or "Forest" in type(model).__name__ or type(model).__name__.startswith("GBT"):
        forest = [(weight, leaf) for weight, tree in read_trees(model, class_index) for leaf in leaves(tree)]
        used = sorted({s for _, leaf in forest for s in leaf.slots})
        explain = _explain_trees(forest, used, group, n_groups)
    else:
        form = additive(model, class_index)
        used = [int(s) for s in np.flatnonzero((form.square != 0) | (form.slope != 0))]
        about = ready.agg(Summarizer.metrics("mean", "variance", "count").summary(F.col(features)).alias("s")).first()["s"]
        n = int(about["count"])
        mean = about["mean"].toArray() if n else np.zeros(len(group))
        squares = about["variance"].toArray() * (n - 1) / n + mean**2 if n else mean
        explain = _explain_sums(form, used, group, n_groups, mean, squares)
    values = vector_to_array(F.col(features))
    rows = ready.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in ready.columns if c != features]).alias("row"), F.transform(F.array(*[F.lit(s) for s in used]).cast("array<int>"), lambda s: F.get(values, s)).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(start, BATCH_ROWS)
                x = pc.list_flatten(part.column("x")).to_numpy(zero_copy_only=False).reshape(part.num_rows, len(used))
                base, out = explain(x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * n_groups), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), pa.array(np.full(len(out), base)), lists, pa.array(base + out.sum(1))], names=["row", "base", "contributions", "output"]
                )

    schema = rows.select("row").schema.add("base", "double").add("contributions", T.ArrayType(T.DoubleType())).add("output", "double")
    return rows.mapInArrow(run, schema).select("row.*", "base", "contributions", "output")


def _explain_trees(forest: list[tuple[float, Leaf]], used: list[int], group: np.ndarray, n_groups: int):
    place = {s: i for i, s in enumerate(used)}
    local = [(w, leaf, [[(q._replace(slot=place[q.slot]), a) for q, a in asked] for asked in leaf.questions]) for w, leaf in forest]
    base = sum(w * leaf.value * float(np.prod(leaf.shares)) for w, leaf in forest)
    known: list[dict[bytes, np.ndarray]] = [{} for _ in forest]

    def explain(x: np.ndarray) -> tuple[float, np.ndarray]:
        out = np.zeros((len(x), n_groups))
        answers: dict[Question, np.ndarray] = {}
        for (weight, leaf, questions), table in zip(local, known):
            if not leaf.slots:
                continue
            met = np.ones((len(x), len(leaf.slots)), bool)
            for i, asked in enumerate(questions):
                for question, wanted in asked:
                    if question not in answers:
                        answers[question] = question.left(x)
                    met[:, i] &= answers[question] == wanted
            patterns, which = np.unique(met, axis=0, return_inverse=True)
            for p in patterns:
                if p.tobytes() not in table:
                    table[p.tobytes()] = weight * leaf.value * leaf_contributions(leaf.shares, p)
            found = np.array([table[p.tobytes()] for p in patterns])[which.ravel()]
            for i, slot in enumerate(leaf.slots):
                out[:, group[slot]] += found[:, i]
        return base, out

    return explain


def _explain_sums(form: Additive, used: list[int], group: np.ndarray, n_groups: int, mean: np.ndarray, squares: np.ndarray):
    square, slope = form.square[used], form.slope[used]
    typical = square * squares[used] + slope * mean[used]
    base = form.constant + float(typical.sum())
    to_group = np.zeros((len(used), n_groups))
    to_group[np.arange(len(used)), group[used]] = 1.0

    def explain(x: np.ndarray) -> tuple[float, np.ndarray]:
        return base, (square * x * x + slope * x - typical) @ to_group

    return explain
