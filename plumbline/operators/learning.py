"""Baseline models with Spark ML: problem type, best of several learners, prediction, explanation."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from math import exp, factorial

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LogisticRegression,
    NaiveBayes,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.feature import Bucketizer, Imputer, IndexToString, OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.kinds import kinds, ref
from plumbline.operators.contributions import explained
from plumbline.operators.profile import loose_numeric_columns
from plumbline.operators.sketches import distributions
from plumbline.operators.wide import stack_rows

FEATURES, LABEL, TARGET, PREDICTION = "__features", "__label", "__target", "prediction_label"
HELD_OUT, WEIGHT, WITHIN, TREE = "__held_out", "__weight", "__within", "__tree"
# A label that no text has, as all of them begin with a mark.
_NO_VALUE = "no value"
# A value of a text feature has a slot of its own if at least one row in so many holds it; the others of the feature share one.
RARE = 1000
# A classification target with more values is refused: its values are numbered on the driver.
MAX_CLASSES = 10_000
# Tree learners see a number as one of so many bins; it is the default of Spark's.
BINS = 32
# From so many rows on they are given counts and sums of the combinations of bins, if one in FOLD rows or fewer has a combination of its own.
FOLD_ROWS, FOLD = 10_000, 20
# Cells that a task of a tree learner reads, and trees of a forest that draw from a row at once and that are grown at the same time.
CELLS_PER_TASK, DRAWN_TOGETHER, GROWN_TOGETHER = 50_000, 5, 4
SEED = 42


def problem_type(df: DataFrame, target: str) -> str:
    """``classification`` when the target holds no number at all, else ``regression``."""
    return "regression" if target in loose_numeric_columns(df.select(ref(target)), strict=False) else "classification"


def problem_types(df: DataFrame) -> DataFrame:
    """Problem type that each column would have as a target."""
    numeric = set(loose_numeric_columns(df, strict=False))
    rows = [(c, "regression" if c in numeric else "classification") for c in df.columns]
    return df.sparkSession.createDataFrame(rows, "target string, problem_type string")


def _learners(kind: str, classes: int) -> dict:
    shared = dict(featuresCol=FEATURES, labelCol=LABEL)
    if kind == "regression":
        return {
            "LinearRegression": LinearRegression(**shared),
            "DecisionTreeRegressor": DecisionTreeRegressor(seed=SEED, **shared),
            "RandomForestRegressor": RandomForestRegressor(seed=SEED, **shared),
            "GBTRegressor": GBTRegressor(seed=SEED, maxIter=10, **shared),
        }
    learners = {
        "LogisticRegression": LogisticRegression(maxIter=50, **shared),
        "DecisionTreeClassifier": DecisionTreeClassifier(seed=SEED, **shared),
        "RandomForestClassifier": RandomForestClassifier(seed=SEED, **shared),
        "NaiveBayes": NaiveBayes(modelType="gaussian", **shared),
    }
    if classes == 2:
        learners["GBTClassifier"] = GBTClassifier(seed=SEED, maxIter=10, **shared)
    return learners


@dataclass
class TrainedModel:
    model_type: str
    problem: str
    target: str
    features: list[str]
    score: float
    rows_trained: int
    pipeline: PipelineModel

    def info(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(
            [(self.model_type, self.problem, self.target, self.features, float(self.score), self.rows_trained)],
            "model_type string, problem string, target string, features array<string>, score double, rows_trained bigint",
        )


def frequent_values(ready: DataFrame, columns: Sequence[str], rows: int, rare: int = RARE) -> list[list[str]]:
    """Values of text columns that at least one row in ``rare`` holds, most frequent first; at most ``rare`` of each column.

    Values are counted in one pass; only the frequent ones reach the driver.
    """
    out: list[list[str]] = [[] for _ in columns]
    if columns:
        cells = stack_rows(ready, [{"column": F.lit(i), "value": ref(c)} for i, c in enumerate(columns)])
        counts = cells.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * rare >= rows)
        for r in counts.orderBy("column", F.desc("n"), "value").collect():
            out[r["column"]].append(r["value"])
    return out


def _inputs(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """The names under which the stages take numbers and texts: the place of the feature, whatever its own name is."""
    own = kinds(df)
    names = [(f"__x{i}", own[c] in ("integer", "float")) for i, c in enumerate(features)]
    return [n for n, number in names if number], [n for n, number in names if not number]


def _stages(numbers: list[str], texts: list[str], values: list[list[str]], kind: str) -> list:
    """Missing numbers become the median; a text has one slot for each of its frequent values and one for all others."""
    stages, inputs = [], []
    if numbers:
        filled = [f"{c}_filled" for c in numbers]
        stages.append(Imputer(strategy="median", inputCols=numbers, outputCols=filled))
        inputs += filled
    if texts:
        places, slots = [f"{c}_place" for c in texts], [f"{c}_slots" for c in texts]
        # A column without frequent values has one label that no text equals beside the slot of the others.
        stages += [StringIndexerModel.from_labels(v or [_NO_VALUE], text, place, "keep") for v, text, place in zip(values, texts, places)]
        stages.append(OneHotEncoder(inputCols=places, outputCols=slots, dropLast=False))
        inputs += slots
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES, handleInvalid="keep"))
    if kind == "classification":
        stages.append(StringIndexer(inputCol=TARGET, outputCol=LABEL, handleInvalid="keep", stringOrderType="alphabetAsc"))
    return stages


def slot_features(model: TrainedModel) -> list[int]:
    """The feature, by its place in ``model.features``, of every slot of the feature vector."""
    place = lambda c: int(c.removeprefix("__x"))
    out = []
    for stage in model.pipeline.stages:
        if stage.__class__.__name__ == "ImputerModel":
            out += [place(c) for c in stage.getInputCols()]
        elif stage.__class__.__name__ == "StringIndexerModel" and not _is_label(stage):
            # One slot for each label, and one for all other values.
            out += [place(stage.getInputCol())] * (len(stage.labels) + 1)
    return out


def _model_ready(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Adds what the feature stages take: numbers as doubles, everything else as text behind a mark, so that none is empty."""
    own = kinds(df)
    return df.withColumns({
        f"__x{i}": ref(c).cast("double") if own[c] in ("integer", "float") else F.concat(F.lit("="), F.coalesce(ref(c).cast("string"), F.lit("")))
        for i, c in enumerate(features)
    })


def _grows_trees(learner: str) -> bool:
    return learner.startswith(("DecisionTree", "RandomForest", "GBT"))


def split_points(values: np.ndarray, bins: int = BINS) -> list[float]:
    """Thresholds between the values of a sorted sample, chosen as Spark's tree learners choose them from theirs.

    Up to ``bins`` different values are all told apart. More are cut where the bins come closest to equal numbers of values.
    """
    distinct, counts = np.unique(values, return_counts=True)
    between = distinct[:-1] / 2 + distinct[1:] / 2
    if len(distinct) > bins:
        stride, ends, chosen = len(values) / bins, np.cumsum(counts), []
        for i in range(len(between)):
            target = stride * (len(chosen) + 1)
            if abs(ends[i] - target) < abs(ends[i + 1] - target):
                chosen.append(i)
        between = between[chosen]
    return [float(t) for t in np.unique(between) if np.isfinite(t)]


def _bucketizer(columns: Sequence[str], points: Sequence[Sequence[float]]) -> Bucketizer:
    """Numbers become the number of their bin; a value equal to a threshold belongs below it, as in a tree."""
    # A number without thresholds has one bin in use: none is below the least number there is.
    edges = [[float("-inf"), *[float(np.nextafter(t, np.inf)) for t in ts or [-np.finfo(float).max]], float("inf")] for ts in points]
    return Bucketizer(splitsArray=edges, inputCols=list(columns), outputCols=[f"{c}_bin" for c in columns], handleInvalid="keep")


def poisson(u: Column) -> Column:
    """How often a row is drawn, from a uniform number: a Poisson number of mean 1."""
    total, out = 0.0, F
    for k in range(18):
        total += exp(-1) / factorial(k)
        out = out.when(u < total, float(k))
    return out.otherwise(18.0)


@dataclass
class _Cells:
    """Rows folded by fold, bins of numbers, slots of texts and (in classification) class: all that trees can tell apart.

    Splits, leaves and residuals of trees depend on the rows of a cell through their number and the mean of their labels only.
    """

    rows: DataFrame
    cells: DataFrame
    keys: list[str]
    stages: list
    vectors: PipelineModel
    compared_on: tuple[Column, Column]
    tasks: int
    drawn: dict[int, DataFrame] = field(default_factory=dict)

    def fit(self, learner, held_out: bool | None = None):
        """The learner over all cells, or those that learners are compared on."""
        part = F.lit(True) if held_out is None else self.compared_on[held_out]
        if not learner.__class__.__name__.startswith("RandomForest"):
            return learner.copy({learner.weightCol: WEIGHT}).fit(self.cells.filter(part).coalesce(self.tasks))
        return self._forest(learner, part)

    def _forest(self, learner, part: Column):
        """A forest whose trees each draw every row by itself; what a tree drew is added up by cell."""
        n, regression = learner.getNumTrees(), isinstance(learner, RandomForestRegressor)
        if n not in self.drawn:
            at_once = range(DRAWN_TOGETHER)
            draws = self.rows.withColumn("__first", F.explode(F.lit(list(range(0, n, DRAWN_TOGETHER)))))
            draws = draws.withColumns({f"__u{i}": F.rand(SEED + i) for i in at_once}).withColumns({f"__w{i}": poisson(F.col(f"__u{i}")) for i in at_once})
            sums = draws.groupBy("__first", *self.keys).agg(
                *[F.sum(f"__w{i}").alias(f"__w{i}") for i in at_once], *[F.sum(F.col(f"__w{i}") * F.col(LABEL)).alias(f"__s{i}") for i in at_once if regression]
            )
            of_tree = lambda i: F.struct((F.col("__first") + i).alias(TREE), F.col(f"__w{i}").alias(WEIGHT), *[F.try_divide(f"__s{i}", f"__w{i}").alias(LABEL)] * regression)
            sums = sums.select(*self.keys, F.inline(F.array(*map(of_tree, at_once)))).filter((F.col(WEIGHT) > 0) & (F.col(TREE) < n))
            self.drawn[n] = self.vectors.transform(sums).select(TREE, HELD_OUT, FEATURES, LABEL, WEIGHT).persist(StorageLevel.MEMORY_AND_DISK)
        # A forest of one tree would try all features at each node.
        tried = "onethird" if regression else "sqrt"
        single = lambda t: learner.copy({
            learner.weightCol: WEIGHT, learner.numTrees: 1, learner.bootstrap: False, learner.featureSubsetStrategy: tried, learner.seed: SEED + t,
        }).fit(self.drawn[n].filter((F.col(TREE) == t) & part).coalesce(self.tasks))
        with ThreadPoolExecutor(GROWN_TOGETHER) as pool:
            grown = list(pool.map(single, range(n)))
        return _joined_forest(grown, learner)

    def score(self, model, kind: str) -> float:
        """Accuracy or RMSE over the rows of the cells held out."""
        scored = model.transform(self.cells.filter(self.compared_on[True]))
        if kind == "classification":
            right = F.sum(F.when(F.col("prediction") == F.col(LABEL), F.col(WEIGHT)).otherwise(0.0)) / F.sum(WEIGHT)
            return scored.agg(right).first()[0]
        off = F.pow(F.col("prediction") - F.col(LABEL), F.lit(2)) + F.col(WITHIN)
        return scored.agg(F.sqrt(F.sum(off * F.col(WEIGHT)) / F.sum(WEIGHT))).first()[0]

    def unpersist(self) -> None:
        for part in (self.cells, *self.drawn.values()):
            part.unpersist()


def _joined_forest(grown: Sequence, learner):
    """One forest of the trees of several."""
    regression = isinstance(learner, RandomForestRegressor)
    jvm, first = SparkSession.active()._jvm, grown[0]
    ml = jvm.org.apache.spark.ml.regression if regression else jvm.org.apache.spark.ml.classification
    trees = SparkSession.active().sparkContext._gateway.new_array(ml.DecisionTreeRegressionModel if regression else ml.DecisionTreeClassificationModel, len(grown))
    for i, one in enumerate(grown):
        trees[i] = one._java_obj.trees()[0]
    if regression:
        forest = RandomForestRegressionModel(ml.RandomForestRegressionModel(learner.uid, trees, first.numFeatures))
    else:
        forest = RandomForestClassificationModel(ml.RandomForestClassificationModel(learner.uid, trees, first.numFeatures, max(m.numClasses for m in grown)))
    return learner._copyValues(forest)


def _cells(labelled: DataFrame, prepared: PipelineModel, numbers: list[str], texts: list[str], kind: str, rows: int) -> _Cells | None:
    """The rows folded for tree learners, or nothing where that would not leave far fewer."""
    if rows < FOLD_ROWS:
        return None
    *own, assembler = [s for s in prepared.stages if not _is_label(s)]
    labels = [s for s in prepared.stages if _is_label(s)]
    encoder = [s for s in own if s.__class__.__name__ == "OneHotEncoderModel"]
    steps = [s for s in own if s not in encoder]
    places, slots, filled = [f"{c}_place" for c in texts], [f"{c}_slots" for c in texts], [f"{c}_filled" for c in numbers]
    if numbers:
        found = distributions(PipelineModel(steps).transform(labelled), {c: F.col(c) for c in filled}, {c: rows for c in filled})
        steps.append(_bucketizer(filled, [split_points(found[c].values) for c in filled]))
    bins = [f"{c}_bin" for c in filled]
    vectors = PipelineModel([*encoder, VectorAssembler(inputCols=[*bins, *slots], outputCol=FEATURES, handleInvalid="keep")])
    keys = [HELD_OUT, *bins, *places, *([LABEL] if kind == "classification" else [])]
    # Without the mark of a bucketizer that bins are categories: trees shall cut them in their order.
    plain = [F.col(k).alias(k, metadata={}) if k in bins else F.col(k) for k in dict.fromkeys([*keys, LABEL])]
    placed = PipelineModel([*steps, *labels]).transform(labelled).select(*plain)
    size = placed.agg(F.approx_count_distinct(F.struct(*keys))).first()[0]
    if size * FOLD > rows:
        return None
    of_labels = [F.avg(LABEL).alias("__mean"), F.var_pop(LABEL).alias(WITHIN)] if kind == "regression" else []
    cells = placed.groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias(WEIGHT), *of_labels)
    if kind == "regression":
        cells = cells.withColumnRenamed("__mean", LABEL)
    cells = vectors.transform(cells).persist(StorageLevel.MEMORY_AND_DISK)
    train, test = ~F.col(HELD_OUT), F.col(HELD_OUT)
    if cells.filter(train).isEmpty() or cells.filter(test).isEmpty():
        train = test = F.lit(True)
    return _Cells(placed, cells, keys, [*steps, *vectors.stages, *labels], vectors, (train, test), size // CELLS_PER_TASK + 1)


def train_best(
    df: DataFrame,
    target: str | None = None,
    problem: str | None = None,
    folds: int = 0,
    learners: Sequence[str] | None = None,
) -> TrainedModel:
    """Fit several learners and keep the one with the best score (accuracy or RMSE).

    Learners are compared on a held-out fifth of the rows, or by cross-validation with ``folds``.
    The kept model is fitted again on all rows.
    """
    target = target or df.columns[-1]
    features = [c for c in df.columns if c != target]
    if not features:
        raise ValueError("at least two columns are needed")
    kind = problem or problem_type(df, target)
    labelled = _model_ready(df.filter(ref(target).isNotNull()), features)
    if kind == "regression":
        labelled = labelled.withColumn(LABEL, ref(target).cast("double"))
    else:
        labelled = labelled.withColumn(TARGET, ref(target).cast("string"))
    rows = labelled.count()
    if not rows:
        raise ValueError("at least one row is needed")
    classes = labelled.select(ref(target)).distinct().limit(MAX_CLASSES + 1).count() if kind == "classification" else 0
    if classes > MAX_CLASSES:
        raise ValueError(f"{target!r} has more than {MAX_CLASSES} values")
    numbers, texts = _inputs(df, features)
    stages = _stages(numbers, texts, frequent_values(labelled, texts, rows), kind)
    prepared = Pipeline(stages=stages).fit(labelled)
    # The fold of a row is a fixed function of its content, so a recomputed task agrees.
    held_out = F.pmod(F.xxhash64(*[ref(c) for c in df.columns]), F.lit(5)) == 0
    evaluator = (
        RegressionEvaluator(labelCol=LABEL, metricName="rmse")
        if kind == "regression"
        else MulticlassClassificationEvaluator(labelCol=LABEL, metricName="accuracy")
    )
    scores = {}
    candidates = {n: e for n, e in _learners(kind, classes).items() if not learners or n in learners}
    trees = [n for n in candidates if _grows_trees(n)]
    cells = _cells(labelled.withColumn(HELD_OUT, held_out), prepared, numbers, texts, kind, rows) if trees and not folds else None
    ready = prepared.transform(labelled)
    if cells is None or len(trees) < len(candidates):
        ready = ready.withColumn(HELD_OUT, held_out).select(FEATURES, LABEL, HELD_OUT).persist(StorageLevel.MEMORY_AND_DISK)
        train, test = ready.filter(~F.col(HELD_OUT)), ready.filter(HELD_OUT)
        if not folds and (train.isEmpty() or test.isEmpty()):
            # Too few rows for a fifth of them to be held out: learners are compared on the rows they have seen.
            train = test = ready
    for name, learner in candidates.items():
        if folds:
            cv: CrossValidatorModel = CrossValidator(
                estimator=learner, estimatorParamMaps=ParamGridBuilder().build(), evaluator=evaluator, numFolds=folds, seed=SEED
            ).fit(ready)
            scores[name] = cv.avgMetrics[0]
        elif cells and name in trees:
            scores[name] = cells.score(cells.fit(learner, held_out=False), kind)
        else:
            scores[name] = evaluator.evaluate(learner.fit(train).transform(test))
    best = (min if kind == "regression" else max)(sorted(scores), key=scores.get)
    if cells and best in trees:
        steps = [*cells.stages, cells.fit(candidates[best])]
    else:
        steps = [*prepared.stages, candidates[best].fit(ready)]
    ready.unpersist()
    if cells:
        cells.unpersist()
    if kind == "classification":
        labels = prepared.stages[-1].labels
        steps.append(IndexToString(inputCol="prediction", outputCol=PREDICTION, labels=[*labels, "__unknown"]))
    return TrainedModel(best, kind, target, features, scores[best], rows, PipelineModel(steps))


def predict(df: DataFrame, model: TrainedModel | None = None) -> DataFrame:
    """Add ``prediction_label`` to every row; without a model one is trained on the last column."""
    model = model or train_best(df)
    ready = _model_ready(df, model.features)
    steps = model.pipeline.stages
    if model.problem == "classification":
        # The label indexer needs the target, which rows to predict need not have.
        steps = [s for s in steps if not _is_label(s)]
    scored = PipelineModel(steps).transform(ready)
    if model.problem == "regression":
        scored = scored.withColumn(PREDICTION, F.col("prediction"))
    return scored.select(*[ref(c) for c in df.columns], PREDICTION)


def contributions(model: TrainedModel, df: DataFrame, class_index: int = 0) -> DataFrame:
    """The columns of ``df`` plus ``base, contributions, output``, see :func:`plumbline.operators.contributions.explained`.

    ``contributions`` is in the order of ``model.features``. Of a classifier one class is explained, by default the first.
    """
    ready = _model_ready(df, model.features).withColumn("__row", F.struct(*[ref(c) for c in df.columns]))
    *steps, final = [s for s in model.pipeline.stages if s.__class__.__name__ != "IndexToString" and not _is_label(s)]
    vectors = PipelineModel(steps).transform(ready).select("__row", FEATURES)
    return explained(vectors, FEATURES, final, slot_features(model), class_index).select("__row.*", "base", "contributions", "output")


def explain(model: TrainedModel, df: DataFrame, k: int | None = None, class_index: int = 0) -> DataFrame:
    """The features, or the strongest ``k``, by the mean absolute contribution to the predictions of the rows of ``df``.

    ``importance`` is the share of the sum over all features. The direction of a number is negative where larger values
    contribute less; other features have no order and count as positive.
    """
    own = kinds(df)
    found = contributions(model, df, class_index)
    numbers = [i for i, c in enumerate(model.features) if own[c] in ("integer", "float")]
    sums = found.agg(
        *[F.avg(F.abs(F.get("contributions", F.lit(i)))).alias(f"c{i}") for i in range(len(model.features))],
        *[F.covar_pop(ref(model.features[i]).cast("double"), F.get("contributions", F.lit(i))).alias(f"d{i}") for i in numbers],
    ).first()
    sizes = [sums[f"c{i}"] or 0.0 for i in range(len(model.features))]
    total = sum(sizes)
    out = [
        (c, sizes[i], sizes[i] / total if total else 0.0, "negative" if i in numbers and (sums[f"d{i}"] or 0.0) < 0 else "positive")
        for i, c in enumerate(model.features)
    ]
    out.sort(key=lambda r: (-r[2], r[0]))
    return df.sparkSession.createDataFrame(out[:k], "feature string, contribution double, importance double, impact_direction string")


def _is_label(stage) -> bool:
    return stage.__class__.__name__ == "StringIndexerModel" and stage.getOutputCol() == LABEL


def save_model(model: TrainedModel, path: str, spark: SparkSession) -> None:
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    model.info(spark).withColumn("trained_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/info")


def model_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> TrainedModel:
    row = model_info(spark, path).first()
    return TrainedModel(
        row["model_type"], row["problem"], row["target"], list(row["features"]), row["score"], row["rows_trained"],
        PipelineModel.load(f"{path}/pipeline"),
    )
