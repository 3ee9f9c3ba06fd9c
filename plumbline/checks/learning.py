"""Baseline models on labelled documents. Iterative fitting cannot be written as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from plumbline.checks.tables import from_sql, load, stacked
from plumbline.operators import learning
from plumbline.session import fresh_path


def _documents(spark, sf):
    """Labelled documents with a few simple features; the quality label comes last."""
    return from_sql(
        spark, sf,
        """SELECT d.doc_id, d.n_chars, CAST(size(split(d.text, '\\\\s+')) AS BIGINT) AS words, d.lang, l.toxic,
           CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS quality FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
    )


def _features(spark, sf):
    return _documents(spark, sf).drop("doc_id")


_LINES = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_extendedprice"]


def _ml2(spark, sf):
    return learning.train_best(_features(spark, sf)).info(spark)


def _ml2_regression(spark, sf):
    return learning.train_best(load(spark, sf, "lineitem").select(*_LINES)).info(spark)


def _ml2_groups(spark, sf):
    """A tree over two text columns with few values, whose leaves are their combinations."""
    lines = load(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    model = learning.train_best(lines, learners=["DecisionTreeRegressor"])
    scored = learning.predict(lines, model).groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.min("prediction_label"), 2).alias("least"), F.round(F.max("prediction_label"), 2).alias("most"), F.count("*").alias("rows")
    )
    return scored.select("l_returnflag", "l_linestatus", "least", "most", "rows", F.lit(model.model_type).alias("model_type"), F.lit(model.rows_trained).alias("rows_trained"))


def _ml3(spark, sf):
    df = _documents(spark, sf)
    return learning.predict(df, learning.train_best(df.drop("doc_id"))).select("doc_id", "quality", "prediction_label")


def _ml4(spark, sf):
    df = _documents(spark, sf)
    return learning.explain(learning.train_best(df.drop("doc_id")), df, k=8)


def _ml4_linear(spark, sf):
    """Contributions of a plane through two features, which SQL can fit as well."""
    lines = load(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_extendedprice")
    model = learning.train_best(lines, learners=["LinearRegression"])
    out = learning.explain(model, lines)
    return out.select("feature", F.round("contribution", 1).alias("contribution"), F.round("importance", 4).alias("importance"), "impact_direction")


def _ml4_sums(spark, sf):
    """Contributions and base of each document add up to the output of the model; how many do not, for each kind of learner."""
    df = _documents(spark, sf)
    parts = []
    for name in ("LogisticRegression", "DecisionTreeClassifier", "RandomForestClassifier", "NaiveBayes"):
        model = learning.train_best(df.drop("doc_id"), learners=[name])
        off = F.abs(F.col("base") + F.aggregate("contributions", F.lit(0.0), lambda a, v: a + v) - F.col("output")) > 1e-6 * F.greatest(F.abs("output"), F.lit(1.0))
        parts.append(learning.contributions(model, df).agg(F.lit(name).alias("learner"), F.count("*").alias("rows"), F.count_if(off).alias("off")))
    return reduce(lambda x, y: x.unionAll(y), parts)


def _ml2_folds(spark, sf):
    return learning.train_best(_features(spark, sf), folds=3).info(spark)


def _ml3_linear(spark, sf):
    """A straight line through one feature, which SQL can fit as well."""
    lines = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    model = learning.train_best(lines.select("l_quantity", "l_extendedprice"), learners=["LinearRegression"])
    return learning.predict(lines, model).withColumn("prediction_label", F.round("prediction_label", 2))


def _ml5_same(spark, sf):
    """A model read back decides every row as the one that was stored."""
    df = _documents(spark, sf)
    model = learning.train_best(df.drop("doc_id"))
    path = fresh_path(spark, "model")
    learning.save_model(model, path, spark)
    own = learning.predict(df, model).select("doc_id", F.col("prediction_label").alias("own"))
    read = learning.predict(df, learning.load_model(spark, path)).select("doc_id", F.col("prediction_label").alias("read"))
    return own.join(read, "doc_id").agg(F.count("*").alias("rows"), F.count_if(F.col("own") != F.col("read")).alias("differing"))


def _ml5(spark, sf):
    df = _documents(spark, sf)
    model = learning.train_best(df.drop("doc_id"))
    path = fresh_path(spark, "model")
    learning.save_model(model, path, spark)
    scored = learning.predict(df, learning.load_model(spark, path))
    info = learning.model_info(spark, path).first()
    return scored.agg(
        F.lit(info["model_type"]).alias("model_type"),
        F.lit(info["target"]).alias("target"),
        F.lit(info["rows_trained"]).alias("rows_trained"),
        F.avg((F.col("prediction_label") == F.col("quality")).cast("double")).alias("accuracy"),
    )


QUERIES = {
    "ml1": lambda s, d: learning.problem_types(_documents(s, d)),
    "ml2": _ml2,
    "ml2_regression": _ml2_regression,
    "ml3": _ml3,
    "ml4": _ml4,
    "ml2_groups": _ml2_groups,
    "ml4_linear": _ml4_linear,
    "ml4_sums": _ml4_sums,
    "ml2_folds": _ml2_folds,
    "ml3_linear": _ml3_linear,
    "ml5": _ml5,
    "ml5_same": _ml5_same,
}

_NUMBER = r"'^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$'"

SQL = {
    "ml3_linear": """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, round(a + b * l_quantity, 2) AS prediction_label
        FROM lineitem, (SELECT regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b FROM lineitem)""",
    "ml2_groups": """SELECT l_returnflag, l_linestatus, round(avg(l_extendedprice), 2) AS least, round(avg(l_extendedprice), 2) AS most, count(*) AS rows,
        'DecisionTreeRegressor' AS model_type, (SELECT count(*) FROM lineitem) AS rows_trained FROM lineitem GROUP BY 1, 2""",
    "ml4_linear": """WITH m AS (SELECT avg(l_quantity) AS q, avg(l_discount) AS d, var_pop(l_quantity) AS vq, var_pop(l_discount) AS vd, covar_pop(l_quantity, l_discount) AS c,
        covar_pop(l_quantity, l_extendedprice) AS cq, covar_pop(l_discount, l_extendedprice) AS cd FROM lineitem),
    b AS (SELECT *, (cq * vd - cd * c) / (vq * vd - c * c) AS bq, (cd * vq - cq * c) / (vq * vd - c * c) AS bd FROM m),
    s AS (SELECT avg(abs(any_bq * (l_quantity - q))) AS tq, avg(abs(any_bd * (l_discount - d))) AS td, any_value(any_bq) AS bq, any_value(any_bd) AS bd
        FROM lineitem, (SELECT q, d, bq AS any_bq, bd AS any_bd FROM b))
    SELECT 'l_quantity' AS feature, round(tq, 1) AS contribution, round(tq / (tq + td), 4) AS importance, CASE WHEN bq < 0 THEN 'negative' ELSE 'positive' END AS impact_direction FROM s
    UNION ALL SELECT 'l_discount', round(td, 1), round(td / (tq + td), 4), CASE WHEN bd < 0 THEN 'negative' ELSE 'positive' END FROM s""",
    "ml4_sums": """SELECT l AS learner, (SELECT count(*) FROM documents JOIN labels USING (doc_id)) AS rows, 0::BIGINT AS off
        FROM (VALUES ('LogisticRegression'), ('DecisionTreeClassifier'), ('RandomForestClassifier'), ('NaiveBayes')) AS t(l)""",
    "ml5_same": "SELECT count(*) AS rows, 0::BIGINT AS differing FROM documents JOIN labels USING (doc_id)",
    "ml1": """WITH t AS (SELECT d.doc_id, d.n_chars, d.n_chars AS words, d.lang, l.toxic, CASE WHEN l.quality = 1 THEN 'good' ELSE 'poor' END AS quality
        FROM documents d JOIN labels l USING (doc_id)) """
    + stacked(
        f"SELECT '{c}' AS target, CASE WHEN count(*) FILTER (regexp_matches({c}::VARCHAR, {_NUMBER})) > 0 THEN 'regression' ELSE 'classification' END AS problem_type FROM t"
        for c in ("doc_id", "n_chars", "words", "lang", "toxic", "quality")
    ),
}
