import math
import random
import statistics

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from plumbline.operators import outliers, profile, quality
from plumbline.operators.quantiles import order_statistics, quantile_table


def test_profile_schema(people):
    rows = as_dict(profile.profile_schema(people, ["id"]), "column")
    assert len(rows) == 5
    assert rows["age"]["is_numeric"] and not rows["name"]["is_numeric"]
    assert rows["department"]["cardinality"] == 3 and rows["department"]["cardinality_ratio"] == 60.0
    assert rows["name"]["samples"] == ["Alice", "Bob", "Charlie", "Diana", "Eve"]


def test_null_counts_as_a_value(gaps):
    rows = as_dict(profile.profile_schema(gaps), "column")
    assert rows["value"]["null_count"] == 2 and rows["value"]["null_percentage"] == 40.0
    assert rows["value"]["cardinality"] == 4
    assert as_dict(profile.cardinality(gaps), "column")["value"]["distinct_values"] == 3


def test_schema_summary(people):
    row = profile.schema_summary(profile.profile_schema(people)).first()
    assert (row.total_columns, row.numeric_columns, row.categorical_columns, row.datetime_columns, row.text_columns) == (5, 3, 5, 0, 0)


def test_univariate_stats(people):
    age = as_dict(profile.univariate_stats(people), "column")["age"]
    assert (age["mean"], age["min"], age["max"], age["median"], age["q1"], age["q3"], age["count"]) == (35, 25, 45, 35, 30, 40, 5)
    assert age["std"] == pytest.approx(statistics.stdev([25, 30, 35, 40, 45]))
    assert age["kurtosis"] == pytest.approx(-1.3)


@pytest.mark.parametrize("rows", [[], [(None,)], [(None,), (None,)]])
def test_columns_without_values_are_left_out(spark, rows):
    df = spark.createDataFrame(rows, "x double")
    assert profile.univariate_stats(df).count() == 0
    assert outliers.outliers_iqr(df).count() == 0
    assert outliers.outliers_zscore(df).count() == 0


def test_single_and_constant_values(spark):
    one = profile.univariate_stats(spark.createDataFrame([(3.0,)], "x double")).first()
    assert (one.std, one.variance, one.skewness, one.kurtosis, one.iqr) == (0, 0, 0, 0, 0)
    flat = spark.createDataFrame([(3.0,)] * 6, "x double")
    assert profile.univariate_stats(flat).first().skewness is None
    z = outliers.outliers_zscore(flat).first()
    assert (z.outlier_count, z.max_zscore) == (0, 0)


def test_detailed_mode_prefers_the_smallest_value(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, 5, 2, 2, 9]] + [(math.inf,)], "x double")
    row = profile.univariate_detailed(df).first()
    assert (row.mode, row.mode_count, row.inf_count) == (2, 2, 1)
    steady = profile.univariate_detailed(spark.createDataFrame([(float(v),) for v in range(1, 101)], "x double")).first()
    assert steady.range == 99 and steady.p1 == pytest.approx(1.99) and steady.p99 == pytest.approx(99.01)
    assert steady.cv == round(statistics.stdev(range(1, 101)) / 50.5, 4)


def test_nearest_rank_quartiles(spark):
    row = profile.univariate_stats_nearest(spark.createDataFrame([(v,) for v in [1, 2, 3, 4]], "x long")).first()
    assert (row.q1, row.median, row.q3) == (2, 2.5, 4)


def test_types_by_cells(spark):
    df = spark.createDataFrame(
        [(1, "true", "1.5", "2024-01-01", "x", None), (2, "false", "-2e3", "later", "1d", None)],
        "id int, flag string, num string, day string, word string, none string",
    )
    rows = as_dict(profile.column_types(df, ["id"]), "column")
    assert [rows[c]["dtype"] for c in df.columns] == ["number", "boolean", "number", "date", "string", "unknown"]
    assert profile.loose_numeric_columns(df) == ["id", "num"]


def test_inferred_types(spark):
    rows = [
        (i, i % 2, "2024-01-15", "2024-01-15T10:20", "ab"[i % 2], f"${i},000", "long text " * 8 + str(i % 15), f"w{i % 15}", None) for i in range(30)
    ]
    df = spark.createDataFrame(rows, "id int, bit int, day string, at string, cat string, money string, prose string, word string, none string")
    found = as_dict(profile.infer_types(df, ["id"]), "column")
    assert {c: r["detected_type"] for c, r in found.items()} == {
        "id": "int", "bit": "boolean", "day": "date", "at": "datetime", "cat": "categorical", "money": "float", "prose": "text",
        "word": "str", "none": "categorical",
    }
    assert found["day"]["format_spec"] == "%Y-%m-%d" and found["at"]["format_spec"] == "%Y-%m-%dT%H:%M:%S"
    assert found["none"]["nullable"] and not found["id"]["nullable"]


def test_confidence_bands(spark):
    df = spark.createDataFrame([(0.95,), (0.80,), (0.75,), (0.60,), (0.40,), (0.30,)], "confidence double")
    colors = [r.color for r in profile.with_confidence_level(df).collect()]
    assert colors == ["green", "yellow", "yellow", "orange", "red", "red"]
    assert profile.overall_confidence(df).first()[0] == round(3.8 / 6, 4)


@pytest.mark.parametrize("seed", range(3))
def test_bracketed_quantiles_equal_sorted_values(spark, seed):
    """Hot values, ties, nulls, infinities and NaN, with brackets that need several rounds."""
    rng = random.Random(seed)
    values = [7.0] * 8000 + [rng.gauss(0, 10) for _ in range(12000)] + [float(rng.randrange(5)) for _ in range(4000)]
    values += [math.inf] * 20 + [-math.inf] * 20
    rng.shuffle(values)
    df = spark.createDataFrame([(v if rng.random() > 0.05 else None,) for v in values] , "x double").repartition(4).cache()
    kept = sorted(r.x for r in df.collect() if r.x is not None)
    counts, found = order_statistics(df, {"x": lambda n: [0, 5, n // 4, n // 2, int(n * 0.9), n - 1]}, bracket_rows=50)
    assert counts["x"] == len(kept)
    assert all(value == kept[rank] for (_, rank), value in found.items()) and len(found) == 6
    few = quantile_table(df, ["x"], {"q": 0.37}, percentile_rows=10, bracket_rows=50).first().q
    assert few == pytest.approx(quantile_table(df, ["x"], {"q": 0.37}, percentile_rows=10**9).first().q)
    df.unpersist()


def test_iqr_and_zscore_outliers(spark):
    rng = random.Random(42)
    values = [rng.gauss(50, 10) for _ in range(100)] + [5.0, 95.0, 100.0, 120.0, 2.0]
    df = spark.createDataFrame([(v,) for v in values], "values double")
    assert outliers.outliers_iqr(df).first().outlier_count > 0
    assert outliers.outliers_zscore(df).first().outlier_count > 0
    small = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 100]], "x int")
    assert [r.x for r in outliers.flag_outliers_iqr(small, "x").filter("is_outlier").collect()] == [100]
    assert [r.x for r in outliers.flag_outliers_zscore(small, "x", 2.0).filter("is_outlier").collect()] == [100]


def test_duplicates_count_all_members_or_extra_copies(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, s string")
    row = quality.duplicate_rows(df).first()
    assert (row.rows, row.duplicate_count, row.surplus_copies, row.has_duplicate_rows) == (6, 5, 3, True)
    empty = quality.duplicate_rows(df.limit(0)).first()
    assert (empty.duplicate_count, empty.has_duplicate_rows) == (0, False)


def test_quality_scores(spark):
    df = spark.createDataFrame(
        [("Ann", 30, 50, "HR"), ("Bo", None, 60, "IT"), ("Cy", 40, None, None), ("Di", 50, 80, "IT"), ("Ed", 60, 90, "HR")],
        "name string, age long, salary long, department string",
    )
    columns, summary = quality.quality_profile(df, ["name"])
    assert as_dict(columns, "column")["age"]["cardinality_ratio"] == 1.25
    row = summary.first()
    assert (row.total_cells, row.total_missing, row.columns_with_missing, row.missing_percentage) == (20, 3, 3, 15.0)
    assert row.quality_score == round(1 - 3 / 20 * 0.4, 4)
    blank = spark.createDataFrame([("",), ("x",), ("x",), (None,)], "s string")
    metrics = quality.quality_metrics(blank).first()
    assert (metrics.total_missing, metrics.duplicate_rows, metrics.quality_score) == (2, 1, round(1 - 0.5 - 0.025, 4))
    assert quality.quality_metrics(blank.limit(0)).first().quality_score == 1


def test_personal_data_lowers_the_score(spark):
    df = spark.createDataFrame([("write to ann@mail.example.com", 1), ("nothing", 2)], "note string, x int")
    assert quality.quality_profile(df)[1].first().quality_score == 0.95


def test_nan_and_columns_with_odd_names(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, 3)], "`a b.c` double, `x``y` int")
    assert {r.column for r in profile.univariate_stats(df).collect()} == {"a b.c", "x`y"}
    assert profile.profile_schema(df.withColumn("v", F.array(F.lit(1)))).count() == 3
