import random
from collections import Counter

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from plumbline.operators import audit, cleaning, derive, filters, grouping, history, pii
from plumbline.plans.prepare import clean_table, prepare
from plumbline.plans.report import report_figures


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


@pytest.mark.parametrize("strategy, filled", [("mean", 30.0), ("median", 30.0), ("mode", 10.0), ("zero", 0.0)])
def test_constant_imputation(gaps, strategy, filled):
    out = cleaning.impute(gaps, strategy, ["value"])
    assert column(out, "value") == [10.0, filled, 30.0, filled, 50.0]


def test_directional_imputation(gaps):
    assert column(cleaning.impute(gaps, "forward", ["category"], ["id"]), "category") == ["A", "A", "C", "D", "D"]
    assert column(cleaning.impute(gaps, "backward", ["category"], ["id"]), "category") == ["A", "C", "C", "D", None]
    with pytest.raises(ValueError):
        cleaning.impute(gaps, "forward", ["category"])
    with pytest.raises(ValueError):
        cleaning.impute(gaps, "guess")


def test_text_columns_keep_their_nulls_under_mean(gaps):
    assert column(cleaning.impute(gaps, "mean"), "category") == ["A", None, "C", "D", None]


def test_impute_all_fills_empty_text(spark):
    df = spark.createDataFrame([(1, 1.0, "b", "7", None), (2, None, "", "", None), (3, 2.0, "b", "8", None)], "id int, x double, s string, n string, z string")
    out = cleaning.impute_all(df)
    assert column(out, "x") == [1.0, 1.5, 2.0] and column(out, "s") == ["b", "b", "b"] and column(out, "n") == ["7", "7.5", "8"]
    assert column(out, "z") == [None, None, None]


def test_cap_keeps_nulls(spark):
    df = spark.createDataFrame([(1, 5), (2, None), (3, 50)], "id int, x int")
    assert column(cleaning.cap(df, {"x": (10, 20)}), "x") == [10.0, None, 20.0]


def test_plan_is_applied_in_order_with_audit(spark):
    rows = [(i, float(i) if i % 5 else None, "x" if i % 4 else None, "mail me at ann@mail.example.com") for i in range(40)]
    df = spark.createDataFrame(rows + rows[:3] + [(40, 5000.0, "x", "none")], "id int, v double, s string, note string")
    quality, summary, cleaned, trail = clean_table(df)
    out = {r.id: r for r in cleaned.collect()}
    assert cleaned.count() == 41 and out[0].v is not None and out[40].v < 5000 and out[4].s == "x"
    assert out[1].note == "mail me at a***@mail.example.com"
    steps = trail.orderBy("sequence").collect()
    assert [(s.column, s.status) for s in steps] == [("v", "completed"), ("s", "completed"), ("v", "completed"), ("note", "completed"), ("*", "completed")]
    assert (steps[-1].rows_before, steps[-1].rows_after) == (44, 41)
    assert summary.first().quality_score < 1


def test_failed_operations_are_isolated(gaps):
    plan = [
        cleaning.CleaningOperation("value", "transform", "", {"expression": "no_such + 1"}, 0.9),
        cleaning.CleaningOperation("missing", "impute", "", {"strategy": "mean"}, 0.9),
        cleaning.CleaningOperation("value", "transform", "", {"expression": "value * 2"}, 0.9),
        cleaning.CleaningOperation("value", "cap", "", {"lower_bound": 0, "upper_bound": 30}, 0.1),
    ]
    out, trail = cleaning.apply_plan(gaps, plan)
    assert column(out, "value") == [20.0, None, 60.0, None, 100.0]
    assert [r.status for r in trail.orderBy("sequence").collect()] == ["failed", "failed", "completed"]
    given, _ = cleaning.apply_plan(gaps, plan[3:], min_confidence=None)
    assert column(given, "value") == [10.0, None, 30.0, None, 30.0]


def test_empty_plan_changes_nothing(gaps):
    out, trail = cleaning.apply_plan(gaps, [])
    assert out.collect() == gaps.collect() and trail.count() == 0
    assert len(cleaning.accepted([cleaning.CleaningOperation("a", "cap", confidence=0.2)])) == 1


MASKS = {
    "john.doe@mail.example.com": "j***@mail.example.com",
    "call +1-555-123-4567 now": "call ++***-***-4567 now",
    "SSN 123-45-6789": "SSN ***-**-6789",
    "card 4111-1111-1111-1111.": "card ****-****-****-1111.",
    "nothing here 12345": "nothing here 12345",
    "a@b.co and 555.123.4567": "a***@b.co and +***-***-4567",
}


def test_masks_inside_text(spark):
    df = spark.createDataFrame(list(enumerate(MASKS)), "id int, t string")
    assert column(pii.mask_pii(df), "t") == list(MASKS.values())
    found = {r.column: r.pii_types for r in pii.pii_report(df).collect()}
    assert found == {"t": ["email", "phone", "ssn", "credit_card"]}


def test_masks_of_whole_values(spark):
    values = ["jo@mail.example.com", "123-45-6789", "4111 1111 1111 1111", "+1 (555) 1234567", "plain", None]
    df = spark.createDataFrame(list(enumerate(values)), "id int, t string")
    assert column(pii.mask_pii_values(df), "t") == ["j***@***.example.com", "***-**-6789", "****-****-****-1111", "*******4567", "plain", None]


def test_diff_counts_changes_and_fills_apart(spark):
    before = spark.createDataFrame([(1, 1.0, "a"), (2, None, "b"), (3, 3.0, None), (4, 4.0, "d")], "id int, x double, s string")
    after = spark.createDataFrame([(1, 1.0, "A"), (2, 9.0, "b"), (3, 8.0, None)], "id int, x double, s string")
    rows = as_dict(audit.diff_columns(before, after, ["id"]), "column")
    assert (rows["x"]["changed_count"], rows["x"]["filled_count"]) == (1, 1)
    assert (rows["s"]["changed_count"], rows["s"]["filled_count"], rows["s"]["change_percentage"]) == (1, 0, 25.0)
    samples = audit.diff_samples(before, after, ["id"], 1).collect()
    assert {(r.column, r.before, r.after) for r in samples} == {("x", None, "9"), ("s", "a", "A")}
    assert audit.diff_summary(before, after, ["id"]).first().cleaned_rows == 3


def brute_diff(before, after):
    """Per column changed and filled cells of keys that both versions hold once, and rows left over under repeated keys."""
    by = lambda rows: {k: [r for r in rows if r[0] == k] for k in {r[0] for r in rows}}
    old, new, changed, filled, left = by(before), by(after), [0, 0], [0, 0], [0, 0]
    for k in set(old) | set(new):
        x, y = old.get(k, []), new.get(k, [])
        if len(x) > 1 or len(y) > 1:
            left[0] += (Counter(x) - Counter(y)).total()
            left[1] += (Counter(y) - Counter(x)).total()
        elif x and y:
            for i in (0, 1):
                a, b = x[0][1 + i], y[0][1 + i]
                changed[i] += a is not None and a != b
                filled[i] += a is None and b is not None
    return changed, filled, left


@pytest.mark.parametrize("seed", [1, 2])
def test_versions_with_repeated_and_null_keys_are_compared_as_multisets(spark, seed):
    rng = random.Random(seed)
    row = lambda: (rng.choice([None, *range(30)]), rng.choice([None, 0.0, -0.0, 1.5]), rng.choice([None, "a", "b"]))
    before = [row() for _ in range(60)] + [(None, 1.5, "a")] * 5 + [(100 + k, 1.0, None) for k in range(40)]
    after = [r if rng.random() < 0.6 else row() for r in before if rng.random() < 0.9] + [(200, None, None)]
    frames = [spark.createDataFrame(rows, "id int, x double, s string") for rows in (before, after)]
    changed, filled, left = brute_diff(before, after)
    rows = as_dict(audit.diff_columns(*frames, ["id"]), "column")
    assert [(rows[c]["changed_count"], rows[c]["filled_count"]) for c in ("x", "s")] == list(zip(changed, filled))
    total = audit.diff_summary(*frames, ["id"]).first()
    assert (total.original_rows, total.cleaned_rows, total.repeated_before, total.repeated_after) == (len(before), len(after), *left)


def test_equal_versions_of_many_columns_and_other_types(spark):
    names = [f"c{i}" for i in range(45)]
    before = spark.createDataFrame([(k, *range(45)) for k in range(5)], ", ".join(["k int", *[f"{n} int" for n in names]]))
    after = before.select("k", *[F.col(n).cast("double") if i % 2 else F.col(n).cast("string") for i, n in enumerate(names)])
    out = audit.diff_columns(before, after, ["k"]).collect()
    assert len(out) == 45 and sum(r.changed_count + r.filled_count for r in out) == 0
    assert audit.diff_samples(before, after, ["k"]).count() == 0
    assert audit.diff_summary(before.limit(0), after.limit(0), ["k"]).first().total_changes == 0


def test_derived_columns(people):
    out = derive.derive(derive.derive(people, "sum", "age + salary"), "per_year", "salary / age").orderBy("id").first()
    assert (out["sum"], out["per_year"]) == (50025, 2000)
    table, trail = derive.derive_all(people, [derive.DerivedColumn("a", "age * 2"), derive.DerivedColumn("b", "no_such"), derive.DerivedColumn("c", "sum(age)"), derive.DerivedColumn("d", "explode(array(1, 2))")])
    assert table.columns == people.columns + ["a"]
    assert [r.status for r in trail.orderBy("sequence").collect()] == ["completed", "failed", "failed", "failed"]


def test_suggested_columns_leave_room(people):
    assert [s.name for s in derive.suggest_derived(people)] == ["id_to_age_ratio", "age_to_salary_ratio", "id_minus_age", "avg_top_3_numeric"]
    wide = people.select(*[F.col("age").alias(f"c{i}") for i in range(9)])
    assert len(derive.suggest_derived(wide)) == 5


def test_bins_and_row_average(spark):
    df = spark.createDataFrame([(1, 18, None), (2, 19, 1.0), (3, 130, None)], "id int, age int, x double")
    out = derive.derive_bins(df, "age", [0, 18, 35, 55, 120], ["child", "young", "middle", "senior"])
    assert column(out, "age_bin") == ["child", "young", None]
    assert column(derive.derive_row_average(df, ["age", "x"]), "avg_top_3_numeric") == [18.0, 10.0, 130.0]


def test_validation_counts_nan_and_infinity(spark):
    df = spark.createDataFrame([(float("nan"), 0.0), (float("inf"), -1.0), (1.0, None)], "a double, b double")
    specs = [derive.DerivedColumn("a", ""), derive.DerivedColumn("b", "", "double", ("no_null", "non_negative", "no_zero_denominator", "other"))]
    rows = as_dict(derive.validate_columns(df, specs, expected_rows=3), "column")
    assert rows["a"]["errors"] == ["nan_values", "infinite_values"]
    assert rows["b"]["errors"] == ["no_zero_denominator", "non_negative", "no_null"]


def test_group_aggregate_of_no_numbers_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", "x"), ("b", "4")], "k string, v string")
    out = as_dict(grouping.group_aggregate(df, ["k"], {"n": ("COUNT", "v"), "s": ("SUM", "v"), "m": ("AVG", "v"), "lo": ("MIN", "v")}), "k")
    assert out["a"] == {"k": "a", "n": 2, "s": 0, "m": 0, "lo": 0} and out["b"]["s"] == 4


def test_sql_takes_one_select(people):
    out = grouping.sql_query(people, "SELECT department, count(*) AS n FROM dataset WHERE age > 25 GROUP BY department HAVING count(*) > 1 ORDER BY n DESC LIMIT 5")
    assert [tuple(r) for r in out.collect()] == [("Marketing", 2)]
    for bad in ("DROP TABLE dataset", ""):
        with pytest.raises(ValueError):
            grouping.sql_query(people, bad)


def test_summaries(spark, people):
    assert grouping.summarize_all(people).first().avg_age == 35
    assert grouping.summarize_all(spark.createDataFrame([("x",)], "s string")).first().message
    assert [r.column for r in grouping.kpi_cards(people).collect()] == ["id", "age", "salary"]


def test_latency_nearest_rank(spark):
    df = spark.createDataFrame([("a", i / 100.0, 200 if i % 10 else 500) for i in range(100)] + [("b", 4.0, 200)], "e string, s double, st int")
    rows = as_dict(grouping.latency_stats(df, "e", "s", "st", rows_per_bucket=10), "e")
    assert (rows["a"]["p50_ms"], rows["a"]["p95_ms"], rows["a"]["p99_ms"]) == (500.0, 950.0, 990.0)
    assert rows["a"]["success_rate"] == 90.0 and rows["b"]["slow_severe"] == 1 and rows["b"]["std_dev_ms"] == 0


def test_fetch_and_panel(people):
    assert [r.id for r in filters.fetch(people, {"department": "Engineering"}, [F.desc("age")], 1, 1).collect()] == [1]
    assert filters.filter_panel(people, "age", 30, "name", "E").count() == 2
    assert filters.preview(people, ["id"], 2, 3).first().name == "Ali"


def test_pattern_scan_reads_whole_texts(spark):
    texts = ["x" * 20000 + " select a from b", "fine", "<SCRIPT>1</script>", "..%2Fetc"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    out = {r.id: (r.sql_injection_hits, r.suspicious_hits, r.path_traversal_hits) for r in filters.scan_patterns(df, "t").collect()}
    assert out == {0: ([1], [6], []), 2: ([], [1], []), 3: ([], [], [3])}


def test_versions(spark):
    rows = spark.createDataFrame([("r", 1, 10, "a"), ("r", 2, 20, "b"), ("q", 3, 15, "c")], "k string, version int, at int, body string")
    back = history.revert_to(rows, "k", "r", "version", 1, "at", 30)
    assert as_dict(history.current_versions(back, "k", "at", "version"), "k")["r"]["body"] == "a"
    assert [r.body for r in history.version_history(back, "k", "r", "at").collect()] == ["a", "b", "a"]


def test_whole_preparation(spark):
    rows = [(str(i), f"2024-01-{i % 28 + 1:02d}", str(i * 2.5) if i % 6 else None, "ab"[i % 2]) for i in range(60)]
    raw = spark.createDataFrame(rows, "id string, day string, amount string, grp string")
    done = prepare(raw, ["id"])
    assert dict(done.typed.dtypes)["day"] == "timestamp_ntz" and dict(done.typed.dtypes)["amount"] == "double"
    assert done.enriched.count() == 60 and done.cleaned.filter("amount is null").count() == 0
    assert done.relationships.count() >= 1 and done.audit.count() >= 2


def test_report_figures(spark, people):
    df = people.withColumn("join_date", F.concat(F.lit("2024-01-0"), F.col("id").cast("string")))
    figures = report_figures(df, "people", ["id"])
    assert figures.schema.count() == 6 and figures.date_column == "join_date"
    assert {"cv", "p99"} <= set(figures.univariate.columns) and figures.trends.count() == 3
    assert figures.seasonality(df, "salary").count() == 7
