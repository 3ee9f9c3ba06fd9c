import math
import random

import pytest
from conftest import as_dict
from pyspark.sql import functions as F

from plumbline.functions.student_t import correlation_p_value
from plumbline.operators import correlation, domains, joins, relationships, trends
from plumbline.operators.ordering import directional_fill, row_index, value_ranks, with_buckets


def pairs(df, name="r"):
    return {(r.source_column, r.target_column): r[name] for r in df.collect()}


def test_pearson(spark):
    exact = spark.createDataFrame([(i, 2 * i) for i in range(1, 6)], "x long, y long")
    assert pairs(correlation.pearson_matrix(exact))[("x", "y")] == pytest.approx(1)
    weak = spark.createDataFrame(list(zip(range(1, 6), [5, 1, 8, 2, 3])), "x long, y long")
    assert abs(pairs(correlation.pearson_matrix(weak))[("x", "y")]) < 0.5


def test_undefined_correlations_are_zero(spark):
    df = spark.createDataFrame([(1.0, 4.0, 1.0, None), (2.0, 4.0, math.nan, 2.0), (3.0, 4.0, 2.0, 5.0)], "x double, flat double, bad double, few double")
    for matrix in (correlation.pearson_matrix(df), correlation.spearman_matrix(df)):
        found = pairs(matrix)
        assert found[("x", "flat")] == 0 and found[("x", "few")] == 0 and found[("few", "few")] == 1
    assert pairs(correlation.pearson_matrix(df))[("x", "bad")] == 0


def _average_ranks(values):
    ordered = sorted(values)
    return [ordered.index(v) + (ordered.count(v) + 1) / 2 for v in values]


def test_spearman_ranks_within_complete_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(12), float(rng.randrange(9)) if rng.random() > 0.3 else None, 1 if rng.random() < 0.7 else rng.randrange(40)) for _ in range(300)]
    df = spark.createDataFrame(rows, "a long, b double, c int")
    found = correlation.spearman_pairs(df, ["a", "b", "c"])
    for (x, y), (i, j) in {("a", "b"): (0, 1), ("a", "c"): (0, 2), ("b", "c"): (1, 2)}.items():
        full = [r for r in rows if r[i] is not None and r[j] is not None]
        u, v = _average_ranks([r[i] for r in full]), _average_ranks([r[j] for r in full])
        mu, mv = sum(u) / len(u), sum(v) / len(v)
        rho = sum((p - mu) * (q - mv) for p, q in zip(u, v)) / math.sqrt(sum((p - mu) ** 2 for p in u) * sum((q - mv) ** 2 for q in v))
        assert found[(x, y)] == (pytest.approx(rho, abs=1e-9), len(full))


def test_spearman_tells_large_integers_apart(spark):
    big = 2**60
    df = spark.createDataFrame([(big + i, i) for i in range(50)], "a long, b long")
    assert correlation.spearman_pairs(df, ["a", "b"])[("a", "b")][0] == pytest.approx(1)


@pytest.mark.parametrize("r, n, p", [(0.5, 10, 0.141113), (0.9, 5, 0.037386), (-0.3, 100, 0.002425), (0.0, 30, 1.0), (1.0, 9, 0.0), (0.4, 2, 1.0)])
def test_p_values(r, n, p):
    assert correlation_p_value(r, n) == pytest.approx(p, abs=2e-6)


def test_bivariate(spark):
    df = spark.createDataFrame([(i, i * i) for i in range(1, 11)], "x long, y long")
    row = [r for r in correlation.bivariate(df).collect() if (r.source_column, r.target_column) == ("y", "x")][0]
    assert (row.spearman_r, row.sample_size, row.significant, row.strength) == (1.0, 10, True, "very_strong")
    same = [r for r in correlation.bivariate(df).collect() if r.source_column == r.target_column]
    assert all((r.pearson_r, r.p_value, r.sample_size) == (1.0, 0.0, 10) for r in same)


def test_value_overlap(spark):
    df = spark.createDataFrame([("A", "A"), ("B", "B"), ("C", "C"), ("D", "E")], "col1 string, col2 string")
    row = relationships.value_overlap(df).first()
    assert (row.overlap_count, row.overlap_ratio) == (3, 0.75)


def test_overlap_compares_numbers_but_not_text_with_numbers(spark):
    df = spark.createDataFrame([(1, 1.0, "1"), (2, 2.5, "2")], "i int, d double, s string")
    found = {(r.source_column, r.target_column): r.overlap_count for r in relationships.value_overlap(df).collect()}
    assert found == {("i", "d"): 1}


def test_overlap_of_more_columns_than_bits(spark):
    df = spark.range(3).select(*[(F.col("id") + i).alias(f"c{i}") for i in range(70)])
    found = {(r.source_column, r.target_column): r.overlap_count for r in relationships.value_overlap(df).collect()}
    assert found[("c0", "c1")] == 2 and found[("c61", "c62")] == 2 and found[("c68", "c69")] == 2 and ("c0", "c69") not in found


def test_candidates_and_classification(spark):
    df = spark.createDataFrame([(i, 2 * i, -i, f"k{i}", f"k{i}") for i in range(20)], "a long, b long, c long, s string, t string")
    found = relationships.relationship_candidates(df)
    kinds = {(r.source_column, r.target_column): r.relationship_type for r in relationships.classify_relationships(found).collect()}
    assert kinds[("a", "b")] == "one-to-one" and kinds[("a", "c")] == "many-to-many" and kinds[("s", "t")] == "one-to-many"
    checks = as_dict(relationships.validate_relationships(relationships.classify_relationships(found), df.columns), "check")
    assert all(c["passed"] for c in checks.values())
    none = as_dict(relationships.validate_relationships(relationships.classify_relationships(found).limit(0), df.columns), "check")
    assert not none["minimum_relationships"]["passed"]


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(None, 1), ("", 2), ("1", 3), ("1", 4), ("lone", 5)], "k string, v long")
    right = spark.createDataFrame([(1.0, "one"), (None, "none"), (1.0, "uno"), (9.0, "nine")], "k double, w string")
    return left, right


@pytest.mark.parametrize("how, rows", [("inner", 6), ("left", 7), ("right", 7), ("outer", 8)])
def test_join_keys_compare_as_text(sides, how, rows):
    out = joins.join(*sides, "k", "k", how).collect()
    assert len(out) == rows
    assert {r.source_v for r in out if r.target_w == "none"} == {1, 2}
    assert {r.source_v for r in out if r.target_w == "uno"} == {3, 4}
    if how in ("right", "outer"):
        assert [(r.k, r.source_v) for r in out if r.target_w == "nine"] == [("9", None)]


def test_integer_keys_of_different_width(spark):
    left = spark.createDataFrame([(1, "a"), (None, "b")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k2 long, w string")
    assert sorted((r.k or 0, r.target_w) for r in joins.join(left, right, "k", "k2", "outer").collect()) == [(0, "y"), (1, "x"), (3, "z")]


def test_relation_store(spark, tmp_path, sides):
    store = joins.RelationStore(spark, str(tmp_path))
    assert store.list().count() == 0
    relation = joins.Relation("r1", "l", "k", "r", "k", "left")
    store.define(relation)
    assert store.get("r1") == relation
    tables = {"l": sides[0], "r": sides[1]}
    assert store.materialize("r1", tables).count() == 7 and store.materialize("r1", tables).count() == 7
    store.drop("r1")
    assert store.list().count() == 0
    with pytest.raises(KeyError):
        store.get("r1")


def test_cross_relations(spark):
    tables = {
        "orders": spark.createDataFrame([(1, 7)], "id int, `Customer-ID` int"),
        "customers": spark.createDataFrame([(7, 7, "x")], "id int, customer_id int, name string"),
    }
    found = joins.discover_cross_relations(tables)
    assert [(r.source_table, r.source_column, r.target_column) for r in found.collect()] == [("orders", "Customer-ID", "customer_id")]
    ranked = joins.rank_cross_relations(found, tables).first()
    assert (ranked.overlap_count, ranked.overlap_ratio) == (1, 1.0)
    known = joins.relations_frame(spark, [joins.Relation("x", "customers", "customer_id", "orders", "Customer-ID")])
    assert joins.discover_cross_relations(tables, known).count() == 0
    assert joins.discover_cross_relations({"customer": tables["customers"], "b": spark.createDataFrame([(1,)], "customer_id int")}, id_rule=True).count() == 2


def test_buckets_split_hot_values(spark):
    df = spark.range(40000).select(
        F.when(F.col("id") % 3 == 0, 5).when(F.col("id") % 3 == 1, F.col("id") % 1000).alias("a"), F.xxhash64("id").alias("b"), "id"
    )
    placed = with_buckets(df, ["a", "b"], 1000)
    assert placed.groupBy("__bucket").count().agg(F.max("count")).first()[0] <= 2000
    indexed = row_index(df, ["a", "b"], rows_per_bucket=1000)
    ordered = indexed.orderBy("a", "b").select("row_index").collect()
    assert [r[0] for r in ordered] == list(range(40000))


@pytest.mark.parametrize(
    "order",
    [
        ["DATE '2024-01-01' + int(id % 3)", "'open'", "id"],  # only the third column tells rows apart
        ["id div 4000", "id"],  # the second column grows with the first
        ["concat('Customer#00000', lpad(id, 9, '0'))"],  # a long common beginning
    ],
)
def test_buckets_split_by_the_whole_tuple(spark, order):
    df = spark.range(40000).selectExpr("id", *[f"{e} AS o{i}" for i, e in enumerate(order)])
    names = [f"o{i}" for i in range(len(order))]
    sizes = with_buckets(df, names, 1000).groupBy("__bucket").count()
    assert sizes.agg(F.max("count")).first()[0] <= 2000
    indexed = row_index(df, names, rows_per_bucket=1000).orderBy(*names).select("row_index").collect()
    assert [r[0] for r in indexed] == list(range(40000))


@pytest.mark.parametrize("direction", ["forward", "backward"])
def test_directional_fill_matches_one_window(spark, direction):
    df = spark.range(5000).select("id", (F.col("id") % 3).alias("k"), F.xxhash64("id").alias("o"), F.when(F.hash("id") % 11 == 0, F.col("id")).alias("v"))
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW" if direction == "forward" else "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"
    function = "last" if direction == "forward" else "first"
    want = {r.id: r.w for r in df.withColumn("w", F.expr(f"{function}(v, true) OVER (PARTITION BY k ORDER BY o {frame})")).collect()}
    got = {r.id: r.v for r in directional_fill(df, ["v"], ["o"], ["k"], direction, rows_per_bucket=100).collect()}
    assert got == want


def test_grouped_ranks(spark):
    df = spark.range(3000).select((F.col("id") % 2).alias("k"), (F.hash("id") % 100).alias("v"))
    ranks = value_ranks(df, ["v"], ["k"], rows_per_bucket=100).collect()
    for k in (0, 1):
        values = sorted(r.v for r in df.filter(F.col("k") == k).collect())
        assert all(r.below == values.index(r.v) and r.n == values.count(r.v) and r.total == 1500 for r in ranks if r.k == k)


def test_trend_orders_by_date(spark):
    df = spark.createDataFrame([("2024-01-03", 30.0), ("2024-01-01", 10.0), ("2024-01-02", None), ("2024-01-04", 40.0)], "day string, v double")
    assert trends.first_date_column(df) == "day"
    timed = trends.as_time(df, "day")
    row = trends.linear_trend(timed, ["day"]).first()
    assert (row.direction, row.slope, row.change_pct) == ("increasing", 11.0, 300.0)
    assert trends.date_range(timed, "day").first().span_days == 3


def test_trend_needs_three_values(spark):
    df = spark.createDataFrame([("2024-01-03", 30.0), ("2024-01-01", 10.0)], "day string, v double")
    assert trends.linear_trend(trends.as_time(df, "day"), ["day"]).count() == 0


def test_subject_areas(spark):
    tables = {
        "shop": spark.createDataFrame([("a", 1, "b", 2)], "product string, price int, customer string, order_amount int"),
        "none": spark.createDataFrame([(1, 2, 3)], "a int, b int, c int"),
        "home": spark.createDataFrame([(1, 2, 3)], "real int, estate int, price int"),
    }
    found = as_dict(domains.infer_domains(domains.column_catalog(tables)), "table_name")
    assert found["shop"]["label"].startswith("retail_ecommerce") and "none" not in found
    assert found["home"]["label"] == "finance/real_estate"


@pytest.mark.parametrize("how", ["inner", "left", "right", "outer"])
def test_rows_without_a_key_stay_apart_until_asked(spark, how):
    left = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), ("b", 4), ("a", 5)], "k string, x int")
    right = spark.createDataFrame([(None, 1), ("", 2), ("a", 3), ("c", 4)], "k string, y int")
    for rows in (right, right.filter("k IS NOT NULL AND k <> ''")):
        found = joins.factorised(left, rows, "k", "k", how)
        whole = joins.join(left, rows, "k", "k", how)
        show = lambda df: sorted(map(repr, df.collect()))
        assert show(found.expanded()) == show(whole) and found.rows() == whole.count()
        assert found.source_blank.count() == 2
        counts = {r.key: r.joined_rows for r in joins.join_counts(left, rows, "k", "k", how).collect()}
        assert sum(counts.values()) == whole.count()


@pytest.mark.parametrize("how", joins.JOIN_TYPES)
def test_pairs_of_a_frequent_key_are_formed_in_many_partitions(spark, monkeypatch, how):
    """Equal rows among them, null as a frequent key too, and keys that only one side has."""
    monkeypatch.setattr(joins, "CELL_ROWS", 10)
    left = [(7, i // 2) for i in range(95)] + [(None, i) for i in range(12)] + [(i, i) for i in range(20, 30)]
    right = [(7, i // 3) for i in range(60)] + [(None, i) for i in range(11)] + [(i, i) for i in range(25, 40)]
    source, target = spark.createDataFrame(left, "k bigint, a bigint"), spark.createDataFrame(right, "k bigint, b bigint")
    want = [(k, a, b) for k, a in left for k2, b in right if k == k2]
    want += [(k, a, None) for k, a in left if how in ("left", "outer") and k not in [r[0] for r in right]]
    want += [(k, None, b) for k, b in right if how in ("right", "outer") and k not in [r[0] for r in left]]
    found = joins.join(source, target, "k", "k", how)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    shares = [r["count"] for r in found.filter("k = 7").groupBy(F.spark_partition_id()).count().collect()]
    assert len(shares) > 8 and max(shares) < 95 * 60 / 4


@pytest.mark.parametrize("how", joins.JOIN_TYPES)
def test_pairs_of_a_frequent_key_run_through_lists(spark, monkeypatch, how):
    """A cell looks up one list for a row of the other side, not one row for each pair, and no anti join reads rows of hot keys."""
    monkeypatch.setattr(joins, "CELL_ROWS", 4)
    left = [(k, None if i % 5 == 0 else f"a{i}", [i]) for k, n in ((None, 9), (3, 13), (5, 1), (8, 2)) for i in range(n)]
    right = [(k, None if i % 4 == 0 else i // 2) for k, n in ((None, 7), (3, 10), (5, 2), (9, 3)) for i in range(n)]
    source, target = spark.createDataFrame(left, "k bigint, a string, c array<int>"), spark.createDataFrame(right, "k bigint, b int")
    want = [(*x, b) for x in left for k, b in right if x[0] == k]
    want += [(8, a, c, None) for k, a, c in left if k == 8 and how in ("left", "outer")]
    want += [(9, None, None, b) for k, b in right if k == 9 and how in ("right", "outer")]
    found = joins.join(source, target, "k", "k", how)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate inline") == 1
    keyed = lambda df, name: df.withColumns({name[:3] + "k": F.col("k"), name[:3] + "v": F.col("k")}).drop("k")
    pairs, one, other = joins._pairs(keyed(source, "__s"), keyed(target, "__t"))
    assert {r["__sk"] for r in one.collect()} == {5, 8} and {r["__tk"] for r in other.collect()} == {5, 9}
    assert sum(p.count() for p in pairs) == 9 * 7 + 13 * 10 + 2
