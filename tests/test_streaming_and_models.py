import math
import os
import random
import statistics

import numpy as np
import pytest
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F

from __spark_entry__ import queries
from plumbline import session
from plumbline.operators import contributions, learning, ordering
from plumbline.streaming import files, latency, rates


def _log(spark, seed, n=1500):
    rng, t, rows = random.Random(seed), 0, []
    for i in range(n):
        t += rng.choice([0, 1, 1, 2, 5, 40, 200]) if rng.random() < 0.05 else rng.choice([0, 1, 2])
        rows.append((i, rng.choice("aab"), rng.choice(["auth", "other"]), t * 333333))
    df = spark.createDataFrame(rows, "id int, k string, c string, m bigint").withColumn("ts", F.timestamp_micros("m")).drop("m")
    return rows, df


def _decide(rows, limit_of, span):
    recent, allowed = {}, {}
    for i, k, c, at in sorted(rows, key=lambda r: (r[3], r[0])):
        kept = [x for x in recent.get((k, c), []) if x > at - span]
        allowed[i] = len(kept) < limit_of(c)
        recent[(k, c)] = kept + [at] * allowed[i]
    return allowed


@pytest.mark.parametrize("seed, window, slice_rows", [(1, 10, 100_000), (2, 30, 7), (3, 10, 1)])
def test_rate_decisions_match_brute_force(spark, seed, window, slice_rows):
    rows, df = _log(spark, seed, 1500 if slice_rows > 1 else 300)
    got = rates.rate_decisions(df, "k", "ts", "id", "c", window, {"auth": 2}, 5, slice_rows)
    want = _decide(rows, lambda c: 2 if c == "auth" else 5, window * 1_000_000)
    assert {r.id: r.allowed for r in got.collect()} == want and 0 < sum(want.values()) < len(want)


def test_rate_flags_match_brute_force(spark):
    rows, df = _log(spark, 3, 600)
    got = {r.id: (r.in_window, r.exceeded) for r in rates.rate_flags(df, "k", "ts", "c", 10, {"auth": 2}, 5).collect()}
    for i, k, c, at in rows:
        n = sum(1 for _, k2, c2, at2 in rows if (k2, c2) == (k, c) and at - 10_000_000 <= at2 <= at)
        assert got[i] == (n, n > (2 if c == "auth" else 5))


def test_a_busy_pair_is_summed_in_many_buckets(spark, monkeypatch):
    """All requests within one window: no bucket has more than a share of them, and sums are carried on between buckets."""
    seen = []
    monkeypatch.setattr(ordering, "stored", lambda df, name: seen.append(session.stored(df, name)) or seen[-1])
    log = spark.range(400).select("id", F.lit("a").alias("k"), F.timestamp_millis(F.floor(F.col("id") / 2) + 1_700_000_000_000).alias("ts"))
    log = log.unionByName(spark.range(400, 402).select("id", F.lit("a").alias("k"), F.lit(None).cast("timestamp").alias("ts")))
    got = {r.id: r.in_window for r in rates.rate_flags(log, "k", "ts", window=3600).collect()}
    assert got == {i: i // 2 * 2 + 2 for i in range(400)} | {400: 0, 401: 0}
    sizes = [r["count"] for r in seen[0].groupBy(ordering.BUCKET).count().collect()]
    assert len(seen) == 1 and len(sizes) >= 4 and max(sizes) < sum(sizes) / 2


def test_running_sum_in_small_buckets(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), rng.randrange(-3, 9)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k string, t long, v long")
    upto = lambda a, b: b is None if a is None else b is None or b <= a
    want = {i: sum(w for _, k2, t2, w in rows if k2 == k and upto(t, t2)) for i, k, t, _ in rows}
    assert {r.id: r.s for r in ordering.running_sum(df, "v", "t", ["k"], "s", rows_per_bucket=20).collect()} == want


@pytest.fixture
def log_files(spark, tmp_path):
    """Files read one after the other; a row of the last one is far behind the watermark."""
    batches = [
        [("a", 0.0, 0.1), ("a", 10.0, 0.9), ("b", 20.0, 5.0)],
        [("a", 5000.0, 0.2), ("a", 5001.0, 0.2)],
        [("a", 6000.0, 0.2)],
        [("a", 5.0, 9.9), ("b", 9000.0, 0.3)],
    ]
    seen = set()
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "k string, at double, seconds double").withColumn("ts", F.timestamp_seconds("at").cast("timestamp_ntz"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        schema = df.schema
        for path in set((tmp_path / "log").glob("*.parquet")) - seen:
            os.utime(path, (1_700_000_000 + i * 100,) * 2)
            seen.add(path)
    return files.read_stream(spark, str(tmp_path / "log"), schema, files_per_trigger=1)


def test_latency_stream_drops_late_rows(log_files):
    out = files.run_available(latency.latency_stream(log_files, "k", "seconds", "ts", "1 hour", "10 minutes")).collect()
    first = {r.k: r for r in out if r.window_start.timestamp() == 0}
    assert first["a"]["count"] == 2 and first["a"].max_ms == 900.0 and first["b"].slow_severe == 1


def test_count_stream(log_files):
    out = files.run_available(rates.rate_counts_stream(log_files, "k", "ts", limit=1)).collect()
    assert any(r.requests == 2 and r.exceeded for r in out) and all(r.window_start < r.window_end for r in out)


def test_streams_close_with_their_input(log_files):
    out = files.run_to_end(log_files, lambda log: latency.latency_stream(log, "k", "seconds", "ts", "1 hour", "10 minutes"), "ts").collect()
    # The last row is the only one of its window; the late one of "a" is left out.
    assert {(r.k, r.window_start.timestamp()): r["count"] for r in out} == {("a", 0.0): 2, ("b", 0.0): 1, ("a", 3600.0): 3, ("b", 7200.0): 1}


def test_decision_stream_leaves_out_late_requests(log_files):
    decide = lambda log: rates.rate_decisions_stream(log, "k", "ts", "at", window=60, default=1)
    out = files.run_to_end(log_files, decide, "ts").collect()
    # Spark counts a time at or before 1970 as late.
    want = [("a", 10, True), ("a", 5000, True), ("a", 5001, False), ("a", 6000, True), ("b", 20, True), ("b", 9000, True)]
    assert sorted((r.pair[2:-2], r.at // 1_000_000, r.allowed) for r in out) == want


@pytest.mark.parametrize("parts", [1, 6])
def test_decision_stream_equals_batch_however_files_are_dealt(spark, tmp_path, parts):
    rows, df = _log(spark, 8, 400)
    # Neighbouring requests change places, so that files overlap in time.
    ordered = [rows[i ^ 3] for i in range(len(rows))]
    step = -(-len(ordered) // parts)
    for n in range(parts):
        part = spark.createDataFrame(ordered[n * step : (n + 1) * step], "id int, k string, c string, m bigint").withColumn("ts", F.timestamp_micros("m")).drop("m")
        before = set(tmp_path.glob("*.parquet"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path))
        for path in set(tmp_path.glob("*.parquet")) - before:
            os.utime(path, (1_700_000_000 + n * 100,) * 2)
    log = files.read_stream(spark, str(tmp_path), df.schema, files_per_trigger=1)
    decide = lambda x: rates.rate_decisions_stream(x, "k", "ts", "id", "c", 10, {"auth": 2}, 5, "30 seconds")
    out = files.run_to_end(log, decide, "ts").collect()
    assert {int(r.tie): r.allowed for r in out} == _decide(rows, lambda c: 2 if c == "auth" else 5, 10_000_000)


@pytest.fixture(scope="module")
def flowers(spark):
    rng = random.Random(5)
    rows = [(i, rng.gauss(3 * (i % 2), 0.5), rng.gauss(0, 1), "xyz"[i % 3], ["rose", "tulip"][i % 2]) for i in range(200)]
    return spark.createDataFrame(rows, "id int, petal double, noise double, site string, kind string")


def test_problem_type(flowers):
    assert learning.problem_type(flowers, "kind") == "classification"
    assert learning.problem_type(flowers, "petal") == "regression"


def test_classifier_round_trip(spark, tmp_path, flowers):
    model = learning.train_best(flowers.drop("id"), learners=["DecisionTreeClassifier", "LogisticRegression"])
    assert model.problem == "classification" and model.score > 0.9 and model.rows_trained == 200
    shares = learning.explain(model, flowers).collect()
    assert shares[0].feature == "petal" and sum(r.importance for r in shares) == pytest.approx(1)
    learning.save_model(model, str(tmp_path / "model"), spark)
    again = learning.load_model(spark, str(tmp_path / "model"))
    scored = learning.predict(flowers.drop("kind"), again)
    assert set(r.prediction_label for r in scored.select("prediction_label").distinct().collect()) <= {"rose", "tulip"}
    assert learning.model_info(spark, str(tmp_path / "model")).first().target == "kind"


def test_regression_uses_named_features(flowers):
    df = flowers.select("noise", "site", "petal", (F.col("petal") * 3 + 1).alias("y"))
    model = learning.train_best(df, learners=["LinearRegression"])
    assert model.problem == "regression" and model.features == ["noise", "site", "petal"] and model.score < 0.1


def test_too_few_columns_or_rows(flowers):
    with pytest.raises(ValueError):
        learning.train_best(flowers.select("kind"))
    with pytest.raises(ValueError):
        learning.train_best(flowers.limit(0))


@pytest.fixture(scope="module")
def many(spark):
    y = "(id % 7) * 3 + (id % 60 DIV 15) * (id % 3) + id * 37 % 101 / 50.0D AS y"
    return spark.range(6000).selectExpr("CAST(id % 7 AS double) a", "CAST(id % 60 DIV 15 AS int) b", "concat('v', id % 3) s", y).cache()


@pytest.mark.parametrize("learner", ["DecisionTreeRegressor", "GBTRegressor", "DecisionTreeClassifier", "RandomForestClassifier"])
def test_tree_learners_read_cells_in_place_of_rows(many, monkeypatch, learner):
    df = many.withColumn("y", F.when(F.col("y") > 10, "high").otherwise("low")) if "Classifier" in learner else many
    plain = learning.train_best(df, learners=[learner])
    read, fit = [], getattr(learning, learner)._fit
    monkeypatch.setattr(getattr(learning, learner), "_fit", lambda self, data: (read.append(data.count()), fit(self, data))[1])
    monkeypatch.setattr(learning, "FOLD_ROWS", 0, raising=False)
    model = learning.train_best(df, learners=[learner])
    assert read and max(read) * 15 < 6000
    if "Forest" not in learner:
        assert model.score == pytest.approx(plain.score)
        rows = df.drop("y").distinct()
        of = lambda m: {tuple(r)[:3]: r["prediction_label"] for r in learning.predict(rows, m).collect()}
        assert of(model) == (of(plain) if "Classifier" in learner else pytest.approx(of(plain)))
    else:
        assert model.score > 0.8 and len(model.pipeline.stages[-2].trees) == 20


def test_trees_of_a_forest_draw_every_row_by_itself(spark, many, monkeypatch, tmp_path):
    monkeypatch.setattr(learning, "FOLD_ROWS", 0)
    model = learning.train_best(many, learners=["RandomForestRegressor"])
    trees = [t for _, t in contributions.read_trees(model.pipeline.stages[-1])]
    sizes = [t[0].rows for t in trees]
    assert len(trees) == 20 and len(set(sizes)) > 10 and max(abs(n - 6000) for n in sizes) < 5 * math.sqrt(6000)
    spread = statistics.stdev(t[0].value for t in trees) / many.agg(F.stddev("y")).first()[0] * math.sqrt(6000)
    assert 0.5 < spread < 2
    learning.save_model(model, str(tmp_path / "model"), spark)
    own, read = (learning.predict(many, m).agg(F.sum("prediction_label")).first()[0] for m in (model, learning.load_model(spark, str(tmp_path / "model"))))
    assert own == pytest.approx(read)


def test_poisson_and_split_points(spark):
    got = spark.range(100_000).select(learning.poisson((F.col("id") + 0.5) / 100_000).alias("n")).agg(F.avg("n"), F.var_pop("n")).first()
    assert got[0] == pytest.approx(1, abs=1e-3) and got[1] == pytest.approx(1, abs=1e-3)
    assert learning.split_points(np.array([1.0, 1, 2, 4])) == [1.5, 3.0] and learning.split_points(np.array([7.0, 7])) == []
    sizes = np.diff([0, *np.searchsorted(np.arange(1000.0), learning.split_points(np.arange(1000.0))), 1000])
    assert len(sizes) == 32 and set(sizes) == {31, 32}


class _Kept:
    """State of one pair in memory, as a processor sees it, with the number of requests read at a time."""

    def __init__(self):
        self.values, self.value, self.timers, self.most = {}, None, [], 0
        self.getMapState = self.getValueState = lambda name, *_: self if name == "waiting" else _Kept()
        self.keys, self.exists, self.clear, self.removeKey = lambda: iter(list(self.values)), lambda: self.value is not None, lambda: self.update(None), lambda k: self.values.pop(k)
        self.updateValue, self.registerTimer = self.values.__setitem__, self.timers.append

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def getValue(self, key):
        self.most = max(self.most, len(self.values[key][0]))
        return self.values[key]


def test_waiting_requests_are_read_one_window_at_a_time(monkeypatch):
    monkeypatch.setattr(rates, "CHUNK_ROWS", 100)
    rng, state, span = random.Random(8), _Kept(), 10_000_000
    rows = [(i, "a", "c", rng.randrange(3000) * 333_333 + 1_000_000) for i in range(2000)]
    decide = rates._Decisions(span)
    decide.init(state)
    mark = lambda ms: type("Mark", (), {"getCurrentWatermarkInMs": staticmethod(lambda: ms)})
    list(decide.handleInputRows(("a",), iter([{"at": r[3], "tie": str(r[0]), "max_requests": 5} for r in rows]), mark(0)))
    got = [r for ms in (300_000, 300_001, 700_123, 10**9) for r in decide.handleExpiredTimer(("a",), mark(ms), None)]
    assert {int(r.tie): r.allowed for r in got} == _decide(rows, lambda c: 5, span) and not state.values
    assert [(r.at, int(r.tie)) for r in got] == sorted((r[3], r[0]) for r in rows) and state.most < 100


@pytest.mark.parametrize("query, table, rows", [
    ("str1_stream_files", "events", "SELECT id AS event_id, id % 9 AS user_id, element_at(array('error', 'click', 'view'), int(id % 3) + 1) AS event_type, CAST(timestamp_seconds(1700000000 + id * 97) AS timestamp_ntz) AS ts, double(id) AS value FROM range(300)"),
    ("src8_files", "documents", "SELECT id AS doc_id, concat('text ', id) AS text FROM range(40)"),
])
def test_one_task_reads_no_whole_table_to_write_a_file(spark, tmp_path, monkeypatch, query, table, rows):
    spark.sql(rows).repartition(3).write.parquet(str(tmp_path / f"{table}.parquet"))
    read, coalesce = [], DataFrame.coalesce
    monkeypatch.setattr(type(spark.range(1)), "coalesce", lambda df, n: read.append(df.inputFiles()) or coalesce(df, n))
    found = queries()[query](spark, str(tmp_path)).collect()
    assert read and not [f for files in read for f in files if f"{table}.parquet" in f]
    if table == "events":
        assert len(found) == 300
    else:
        assert sorted((r.files, r.copies) for r in found) == [(2, 2), (3, 3)]
