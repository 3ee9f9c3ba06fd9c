import math

from conftest import as_dict
from pyspark.sql import functions as F

from plumbline.operators import history, joins, quality
from plumbline.operators.quantiles import quantile_table
from plumbline.sources import readers
from plumbline.streaming import files


def test_whole_columns_decide_types(spark):
    df = spark.createDataFrame(
        [("1", "1.5", "true", "x", None), ("-2", "3", "FALSE", "1", None), (None, "1e3", None, "", None)], "i string, f string, b string, t string, n string"
    )
    typed = readers.type_texts(df)
    assert dict(typed.dtypes) == {"i": "bigint", "f": "double", "b": "boolean", "t": "string", "n": "string"}
    assert [r["f"] for r in typed.collect()] == [1.5, 3.0, 1000.0]
    assert {r["lost"] for r in readers.cast_losses(df, typed).collect()} == {0}


def test_fractions_are_no_integers_and_times_keep_theirs(spark):
    df = spark.createDataFrame([("1.9", "1997-10-31T00:00:00.000"), ("2.0", "1997-10-31 01:02:03"), ("7", "bad")], "n string, t string")
    typed = readers.apply_schema(
        df, [{"column": "n", "detected_type": "int"}, {"column": "t", "detected_type": "datetime", "format_spec": "%Y-%m-%dT%H:%M:%S"}]
    )
    assert [r["n"] for r in typed.collect()] == [None, 2, 7]
    assert [r["t"] and r["t"].hour for r in typed.collect()] == [0, 1, None]
    assert {r["column"]: r["lost"] for r in readers.cast_losses(df, typed).collect()} == {"n": 1, "t": 1}


def test_quantiles_agree_at_any_size(spark):
    values = [-math.inf, 1.0, 2.0, 3.0, 3.5, 9.25, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    wanted = {"q1": 0.25, "low": 0.1, "mid": 0.5, "q9": 0.9}
    assert quantile_table(df, ["v"], wanted).first() == quantile_table(df, ["v"], wanted, percentile_rows=0).first()
    plain = spark.range(3000).select((F.hash("id") / 1000.0).alias("v"))
    many = {f"q{k}": k / 97 for k in range(1, 97)}
    assert quantile_table(plain, ["v"], many).first() == quantile_table(plain, ["v"], many, percentile_rows=0).first()


def test_table_profile_and_schedule(spark):
    df = spark.createDataFrame([(1, "ab"), (1, "ab"), (None, "é")], "n int, t string")
    assert quality.table_profile(df).first().asDict() == {"rows": 3, "columns": 2, "bytes": 8, "has_duplicate_rows": True}
    assert quality.table_profile(df.limit(0)).first().asDict() == {"rows": 0, "columns": 2, "bytes": 0, "has_duplicate_rows": False}
    runs = spark.sql("SELECT * FROM VALUES ('daily'), ('weekly'), ('monthly'), ('never') AS t(f)").select("f", history.next_run(F.col("f"), F.lit("2024-02-28").cast("date")).alias("d"))
    assert {f: str(r["d"]) for f, r in as_dict(runs, "f").items()} == {"daily": "2024-02-29", "weekly": "2024-03-06", "monthly": "2024-03-29", "never": "None"}


def test_all_join_kinds_with_a_hot_target_key(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    right = spark.createDataFrame([(1, k) for k in range(5)] + [(9, 9), (None, 7)], "k long, w long")
    counts = {how: joins.join(left, right, "k", "k", how).count() for how in joins.JOIN_TYPES}
    assert counts == {"inner": 6, "left": 7, "right": 7, "outer": 8}
    outer = joins.join(left, right, "k", "k", "outer").collect()
    assert {(r["k"], r["source_v"], r["target_w"]) for r in outer} >= {(2, "b", None), (9, None, 9), (None, "n", 7)}


def test_streams_run_as_long_as_they_take(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    stream = files.read_stream(spark, f"{tmp_path}/in", "id long")
    assert sorted(r["id"] for r in files.run_available(stream).collect()) == [0, 1, 2]
