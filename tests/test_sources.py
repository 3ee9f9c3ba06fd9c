import pytest

from plumbline import session
from plumbline.sources import readers, stores


@pytest.fixture
def messy(tmp_path):
    path = tmp_path / "messy.csv"
    path.write_text('name,age,note\nAnn,NA,"a, b"\nBo,null,"say ""hi"""\nCy,None\nDi,nan,x,extra,more\nEd,N/A,\nFi,7,NULL\n')
    return str(path)


def test_read_csv(spark, messy):
    rows = {r.name: (r.age, r.note) for r in readers.read_csv(spark, messy).collect()}
    assert rows == {"Ann": (None, "a, b"), "Bo": (None, 'say "hi"'), "Cy": (None, None), "Di": (None, "x"), "Ed": (None, None), "Fi": ("7", None)}
    assert readers.read_csv(spark, messy, encoding="no-such-encoding").count() == 6


def test_read_csv_in_another_encoding(spark, tmp_path):
    path = tmp_path / "latin.csv"
    path.write_bytes("name\nJosé\n".encode("iso-8859-1"))
    assert readers.read_csv(spark, str(path), "iso-8859-1").first().name == "José"


def test_rows_without_header(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text('1,"a,b",2\n 3 ,,x\n')
    df = readers.read_csv_rows(spark, str(path), has_header=False)
    assert df.columns == ["col_0", "col_1", "col_2"]
    assert [tuple(r) for r in df.orderBy("col_0").collect()] == [(1.0, "a,b", "2"), (3.0, None, "x")]


def test_apply_schema(spark):
    df = spark.createDataFrame([("5", "1.5", "01/31/2024", "t"), ("5.0", "x", "2024", "t")], "a string, b string, c string, d string")
    inferred = [dict(column="a", detected_type="int"), dict(column="b", detected_type="float"), dict(column="c", detected_type="date", format_spec="%m/%d/%Y"), dict(column="zz", detected_type="int")]
    out = readers.apply_schema(df, inferred)
    assert [r.a for r in out.collect()] == [5, 5] and [r.b for r in out.collect()] == [1.5, None]
    assert [str(r.c) for r in out.collect()] == ["2024-01-31 00:00:00", "None"]


def test_formats(spark, tmp_path, people):
    for suffix, fmt, options in ((".tsv", "csv", {"sep": "\t", "header": True}), (".json", "json", {}), (".parquet", "parquet", {})):
        path = str(tmp_path / f"people{suffix}")
        people.write.format(fmt).options(**options).save(path)
        assert readers.read_table(spark, path).count() == 5
    with pytest.raises(ValueError):
        readers.read_table(spark, "people.xlsx")


def test_snapshots_and_datasets(spark, tmp_path, people):
    key = stores.save_snapshot(people, str(tmp_path), "p", "v1")
    assert stores.load_snapshot(spark, str(tmp_path), key).count() == 5
    with pytest.raises(Exception):
        stores.save_snapshot(people, str(tmp_path), "p", "v1")
    root = str(tmp_path / "datasets")
    stores.store_dataset(people, root, "key", "a")
    stores.store_dataset(people.limit(2), root, "key", "b")
    stores.store_dataset(people.filter("id = 1"), root, "key", "a")
    assert stores.load_dataset(spark, root, "key", "a").count() == 1 and stores.load_dataset(spark, root, "key", "b").count() == 2


def test_duplicate_files(spark, tmp_path):
    for name, text in (("a.csv", "x"), ("b.csv", "x"), ("c.csv", "y")):
        (tmp_path / name).write_text(text)
    rows = stores.duplicate_files(spark, str(tmp_path), "*.csv").collect()
    assert sorted(r.path.rsplit("/", 1)[-1] for r in rows) == ["a.csv", "b.csv"] and all(r.copies == 2 for r in rows)
    texts = spark.createDataFrame([(1, "t"), (2, "t"), (3, "u")], "id int, t string")
    assert stores.duplicate_contents(texts, "t", "id").first().first_key == 1


def test_shared_root_comes_from_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    root = session.shared_root(spark)
    assert root == (named.rstrip("/") if named else session.shared_root(spark))
    first, second = session.fresh_path(spark, "x"), session.fresh_path(spark, "x")
    assert first != second and first.startswith(root)
