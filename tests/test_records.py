"""CSV files with line breaks inside quotes, cut at any byte, and files of unknown encoding."""

import csv
import io
import random

import pytest

from plumbline.sources import readers, records


@pytest.fixture
def small_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "97")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def written(tmp_path, rows, name="a.csv", encoding="utf-8", end="\n"):
    out = io.StringIO()
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL).writerows([["id", "text, quoted", "note"], *rows])
    (tmp_path / name).write_bytes(out.getvalue().encode(encoding))
    return rows


def texts(n, seed=1):
    rng = random.Random(seed)
    parts = ["word", "\n", '"', ",", "é", "漢", " ", "\n\n", '"\n"', "x" * 30]
    return [[str(k), "".join(rng.choice(parts) for _ in range(rng.randint(1, 14))) + ".", "end"] for k in range(n)]


def shown(df):
    return sorted((list(r) for r in df.collect()), key=lambda r: int(r[0]))


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_are_whole_wherever_ranges_end(spark, tmp_path, small_ranges, end):
    rows = written(tmp_path, texts(60), end=end)
    more = written(tmp_path, [[str(100 + int(r[0])), *r[1:]] for r in texts(30, 2)], "b.csv", end=end)
    df = readers.read_csv(spark, str(tmp_path), multi_line=True)
    assert df.columns == ["id", "text, quoted", "note"]
    assert shown(df) == rows + more
    assert records.ranges(spark, str(tmp_path)).count() > 20


def test_one_record_longer_than_many_ranges(spark, tmp_path, small_ranges):
    rows = written(tmp_path, [["1", "line\n" * 200, "a"], ["2", "plain", "b"], ["3", '"\n' * 150, "c"]])
    assert shown(readers.read_csv(spark, str(tmp_path), multi_line=True)) == rows


@pytest.mark.parametrize("multi_line", [False, True])
def test_encodings_are_found(spark, tmp_path, multi_line):
    rows = [["1", "grün, süß", "Ärger"], ["2", "façade", "plain"]]
    for encoding in ("iso-8859-1", "utf-8", "utf-8-sig"):
        folder = tmp_path / encoding
        folder.mkdir()
        written(folder, rows, encoding=encoding)
        df = readers.read_csv(spark, str(folder), multi_line=multi_line)
        assert shown(df) == rows and df.columns[0].lstrip("﻿") == "id"
    assert records.detect_encoding(spark, str(tmp_path / "iso-8859-1")) == "iso-8859-1"
    assert shown(readers.read_csv(spark, str(tmp_path / "utf-8"), "no such encoding", multi_line=multi_line)) == rows


def test_ragged_blank_and_null_fields_as_by_the_plain_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b,c\n1,"x",NA\n2\n\n3,"",z,extra\n4,"say ""hi""",null\n')
    plain = readers.read_csv(spark, str(tmp_path))
    parallel = readers.read_csv(spark, str(tmp_path), multi_line=True)
    assert parallel.columns == plain.columns and sorted(parallel.collect(), key=str) == sorted(plain.collect(), key=str)


def test_a_repeated_header_is_a_record_and_empty_files_have_none(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\na,b\n1,2\n")
    assert sorted(map(tuple, readers.read_csv(spark, str(tmp_path), multi_line=True).collect())) == [("1", "2"), ("a", "b")]
    (tmp_path / "only").mkdir()
    (tmp_path / "only" / "a.csv").write_text("a,b\n")
    df = readers.read_csv(spark, str(tmp_path / "only"), multi_line=True)
    assert df.columns == ["a", "b"] and df.count() == 0
