"""Readers, snapshots, keyed datasets, duplicate contents and previews.

Files are written from the given tables to the shared folder and read back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.checks.tables import from_sql, load
from plumbline.operators import filters
from plumbline.plans.prepare import prepare
from plumbline.sources import readers, stores
from plumbline.session import drop_path, fresh_path

_WITH_TOKENS = """SELECT o_orderkey, CASE o_orderkey % 10 WHEN 1 THEN 'NA' WHEN 2 THEN 'N/A' WHEN 3 THEN 'null' WHEN 4 THEN 'NaN' ELSE o_orderstatus END AS status,
    concat(o_orderpriority, ', "', o_orderstatus, '"') AS note, o_totalprice FROM {orders}"""


def _written(df, name, fmt, **options):
    path = fresh_path(df.sparkSession, name)
    df.write.format(fmt).options(**options).save(path)
    return path


def _src1(spark, sf):
    path = _written(from_sql(spark, sf, _WITH_TOKENS), "csv", "csv", header=True, escape='"')
    return readers.read_csv(spark, path)


def _src1_lineitem(spark, sf):
    """A table written as text comes back with its numbers and times."""
    read = readers.type_texts(readers.read_csv(spark, _written(load(spark, sf, "lineitem"), "lines", "csv", header=True)))
    typed = readers.apply_schema(read, [{"column": "l_shipdate", "detected_type": "datetime", "format_spec": "%Y-%m-%dT%H:%M:%S"}])
    return typed.withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss"))


def _src1_documents(spark, sf):
    """Texts with line breaks, quotes and separators come back as they were."""
    path = _written(load(spark, sf, "documents").select("doc_id", "text", "lang"), "texts", "csv", header=True, escape='"')
    return readers.type_texts(readers.read_csv(spark, path, multi_line=True))


def _prepare_typed(spark, sf):
    """The whole way from a written table: what it is typed and cleaned to, with no value lost."""
    path = _written(load(spark, sf, "orders"), "orders", "csv", header=True)
    done = prepare(readers.read_csv(spark, path), ["o_orderkey"])
    return done.cleaned.select("o_orderkey", "o_custkey", "o_orderstatus", F.round("o_totalprice", 4).alias("o_totalprice"), F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("o_orderdate"), "o_orderpriority")


def _prepare_losses(spark, sf):
    raw = readers.read_csv(spark, _written(load(spark, sf, "orders"), "orders", "csv", header=True))
    return readers.cast_losses(raw, prepare(raw, ["o_orderkey"]).typed)


def _src8_files(spark, sf):
    """Texts written as one file for each fifth of the ids; two of these are written again, and one of them a third time."""
    path, dealt, docs = fresh_path(spark, "copies"), fresh_path(spark, "copy-lines"), load(spark, sf, "documents")
    # Texts are read and digested in parallel; the task that writes a file reads its lines only.
    line = F.to_json(F.struct("doc_id", F.md5(F.col("text").cast("binary")).alias("text")))
    docs.select("doc_id", line.alias("value"), (F.col("doc_id") % 5).alias("part")).write.partitionBy("part").parquet(dealt)
    lines = spark.read.parquet(dealt)
    for k, part in enumerate([0, 1, 2, 3, 4, 1, 3, 1]):
        lines.filter(F.col("part") == part).coalesce(1).sortWithinPartitions("doc_id", "value").select("value").write.text(f"{path}/{k}")
    drop_path(spark, dealt)
    found = stores.duplicate_files(spark, f"{path}/*/", "*.txt")
    return found.groupBy("digest").agg(F.count("*").alias("files"), F.max("copies").alias("copies"))


def _src2(spark, sf):
    df = from_sql(spark, sf, "SELECT o_orderkey, o_totalprice, o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS key, CASE WHEN o_orderkey = 5 THEN 'x' ELSE '7' END AS mixed FROM {orders}")
    return readers.read_csv_rows(spark, _written(df, "rows", "csv", header=False), has_header=False)


def _src3(spark, sf):
    texts = from_sql(
        spark, sf,
        """SELECT CAST(o_orderkey AS STRING) AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'bad' ELSE CAST(o_totalprice AS STRING) END AS price,
           CASE WHEN o_orderkey % 8 = 0 THEN '1/2/3' ELSE date_format(o_orderdate, 'MM/dd/yyyy') END AS day, o_orderpriority FROM {orders}""",
    )
    inferred = [
        {"column": "id", "detected_type": "int", "format_spec": None},
        {"column": "price", "detected_type": "float", "format_spec": None},
        {"column": "day", "detected_type": "date", "format_spec": "%m/%d/%Y"},
        {"column": "absent", "detected_type": "int", "format_spec": None},
    ]
    return readers.apply_schema(texts, inferred).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _src4(spark, sf):
    df = load(spark, sf, "customer")
    paths = {
        "tsv": _written(df, "table", "csv", header=True, sep="\t"),
        "json": _written(df, "table", "json"),
        "parquet": _written(df, "table", "parquet"),
    }
    parts = [
        readers.read_table(spark, path, fmt).agg(
            F.count(F.lit(1)).alias("rows"), F.count_distinct("c_custkey").alias("keys"),
            F.round(F.sum(F.col("c_acctbal").cast("double")), 2).alias("balance"), F.min("c_name").alias("first_name"),
        ).withColumn("format", F.lit(fmt))
        for fmt, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def _src5(spark, sf):
    root = fresh_path(spark, "snapshots")
    events = load(spark, sf, "events").select("event_id", "user_id", "value")
    stores.save_snapshot(events, root, "events", "v1.0-raw")
    key = stores.save_snapshot(events.filter("value > 10"), root, "events", "v1.1-cleaned")
    return stores.load_snapshot(spark, root, key)


def _src6(spark, sf):
    root = fresh_path(spark, "datasets")
    orders = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    for key, status in (("a", "F"), ("b", "P"), ("a", "O")):
        stores.store_dataset(orders.filter(F.col("o_orderstatus") == status), root, "dataset", key)
    return stores.load_dataset(spark, root, "dataset", "a").unionByName(stores.load_dataset(spark, root, "dataset", "b"))


QUERIES = {
    "src1_lineitem": _src1_lineitem,
    "src1_documents": _src1_documents,
    "src8_files": _src8_files,
    "prepare_cleaned": _prepare_typed,
    "prepare_losses": _prepare_losses,
    "src1": _src1,
    "src2": _src2,
    "src3": _src3,
    "src4": _src4,
    "src5": _src5,
    "src6": _src6,
    "src8": lambda s, d: stores.duplicate_contents(load(s, d, "documents"), "text", "doc_id"),
    "src9": lambda s, d: filters.preview(load(s, d, "documents"), ["doc_id"], 100, 50),
}

SQL = {
    "src1_lineitem": "SELECT * REPLACE (CAST(l_linenumber AS BIGINT) AS l_linenumber, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS l_shipdate) FROM lineitem",
    "src1_documents": "SELECT doc_id, text, lang FROM documents",
    "prepare_cleaned": "SELECT o_orderkey, o_custkey, o_orderstatus, round(o_totalprice, 4) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate, o_orderpriority FROM orders",
    "prepare_losses": " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS \"values\", 0::BIGINT AS lost FROM orders" for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]),
    "src8_files": """WITH files AS (SELECT doc_id % 5 AS part, md5(string_agg('{"doc_id":' || doc_id || ',"text":"' || md5(text) || '"}' || chr(10), '' ORDER BY doc_id)) AS digest FROM documents GROUP BY 1)
        SELECT digest, count(*) AS files, count(*) AS copies FROM files JOIN (SELECT unnest([0, 1, 2, 3, 4, 1, 3, 1]) AS part) USING (part) GROUP BY 1 HAVING count(*) > 1""",
    "src1": """SELECT o_orderkey::VARCHAR AS o_orderkey, CASE WHEN o_orderkey % 10 NOT IN (1, 2, 3, 4) THEN o_orderstatus END AS status,
        o_orderpriority || ', "' || o_orderstatus || '"' AS note, o_totalprice::VARCHAR AS o_totalprice FROM orders""",
    "src2": """SELECT o_orderkey::DOUBLE AS col_0, o_totalprice AS col_1, o_orderpriority AS col_2,
        CASE WHEN o_orderkey % 4 = 0 THEN o_custkey::DOUBLE END AS col_3, CASE WHEN o_orderkey = 5 THEN 'x' ELSE '7' END AS col_4 FROM orders""",
    "src3": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS price,
        CASE WHEN o_orderkey % 8 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day, o_orderpriority FROM orders""",
    "src4": " UNION ALL ".join(
        f"SELECT '{f}' AS format, count(*) AS rows, count(DISTINCT c_custkey) AS keys, round(sum(c_acctbal), 2) AS balance, min(c_name) AS first_name FROM customer"
        for f in ("tsv", "json", "parquet")
    ),
    "src5": "SELECT event_id, user_id, value FROM events WHERE value > 10",
    "src6": "SELECT o_orderkey, o_totalprice, o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'a' ELSE 'b' END AS dataset FROM orders WHERE o_orderstatus IN ('O', 'P')",
    "src8": "SELECT md5(text) AS digest, count(*) AS copies, min(doc_id) AS first_key FROM documents GROUP BY 1 HAVING count(*) > 1",
    "src9": """SELECT doc_id::VARCHAR AS doc_id, substring(coalesce(text, ''), 1, 50) AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        n_chars::VARCHAR AS n_chars FROM documents ORDER BY documents.doc_id LIMIT 100""",
}
