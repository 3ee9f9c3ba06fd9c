"""Derived columns, filters, pattern scans, windows, ordering, limits and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.checks.tables import from_sql, holed_orders, load, stacked, with_holed
from plumbline.functions.fixed import PATTERN_SETS
from plumbline.operators import audit, derive, filters, history, ordering, relationships

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]


def _prj1(spark, sf):
    lines = load(spark, sf, "lineitem").select(*LINE, "l_extendedprice", "l_discount")
    return derive.derive(lines, "net", "l_extendedprice * (1 - l_discount)")


def _prj1_audit(spark, sf):
    """Of three expressions one names an unknown column and one is an aggregate."""
    specs = [
        derive.DerivedColumn("net", "l_extendedprice * (1 - l_discount)"),
        derive.DerivedColumn("lost", "l_extendedprice * no_such_column"),
        derive.DerivedColumn("mean", "avg(l_extendedprice)"),
    ]
    out, trail = derive.derive_all(load(spark, sf, "lineitem"), specs)
    total = out.agg(F.round(F.sum("net"), 2).alias("net")).first()["net"]
    return trail.select("sequence", "column", "status").withColumn("total_net", F.lit(total))


def _prj2(spark, sf):
    out = derive.derive_ratios(load(spark, sf, "lineitem"))
    return out.select(*LINE, *[c for c in out.columns if c.endswith("_ratio")])


def _prj6(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("l_discount", F.when(F.col("l_discount") > 0, F.col("l_discount")).otherwise(F.lit(0.0)))
    df = derive.derive_all(
        df,
        [
            derive.DerivedColumn("net", "l_extendedprice * (1 - l_discount)"),
            derive.DerivedColumn("per_discount", "try_divide(l_extendedprice, l_discount)"),
            derive.DerivedColumn("shift", "l_quantity - 25"),
            derive.DerivedColumn("text", "cast(l_linenumber as string)"),
        ],
    )[0]
    specs = [
        derive.DerivedColumn("net", "", "double", ("non_negative", "no_null")),
        derive.DerivedColumn("per_discount", "", "double", ("no_null", "no_zero_denominator")),
        derive.DerivedColumn("shift", "", "double", ("non_negative", "no_zero_denominator")),
        derive.DerivedColumn("text", "", "double", ("unheard_of",)),
    ]
    out = derive.validate_columns(df, specs, denominators={"per_discount": "l_discount"})
    return out.select(
        "column", "null_count", "nan_count", "inf_count", "zero_count", "negative_count", "zero_denominators",
        F.array_join("errors", ",").alias("errors"), "passed",
    )


_PRJ6_SQL = """WITH t AS (SELECT l_extendedprice * (1 - l_discount) AS net, l_extendedprice / nullif(l_discount, 0) AS per_discount, l_quantity - 25 AS shift, l_discount AS d FROM lineitem),
    n AS (SELECT count(*) FILTER (net < 0) AS neg, count(*) FILTER (net = 0) AS zero, count(*) FILTER (d = 0) AS zd,
          count(*) FILTER (per_discount = 0) AS pz, count(*) FILTER (per_discount < 0) AS pn,
          count(*) FILTER (shift = 0) AS sz, count(*) FILTER (shift < 0) AS sn FROM t)
    SELECT 'net' AS "column", 0::BIGINT AS null_count, 0::BIGINT AS nan_count, 0::BIGINT AS inf_count, zero AS zero_count, neg AS negative_count,
        0::BIGINT AS zero_denominators, CASE WHEN neg > 0 THEN 'non_negative' ELSE '' END AS errors, neg = 0 AS passed FROM n
    UNION ALL SELECT 'per_discount', zd, 0, 0, pz, pn, zd, concat_ws(',', CASE WHEN pz > 0 THEN 'no_zero_denominator' END,
        CASE WHEN zd > 0 THEN 'zero_in_denominator' END, CASE WHEN zd > 0 THEN 'no_null' END), zd = 0 AND pz = 0 FROM n
    UNION ALL SELECT 'shift', 0, 0, 0, sz, sn, 0, concat_ws(',', CASE WHEN sz > 0 THEN 'no_zero_denominator' END, CASE WHEN sn > 0 THEN 'non_negative' END), sz = 0 AND sn = 0 FROM n
    UNION ALL SELECT 'text', 0, 0, 0, 0, 0, 0, 'type_mismatch', false FROM n"""


def _flt5(spark, sf):
    return filters.pattern_counts(load(spark, sf, "pages"), "html")


def _flt5_rows(spark, sf):
    out = filters.scan_patterns(load(spark, sf, "pages"), "html").select("page_id", *[f"{s}_hits" for s in PATTERN_SETS])
    return out.withColumns({f"{s}_hits": F.array_join(f"{s}_hits", ",") for s in PATTERN_SETS})


def _quoted(pattern):
    return "'(?i)" + pattern.replace("'", "''") + "'"


def _hits(pattern_set):
    cases = ", ".join(f"CASE WHEN regexp_matches(html, {_quoted(p)}) THEN '{i}' END" for i, p in enumerate(PATTERN_SETS[pattern_set], 1))
    return f"concat_ws(',', {cases})"


_FLT5_ROWS_SQL = "SELECT * FROM (SELECT page_id, " + ", ".join(f"{_hits(s)} AS {s}_hits" for s in PATTERN_SETS) + " FROM pages) WHERE " + " OR ".join(f"{s}_hits <> ''" for s in PATTERN_SETS)


def _win2(spark, sf):
    ranks = ordering.value_ranks(load(spark, sf, "lineitem"), ["l_extendedprice"])
    return ranks.select("l_extendedprice", (F.col("below") + (F.col("n") + 1) / 2.0).alias("average_rank"), "n")


def _win4(spark, sf):
    return ordering.row_index(load(spark, sf, "events").select("event_id", "ts"), ["ts", "event_id"]).select("event_id", "row_index")


def _win4_text(spark, sf):
    return ordering.row_index(load(spark, sf, "customer").select("c_name", "c_custkey"), ["c_name", "c_custkey"]).select("c_custkey", "row_index")


def _versions(spark, sf):
    """Orders of a customer as successive versions of one record."""
    return load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_totalprice")


def _text_date(df):
    return df.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def _win5(spark, sf):
    return _text_date(history.current_versions(_versions(spark, sf), "o_custkey", "o_orderdate", "o_orderkey"))


def _win5_history(spark, sf):
    return _text_date(history.version_history(_versions(spark, sf), "o_custkey", 7, "o_orderdate", [F.desc("o_orderkey")]))


def _win5_revert(spark, sf):
    """Every customer's record after customer 7 was set back to its first version."""
    rows = _versions(spark, sf)
    first = rows.filter("o_custkey = 7").agg(F.min("o_orderkey").alias("k")).first()["k"]
    back = history.revert_to(rows, "o_custkey", 7, "o_orderkey", first, "o_orderdate", "2030-01-01 00:00:00")
    return _text_date(history.current_versions(back, "o_custkey", "o_orderdate", "o_orderkey"))


_CURRENT = "SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_totalprice FROM {t} QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"


def _set3(spark, sf):
    """Two trails, one entry per part brand and type, one after the other."""
    brands = load(spark, sf, "part").groupBy(F.col("p_brand").alias("column")).agg(F.count(F.lit(1)).alias("rows_after")).withColumn("step", F.lit("brand"))
    types = load(spark, sf, "part").groupBy(F.col("p_type").alias("column")).agg(F.count(F.lit(1)).alias("rows_after")).withColumn("step", F.lit("type"))
    return audit.append_audit(brands, types)


QUERIES = {
    "sch1": lambda s, d: from_sql(s, d, "SELECT o_orderkey, o_orderdate, CASE o_orderpriority WHEN '1-URGENT' THEN 'daily' WHEN '2-HIGH' THEN 'weekly' WHEN '3-MEDIUM' THEN 'monthly' END AS frequency FROM {orders}")
    .select("o_orderkey", F.date_format(history.next_run(F.col("frequency"), F.col("o_orderdate")), "yyyy-MM-dd").alias("next_run")),
    "prj1": _prj1,
    "prj1_audit": _prj1_audit,
    "prj2": _prj2,
    "prj3": lambda s, d: derive.derive_difference(load(s, d, "lineitem")).select(*LINE, "l_orderkey_minus_l_partkey"),
    "prj4": lambda s, d: derive.derive_row_average(holed_orders(s, d)).select("o_orderkey", F.round("avg_top_3_numeric", 4).alias("avg_top_3_numeric")),
    "prj5": lambda s, d: derive.derive_bins(load(s, d, "part"), "p_size", [0, 10, 25, 49], ["small", "medium", "large"], "size_group").select("p_partkey", "p_size", "size_group"),
    "prj6": _prj6,
    "flt1": lambda s, d: _text_date(filters.fetch(load(s, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": "1-URGENT"}, [F.desc("o_totalprice"), "o_orderkey"], 100, 20)),
    "flt2": lambda s, d: filters.filter_panel(load(s, d, "events"), "value", 50.0, "event_type", "PUR", "ts", "2024-01-05 00:00:00", "2024-01-20 00:00:00").select("event_id", "event_type", "value"),
    "flt3": lambda s, d: filters.latest(load(s, d, "events"), "ts", {"event_type": "error"}, 50, ["event_id"]).select("event_id", "user_id", "value"),
    "flt5": _flt5,
    "flt5_rows": _flt5_rows,
    "win1": lambda s, d: ordering.directional_fill(from_sql(s, d, "SELECT event_id, ts, CASE WHEN event_id % 5 = 2 THEN user_id END AS user_id FROM {events}"), ["user_id"], ["ts", "event_id"]).select("event_id", F.col("user_id").cast("double").alias("user_id")),
    "win2": _win2,
    "win3": lambda s, d: history.keep_last_n(load(s, d, "conversations"), "conv_id", "turn", 20),
    "win3_last2": lambda s, d: history.keep_last_n(load(s, d, "conversations"), "conv_id", "turn", 2),
    "win4": _win4,
    "win4_text": _win4_text,
    "win5": _win5,
    "win5_history": _win5_history,
    "win5_revert": _win5_revert,
    "srt1": lambda s, d: relationships.sort_by_strength(load(s, d, "supplier").select(F.col("s_acctbal").alias("strength"), F.col("s_name").alias("source_column"), F.col("s_nationkey").alias("target_column"))),
    "top1": lambda s, d: relationships.top_k(load(s, d, "lineitem").select(*LINE, "l_extendedprice"), [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")], 20),
    "lim1": lambda s, d: filters.limit(load(s, d, "customer"), 100, ["c_custkey"]),
    "set1": lambda s, d: filters.distinct(load(s, d, "lineitem").select("l_suppkey", "l_linenumber", "l_returnflag")),
    "set2": lambda s, d: relationships.shared_values(load(s, d, "lineitem"), "l_suppkey", load(s, d, "lineitem"), "l_partkey"),
    "set3": _set3,
}

_RATIOS = ", ".join(f"{a}::DOUBLE / nullif({b}, 0)::DOUBLE AS {a}_to_{b}_ratio" for a, b in list(zip(NUMBERS, NUMBERS[1:]))[:5])

SQL = {
    "sch1": """SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 7 WHEN '3-MEDIUM' THEN 30 END, '%Y-%m-%d') AS next_run FROM orders""",
    "prj1": f"SELECT {', '.join(LINE)}, l_extendedprice, l_discount, l_extendedprice * (1 - l_discount) AS net FROM lineitem",
    "prj1_audit": stacked(
        f"SELECT {i} AS sequence, '{n}' AS \"column\", '{st}' AS status, (SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) FROM lineitem) AS total_net"
        for i, (n, st) in enumerate([("net", "completed"), ("lost", "failed"), ("mean", "failed")])
    ),
    "prj2": f"SELECT {', '.join(LINE)}, {_RATIOS} FROM lineitem",
    "prj3": f"SELECT {', '.join(LINE)}, l_orderkey - l_partkey AS l_orderkey_minus_l_partkey FROM lineitem",
    "prj4": with_holed(
        """SELECT o_orderkey, round((o_orderkey + coalesce(o_custkey, 0) + coalesce(o_totalprice, 0)::DOUBLE)
        / (1 + CAST(o_custkey IS NOT NULL AS INT) + CAST(o_totalprice IS NOT NULL AS INT)), 4) AS avg_top_3_numeric FROM ho"""
    ),
    "prj5": """SELECT p_partkey, p_size, CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 25 THEN 'medium'
        WHEN p_size > 25 AND p_size <= 49 THEN 'large' END AS size_group FROM part""",
    "prj6": _PRJ6_SQL,
    "flt1": """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders
        WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 20""",
    "flt2": """SELECT event_id, event_type, value FROM events WHERE value >= 50 AND contains(lower(event_type), 'pur')
        AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
    "flt3": "SELECT event_id, user_id, value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50",
    "flt5": stacked(
        f"SELECT '{s}' AS pattern_set, {i} AS pattern_no, count(*) FILTER (regexp_matches(html, {_quoted(p)})) AS rows FROM pages"
        for s, patterns in PATTERN_SETS.items() for i, p in enumerate(patterns, 1)
    ),
    "flt5_rows": _FLT5_ROWS_SQL,
    "win1": """SELECT event_id, last_value(CASE WHEN event_id % 5 = 2 THEN user_id END IGNORE NULLS)
        OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS user_id FROM events""",
    "win2": """SELECT l_extendedprice, any_value(r) + (count(*) - 1) / 2.0::DOUBLE AS average_rank, count(*) AS n
        FROM (SELECT l_extendedprice, rank() OVER (ORDER BY l_extendedprice) AS r FROM lineitem) GROUP BY 1""",
    "win3": "SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 20",
    "win3_last2": "SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2",
    "win4_text": "SELECT c_custkey, row_number() OVER (ORDER BY c_name, c_custkey) - 1 AS row_index FROM customer",
    "win4": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_index FROM events",
    "win5": f"SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM ({_CURRENT.format(t='orders')})",
    "win5_history": "SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderstatus, o_totalprice FROM orders WHERE o_custkey = 7",
    "win5_revert": f"""WITH v AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_totalprice FROM orders),
        b AS (SELECT * FROM v UNION ALL SELECT o_custkey, (SELECT max(o_orderkey) + 1 FROM v), TIMESTAMP '2030-01-01', o_orderstatus, o_totalprice
              FROM v WHERE o_orderkey = (SELECT min(o_orderkey) FROM v WHERE o_custkey = 7))
        SELECT * REPLACE (strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate) FROM ({_CURRENT.format(t='b')})""",
    "srt1": "SELECT s_acctbal AS strength, s_name AS source_column, s_nationkey AS target_column FROM supplier",
    "top1": f"SELECT {', '.join(LINE)}, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 20",
    "lim1": "SELECT * FROM customer ORDER BY c_custkey LIMIT 100",
    "set1": "SELECT DISTINCT l_suppkey, l_linenumber, l_returnflag FROM lineitem",
    "set2": "SELECT l_suppkey AS value FROM lineitem INTERSECT SELECT l_partkey FROM lineitem",
    "set3": """SELECT p_brand AS "column", count(*) AS rows_after, 'brand' AS step, 0 AS trail FROM part GROUP BY 1
        UNION ALL SELECT p_type, count(*), 'type', 1 FROM part GROUP BY 1""",
}
