"""Joins, grouped aggregates, SQL, summaries, chart data and latency statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.checks.correlating import KEYS, overlap_sql
from plumbline.checks.tables import from_sql, holed_orders, load, stacked, with_holed
from plumbline.operators import grouping, joins, relationships
from plumbline.session import fresh_path

# One customer without a key and some orders without one, so that nulls meet nulls; both sides have
# keys that the other lacks.
_CUSTOMERS = "SELECT CASE WHEN c_custkey = 0 THEN NULL WHEN c_custkey % 11 = 5 THEN -1000000000000 - c_custkey ELSE c_custkey END AS c_custkey, c_name, c_nationkey FROM {customer}"
_ORDERS = """SELECT o_orderkey, CASE WHEN o_orderkey % 1000 = 7 THEN NULL WHEN o_orderkey % 50 = 3 THEN -o_custkey ELSE o_custkey END AS o_custkey,
    o_totalprice FROM {orders}"""
_JOIN_BASE = f"WITH c AS ({_CUSTOMERS.replace('{customer}', 'customer')}), o AS ({_ORDERS.replace('{orders}', 'orders')})"


def _shown(df):
    """Keys as double, because they may be null."""
    return df.withColumns({c: F.col(c).cast("double") for c, t in df.dtypes if t in ("bigint", "int")})


def _join(how):
    return lambda s, d: _shown(joins.join(from_sql(s, d, _CUSTOMERS), from_sql(s, d, _ORDERS), "c_custkey", "o_custkey", how))


def _join_sql(how, key):
    return f"""{_JOIN_BASE} SELECT {key}::DOUBLE AS c_custkey, c_name AS source_c_name, c_nationkey::DOUBLE AS source_c_nationkey,
        o_orderkey::DOUBLE AS target_o_orderkey, o_totalprice AS target_o_totalprice
        FROM (SELECT *, true AS here FROM c) c {how} JOIN o ON coalesce(c_custkey::VARCHAR, '') = coalesce(o_custkey::VARCHAR, '')"""


def _jn0(spark, sf):
    """A key that is a number on one side and text on the other, with empty text and null."""
    nation = from_sql(spark, sf, "SELECT CAST(n_nationkey AS DOUBLE) AS key, n_name FROM {nation}")
    customer = from_sql(spark, sf, "SELECT CASE WHEN c_custkey % 10 = 1 THEN '' WHEN c_custkey % 10 = 2 THEN NULL ELSE CAST(c_nationkey AS STRING) END AS nk, c_custkey FROM {customer}")
    return joins.join(customer, nation, "nk", "key", "outer").withColumn("source_c_custkey", F.col("source_c_custkey").cast("double"))


_JN0_SQL = """SELECT coalesce(nk, k2) AS nk, c_custkey::DOUBLE AS source_c_custkey, n_name AS target_n_name
    FROM (SELECT coalesce(CASE WHEN c_custkey % 10 = 1 THEN '' WHEN c_custkey % 10 = 2 THEN '' ELSE c_nationkey::VARCHAR END, '') AS k1,
          CASE WHEN c_custkey % 10 = 1 THEN '' WHEN c_custkey % 10 = 2 THEN NULL ELSE c_nationkey::VARCHAR END AS nk, c_custkey FROM customer)
    FULL JOIN (SELECT n_nationkey::VARCHAR AS k2, n_name FROM nation) ON k1 = k2"""


def _blank_sides(spark, sf):
    """Orders and events of which a third has no key, null or empty, on both sides."""
    orders = from_sql(spark, sf, "SELECT CASE o_orderkey % 3 WHEN 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN '' END ELSE CAST(o_custkey AS STRING) END AS k, o_orderkey FROM {orders}")
    events = from_sql(spark, sf, "SELECT CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(user_id AS STRING) END AS u, event_id FROM {events}")
    return orders, events


def _jn0_counts(spark, sf):
    return joins.join_counts(*_blank_sides(spark, sf), "k", "u", "outer")


def _jn0_factorised(spark, sf):
    found = joins.factorised(*_blank_sides(spark, sf), "k", "u", "outer")
    return found.joined.agg(F.count("*").alias("joined"), F.count("source_o_orderkey").alias("with_order"), F.count("target_event_id").alias("with_event")).withColumn("whole", F.lit(found.rows()).cast("bigint"))


_BLANK_SQL = """o AS (SELECT coalesce(CASE o_orderkey % 3 WHEN 0 THEN '' ELSE o_custkey::VARCHAR END, '') AS k, o_orderkey FROM orders),
    e AS (SELECT CASE WHEN event_id % 3 = 0 THEN '' ELSE user_id::VARCHAR END AS k, event_id FROM events),
    n AS (SELECT k AS key, coalesce(x, 0) AS source_rows, coalesce(y, 0) AS target_rows, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN x ELSE x * y END AS joined_rows
        FROM (SELECT k, count(*) AS x FROM o GROUP BY 1) FULL JOIN (SELECT k, count(*) AS y FROM e GROUP BY 1) USING (k))"""


def _tables(spark, sf):
    return {t: load(spark, sf, t) for t in ("region", "nation", "customer", "supplier")}


def _store(spark):
    store = joins.RelationStore(spark, fresh_path(spark, "relations"))
    store.define(joins.Relation("nation_customer", "customer", "c_nationkey", "nation", "n_nationkey", "inner"))
    store.define(joins.Relation("nation_supplier", "supplier", "s_nationkey", "nation", "n_nationkey", "left"))
    store.define(joins.Relation("region_nation", "nation", "n_regionkey", "region", "r_regionkey", "inner"))
    return store


def _jn5(spark, sf):
    """Definitions that remain after one is dropped, with the rows that each of them joins."""
    store, tables = _store(spark), _tables(spark, sf)
    store.drop("region_nation")
    parts = [
        store.execute(r["relation_id"], tables).agg(F.count(F.lit(1)).alias("joined_rows")).withColumn("relation_id", F.lit(r["relation_id"]))
        for r in store.list().orderBy("relation_id").collect()
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return store.list().join(out, "relation_id")


def _src7(spark, sf):
    store, tables = _store(spark), _tables(spark, sf)
    store.materialize("nation_customer", tables)
    return store.materialize("nation_customer", tables)


def _grp1(spark, sf):
    return grouping.group_aggregate(
        holed_orders(spark, sf), ["o_orderpriority"],
        {"total": ("SUM", "o_totalprice"), "mean": ("AVG", "o_totalprice"), "rows": ("COUNT", "o_totalprice"),
         "low": ("MIN", "o_totalprice"), "high": ("MAX", "o_totalprice"), "text_mean": ("AVG", "o_orderstatus")},
        limit=None,
    ).withColumns({"total": F.round("total", 2), "mean": F.round("mean", 4)})


def _grp1_top(spark, sf):
    return grouping.group_aggregate(
        load(spark, sf, "lineitem"), ["l_suppkey"], {"quantity": ("SUM", "l_quantity"), "rows": ("COUNT", "l_quantity")},
        order_by=[F.desc("quantity"), "l_suppkey"], limit=25,
    )


_GRP2 = """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS quantity, round(avg(l_extendedprice), 4) AS price, count(*) AS rows
    FROM dataset WHERE l_shipdate >= DATE '1996-01-01' GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
    ORDER BY l_returnflag, l_linestatus LIMIT 100"""


def _grp3_sql(columns):
    out = ", ".join(
        f"round(avg({c}), 2) AS avg_{c}, {'round(sum(' + c + '), 2)' if t == 'd' else 'sum(' + c + ')::BIGINT'} AS total_{c}, min({c}) AS min_{c}, max({c}) AS max_{c}, count({c}) AS count_{c}"
        for c, t in columns
    )
    return f"SELECT {out}, count(*) AS total_rows FROM ho"


def _grp6(spark, sf):
    out = grouping.chart_series(load(spark, sf, "orders"), "o_orderpriority", "o_totalprice", "pie")
    return out.withColumns({"y": F.round("y", 2), "share": F.round("share", 6)})


def _grp6_bar(spark, sf):
    return grouping.chart_series(load(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "bar")


def _grp6_line(spark, sf):
    out = grouping.chart_series(load(spark, sf, "orders"), "o_orderdate", "o_totalprice", "line")
    return out.select(F.date_format("x", "yyyy-MM-dd").alias("x"), F.round("y", 2).alias("y"))


def _grp6_heatmap(spark, sf):
    return grouping.chart_series(load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), "", "", "heatmap")


_REQUESTS = "SELECT event_type AS endpoint, value / 100 AS seconds, CAST(CASE WHEN event_id % 17 = 0 THEN 503 ELSE 200 END AS INT) AS status FROM {events}"


def _grp7(spark, sf):
    return grouping.latency_stats(from_sql(spark, sf, _REQUESTS), "endpoint", "seconds", "status")


_GRP7_SQL = f"""WITH r AS ({_REQUESTS.replace('{events}', 'events')}),
    o AS (SELECT *, row_number() OVER (PARTITION BY endpoint ORDER BY seconds) - 1 AS k, count(*) OVER (PARTITION BY endpoint) AS n FROM r)
    SELECT endpoint, count(*) AS count, round(max(seconds) FILTER (k = n // 2) * 1000, 2) AS p50_ms,
        round(max(seconds) FILTER (k = floor(n * 0.95)) * 1000, 2) AS p95_ms, round(max(seconds) FILTER (k = floor(n * 0.99)) * 1000, 2) AS p99_ms,
        round(min(seconds) * 1000, 2) AS min_ms, round(max(seconds) * 1000, 2) AS max_ms, round(avg(seconds) * 1000, 2) AS avg_ms,
        round(stddev_samp(seconds) * 1000, 2) AS std_dev_ms,
        count(*) FILTER (seconds > 0.5 AND seconds <= 1) AS slow_warning, count(*) FILTER (seconds > 1 AND seconds <= 3) AS slow_critical,
        count(*) FILTER (seconds > 3) AS slow_severe, round(count(*) FILTER (status < 500) * 100.0 / count(*), 1)::DOUBLE AS success_rate
    FROM o GROUP BY endpoint"""

_R = "coalesce(round(covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})), 4), 0)"

def _hot(how):
    """Both sides have one key with about a third of the rows."""
    def run(spark, sf):
        customers = from_sql(spark, sf, "SELECT CASE WHEN c_custkey % 100 = 3 THEN 1 ELSE c_custkey END AS k, CAST(c_custkey AS STRING) AS customer FROM {customer}")
        orders = from_sql(spark, sf, "SELECT CASE WHEN o_orderkey % 10 < 3 THEN 1 ELSE o_custkey + 20 END AS k, CAST(o_orderkey AS STRING) AS order FROM {orders}")
        return joins.join(customers, orders, "k", "k", how).select(F.col("source_customer").alias("customer"), F.col("target_order").alias("order"))

    return run


def _hot_sql(how):
    return f"""SELECT CAST(c_custkey AS VARCHAR) AS customer, CAST(o_orderkey AS VARCHAR) AS "order"
        FROM (SELECT CASE WHEN c_custkey % 100 = 3 THEN 1 ELSE c_custkey END AS k, c_custkey FROM customer) AS c {how} JOIN
             (SELECT CASE WHEN o_orderkey % 10 < 3 THEN 1 ELSE o_custkey + 20 END AS k, o_orderkey FROM orders) AS o ON c.k = o.k"""


_HOT = {"jn1_hot": "inner", "jn2_hot": "left", "jn3_hot": "right", "jn4_hot": "outer"}

QUERIES = {
    "jn0": _jn0,
    "jn0_counts": _jn0_counts,
    "jn0_factorised": _jn0_factorised,
    "jn1": _join("inner"),
    "jn2": _join("left"),
    "jn3": _join("right"),
    "jn4": _join("outer"),
    "jn5": _jn5,
    "src7": _src7,
    "grp1": _grp1,
    "grp1_top": _grp1_top,
    "grp2": lambda s, d: grouping.sql_query(load(s, d, "lineitem"), _GRP2),
    "grp3": lambda s, d: grouping.summarize_all(holed_orders(s, d)),
    "grp4": lambda s, d: grouping.kpi_cards(load(s, d, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_orderkey"), 4).withColumn("value", F.round("value", 4)),
    "grp5": lambda s, d: grouping.dataset_summary(load(s, d, "lineitem"), relationships.value_overlap(load(s, d, "lineitem"), KEYS)),
    "grp6": _grp6,
    "grp6_bar": _grp6_bar,
    "grp6_line": _grp6_line,
    "grp6_scatter": lambda s, d: grouping.chart_series(load(s, d, "part"), "p_size", "p_retailprice", "scatter"),
    "grp6_heatmap": _grp6_heatmap,
    "grp7": _grp7,
}

SQL = {
    "jn0": _JN0_SQL,
    "jn0_counts": f"WITH {_BLANK_SQL} SELECT * FROM n",
    "jn0_factorised": f"""WITH {_BLANK_SQL} SELECT count(*) AS joined, count(o_orderkey) AS with_order, count(event_id) AS with_event, (SELECT sum(joined_rows)::BIGINT FROM n) AS whole
        FROM (SELECT * FROM o WHERE k <> '') FULL JOIN (SELECT * FROM e WHERE k <> '') USING (k)""",
    "jn1": _join_sql("INNER", "c_custkey"),
    "jn2": _join_sql("LEFT", "c_custkey"),
    "jn3": _join_sql("RIGHT", "CASE WHEN here THEN c_custkey ELSE o_custkey END"),
    "jn4": _join_sql("FULL", "CASE WHEN here THEN c_custkey ELSE o_custkey END"),
    "jn5": """SELECT 'nation_customer' AS relation_id, 'customer' AS source_table, 'c_nationkey' AS source_column, 'nation' AS target_table,
        'n_nationkey' AS target_column, 'inner' AS join_type, (SELECT count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey) AS joined_rows
        UNION ALL SELECT 'nation_supplier', 'supplier', 's_nationkey', 'nation', 'n_nationkey', 'left',
        (SELECT count(*) FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)""",
    "src7": """SELECT c_nationkey, c_custkey AS source_c_custkey, c_name AS source_c_name, c_acctbal AS source_c_acctbal, c_mktsegment AS source_c_mktsegment,
        n_name AS target_n_name, n_regionkey AS target_n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "grp1": with_holed(
        """SELECT o_orderpriority, round(coalesce(sum(o_totalprice), 0), 2) AS total, round(coalesce(avg(o_totalprice), 0), 4) AS mean, count(*) AS rows,
        coalesce(min(o_totalprice), 0) AS low, coalesce(max(o_totalprice), 0) AS high, 0.0::DOUBLE AS text_mean FROM ho GROUP BY 1"""
    ),
    "grp1_top": "SELECT l_suppkey, sum(l_quantity) AS quantity, count(*) AS rows FROM lineitem GROUP BY 1 ORDER BY quantity DESC, l_suppkey LIMIT 25",
    "grp2": _GRP2.replace("dataset", "lineitem"),
    "grp3": with_holed(_grp3_sql([("o_orderkey", "i"), ("o_custkey", "i"), ("o_totalprice", "d")])),
    "grp4": stacked(
        f"SELECT {i} AS card, '{c}' AS \"column\", 'avg' AS aggregation, round(avg({c}), 4) AS value FROM lineitem"
        for i, c in enumerate(["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    ),
    "grp5": f"""SELECT count(*) AS row_count, (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE lineitem)) AS column_count,
        (SELECT CAST(count(*) AS INTEGER) FROM (DESCRIBE lineitem) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE')) AS numeric_count,
        (SELECT CAST(count(*) AS INTEGER) FROM ({overlap_sql(KEYS, 'lineitem', KEYS[:5])})) AS relationship_count FROM lineitem""",
    "grp6": """SELECT o_orderpriority AS x, round(sum(o_totalprice), 2) AS y, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS share
        FROM orders GROUP BY 1""",
    "grp6_bar": "SELECT l_returnflag AS x, sum(l_quantity) AS y FROM lineitem GROUP BY 1",
    "grp6_line": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS x, round(sum(o_totalprice), 2) AS y FROM orders GROUP BY 1",
    "grp6_scatter": "SELECT p_size AS x, p_retailprice AS y FROM part",
    "grp6_heatmap": stacked(
        f"SELECT '{a}' AS source_column, '{b}' AS target_column, {'max(1.0)::DOUBLE' if a == b else _R.format(x=a, y=b)} AS r FROM orders"
        for a in ["o_orderkey", "o_custkey", "o_totalprice"] for b in ["o_orderkey", "o_custkey", "o_totalprice"]
    ),
    "grp7": _GRP7_SQL,
}
QUERIES |= {name: _hot(how) for name, how in _HOT.items()}
SQL |= {name: _hot_sql("FULL" if how == "outer" else how.upper()) for name, how in _HOT.items()}
