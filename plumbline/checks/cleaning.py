"""Imputation, cleaning plans, comparison of versions and audit rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.checks.tables import from_sql, holed_orders, load, plain, with_holed
from plumbline.operators import audit, cleaning
from plumbline.operators.outliers import collect_bounds, iqr_bounds
from plumbline.operators.quality import duplicate_rows, quality_columns
from plumbline.plans.prepare import clean_table

COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority"
SHOWN = COLUMNS.replace("o_custkey", "o_custkey::DOUBLE AS o_custkey")


def _orders(spark, sf):
    return holed_orders(spark, sf).drop("o_orderdate")


def _prices(df, digits=4):
    return df.withColumn("o_totalprice", F.round("o_totalprice", digits))


def _key_as_double(df):
    """Whole numbers with gaps as double, which both engines hand over in the same way."""
    return df.withColumn("o_custkey", F.col("o_custkey").cast("double"))


def _constant_sql(custkey, price):
    """Orders with the two numeric columns filled from scalar expressions."""
    return with_holed(
        f"""SELECT o_orderkey, coalesce(o_custkey::DOUBLE, {custkey})::DOUBLE AS o_custkey, o_orderstatus,
        round(coalesce(o_totalprice, {price}), 4)::DOUBLE AS o_totalprice, o_orderpriority FROM ho"""
    )


def _imputed(strategy, **size):
    def run(spark, sf):
        out = _prices(cleaning.impute(_orders(spark, sf), strategy, ["o_custkey", "o_orderstatus", "o_totalprice"], **size))
        return out.withColumn("o_custkey", F.round(F.col("o_custkey").cast("double"), 4))

    return run


def _mode(c, extra=""):
    return f"(SELECT {c} FROM (SELECT {c}, count(*) AS n FROM ho WHERE {c} IS NOT NULL {extra} GROUP BY 1) ORDER BY n DESC, {c} LIMIT 1)"


def _directional(direction):
    def run(spark, sf):
        return cleaning.impute(
            _orders(spark, sf).join(load(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderkey"),
            direction, ["o_totalprice", "o_orderstatus"], ["o_orderdate", "o_orderkey"],
        ).select("o_orderkey", "o_totalprice", "o_orderstatus")

    return run


def _by_days(spark, sf):
    """Few first values, and an order only the third column decides."""
    orders = from_sql(spark, sf, "SELECT o_orderkey, date_trunc('YEAR', o_orderdate) AS year, o_orderstatus, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice FROM {orders}")
    return cleaning.impute(orders, "forward", ["o_totalprice"], ["year", "o_orderstatus", "o_orderkey"]).select("o_orderkey", "o_totalprice")


def _grouped_fill(spark, sf):
    events = from_sql(spark, sf, "SELECT event_id, user_id, event_type, ts, CASE WHEN event_id % 3 = 0 THEN value END AS value FROM {events}")
    return cleaning.impute(events, "forward", ["value"], ["ts", "event_id"], ["event_type"]).select("event_id", "value")


def _fill_sql(function, frame):
    w = f"OVER (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN {frame})"
    return with_holed(
        f"""SELECT o_orderkey, {function}(o_totalprice IGNORE NULLS) {w} AS o_totalprice,
        {function}(o_orderstatus IGNORE NULLS) {w} AS o_orderstatus FROM ho"""
    )


def _cln12(spark, sf):
    """The cleaned table of a rule plan over orders with gaps and doubled rows."""
    return _prices(clean_table(_doubled(spark, sf))[2]).withColumn("o_custkey", F.round("o_custkey", 4))


def _doubled(spark, sf):
    df = _orders(spark, sf)
    return df.unionAll(df.filter(F.col("o_orderkey") % 10 == 3))


def _plan(spark, sf):
    df = _doubled(spark, sf)
    bounds = collect_bounds(iqr_bounds(df))
    plan = cleaning.cleaning_plan(quality_columns(df), df, bounds, duplicate_rows(df).first()["duplicate_count"])
    rows = [(i, op.column, op.strategy, op.issue, op.parameters.get("strategy"), op.confidence) for i, op in enumerate(plan)]
    return spark.createDataFrame(rows, "place int, column string, strategy string, issue string, fill string, confidence double")


_DOUBLED = f", dd AS (SELECT {COLUMNS} FROM ho UNION ALL SELECT {COLUMNS} FROM ho WHERE o_orderkey % 10 = 3)"


def _missing(c):
    return f"(SELECT 'Missing values (' || round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE || '%)' FROM dd)"


_CLN11_SQL = with_holed(
    f"""{_DOUBLED} SELECT 0 AS place, 'o_custkey' AS "column", 'impute' AS strategy, {_missing('o_custkey')} AS issue, 'mean' AS fill, 0.85::DOUBLE AS confidence
    UNION ALL SELECT 1, 'o_orderstatus', 'impute', {_missing('o_orderstatus')}, 'mode', 0.75
    UNION ALL SELECT 2, 'o_totalprice', 'impute', {_missing('o_totalprice')}, 'mean', 0.85
    UNION ALL SELECT 3, '*', 'remove', 'Duplicate rows (' || (SELECT sum(n) FILTER (n > 1) FROM (SELECT count(*) AS n FROM dd GROUP BY {COLUMNS})) || ')', NULL, 0.90"""
)
_CLN12_SQL = with_holed(
    f"""{_DOUBLED}, m AS (SELECT avg(o_custkey) AS c, avg(o_totalprice) AS p,
        (SELECT o_orderstatus FROM (SELECT o_orderstatus, count(*) AS n FROM dd WHERE o_orderstatus IS NOT NULL GROUP BY 1) ORDER BY n DESC, 1 LIMIT 1) AS s FROM dd)
    SELECT DISTINCT o_orderkey, round(coalesce(o_custkey::DOUBLE, c), 4) AS o_custkey, coalesce(o_orderstatus, s) AS o_orderstatus,
        round(coalesce(o_totalprice, p), 4) AS o_totalprice, o_orderpriority FROM dd, m"""
)


def _aud1(spark, sf):
    trail = clean_table(_doubled(spark, sf))[3]
    return trail.select("sequence", "step", "column", F.regexp_extract("description", "^[a-z]+", 0).alias("strategy"), "status", "rows_before", "rows_after")


_AUD1_SQL = with_holed(
    f"""{_DOUBLED}, n AS (SELECT count(*) AS n, count(DISTINCT o_orderkey) AS d FROM dd)
    SELECT 0 AS sequence, 'clean' AS step, 'o_custkey' AS "column", 'impute' AS strategy, 'completed' AS status, n AS rows_before, n AS rows_after FROM n
    UNION ALL SELECT 1, 'clean', 'o_orderstatus', 'impute', 'completed', n, n FROM n
    UNION ALL SELECT 2, 'clean', 'o_totalprice', 'impute', 'completed', n, n FROM n
    UNION ALL SELECT 3, 'clean', '*', 'remove', 'completed', n, d FROM n"""
)


def _contacts(spark, sf):
    return from_sql(
        spark, sf,
        """SELECT c_nationkey, c_mktsegment, CASE WHEN c_custkey % 4 <> 1 THEN c_acctbal END AS c_acctbal,
           CASE WHEN c_custkey % 6 = 0 THEN '' ELSE concat('user', CAST(c_custkey % 50 AS STRING), '@mail.example.com') END AS contact,
           CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM {customer}""",
    )


_CONTACTS_SQL = """base AS (SELECT c_nationkey, c_mktsegment, CASE WHEN c_custkey % 4 <> 1 THEN c_acctbal END AS c_acctbal,
    CASE WHEN c_custkey % 6 = 0 THEN '' ELSE 'user' || (c_custkey % 50) || '@mail.example.com' END AS contact,
    CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS segment FROM customer)"""


def _filled_sql(source):
    return f"""SELECT c_nationkey, c_mktsegment, coalesce(c_acctbal, (SELECT round(avg(c_acctbal), 2) FROM {source})) AS c_acctbal,
    coalesce(nullif(contact, ''), (SELECT contact FROM {source} WHERE contact <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS contact,
    coalesce(nullif(segment, ''), (SELECT segment FROM {source} WHERE segment <> '' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS segment
    FROM {source}"""


_MASKED = """masked AS (SELECT DISTINCT c_nationkey, c_mktsegment, c_acctbal,
    CASE WHEN contact = '' THEN '' ELSE left(contact, 1) || '***@***.example.com' END AS contact, segment FROM base)"""


def _versions(spark, sf):
    before = _orders(spark, sf)
    after = cleaning.cap(cleaning.impute(before, "mean", ["o_totalprice"]), {"o_totalprice": (50000.0, 400000.0)})
    return before, after.filter(F.col("o_orderkey") % 100 != 99)


_VERSIONS = """, m AS (SELECT avg(o_totalprice) AS p FROM ho), b AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM ho),
    a AS (SELECT o_orderkey, o_custkey, o_orderstatus, least(400000, greatest(50000, coalesce(o_totalprice, p))) AS o_totalprice, o_orderpriority
          FROM ho, m WHERE o_orderkey % 100 <> 99),
    j AS (SELECT b.o_totalprice AS x, a.o_totalprice AS y, o_orderkey FROM b JOIN a USING (o_orderkey))"""


def _dif1(spark, sf):
    before, after = _versions(spark, sf)
    return audit.diff_columns(before, after, ["o_orderkey"])


def _dif1_samples(spark, sf):
    before, after = _versions(spark, sf)
    out = audit.diff_samples(before, after, ["o_orderkey"])
    return out.withColumns({"before": F.round(F.col("before").cast("double"), 2), "after": F.round(F.col("after").cast("double"), 2)})


def _dif1_summary(spark, sf):
    before, after = _versions(spark, sf)
    return audit.diff_summary(before, after, ["o_orderkey"])


# Lines by order: keys are repeated, one in fifty is null, some lines are changed, some lost, some doubled.
_LINES_BEFORE = "SELECT CASE WHEN l_orderkey % 50 <> 0 THEN l_orderkey END AS k, CASE WHEN l_partkey % 11 <> 0 THEN l_quantity END AS q, l_returnflag AS f FROM {lineitem}"
_LINES_AFTER = """SELECT CASE WHEN l_orderkey % 50 <> 0 THEN l_orderkey END AS k, CASE WHEN l_partkey % 97 = 5 THEN l_quantity + 1 WHEN l_partkey % 11 <> 0 OR l_suppkey % 2 = 0 THEN l_quantity END AS q,
    l_returnflag AS f FROM {lineitem} CROSS JOIN range(2) AS t(i) WHERE NOT (l_linenumber = 3 AND l_orderkey % 20 = 1) AND (i = 0 OR l_orderkey % 30 = 2)"""


def _dif1_repeated(spark, sf):
    after = _LINES_AFTER.replace("CROSS JOIN range(2) AS t(i)", "LATERAL VIEW explode(array(0, 1)) t AS i")
    return audit.diff_summary(from_sql(spark, sf, _LINES_BEFORE), from_sql(spark, sf, after), ["k"])


_COUNTS = "(SELECT count(*) FROM b) AS rows_before, (SELECT count(*) FROM a) AS rows_after"

QUERIES = {
    "cln1": _imputed("mean"),
    "cln2": _imputed("median"),
    "cln2_brackets": _imputed("median", percentile_rows=0),
    "cln3": _imputed("mode"),
    "cln4": _imputed("zero"),
    "cln5": _directional("forward"),
    "cln5_days": _by_days,
    "cln5_grouped": _grouped_fill,
    "cln6": _directional("backward"),
    "cln7": lambda s, d: cleaning.impute_all(_contacts(s, d)),
    "cln8": lambda s, d: _key_as_double(cleaning.cap(_orders(s, d), {"o_totalprice": (50000.0, 400000.0)})),
    "cln9": lambda s, d: _key_as_double(cleaning.drop_duplicates(_doubled(s, d))),
    "cln10": lambda s, d: _key_as_double(cleaning.transform(_orders(s, d), "o_totalprice", "o_totalprice / 2 + o_orderkey")),
    "cln11": _plan,
    "cln12": _cln12,
    "cln13": lambda s, d: cleaning.clean(_contacts(s, d)),
    "dif1": _dif1,
    "dif1_samples": _dif1_samples,
    "dif1_summary": _dif1_summary,
    "dif1_repeated": _dif1_repeated,
    "aud1": _aud1,
}

SQL = {
    "cln1": _constant_sql("(SELECT round(avg(o_custkey), 4) FROM ho)", "(SELECT avg(o_totalprice) FROM ho)"),
    "cln2": _constant_sql("(SELECT median(o_custkey) FROM ho)", "(SELECT median(o_totalprice) FROM ho)"),
    "cln3": with_holed(
        f"""SELECT o_orderkey, coalesce(o_custkey, {_mode('o_custkey')})::DOUBLE AS o_custkey, coalesce(o_orderstatus, {_mode('o_orderstatus')}) AS o_orderstatus,
        coalesce(o_totalprice, {_mode('o_totalprice')}) AS o_totalprice, o_orderpriority FROM ho"""
    ),
    "cln4": _constant_sql("0", "0"),
    "cln5": _fill_sql("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"),
    "cln5_days": """SELECT o_orderkey, last_value(v IGNORE NULLS) OVER (ORDER BY date_trunc('year', o_orderdate), o_orderstatus, o_orderkey ROWS UNBOUNDED PRECEDING) AS o_totalprice
        FROM (SELECT *, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS v FROM orders)""",
    "cln5_grouped": """SELECT event_id, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS value
        FROM (SELECT event_id, event_type, ts, CASE WHEN event_id % 3 = 0 THEN value END AS v FROM events)""",
    "cln6": _fill_sql("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING"),
    "cln7": f"WITH {_CONTACTS_SQL} {_filled_sql('base')}",
    "cln8": with_holed(f"SELECT {SHOWN.replace('o_totalprice', 'CASE WHEN o_totalprice IS NOT NULL THEN least(400000, greatest(50000, o_totalprice)) END AS o_totalprice')} FROM ho"),
    "cln9": with_holed(f"SELECT {SHOWN} FROM ho"),
    "cln10": with_holed(f"SELECT {SHOWN.replace('o_totalprice', 'o_totalprice / 2 + o_orderkey AS o_totalprice')} FROM ho"),
    "cln11": _CLN11_SQL,
    "cln12": _CLN12_SQL,
    "cln13": f"WITH {_CONTACTS_SQL}, {_MASKED} {_filled_sql('masked')}",
    "dif1": with_holed(
        f"""{_VERSIONS} SELECT 'o_totalprice' AS "column", {_COUNTS}, count(*) FILTER (x <> y) AS changed_count,
        count(*) FILTER (x IS NULL) AS filled_count, round(count(*) FILTER (x <> y) * 100.0 / (SELECT count(*) FROM b), 2)::DOUBLE AS change_percentage FROM j
        """ + "".join(f" UNION ALL SELECT '{c}', {_COUNTS.replace(' AS rows_before', '').replace(' AS rows_after', '')}, 0, 0, 0" for c in ["o_custkey", "o_orderstatus", "o_orderpriority"])
    ),
    "dif1_samples": with_holed(
        f"""{_VERSIONS} SELECT 'o_totalprice' AS "column", o_orderkey AS key_o_orderkey, round(x, 2) AS before, round(y, 2) AS after, sample
        FROM (SELECT *, CAST(row_number() OVER (ORDER BY o_orderkey) AS INT) AS sample FROM j WHERE x IS DISTINCT FROM y) WHERE sample <= 5"""
    ),
    "dif1_summary": with_holed(
        f"""{_VERSIONS} SELECT (SELECT count(*) FROM b) AS original_rows, (SELECT count(*) FROM a) AS cleaned_rows, 5 AS original_columns, 5 AS cleaned_columns,
        count(*) FILTER (x <> y) AS total_changes, count(*) FILTER (x IS NULL) AS total_filled, 1::BIGINT AS columns_changed, 0::BIGINT AS repeated_before, 0::BIGINT AS repeated_after FROM j"""
    ),
    "dif1_repeated": f"""WITH b AS ({plain(_LINES_BEFORE)}), a AS ({plain(_LINES_AFTER)}),
    n AS (SELECT k, sum(b)::BIGINT AS nb, sum(a)::BIGINT AS na FROM (SELECT k, 1 AS b, 0 AS a FROM b UNION ALL SELECT k, 0, 1 FROM a) GROUP BY k),
    lb AS (SELECT * FROM b EXCEPT ALL SELECT * FROM a), la AS (SELECT * FROM a EXCEPT ALL SELECT * FROM b),
    j AS (SELECT b.q AS bq, a.q AS aq, b.f AS bf, a.f AS af FROM n JOIN b ON b.k IS NOT DISTINCT FROM n.k JOIN a ON a.k IS NOT DISTINCT FROM n.k WHERE nb = 1 AND na = 1),
    c AS (SELECT count(*) FILTER (bq IS NOT NULL AND bq IS DISTINCT FROM aq) AS cq, count(*) FILTER (bf IS NOT NULL AND bf IS DISTINCT FROM af) AS cf,
          count(*) FILTER (bq IS NULL AND aq IS NOT NULL) AS fq, count(*) FILTER (bf IS NULL AND af IS NOT NULL) AS ff FROM j)
    SELECT (SELECT count(*) FROM b) AS original_rows, (SELECT count(*) FROM a) AS cleaned_rows, 3 AS original_columns, 3 AS cleaned_columns, cq + cf AS total_changes, fq + ff AS total_filled,
        CAST((cq + fq > 0)::INT + (cf + ff > 0)::INT AS BIGINT) AS columns_changed,
        (SELECT count(*) FROM lb JOIN n ON n.k IS NOT DISTINCT FROM lb.k WHERE nb > 1 OR na > 1) AS repeated_before,
        (SELECT count(*) FROM la JOIN n ON n.k IS NOT DISTINCT FROM la.k WHERE nb > 1 OR na > 1) AS repeated_after FROM c""",
    "aud1": _AUD1_SQL,
}
SQL["cln2_brackets"] = SQL["cln2"]
