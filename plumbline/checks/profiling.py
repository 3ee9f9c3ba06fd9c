"""Profiles, quality, outliers and personal data."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.checks.correlating import significant
from plumbline.checks.tables import from_sql, holed_lines, holed_orders, load, plain, stacked, with_holed
from plumbline.functions.fixed import PII_PATTERNS
from plumbline.operators import outliers, pii, profile, quality
from plumbline.plans.report import report_figures

NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
ORDER_NUMBERS = ["o_orderkey", "o_custkey", "o_totalprice"]
TYPES = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}
CATEGORY = {"bigint": "integer", "double": "float", "string": "string", "timestamp_ntz": "datetime"}


def _rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def _agg1(spark, sf):
    out = profile.profile_schema(holed_orders(spark, sf), ["o_orderkey"])
    return out.withColumn("samples", F.array_join("samples", "|"))


def _bytes(c):
    return f"strlen({c})" if TYPES[c] == "string" else f"CASE WHEN {c} IS NOT NULL THEN 8 END"


def _sample(c, k):
    text = rf"regexp_replace(CAST({c} AS VARCHAR), '\.0$', '')"
    return f"(SELECT string_agg(v, '|' ORDER BY o_orderkey) FROM (SELECT o_orderkey, {text} AS v FROM ho WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT {k}))"


_UNIQUE = "(count(DISTINCT {c}) + CAST(count(*) > count({c}) AS BIGINT))"

_AGG1_SQL = stacked(
    f"""SELECT {i} AS position, '{c}' AS "column", '{TYPES[c]}' AS dtype, '{CATEGORY[TYPES[c]]}' AS dtype_category,
        count(*) AS rows, count(*) - count({c}) AS null_count,
        round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS null_percentage,
        {_UNIQUE.format(c=c)} AS cardinality,
        round({_UNIQUE.format(c=c)} * 100.0 / count(*), 2)::DOUBLE AS cardinality_ratio,
        CAST(sum({_bytes(c)}) AS BIGINT) AS size_bytes,
        {str(TYPES[c] in ('bigint', 'double')).lower()} AS is_numeric,
        {_UNIQUE.format(c=c)} BETWEEN 1 AND 20 AS is_categorical,
        {str(TYPES[c] == 'timestamp_ntz').lower()} AS is_datetime,
        {_sample(c, 5)} AS samples
        FROM ho"""
    for i, c in enumerate(ORDERS)
)


def _agg3_sql(table, columns, extra=""):
    return stacked(
        f"""SELECT '{c}' AS "column", round(avg({c}), 4) AS mean, round(median({c}), 4)::DOUBLE AS median,
            round(stddev_samp({c}), 4) AS std, round(var_samp({c}), 2) AS variance,
            min({c})::DOUBLE AS min, max({c})::DOUBLE AS max,
            round(quantile_cont({c}::DOUBLE, 0.25), 4) AS q1, round(quantile_cont({c}::DOUBLE, 0.75), 4) AS q3,
            round(quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25), 4) AS iqr,
            round(avg(power(({c} - m) / s, 3)), 4) AS skewness, round(kurtosis_pop({c}), 4) AS kurtosis,
            count(*) FILTER ({c} = 0) AS zero_count, count(*) - count({c}) AS null_count, count({c}) AS count
            {extra.format(c=c)}
            FROM {table}, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM {table})"""
        for c in columns
    )


_STATS = ["column", "mean", "median", "std", "variance", "min", "max", "q1", "q3", "iqr", "skewness", "kurtosis", "zero_count", "null_count", "count"]


def _stats(df):
    return _rounded(df, 4, "mean", "median", "std", "q1", "q3", "iqr", "skewness", "kurtosis").withColumn("variance", F.round("variance", 2))


def _agg3(spark, sf, **size):
    return _stats(profile.univariate_stats(load(spark, sf, "lineitem"), **size)).select(*_STATS)


def _agg3_gaps(spark, sf):
    return _stats(profile.univariate_stats(holed_lines(spark, sf))).select(*_STATS)


_DETAIL = """, round(stddev_samp({c}) / abs(avg({c})), 4) AS cv, (max({c}) - min({c}))::DOUBLE AS range,
    (SELECT v::DOUBLE FROM (SELECT {c} AS v, count(*) AS n FROM lineitem GROUP BY 1) ORDER BY n DESC, v LIMIT 1) AS mode,
    (SELECT count(*) AS n FROM lineitem GROUP BY {c} ORDER BY n DESC LIMIT 1) AS mode_count,
    round(quantile_cont({c}::DOUBLE, 0.01), 4) AS p1, round(quantile_cont({c}::DOUBLE, 0.05), 4) AS p5,
    round(quantile_cont({c}::DOUBLE, 0.10), 4) AS p10, round(quantile_cont({c}::DOUBLE, 0.90), 4) AS p90,
    round(quantile_cont({c}::DOUBLE, 0.95), 4) AS p95, round(quantile_cont({c}::DOUBLE, 0.99), 4) AS p99,
    0::BIGINT AS inf_count"""


def _agg4(spark, sf, **size):
    df = _stats(profile.univariate_detailed(load(spark, sf, "lineitem"), **size))
    tails = ["p1", "p5", "p10", "p90", "p95", "p99"]
    return _rounded(df, 4, *tails).select(*_STATS, "cv", "range", "mode", "mode_count", *tails, "inf_count")


def _agg5(spark, sf):
    return profile.univariate_stats_nearest(holed_lines(spark, sf)).drop("position")


_AGG5_SQL = with_holed(
    stacked(
        f"""SELECT '{c}' AS "column", round(avg(v), 4) AS mean,
            round(CASE WHEN count(*) % 2 = 0 THEN (max(v) FILTER (rn = n // 2 - 1) + max(v) FILTER (rn = n // 2)) / 2
                  ELSE max(v) FILTER (rn = n // 2) END, 4) AS median,
            round(stddev_samp(v), 4) AS std, round(min(v), 4) AS min, round(max(v), 4) AS max,
            round(max(v) FILTER (rn = n // 4), 4) AS q1, round(max(v) FILTER (rn = 3 * n // 4), 4) AS q3,
            round(max(v) FILTER (rn = 3 * n // 4) - max(v) FILTER (rn = n // 4), 4) AS iqr,
            (SELECT count(*) - count({c}) FROM hl) AS null_count, count(*) AS count
            FROM (SELECT {c}::DOUBLE AS v, row_number() OVER (ORDER BY {c}) - 1 AS rn, count(*) OVER () AS n
                  FROM hl WHERE {c} IS NOT NULL)"""
        for c in ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    )
)


def _texts(spark, sf):
    """Orders as a CSV reader would give them: every column as text."""
    df = holed_orders(spark, sf)
    return df.select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("string").alias("price"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false").alias("even"),
        F.concat(F.lit("$"), F.col("o_orderkey").cast("string")).alias("money"),
    )


_TEXTS_SQL = """t AS (SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS customer, o_orderstatus AS status,
    CAST(o_totalprice AS VARCHAR) AS price, strftime(o_orderdate, '%Y-%m-%d') AS day,
    CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END AS even, '$' || o_orderkey AS money FROM ho)"""
_TEXT_COLUMNS = ["o_orderkey", "customer", "status", "price", "day", "even", "money"]


def _with_texts(body):
    return with_holed("SELECT 1").removesuffix("SELECT 1").rstrip() + f", {_TEXTS_SQL} {body}"


def _agg6(spark, sf):
    out = profile.column_types(_texts(spark, sf), ["o_orderkey"])
    return out.withColumn("samples", F.array_join("samples", "|"))


def _text_sample(c, k=5):
    return f"(SELECT string_agg(v, '|' ORDER BY o_orderkey) FROM (SELECT o_orderkey, CAST({c} AS VARCHAR) AS v FROM t WHERE {c} IS NOT NULL ORDER BY o_orderkey LIMIT {k}))"


_NUMBER = r"'^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$'"

_AGG6_SQL = _with_texts(
    stacked(
        f"""SELECT {i} AS position, '{c}' AS "column",
            CASE WHEN count({c}) = 0 THEN 'unknown'
                 WHEN count(*) FILTER ({c}::VARCHAR IN ('true', 'false')) = count({c}) THEN 'boolean'
                 WHEN count(*) FILTER (regexp_matches({c}::VARCHAR, {_NUMBER})) = count({c}) THEN 'number'
                 WHEN regexp_matches(arg_min({c}::VARCHAR, o_orderkey), '^\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN 'date'
                 ELSE 'string' END AS dtype,
            count(*) - count({c}) AS null_count,
            round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS null_percentage,
            count(DISTINCT {c}) AS cardinality, {_text_sample(c)} AS samples FROM t"""
        for i, c in enumerate(_TEXT_COLUMNS)
    )
)


def _agg7(spark, sf):
    out = profile.infer_types(_texts(spark, sf), ["o_orderkey"])
    return out.withColumn("samples", F.array_join("samples", "|"))


_AGG7_SQL = _with_texts(
    """SELECT position, "column",
        CASE WHEN "column" = 'o_orderkey' THEN CASE WHEN d <= 2 THEN 'boolean' ELSE 'int' END
             WHEN regexp_matches(f, '^\\d{4}-\\d{2}-\\d{2}$') THEN 'date'
             WHEN d * 1.0 / n < 0.1 AND d <= 20 THEN 'categorical'
             WHEN numbers = n THEN 'float'
             WHEN avg_length > 50 OR d * 1.0 / n > 0.8 THEN 'text' ELSE 'str' END AS detected_type,
        CASE WHEN regexp_matches(f, '^\\d{4}-\\d{2}-\\d{2}$') THEN '%Y-%m-%d' END AS format_spec,
        CASE WHEN "column" = 'o_orderkey' THEN CASE WHEN d <= 2 THEN 0.85 ELSE 0.95 END
             WHEN regexp_matches(f, '^\\d{4}-\\d{2}-\\d{2}$') THEN 0.70
             WHEN d * 1.0 / n < 0.1 AND d <= 20 THEN 0.85
             WHEN numbers = n THEN 0.60
             WHEN avg_length > 50 OR d * 1.0 / n > 0.8 THEN 0.75 ELSE 0.80 END::DOUBLE AS confidence,
        nullable, samples FROM ("""
    + stacked(
        f"""SELECT {i} AS position, '{c}' AS "column", count({c}) AS n, count(DISTINCT {c}) AS d,
            arg_min({c}::VARCHAR, o_orderkey) AS f, avg(length({c}::VARCHAR)) AS avg_length,
            count(*) FILTER (regexp_matches(regexp_replace({c}::VARCHAR, '[,$€]', '', 'g'), {_NUMBER})) AS numbers,
            count({c}) < count(*) AS nullable, {_text_sample(c)} AS samples FROM t"""
        for i, c in enumerate(_TEXT_COLUMNS)
    )
    + ")"
)


def _prj7(spark, sf):
    return profile.numeric_profile(_texts(spark, sf)).drop("position")


_PRJ7_SQL = _with_texts(
    stacked(
        f"""SELECT '{c}' AS "column", count({c}) AS "values",
            count(*) FILTER (regexp_matches({c}::VARCHAR, {_NUMBER})) AS numbers,
            count(*) FILTER (regexp_matches({c}::VARCHAR, {_NUMBER})) = count({c}) AS all_numbers,
            count(*) FILTER (regexp_matches({c}::VARCHAR, {_NUMBER})) > 0 AS some_number FROM t"""
        for c in _TEXT_COLUMNS
    )
)


def _confidence(spark, sf):
    """Event values scaled to confidences between 0 and 1."""
    return load(spark, sf, "events").select("event_id", "event_type", F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"))


_LEVEL = """CASE WHEN c >= 0.90 THEN 'high' WHEN c >= 0.70 THEN 'medium' WHEN c >= 0.50 THEN 'low' ELSE 'very_low' END AS level,
    CASE WHEN c >= 0.90 THEN 'green' WHEN c >= 0.70 THEN 'yellow' WHEN c >= 0.50 THEN 'orange' ELSE 'red' END AS color"""

_BOUNDS = """SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3,
    quantile_cont({c}::DOUBLE, 0.25) - 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) AS lo,
    quantile_cont({c}::DOUBLE, 0.75) + 1.5 * (quantile_cont({c}::DOUBLE, 0.75) - quantile_cont({c}::DOUBLE, 0.25)) AS hi FROM {t}"""


def _out_sql(table, columns):
    return stacked(
        f"""SELECT '{c}' AS "column", round(any_value(q1), 4) AS q1, round(any_value(q3), 4) AS q3,
            round(any_value(q3) - any_value(q1), 4) AS iqr, round(any_value(lo), 4) AS lower_bound, round(any_value(hi), 4) AS upper_bound,
            count(*) FILTER ({c} < lo OR {c} > hi) AS outlier_count,
            round(count(*) FILTER ({c} < lo OR {c} > hi) * 100.0 / count({c}), 2)::DOUBLE AS outlier_percentage, 'iqr' AS method
            FROM {table}, ({_BOUNDS.format(c=c, t=table)})"""
        for c in columns
    )


def _out1(spark, sf, **size):
    events = load(spark, sf, "events").select("event_id", "user_id", "value")
    return _rounded(outliers.outliers_iqr(events, **size), 4, "q1", "q3", "iqr", "lower_bound", "upper_bound")


def _out1_rows(spark, sf):
    return outliers.flag_outliers_iqr(load(spark, sf, "events"), "value").filter("is_outlier").select("event_id", "value")


def _out2(spark, sf):
    events = load(spark, sf, "events").select("event_id", "user_id", "value")
    return _rounded(outliers.outliers_zscore(events), 4, "max_zscore")


_OUT2_SQL = stacked(
    f"""SELECT '{c}' AS "column", 3.0::DOUBLE AS threshold, count(*) FILTER (abs({c} - m) / s > 3) AS outlier_count,
        round(count(*) FILTER (abs({c} - m) / s > 3) * 100.0 / count({c}), 2)::DOUBLE AS outlier_percentage,
        round(max(abs({c} - m) / s), 4) AS max_zscore, 'zscore' AS method
        FROM events, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM events)"""
    for c in ["event_id", "user_id", "value"]
)


def _qlt1(spark, sf):
    out = quality.quality_columns(holed_orders(spark, sf), ["o_orderkey"])
    return out.withColumn("samples", F.array_join("samples", "|"))


def _outlier_count(c, table):
    if c not in ORDER_NUMBERS:
        return "0::BIGINT"
    return f"(SELECT count(*) FILTER ({c} < lo OR {c} > hi) FROM {table}, ({_BOUNDS.format(c=c, t=table)}))"


_QLT1_SQL = with_holed(
    stacked(
        f"""SELECT {i} AS position, '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS null_count,
            round((count(*) - count({c})) * 100.0 / count(*), 2)::DOUBLE AS null_percentage,
            {_UNIQUE.format(c=c)} AS cardinality, round({_UNIQUE.format(c=c)} / count({c})::DOUBLE, 4) AS cardinality_ratio,
            {_outlier_count(c, 'ho')} AS outlier_count, false AS has_pii, {_sample(c, 3)} AS samples FROM ho"""
        for i, c in enumerate(ORDERS)
    )
)


def _qlt2(spark, sf):
    docs = load(spark, sf, "documents").withColumn("source", F.when(F.col("doc_id") % 4 != 0, F.col("source")))
    return quality.quality_profile(docs.select("text", "lang", "source", "n_chars"))[1]


def _any_pii(c):
    return "(" + " OR ".join(f"regexp_matches({c}, '{PII_PATTERNS[t]}')" for t in ("email", "phone", "ssn")) + ")"


_QLT2_SQL = f"""
WITH d AS (SELECT text, lang, CASE WHEN doc_id % 4 <> 0 THEN source END AS source, n_chars FROM documents),
f AS (SELECT count(*) * 4 AS cells, count(*) - count(source) AS missing,
      CAST(max(CAST({_any_pii('text')} AS INT)) + max(CAST({_any_pii('lang')} AS INT))
           + coalesce(max(CAST({_any_pii('source')} AS INT)), 0) AS BIGINT) AS pii FROM d),
o AS (SELECT count(*) FILTER (n_chars < lo OR n_chars > hi) AS outliers FROM d, ({_BOUNDS.format(c='n_chars', t='d')})),
g AS (SELECT coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS dups, sum(n)::BIGINT AS n FROM (SELECT count(*) AS n FROM d GROUP BY text, lang, source, n_chars))
SELECT cells AS total_cells, missing AS total_missing, round(missing * 100.0 / cells, 2)::DOUBLE AS missing_percentage,
    1::BIGINT AS columns_with_missing, outliers AS total_outliers, dups AS duplicate_count,
    round(dups * 100.0 / n, 2)::DOUBLE AS duplicate_percentage, pii AS pii_columns,
    round(greatest(0, 1 - 0.4::DOUBLE * missing / cells - 0.3::DOUBLE * least(outliers / cells::DOUBLE, 0.1)
        - 0.2::DOUBLE * least(dups / cells::DOUBLE, 0.1) - 0.1::DOUBLE * pii / 4), 4) AS quality_score
FROM f, o, g"""


def _qlt3(spark, sf):
    return quality.quality_metrics(_ninths(spark, sf))


# Orders with gaps and few values, so that rows repeat.
_NINTHS = """SELECT o_orderkey % 9 AS part, CASE WHEN o_orderkey % 13 <> 0 THEN o_custkey % 4 END AS customer, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS o_orderstatus,
    CASE WHEN o_orderkey % 7 <> 0 THEN round(o_totalprice / 100000, 0) END AS price, date_trunc('year', o_orderdate) AS year, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority ELSE '' END AS o_orderpriority FROM {orders}"""


def _ninths(spark, sf):
    return from_sql(spark, sf, _NINTHS)


_QLT3_SQL = f"""WITH t AS ({plain(_NINTHS)}), n AS (SELECT count(*) AS n FROM t),
    m AS ({stacked(f"SELECT count(*) FILTER ({c} IS NULL{' OR ' + c + chr(32) + '=' + chr(32) + chr(39) * 2 if c.startswith('o_') else ''}) AS k FROM t" for c in ["part", "customer", "o_orderstatus", "price", "year", "o_orderpriority"])}),
    g AS (SELECT count(*) AS groups FROM (SELECT DISTINCT * FROM t)),
    s AS (SELECT n * 6 AS cells, (SELECT sum(k)::BIGINT FROM m) AS missing, (SELECT count(*) FROM m WHERE k > 0) AS with_missing, n - groups AS surplus, n FROM n, g)
    SELECT cells AS total_cells, missing AS total_missing, round(missing * 100.0 / cells, 2)::DOUBLE AS missing_percentage, with_missing AS columns_with_missing, surplus AS duplicate_rows,
        greatest(0, round(1 - round(missing * 100.0 / cells, 2)::DOUBLE / 100 - surplus / n::DOUBLE * 0.1, 4)) AS quality_score FROM s"""


def _dup1(spark, sf):
    return quality.duplicate_rows(load(spark, sf, "documents").select("text", "lang"))


_DUP1_SQL = """SELECT sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_count,
    sum(n - 1)::BIGINT AS surplus_copies, round(coalesce(sum(n) FILTER (n > 1), 0) * 100.0 / sum(n), 2)::DOUBLE AS duplicate_percentage,
    max(n) > 1 AS has_duplicate_rows FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang)"""

_PII = ["email", "phone", "ssn", "credit_card"]


def _pii_counts(column, table):
    counts = ", ".join(f"count(*) FILTER (regexp_matches({column}, '{PII_PATTERNS[t]}')) AS {t}_count" for t in _PII)
    return f"SELECT '{column}' AS \"column\", count({column}) AS \"values\", {counts} FROM {table}"


def _pii3(spark, sf):
    out = pii.pii_report(load(spark, sf, "documents"))
    return out.withColumn("pii_types", F.array_join("pii_types", ","))


_MASK = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '\b(?:\d{4}[-.\s]?){3}(\d{4})\b', '****-****-****-\1', 'g'),
    '\b\d{3}-\d{2}-(\d{4})\b', '***-**-\1', 'g'),
    '\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?(\d{4})\b', '+***-***-\1', 'g'),
    '\b([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*@([A-Za-z0-9.-]+\.[A-Z|a-z]{2,})\b', '\1***@\2', 'g')"""


def _contacts(spark, sf):
    """Contact values derived from customers: whole values of each kind of personal data."""
    c = load(spark, sf, "customer")
    d = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    kind = F.col("c_custkey") % 5
    value = (
        F.when(kind == 0, F.concat(F.lit("user"), d, F.lit("@mail.example.com")))
        .when(kind == 1, F.concat(F.lit("555-12-"), F.right(d, F.lit(4))))
        .when(kind == 2, F.concat(F.lit("4111-1111-"), F.substring(d, 1, 4), F.lit("-"), F.right(d, F.lit(4))))
        .when(kind == 3, F.concat(F.lit("+1 (555) "), F.right(d, F.lit(7))))
        .otherwise(F.col("c_name"))
    )
    return c.select("c_custkey", value.alias("contact"))


_PII4_SQL = """SELECT c_custkey, CASE c_custkey % 5
    WHEN 0 THEN 'u***@***.example.com'
    WHEN 1 THEN '***-**-' || right(d, 4)
    WHEN 2 THEN '****-****-****-' || right(d, 4)
    WHEN 3 THEN '*******' || right(d, 4)
    ELSE c_name END AS contact
    FROM (SELECT c_custkey, c_name, lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS d FROM customer)"""

def _report(spark, sf):
    """The figures of a report on orders with gaps, and on the trends of its numbers, in one row."""
    df = holed_orders(spark, sf)
    found = report_figures(df, "orders", ["o_orderkey"])
    pairs = found.bivariate.agg(F.count("*").alias("pairs"), F.count_if("significant").alias("significant_pairs"))
    moves = found.trends.agg(F.count("*").alias("trends"), F.max(F.when(F.col("column") == "o_totalprice", F.col("direction"))).alias("price_direction"))
    spread = found.univariate.filter("column = 'o_totalprice'").select(F.round("cv", 4).alias("price_cv"), F.round("range", 2).alias("price_range"))
    span = found.date_range.select("span_days", F.date_format("start", "yyyy-MM-dd").alias("first_day"))
    parts = [found.summary.select("total_columns", "numeric_columns", "datetime_columns", "text_columns"), pairs, moves, spread, span]
    values = {name: value for part in parts for name, value in part.first().asDict().items()}
    kind = lambda v: "double" if isinstance(v, float) else "bigint" if isinstance(v, int) else "string"
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{name} {kind(v)}" for name, v in values.items()))


def _report_sql():
    square = lambda a, b: f"(SELECT corr({a}, {b}) ** 2 FROM ho WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    n = lambda a, b: f"(SELECT count(*) FROM ho WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    pairs = stacked(f"SELECT {significant(square(a, b), n(a, b))} AS s" for a in ORDER_NUMBERS for b in ORDER_NUMBERS if a < b)
    return with_holed(
        f""", s AS (SELECT count(*) AS total_columns, count(*) FILTER (is_numeric) AS numeric_columns, count(*) FILTER (is_datetime) AS datetime_columns,
            count(*) FILTER (NOT is_numeric AND NOT is_categorical AND NOT is_datetime) AS text_columns FROM ({_AGG1_SQL})),
        f AS (SELECT last_value(o_totalprice IGNORE NULLS) OVER (ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS v, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS x FROM ho),
        p AS (SELECT round(stddev_samp(o_totalprice) / abs(avg(o_totalprice)), 4) AS price_cv, round(max(o_totalprice) - min(o_totalprice), 2) AS price_range,
            CAST(floor(epoch(max(o_orderdate) - min(o_orderdate)) / 86400) AS BIGINT) AS span_days, strftime(min(o_orderdate), '%Y-%m-%d') AS first_day FROM ho)
        SELECT s.*, numeric_columns * numeric_columns AS pairs, numeric_columns + 2 * (SELECT count(*) FROM ({pairs}) WHERE s) AS significant_pairs, numeric_columns AS trends,
            (SELECT CASE WHEN regr_slope(v, x) > 0 THEN 'increasing' WHEN regr_slope(v, x) < 0 THEN 'decreasing' ELSE 'stable' END FROM f) AS price_direction, p.* FROM s, p"""
    )


QUERIES = {
    "agg1_table": lambda s, d: quality.table_profile(load(s, d, "documents").unionAll(load(s, d, "documents").filter("doc_id % 7 = 3"))),
    "agg1": _agg1,
    "report": _report,
    "agg2": lambda s, d: profile.schema_summary(profile.profile_schema(holed_orders(s, d))),
    "agg3": _agg3,
    "agg3_brackets": lambda s, d: _agg3(s, d, percentile_rows=0),
    "agg3_gaps": _agg3_gaps,
    "agg4": _agg4,
    "agg4_brackets": lambda s, d: _agg4(s, d, percentile_rows=0),
    "agg5": _agg5,
    "agg6": _agg6,
    "agg7": _agg7,
    "agg8": lambda s, d: profile.overall_confidence(_confidence(s, d)),
    "agg9": lambda s, d: profile.confidence_levels(_confidence(s, d)),
    "prj7": _prj7,
    "qlt1": _qlt1,
    "qlt2": _qlt2,
    "qlt3": _qlt3,
    "dup1": _dup1,
    "dup1_lines": lambda s, d: quality.duplicate_rows(load(s, d, "lineitem")),
    "crd1": lambda s, d: profile.cardinality(load(s, d, "lineitem")).drop("position"),
    "out1": _out1,
    "out1_brackets": lambda s, d: _out1(s, d, percentile_rows=0),
    "out1_rows": _out1_rows,
    "out2": _out2,
    "pii1": lambda s, d: pii.detect_pii(load(s, d, "documents")).drop("position"),
    "pii2": lambda s, d: pii.mask_pii(load(s, d, "documents"), ["text"]).select("doc_id", "text"),
    "pii3": _pii3,
    "pii4": lambda s, d: pii.mask_pii_values(_contacts(s, d)),
}

SQL = {
    "agg1_table": """SELECT count(*) AS rows, (SELECT count(*) FROM (DESCRIBE documents)) AS "columns",
        CAST(sum(strlen(doc_id::VARCHAR) + coalesce(strlen(text), 0) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0) + coalesce(strlen(n_chars::VARCHAR), 0)) AS BIGINT) AS bytes,
        count(*) > count(DISTINCT doc_id) AS has_duplicate_rows FROM (SELECT * FROM documents UNION ALL SELECT * FROM documents WHERE doc_id % 7 = 3)""",
    "agg1": with_holed(_AGG1_SQL),
    "report": _report_sql(),
    "agg2": with_holed(
        f"""SELECT count(*) AS total_columns, count(*) FILTER (is_numeric) AS numeric_columns,
        count(*) FILTER (is_categorical) AS categorical_columns, count(*) FILTER (is_datetime) AS datetime_columns,
        count(*) FILTER (NOT is_numeric AND NOT is_categorical AND NOT is_datetime) AS text_columns,
        round(avg(null_percentage), 2) AS null_percentage_total, round(avg(cardinality), 1) AS avg_cardinality FROM ({_AGG1_SQL})"""
    ),
    "agg3": _agg3_sql("lineitem", NUMBERS),
    "agg3_gaps": with_holed(_agg3_sql("hl", ["l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"])),
    "agg4": _agg3_sql("lineitem", NUMBERS, _DETAIL),
    "agg5": _AGG5_SQL,
    "agg6": _AGG6_SQL,
    "agg7": _AGG7_SQL,
    "agg8": "SELECT round(avg(least(value / 100, 1.0)), 4) AS overall_confidence FROM events",
    "agg9": f"SELECT level, color, count(*) AS sections FROM (SELECT {_LEVEL} FROM (SELECT least(value / 100, 1.0) AS c FROM events)) GROUP BY 1, 2",
    "prj7": _PRJ7_SQL,
    "qlt1": _QLT1_SQL,
    "qlt2": _QLT2_SQL,
    "qlt3": _QLT3_SQL,
    "dup1": _DUP1_SQL,
    "dup1_lines": """SELECT sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS duplicate_count,
        sum(n - 1)::BIGINT AS surplus_copies, round(coalesce(sum(n) FILTER (n > 1), 0) * 100.0 / sum(n), 2)::DOUBLE AS duplicate_percentage,
        max(n) > 1 AS has_duplicate_rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY """
    + ", ".join([*NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]) + ")",
    "crd1": stacked(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS distinct_values FROM lineitem"
        for c in [*NUMBERS, "l_returnflag", "l_linestatus", "l_shipdate"]
    ),
    "out1": _out_sql("events", ["event_id", "user_id", "value"]),
    "out1_rows": f"SELECT event_id, value FROM events, ({_BOUNDS.format(c='value', t='events')}) WHERE value < lo OR value > hi",
    "out2": _OUT2_SQL,
    "pii1": stacked(_pii_counts(c, "documents") for c in ["text", "lang", "source"]),
    "pii2": f"SELECT doc_id, {_MASK} AS text FROM documents",
    "pii3": "SELECT \"column\", concat_ws(',', "
    + ", ".join(f"CASE WHEN {t}_count > 0 THEN '{t}' END" for t in _PII)
    + ") AS pii_types FROM ("
    + stacked(_pii_counts(c, "documents") for c in ["text", "lang", "source"])
    + ") WHERE email_count + phone_count + ssn_count + credit_card_count > 0",
    "pii4": _PII4_SQL,
}
# The path of large tables, taken at any size, gives the same.
SQL |= {f"{name}_brackets": SQL[name] for name in ("agg3", "agg4", "out1")}
