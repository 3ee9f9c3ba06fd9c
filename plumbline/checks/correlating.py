"""Correlation, relationships, trends and subject areas."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from plumbline.checks.tables import TABLES, from_sql, holed_lines, load, stacked, with_holed
from plumbline.functions.fixed import DOMAINS
from plumbline.operators import correlation, domains, joins, relationships, trends

LINES = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
KEYS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]


def _r(x, y, table):
    return f"(SELECT coalesce(round(covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})), 4), 0) FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"


def _ranked(x, y, table):
    """Average ranks of both columns within the rows where both are present."""
    rank = lambda c: f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"
    return f"(SELECT {rank(x)} AS rx, {rank(y)} AS ry FROM {table} WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"


def significant(r2, n):
    """Whether a correlation with this square has a two-sided p below 0.05, by the critical t of n - 2 degrees of freedom.

    The quantile of Student's t is taken from the normal one by the first terms of its expansion, which has twelve digits
    where there are thousands of rows.
    """
    z, d = 1.959963984540054, f"({n} - 2)"
    t = f"({z} + {(z**3 + z) / 4} / {d} + {(5 * z**5 + 16 * z**3 + 3 * z) / 96} / {d} ** 2 + {(3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384} / {d} ** 3)"
    return f"coalesce({r2} >= 1 OR {r2} * {d} > (1 - {r2}) * {t} ** 2, false)"


def _rho(x, y, table):
    return f"(SELECT round(covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)), 4) FROM {_ranked(x, y, table)})"


def _matrix_sql(columns, table, cell, name="r"):
    unique = [f"SELECT '{a}' AS a, '{b}' AS b, {cell(a, b, table)} AS {name}" for a, b in combinations(columns, 2)]
    pairs = stacked(unique)
    diagonal = stacked(f"SELECT '{c}', '{c}', 1.0::DOUBLE" for c in columns)
    return f"""SELECT a AS source_column, b AS target_column, {name} FROM ({pairs})
        UNION ALL SELECT b, a, {name} FROM ({pairs}) UNION ALL {diagonal}"""


def _strength(r):
    return f"""CASE WHEN abs({r}) >= 0.8 THEN 'very_strong' WHEN abs({r}) >= 0.6 THEN 'strong'
        WHEN abs({r}) >= 0.4 THEN 'moderate' WHEN abs({r}) >= 0.2 THEN 'weak' ELSE 'very_weak' END"""


_GAPS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _wide(n):
    """``n`` columns w0, w1, ... of ``orders``: mixed with noise by key, three in four with gaps, one constant and one empty."""
    bases = ["o_totalprice", "o_custkey", "o_orderkey % 97", "length(o_orderpriority)", "o_custkey % 31"]
    out = []
    for i in range(n):
        noise = f"(o_orderkey * {i + 3} + o_custkey * {2 * i + 1}) % {11 + i}"
        value = f"CAST({bases[i % 5]} AS DOUBLE) * {1 + i % 3} + CAST({bases[(i // 5 + 2) % 5]} AS DOUBLE) * {i % 4} - {noise}"
        if i == 7:
            value = "CAST(12.3 AS DOUBLE)"
        if i % 4:
            value = f"CASE WHEN (o_orderkey + o_custkey * {i}) % {5 + i % 13} <> 0 THEN {value} END"
        if i == 13:
            value = "CASE WHEN o_orderkey < 0 THEN CAST(o_custkey AS DOUBLE) END"
        out.append(f"{value} AS w{i}")
    return f"SELECT {', '.join(out)} FROM {{orders}}"


def _wide_matrix(measure, n):
    return lambda spark, sf: measure(from_sql(spark, sf, _wide(n)))


def _wide_pairs(n, ranks):
    """Correlations of all pairs of the wide table: of values by a join of the cells of a row, of ranks pair by pair."""
    if ranks:
        parts = stacked(f"SELECT {i} AS i, {j} AS j, {_rho(f'w{i}', f'w{j}', 'wide')} AS r" for i, j in combinations(range(n), 2))
        cells = "SELECT 1"
    else:
        cells = f"SELECT r, i, v FROM (SELECT row_number() OVER () AS r, unnest(range({n})) AS i, unnest([{', '.join(f'w{i}' for i in range(n))}]) AS v FROM wide) WHERE v IS NOT NULL"
        parts = """SELECT i, j, CASE WHEN n >= 3 AND x > 0 AND y > 0 THEN round(c / sqrt(x * y), 4) END AS r FROM (
            SELECT a.i AS i, b.i AS j, count(*) AS n, covar_pop(a.v, b.v) AS c, var_pop(a.v) AS x, var_pop(b.v) AS y FROM cells AS a JOIN cells AS b ON a.r = b.r AND a.i < b.i GROUP BY 1, 2)"""
    return f"""WITH wide AS ({_wide(n).replace('{orders}', 'orders')}), cells AS ({cells}), found AS ({parts}),
        pairs AS (SELECT a.i AS i, b.j AS j, coalesce(r, 0) AS r FROM range({n}) AS a(i) JOIN range({n}) AS b(j) ON a.i < b.j LEFT JOIN found ON found.i = a.i AND found.j = b.j AND NOT isnan(r))
        SELECT 'w' || i AS source_column, 'w' || j AS target_column, r FROM pairs
        UNION ALL SELECT 'w' || j, 'w' || i, r FROM pairs UNION ALL SELECT 'w' || i, 'w' || i, 1.0::DOUBLE FROM range({n}) AS t(i)"""


def _cor3_sql(columns, table):
    n = lambda a, b: f"(SELECT count(*) FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    square = lambda a, b: f"(SELECT covar_pop({a}, {b}) ** 2 / (var_pop({a}) * var_pop({b})) FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
    pairs = stacked(
        f"SELECT '{a}' AS a, '{b}' AS b, {_r(a, b, table)} AS r, {_rho(a, b, table)} AS rho, {n(a, b)} AS n, {square(a, b)} AS r2"
        for a, b in combinations(columns, 2)
    )
    diagonal = stacked(f"SELECT '{c}', '{c}', 1.0::DOUBLE, 1.0::DOUBLE, (SELECT count({c}) FROM {table}), 1.0::DOUBLE" for c in columns)
    return f"""SELECT a AS source_column, b AS target_column, r AS pearson_r, rho AS spearman_r, n AS sample_size,
        {significant('r2', 'n')} AS significant, {_strength('r')} AS strength FROM (SELECT a, b, r, rho, n, r2 FROM ({pairs}) UNION ALL SELECT b, a, r, rho, n, r2 FROM ({pairs})
        UNION ALL {diagonal})"""


def overlap_sql(columns, table, numbers, threshold=0.3):
    """Shared distinct values of column pairs of one family."""
    pairs = [(a, b) for a, b in combinations(columns, 2) if (a in numbers) == (b in numbers)]
    cast = lambda c: f"{c}::DOUBLE" if c in numbers else c
    parts = stacked(
        f"""SELECT '{a}' AS source_column, '{b}' AS target_column,
            (SELECT count(*) FROM (SELECT {cast(a)} FROM {table} INTERSECT SELECT {cast(b)} FROM {table})) AS overlap_count,
            (SELECT count(DISTINCT {a}) FROM {table}) AS unique_values_1, (SELECT count(DISTINCT {b}) FROM {table}) AS unique_values_2"""
        for a, b in pairs
    )
    return f"""SELECT *, round(overlap_count / least(unique_values_1, unique_values_2)::DOUBLE, 4) AS overlap_ratio FROM ({parts})
        WHERE overlap_count / least(unique_values_1, unique_values_2)::DOUBLE >= {threshold}"""


# Order columns and expressions of them, so that strong correlations of either sign occur.
_RELATED = """SELECT o_orderkey, o_custkey, o_totalprice, o_totalprice * 0.1 + o_custkey AS price_tenth,
    500000 - o_totalprice AS price_left, o_orderstatus, upper(o_orderstatus) AS status_code FROM {orders}"""
_RELATED_COLUMNS = ["o_orderkey", "o_custkey", "o_totalprice", "price_tenth", "price_left", "o_orderstatus", "status_code"]
_RELATED_NUMBERS = _RELATED_COLUMNS[:5]


def _related(spark, sf):
    return from_sql(spark, sf, _RELATED)


def _candidates_sql():
    sorted_pairs = [tuple(sorted(p)) for p in combinations(_RELATED_NUMBERS, 2)]
    correlated = stacked(
        f"SELECT '{a}' AS source_column, '{b}' AS target_column, 'correlation' AS evidence, {_r(a, b, 'rel')} AS pearson_r, {_rho(a, b, 'rel')} AS spearman_r"
        for a, b in sorted_pairs
    )
    return f"""WITH rel AS ({_RELATED.replace('{orders}', 'orders')}),
    c AS (SELECT *, abs(pearson_r) AS strength FROM ({correlated}) WHERE abs(pearson_r) >= 0.5),
    o AS ({overlap_sql(_RELATED_COLUMNS, 'rel', _RELATED_NUMBERS)}),
    cand AS (SELECT source_column, target_column, evidence, pearson_r, spearman_r, strength, NULL::DOUBLE AS overlap_ratio, NULL::BIGINT AS overlap_count FROM c
        UNION ALL SELECT source_column, target_column, 'value_overlap', NULL, NULL, overlap_ratio, overlap_ratio, overlap_count FROM o
        WHERE (source_column, target_column) NOT IN (SELECT (source_column, target_column) FROM c))"""


_CANDIDATES = _candidates_sql()

_CLASSIFIED = """SELECT source_column, target_column,
    CASE WHEN evidence <> 'correlation' THEN 'one-to-many' WHEN pearson_r < -0.7 THEN 'many-to-many' ELSE 'one-to-one' END AS relationship_type,
    round(least(0.85, greatest(0.65, strength)), 2)::DOUBLE AS confidence,
    CASE WHEN evidence = 'correlation' AND abs(pearson_r) > 0.5 THEN 'scatter'
         WHEN evidence = 'correlation' AND abs(pearson_r) > 0.3 THEN 'heatmap' ELSE 'bar' END AS chart_hint,
    pearson_r AS correlation_coefficient
    FROM (SELECT * FROM cand ORDER BY strength DESC, source_column, target_column LIMIT 10)"""


def _rel5(spark, sf):
    df = _related(spark, sf)
    found = relationships.classify_relationships(relationships.relationship_candidates(df), k=10)
    return relationships.validate_relationships(found, df.columns[:-1])


_REL5_SQL = f"""{_CANDIDATES}, k AS ({_CLASSIFIED})
    SELECT 'minimum_relationships' AS "check", greatest(1 - count(*), 0) AS violations, count(*) >= 1 AS passed FROM k
    UNION ALL SELECT 'confidence_gate', count(*) FILTER (confidence < 0.7), count(*) FILTER (confidence < 0.7) = 0 FROM k
    UNION ALL SELECT 'valid_type', 0, true
    UNION ALL SELECT 'no_duplicates', 0, true
    UNION ALL SELECT 'columns_exist', count(*) FILTER (source_column = 'status_code' OR target_column = 'status_code'),
        count(*) FILTER (source_column = 'status_code' OR target_column = 'status_code') = 0 FROM k"""


def _trd1(spark, sf):
    df = from_sql(spark, sf, "SELECT o_orderkey, o_orderdate, date_format(o_orderdate, 'yyyy/MM/dd') AS day_text, CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'MM-dd-yyyy') ELSE 'open' END AS mixed, o_orderpriority FROM {orders}")
    return trends.date_columns(df)


_TRD1_SQL = """SELECT 0 AS position, 'o_orderkey' AS "column", false AS is_date, 0::BIGINT AS date_values
    UNION ALL SELECT 1, 'o_orderdate', true, (SELECT count(*) FROM orders)
    UNION ALL SELECT 2, 'day_text', true, (SELECT count(*) FROM orders)
    UNION ALL SELECT 3, 'mixed', true, (SELECT count(*) FROM orders WHERE o_orderkey % 3 = 0)
    UNION ALL SELECT 4, 'o_orderpriority', false, 0"""


def _trd1_share(spark, sf):
    df = from_sql(spark, sf, "SELECT CASE WHEN o_orderkey % 3 = 0 THEN date_format(o_orderdate, 'MM-dd-yyyy') ELSE 'open' END AS a_third, CASE WHEN o_orderkey % 3 > 0 THEN date_format(o_orderdate, 'yyyy/MM/dd') ELSE 'open' END AS two_thirds, o_orderdate FROM {orders}")
    return trends.date_columns(df, 0.5)


_TRD1_SHARE_SQL = """WITH n AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 3 = 0) AS a, count(*) FILTER (o_orderkey % 3 > 0) AS b FROM orders)
    SELECT 0 AS position, 'a_third' AS "column", a >= 0.5 * n AS is_date, a AS date_values FROM n
    UNION ALL SELECT 1, 'two_thirds', b >= 0.5 * n, b FROM n UNION ALL SELECT 2, 'o_orderdate', true, n FROM n"""


def _text_time(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def _trd3(spark, sf):
    df = from_sql(spark, sf, "SELECT ts, event_id, CASE WHEN event_id % 9 <> 4 THEN value END AS value, user_id FROM {events}")
    out = trends.linear_trend(df, ["ts", "event_id"], ["value", "user_id"])
    return out.drop("p_value")


def _trend_sql(column, expression):
    return f"""SELECT '{column}' AS "column",
        CASE WHEN regr_slope(v, x) > 0 THEN 'increasing' WHEN regr_slope(v, x) < 0 THEN 'decreasing' ELSE 'stable' END AS direction,
        round(regr_slope(v, x), 4) AS slope, round(regr_r2(v, x), 4) AS r_squared, {significant('regr_r2(v, x)', 'count(v)')} AS significant,
        CASE WHEN arg_min(v, x) FILTER (v IS NOT NULL) = 0 THEN 0 ELSE round((arg_max(v, x) - arg_min(v, x)) / abs(arg_min(v, x)) * 100, 2) END AS change_pct
        FROM (SELECT last_value(v IGNORE NULLS) OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)::DOUBLE AS v,
                     row_number() OVER (ORDER BY ts, event_id) - 1 AS x
              FROM (SELECT ts, event_id, {expression} AS v FROM events))"""


_TRD3_SQL = stacked([_trend_sql("value", "CASE WHEN event_id % 9 <> 4 THEN value END"), _trend_sql("user_id", "user_id")])


def _trd4(spark, sf):
    out = trends.aggregate_by_period(load(spark, sf, "events"), "ts", ["value"], "week", ["event_type"])
    return _text_time(out, "period").withColumns({"sum_value": F.round("sum_value", 2), "avg_value": F.round("avg_value", 4)})


def _trd4_spikes(spark, sf):
    out = trends.spikes(load(spark, sf, "events"), "ts", "value", "day", 1.5)
    return _text_time(out, "period").withColumns({"total": F.round("total", 2), "z_score": F.round("z_score", 4)})


def _activity(spark, sf):
    """Column lists of the wide activity tables per user and day that a pivot on event type gives."""
    return from_sql(
        spark, sf,
        """SELECT table_name, CAST(row_number() OVER (PARTITION BY table_name ORDER BY column_name) - 1 AS INT) AS position, column_name
           FROM (SELECT DISTINCT concat(user_id, '/', date_format(ts, 'yyyy-MM-dd')) AS table_name, concat(event_type, '_count') AS column_name FROM {events})""",
    )


def _dom1_sql():
    words = ", ".join(
        f"({i}, '{d}', '{w}', {len(k)})" for i, (d, (k, _)) in enumerate(DOMAINS.items()) for w in k
    )
    subs = ", ".join(f"('{d}', '{s}', '{s.replace('_', ' ')}')" for d, (_, ss) in DOMAINS.items() for s in ss)
    return f"""WITH cat AS (SELECT DISTINCT concat(user_id, '/', strftime(ts, '%Y-%m-%d')) AS table_name, concat(event_type, '_count') AS column_name FROM events),
    words(place, domain, word, size) AS (VALUES {words}), subs(domain, subdomain, phrase) AS (VALUES {subs}),
    hits AS (SELECT table_name, place, domain, word, size, count(*) * 2 + 1 AS points FROM cat, words WHERE contains(lower(column_name), word) GROUP BY ALL),
    scores AS (SELECT table_name, place, domain, sum(points) / any_value(size)::DOUBLE AS score FROM hits GROUP BY ALL),
    best AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY table_name ORDER BY score DESC, place) = 1),
    texts AS (SELECT table_name, string_agg(lower(column_name), ' ' ORDER BY column_name) AS text FROM cat GROUP BY 1),
    sub AS (SELECT table_name, domain, min(subdomain) AS subdomain FROM texts, subs WHERE contains(text, phrase) GROUP BY ALL)
    SELECT b.table_name, b.domain, s.subdomain, round(score, 4) AS confidence, b.domain || coalesce('/' || s.subdomain, '') AS label
    FROM best b LEFT JOIN sub s USING (table_name, domain) WHERE score >= 0.15"""


def _jn6(spark, sf):
    tables = {t: load(spark, sf, t) for t in TABLES}
    return joins.rank_cross_relations(joins.discover_cross_relations(tables), tables)


def _jn6_sql():
    pairs = [("documents", "benchmark", "text"), ("documents", "conversations", "text"), ("benchmark", "conversations", "text"), ("documents", "labels", "doc_id")]
    parts = stacked(
        f"""SELECT '{a}' AS source_table, '{c}' AS source_column, '{b}' AS target_table, '{c}' AS target_column, 'inner' AS join_type,
            (SELECT count(*) FROM (SELECT {c} FROM {a} INTERSECT SELECT {c} FROM {b})) AS overlap_count,
            (SELECT count(DISTINCT {c}) FROM {a}) AS unique_values_1, (SELECT count(DISTINCT {c}) FROM {b}) AS unique_values_2"""
        for a, b, c in pairs
    )
    return f"SELECT *, round(overlap_count / least(unique_values_1, unique_values_2)::DOUBLE, 4) AS overlap_ratio FROM ({parts})"


def _cor3(spark, sf):
    return correlation.bivariate(holed_lines(spark, sf), _GAPS).drop("p_value")


QUERIES = {
    "cor1": lambda s, d: correlation.pearson_matrix(load(s, d, "lineitem"), LINES),
    "cor1_gaps": lambda s, d: correlation.pearson_matrix(holed_lines(s, d), _GAPS),
    "cor1_wide": _wide_matrix(correlation.pearson_matrix, 200),
    "cor2_wide": _wide_matrix(correlation.spearman_matrix, 20),
    "cor2": lambda s, d: correlation.spearman_matrix(load(s, d, "lineitem"), LINES),
    "cor2_gaps": lambda s, d: correlation.spearman_matrix(holed_lines(s, d), _GAPS),
    "cor3": _cor3,
    "rel1": lambda s, d: relationships.value_overlap(load(s, d, "lineitem"), KEYS),
    "rel2": lambda s, d: relationships.relationship_candidates(_related(s, d)).fillna(0, ["overlap_count"]),
    "rel3": lambda s, d: relationships.classify_relationships(relationships.relationship_candidates(_related(s, d)), k=10),
    "rel4": lambda s, d: relationships.classify_correlated(relationships.correlation_candidates(_related(s, d)), k=5),
    "rel5": _rel5,
    "trd1": _trd1,
    "trd1_share": _trd1_share,
    "trd2": lambda s, d: _text_time(trends.date_range(load(s, d, "orders"), "o_orderdate"), "start", "end"),
    "trd3": _trd3,
    "trd4": _trd4,
    "trd4_seasons": lambda s, d: trends.seasonality(load(s, d, "orders"), "o_orderdate", "o_totalprice").withColumn("average", F.round("average", 4)),
    "trd4_spikes": _trd4_spikes,
    "dom1": lambda s, d: domains.infer_domains(_activity(s, d)),
    "jn6": _jn6,
}

SQL = {
    "cor1": _matrix_sql(LINES, "lineitem", _r),
    "cor1_gaps": with_holed(_matrix_sql(_GAPS, "hl", _r)),
    "cor1_wide": _wide_pairs(200, False),
    "cor2_wide": _wide_pairs(20, True),
    "cor2": _matrix_sql(LINES, "lineitem", _rho),
    "cor2_gaps": with_holed(_matrix_sql(_GAPS, "hl", _rho)),
    "cor3": with_holed(_cor3_sql(_GAPS, "hl")),
    "rel1": overlap_sql(KEYS, "lineitem", KEYS[:5]),
    "rel2": f"{_CANDIDATES} SELECT * REPLACE (coalesce(overlap_count, 0) AS overlap_count) FROM cand",
    "rel3": f"{_CANDIDATES} {_CLASSIFIED}",
    "rel4": f"""{_CANDIDATES} SELECT source_column, target_column,
        CASE WHEN abs(pearson_r) > 0.7 THEN 'one-to-one' ELSE 'one-to-many' END AS relationship_type, round(strength, 2) AS confidence,
        CASE WHEN abs(pearson_r) > 0.5 THEN 'scatter' ELSE 'bar' END AS chart_hint
        FROM (SELECT * FROM c ORDER BY strength DESC, source_column, target_column LIMIT 5)""",
    "rel5": _REL5_SQL,
    "trd1": _TRD1_SQL,
    "trd1_share": _TRD1_SHARE_SQL,
    "trd2": """SELECT strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS "end",
        CAST(floor(epoch(max(o_orderdate) - min(o_orderdate)) / 86400) AS INT) AS span_days FROM orders""",
    "trd3": _TRD3_SQL,
    "trd4": """SELECT event_type, strftime(date_trunc('week', ts), '%Y-%m-%d %H:%M:%S') AS period, count(*) AS rows,
        round(sum(value), 2) AS sum_value, round(avg(value), 4) AS avg_value FROM events GROUP BY 1, 2""",
    "trd4_seasons": stacked(
        f"SELECT '{name}' AS season, CAST({part} AS INT) AS slot, count(o_totalprice) AS rows, round(avg(o_totalprice), 4) AS average FROM orders GROUP BY 2"
        for name, part in (("month", "month(o_orderdate)"), ("quarter", "quarter(o_orderdate)"), ("day_of_week", "dayofweek(o_orderdate) + 1"))
    ),
    "trd4_spikes": """WITH t AS (SELECT date_trunc('day', ts) AS day, sum(value) AS total FROM events GROUP BY 1)
        SELECT strftime(day, '%Y-%m-%d %H:%M:%S') AS period, round(total, 2) AS total, round((total - m) / s, 4) AS z_score
        FROM t, (SELECT avg(total) AS m, stddev_pop(total) AS s FROM t) WHERE abs((total - m) / s) > 1.5""",
    "dom1": _dom1_sql(),
    "jn6": _jn6_sql(),
}
