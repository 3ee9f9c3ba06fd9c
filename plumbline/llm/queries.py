"""The operators of this subpackage as registered queries over whole tables, and SQL with the same result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import bisectors, fixity, infill, jaccard, language, lists, mixing, packing, private, quality, repeats, rules, winnowing


def load(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, n: int):
    """The remainder of the CRC-32 of a number written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


# The second replica has changed records and has lost some; the first has lost others.
_CHANGED, _LOST_RIGHT, _LOST_LEFT = "page_id % 101 = 7", "page_id % 211 = 13", "page_id % 307 = 5"


def _op1(spark, sf_dir):
    whole = fixity.records(load(spark, sf_dir, "pages"))
    left = whole.filter(f"NOT coalesce({_LOST_LEFT}, false)")
    right = whole.filter(f"NOT coalesce({_LOST_RIGHT}, false)").withColumn("record", F.expr(f"CASE WHEN {_CHANGED} THEN concat(substr(record, 2), substr(record, 1, 1)) ELSE record END"))
    return fixity.audit(left, right).fillna(0, ["left_length", "right_length"])


_OP1_SQL = f"""
WITH pieces AS (
    SELECT page_id, CAST(CAST(floor(page_id / 500) AS BIGINT) AS VARCHAR) AS file,
           'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || url
           || chr(13) || chr(10) || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html || chr(13) || chr(10) || chr(13) || chr(10) AS record
    FROM pages
), records AS (SELECT page_id, file, record, CAST(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id, sha256(record) ROWS UNBOUNDED PRECEDING) - strlen(record) AS BIGINT) AS "offset" FROM pieces
), l AS (SELECT file, "offset", strlen(record) AS left_length, sha256(record) AS left_sha256 FROM records WHERE NOT ({_LOST_LEFT})
), r AS (
    SELECT file, "offset", strlen(record) AS right_length, sha256(CASE WHEN {_CHANGED} THEN substr(record, 2) || substr(record, 1, 1) ELSE record END) AS right_sha256
    FROM records WHERE NOT ({_LOST_RIGHT})
)
SELECT file, "offset", CASE WHEN right_sha256 IS NULL THEN 'missing' WHEN left_sha256 IS NULL THEN 'extra' ELSE 'changed' END AS status, coalesce(left_length, 0) AS left_length, coalesce(right_length, 0) AS right_length, left_sha256, right_sha256
FROM l FULL JOIN r USING (file, "offset") WHERE left_sha256 IS DISTINCT FROM right_sha256
"""


def _op2(spark, sf_dir):
    found = rules.judged(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _texts(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


_OP2_SQL = f"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents
), windows AS (
    SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), repeated AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n >= 2
), words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS p FROM repeated) GROUP BY r
), m AS (
    SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
           len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines,
           len(list_filter(w, lambda x: lower(x) IN ({_texts(sorted({w for words in rules.STOP_WORDS.values() for w in words}))}))) AS n_stop,
           len(list_filter(w, lambda x: x = upper(x) AND x <> lower(x))) AS n_capital
    FROM d LEFT JOIN words USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND word_chars / n_words BETWEEN 2.0 AND 15.0 AND n_symbols / n_words <= 0.25
       AND n_stop / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.5 AND n_capital / n_words <= 0.7 AS kept
FROM m
"""


def _op3(spark, sf_dir):
    return repeats.digests(load(spark, sf_dir, "documents"))


def _op4(spark, sf_dir):
    return private.digests(private.detect(load(spark, sf_dir, "documents")))


# Fetch days and list entries are made from the pages: each host, and some domains above it, is listed, taken off and allowed on days that its first page's number gives.
_ENTRIES = """
    SELECT host AS domain, {first} AS listed_on, 'block' AS action FROM hosts WHERE k % 3 = 0
    UNION ALL SELECT host, {removed}, 'remove' FROM hosts WHERE k % 6 = 0
    UNION ALL SELECT host, {allowed}, 'allow' FROM hosts WHERE k % 9 = 0
    UNION ALL SELECT regexp_replace(host, '^[^.]+[.]', ''), {above}, 'block' FROM hosts WHERE k % 5 = 1
"""


def _op5(spark, sf_dir):
    pages = load(spark, sf_dir, "pages")
    captures = pages.select("page_id", "url", F.expr("date_add(DATE '2024-01-01', CAST(page_id * 37 % 366 AS INT))").alias("fetched_on"))
    hosts = pages.select(lists.host_of(F.col("url")).alias("host"), "page_id").groupBy("host").agg(F.min("page_id").alias("k"))
    day = "date_add(DATE '2024-01-01', CAST({} AS INT))".format
    entries = spark.sql(_ENTRIES.format(first=day("k % 200"), removed=day("k % 200 + 40 + k % 30"), allowed=day("k % 200 + 120"), above=day("k % 300")).replace("hosts", "{hosts}"), hosts=hosts)
    return lists.judged(captures, entries).withColumn("fetched_on", F.date_format("fetched_on", "yyyy-MM-dd"))


_DAY = "DATE '2024-01-01' + CAST({} AS INTEGER)".format
_OP5_SQL = f"""
WITH captures AS (
    SELECT page_id, {_DAY("page_id * 37 % 366")} AS fetched_on, nullif(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), '') AS host FROM pages
), hosts AS (SELECT host, min(page_id) AS k FROM captures GROUP BY host
), entries AS ({_ENTRIES.format(first=_DAY("k % 200"), removed=_DAY("k % 200 + 40 + k % 30"), allowed=_DAY("k % 200 + 120"), above=_DAY("k % 300"))}
), daily AS (SELECT domain, listed_on, max(CASE action WHEN 'remove' THEN 1 WHEN 'block' THEN 2 ELSE 3 END) AS rank FROM entries GROUP BY ALL
), spans AS (SELECT domain, rank, listed_on, lead(listed_on) OVER (PARTITION BY domain ORDER BY listed_on) AS ended_on FROM daily
), parts AS (
    SELECT page_id, fetched_on, host, array_to_string(string_split(host, '.')[i:], '.') AS domain
    FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')), 2))) AS i FROM captures WHERE host IS NOT NULL)
), active AS (
    SELECT page_id, count(*) AS n_active, arg_max(struct_pack(domain := parts.domain, rank := rank), length(parts.domain)) AS best
    FROM parts JOIN spans ON parts.domain = spans.domain AND rank > 1 AND listed_on <= fetched_on AND (ended_on IS NULL OR fetched_on < ended_on) GROUP BY page_id
)
SELECT page_id, host, strftime(fetched_on, '%Y-%m-%d') AS fetched_on, coalesce(n_active, 0) AS n_active, best.domain AS decided_by,
       CASE best.rank WHEN 2 THEN 'block' WHEN 3 THEN 'allow' END AS action, coalesce(best.rank = 2, false) AS blocked
FROM captures LEFT JOIN active USING (page_id)
"""


def _op6(spark, sf_dir):
    found = winnowing.find(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return winnowing.summaries(found)


_OP6_SQL = """
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), []) AS w FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), windows AS (
    SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)
), spots AS (
    SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
    FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (SELECT r, i, spots.n, item_id FROM spots JOIN windows USING (n, g)
), words AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hits)) GROUP BY r
), items AS (
    SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def _op7(spark, sf_dir):
    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def _op8(spark, sf_dir):
    return jaccard.join(load(spark, sf_dir, "documents"), words=4, percent=85)


def _op9(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    model = language.fit(docs.filter(remainder("doc_id", 4) != 2))
    found = language.predict(docs, model)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def _op10(spark, sf_dir):
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.filter(remainder("doc_id", 5) != 0))
    found = quality.score(docs, model)
    return found.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def _op11(spark, sf_dir):
    return infill.transform(load(spark, sf_dir, "documents"), digests=True)


_OP11_SQL = """
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), numbers AS (
    SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d
), cut AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM numbers
), parts AS (
    SELECT *, array_to_string(list_slice(u, 1, a), '') AS p, array_to_string(list_slice(u, a + 1, b), '') AS m, array_to_string(list_slice(u, b + 1, n), '') AS s FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""


def _op12(spark, sf_dir):
    return bisectors.cluster(load(spark, sf_dir, "embeddings"))


def _op12_rounds() -> str:
    """Five rounds of assignment and moving, each a pair of statements, and one more assignment."""
    near = """a{r} AS MATERIALIZED (
        SELECT i, x, k AS cluster, d AS distance FROM (
            SELECT v.i, v.x, c.k, list_sum(list_transform(range(1, 65), lambda p: (v.x[p] - c.x[p]) * (v.x[p] - c.x[p]))) AS d,
                   row_number() OVER (PARTITION BY v.i ORDER BY d, c.k) AS place
            FROM v, c{r} AS c
        ) WHERE place = 1
    )"""
    move = """c{n} AS MATERIALIZED (
        WITH sums AS (SELECT cluster, p, sum(x[p]) AS s, count(*) AS n FROM a{r}, range(1, 65) AS t(p) GROUP BY cluster, p),
        means AS (SELECT cluster, list(CAST((s - ((s % n) + n) % n) / n AS BIGINT) ORDER BY p) AS x FROM sums GROUP BY cluster)
        SELECT c.k, coalesce(means.x, c.x) AS x FROM c{r} AS c LEFT JOIN means ON c.k = means.cluster
    )"""
    steps = []
    for r in range(5):
        steps += [near.format(r=r), move.format(r=r, n=r + 1)]
    return ", ".join([*steps, near.format(r=5)])


_OP12_SQL = f"""
WITH v AS MATERIALIZED (
    SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64
), c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY h, x) - 1 AS k, x FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, x FROM v ORDER BY h, x LIMIT 40)
), {_op12_rounds()}
SELECT v.vec_id, CAST(a5.cluster AS INTEGER) AS cluster, CAST(a5.distance AS BIGINT) AS distance,
       CAST(sum(a5.distance) OVER (PARTITION BY a5.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(a5.distance) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(c5.x, ',')) AS centroid_sha256
FROM a5 JOIN v USING (i) JOIN c5 ON c5.k = a5.cluster
"""


def _op13(spark, sf_dir):
    return mixing.mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


# The same tilts by halving, and the same copies by running sums; sizes with more documents than a part holds are not divided here.
_OP13_SQL = f"""
WITH RECURSIVE d AS MATERIALIZED (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size, sha256('13:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), s AS MATERIALIZED (
    SELECT source, CAST(sum(size) AS BIGINT) AS source_size, avg(size) FILTER (size > 0) AS mean_size, [3, 1, 2][row_number() OVER (ORDER BY source IS NULL, source) % 3 + CASE WHEN row_number() OVER (ORDER BY source IS NULL, source) % 3 = 0 THEN 3 ELSE 0 END] AS w
    FROM d GROUP BY source
), filled(i, level) AS (
    SELECT 0, 1.5 * sum(source_size) / sum(w) FROM s
    UNION ALL
    SELECT any_value(i) + 1, (1.5 * sum(source_size) - coalesce(sum(2.0 * source_size) FILTER (2.0 * source_size <= w * level), 0)) / sum(w) FILTER (2.0 * source_size > w * level)
    FROM filled, s WHERE i < 60 GROUP BY level HAVING count(*) FILTER (2.0 * source_size > w * level) > 0
), t AS MATERIALIZED (
    SELECT source, source_size, mean_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(2.0 * source_size, w * (SELECT level FROM filled ORDER BY i DESC LIMIT 1)) END AS target FROM s
), sizes AS MATERIALIZED (SELECT source, size, count(*) AS n FROM d GROUP BY ALL
), halved(i, source, low, high) AS (
    SELECT 0, source, -1000.0::DOUBLE, 1000.0::DOUBLE FROM t WHERE target > 0 AND target < 2.0 * source_size
    UNION ALL
    SELECT any_value(i) + 1, b.source, CASE WHEN got < any_value(target) THEN any_value(low + high) / 2 ELSE any_value(low) END, CASE WHEN got < any_value(target) THEN any_value(high) ELSE any_value(low + high) / 2 END
    FROM (
        SELECT any_value(i) AS i, t.source, any_value(low) AS low, any_value(high) AS high, any_value(target) AS target,
               sum(size * n * least(2.0, exp(least((low + high) / 2 * (size / mean_size), 700.0)))) AS got
        FROM halved JOIN t ON t.source IS NOT DISTINCT FROM halved.source JOIN sizes ON sizes.source IS NOT DISTINCT FROM t.source AND size > 0
        WHERE i < 100 GROUP BY t.source
    ) AS b GROUP BY b.source, got
), rates AS (
    SELECT sizes.source, size, n, source_size, target,
           CAST(round(CASE WHEN low IS NULL THEN CASE WHEN target > 0 THEN 2.0 ELSE 0.0 END ELSE least(2.0, exp(least((low + high) / 2 * (size / mean_size), 700.0))) END * {mixing.UNITS}) AS HUGEINT) AS units
    FROM sizes JOIN t ON t.source IS NOT DISTINCT FROM sizes.source LEFT JOIN (SELECT * FROM halved WHERE i = 100) AS x ON x.source IS NOT DISTINCT FROM t.source
), sums AS (SELECT *, CAST(sum(n * units) OVER (PARTITION BY source ORDER BY size) AS HUGEINT) AS up_to FROM rates
), odd AS (
    SELECT *, units // {mixing.UNITS} AS base, (up_to + {mixing.UNITS // 2}) // {mixing.UNITS} - (up_to - n * units + {mixing.UNITS // 2}) // {mixing.UNITS} - n * (units // {mixing.UNITS}) AS odd FROM sums
)
SELECT doc_id, d.size, source_size, target, CAST(d.size * (base + CASE WHEN row_number() OVER (PARTITION BY d.source, d.size ORDER BY h, doc_id) <= odd THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN odd ON odd.source IS NOT DISTINCT FROM d.source AND odd.size = d.size
"""


QUERIES = {
    "op1_fixity": _op1,
    "op2_rules": _op2,
    "op3_repeats": _op3,
    "op4_pii": _op4,
    "op5_lists": _op5,
    "op6_decontaminate": _op6,
    "op7_pack": _op7,
    "op8_jaccard": _op8,
    "op9_language": _op9,
    "op10_quality": _op10,
    "op11_infill": _op11,
    "op12_bisectors": _op12,
    "op13_mix": _op13,
}
SQL: dict[str, str] = {
    "op1_fixity": _OP1_SQL,
    "op2_rules": _OP2_SQL,
    "op5_lists": _OP5_SQL,
    "op6_decontaminate": _OP6_SQL,
    "op11_infill": _OP11_SQL,
    "op12_bisectors": _OP12_SQL,
    "op13_mix": _OP13_SQL,
}
