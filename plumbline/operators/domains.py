"""Subject area of tables from the names of their columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.fixed import DOMAIN_THRESHOLD, DOMAINS


def _literals(rows: list[tuple], names: tuple[str, ...]):
    return F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows])


def infer_domains(catalog: DataFrame) -> DataFrame:
    """Best subject area per table of a catalog ``table_name, position, column_name``.

    A keyword scores one point when some column contains it and two more per column that does; the
    score is divided by the number of keywords of the area. Areas below the threshold give no row.
    """
    order = {d: i for i, d in enumerate(DOMAINS)}
    keywords = _literals(
        [(order[d], k) for d, (words, _) in DOMAINS.items() for k in words], ("domain", "keyword")
    )
    areas = _literals(
        [(order[d], s, s.replace("_", " ")) for d, (_, subs) in DOMAINS.items() for s in subs],
        ("domain", "subdomain", "phrase"),
    )
    names = catalog.select("table_name", "position", F.lower("column_name").alias("name"))
    scores = (
        names.select("table_name", F.explode(F.filter(keywords, lambda k: F.col("name").contains(k["keyword"]))).alias("hit"))
        .groupBy("table_name", "hit.domain", "hit.keyword")
        .agg((F.count(F.lit(1)) * 2 + 1).alias("points"))
        .groupBy("table_name", "domain")
        .agg(F.sum("points").alias("points"))
    )
    sizes = F.element_at(F.array(*[F.lit(len(words)) for words, _ in DOMAINS.values()]), F.col("domain") + 1)
    scored = scores.withColumn("score", F.col("points") / sizes)
    best = scored.groupBy("table_name").agg(F.min(F.struct((-F.col("score")).alias("s"), "domain")).alias("b"))
    best = best.select("table_name", F.col("b.domain").alias("domain"), (-F.col("b.s")).alias("score"))
    best = best.filter(F.col("score") >= DOMAIN_THRESHOLD)
    # A two-word sub-area may be spread over two neighbouring columns.
    after = names.select("table_name", (F.col("position") - 1).alias("position"), F.col("name").alias("next"))
    text = F.concat_ws(" ", "name", "next")
    subs = (
        names.join(after, ["table_name", "position"], "left")
        .select("table_name", F.explode(F.filter(areas, lambda a: text.contains(a["phrase"]))).alias("a"))
        .groupBy("table_name", "a.domain")
        .agg(F.min_by("a.subdomain", F.array_position(areas, F.col("a"))).alias("subdomain"))
    )
    label = F.element_at(F.array(*[F.lit(d) for d in DOMAINS]), F.col("domain") + 1)
    return best.join(subs, ["table_name", "domain"], "left").select(
        "table_name",
        label.alias("domain"),
        "subdomain",
        F.round("score", 4).alias("confidence"),
        F.concat(label, F.coalesce(F.concat(F.lit("/"), "subdomain"), F.lit(""))).alias("label"),
    )


def column_catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, position, column_name, data_type`` of named tables, read from their schemas."""
    rows = [
        (name, i, f.name, f.dataType.simpleString())
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    spark = next(iter(tables.values())).sparkSession
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, data_type string")
