"""Joins of two tables on one column each, stored join definitions, and join discovery."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.kinds import kind_of, plain_text, ref
from plumbline.operators.domains import column_catalog
from plumbline.operators.relationships import overlap_counts
from plumbline.session import stored

JOIN_TYPES = ("inner", "left", "right", "outer")
# Rows of either side of a key that meet in one cell; a key with more pairs than a cell holds is joined cell by cell.
CELL_ROWS = 2_000
# Partitions over which cells are dealt at most.
CELL_PARTITIONS = 2_000


def _keys(source: DataFrame, target: DataFrame, source_column: str, target_column: str) -> tuple[Column, Column, bool]:
    """Key expressions of both sides and whether they have one type.

    Keys compare as text: null equals null and empty text, and the number 1 equals the text ``1``.
    Between two integer columns, or two columns of one type that is not text, a null-safe
    comparison of the values says the same and needs no text.
    """
    left, right = source.schema[source_column].dataType, target.schema[target_column].dataType
    if kind_of(left) == kind_of(right) == "integer":
        return ref(source_column).cast("bigint"), ref(target_column).cast("bigint"), True
    if left == right and kind_of(left) != "string":
        return ref(source_column), ref(target_column), True
    text = lambda c, t: F.coalesce(plain_text(ref(c), t), F.lit(""))
    return text(source_column, left), text(target_column, right), left == right


def join(source: DataFrame, target: DataFrame, source_column: str, target_column: str, how: str = "inner") -> DataFrame:
    """Join on one column each; other columns are prefixed ``source_`` and ``target_``.

    The key column keeps the source value and takes the target value in rows without a source.
    Adaptive execution picks broadcast or sort-merge from measured sizes. Every kind is an inner join,
    whose hot keys are split on both sides, see :func:`_pairs`, and anti joins with the other side's
    distinct keys for the rows without a partner. Null and empty keys match each other by rule, so their rows of both
    sides do meet in all pairs; :func:`factorised` keeps them apart.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}")
    source_key, target_key, one_type = _keys(source, target, source_column, target_column)
    types = source.schema[source_column].dataType, target.schema[target_column].dataType
    as_shown = lambda c, t: F.col(c) if one_type else plain_text(F.col(c), t)
    left = source.select(
        source_key.alias("__sk"), ref(source_column).alias("__sv"),
        *[ref(c).alias(f"source_{c}") for c in source.columns if c != source_column],
    )
    right = target.select(
        target_key.alias("__tk"), ref(target_column).alias("__tv"),
        *[ref(c).alias(f"target_{c}") for c in target.columns if c != target_column],
    )
    same = F.col("__sk").eqNullSafe(F.col("__tk"))
    source_value, target_value = as_shown("__sv", types[0]), as_shown("__tv", types[1])
    lefts = [c for c in left.columns if not c.startswith("__")]
    rights = [c for c in right.columns if not c.startswith("__")]
    shown = lambda key, rows: rows.select(key.alias(source_column), *[ref(c) for c in lefts + rights])
    own_key = F.col("__sv") if how in ("inner", "left") else source_value
    pairs, left, right = _pairs(left, right)
    parts = [shown(own_key, rows) for rows in pairs]
    if how in ("left", "outer"):
        alone = left.join(right.select("__tk").distinct(), same, "left_anti")
        parts.append(shown(own_key, alone.withColumns({c: F.lit(None).cast(right.schema[c].dataType) for c in rights})))
    if how in ("right", "outer"):
        alone = right.join(left.select("__sk").distinct(), same, "left_anti")
        parts.append(shown(target_value, alone.withColumns({c: F.lit(None).cast(left.schema[c].dataType) for c in lefts})))
    return reduce(DataFrame.unionByName, parts)


def _pairs(left: DataFrame, right: DataFrame) -> tuple[list[DataFrame], DataFrame, DataFrame]:
    """The rows of both sides that have one key, in parts, and both sides without the rows of hot keys, which all have partners.

    What a key costs is its number of pairs, which no size in bytes tells, so keys are counted first. One with more pairs
    than a cell holds is dealt over a grid: each of its rows belongs to one block of its side, whole rows of blocks meet
    whole columns, and every pair is formed in the cell of its two blocks. Blocks are dealt by the place of a row in its
    partition, so that equal rows are divided too. A block of the left side is one list, so that a cell looks up one row
    for each of its right rows and runs through the list, in place of a look-up for each pair.
    """
    same = F.col("__sk").eqNullSafe(F.col("__tk"))
    counted = lambda df, key, n: df.groupBy(key).agg(F.count(F.lit(1)).alias(n))
    both = counted(left, "__sk", "__n").join(counted(right, "__tk", "__m"), same).filter(F.col("__n") * F.col("__m") > CELL_ROWS**2)
    blocks = lambda n: F.ceil(F.col(n) / CELL_ROWS)
    hot = stored(both.select(F.col("__sk").alias("__hot"), blocks("__n").alias("__rows"), blocks("__m").alias("__columns"), F.monotonically_increasing_id().alias("__id")), "hot-keys")
    cells = hot.agg(F.sum(F.col("__rows") * F.col("__columns"))).first()[0]
    if not cells:
        return [left.join(right, same, "inner")], left, right
    cell = ["__id", "__row", "__column"]

    def blocked(df: DataFrame, key: str, own: str, number: str) -> DataFrame:
        return df.join(hot, F.col(key).eqNullSafe(F.col("__hot"))).withColumn(own, F.pmod(F.monotonically_increasing_id(), F.col(number)))

    def dealt(df: DataFrame, other: str, number: str, values: list[str]) -> DataFrame:
        copies = df.withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(number) - 1)))
        return copies.select(*cell, *[ref(c) for c in values]).repartition(min(cells, CELL_PARTITIONS), *cell)

    shown = lambda df, key: [c for c in df.columns if c != key]
    of_block = F.collect_list(F.struct(*[ref(c) for c in shown(left, "__sk")])).alias("__block")
    lists = blocked(left, "__sk", "__row", "__rows").groupBy("__id", "__row", "__columns").agg(of_block)
    rows = dealt(blocked(right, "__tk", "__column", "__columns"), "__row", "__rows", shown(right, "__tk"))
    # Merged, so that the right rows are walked one after the other: a walk over lists would form all pairs of a cell at a time.
    met = rows.join(dealt(lists, "__column", "__columns", ["__block"]).hint("merge"), cell)
    split = met.select(*[ref(c) for c in shown(right, "__tk")], F.inline("__block"))
    others = lambda df, key: df.join(hot, F.col(key).eqNullSafe(F.col("__hot")), "left_anti")
    left, right = others(left, "__sk"), others(right, "__tk")
    return [left.join(right, same, "inner"), split], left, right


@dataclass(frozen=True)
class FactorisedJoin:
    """A join whose rows without a key are kept as one list for each side in place of all their pairs.

    ``joined`` has the rows with keys, ``source_blank`` and ``target_blank`` the rows of both tables whose key is null or
    empty. By rule each of the one list meets each of the other.
    """

    joined: DataFrame
    source_blank: DataFrame
    target_blank: DataFrame
    source_column: str
    target_column: str
    how: str

    def rows(self) -> int:
        """The number of rows of the whole join, without forming the pairs."""
        n, m = self.source_blank.count(), self.target_blank.count()
        alone = (n if self.how in ("left", "outer") and not m else 0) + (m if self.how in ("right", "outer") and not n else 0)
        return self.joined.count() + n * m + alone

    def expanded(self) -> DataFrame:
        """All rows of the join, the pairs of rows without a key included."""
        return self.joined.unionByName(join(self.source_blank, self.target_blank, self.source_column, self.target_column, self.how))


def factorised(source: DataFrame, target: DataFrame, source_column: str, target_column: str, how: str = "inner") -> FactorisedJoin:
    """:func:`join` with the rows of null and empty keys kept apart, so that nothing grows with the product of their numbers."""
    source_key, target_key, _ = _keys(source, target, source_column, target_column)
    blank = lambda key: F.coalesce(key.cast("string"), F.lit("")) == ""
    joined = join(source.filter(~blank(source_key)), target.filter(~blank(target_key)), source_column, target_column, how)
    return FactorisedJoin(joined, source.filter(blank(source_key)), target.filter(blank(target_key)), source_column, target_column, how)


def join_counts(source: DataFrame, target: DataFrame, source_column: str, target_column: str, how: str = "inner") -> DataFrame:
    """Per key, as text, the rows of both sides and of the join: ``key, source_rows, target_rows, joined_rows``.

    Rows are counted before the sides meet, so a key takes one row of each side however often it occurs. Null and empty
    keys are one key, the empty text.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}")
    types = source.schema[source_column].dataType, target.schema[target_column].dataType
    counted = lambda df, c, t, name: df.groupBy(F.coalesce(plain_text(ref(c), t), F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias(name))
    both = counted(source, source_column, types[0], "source_rows").join(counted(target, target_column, types[1], "target_rows"), "key", "full").fillna(0, ["source_rows", "target_rows"])
    n, m = F.col("source_rows"), F.col("target_rows")
    alone = F.lit(0)
    if how in ("left", "outer"):
        alone = alone + F.when(m == 0, n).otherwise(0)
    if how in ("right", "outer"):
        alone = alone + F.when(n == 0, m).otherwise(0)
    return both.select("key", n, m, (n * m + alone).alias("joined_rows")).filter("joined_rows > 0")


@dataclass(frozen=True)
class Relation:
    relation_id: str
    source_table: str
    source_column: str
    target_table: str
    target_column: str
    join_type: str = "inner"


RELATION_SCHEMA = (
    "relation_id string, source_table string, source_column string, target_table string, target_column string, join_type string"
)


def relations_frame(spark: SparkSession, relations: Sequence[Relation]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(r).values()) for r in relations], RELATION_SCHEMA)


class RelationStore:
    """Join definitions and their stored results below one shared folder.

    Definitions are few and kept as one small Parquet folder per relation, so that defining,
    replacing and dropping one never rewrites another.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _definition(self, relation_id: str) -> str:
        return f"{self.root}/definitions/relation={relation_id}"

    def _result(self, relation_id: str) -> str:
        return f"{self.root}/results/{relation_id}"

    def define(self, relation: Relation) -> None:
        if relation.join_type not in JOIN_TYPES:
            raise ValueError(f"unknown join type {relation.join_type!r}")
        relations_frame(self.spark, [relation]).write.mode("overwrite").parquet(self._definition(relation.relation_id))

    def list(self) -> DataFrame:
        pattern = f"{self.root}/definitions/relation=*"
        hadoop, fs = self._path(pattern)
        if not fs.globStatus(hadoop):
            return relations_frame(self.spark, [])
        return self.spark.read.schema(RELATION_SCHEMA).parquet(pattern)

    def get(self, relation_id: str) -> Relation:
        if not self._exists(self._definition(relation_id)):
            raise KeyError(relation_id)
        return Relation(**self.spark.read.schema(RELATION_SCHEMA).parquet(self._definition(relation_id)).first().asDict())

    def drop(self, relation_id: str) -> None:
        """Remove a definition together with its stored result."""
        for path in (self._definition(relation_id), self._result(relation_id)):
            self._delete(path)

    def execute(self, relation_id: str, tables: Mapping[str, DataFrame]) -> DataFrame:
        r = self.get(relation_id)
        return join(tables[r.source_table], tables[r.target_table], r.source_column, r.target_column, r.join_type)

    def materialize(self, relation_id: str, tables: Mapping[str, DataFrame]) -> DataFrame:
        """Store the join result under the relation, replacing an earlier one, and read it back."""
        self.execute(relation_id, tables).write.mode("overwrite").parquet(self._result(relation_id))
        return self.load(relation_id)

    def load(self, relation_id: str) -> DataFrame:
        return self.spark.read.parquet(self._result(relation_id))

    def _path(self, path: str):
        jvm = self.spark._jvm
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        hadoop, fs = self._path(path)
        return fs.exists(hadoop)

    def _delete(self, path: str) -> None:
        hadoop, fs = self._path(path)
        fs.delete(hadoop, True)


def discover_cross_relations(
    tables: Mapping[str, DataFrame], existing: DataFrame | None = None, id_rule: bool = False
) -> DataFrame:
    """Column pairs of different tables with the same name, ignoring case and punctuation.

    With ``id_rule`` a column ``<table>_id`` also suggests the ``id`` of that table. Pairs of plain
    ``id`` columns are skipped, and so are pairs that are defined already in either direction.
    """
    catalog = column_catalog(dict(tables))
    order = {name: i for i, name in enumerate(tables)}
    rank = F.create_map(*[F.lit(x) for name, i in order.items() for x in (name, i)])
    cleaned = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    sides = catalog.select("table_name", "column_name", cleaned("column_name").alias("name"), rank[F.col("table_name")].alias("place"))
    if id_rule:
        alias = sides.filter(F.col("name") == "id").withColumn("name", F.concat(cleaned("table_name"), F.lit("id")))
        sides = sides.unionByName(alias)
    left = sides.select(F.col("table_name").alias("source_table"), F.col("column_name").alias("source_column"), "name", F.col("place").alias("p1"))
    right = sides.select(F.col("table_name").alias("target_table"), F.col("column_name").alias("target_column"), "name", F.col("place").alias("p2"))
    pairs = left.join(right, "name").filter((F.col("p1") < F.col("p2")) & (F.col("name") != "id"))
    names = ["source_table", "source_column", "target_table", "target_column"]
    pairs = pairs.select(*names).distinct()
    if existing is not None:
        forward = existing.select(*names)
        backward = existing.select(
            F.col("target_table").alias("source_table"), F.col("target_column").alias("source_column"),
            F.col("source_table").alias("target_table"), F.col("source_column").alias("target_column"),
        )
        pairs = pairs.join(forward, names, "left_anti").join(backward, names, "left_anti")
    return pairs.withColumn("join_type", F.lit("inner"))


def rank_cross_relations(suggestions: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Suggestions with the shared and own distinct values of both columns."""
    names = ["source_table", "source_column", "target_table", "target_column", "join_type"]
    rows = [tuple(r[n] for n in names) for r in suggestions.collect()]
    members: dict[tuple[str, str], int] = {}
    for source, sc, target, tc, _ in rows:
        members.setdefault((source, sc), len(members))
        members.setdefault((target, tc), len(members))
    spark = next(iter(tables.values())).sparkSession
    if not rows:
        return spark.createDataFrame(
            [], ", ".join(f"{n} string" for n in names)
            + ", overlap_count bigint, unique_values_1 bigint, unique_values_2 bigint, overlap_ratio double",
        )
    pairs = [(members[(r[0], r[1])], members[(r[2], r[3])]) for r in rows]
    counts = overlap_counts([(tables[t], c) for t, c in members], pairs)
    keyed = spark.createDataFrame(
        [(*r, *p) for r, p in zip(rows, pairs)], ", ".join(f"{n} string" for n in names) + ", source int, target int"
    )
    ratio = F.try_divide(F.col("overlap_count"), F.least("unique_values_1", "unique_values_2"))
    return counts.join(F.broadcast(keyed), ["source", "target"]).select(
        *names, "overlap_count", "unique_values_1", "unique_values_2",
        F.round(F.coalesce(ratio, F.lit(0.0)), 4).alias("overlap_ratio"),
    )
