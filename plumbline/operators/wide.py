"""Wide aggregates: every statistic of every column in one pass, one output row per column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.kinds import ref

# More expressions than this in one aggregate make generated methods too long for the JVM to compile
# to machine code, which costs more than reading disjoint columns in several passes.
MAX_EXPRESSIONS = 40
# The same for lists of plain counters and sums.
MAX_COUNTERS = 120
# Partitions of a stored table below which it is dealt over all cores before it is read several times.
FEW_PARTITIONS = 8


def chunks(items: Sequence, size: int):
    for start in range(0, len(items), size):
        yield items[start : start + size]


def stack_rows(df: DataFrame, rows: Sequence[Mapping[str, Column]]) -> DataFrame:
    """Turn each input row into ``len(rows)`` rows, one per mapping of output name to expression."""
    structs = [F.struct(*[e.alias(n) for n, e in row.items()]) for row in rows]
    return df.select(F.explode(F.array(*structs)).alias("row")).select("row.*")


def per_item(
    df: DataFrame,
    items: Sequence,
    labels: Callable[[object], Mapping[str, Column]],
    stats: Mapping[str, Callable[[object], Column]],
) -> DataFrame:
    """One wide aggregate over ``df``, returned in long form with one row per item.

    ``labels`` gives the constant columns of an item (its name, its position), ``stats`` the
    aggregates. Items are split over several aggregates when there are too many expressions.
    """
    if not items:
        raise ValueError("nothing to aggregate")
    parts = []
    for chunk in chunks(list(items), max(1, MAX_EXPRESSIONS // max(1, len(stats)))):
        aggregates = [
            make(item).alias(f"a{i}_{name}")
            for i, item in enumerate(chunk)
            for name, make in stats.items()
        ]
        rows = [
            {**labels(item), **{name: F.col(f"a{i}_{name}") for name in stats}}
            for i, item in enumerate(chunk)
        ]
        parts.append(stack_rows(df.agg(*aggregates), rows))
    return reduce(DataFrame.unionByName, parts)


def per_column(df: DataFrame, columns: Sequence[str], stats: Mapping[str, Callable[[str], Column]]) -> DataFrame:
    """``per_item`` for columns: labels are ``position`` and ``column``."""
    place = {c: i for i, c in enumerate(df.columns)}
    return per_item(
        df,
        columns,
        lambda c: {"position": F.lit(place[c]), "column": F.lit(c)},
        stats,
    )


def is_plain_scan(df: DataFrame) -> bool:
    """Whether the table is read from storage or memory with projections and filters only.

    Then columns can be read apart from each other, each once, at no extra cost.
    """
    node = df._jdf.queryExecution().optimizedPlan()
    while node.children().size() == 1 and node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        node = node.children().head()
    return node.nodeName() in ("LogicalRelation", "InMemoryRelation", "RelationV2", "DataSourceV2ScanRelation", "LocalRelation")


@contextmanager
def spread(df: DataFrame, columns: Sequence[str]) -> Iterator[DataFrame]:
    """The named columns of a table, for operators that read them several times.

    A stored table of at most ``FEW_PARTITIONS`` partitions, which would leave most cores idle in each pass, is dealt over
    all cores and kept in memory meanwhile. Any larger table is read as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if not is_plain_scan(df) or df.rdd.getNumPartitions() > min(FEW_PARTITIONS, cores // 2):
        yield df.select(*[ref(c) for c in columns])
        return
    rows = df.select(*[ref(c) for c in columns]).repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield rows
    finally:
        rows.unpersist()


def at_hand(df: DataFrame) -> DataFrame:
    """A small result computed once, such as one row for each column."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def collect_wide(df: DataFrame, expressions: Mapping[str, Column]) -> dict:
    """Run aggregates in one pass per chunk and return their values by name (one row each)."""
    found: dict = {}
    for chunk in chunks(list(expressions.items()), MAX_COUNTERS):
        names = [f"e{i}" for i in range(len(chunk))]
        row = df.agg(*[e.alias(n) for n, (_, e) in zip(names, chunk)]).first()
        found.update({key: row[n] for n, (key, _) in zip(names, chunk)})
    return found
