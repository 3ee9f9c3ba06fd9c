"""Mixing sources to target weights by entropy balancing, in Spark's own functions only.

Every document starts with the rate 1. Of all rates that give each source its target in words, and none of which is above
a limit, those with the least relative entropy to the start are ``min(limit, exp(tilt * size))``: one tilt for each source,
the dual variable of its constraint. The dual is convex, and separate for each source. Newton's method solves it for all
sources at once; a round is one aggregate over the counts of documents by source and size.

Rates become whole copies by running sums. Documents of one source are ordered by size, and each size gets as many copies
as the running sum of rates passes whole numbers there. So the copies of a source miss its target by no more than the
words of its longest document. Which documents of one size get the odd copies, the hash of their id decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import narrowed, stored
from plumbline.operators.ordering import row_index
from plumbline.session import drop_path, fresh_path

#: Rates are whole multiples of one part in this many, so that sums of them are exact.
UNITS = 10**9
#: Documents of one source and size that are ranked together.
RANKED = 5_000
#: Rounds after which a tilt is taken as it is; halving a bracket as often leaves no double inside.
ROUNDS = 200
#: Rows of one id and size that are written out at a time.
WRITTEN = 1_000_000


def n_words(text: Column) -> Column:
    """The number of runs of characters other than white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, source, size`` and ``m``, the number of such rows; the words of every text are counted once."""
    rows = narrowed(docs, doc_id=id_col, text=text_col, source=source_col)
    rows = rows.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("m"))


def _met(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows of both sides whose named columns are equal, nulls too; the columns are those of the left side."""
    own = {n: f"of_{n}" for n in names}
    condition = F.lit(True)
    for n, other in own.items():
        condition = condition & F.col(n).eqNullSafe(F.col(other))
    return left.join(right.withColumnsRenamed(own), condition, how).drop(*own.values())


def weighted(sources: DataFrame, weights: Sequence[float] | DataFrame) -> DataFrame:
    """``source, source_size, weight``: weights in turn over the sources by name, null last, or those of a table.

    A table has ``source`` and ``weight``; sources that it lacks weigh nothing.
    """
    if isinstance(weights, DataFrame):
        table = weights.select(F.col("source").cast("string").alias("source"), F.col("weight").cast("double").alias("weight"))
        return _met(sources, table, ["source"], "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    placed = row_index(sources.withColumn("no_name", F.col("source").isNull()), ["no_name", "source"], "place")
    turns = F.array(*[F.lit(float(w)) for w in weights])
    return placed.select("source", "source_size", F.get(turns, (F.col("place") % len(weights)).cast("int")).alias("weight"))


def targets(sources: DataFrame, share: float, most: int) -> DataFrame:
    """``source, source_size, target``: ``share`` of all words by weight, no source above ``most`` times its own.

    What a source can't take is shared again by weight among the others, until none is above. Four sums come to the
    driver in each round.
    """
    cap, weight = F.col("source_size") * F.lit(float(most)), F.col("weight")
    level, before = None, None
    while True:
        full = F.lit(False) if level is None else cap <= weight * F.lit(level)
        row = sources.agg(
            F.sum("source_size").alias("words"), F.count_if(full).alias("full"), F.sum(F.when(full, cap)).alias("taken"), F.sum(F.when(~full, weight)).alias("weight")
        ).first()
        if row["full"] == before:
            break
        before = row["full"]
        if not row["weight"]:
            level = float("inf")
            break
        level = ((row["words"] or 0) * share - (row["taken"] or 0.0)) / row["weight"]
    return sources.select("source", "source_size", F.when(weight > 0, F.least(cap, weight * F.lit(level))).otherwise(F.lit(0.0)).alias("target"))


def _rate(most: int) -> Column:
    z = F.col("size") / F.col("mean_size")
    return F.least(F.exp(F.least(F.col("tilt") * z, F.lit(700.0))), F.lit(float(most)))


def tilts(sizes: DataFrame, wanted: DataFrame, most: int, tolerance: float = 1e-12) -> DataFrame:
    """``source, source_size, target, mean_size, tilt`` from the counts ``source, size, n`` and the targets.

    Sizes are taken in means of the source. A source whose target is nothing, or the limit of all its documents, has no
    tilt. Sums are decimals, so they don't depend on the order of adding and reruns agree. The signs seen so far bracket a
    tilt; a Newton step that leaves the bracket is replaced by its middle, and one without a bracket does at most double
    the tilt. Every round is stored, the one before it is removed.
    """
    spark = sizes.sparkSession
    sizes = sizes.filter("size > 0")
    means = sizes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).cast("double").alias("mean_size"))
    open_ = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * F.lit(float(most)))
    none = F.lit(None).cast("double")
    state = _met(wanted, means, ["source"], "left").select(
        "source", "source_size", "target", "mean_size", F.when(open_, F.log(F.col("target") / F.col("source_size"))).alias("tilt"), none.alias("low"), none.alias("high"), (~open_).alias("done")
    )
    path = None
    exact = lambda c: F.sum(c.cast("decimal(38,9)")).cast("double")
    for _ in range(ROUNDS):
        last, path = path, fresh_path(spark, "tilts")
        state.write.parquet(path)
        state = spark.read.schema(state.schema).parquet(path)
        if last:
            drop_path(spark, last)
        todo = state.filter("NOT done")
        if todo.isEmpty():
            break
        words, z = F.col("size") * F.col("n"), F.col("size") / F.col("mean_size")
        met = _met(sizes, todo, ["source"]).groupBy("source").agg(
            exact(words * _rate(most)).alias("got"), exact(F.when(_rate(most) < most, words * z * _rate(most)).otherwise(0.0)).alias("slope")
        )
        tilt, off = F.col("tilt"), F.col("got") - F.col("target")
        now = _met(state, met, ["source"], "left").withColumns({
            "low": F.when(off < 0, tilt).otherwise(F.col("low")), "high": F.when(off > 0, tilt).otherwise(F.col("high")),
            "newton": tilt - F.when(F.col("slope") > 0, off / F.col("slope")),
            "wide": F.when(off < 0, F.greatest(tilt * 2, tilt + 1)).otherwise(F.least(tilt * 2, tilt - 1)),
            "met": F.abs(off) <= F.greatest(F.col("target") * tolerance, F.lit(1e-7)),
        })
        free = F.when(off < 0, F.least("newton", "wide")).otherwise(F.greatest("newton", "wide"))
        between = F.when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        step = F.when(F.col("low").isNull() | F.col("high").isNull(), free).otherwise(between)
        tight = F.coalesce(F.col("high") - F.col("low") <= F.abs(tilt) * 1e-15, F.lit(False))
        state = now.select(
            "source", "source_size", "target", "mean_size", F.when(F.col("done") | F.col("met"), tilt).otherwise(step).alias("tilt"), "low", "high",
            (F.col("done") | F.coalesce("met", F.lit(False)) | tight).alias("done"),
        )
    return state.drop("low", "high", "done")


def copies(rows: DataFrame, sizes: DataFrame, tilted: DataFrame, most: int) -> DataFrame:
    """``doc_id, source, size, m, source_size, target, base, extra``: of ``m`` equal rows ``extra`` have ``base + 1`` copies, the others ``base``."""
    fixed = F.when(F.col("target") > 0, F.lit(float(most))).otherwise(F.lit(0.0))
    units = F.round(F.when(F.col("tilt").isNull(), fixed).otherwise(_rate(most)) * UNITS).cast("decimal(38,0)")
    rates = _met(sizes, tilted, ["source"]).select("source", "size", "n", "source_size", "target", units.alias("units"))
    running = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    passed = lambda c: F.expr(f"({c} + {UNITS // 2}) div {UNITS}")
    by_size = (
        rates.withColumn("grown", (F.col("n") * F.col("units")).cast("decimal(38,0)")).withColumn("up_to", F.sum("grown").over(running))
        .withColumn("below", F.col("up_to") - F.col("grown")).withColumn("base", F.expr(f"units div {UNITS}"))
        .select("source", "size", "n", "source_size", "target", "base", (passed("up_to") - passed("below") - F.col("n") * F.col("base")).alias("odd"), F.ceil(F.col("n") / RANKED).alias("parts"))
    )
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("parts"))).otherwise(F.lit(0)).cast("bigint")
    dealt = _met(rows, by_size, ["source", "size"]).select(
        "doc_id", "source", "size", "m", "n", "source_size", "target", "base", "odd", part.alias("part"),
        F.sha2(F.concat(F.lit("13:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256).alias("h"),
    )
    # The odd copies of a size are dealt to its parts in proportion, then to the least hashes of each part.
    facts = ["source", "size", "part"]
    parts = dealt.groupBy(*facts).agg(F.sum("m").alias("k"), F.first("n").alias("n"), F.first("odd").alias("odd"))
    along = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    until = F.sum("k").over(along)
    share = lambda c: F.floor(c.cast("decimal(20,0)") * F.col("odd") / F.col("n"))
    odd = parts.withColumn("until", until).select(*facts, (F.when(F.col("until") == F.col("n"), F.col("odd")).otherwise(share(F.col("until"))) - share(F.col("until") - F.col("k"))).cast("bigint").alias("here"))
    inside = Window.partitionBy(*facts).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = _met(dealt, odd, facts).withColumn("before", F.coalesce(F.sum("m").over(inside), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("m"), F.col("here") - F.col("before")))
    return placed.select("doc_id", "source", "size", "m", "source_size", "target", "base", extra.alias("extra"))


def decided(docs: DataFrame, weights: Sequence[float] | DataFrame, share: float, most: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """The rows of :func:`copies` for all documents."""
    if most != int(most) or most < 1:
        raise ValueError("the limit of a document is a whole number of copies")
    rows = stored(sized(docs, id_col, text_col, source_col), "sized")
    sizes = stored(rows.groupBy("source", "size").agg(F.sum("m").alias("n")), "sizes")
    sources = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    wanted = targets(stored(weighted(sources, weights), "weighted"), share, int(most))
    return copies(rows, sizes, tilts(sizes, wanted, int(most)), int(most))


def mix(
    docs: DataFrame, weights: Sequence[float] | DataFrame = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Per row ``doc_id, source, size, source_size, target, copies, taken``: the copies that a mix takes of each document.

    The mix has ``share`` times all words (runs of characters other than white space, of whole texts), dealt to the sources
    by ``weights``. Those repeat over the sources in the order of their names, a null source last (it is a source like any
    other, as is an empty name), or are a table ``source, weight``. No document is taken more than ``most`` times, so no
    source gets more than ``most`` times its words; what it can't take goes to the others. ``taken`` is copies times size.

    The words taken from a source differ from its target by less than twice its longest document. A null or empty text has
    no words. Rows that repeat an id and a size are told apart by nothing, so some of them may have one copy more than the
    others. The result depends on ids, sizes and sources only, not on the order of rows; an empty table gives no rows.

    Texts are read once and not shuffled: only id, source and size are. A source may hold any part of all rows: its
    documents are counted by size before a shuffle, and ranked in groups of one size of about ``RANKED``.
    """
    found = decided(docs, weights, share, most, id_col, text_col, source_col)
    # A row for each copy of an equal row, in steps so that no array grows with their number.
    step = F.explode(F.sequence(F.lit(0), (F.col("m") - 1).cast("bigint"), F.lit(WRITTEN).cast("bigint")))
    some = found.select("*", step.alias("start"))
    each = some.select("*", F.explode(F.sequence(F.col("start"), F.least(F.col("m"), F.col("start") + WRITTEN) - 1)).alias("k"))
    taken = (F.col("base") + (F.col("k") < F.col("extra")).cast("bigint")).alias("copies")
    return each.select("doc_id", "source", "size", "source_size", "target", taken).withColumn("taken", F.col("copies") * F.col("size"))


def mixture(
    docs: DataFrame, weights: Sequence[float] | DataFrame = (3, 1, 2), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """The documents of the mix with all their columns, each as often as :func:`mix` takes it.

    Whole rows are joined with the copies by id, source and size. Rows that share these get copies by their hash in turn.
    """
    found = decided(docs, weights, share, most, id_col, text_col, source_col).select("doc_id", "source", "size", "m", "base", "extra")
    key = F.struct(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").cast("string").alias("source"), n_words(F.col(f"`{text_col}`").cast("string")).alias("size"))
    rows = docs.select(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"), key.alias("key"))
    same = rows["key.doc_id"].eqNullSafe(found["doc_id"]) & rows["key.source"].eqNullSafe(found["source"]) & (rows["key.size"] == found["size"])
    met = rows.join(found, same).select("row", "key", "m", "base", "extra")
    alone = met.filter("m = 1").select("row", (F.col("base") + F.col("extra")).alias("copies"))
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    several = met.filter("m > 1").withColumn("turn", turn).select("row", (F.col("base") + (F.col("turn") <= F.col("extra")).cast("bigint")).alias("copies"))
    return alone.unionAll(several).filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
