"""Documents to training sequences: language, near duplicates, benchmark passages, personal data, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import jaccard, language, packing, private, winnowing
from plumbline.llm.common import stored

#: A text whose best code takes more bits a byte than this is in none of the learned languages.
MOST_BITS = 6.5


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in a language that the labelled ones teach; texts without letters and noise go."""
    found = language.predict(docs, language.fit(docs), keep=True)
    return found.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("bits_per_byte") <= MOST_BITS)).select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least id.

    Documents without words, and those that link with nothing, stay. Of rows that repeat an id with texts of
    one group, one stays; a group all of whose ids are null keeps one row too.
    """
    groups = jaccard.join(docs, keep_text_hash=True)
    first = groups.filter("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row"))
    wanted = first.select("row.doc_id", "row.text_hash")
    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("w.text_hash") == F.xxhash64("d.text"))
    wordless = groups.filter("n_shingles = 0").select("doc_id", "text_hash").distinct()
    kept = docs.alias("d").join(wanted.alias("w"), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionAll(docs.alias("d").join(wordless.alias("w"), same, "left_semi"))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth stands in passages of benchmark items."""
    found = winnowing.find(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=True)
    return winnowing.marked(found).filter("NOT contaminated").select("row.*")


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the text."""
    return private.mask(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", known_language),
    ("near duplicates", one_of_each),
    ("decontamination", uncontaminated),
    ("personal data", without_personal_data),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Model scores, set joins and token ids have no SQL; tests compare with brute force.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
