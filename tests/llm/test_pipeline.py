import random

import corpus_pipeline
from edges import prose
from test_sets import brute_decontaminate, brute_join

from plumbline.llm import jaccard, language, private


def corpus(spark, tmp_path):
    rng = random.Random(11)
    texts = [prose(rng, rng.randint(20, 90)) for _ in range(30)]
    item = prose(rng, 40)
    rows = [(k, t, "en" if k % 2 else "de", "s", len(t)) for k, t in enumerate(texts)]
    rows += [(50, texts[3], "en", "s", 1), (51, texts[4] + " end", "en", "s", 1), (52, item, "en", "s", 1), (53, prose(rng, 30) + " mail a.b@c.de now", "en", "s", 1)]
    rows += [(54, None, "en", "s", None), (55, "", None, None, 0), (56, "12 34 !!", "en", "s", 1), (None, prose(rng, 30), "de", None, 1), (57, "abc " * 3000, "en", "s", 1), (3, texts[3], "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, [(1, item)]


def ids(df):
    return sorted((r["doc_id"] for r in df.collect()), key=repr)


def test_each_stage_decides_as_brute_force(spark, tmp_path):
    rows, items = corpus(spark, tmp_path)
    docs, sf = spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)
    stages = dict(corpus_pipeline.STAGES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near duplicates", "decontamination", "personal data", "packing"]

    first = stages["language"](spark, docs, sf).cache()
    assert first.columns == docs.columns
    assert ids(first) == sorted((r[0] for r in rows if r[1] and any(c.isalpha() for c in r[1])), key=repr)

    second = stages["near duplicates"](spark, first, sf).cache()
    kept = [(r["doc_id"], r["text"]) for r in first.collect()]
    groups = brute_join(kept, 5, 80)
    leaders = {g for _, n, g in groups if n}
    assert second.columns == docs.columns and set(ids(second)) == leaders and second.count() == len(leaders)

    third = stages["decontamination"](spark, second, sf).cache()
    bad = {r[0] for r in brute_decontaminate([(r["doc_id"], r["text"]) for r in second.collect()], items) if r[5]}
    assert bad == {52} and set(ids(third)) == leaders - bad

    fourth = stages["personal data"](spark, third, sf).cache()
    texts = {r["doc_id"]: r for r in fourth.collect()}
    assert fourth.columns == docs.columns and fourth.count() == third.count()
    assert texts[53]["text"].endswith("mail [EMAIL] now") and texts[53]["n_chars"] == len(texts[53]["text"])
    assert not any(s.kind == "email" for r in texts.values() for s in private.find_spans(r["text"]))

    fifth = stages["packing"](spark, fourth, sf)
    assert set(ids(fifth)) == set(ids(fourth))
    assert sorted(map(repr, (r["doc_id"] for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()))) == sorted(map(repr, set(ids(fifth))))


def test_stages_take_empty_tables(spark, tmp_path):
    corpus(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0


def test_columns_of_other_names_pass_through(spark):
    docs = spark.createDataFrame([(1, "a plain text", "en", 0.1, "x", "y")], "doc_id long, text string, lang string, score double, `a.b` string, row string")
    assert language.predict(docs, language.fit(docs), keep=True).select("row.*").columns == docs.columns
    assert private.mask(docs).columns == docs.columns
    assert jaccard.join(docs).columns == ["doc_id", "n_shingles", "component_id"]
