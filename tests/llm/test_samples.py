"""Samples of the learned operators stay bounded and are never empty with many rows or copies under one id."""

import zlib

import pytest
from pyspark.sql import functions as F

from evigrid.llm.language_crf import fit_on_rows as fit_languages
from evigrid.llm.language_crf import label_languages, language_sample, sample_rows
from evigrid.llm.toxicity import fit_on_rows, fit_toxicity, labelled_rows, score_toxicity

LEARNED = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2]


@pytest.mark.parametrize("own", LEARNED[:3])
@pytest.mark.parametrize("copies", [False, True])
def test_languages_of_many_rows_under_one_id(spark, own, copies):
    n = F.lit(7) if copies else F.col("id")
    docs = spark.range(20_000).select(F.lit(own).cast("long").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("the house of the dog "), n)).otherwise(F.concat(F.lit("la maison de la ville "), n)).alias("text"), F.when(F.col("id") % 2 == 0, "en").otherwise("fr").alias("lang"))
    texts, langs = language_sample(docs)
    assert set(langs) == {"en", "fr"} and (len(texts) == 2 if copies else 1000 < len(texts) <= 2000)
    if own == LEARNED[0]:
        model = fit_languages(sample_rows(docs))
        out = label_languages(spark.createDataFrame([(1, "the dog of the house"), (2, "la ville de la maison")], "doc_id long, text string"), model).collect()
        assert [r["lang_pred"] for r in sorted(out)] == ["en", "fr"]


def test_rare_and_many_languages(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.when(F.col("id") < 30, "rare").otherwise(F.concat(F.lit("l"), F.col("id") % 5)).alias("lang"))
    _, langs = language_sample(docs, most=200)
    assert len(langs) <= 200 and langs.count("rare") > 10 and len(set(langs)) == 6
    _, langs = language_sample(docs, languages=5)
    assert "rare" not in langs and len(set(langs)) == 5


@pytest.mark.parametrize("own", LEARNED[:2])
@pytest.mark.parametrize("copies", [False, True])
def test_labelled_texts_of_many_rows_under_one_id(spark, own, copies):
    n = F.lit(7) if copies else F.col("id")
    docs = spark.range(20_000).select(F.lit(own).cast("long").alias("doc_id"), F.concat(F.lit("you are an idiot and a fool "), n).alias("text"))
    docs = docs.unionByName(spark.range(400).select((F.col("id") + 1000).alias("doc_id"), F.concat(F.lit("a nice day with my friend "), F.col("id")).alias("text")))
    labels = docs.select("doc_id", (F.col("doc_id") == own).cast("int").alias("toxic")).distinct()
    rows, prior = labelled_rows(docs, labels, most=500)
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    assert 200 < counts[0] <= 400 and (counts[1] == 1 if copies else 400 < counts[1] <= 500) and 0 < prior < 0.01
    if not copies:
        model = fit_on_rows(rows, 0.5)
        out = {r["doc_id"]: r["score"] for r in score_toxicity(spark.createDataFrame([(1, "such an idiot and a fool " * 3), (2, "a nice day " * 3)], "doc_id long, text string"), model).collect()}
        assert out[1] > out[2]


def test_dictionary_keeps_whole_units():
    words = [f"bad{a}{b}word" for a in "abcdefghij" for b in "klmnopqrst"]
    texts = [" ".join(words[k % 100 :] + words[: k % 100]) for k in range(40)] + [f"plain text number {k} of many" for k in range(40)]
    model = fit_toxicity(texts, [1] * 40 + [0] * 40, dictionary=700)
    tail = model.toxic[-200:].decode()
    assert all(f" {w} " in f" {tail} " for w in tail.split()[1:])
