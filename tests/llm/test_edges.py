"""Every operator on nulls, empty and very long texts, repeated rows, ties, clashing columns and empty tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evigrid.llm.cap_filters import link_vectors
from evigrid.llm.language_crf import fit_crf, label_languages, language_sample
from evigrid.llm.line_dedup import dedup_lines
from evigrid.llm.mixing import mix_sources, mixed_documents
from evigrid.llm.mpegts import encode_media, parse_media
from evigrid.llm.ngram_join import drop_near_duplicates, ngram_jaccard_join
from evigrid.llm.packing import pack_by_retrieval
from evigrid.llm.queries import tokenizer_files
from evigrid.llm.sharding import shard_by_ring
from evigrid.llm.substring_dedup import substring_dedup
from evigrid.llm.toxicity import Scorer, _spread_windows, drop_toxic, fit_on_rows, fit_toxicity, labelled_rows, score_toxicity

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ROWS = [
    (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1), (1, "alpha beta gamma delta epsilon zeta", "en", "a", 1), (2, None, "en", "a", None), (3, "", None, None, 0), (None, "no id here", "fr", "b", 10),
    (None, None, None, None, None), (4, "   \n\t ", "de", "b", 6), (5, LONG, "en", "c", len(LONG)), (6, "é ü \U0001f600 a\x00b", "fr", None, 9), (7, "one two", "en", "a", 7), (8, "one two", "en", "a", 7), (1, "another text under one id", "en", "b", 5),
]
CLASH = ("n_lines", "taken", "size", "batch", "shard", "place", "node", "quota", "score", "_text", "text_hash", "start", "ids", "_id", "_own")


@pytest.fixture(scope="module", params=["rows", "empty"])
def docs(spark, request):
    rows = ROWS if request.param == "rows" else []
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASH})


MODEL = fit_toxicity(["you are an idiot and a fool", "nice day today my friend"] * 30, [1, 0] * 30)
CRF = fit_crf(["the house of the dog", "la maison de la ville"] * 5, ["en", "fr"] * 5, steps=20)
OPERATORS = {
    "mix": mix_sources, "toxicity": lambda d: score_toxicity(d, MODEL), "language": lambda d: label_languages(d, CRF, runs=True), "lines": dedup_lines, "media": lambda d: parse_media(encode_media(d)),
    "join": ngram_jaccard_join, "ring": shard_by_ring, "pack": lambda d: pack_by_retrieval(d, **tokenizer_files()), "substring": substring_dedup,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_each_row_has_a_result(docs, name):
    out = OPERATORS[name](docs).collect()
    n = docs.count()
    if name == "pack":
        assert len({(r["doc_id"], r["doc_tokens"], r["start"]) for r in out}) <= len(out)
        assert sum(r["start"] == 0 for r in out) == n
    else:
        assert len(out) == n


@pytest.mark.parametrize("stage", [lambda d: drop_toxic(d, MODEL), drop_near_duplicates, mixed_documents])
def test_filters_keep_the_columns(docs, stage):
    out = stage(docs)
    assert out.columns == docs.columns
    out.collect()


@pytest.mark.parametrize("labels", [[], [(1, None), (None, 1), (99, 1)], [(1, 1), (6, 1)], [(1, 0), (1, 1), (4, 0)]])
def test_models_of_few_labels(docs, spark, labels):
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows, prior = labelled_rows(docs, known)
    assert rows.columns == ["id", "text", "label"] and (prior is None or 0 <= prior <= 1)
    out = score_toxicity(docs, fit_on_rows(rows, prior)).collect()
    assert all(0 <= r["score"] <= 1 for r in out)
    sample = language_sample(docs)
    out = label_languages(docs, fit_crf(*sample, steps=2)).collect()
    assert {r["lang_pred"] for r in out} <= {*sample[1], "und"}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_pipeline_stages(docs, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    out = stage(docs.sparkSession, docs, "/root/testdata/sf0.001")
    if name != "packing":
        assert out.columns == corpus_pipeline.COLUMNS
    assert out.count() <= 2 * docs.count() + (0 if name != "packing" else 100)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (9, [1.0, 0.0]), (9, [1.0, 0.0]), (None, [1.0, 0.01]), (10, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("node", "v", "weight", "cap")})
    out = {(r["vec_id"], r["n_links"], r["component_id"]) for r in link_vectors(df).collect()}
    assert {(1, 4, 1), (2, 4, 1), (9, 4, 1), (None, 4, 1)} <= out
    assert {(k, 0, k) for k in (3, 4, 5, 6, 7, 8, 10)} <= out
    assert link_vectors(df.limit(0)).collect() == []


def test_near_copies_under_one_id_or_none(spark):
    words = [f"w{k}" for k in range(60)]
    near = [" ".join(words[:55] + [x] + words[56:]) for x in ("a", "b", "c")]
    far = "quite another text of some words here"
    for ids, keep in (([None, None, None], 2), ([7, 7, 7], 2), ([7, None, 3], 2)):
        df = spark.createDataFrame([(i, t) for i, t in zip(ids, near, strict=True)] + [(None, far)] * 2, "doc_id long, text string")
        out = drop_near_duplicates(df).collect()
        assert len(out) == keep and sum(r["text"] == far for r in out) == 1
        if ids[2] == 3:
            assert {r["doc_id"] for r in out} == {3, None}
        joined = ngram_jaccard_join(df).collect()
        assert sorted(r["n_links"] for r in joined) == [1, 1, 2, 2, 2]


def test_toxic_windows_of_long_texts_all_count():
    random = np.random.RandomState(4)
    vocabulary, bad = [f"{a}{b}{c}" for a in ("lo", "mi", "ta") for b in ("ren", "sal", "vod", "kup") for c in ("a", "el", "ing", "ost", "um")], ["idiotic", "worthless", "moronic"]

    def text(windows: int, toxic: int) -> str:
        rows = random.choice(vocabulary, (windows, 8)).astype(object)
        rows[np.linspace(0, windows - 1, toxic).astype(int), 4] = random.choice(bad, toxic)
        return " ".join(rows.ravel())

    labels = [int(k % 3 == 0) for k in range(600)]
    scorer = Scorer(fit_toxicity([text(n := int(random.randint(3, 60)), y * max(1, n // 6)) for y in labels], labels))
    few, many = scorer([text(6250, 3), text(6250, 1000)])[0]
    assert many > 0.9 and few < many - 0.3


def test_ordinary_windows_come_from_all_texts():
    texts = [" ".join([f"t{k}"] * 80) for k in range(100)]
    held = [w.split()[0] for w in _spread_windows(texts, 8, 500)]
    assert len(held) == 500 and {held.count(b"t%d" % k) for k in range(100)} == {5}
    assert len(_spread_windows(texts, 8, 1000)) == 1000
