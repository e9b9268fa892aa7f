"""Law registry, answers and audit rules on small fixtures."""

import pytest
from pyspark.sql import functions as F

from evigrid.operators import answers, audit, claims, corpus, laws, upkeep
from evigrid.sources import ingest

TEXTS = [
    ("ӘҚБтК 640-бабы", "koap_article", "640-"), ("640-бабы ӘҚБтК бойынша", "koap_article", "640-"), ("ҚК 190-бабы", "uk_article", "190-"), ("190-бабы бойынша ҚК", "uk_article", "190-"),
    ("айлық есептік көрсеткіштің 500 еселенген", "fine_mrp", "500"), ("статьей 207 Уголовного кодекса", "uk_article", "207"), ("қолданысқа енгізіледі он күн өткен соң бастап", "enforcement_date", "он күн өткен соң бастап"),
]


def test_claim_patterns(spark):
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(TEXTS)], "doc_id long, text string")
    found = {(r["doc_id"], r["tag"], r["entity"]) for r in claims.extract_claims(docs).collect()}
    assert {(k, tag, entity) for k, (_, tag, entity) in enumerate(TEXTS)} <= found


@pytest.mark.parametrize(("text", "laws_"), [
    ("по КоАП", ["235-V"]), ("акт амнистии", []), ("нарушение АК РК", ["1000-XIII", "309-II"]), ("в законе 413-IV", ["413-IV"]), ("об исполнительном производстве 233-IV", ["233-IV", "261-IV"]), (None, []),
])
def test_laws_of_a_claim(spark, text, laws_):
    df = spark.createDataFrame([(text,)], "t string")
    none = F.array().cast("array<string>")
    assert df.select(laws.claim_laws(F.col("t"), F.lit(None).cast("string"), none, none)).first()[0] == laws_
    assert df.select(laws.claim_laws(F.col("t"), F.lit(""), none, F.array(F.lit("94-V")))).first()[0] == ["94-V"]


def test_chunks_join_stripped_clauses(spark):
    clauses = [f"{k}. " + f"слово{k} " * 120 for k in range(1, 9)]
    rows = [("10", "Статья 10\n" + "\n".join(clauses)), ("12", "Текст без пунктов. " * 300), ("13", "короткая"), ("14", None), ("15", "")]
    out = ingest.adaptive_chunks(spark.createDataFrame(rows, "doc_id string, text string")).orderBy("doc_id", "k").collect()
    # the plain definition
    current, want = "", []
    for part in ["Статья 10", *clauses]:
        if len(current) + len(part) > 4000 and current:
            want.append(current)
            current = current[-200:] + "\n" + part
        else:
            current = (current + "\n" + part).strip()
    want.append(current)
    assert [(r["chunk_name"], r["content"]) for r in out if r["doc_id"] == "10"] == [(f"10_p{k + 1}", c) for k, c in enumerate(want)]
    assert [r["chunk_name"] for r in out if r["doc_id"] == "12"] == ["12_p1", "12_p2"]
    assert [r["content"] for r in out if r["doc_id"] == "13"] == ["короткая"]


def test_ranks(spark):
    rows = [("TIER_2", "Гражданский кодекс Республики Казахстан", "Статья 7. О внесении изменений", "https://zakon.kz/a", 2, 0.85), ("TIER_3", "Этический кодекс", "блог", "https://x.kz", 11, 0.5), ("TIER_1", "", "", "https://adilet.zan.kz/rus/docs/V1", 7, 1.0), ("BLACKLIST", "", "", "https://forum.kz", 11, 1.0)]
    df = spark.createDataFrame(rows, "tier string, title string, content string, url string, rank int, confidence double")
    for r in df.withColumn("s", corpus.rank_score(*[F.col(c) for c in ("tier", "title", "content", "url")])).collect():
        assert (r["s"]["rank"], round(r["s"]["confidence"], 6)) == (r["rank"], r["confidence"])


def test_article_boost(spark):
    none = F.array(F.lit("c1"))
    df = spark.createDataFrame([(0.05, 0.2), (0.05, 0.01), (0.3, 0.9), (0.05, 0.6)], "score double, article double")
    rule = audit.fact_status(F.col("score"), F.lit(0.5), none, F.lit(None).cast("double"), F.lit(True), F.lit(True), F.lit(None).cast("double"), F.col("article"))
    assert [(r[0]["validation_status"], r[0]["bm25_score"]) for r in df.select(rule).collect()] == [("HIGH", 0.35), ("LOW", 0.05), ("HIGH", 0.3), ("HIGH", 0.6)]


@pytest.mark.parametrize(("body", "ids"), [
    ('["too short", "a claim long enough", 5, {"claim_text": "x", "severity": "grave"}, {"claim_text": ""}, {"claim_text": "y", "claim_type": "temporal"}]', ["claim_0000", "claim_0001"]),
    ('{"claims": [{"claim_text": "z"}]}', ["claim_0000"]), ("broken", []), ("{}", []), (None, []),
])
def test_claim_answers(spark, body, ids):
    raw = spark.createDataFrame([(1, 0, body)], "d int, w int, json string")
    assert sorted(r["claim_id"] for r in answers.claim_rows(raw, ["d"], "w").collect()) == ids


def test_plans_of_wrong_shape(spark):
    raw = spark.createDataFrame([(1, '{"web_queries_ru": "none", "web_queries_kk": [1, {"query_text": "q", "max_results": "many"}, {"query_text": "ok"}]}'), (2, "broken"), (3, None)], "k int, json string")
    assert [tuple(r) for r in answers.plan_queries(raw, ["k"]).collect()] == [(1, "kk", 2, "ok", [], 10)]
    registry = spark.createDataFrame([], "law_id string, code string, title string")
    assert answers.plan_law_queries(raw, registry, ["k"]).collect() == []


def test_natural_order_of_articles(spark):
    df = spark.createDataFrame([("10",), ("9-1",), ("9",), ("9-10",), ("9-2",), ("x",)], "a string")
    assert [r["a"] for r in df.orderBy(upkeep.natural_key(F.col("a"))).collect()] == ["9", "9-1", "9-2", "9-10", "10", "x"]
