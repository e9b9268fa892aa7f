"""Prompt and report texts, translations, reference data and report rows on fixtures."""

import pytest
from pyspark.sql import functions as F

from evigrid import dims
from evigrid.functions import text as T
from evigrid.operators import search, texts


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_texts_that_are_composed_already(spark):
    rows = ["plain", "é ü", "Қазақ “x” — №", "é", "가", "Å", "Ā̖̄", "", None, "̀", "a҃́"]
    import unicodedata

    out = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(T.nfc(F.col("t"))).collect()]
    assert out == [None if r is None else unicodedata.normalize("NFC", r) for r in rows]


def test_planner_text(spark):
    assert one(spark, texts.planner_text(F.col("t"), 5), t="abcdefg") == "abcde\n\n[... текст обрезан — оригинал содержит 7 символов ...]"
    assert one(spark, texts.planner_text(F.col("t"), 7), t="abcdefg") == "abcdefg"


def test_hints_and_titles(spark):
    hints = spark.createDataFrame([(2, "УК РК", "226-V"), (1, "КоАП РК", "235-V")], "seq int, name string, code string")
    assert texts.hint_lines(hints).first()[0] == "- КоАП РК = 235-V\n- УК РК = 226-V"
    chunks = spark.createDataFrame([("94-V", 1, " | Ст. 1"), ("94-V", 2, "О данных | Ст. 2"), ("94-V", 3, "Иное"), ("1-V", 1, None)], "law_id string, seq int, source_title string")
    assert [tuple(r) for r in texts.law_title(chunks, "seq").collect()] == [("94-V", "О данных")]


@pytest.mark.parametrize(("title", "content", "law"), [("Налоговый кодекс", "", "214-VII"), ("", "по гражданскому и уголовному", "1000-XIII"), (None, "в законе 94-v", "94-V"), ("ук", "x", None), ("", "413-IV-NEW", "413-IV-NEW"), (None, None, None)])
def test_hinted_law(spark, title, content, law):
    df = spark.createDataFrame([(title, content)], "t string, c string")
    assert df.select(texts.hinted_law(F.col("t"), F.col("c"))).first()[0] == law


def test_look_ups(spark):
    rows = spark.createDataFrame([("94-V", "79", "147", 2025), ("87-IV", "80", "1", 2000), (None, None, None, None)], "law string, offence string, crime string, year int")
    out = [(r["law_valid"], r["fine_person"], r["crime_title"] is not None, r["mrp"], r["mrp_source"] is not None) for r in texts.look_up(rows, spark, "law", "offence", "crime", "year").collect()]
    assert sorted(out, key=str) == sorted([(True, 200, True, 3932, True), (False, None, False, None, False), (None, None, False, None, False)], key=str)


def test_reference_text():
    lines = texts.reference_text().split("\n")
    assert lines[0].startswith("### СПРАВОЧНИК: МРП") and "  2023: 3450 тг (Закон РК от 01.12.2022 № 174-VII «О республиканском бюджете на 2023-2025 годы»)" in lines
    assert "  2026: 4205 тг" in lines and sum(line.startswith("  Ст. ") for line in lines) == len(dims.OFFENCES) + len(dims.CRIMES)
    assert lines[-1] == "  Срок уведомления третьих лиц: 10 рабочих дней (ст.27 Закона о ПД)"


def test_localised_reports(spark):
    reports = spark.createDataFrame([(k, f"[СТАТУС] 94-V отчёт {k}") for k in range(6)] + [(6, " ")], "report_id int, content string")
    answers = spark.createDataFrame([(1, "```markdown\n[СТАТУС] 94-V есеп 1\n```"), (2, "[СТАТУС] есеп"), (3, ""), (4, None), (0, "[СТАТУС] 94-V кеш"), (6, "x")], "report_id int, content string")
    shown, missing, new = texts.localised(reports, spark.createDataFrame([(0, "сақталған")], "report_id int, content string"), answers)
    out = {r["report_id"]: (r["content"], r["origin"]) for r in shown.collect()}
    assert out[0] == ("сақталған", "stored") and out[1] == ("[СТАТУС] 94-V есеп 1", "answer")
    assert {out[k][1] for k in (2, 3, 4, 5, 6)} == {"original"} and out[2][0] == "[СТАТУС] 94-V отчёт 2" and out[6][0] == " "
    assert sorted(r[0] for r in missing.collect()) == [2, 3, 4, 5, 6] and [tuple(r) for r in new.collect()] == [(1, "[СТАТУС] 94-V есеп 1")]


def test_derived_fields(spark):
    analyses = spark.createDataFrame([("a", (["p"], "r"), ["x"], "y"), ("b", None, ["x"], "y"), ("c", None, [], ""), ("d", None, None, None)], "analysis string, stats struct<pros:array<string>,recommendation:string>, custom_pros array<string>, custom_recommendation string")
    facts = spark.createDataFrame([("a", "HIGH"), ("a", "UNVERIFIED"), ("c", "LOW"), ("c", "MEDIUM")], "analysis string, validation_status string")
    verdicts = spark.createDataFrame([("c", "CONFIRMED"), ("c", "CONTRADICTED"), ("c", "UNVERIFIED")], "analysis string, status string")
    out = {r["analysis"]: tuple(r)[1:] for r in texts.derived_fields(analyses, facts, verdicts).collect()}
    assert out["a"] == (1, 1, ["p"], "r") and out["b"] == (0, 0, ["x"], "y")
    assert out["c"][:3] == (1, 0, ["Подтверждено 1 из 3 анализируемых утверждений законопроекта."]) and out["c"][3].endswith("КРИТИЧЕСКИ: 1 ошибок.")
    assert out["d"][2] == ["Подтверждено 0 из 0 анализируемых утверждений законопроекта."] and "КРИТИЧЕСКИ" not in out["d"][3]


def test_fusion_cuts_before_it_reranks(spark):
    rows = [(1, i, 1.0 - i / 100, 0.0, 0, True, 2020, "law" if i != 2 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "query_id int, id int, semantic double, bm25 double, exact int, language_match boolean, year int, law string")
    rerank = spark.createDataFrame([(1, i, float(i)) for i in range(40)], "query_id int, id int, rerank double")
    assert [r["id"] for r in search.fuse(df, k=3, rerank=rerank).orderBy("rank").collect()] == [29, 28, 27]
    assert [r["id"] for r in search.fuse(df, k=3, law_only=True).orderBy("rank").collect()] == [0, 1, 3]
    assert [r["id"] for r in search.fuse(df, k=2, pool=3, cut=2, law_only=True, rerank=rerank).orderBy("rank").collect()] == [1, 0]
