"""Text functions on fixture strings."""

import pytest
from pyspark.sql import functions as F

from evigrid import dims
from evigrid.functions import text as T
from evigrid.sources import ingest


def value(spark, column, **inputs):
    df = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} string" for k in inputs))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "expected"), [
    ("Согласно статье 47-1 закона", "47-1"), ("ст. 12 применяется", "12"), ("осы 61-бап бойынша", "61"), ("бабы 7", "7"), ("нет ссылок", None),
])
def test_article(spark, text, expected):
    assert value(spark, T.article_of(F.col("t")), t=text) == expected


def test_law_ids(spark):
    assert value(spark, T.law_ids(F.col("t")), t="по № 413-IV и 94-v, снова 413-IV") == ["413-IV", "94-V"]
    assert value(spark, T.law_core(F.col("t")), t="226-v-UK") == "226-V"
    assert value(spark, T.law_core(F.col("t")), t="закон") is None


def test_tokens(spark):
    assert value(spark, T.tokens(F.col("t")), t="Настоящий Закон вводится в действие: штраф 500 МРП, де-факто!") == ["закон", "штраф", "500", "мрп", "де-факто"]
    assert value(spark, T.tokens(F.col("t")), t="") == []


def test_morph_tokens_keep_a_query_of_stop_words(spark):
    assert value(spark, T.morph_tokens(F.col("t")), t="закон штрафами") == ["штраф"]
    assert value(spark, T.morph_tokens(F.col("t")), t="закон статья") == ["закон", "стать"]


def test_transliteration(spark):
    assert value(spark, T.transliterate(F.col("t")), t="Qazaqstan zhyly á Ñ") == "Qazaqstan жyly ә Ң"
    assert value(spark, T.transliterate(F.col("t")), t="plain text") == "plain text"


def test_language(spark):
    got = [value(spark, T.language(F.col("t")), t=t) for t in ("Закон о данных", "A plain text", "Қазақ тілі", "аб cd")]
    assert got == ["ru", "en", "kk", "mixed"]


def test_numbers_with_units(spark):
    got = value(spark, T.numbers_with_units(F.col("t")), t="штраф 1 000 МРП и 5,5 % за 10 дней")
    assert [(x["unit"], x["value"]) for x in got] == [("мрп", "1000"), ("%", "5.5"), ("дней", "10")] or [(x["unit"], x["value"]) for x in got] == [("мрп", "1000"), ("дней", "10")]


def test_years(spark):
    assert value(spark, T.years(F.col("t")), t="в 2013 году и 2024, не 1999") == [2013, 2024]


@pytest.mark.parametrize(("url", "tier"), [
    ("https://adilet.zan.kz/rus/docs/Z1", "TIER_1"), ("http://www.zakon.kz/x", "TIER_2"), ("https://sub.zakon.kz", "TIER_2"), ("https://medium.com/a", "TIER_3"), ("https://x.forum.kz/t", "BLACKLIST"), ("https://notzakon.kz", "TIER_3"), ("broken", "TIER_3"),
])
def test_web_tier(spark, url, tier):
    assert value(spark, T.web_tier(F.col("u")), u=url) == tier


def test_repairs(spark):
    assert value(spark, T.repair_spacing(F.col("t")), t="С т а т ь я  1\nобычная строка текста") == "Статья 1\nобычная строка текста"
    assert value(spark, T.repair_breaks(F.col("t")), t="10-\n5 и 124\n-бап") == "10-5 и 124-бап"


def test_labels_and_fences(spark):
    for text, want in (
        ("Факт подтверждён (S5, S6).", "Факт подтверждён."), ("норма (S4, ст. 5) действует", "норма (ст. 5) действует"), ("норма (ст. 5, S6)", "норма (ст. 5)"),
        ("Вывод, источник S3: верен", "Вывод верен"), ("ст. 1 в редакции S5, S6 .", "ст. 1."), ("( ; п. 2) и ()", "(п. 2) и"), ("Bare S1 stays", "Bare S1 stays"),
    ):
        assert value(spark, T.clean_labels(F.col("t")), t=text) == want
    assert value(spark, T.strip_fences(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert value(spark, T.strip_fences(F.col("t")), t="plain") == "plain"


def test_preserved(spark):
    source = "[ПОДТВЕРЖДЕНО] ст.  14 закона 94-V, 92 %, 15.06.2026, K1400000226, https://adilet.zan.kz/x"
    assert value(spark, T.preserved(F.col("a"), F.col("b")), a=source, b="94-V ст. 14 [ПОДТВЕРЖДЕНО] 92  % 15.06.2026 K1400000226 https://adilet.zan.kz/x") is True
    for lost in ("94-V", "ст.  14", "92 %", "15.06.2026", "K1400000226", "[ПОДТВЕРЖДЕНО]", "https://adilet.zan.kz/x"):
        assert value(spark, T.preserved(F.col("a"), F.col("b")), a=source, b=source.replace(lost, "")) is False
    assert value(spark, T.preserved(F.col("a"), F.col("b")), a="без улик", b="перевод") is True
    assert value(spark, T.preserved(F.col("a"), F.col("b")), a="без улик", b=" ") is False


@pytest.mark.parametrize(("text", "language"), [("Qazaqstan Respublikasy turaly memleket", "kk"), ("jáne", "kk"), ("The house of the dog", "en"), ("Закон о связи", "ru"), ("Заң туралы қаулы", "kk"), ("дом house", "mixed"), ("a" * 400 + "я" * 600, "en")])
def test_language_rules(spark, text, language):
    assert value(spark, T.language(F.col("t")), t=text) == language


def test_units_and_scores(spark):
    got = [value(spark, T.unit_bucket(F.col("u")), u=u) for u in ("часов", "рабочих дней", "календарных дней", "месяца", "суток")]
    assert got == ["часов", "рабочих дней", "дней", "месяцев", "суток"]
    assert value(spark, T.score_bar(F.lit(0.58)), u="") == "█████░░░░░"
    assert [value(spark, T.traffic_light(F.lit(x).cast("double")), u="") for x in (0.8, 0.5, 0.1, None)] == ["green", "yellow", "red", "unknown"]


def test_safe_number(spark):
    assert [value(spark, T.safe_number(F.col("t")), t=t) for t in ("5.5", "196-1", "-3", "1.2.3", "abc")] == [5.5, None, -3.0, None, None]


def test_file_names(spark):
    assert str(value(spark, ingest.version_date(F.col("n")), n="law_01-02-2024.docx")) == "2024-02-01"
    assert value(spark, ingest.version_date(F.col("n")), n="law_41-02-2024.docx") is None
    assert str(value(spark, ingest.stamp_of(F.col("n")), n="r_20240102_030405")) == "2024-01-02 03:04:05"
    assert [value(spark, ingest.document_format(F.col("n")), n=n) for n in ("a/b.PDF", "x.docx", "y.txt", "z.md", "none")] == ["pdf", "docx", "txt", None, None]


def test_json_repair():
    assert ingest.repair_json('```json\n[{"a": 1}, {"b": 2, "c"') == '[{"a": 1}]'
    assert ingest.repair_json('{"a": [1, 2], "b": {"c": "x}"}}') == '{"a": [1, 2], "b": {"c": "x}"}}'
    assert ingest.repair_json("nothing") is None
    assert ingest.repair_json(None) is None


def test_dimensions_are_consistent():
    assert dims.LEGAL_RANKS["CODE"] < dims.LEGAL_RANKS["CONSTITUTIONAL_LAW"]
    assert abs(sum(dims.FUSION_WEIGHTS) - 1) < 1e-12
