"""Search, fusion, audit, claims, corpus, ingest and events on fixtures."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from evigrid.operators import audit, claims, corpus, evaluation, fusion, report, search
from evigrid.sources import ingest
from evigrid.streaming import events as ev

CHUNK = "id string, law_id string, article string, legal_rank int, web_tier string, effective_date date, source_url string, content string, is_duplicate boolean"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# --- search


def test_bm25_of_a_small_corpus(spark):
    """Two documents: every idf is zero or negative, as the epsilon rule has it."""
    docs = spark.createDataFrame([(1, "alpha beta beta"), (2, "alpha gamma")], "id long, text string")
    index = search.build_index(docs, lambda c: F.split(c, " "))
    idf = dict(rows(index.terms, "term", "idf"))
    import math

    raw = {"alpha": math.log(0.5) - math.log(2.5), "beta": 0.0, "gamma": 0.0}
    assert idf["beta"] == pytest.approx(0)
    assert idf["alpha"] == pytest.approx(0.25 * sum(raw.values()) / 3)


def test_repeated_query_terms_count_twice(spark):
    docs = spark.createDataFrame([(k, f"word{k} common") for k in range(6)], "id long, text string")
    index = search.build_index(docs, lambda c: F.split(c, " "))
    asked = spark.createDataFrame([("once", "word1"), ("twice", "word1 word1")], "query_id string, text string")
    got = {r["query_id"]: r["score"] for r in search.score(index, asked, lambda c: F.split(c, " ")).collect()}
    assert got["twice"] == pytest.approx(2 * got["once"])


def test_pack_prefix_stops_at_the_first_overflow(spark):
    df = spark.createDataFrame([("g", 1, 50), ("g", 2, 60), ("g", 3, 10)], "g string, seq int, n int")
    assert rows(search.pack_prefix(df, "g", [F.col("seq")], F.col("n"), 100), "seq", "label") == [(1, "S1")]


def test_batch_selection_caps_lexical_rows_only(spark):
    forced = spark.createDataFrame([(0, k) for k in range(3)], "batch int, id int")
    ranked = spark.createDataFrame([(0, c, 10 + i, float(9 - i)) for c in range(2) for i in range(4)], "batch int, claim_seq int, id int, score double")
    out = search.select_for_batch(forced, forced, ranked, per_claim=2, cap=6)
    assert rows(out, "id", "origin") == [(0, "given"), (1, "given"), (2, "given"), (10, "lexical"), (11, "lexical"), (12, "lexical")]


# --- fusion


@pytest.mark.parametrize(("url", "content", "fallback", "law", "spam"), [
    ("http://x.kz", "short", "CSS_SELECTOR", None, False), ("http://x.kz", "short", "LOCAL_CACHE", None, True), ("http://x.kz", "short", "LOCAL_CACHE", "94-V", False),
    ("https://egov.kz/cms/1", "статья 5 штраф " * 20, None, None, True), ("http://x.kz", "скачать приложение статья 5 " * 20, None, None, True), ("http://x.kz", "просто текст без сигналов " * 20, None, None, True),
    ("http://zakon.kz/1", "просто текст без сигналов " * 20, None, None, False), ("http://x.kz", "статья 5 предусматривает " * 20, None, None, False),
])
def test_spam(spark, url, content, fallback, law, spam):
    df = spark.createDataFrame([(url, content, fallback, law)], "u string, c string, f string, l string")
    assert df.select(fusion.is_spam(F.col("u"), F.col("c"), F.col("f"), F.col("l"))).first()[0] is spam


def test_conflicts(spark):
    day = dt.date
    data = [
        ("a", "L", "1", 2, None, day(2020, 1, 1), "u1", "срок 10 дней", False), ("b", "L", "1", 6, None, day(2021, 1, 1), "u2", "срок 15 дней", False),
        ("c", "L", "2", 4, "TIER_2", None, "u3?x", "на практике не работает 2010", False), ("d", "L", None, 11, None, None, "u4", "год 2020", False), ("e", "L", "1", 9, None, day(1999, 1, 1), "u5", "срок 99 дней", True),
    ]
    out = {r["id"]: r for r in fusion.detect_conflicts(spark.createDataFrame(data, CHUNK)).collect()}
    assert out["a"]["conflict_types"] == ["ENFORCEMENT_GAP", "FACTUAL", "HIERARCHY", "TEMPORAL"]
    assert set(out["c"]["conflict_with_ids"]) == {"a", "b", "d"}
    assert out["c"]["conflict_types"] == ["ENFORCEMENT_GAP", "HIERARCHY", "TEMPORAL"]
    assert not out["e"]["is_conflict"] and out["e"]["conflict_types"] is None


def test_hierarchy_counts_agree_with_pairs(spark):
    df = spark.createDataFrame([(str(k), f"L{k % 3}", 1 + k % 11) for k in range(60)], "id string, law_id string, legal_rank int")
    pairs = fusion.hierarchy_pairs(df).groupBy("law_id").count()
    assert rows(pairs, "law_id", "count") == rows(fusion.hierarchy_counts(df), "law_id", "n_pairs")


def test_greedy_replay_is_not_transitive(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (4, 5)], "a long, b long")
    ranks = spark.createDataFrame([(1, 4), (2, 4), (3, 4), (4, 9), (5, 2)], "id long, legal_rank int")
    assert rows(fusion.greedy_losers(pairs, ranks), "id", "kept_id") == [(2, 1), (4, 5)]
    assert rows(fusion.greedy_keep(spark.createDataFrame([(1, 2), (2, 3)], "a long, b long")), "id") == [(2,)]


def test_cosine_pairs_blocks(spark):
    df = spark.createDataFrame([(k, [1.0, k * 0.1]) for k in range(12)] + [(99, [0.0, 0.0])], "id long, vector array<double>")
    one, many = fusion.cosine_pairs(df, 0.95), fusion.cosine_pairs(df, 0.95, block=3)
    assert rows(one, "a", "b") == rows(many, "a", "b") and (0, 1) in rows(one, "a", "b") and all(b != 99 for _, b in rows(one, "a", "b"))


def test_jaccard_pairs_find_all(spark):
    texts = ["alpha beta gamma delta omega", "alpha beta gamma delta", "sigma theta alpha beta", "delta gamma beta alpha omega extra", "zeta"]
    sets = [set(t.split()) for t in texts]
    want = [(i, j) for i in range(5) for j in range(i + 1, 5) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6]
    got = rows(fusion.jaccard_pairs(spark.createDataFrame(list(enumerate(texts)), "id long, text string")), "a", "b")
    assert got == want


# --- audit


def verdicts(spark, data):
    return spark.createDataFrame(data, "analysis int, claim_id string, status string, severity string, best_rank int, bm25_score double")


@pytest.mark.parametrize(("data", "expected"), [
    ([(1, "c1", "CONFIRMED", "medium", None, 0.9)], 0.58),
    ([(1, "c1", "UNVERIFIED", "high", None, None)] * 3, 0.1), ([(1, "c1", "UNVERIFIED", "low", None, None)] * 2, None),
    ([(1, "c1", "UNVERIFIED", "medium", None, None)] + [(1, s, "CONTRADICTED", s, None, 0.0) for s in ("critical", "high", "medium")], 0.084),
    ([(1, "c1", "CONFIRMED", "medium", None, None), (1, "c2", "UNVERIFIED", "medium", None, None)], 0.375),
    ([(1, "structural_1", "CONFIRMED", "medium", 2, 1.0), (1, "c1", "CONFIRMED", "low", 4, 0.5)], 0.5 * 0.8 + 0.3 * 0.8 + 0.2 * 0.5),
])
def test_reliability(spark, data, expected):
    got = audit.reliability(verdicts(spark, data), ["analysis"]).first()["reliability"]
    assert got == (None if expected is None else pytest.approx(expected, abs=1e-12))


def test_sync(spark):
    v = spark.createDataFrame([(k, s, "LOW", ["old"]) for k, s in (("a", "CONFIRMED"), ("b", "UNVERIFIED"), ("c", "UNVERIFIED"), ("d", "CONTRADICTED"), ("e", "UNVERIFIED"), ("f", "CONFIRMED"))], "claim_id string, status string, confidence string, source_ids array<string>")
    f = spark.createDataFrame([("a", "LOW", 0.1, ["n"]), ("b", "HIGH", 0.5, ["n"]), ("c", "MEDIUM", 0.5, ["n"]), ("d", "HIGH", 0.9, ["n"]), ("e", "HIGH", None, ["n"])], "claim_id string, validation_status string, bm25_score double, source_ids array<string>")
    synced = audit.sync_facts(f, v, ["claim_id"])
    assert ("d", "LOW", 0.0) in rows(synced.where("bm25_score is not null"), "claim_id", "validation_status", "bm25_score")
    out = {r["claim_id"]: (r["status"], r["confidence"], r["source_ids"]) for r in audit.sync_verdicts(v, synced, ["claim_id"]).collect()}
    assert out == {"a": ("UNVERIFIED", "LOW", ["old"]), "b": ("CONFIRMED", "HIGH", ["n"]), "c": ("UNVERIFIED", "LOW", ["old"]), "d": ("CONTRADICTED", "LOW", ["old"]), "e": ("UNVERIFIED", "LOW", ["old"]), "f": ("CONFIRMED", "LOW", ["old"])}


def test_conflict_records(spark):
    v = spark.createDataFrame([(1, k, "CONTRADICTED", c, d) for k, (c, d) in enumerate([("c1", "превышает лимит КоАП"), ("c2", "Срок 24 часа"), ("c3", "МРП 3450 вместо 3932"), ("c1", "снова"), ("", "без id")])] + [(1, 9, "CONFIRMED", "c9", "коап")], "a int, seq int, status string, claim_id string, contradiction_detail string")
    out = audit.conflict_records(v, ["a"], "seq")
    assert rows(out, "record_id", "claim_id", "conflict_type") == [("conflict_0000", "c1", "HIERARCHY"), ("conflict_0001", "c2", "TEMPORAL"), ("conflict_0002", "c3", "FACTUAL")]


@pytest.mark.parametrize(("a", "b", "same"), [
    ("во всенародном референдуме", "всенародного референдума", True), ("штраф 100 тенге", "штраф 200 тенге", False), ("допускается вывоз", "не допускается вывоз", False), ("судебные приставы", "налоговые органы", False), ("", "текст", False),
])
def test_same_phrase(spark, a, b, same):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(audit.same_phrase(F.col("a"), F.col("b"))).first()[0] is same


def test_verifier_rules(spark):
    schema = "k string, status string, source_ids array<string>, is_deterministic boolean, document_value string, found_value string, contradiction_detail string"
    data = [
        ("det", "CONTRADICTED", ["x"], True, "a", "b", "c"), ("infl", "CONTRADICTED", ["x"], False, "всенародном референдуме", "всенародного референдума", "z"), ("none", "CONTRADICTED", ["zz"], False, "срок 5", "срок 7", "семь"),
        ("good", "CONTRADICTED", ["x"], False, "штраф 100", "штраф 500", "500"), ("bad", "CONTRADICTED", ["x"], False, "штраф 100", "совсем другое", "999"), ("ok", "CONFIRMED", ["x"], False, "a", "b", None),
        ("absent", "CONTRADICTED", ["x"], False, "заменить слово", "фраза отсутствует", None), ("target", "CONTRADICTED", ["x"], False, "заменить «тенге» на «теңге»", "сумма в тенге", "есть"),
    ]
    chunks = spark.createDataFrame([("x", "Установлен штраф 500 МРП")], "id string, content string")
    out = {r["k"]: (r["rule"], r["status"]) for r in audit.verify_contradictions(spark.createDataFrame(data, schema), chunks, ["k"]).collect()}
    assert {k: v[0] for k, v in out.items()} == {"det": "deterministic", "infl": "inflection", "none": "no_source", "good": "corroborated", "bad": "not_corroborated", "ok": None, "absent": "absence", "target": "amendment_target"}
    assert out["good"][1] == out["det"][1] == "CONTRADICTED" and out["bad"][1] == out["none"][1] == "UNVERIFIED"


def test_fact_status_never_confirms_without_sources(spark):
    schema = "k string, score double, confidence double, sources array<string>, exact double, topology boolean, arithmetic boolean, fallback double"
    data = [("exact", 0.0, 0.9, ["x"], 0.3, True, True, None), ("wrong", 0.0, 0.9, ["x"], 0.9, True, False, None), ("unlinked", 0.0, 0.9, ["UNLINKED"], None, False, True, 0.15), ("found", 0.0, 0.9, [], None, False, True, 0.21), ("virtual", 0.0, 0.9, ["reference_data"], None, False, True, None), ("other", 0.9, 0.9, ["x"], None, False, True, None), ("half", 0.3, 0.9, ["x"], None, True, False, None)]
    df = spark.createDataFrame(data, schema)
    out = df.select("k", audit.fact_status(*[F.col(c) for c in ("score", "confidence", "sources", "exact", "topology", "arithmetic", "fallback")]).alias("s")).select("k", "s.*")
    assert {r["k"]: (r["validation_status"], r["bm25_score"]) for r in out.collect()} == {"exact": ("HIGH", 0.3), "wrong": ("LOW", 0.9), "unlinked": ("UNVERIFIED", 0.15), "found": ("MEDIUM", 0.21), "virtual": ("HIGH", 0.9), "other": ("UNVERIFIED", None), "half": ("MEDIUM", 0.3)}


def test_topology_guards(spark):
    chunks = spark.createDataFrame([("g", "409-I"), ("k", "235-V"), ("o", "261-IV")], "id string, law_id string")
    facts = spark.createDataFrame([("1", "нарушение по КоАП", [], ["g"]), ("2", "гражданский кодекс", [], ["k"]), ("3", "текст", ["261-IV"], ["o"]), ("4", "текст", ["94-V"], ["o"]), ("5", "текст", [], ["missing"]), ("6", "текст", [], ["UNLINKED"])], "k string, claim_text string, laws array<string>, source_ids array<string>")
    assert rows(audit.topology(facts, chunks, ["k"]), "k", "topology_ok") == [("1", False), ("2", False), ("3", True), ("4", False), ("5", False), ("6", False)]


# --- claims


@pytest.mark.parametrize(("text", "tag", "entity"), [
    ("Закон РК от 21 мая 2013 года № 94-V", "law_id", "94-V"), ("штраф по статью 640 КоАП РК", "koap_article", "640"), ("статьей 207 Уголовного кодекса", "uk_article", "207"), ("внести изменения в статью 41 и статью 105", "article_ref", "105"),
    ("влечет штраф в размере 500 МРП", "fine_mrp", "500"), ("Один МРП составляет 3 450 тенге на 2023 год", "mrp_value", "3450"), ("не позднее 24 (двадцати четырех) часов", "hours_deadline", "24"), ("в течение 10 рабочих дней", "workdays_deadline", "10"),
])
def test_extract(spark, text, tag, entity):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert (tag, entity) in rows(claims.extract_claims(docs), "tag", "entity")


def test_extract_tables_and_ids(spark):
    docs = spark.createDataFrame([(1, "МРП\nфизлица | 20 | да\n1 | 30 | нет\nповтор 5 МРП\nповтор 5 МРП")], "doc_id long, text string")
    out = claims.extract_claims(docs)
    got = rows(out, "claim_id", "tag", "entity")
    assert ("claim_0001", "fine_mrp", "20") in got and [g[0] for g in got] == [f"claim_{k:04d}" for k in range(len(got))] and len(got) == 2


def test_entity_checks(spark):
    docs = spark.createDataFrame([(1, "№ 87-IV и № 94-V\nМРП составляет 3 450 тенге в 2023 году\nМРП равен 1 111 тенге\nст. 79 штраф 3000 МРП"), (2, "МРП равен 3 932 тенге, 2023")], "doc_id long, text string")
    out = {(r["doc_id"], r["tag"], r["entity"]): r["deterministic_status"] for r in claims.check_entities(claims.extract_claims(docs), docs).collect()}
    assert out[1, "law_id", "87-IV"] == "CONTRADICTED" and out[1, "law_id", "94-V"] is None
    assert out[1, "mrp_value", "3450"] == "CONFIRMED" and out[1, "mrp_value", "1111"] == "CONTRADICTED" and out[2, "mrp_value", "3932"] is None
    assert out[1, "fine_mrp", "3000"] == "CONTRADICTED"


@pytest.mark.parametrize(("text", "kind", "expected"), [
    ("Закон вводится в действие по истечении десяти дней", "temporal", True), ("дополнить словами «и другие»", "legal_ref", False), ("оператор обязан уведомить", "temporal", False), ("срок 10 дней", "legal_id", False),
    ("статья 5 упоминается", "factual", False), ("№ 94-V", "legal_id", True), ("ст. 207", "legal_ref", True), ("в документе упоминается реестр", "temporal", True), ("произвольный текст", "temporal", False),
])
def test_structural(spark, text, kind, expected):
    df = spark.createDataFrame([(text, kind)], "t string, k string")
    assert df.select(claims.is_structural(F.col("t"), F.col("k"), F.lit(None).cast("string"), F.array().cast("array<string>"))).first()[0] is expected


def test_dedup_claims_across_languages(spark):
    schema = "d int, seq int, claim_text string, quote string, claim_type string, entities array<string>, target_law_ids array<string>, deterministic_verdict string"
    data = [(1, 0, "В статью 61 добавляется абзац: согласие не требуется", "q0", "normative", [], [], None), (1, 1, "61-бап келісімі талап етілмейді толық мәтін ұзағырақ нұсқасы болып табылады", "q1", "normative", [], [], None), (1, 2, "другой текст", "q2", "factual", ["94-V"], [], "x"), (1, 3, "другой текст длиннее", "q3", "factual", ["94 -V"], [], "x")]
    out = claims.dedup_claims(spark.createDataFrame(data, schema), ["d"])
    assert rows(out, "group_seq", "seq") == [(0, 1), (2, 3)]
    assert {r["seq"]: r["quote_variants"] for r in out.collect()} == {1: ["q0"], 3: ["q2"]}


def test_self_check(spark):
    text = "\nСтатья 79-1.\nв течение 10 дней\n\nСтатья 79-1.\nв течение 20 дней\n\nСтатья 80.\n5 суток и 5 часов"
    out = claims.deadline_collisions(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert rows(out, "article", "unit", "deadlines") == [("79-1", "дней", "10 vs 20")]


@pytest.mark.parametrize(("gap", "n"), [(1200, 0), (100, 1)])
def test_chronology(spark, gap, n):
    text = "Закон от 5 июня 2024 года принят." + "x" * gap + "Он вступает в силу с 1 января 2024 года."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    out = claims.chronology(claims.dates_of(docs, claims.ADOPTED), claims.dates_of(docs, claims.EFFECTIVE), "doc_id")
    assert out.count() == n


# --- corpus


def test_resolution(spark):
    registry = spark.createDataFrame([("235-V", "K1400000235", "Кодекс об административных правонарушениях"), ("226-V-UK", "K1400000226", "Уголовный кодекс"), ("261-IV", "Z100000261_", "Об исполнительном производстве и статусе судебных исполнителей")], "law_id string, code string, title string")
    asked = ["253-V", "235-v", "226-V", "z100000261", "233-IV", "Уголовный кодекс", "закон об исполнительном производстве и статусе судебных исполнителей", "исполнительном производстве и статусах судебных исполнителей", "совсем иное"]
    got = dict(rows(corpus.resolve_laws(spark.createDataFrame([(a,) for a in asked], "raw string"), registry), "raw", "law_id"))
    assert got == dict(zip(asked, ["253-V", "235-V", "226-V-UK", "261-IV", "261-IV", "226-V-UK", "261-IV", "261-IV", "совсем иное"], strict=True))


def test_upsert_adds_counts_and_keeps_texts(spark):
    schema = "law_id string, title string, n long, t int"
    old, new = spark.createDataFrame([("a", "old", 2, 1), ("b", "b", 1, 1)], schema), spark.createDataFrame([("a", "", 3, 2), ("c", "c", 1, 2)], schema)
    assert rows(corpus.upsert_registry(old, new, "law_id", ["title"], "n", "t"), "law_id", "title", "n", "t") == [("a", "old", 5, 2), ("b", "b", 1, 1), ("c", "c", 1, 2)]


def test_injection(spark):
    chunks = spark.createDataFrame([("1", "94-V", "5"), ("2", "94-V", "6"), ("3", "233-IV", "5")], "id string, law_id string, article string")
    asked = spark.createDataFrame([(["94-V"], "5"), (["261-IV"], "5"), (["94-V"], None)], "laws array<string>, article string")
    assert rows(corpus.inject_claim_driven(asked, chunks, chunks.where("id = '1'")), "id") == [("3",)]


def test_cache(spark):
    now = F.lit("2024-01-01 00:00:00").cast("timestamp")
    empty = spark.createDataFrame([], "key string, seq int, value string, expires_at timestamp")
    cache = corpus.cache_put(empty, spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, seq int, value string"), now, 60)
    assert rows(corpus.cache_live(cache, now), "key", "value") == [("k", "b")]
    assert corpus.cache_live(cache, F.lit("2024-01-01 00:01:01").cast("timestamp")).count() == 0
    assert rows(corpus.cache_misses(spark.createDataFrame([("k",), ("x",), ("x",)], "key string"), cache, now), "key") == [("x",)]


# --- sources


def test_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Закон о данных".encode("cp1251"))
    body = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Первый</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "c.docx").write_bytes(io.BytesIO(b"not a zip").getvalue())
    (tmp_path / "d.md").write_text("x")
    out = {r["path"].rsplit("/", 1)[1]: r for r in ingest.read_documents(spark, str(tmp_path)).collect()}
    assert out["a.txt"]["raw_text"] == "Закон о данных" and out["a.txt"]["language"] == "ru" and out["a.txt"]["word_count"] == 3
    assert out["b.docx"]["raw_text"] == "Первый\na | b"
    assert out["c.docx"]["raw_text"] is None and "BadZipFile" in out["c.docx"]["error"]
    assert out["d.md"]["error"] == "unsupported format"


def test_html_articles(spark):
    html = "<h1>Закон</h1><script>var t='</p>'</script><p>до</p><p><b>Статья 1. Общие</b></p><p>текст один<p>текст два</p><p>Статья 2 не заголовок</p><p><b>Статья 3. Иные</b></p><p>тело</p>"
    blocks = ingest.html_paragraphs(spark.createDataFrame([(1, html)], "page_id long, html string"))
    assert rows(ingest.html_articles(blocks), "article", "heading", "body") == [("1", "Общие", "текст один\nтекст два\nСтатья 2 не заголовок"), ("3", "Иные", "тело")]


def test_chunks(spark):
    long = "\n".join(f"{k}. " + "текст " * 100 for k in range(1, 31))
    docs = spark.createDataFrame([(10, long), (12, "абвгд " * 1000), (3, "коротко")], "doc_id long, text string")
    out = ingest.adaptive_chunks(docs).collect()
    assert all(len(r["content"]) <= 4000 + 201 for r in out)
    assert [r["chunk_name"] for r in out if r["doc_id"] == 3] == ["3"]
    assert {r["chunk_name"].split("_")[0] for r in out} == {"10", "12", "3"} and sum(r["doc_id"] == 10 for r in out) > 3
    short = ingest.sliding_chunks(docs.where("doc_id = 12"), 4000, 200)
    assert sorted(len(r["content"]) for r in short.collect()) == [2200, 4000]


def test_split_articles(spark):
    docs = spark.createDataFrame([(1, "вводная\nСтатья 1. Первая\nтело\nСтатья 2-1. Вторая\nещё")], "doc_id long, text string")
    assert rows(ingest.split_articles(docs), "article", "content") == [("1", "Первая\nтело"), ("2-1", "Вторая\nещё")]


# --- events and reports


def test_progress(spark):
    df = spark.createDataFrame([("j", 1, "s1"), ("j", 2, "s1"), ("j", 3, "s2")], "job string, t int, stage string")
    assert rows(ev.progress_fold(df, "job", "stage", ["t"]), "t", "event", "stage") == [(1, "stage_start", "s1"), (3, "stage_done", "s1"), (3, "stage_start", "s2")]


def test_rate_limit_ignores_rejected_hits(spark):
    base = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("ip", k, base + dt.timedelta(seconds=s)) for k, s in enumerate([0, 10, 20, 61, 62, 71])], "key string, n int, ts timestamp")
    out = ev.rate_limit(df, "key", "ts", "n", limit=2, window=60)
    assert rows(out, "n", "accepted") == [(0, True), (1, True), (2, False), (3, True), (4, False), (5, True)]
    assert {r["n"]: r["retry_after"] for r in out.collect()}[2] == 41


def test_event_stream(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = dt.datetime(2024, 1, 1)
    spark.createDataFrame([(k % 2, base + dt.timedelta(seconds=k)) for k in range(10)], "key long, ts timestamp").coalesce(1).write.parquet(src)
    hits = ev.rate_limit_stream(ev.read_events_stream(spark, src, "key long, ts timestamp"), "key", "ts", limit=3, window=60)
    q = hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 10 and got.where("accepted").count() == 6


def test_report(spark, tmp_path):
    summary = spark.createDataFrame([(1, 3, 1, 1, 1, 0.58, "Проверить"), (2, 0, 0, 0, 0, None, None)], "a int, total int, confirmed int, contradicted int, unverified int, reliability double, recommendation string")
    conflicts = spark.createDataFrame([(1, "conflict_0000", "FACTUAL", "текст")], "a int, record_id string, conflict_type string, claim_text string")
    facts = spark.createDataFrame([(1, "f2", "claim_0002", "Два (S1)", "HIGH"), (1, "f1", "claim_0001", "Один", "LOW"), (1, "f3", "claim_0003", "один", "LOW")], "a int, fact_id string, claim_id string, claim string, validation_status string")
    out = {r["a"]: r["markdown"] for r in report.render_report(summary, conflicts, facts, "a").collect()}
    assert "57% █████░░░░░" in out[1] and out[1].index("Один") < out[1].index("Два") and "(S1)" not in out[1] and "один" not in out[1]
    assert "N/A" in out[2] and "Конфликты" not in out[2]
    report.write_reports(report.render_report(summary, conflicts, facts, "a"), "a", str(tmp_path / "r"))
    assert len(spark.read.text(str(tmp_path / "r"), wholetext=True).collect()) == 2


def test_gate_and_mutation(spark):
    b = spark.createDataFrame([("a", 0.0), ("b", 0.0), ("c", 0.0)], "law_id string, rate double")
    f = spark.createDataFrame([("a", 0.0), ("b", 0.1), ("d", None)], "law_id string, rate double")
    out = evaluation.gate(b, f)
    assert rows(out, "law_id", "verdict") == [("a", "PASS"), ("b", "FAIL"), ("c", "SKIP"), ("d", "FAIL")]
    assert evaluation.gate_passes(out).first()[0] is False
    df = spark.createDataFrame([("235-V", "в статью 41 внести"), ("11-I", "без ссылки"), ("text", "ст. 99999")], "law string, t string")
    assert [r[0] for r in df.select(evaluation.mutate_law(F.col("law"))).collect()] == ["253-V", "12-I", None]
    assert [r[0] for r in df.select(evaluation.mutate_article(F.col("t"))).collect()] == ["в статью 99999 внести", None, None]


def test_golden_scores(spark):
    expected = spark.createDataFrame([("k", "i1", ["штраф"], "CONTRADICTED"), ("k", "i2", ["срок"], "CONTRADICTED")], "case string, issue_id string, keywords array<string>, status string")
    v = spark.createDataFrame([("k", 1, "Штраф 500", "CONTRADICTED"), ("k", 2, "срок", "UNVERIFIED"), ("k", 3, "иное", "CONTRADICTED")], "case string, seq int, text string, status string")
    r = evaluation.golden_scores(expected, v).first()
    assert (r["recall"], r["precision"], r["f1"]) == (0.5, 0.5, 0.5)


def test_report_listing(spark, tmp_path):
    (tmp_path / "a_20240102_030405.md").write_text("# A\n\nНадёжность: 40 %\n")
    (tmp_path / "b_20240202_030405.md").write_text("# B\n\nбез оценки")
    (tmp_path / "b_20240202_030405.json").write_text('{"reliability": 0.5, "total": 3}')
    out = ingest.list_reports(spark, str(tmp_path)).collect()
    assert [(r["report_id"][0], r["score"]) for r in out] == [("b", 0.5), ("a", 0.4)]


def test_jaccard_pairs_compare_few_sets_that_are_not_near(spark):
    import random

    r = random.Random(7)
    words = [f"word{i:04d}" for i in range(3000)]
    texts = [r.sample(words, r.choice([6, 40, 90, 300, 700])) for _ in range(240)]
    texts += [[w for w in t if r.random() < 0.85] for t in texts[:80]] + [t[: len(t) * 62 // 100] for t in texts[80:100]]
    sets = [set(t) for t in texts]
    want = {(i, j) for j in range(len(sets)) for i in range(j) if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    rows_ = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    assert set(rows(fusion.jaccard_pairs(rows_), "a", "b")) == want
    hashed = rows_.select("id", F.array_sort(F.transform(fusion.word_set(F.col("text")), lambda w: F.xxhash64(w))).alias("words"))
    met = set(rows(fusion._meet(fusion._postings(hashed, [], 0.6), 3, 0.6), "a", "b"))
    assert want <= met and len(met) < 1.2 * len(want)


def test_near_texts_dropped_makes_no_pairs_of_copies(spark, monkeypatch):
    import random

    r = random.Random(3)
    words = [f"word{i}" for i in range(40)]
    texts = [r.sample(words, 8) for _ in range(12)] + [words[:8]] * 60 + [words[:7], words[1:8], words[:6]]
    texts += [t[:7] + ["another"] for t in texts[:8]]
    r.shuffle(texts)
    sets, kept = [set(t) for t in texts], []
    for i, s in enumerate(sets):
        if not any(len(s & sets[k]) >= 0.6 * len(s | sets[k]) for k in kept):
            kept.append(i)
    asked = []
    monkeypatch.setattr(fusion, "greedy_keep", lambda pairs, f=fusion.greedy_keep: (asked.append(pairs.count()), f(pairs))[1])
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "id long, text string")
    assert rows(fusion.near_texts_dropped(df), "id") == [(i,) for i in range(len(texts)) if i not in kept]
    assert asked[0] < 200


def test_greedy_replay_of_a_chain_takes_few_rounds(spark, monkeypatch):
    import random

    r = random.Random(5)
    tables = []
    monkeypatch.setattr(fusion, "written", lambda df, name, f=fusion.written: (tables.append(name), f(df, name))[1])
    chain = [(i, i + 1) for i in range(40)]
    other = sorted({tuple(sorted(r.sample(range(100, 140), 2))) for _ in range(150)})
    rank = {i: r.randint(1, 5) for i in range(140) if i % 9}

    def plain(edges):
        gone = {}
        for a, b in sorted(edges):
            if a not in gone and b not in gone:
                weak, strong = (a, b) if rank.get(a, 99) > rank.get(b, 99) else (b, a)
                gone[weak] = strong
        return sorted(gone.items())

    pairs = spark.createDataFrame(chain + other, "a long, b long")
    ranks = spark.createDataFrame(sorted(rank.items()), "id long, legal_rank int")
    assert rows(fusion.greedy_losers(pairs, ranks), "id", "kept_id") == plain(chain + other)
    assert len(tables) <= 2
    assert rows(fusion.greedy_losers(pairs, ranks, most=60), "id", "kept_id") == plain(chain + other)
