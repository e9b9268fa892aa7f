"""Queries of text rules, repairs and rates that are functions of a row, each with made inputs before or after whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, claims, evaluation, fusion, texts
from ..sources import ingest
from .catalogue import _STOP, query, table

_BROKEN = "\nС т а т ь я  п е р в а я\nобычная строка текста\nа б\n12-\n5 и 124\n-бап"


@query(r"""WITH t AS (SELECT doc_id, coalesce(text, '') || chr(10) || 'С т а т ь я  п е р в а я' || chr(10) || 'обычная строка текста' || chr(10) || 'а б' || chr(10) || '12-' || chr(10) || '5 и 124' || chr(10) || '-бап' AS t FROM documents),
l AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda x: CASE WHEN len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')) > 2 AND len(list_filter(string_split_regex(x, '\s+'), lambda w: length(w) = 1)) > 0.4 * len(list_filter(string_split_regex(x, '\s+'), lambda w: w <> ''))
  THEN array_to_string(list_transform(string_split_regex(trim(x), '\s{2,}'), lambda g: CASE WHEN len(list_filter(string_split_regex(trim(g), '\s+'), lambda w: length(w) = 1)) > 0.5 * len(string_split_regex(trim(g), '\s+')) THEN array_to_string(string_split_regex(trim(g), '\s+'), '') ELSE g END), ' ') ELSE x END) AS ls FROM t)
SELECT doc_id, md5(regexp_replace(regexp_replace(array_to_string(ls, chr(10)), '(\d+)-\s*\n\s*(\d+)', '\1-\2', 'g'), '(?i)(\d+)\s*\n\s*-(бап)', '\1-\2', 'g')) AS text_md5 FROM l""")
def text_repairs(spark, d):
    """SCA-04, SCA-05: spaced letters and numbers broken over lines, behind whole texts."""
    broken = F.concat(F.coalesce("text", F.lit("")), F.lit(_BROKEN))
    return table(spark, d, "documents").select("doc_id", F.md5(T.repair_breaks(T.repair_spacing(broken)).cast("binary")).alias("text_md5"))


@query("""WITH k AS (SELECT doc_id, doc_id % 6 AS k, (doc_id % 900)::VARCHAR AS n FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE k WHEN 0 THEN n || '-1' WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN n WHEN 4 THEN n END AS article, CASE k WHEN 0 THEN 1.5::DOUBLE WHEN 1 THEN -3.0::DOUBLE WHEN 4 THEN n::DOUBLE END AS number,
  CASE WHEN k < 3 THEN [2000 + doc_id % 30, 2005 + k] ELSE [] END::INT[]::VARCHAR AS years, CASE k WHEN 0 THEN '413-IV' WHEN 1 THEN '94-V' END AS core FROM k""")
def claim_parts(spark, d):
    """SCA-10, SCA-11, SCA-12, FN-12: articles in all word orders, numbers and what isn't one, years, law ids with and without tags."""
    k, n = F.col("doc_id") % 6, (F.col("doc_id") % 900).cast("string")
    bare = F.regexp_replace("text", r"\d", "")
    said = F.when(k == 0, F.concat(F.lit("в статье "), n, F.lit("-1 "))).when(k == 1, F.concat(F.lit("Ст. "), n, F.lit(" "))).when(k == 2, F.concat(n, F.lit("-бабының "))).when(k == 3, F.concat(F.lit("бап "), n, F.lit(" "))).when(k == 4, F.concat(F.lit("СТАТЬЮ "), n, F.lit(" "))).otherwise("ничего ")
    value = F.when(k == 0, "1.5").when(k == 1, "-3").when(k == 2, "10-20").when(k == 3, "1.2.3").when(k == 4, n).otherwise("x1")
    dated = F.concat(bare, F.when(k < 3, F.concat(F.lit(" в "), 2000 + F.col("doc_id") % 30, F.lit(" и "), 2005 + k, F.lit(" году, не в 1999 и 2031"))).otherwise(" 1999"))
    law = F.when(k == 0, "413-iv").when(k == 1, " 94-V-NEW ").when(k == 2, "94-Z").otherwise("закон")
    shown = F.concat(F.lit("["), F.array_join(T.years(dated), ", "), F.lit("]"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", T.article_of(F.concat(said, bare)).alias("article"), T.safe_number(value).alias("number"), shown.alias("years"), T.law_core(law).alias("core"))


@query(rf"""WITH t AS (SELECT doc_id, [{", ".join(f"'{keys[0]}'" for _, keys in claims.EVENTS)}][doc_id % {len(claims.EVENTS)} + 1] AS word, [{", ".join(f"'{name}'" for name, _ in claims.EVENTS)}][doc_id % {len(claims.EVENTS)} + 1] AS event, doc_id % 3 AS k,
  array_to_string(list_filter(string_split_regex(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~«»—–' || chr(160), ''), '\s+'), lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t)), ' ') AS normal FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE k WHEN 0 THEN 'art' || (doc_id % 900) || ':' || event WHEN 1 THEN event ELSE 'art' || (doc_id % 900) END AS semantic, md5(normal) AS normal_md5 FROM t""")
def claim_keys(spark, d):
    """SCA-15 with each event's word, an article, or both; SCA-16 over whole texts."""
    i = F.col("doc_id")
    word = F.element_at(F.array(*[F.lit(keys[0]) for _, keys in claims.EVENTS]), (i % len(claims.EVENTS) + 1).cast("int"))
    article = F.concat(F.lit("статья "), i % 900)
    said = F.when(i % 3 == 0, F.concat(article, F.lit(" "), word)).when(i % 3 == 1, word).otherwise(article)
    # a line's text in brackets doesn't count
    claim = F.concat(said, F.lit(" (строка: "), F.regexp_replace("text", r"[()]", ""), F.lit(")"))
    return table(spark, d, "documents").where("text is not null").select("doc_id", claims.semantic_key(claim, F.lit(None).cast("string")).alias("semantic"), F.md5(T.normalise_claim(F.col("text")).cast("binary")).alias("normal_md5"))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '{"a": [1, {"b": ' || doc_id || '}]}' WHEN 1 THEN '{"a": ' || doc_id || '}' WHEN 2 THEN '[{"x": ' || doc_id || '}]' WHEN 3 THEN '{"t": "}' || doc_id || '"}' END AS json FROM documents""")
def json_repairs(spark, d):
    """FN-11: answers cut short, fenced, with words around them, with brackets in strings, and none."""
    i = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 5
    cut = F.when(k == 0, F.concat(F.lit('{"a": [1, {"b": '), i, F.lit('}, {"c": "unfin'))).when(k == 1, F.concat(F.lit('```json\n{"a": '), i, F.lit("}\n```"))).when(k == 2, F.concat(F.lit('answer: [{"x": '), i, F.lit('}, {"x": ')))
    cut = cut.when(k == 3, F.concat(F.lit('{"t": "}'), i, F.lit('"}'))).otherwise("no json")
    return table(spark, d, "documents").select("doc_id", ingest.repaired_json(cut).alias("json"))


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '\d', '', 'g') AS t FROM documents)
SELECT doc_id, k::INT AS pos, CASE k WHEN 1 THEN '1' ELSE '2-1' END AS article, md5(substr(CASE k WHEN 1 THEN trim(t) ELSE trim('Общие ' || t) END, 1, 3000)) AS content_md5 FROM t, (SELECT unnest([1, 2]) AS k)""")
def split_articles(spark, d):
    """SRC-10: two articles with the whole text as body, cut at 3000 characters, which is the rule; what comes before the first goes."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"\d", "")
    made = F.concat(F.lit("Введение\n Статья 1. "), bare, F.lit("\nСтатья 2-1 Общие "), bare)
    out = ingest.split_articles(table(spark, d, "documents").select("doc_id", made.alias("text")))
    return out.select("doc_id", F.col("pos").cast("int").alias("pos"), "article", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""WITH w AS (SELECT page_id, url, html AS content, page_id % 7 AS q, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS priority FROM pages WHERE page_id % 5 <> 0), k AS (SELECT * FROM w WHERE length(content) >= 50),
  b AS (SELECT *, min(priority) OVER (PARTITION BY q) AS best FROM k WHERE q % 2 = 0 OR priority = 1) SELECT page_id, q, priority::INT AS priority FROM b WHERE priority = best""")
def web_results(spark, d):
    """SRC-14, SRC-15: pages as results of two providers; the first with rows wins a query."""
    i = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("https://site.example/"), i)).alias("url"), F.col("html").alias("content"), (i % 7).alias("q"), F.when(i % 3 == 0, 1).otherwise(0).alias("priority"))
    chunks = ingest.web_chunks(rows).where("q % 2 = 0 or priority = 1")
    return ingest.first_non_empty(chunks, "q", "priority").select("page_id", "q", "priority")


@query("""SELECT user_id, round(avg(value), 6) AS reliability FROM events GROUP BY user_id""")
def mean_reliability(spark, d):
    """AGG-08: events as facts without verdicts."""
    rows = table(spark, d, "events").select("user_id", F.col("value").alias("bm25_score"))
    return audit.mean_score(rows, ["user_id"]).select("user_id", F.round("reliability", 6).alias("reliability"))


@query("""WITH c AS (SELECT user_id, event_id % 4 <> 0 AS planted, event_type = 'purchase' AS confirmed FROM events), a AS (SELECT user_id, count(*) FILTER (WHERE planted) AS planted_total, count(*) FILTER (WHERE planted AND confirmed) AS planted_confirmed, count(*) FILTER (WHERE NOT planted) AS true_total, count(*) FILTER (WHERE NOT planted AND confirmed) AS true_confirmed FROM c GROUP BY user_id)
SELECT *, CASE WHEN planted_total > 0 THEN round(planted_confirmed / planted_total, 3) ELSE 0 END::DOUBLE AS false_confirm_rate, CASE WHEN true_total > 0 THEN round(true_confirmed / true_total, 3) ELSE 0 END::DOUBLE AS true_confirm_rate FROM a""")
def verdict_rates(spark, d):
    """AGG-16: users as laws, events as planted and true cases."""
    cases = table(spark, d, "events").select("user_id", F.when(F.col("event_id") % 4 != 0, "planted").otherwise("true").alias("kind"), F.when(F.col("event_type") == "purchase", "CONFIRMED").otherwise("UNVERIFIED").alias("status"))
    return evaluation.verdict_rates(cases, ["user_id"])


@query("""WITH i AS (SELECT item_id % 4 AS g, item_id, 'ключ' || (item_id % 9) AS word, CASE WHEN item_id % 2 = 0 THEN 'CONTRADICTED' ELSE 'CONFIRMED' END AS want FROM benchmark),
  v AS (SELECT doc_id % 4 AS g, doc_id AS seq, 'Ключ' || (doc_id % 13) || ' конец' AS t, CASE WHEN doc_id % 3 = 0 THEN 'CONTRADICTED' ELSE 'CONFIRMED' END AS status FROM documents),
  p AS (SELECT i.g, item_id, seq, status = want AS hit, row_number() OVER (PARTITION BY item_id ORDER BY seq) AS r FROM i JOIN v ON i.g = v.g AND contains(lower(t), word)), f AS (SELECT * FROM p WHERE r = 1),
  a AS (SELECT i.g, count(*) AS issues, count(*) FILTER (WHERE hit) AS tp FROM i LEFT JOIN f USING (item_id) GROUP BY i.g), x AS (SELECT g, count(*) AS fp FROM v WHERE status = 'CONTRADICTED' AND seq NOT IN (SELECT seq FROM f WHERE hit) GROUP BY g),
  r AS (SELECT a.g, tp / issues AS recall, CASE WHEN tp + coalesce(fp, 0) > 0 THEN tp / (tp + coalesce(fp, 0)) ELSE 0 END AS prec FROM a LEFT JOIN x USING (g))
SELECT g AS bill, round(recall, 6) AS recall, round(prec, 6) AS precision, round(CASE WHEN recall + prec > 0 THEN 2 * recall * prec / (recall + prec) ELSE 0 END, 6) AS f1 FROM r""")
def golden_evaluation(spark, d):
    """AGG-17: four bills, benchmark items as issues with a keyword, documents as verdicts in order."""
    i, j = F.col("item_id"), F.col("doc_id")
    issues = table(spark, d, "benchmark").select((i % 4).alias("case"), i.alias("issue_id"), F.array(F.concat(F.lit("ключ"), i % 9)).alias("keywords"), F.when(i % 2 == 0, "CONTRADICTED").otherwise("CONFIRMED").alias("status"))
    said = table(spark, d, "documents").select((j % 4).alias("case"), j.alias("seq"), F.concat(F.lit("Ключ"), j % 13, F.lit(" конец")).alias("text"), F.when(j % 3 == 0, "CONTRADICTED").otherwise("CONFIRMED").alias("status"))
    out = evaluation.golden_scores(issues, said)
    return out.select(F.col("case").alias("bill"), *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


@query("""WITH v AS (SELECT doc_id, CASE toxic WHEN 1 THEN 'CONTRADICTED' WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'CONFIRMED' ELSE 'UNVERIFIED' END END AS s FROM (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id))
SELECT d.doc_id, md5(CASE WHEN s = 'CONTRADICTED' THEN '[' || d.doc_id || ']: документ=''' || text || ''' vs найдено=''f' || d.doc_id || '''' WHEN s = 'CONFIRMED' THEN '[' || d.doc_id || ']: ''' || CASE WHEN d.doc_id % 4 = 0 THEN text ELSE 'f' || d.doc_id END || '''' WHEN s IS NOT NULL THEN '[' || d.doc_id || ']: ''' || text || '''' ELSE 'as it was' END) AS claim_md5,
  CASE s WHEN 'CONTRADICTED' THEN 0.1 WHEN 'CONFIRMED' THEN 0.9 WHEN 'UNVERIFIED' THEN 0.4 ELSE 0.7 END::DOUBLE AS confidence, CASE WHEN s = 'UNVERIFIED' THEN 'UNLINKED' ELSE 'S1' END AS source_ids FROM documents d LEFT JOIN v USING (doc_id) WHERE text IS NOT NULL""")
def facts_after_verification(spark, d):
    """VRD-05: a fact for each document, labels as verdicts after the verifier."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").where("text is not null")
    facts = docs.select(F.lit(1).alias("analysis"), i.cast("string").alias("claim_id"), F.lit("as it was").alias("claim"), F.lit(0.7).alias("confidence"), F.array(F.lit("S1")).alias("source_ids"))
    known = table(spark, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null").join(docs.select("doc_id", "text"), "doc_id")
    found = F.when((F.col("toxic") == 0) & (i % 4 == 0), "").otherwise(F.concat(F.lit("f"), i))
    verdicts = known.select(F.lit(1).alias("analysis"), i.cast("string").alias("claim_id"), F.when(F.col("toxic") == 1, "CONTRADICTED").when(i % 2 == 0, "CONFIRMED").otherwise("UNVERIFIED").alias("status"), F.col("text").alias("document_value"), found.alias("found_value"))
    out = audit.resync_facts(facts, verdicts, ["analysis", "claim_id"])
    return out.select(F.col("claim_id").cast("long").alias("doc_id"), F.md5(F.col("claim").cast("binary")).alias("claim_md5"), "confidence", F.array_join("source_ids", ",").alias("source_ids"))


#: A line for each of the patterns of SCA-08 in order, N standing for a number: (line, tag, entity).
_LINES = (
    ("Закон РК от 1 мая № N-V", "law_id", "N-V"),
    ("смотри № N-IV", "law_id", "N-IV"),
    ("статьи N КоАП", "koap_article", "N"),
    ("ӘҚБтК N-бабы", "koap_article", "N-"),
    ("N-бабы туралы ӘҚБтК", "koap_article", "N-"),
    ("статьей N Уголовного кодекса", "uk_article", "N"),
    ("ҚК N-бабы", "uk_article", "N-"),
    ("N-бабы бойынша ҚК", "uk_article", "N-"),
    ("в статье N закона", "article_ref", "N"),
    ("N-бап талаптары", "article_ref", "N-"),
    ("Постановление Правительства РК № N", "pprkz_num", "N"),
    ("штраф N МРП", "fine_mrp", "N"),
    ("айлық есептік көрсеткіштің N еселенген мөлшерде", "fine_mrp", "N"),
    ("МРП составляет N 450 тенге", "mrp_value", "N450"),
    ("не позднее N часов", "hours_deadline", "N"),
    ("в течение N рабочих дней", "workdays_deadline", "N"),
    ("N жұмыс күні ішінде", "workdays_deadline", "N"),
    ("с 12 января 2024 года", "effective_date", "12 января 2024"),
    ("вводится в действие через десять дней после", "enforcement_date", "через десять дней после"),
    ("қолданысқа енгізіледі он күн өткен соң бастап", "enforcement_date", "он күн өткен соң бастап"),
    ("қолданысқа енгiзiледi он күн кейін", "enforcement_date", "он күн кейiн"),  # the Cyrillic letter becomes the Latin one
)


@query(f"""SELECT doc_id, [{", ".join(f"'{t}'" for _, t, _ in _LINES)}][doc_id % {len(_LINES)} + 1] AS tag, replace([{", ".join(f"'{e}'" for *_, e in _LINES)}][doc_id % {len(_LINES)} + 1], 'N', (10 + doc_id % 900)::VARCHAR) AS entity FROM documents""")
def claim_patterns(spark, d):
    """SCA-08: a line for each pattern before every text; the claims with the line's tag."""
    i = F.col("doc_id")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (i % len(_LINES) + 1).cast("int"))
    line = F.replace(pick([x for x, *_ in _LINES]), F.lit("N"), (10 + i % 900).cast("string"))
    docs = table(spark, d, "documents").select("doc_id", F.concat(line, F.lit("\n"), F.regexp_replace(F.coalesce("text", F.lit("")), r"\d", "")).alias("text"), pick([t for _, t, _ in _LINES]).alias("want"))
    found = claims.extract_claims(docs).join(docs.select("doc_id", "want"), "doc_id").where("tag = want")
    return found.select("doc_id", "tag", "entity").distinct()


@query("""WITH c AS (SELECT doc_id, source || ' ' || lang AS law, doc_id % 50 AS art, 1 + doc_id % 11 AS rank, CASE WHEN doc_id % 3 = 0 THEN doc_id % 5 END AS dt, doc_id % 7 = 0 AS web, 2000 + doc_id % 30 AS year, doc_id % 4 + 1 AS mrp, doc_id % 6 = 0 AS gap, doc_id // 20 % 5 AS base,
    row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS dup FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL), a AS (SELECT *, NOT web AND rank <= 7 AS norm, web AND gap AS practice FROM c WHERE NOT dup),
  p AS (SELECT a.doc_id, bool_or(abs(a.rank - b.rank) > 2) AS h, bool_or(coalesce(a.art = b.art AND a.dt <> b.dt, false) OR a.dt IS NULL AND b.dt IS NULL AND a.base <> b.base AND abs(a.year - b.year) > 2) AS t, bool_or(a.art = b.art AND a.mrp <> b.mrp) AS f, bool_or(a.norm AND b.practice OR b.norm AND a.practice) AS g
    FROM a JOIN a b ON a.law = b.law AND a.doc_id <> b.doc_id GROUP BY a.doc_id)
SELECT doc_id, dup AS is_duplicate, array_to_string(list_filter([CASE WHEN g THEN 'ENFORCEMENT_GAP' END, CASE WHEN f THEN 'FACTUAL' END, CASE WHEN h THEN 'HIERARCHY' END, CASE WHEN t THEN 'TEMPORAL' END], lambda x: x IS NOT NULL), ',') AS conflict_types FROM c LEFT JOIN p USING (doc_id)""")
def fused_conflicts(spark, d):
    """VRD-17: exact copies flagged first, then all four kinds of conflicts among the rest."""
    i = F.col("doc_id")
    docs = table(spark, d, "documents").where("text is not null and source is not null and lang is not null")
    content = F.concat(F.regexp_replace("text", r"\d", ""), F.lit(" "), 2000 + i % 30, F.lit(" год, штраф "), i % 4 + 1, F.lit(" мрп"), F.when(i % 6 == 0, " на практике").otherwise(""))
    flagged = fusion.flag_exact_duplicates(docs, T.content_id(F.col("text")), "doc_id")
    chunks = flagged.select(
        i.alias("id"), F.concat("source", F.lit(" "), "lang").alias("law_id"), (i % 50).alias("article"), (1 + i % 11).cast("int").alias("legal_rank"), F.when(i % 7 == 0, "TIER_2").alias("web_tier"),
        F.when(i % 3 == 0, F.date_add(F.lit("2020-01-01").cast("date"), (i % 5).cast("int"))).alias("effective_date"), F.concat(F.lit("http://x/"), F.floor(i / 20) % 5, F.lit("#"), i).alias("source_url"), content.alias("content"), "is_duplicate",
    )
    out = fusion.detect_conflicts(chunks)
    return out.select(F.col("id").alias("doc_id"), "is_duplicate", F.array_join(F.coalesce("conflict_types", F.array().cast("array<string>")), ",").alias("conflict_types"))


@query("""SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY CASE doc_id % 7 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 5 END, n_chars DESC, length(doc_id::VARCHAR), doc_id::VARCHAR) AS nth FROM documents""")
def listed_checks(spark, d):
    """SRT-07, SRT-09, SRT-12: documents of a source by state, size and key."""
    k = F.col("doc_id") % 7
    state = F.when(k == 0, "broken").when(k == 1, "stale").when(k == 2, "title_differs").when(k == 3, "missing").when(k == 4, "verified").otherwise("?")
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars", state.alias("state"), F.col("doc_id").cast("string").alias("key"))
    return texts.listed(rows, ["source"], "state", "n_chars", "key").select("doc_id", F.col("nth").cast("long").alias("nth"))


@query("""SELECT q, page_id FROM (SELECT page_id % 11 AS q, page_id, row_number() OVER (PARTITION BY page_id % 11 ORDER BY length(html) DESC, page_id) AS n FROM pages) WHERE n <= 5""")
def first_links(spark, d):
    """LIM-02, SRT-02: the first five of each query, which is the feature."""
    rows = table(spark, d, "pages").select((F.col("page_id") % 11).alias("q"), "page_id", F.length("html").alias("size"))
    return texts.first_n(rows, ["q"], [F.col("size").desc(), F.col("page_id")], 5).select("q", "page_id")
