"""Queries of the registry, answer and upkeep operators on the driver's tables, with their DuckDB equivalent.

Bindings: law = nation (id <key + 100>-IV or -V, code K and ten digits, title the name), bill = documents with a heading of
law references before the whole text, chunk = documents (law = source, article = lang), answers = JSON made of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import answers, audit, claims, corpus, laws, upkeep
from ..sources import ingest
from .catalogue import query, table

_ID = "(n_nationkey + 100) || CASE WHEN n_nationkey % 2 = 0 THEN '-IV' ELSE '-V' END"
_CODE = "CASE WHEN n_nationkey % 5 <> 4 THEN 'K' || lpad((n_nationkey + 100)::VARCHAR, 10, '0') || CASE WHEN n_nationkey % 3 = 0 THEN '_' ELSE '' END END"
_REG_SQL = f"reg AS (SELECT n_nationkey AS k, {_ID} AS law_id, {_CODE} AS code, CASE WHEN n_nationkey % 7 <> 6 THEN n_name END AS title_ru, CASE WHEN n_nationkey % 2 = 0 THEN 'kz ' || n_name END AS title_kz FROM nation)"


def _registry(spark, d) -> DataFrame:
    k = F.col("n_nationkey")
    code = F.concat(F.lit("K"), F.lpad((k + 100).cast("string"), 10, "0"), F.when(k % 3 == 0, "_").otherwise(""))
    return table(spark, d, "nation").select(
        k.alias("k"), F.concat((k + 100).cast("string"), F.when(k % 2 == 0, "-IV").otherwise("-V")).alias("law_id"), F.when(k % 5 != 4, code).alias("code"),
        F.when(k % 7 != 6, F.col("n_name")).alias("title_ru"), F.when(k % 2 == 0, F.concat(F.lit("kz "), "n_name")).alias("title_kz"),
    )


@query(f"""WITH {_REG_SQL} SELECT law_id, title_ru FROM reg UNION ALL SELECT 'S-' || r_regionkey, r_name FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey % 7 <> 6 AND lower(n_name) = lower(r_name))
UNION ALL SELECT 'T-' || n_nationkey, upper(n_name) FROM nation WHERE n_nationkey % 7 = 6 AND n_nationkey % 2 = 1""")
def registry_load(spark, d):
    """SRC-21: static rows are regions, and nations again, of which those stored with a title go."""
    nation = table(spark, d, "nation")
    static = table(spark, d, "region").select(F.concat(F.lit("S-"), "r_regionkey").alias("law_id"), F.col("r_name").alias("title_ru"))
    static = static.unionByName(nation.select(F.concat(F.lit("T-"), "n_nationkey").alias("law_id"), F.upper("n_name").alias("title_ru")).where("not (cast(substring(law_id, 3) as int) % 7 = 6 and cast(substring(law_id, 3) as int) % 2 = 0)"))
    return laws.load_registry(_registry(spark, d), static).select("law_id", "title_ru")


@query(f"""WITH {_REG_SQL} SELECT law_id, coalesce(title_kz, title_ru, law_id) AS title, CASE WHEN code IS NULL THEN '' ELSE 'https://adilet.zan.kz/kaz/docs/' || code END AS url,
 array_to_string(list_sort(list_distinct(list_filter([law_id, upper(law_id), upper(trim(' ' || lower(law_id) || ' ')), code, rtrim(code, '_')], lambda x: x IS NOT NULL))), ',') AS variants FROM reg""")
def law_variants(spark, d):
    """SCA-18."""
    raw = F.concat(F.lit(" "), F.lower("law_id"), F.lit(" "))
    return _registry(spark, d).select("law_id", laws.title_of(F.col("title_ru"), F.col("title_kz"), F.col("law_id"), "kz").alias("title"), laws.law_url(F.col("code"), "kaz").alias("url"), F.array_join(laws.id_variants(F.col("law_id"), raw, F.col("code")), ",").alias("variants"))


@query(f"""WITH {_REG_SQL}, a AS (SELECT k, law_id, code FROM reg UNION ALL SELECT k + 100, 'Z' || lpad(k::VARCHAR, 9, '0') || CASE WHEN k % 2 = 0 THEN '_' ELSE '' END, NULL FROM reg UNION ALL SELECT k + 200, 'other ' || k, NULL FROM reg),
u AS (SELECT k, CASE WHEN code IS NOT NULL THEN (CASE WHEN suffix(code, '_') THEN [code, rtrim(code, '_')] ELSE [code] END) WHEN law_id LIKE 'Z%' THEN [law_id, CASE WHEN suffix(law_id, '_') THEN rtrim(law_id, '_') ELSE law_id || '_' END]
 WHEN regexp_matches(law_id, '^\\d+-[IVX]+$') THEN [] ELSE [law_id] END AS us FROM a) SELECT k, coalesce(array_to_string(list_transform(us, lambda x: 'https://adilet.zan.kz/rus/docs/' || x), ' '), '') AS urls FROM u""")
def law_urls(spark, d):
    """SRC-12: registry codes, codes as they are, short ids without a code, anything else."""
    reg = _registry(spark, d).select("k", "law_id", "code")
    none = F.lit(None).cast("string")
    other = reg.select((F.col("k") + 100).alias("k"), F.concat(F.lit("Z"), F.lpad(F.col("k").cast("string"), 9, "0"), F.when(F.col("k") % 2 == 0, "_").otherwise("")).alias("law_id"), none.alias("code"))
    rest = reg.select((F.col("k") + 200).alias("k"), F.concat(F.lit("other "), "k").alias("law_id"), none.alias("code"))
    return reg.unionByName(other).unionByName(rest).select("k", F.array_join(laws.candidate_urls(F.col("law_id"), F.col("code")), " ").alias("urls"))


def _bills(spark, d) -> DataFrame:
    key = F.col("doc_id") % 30 + 100
    number = F.concat(key.cast("string"), F.when(key % 2 == 0, "-IV").otherwise("-V"))
    head = F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("О внесении изменений в Закон РК № "), number)).when(F.col("doc_id") % 3 == 1, F.lit("Земельный кодекс, о связи")).otherwise("без ссылок"), F.lit("\n"))
    return table(spark, d, "documents").select("doc_id", F.concat(head, F.coalesce("text", F.lit(""))).alias("text"))


@query("""SELECT doc_id, 0 AS nth, (doc_id % 30 + 100) || CASE WHEN doc_id % 2 = 0 THEN '-IV' ELSE '-V' END AS law_id FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 0, '442-II' FROM documents WHERE doc_id % 3 = 1 UNION ALL SELECT doc_id, 1, '567-II-NEW' FROM documents WHERE doc_id % 3 = 1""")
def target_laws(spark, d):
    """SCA-14 on headings before the whole texts."""
    return laws.target_laws(_bills(spark, d), _registry(spark, d))


@query("""SELECT doc_id, (doc_id % 30 + 100) || CASE WHEN doc_id % 2 = 0 THEN '-IV' ELSE '-V' END AS law_id FROM documents WHERE doc_id % 3 = 0""")
def law_references(spark, d):
    """SCA-19 on the same texts."""
    return laws.law_references(_bills(spark, d), _registry(spark, d))


@query("""SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '10-V,9-I' WHEN 1 THEN '12-IV' WHEN 2 THEN '235-V' WHEN 3 THEN '413-IV' ELSE '' END AS laws FROM documents""")
def claim_laws(spark, d):
    """SCA-13: target laws, entities, names, ids in the text, none; the texts hold no Cyrillic names of their own."""
    k = F.col("doc_id") % 5
    none = F.array().cast("array<string>")
    quote = F.when(k == 2, "по КоАП РК").when(k == 3, "№ 413-IV").otherwise("")
    found = laws.claim_laws(F.col("text"), quote, F.when(k == 1, F.array(F.lit("12 -IV ЗРК"))).otherwise(none), F.when(k == 0, F.array(F.lit("9-I"), F.lit("10-V"), F.lit("9-I"))).otherwise(none))
    return table(spark, d, "documents").select("doc_id", F.array_join(found, ",").alias("laws"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'K950001000_' WHEN 1 THEN '235-V' WHEN 2 THEN '94-V' WHEN 3 THEN '235-V' WHEN 4 THEN '12-II' ELSE 'UNKNOWN' END AS law_id FROM pages""")
def file_law_ids(spark, d):
    """SCA-24 on made paths; the pages' own text follows a heading."""
    k = F.col("page_id") % 6
    path = F.when(k == 0, "a/Конституция.docx").when(k == 1, "a/K1400000235 rus.pdf").when(k == 2, "a/закон 94-v.docx").when(k == 3, "k1400000235/текст.docx").otherwise("a/текст.docx")
    plain = F.regexp_replace("html", r"\d+-[IVXLCDivxlcd]+", " ")
    return table(spark, d, "pages").select("page_id", laws.file_law_id(path, F.concat(F.when(k == 4, "Закон № 12-II\n").otherwise("\n"), plain), {"K1400000235": "235-V"}).alias("law_id"))


@query(f"""WITH {_REG_SQL} SELECT doc_id, CASE WHEN title_ru IS NOT NULL THEN title_ru || ' | Ст. ' || lang ELSE 'own ' || doc_id END AS title, CASE WHEN code IS NOT NULL THEN 'https://adilet.zan.kz/rus/docs/' || code || '#' || lang ELSE 'u' || doc_id END AS link
 FROM documents JOIN reg ON doc_id % 25 = k""")
def source_captions(spark, d):
    """SCA-29."""
    rows = table(spark, d, "documents").withColumn("k", F.col("doc_id") % 25).join(_registry(spark, d), "k")
    title = laws.title_of(F.col("title_ru"), F.col("title_kz"), F.col("law_id"))
    return rows.select("doc_id", laws.source_title(F.col("law_id"), title, F.col("lang"), F.concat(F.lit("own "), "doc_id")).alias("title"), laws.source_link(F.col("code"), F.col("lang"), F.concat(F.lit("u"), "doc_id")).alias("link"))


@query(f"""WITH {_REG_SQL} SELECT law_id, code, CASE WHEN code IS NULL OR k % 4 = 0 OR title_ru IS NULL THEN 'broken' WHEN k % 4 = 1 THEN 'stale' WHEN k % 4 = 2 THEN 'title_differs' ELSE 'verified' END AS state FROM reg""")
def registry_verification(spark, d):
    """JOI-20: a static copy with other codes loses against the stored pairs."""
    reg = _registry(spark, d)
    k = F.col("k")
    pages = reg.where("code is not null").select("code", F.when(k % 4 == 0, 404).otherwise(200).alias("status"), F.when(k % 4 == 2, F.concat(F.lit("x"), "title_ru")).otherwise(F.upper("title_ru")).alias("title"), F.when(k % 4 == 1, "Утратил силу").otherwise("").alias("text"))
    static = reg.select("law_id", F.lit("Z1").alias("code"), "title_ru")
    return laws.verify_registry(reg, static, pages)


# --- answers ----------------------------------------------------------------------------------------------------------


@query("""WITH q AS (SELECT conv_id, turn, text, CASE turn % 3 WHEN 0 THEN 'ru' WHEN 1 THEN 'kk' ELSE 'en' END AS language FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, language ORDER BY turn) - 1 AS nth FROM q) SELECT conv_id, language, nth, text AS query_text, CASE WHEN turn % 2 = 0 THEN 'a.kz,b.kz' ELSE '' END AS domains,
 CASE WHEN turn % 4 = 0 THEN 10 ELSE turn END AS max_results FROM n WHERE text <> '' AND turn % 5 <> 4""")
def plan_web_queries(spark, d):
    """VRD-16, SET-08: a plan a conversation; a turn of five is no object."""
    c = table(spark, d, "conversations")
    turn = F.col("turn")
    domains = F.when(turn % 2 == 0, F.array(F.lit("a.kz"), F.lit(""), F.lit("b.kz")))
    item = F.when(turn % 5 == 4, F.lit('"no object"')).otherwise(F.to_json(F.struct(F.col("text").alias("query_text"), domains.alias("include_domains"), F.when(turn % 4 != 0, turn).alias("max_results"))))
    listed = c.groupBy("conv_id", F.concat(F.lit("web_queries_"), F.when(turn % 3 == 0, "ru").when(turn % 3 == 1, "kk").otherwise("en")).alias("name")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", item.alias("i")))), lambda x: x["i"]), ",").alias("items"))
    raw = listed.groupBy("conv_id").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(F.concat(F.lit('"'), "name", F.lit('":['), "items", F.lit("]"))), ","), F.lit("}")).alias("json"))
    return answers.plan_queries(raw, ["conv_id"]).select("conv_id", "language", F.col("nth").cast("long").alias("nth"), "query_text", F.array_join("include_domains", ",").alias("domains"), F.col("max_results").cast("long").alias("max_results"))


@query("""SELECT item_id, 'см. ' || (item_id % 25 + 100) || CASE WHEN (item_id % 25) % 2 = 0 THEN '-IV' ELSE '-V' END || ' и 261-IV' AS query_text, (item_id % 25 + 100) || CASE WHEN (item_id % 25) % 2 = 0 THEN '-IV' ELSE '-V' END || ',261-IV' AS law_ids,
 CASE WHEN item_id % 2 = 0 THEN '2024-02-0' || (1 + item_id % 9) END AS date_from FROM benchmark""")
def plan_law_queries(spark, d):
    """VRD-16, SCA-35, FN-01: lower-case and renumbered ids are put right, dates that aren't dates are null."""
    k = F.col("item_id") % 25
    law = F.concat((k + 100).cast("string"), F.when(k % 2 == 0, "-iv").otherwise("-v"))
    date = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("2024-02-0"), 1 + F.col("item_id") % 9)).otherwise("soon")
    body = F.to_json(F.struct(F.array(F.struct(F.concat(F.lit("см. "), law, F.lit(" и 233-IV")).alias("query_text"), F.array(law, F.lit("233-IV"), F.lit("261-IV")).alias("law_ids"), date.alias("date_from"))).alias("adilet_queries")))
    raw = table(spark, d, "benchmark").select("item_id", body.alias("json"))
    reg = _registry(spark, d).select("law_id", "code", F.col("title_ru").alias("title"))
    return answers.plan_law_queries(raw, reg, ["item_id"]).select("item_id", "query_text", F.array_join("law_ids", ",").alias("law_ids"), F.col("date_from").cast("string").alias("date_from"))


@query("""WITH a AS (SELECT conv_id, turn, text, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE turn % 4 <> 3 AND text <> '' AND NOT (turn % 4 = 1 AND length(text) <= 10))
SELECT conv_id, 'claim_' || lpad((r - 1)::VARCHAR, 4, '0') AS claim_id, text AS claim_text, CASE WHEN turn % 4 = 1 THEN '' ELSE substr(text, 1, 200) END AS quote, CASE WHEN turn % 4 = 0 THEN 'temporal' ELSE 'factual' END AS claim_type, CASE WHEN turn % 4 = 0 THEN 'high' ELSE 'medium' END AS severity FROM a""")
def claim_answers(spark, d):
    """LLM-06: one answer a turn; bare strings, defaults, an unknown severity."""
    turn = F.col("turn")
    full = F.to_json(F.struct(F.struct(F.array(F.struct(F.col("text").alias("claim_text"), F.col("text").alias("quote"), F.lit("temporal").alias("claim_type"), F.lit("high").alias("severity"))).alias("claims")).alias("x")))
    bare = F.to_json(F.array(F.col("text")))
    plain = F.to_json(F.array(F.struct(F.col("text").alias("claim_text"), F.col("text").alias("quote"))))
    bad = F.to_json(F.array(F.struct(F.col("text").alias("claim_text"), F.lit("grave").alias("severity"))))
    raw = table(spark, d, "conversations").select("conv_id", "turn", F.when(turn % 4 == 0, F.get_json_object(full, "$.x")).when(turn % 4 == 1, bare).when(turn % 4 == 2, plain).otherwise(bad).alias("json"))
    return answers.claim_rows(raw, ["conv_id"], "turn").select("conv_id", "claim_id", "claim_text", "quote", "claim_type", "severity")


@query("SELECT doc_id, md5(substr(text, 1, 8000)) AS input_md5 FROM documents")
def embedding_requests(spark, d):
    """LLM-10, SRT-14: batches of at most 50; every batch is full but the last of its range, checked here by a count."""
    out = answers.request_batches(table(spark, d, "documents"), "doc_id", "text")
    sizes = out.groupBy("batch").agg(F.count("*").alias("n"), F.max("index").alias("last")).where("n <= 50 and last = n - 1")
    return out.join(sizes, "batch", "left_semi").select("doc_id", F.md5(F.col("input").cast("binary")).alias("input_md5"))


@query("""SELECT 'm' || user_id AS model, count(*) AS calls, count(*) FILTER (WHERE event_type = 'view') AS parsed, count(*) FILTER (WHERE event_type = 'click') AS empty, count(*) FILTER (WHERE event_type = 'error') AS malformed, count(*) FILTER (WHERE event_type = 'purchase') AS fallback FROM events GROUP BY user_id""")
def answer_counters(spark, d):
    """AGG-20."""
    kind = F.col("event_type")
    state = F.when(kind == "view", "parsed").when(kind == "click", "empty").when(kind == "error", "malformed").when(kind == "purchase", "fallback").otherwise("other")
    return answers.answer_counters(table(spark, d, "events").select(F.concat(F.lit("m"), "user_id").alias("model"), state.alias("status")))


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_type FROM events) SELECT user_id, event_id, CASE WHEN event_id % 3 = 0 THEN 'delegation_gap' ELSE 'regulatory_hole' END AS gap_type, CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'не указано' END AS affected_domain FROM r WHERE event_id % 5 <> 0""")
def audit_findings(spark, d):
    """VRD-02: findings of answers; empty descriptions go, unknown types are holes."""
    e = F.col("event_id")
    body = F.to_json(F.struct(F.array(F.struct(F.when(e % 5 == 0, " ").otherwise("gap").alias("description"), F.when(e % 3 == 0, " Delegation_Gap").otherwise("error").alias("gap_type"), F.when(e % 2 == 0, F.col("event_type")).otherwise("").alias("affected_domain"))).alias("additional_findings")))
    return audit.parse_findings(table(spark, d, "events").select("user_id", "event_id", body.alias("json")), ["user_id", "event_id"]).select("user_id", "event_id", "gap_type", "affected_domain")


@query("""WITH v AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'CONTRADICTED' WHEN 'view' THEN 'CONFIRMED' ELSE 'UNVERIFIED' END AS s, event_type AS d, CASE WHEN event_id % 2 = 0 THEN user_id::VARCHAR END AS f FROM events)
SELECT 'fact_c' || event_id AS fact_id, '[c' || event_id || ']: ' || CASE s WHEN 'CONTRADICTED' THEN 'документ=''' || d || ''' vs найдено=''' || coalesce(f, 'None') || '''' WHEN 'CONFIRMED' THEN '''' || coalesce(f, d) || '''' ELSE '''' || d || '''' END AS claim,
CASE s WHEN 'CONTRADICTED' THEN 0.1 WHEN 'CONFIRMED' THEN 0.9 ELSE 0.4 END::DOUBLE AS confidence, CASE WHEN event_id % 3 = 0 THEN 'S1' ELSE 'UNLINKED' END AS source_ids FROM v""")
def verdict_facts(spark, d):
    """VRD-02: one fact a verdict."""
    e = table(spark, d, "events")
    state = F.when(F.col("event_type") == "error", "CONTRADICTED").when(F.col("event_type") == "view", "CONFIRMED").otherwise("UNVERIFIED")
    v = e.select(F.concat(F.lit("c"), "event_id").alias("claim_id"), state.alias("status"), F.col("event_type").alias("document_value"), F.when(F.col("event_id") % 2 == 0, F.col("user_id").cast("string")).alias("found_value"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("S1"))).otherwise(F.array().cast("array<string>")).alias("source_ids"))
    return audit.facts_of(v).select("fact_id", "claim", "confidence", F.array_join("source_ids", ",").alias("source_ids"))


# --- upkeep -----------------------------------------------------------------------------------------------------------


def _stored(spark, d) -> DataFrame:
    """Chunks as JSON; every ninth can't be read."""
    k = F.col("doc_id") % 25
    law = F.concat((k + 100).cast("string"), F.when(k % 2 == 0, "-IV").otherwise("-V"))
    body = F.to_json(F.struct(law.alias("law_id"), F.col("text").alias("content"), (1 + F.col("doc_id") % 11).cast("int").alias("legal_rank")))
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 9 == 8, "{bad").otherwise(body).alias("json"))


@query("""WITH i AS (SELECT DISTINCT o_custkey AS id FROM orders) SELECT i.id, CASE WHEN doc_id IS NULL OR doc_id % 9 = 8 THEN NULL WHEN doc_id % 25 IN (3, 8) THEN 2 WHEN doc_id % 25 = 5 THEN 3 ELSE 1 + doc_id % 11 END AS legal_rank, doc_id IS NULL OR doc_id % 9 = 8 AS failed,
md5(CASE WHEN doc_id % 9 = 8 THEN NULL ELSE text END) AS content_md5 FROM i LEFT JOIN documents ON doc_id = id""")
def chunk_lookup(spark, d):
    """SRC-05, SCA-20: ids of customers; two laws are codes and one the constitution by title."""
    k = F.col("k")
    reg = _registry(spark, d).withColumn("title_ru", F.when(k.isin(3, 8), "Налоговый кодекс").when(k == 5, "Конституция").otherwise(F.col("title_ru")))
    ids = table(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    return upkeep.get_chunks(ids, _stored(spark, d), reg).select("id", F.col("legal_rank").cast("long").alias("legal_rank"), "failed", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("SELECT doc_id AS id, md5(text) AS content_md5 FROM documents WHERE doc_id % 25 = 4 AND doc_id % 9 <> 8")
def law_chunk_scan(spark, d):
    """SRC-24, SQL-03, FN-10."""
    return upkeep.law_chunks(_stored(spark, d), "104-IV").select("id", F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query(f"""WITH {_REG_SQL} SELECT law_id, CASE WHEN k % 3 = 0 THEN 'new ' || k ELSE title_ru END AS title_ru, k % 3 = 0 AS refreshed FROM reg""")
def title_refresh(spark, d):
    """SNK-09, SQL-07: every third law gets a new title, others an empty one or their own."""
    reg = _registry(spark, d)
    fresh = reg.select("law_id", F.when(F.col("k") % 3 == 0, F.concat(F.lit("new "), "k")).when(F.col("k") % 3 == 1, "").otherwise(F.col("title_ru")).alias("title"))
    return upkeep.refresh_titles(reg, fresh).select("law_id", "title_ru", "refreshed")


@query("""WITH m AS (SELECT c_custkey AS k, c_custkey % 7 AS v FROM customer), l AS (SELECT o_custkey AS k, max(o_orderkey % 10) AS l FROM orders GROUP BY 1), s AS (SELECT m.k FROM m JOIN l USING (k) WHERE v = 0 OR l.l > v)
SELECT c_custkey AS law_id, 'old' AS state FROM customer WHERE c_custkey NOT IN (SELECT k FROM s) UNION ALL SELECT k, 'new' FROM s""")
def corpus_refresh(spark, d):
    """SRC-19: a law a customer, versions of orders; null versions are stale."""
    v = F.col("c_custkey") % 7
    manifest = table(spark, d, "customer").select(F.col("c_custkey").alias("law_id"), F.when(v != 0, v).alias("version"))
    latest = table(spark, d, "orders").select(F.col("o_custkey").alias("law_id"), (F.col("o_orderkey") % 10).alias("version"))
    stale = upkeep.stale_laws(manifest, latest)
    fresh = manifest.select("law_id", F.lit("new").alias("state"))
    return upkeep.replace_laws(manifest.select("law_id", F.lit("old").alias("state")), stale, fresh)


@query("SELECT doc_id AS id, embedding IS NULL AS missing FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def vectors_on_demand(spark, d):
    """JOI-22: stored vectors of documents, and the ids to compute."""
    stored = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    wanted = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"))
    found, missing = upkeep.vectors_for(wanted, stored, "seq")
    return found.where("vector is not null").select("id", F.lit(False).alias("missing")).unionByName(missing.select("id", F.lit(True).alias("missing")))


_BEST_SQL = "b AS (SELECT source, doc_id, lang, text FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY (lang = 'fr') DESC, CASE WHEN lang = 'fr' THEN 0 ELSE length(text) END DESC, doc_id) AS r FROM documents WHERE length(text) > 200 AND source <> 'src1' AND lang <> '' ) WHERE r = 1)"


@query(f"WITH {_BEST_SQL} SELECT source AS law_id, doc_id AS id, lang AS article FROM b")
def best_articles(spark, d):
    """RNK-11 with a preferred article."""
    chunks = table(spark, d, "documents").where("source <> 'src1'").select(F.col("source").alias("law_id"), F.col("doc_id").alias("id"), F.col("lang").alias("article"), F.col("text").alias("content"))
    return upkeep.best_article(chunks, "fr").select("law_id", "id", "article")


@query(f"""WITH {_BEST_SQL} SELECT source AS law_id, 'true_real_article' AS claim_id, md5(trim(substr(text, 1, 180), ' ' || chr(9) || chr(10) || chr(13))) AS text_md5, 'UNVERIFIED' AS expect_not FROM b
UNION ALL SELECT source, 'planted_new_article', md5('Кодекс ' || source || ' дополняется новой статьёй 889-1, вводящей цифровой реестр и алгоритмическое прекращение производства.'), 'CONFIRMED' FROM b
UNION ALL SELECT source, 'planted_absurd_article', md5('Статья 99999 закона ' || source || ' устанавливает обязательную биометрию для всех граждан.'), 'CONFIRMED' FROM b
UNION ALL SELECT source, 'planted_fabricated_fact', md5('Статья ' || lang || ' закона ' || source || ' вводит смертную казнь за административные правонарушения и конфискацию всего имущества.'), 'CONFIRMED' FROM b""")
def planted_cases(spark, d):
    """VRD-15 over the best articles."""
    chunks = table(spark, d, "documents").where("source <> 'src1'").select(F.col("source").alias("law_id"), F.col("doc_id").alias("id"), F.col("lang").alias("article"), F.col("text").alias("content"))
    out = upkeep.planted_cases(upkeep.best_article(chunks, "fr"), "889-1")
    return out.select("law_id", "claim_id", F.md5(F.col("claim_text").cast("binary")).alias("text_md5"), "expect_not")


@query("""SELECT count(*) AS files, count(*) FILTER (WHERE doc_id % 10 <> 0) AS ok, count(*) FILTER (WHERE doc_id % 10 <> 0 AND doc_id % 3 < 2) AS with_target, count(*) FILTER (WHERE doc_id % 10 <> 0 AND doc_id % 4 > 0) AS with_claims FROM documents""")
def smoke_summary(spark, d):
    """AGG-19."""
    rows = _bills(spark, d).select((F.col("doc_id") % 10 != 0).alias("ok"), laws.target_candidates(F.col("text")).alias("target_law_ids"), (F.col("doc_id") % 4).alias("regex_claims"))
    return upkeep.smoke_summary(rows)


@query("""SELECT p_partkey, row_number() OVER (ORDER BY p_size, p_partkey % 10, p_partkey) AS nth FROM part""")
def natural_order(spark, d):
    """SRT-11: article numbers <size>-<n> of all parts."""
    article = F.concat(F.col("p_size").cast("string"), F.lit("-"), (F.col("p_partkey") % 10).cast("string"))
    return upkeep.natural_order(table(spark, d, "part").select("p_partkey", "p_size"), article, "p_partkey").select("p_partkey", "nth")


@query("""SELECT doc_id, doc_id % 11 < 6 AS authoritative, doc_id % 11 <> 10 AND doc_id % 3 = 0 AS shown, doc_id % 4 <> 3 AND length(text) <= 2000 AS admitted FROM documents""")
def authority_and_admission(spark, d):
    """FLT-08, FLT-12: ranks 1 to 11, addresses, and files of the texts' length."""
    rank, k = 1 + F.col("doc_id") % 11, F.col("doc_id") % 4
    url = F.when(F.col("doc_id") % 3 == 0, "https://adilet.zan.kz/rus/docs/K1").otherwise("https://zakon.kz")
    name = F.when(k == 0, "a.PDF").when(k == 1, "b.docx").when(k == 2, "c.txt").otherwise("d.exe")
    return table(spark, d, "documents").select("doc_id", upkeep.is_authoritative(rank).alias("authoritative"), upkeep.is_render_authority(rank, url).alias("shown"), upkeep.admitted(name, F.length("text"), most=2000).alias("admitted"))


@query("""SELECT o_orderkey, CASE year(o_orderdate) + 30 WHEN 2022 THEN 3063 WHEN 2023 THEN 3450 WHEN 2024 THEN 3692 WHEN 2025 THEN 3932 WHEN 2026 THEN 4205 END::BIGINT AS mrp FROM orders""")
def monthly_index(spark, d):
    """SCA-38: the index of the order's year, moved by 30."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.year("o_orderdate") + 30).alias("y"))
    return upkeep.with_mrp(rows, "y").select("o_orderkey", F.col("mrp").cast("long").alias("mrp"))


# --- operators of the first catalogue under their own rules -------------------------------------------------------------


@query("""SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 2 ELSE 11 END AS legal_rank FROM documents""")
def rank_healing(spark, d):
    """SCA-20: constitution, code, offence code by its id, anything else as it was."""
    k = F.col("doc_id") % 4
    title = F.when(k == 0, "Конституция РК").when(k == 1, "Налоговый КОДЕКС").when(k == 2, "Об административных правонарушениях").otherwise("Закон о связи")
    return table(spark, d, "documents").select("doc_id", corpus.heal_rank(title, F.lit(11), F.when(k == 2, "235-V").otherwise("94-V")).cast("long").alias("legal_rank"))


@query("""WITH r AS (SELECT page_id, page_id % 8 AS k FROM pages) SELECT page_id, CASE k WHEN 0 THEN 11 WHEN 1 THEN 2 WHEN 2 THEN 6 WHEN 3 THEN 2 WHEN 4 THEN 4 WHEN 5 THEN 11 WHEN 6 THEN 7 ELSE 10 END AS legal_rank,
CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 1.0 WHEN 3 THEN 0.85 WHEN 4 THEN 0.65 ELSE 0.5 END::DOUBLE AS confidence FROM r""")
def rank_by_signals(spark, d):
    """SCA-21: blacklist, two prefixes, a code on an official page, a law elsewhere, an ethics code, the tiers' own ranks."""
    k = F.col("page_id") % 8
    pick = lambda *values: F.element_at(F.array(*[F.lit(v) for v in values]), (k + 1).cast("int"))
    tier = pick("BLACKLIST", "TIER_1", "TIER_1", "TIER_1", "TIER_3", "TIER_3", "TIER_1", "TIER_2")
    url = pick("https://forum.kz", "https://adilet.zan.kz/rus/docs/K1", "https://www.adilet.zan.kz/rus/docs/P2", "https://gov.kz/x", "https://x.kz", "https://x.kz", "https://gov.kz/y", "https://zakon.kz/docs/k1")
    title = pick("", "", "", "Налоговый кодекс", "Трудовой кодекс", "Этический кодекс", "", "")
    content = F.concat(F.when(k == 4, "о внесении изменений ").otherwise(""), F.regexp_replace("html", r"(?i)\bст\.\s*\d+", ""))
    out = corpus.rank_score(tier, title, content, url)
    return table(spark, d, "pages").select("page_id", out["rank"].cast("long").alias("legal_rank"), F.round(out["confidence"], 6).alias("confidence"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN '🔴' WHEN 'view' THEN '🟢' WHEN 'click' THEN CASE WHEN event_id % 3 = 0 OR event_id % 2 = 0 THEN '🟠' ELSE '⚫' END ELSE CASE event_id % 3 WHEN 0 THEN '🟢' WHEN 1 THEN '🟡' ELSE '⚫' END END AS icon FROM events""")
def fact_icons(spark, d):
    """VRD-13: the verdict's icon, else the fact's."""
    e, kind = F.col("event_id"), F.col("event_type")
    status = F.when(kind == "error", "CONTRADICTED").when(kind == "view", "CONFIRMED").when(kind == "click", "UNVERIFIED")
    validation = F.when(kind == "click", "UNVERIFIED").when(e % 3 == 0, "HIGH").when(e % 3 == 1, "MEDIUM").otherwise("UNVERIFIED")
    return table(spark, d, "events").select("event_id", audit.fact_icon(status, F.when(e % 3 == 0, "high").otherwise("low"), F.when(e % 2 == 0, "MEDIUM").otherwise("LOW"), validation).alias("icon"))


@query("""SELECT doc_id, 'koap_article' AS tag, (doc_id % 4 + 77)::VARCHAR AS entity, CASE WHEN doc_id % 4 = 2 THEN 'CONFIRMED' ELSE 'UNVERIFIED' END AS deterministic_status FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'pprkz_num', CASE WHEN doc_id % 2 = 0 THEN '142' ELSE '909' END, CASE WHEN doc_id % 2 = 0 THEN 'CONTRADICTED' END FROM documents WHERE doc_id % 3 = 1
UNION ALL SELECT doc_id, 'uk_article', '190-', NULL FROM documents WHERE doc_id % 3 = 2""")
def entity_checks(spark, d):
    """SCA-08, VRD-01: claims of a made line before the whole text, checked by decrees and a registry with one article."""
    k = F.col("doc_id") % 3
    head = F.when(k == 0, F.concat(F.lit("статья "), (F.col("doc_id") % 4 + 77).cast("string"), F.lit(" КоАП"))).when(k == 1, F.when(F.col("doc_id") % 2 == 0, "ППРК №142").otherwise("ППРК №909")).otherwise("ҚК 190-бабы")
    docs = table(spark, d, "documents").select("doc_id", F.concat(head, F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    known = spark.createDataFrame([("koap", "79"), ("uk", "147")], "code string, article string")
    out = claims.check_entities(claims.extract_claims(docs), docs, known)
    return out.where(F.col("tag").isin("koap_article", "pprkz_num", "uk_article")).select("doc_id", "tag", "entity", "deterministic_status")


@query(r"""WITH RECURSIVE s AS (SELECT doc_id, text, string_split_regex(regexp_replace(text, '\n(\d+[.)])', chr(1) || '\1', 'g'), chr(1)) AS ps FROM documents WHERE length(text) > 4000),
f AS (SELECT doc_id, ps, 1 AS i, trim(chr(10) || ps[1], ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) AS open, NULL::VARCHAR AS done FROM s WHERE len(ps) > 1
 UNION ALL SELECT doc_id, ps, i + 1, CASE WHEN open = '' OR length(open) + length(ps[i + 1]) <= 4000 THEN trim(open || chr(10) || ps[i + 1], ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) ELSE right(open, 200) || chr(10) || ps[i + 1] END,
 CASE WHEN open = '' OR length(open) + length(ps[i + 1]) <= 4000 THEN NULL ELSE open END FROM f WHERE i < len(ps)),
c AS (SELECT doc_id, i, done AS content FROM f WHERE done IS NOT NULL UNION ALL SELECT doc_id, i + 1, open FROM f WHERE i = len(ps) AND open <> ''),
w AS (SELECT doc_id, k AS i, substr(text, k * 3800 + 1, 4000) AS content FROM (SELECT doc_id, text, unnest(range(0, (length(text) - 1) // 3800 + 1)) AS k FROM s WHERE len(ps) = 1))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, md5(content) AS content_md5 FROM (SELECT * FROM c UNION ALL SELECT * FROM w) UNION ALL SELECT doc_id, 0, md5(text) FROM documents WHERE length(text) <= 4000""")
def adaptive_chunks(spark, d):
    """SCA-25: greedy packing of clauses, windows without clauses."""
    out = ingest.adaptive_chunks(table(spark, d, "documents"))
    return out.select("doc_id", F.col("k").cast("long").alias("k"), F.md5(F.col("content").cast("binary")).alias("content_md5"))


@query("""SELECT doc_id, doc_id % 4 = 0 OR doc_id % 4 = 3 AS is_structural FROM documents""")
def ordered_cascade(spark, d):
    """FLT-03, FLT-04: commencement, modal verb, amendment, a bare reference; a made line before the whole text."""
    k = F.col("doc_id") % 4
    head = F.when(k == 0, "вводится в действие ").when(k == 1, "оператор обязан ").when(k == 2, "дополнить словами ").otherwise("ст. 207 ")
    text = F.concat(head, F.regexp_replace(F.coalesce("text", F.lit("")), r"\d", ""))
    return table(spark, d, "documents").select("doc_id", claims.is_structural(text, F.lit("legal_ref"), F.lit(None).cast("string"), F.array().cast("array<string>")).alias("is_structural"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'TIER_1' WHEN 1 THEN 'TIER_1' WHEN 2 THEN 'TIER_2' WHEN 3 THEN 'TIER_3' WHEN 4 THEN 'BLACKLIST' ELSE 'TIER_3' END AS web_tier FROM pages""")
def web_tier_lists(spark, d):
    """SCA-22 with the real lists: a primary source, a sub-domain of one, an expert page, a known blog, a forum, an unknown page."""
    hosts = F.array(*[F.lit(h) for h in ("president.kz", "www.stat.gov.kz", "kursiv.kz", "kk.wikipedia.org", "x.forum.kz", "parlam.kz")])
    url = F.concat(F.lit("https://"), F.element_at(hosts, (F.col("page_id") % 6 + 1).cast("int")), F.lit("/"), F.regexp_replace("url", "(?i)forum|anon", ""))
    return table(spark, d, "pages").select("page_id", T.web_tier(url).alias("web_tier"))
