"""Queries of the audit plan, of the registry's rules and of verdicts known from reference data, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import assess, audit, corpus, laws, search
from .catalogue import _bm25_sql, _tokens_sql, query, table

_CONTENT = "coalesce(text, '') || ' штраф ' || (doc_id % 7 + 1) || ' мрп'"
_FACTS_SQL = f"""ch AS (SELECT doc_id, upper(source) AS law, lang, doc_id % 7 = 0 AS web, {_CONTENT} AS content FROM documents),
  f0 AS (SELECT item_id, item_id % 4 AS kind, text, '[claim]: ' || text || ' штраф ' || (item_id % 5 + 1) || ' мрп' AS claim, CASE WHEN item_id % 3 <> 0 THEN 'SRC' || (item_id % 20) END AS law,
    CASE item_id % 5 WHEN 1 THEN 'en' WHEN 2 THEN 'fr' WHEN 3 THEN 'de' WHEN 4 THEN 'es' END AS art, (item_id % 10) / 10.0::DOUBLE AS confidence FROM benchmark),
  ex AS (SELECT item_id, doc_id FROM f0 JOIN ch ON ch.law = f0.law AND lang = art),
  f AS (SELECT *, CASE WHEN item_id IN (SELECT item_id FROM ex) THEN 'exact' WHEN kind < 2 THEN 'search' WHEN kind = 2 THEN 'virtual' ELSE 'linked' END AS branch FROM f0),
  pairs AS (SELECT item_id, doc_id FROM ex UNION ALL SELECT f.item_id, doc_id FROM f JOIN ch ON doc_id IN (item_id * 7, item_id * 3) WHERE branch = 'linked')"""


@query(f"""WITH {_FACTS_SQL}, {_bm25_sql("SELECT doc_id AS id, content AS text FROM ch", "SELECT 'f' || item_id AS query_id, CASE branch WHEN 'linked' THEN claim ELSE text END AS text FROM f UNION ALL SELECT 'self_' || doc_id, substr(content, 1, 200) FROM ch")},
  norm AS (SELECT CASE WHEN m < 0.001 THEN 1 ELSE m END AS norm FROM (SELECT median(greatest(coalesce(best, 0), 0)) AS m FROM (SELECT 'self_' || doc_id AS query_id FROM ch WHERE len({_tokens_sql('substr(content, 1, 200)')}) > 0) LEFT JOIN (SELECT query_id, max(score) AS best FROM scored GROUP BY query_id) USING (query_id))),
  s AS (SELECT substr(query_id, 2)::BIGINT AS item_id, id AS doc_id, score FROM scored WHERE query_id LIKE 'f%'),
  pr AS (SELECT pairs.item_id, least(1, greatest(0, max(coalesce(score, 0)) / any_value(norm))) AS score, bool_or(doc_id % 7 = pairs.item_id % 5) AS sums FROM norm, pairs LEFT JOIN s USING (item_id, doc_id) GROUP BY pairs.item_id),
  j AS (SELECT f.item_id, f.law AS named, art, ch.*, s.score AS raw, least(1, greatest(0, s.score / norm)) AS value FROM norm, f JOIN s USING (item_id) JOIN ch USING (doc_id) WHERE branch = 'search'),
  l AS (SELECT *, 1 AS layer FROM j WHERE named IS NOT NULL AND (law = named OR web) UNION ALL SELECT *, 3 FROM j),
  b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id, layer ORDER BY raw DESC, doc_id::VARCHAR) AS r FROM l) WHERE r = 1),
  o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY layer) AS n FROM b
    WHERE CASE WHEN layer = 3 THEN value >= 0.20 AND (art IS NULL OR coalesce(lang = art, false) OR regexp_matches(lower(content), '(^|[^\\p{{L}}\\p{{N}}_])' || art || '([^\\p{{L}}\\p{{N}}_]|$)')) ELSE value >= 0.12 END) WHERE n = 1),
  t AS (SELECT f.item_id, bool_or(f.law IS NULL OR ch.law IS NULL OR ch.law = f.law) AS topology FROM f JOIN ch ON doc_id IN (f.item_id * 7, f.item_id * 3) WHERE branch = 'linked' GROUP BY f.item_id),
  z AS (SELECT f.item_id, branch, CASE branch WHEN 'exact' THEN pr.score WHEN 'search' THEN coalesce(o.value, 0) WHEN 'virtual' THEN confidence ELSE CASE WHEN coalesce(topology, false) THEN coalesce(pr.score, 0) END END AS score,
    coalesce(sums, true) AS sums, o.doc_id AS found FROM f LEFT JOIN pr USING (item_id) LEFT JOIN o USING (item_id) LEFT JOIN t USING (item_id)),
  e AS (SELECT item_id, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id::VARCHAR) AS ids FROM ex GROUP BY item_id)
SELECT item_id, branch, round(score, 6) AS bm25_score, CASE WHEN branch = 'search' AND score < 0.20 OR score IS NULL THEN 'UNVERIFIED' WHEN branch = 'exact' AND NOT sums THEN 'LOW'
  WHEN (CASE WHEN branch = 'linked' AND NOT sums THEN score * 0.5::DOUBLE ELSE score END) >= 0.25 THEN 'HIGH' WHEN (CASE WHEN branch = 'linked' AND NOT sums THEN score * 0.5::DOUBLE ELSE score END) >= 0.12 THEN 'MEDIUM' ELSE 'LOW' END AS validation_status,
  CASE branch WHEN 'exact' THEN ids WHEN 'linked' THEN (item_id * 7) || ',' || (item_id * 3) WHEN 'virtual' THEN 'reference_data' ELSE coalesce(found::VARCHAR, CASE WHEN item_id % 4 = 0 THEN 'UNLINKED' ELSE '' END) END AS source_ids
FROM z LEFT JOIN e USING (item_id)""")
def fact_audit(spark, d):
    """VRD-06, VRD-07: benchmark items as claims with their facts, documents as the corpus (law = source, article = lang)."""
    doc, i = F.col("doc_id"), F.col("item_id")
    content = F.concat(F.coalesce("text", F.lit("")), F.lit(" штраф "), doc % 7 + 1, F.lit(" мрп"))
    chunks = table(spark, d, "documents").select(doc.cast("string").alias("id"), F.upper("source").alias("law"), F.col("lang").alias("article"), F.when(doc % 7 == 0, "TIER_2").alias("web_tier"), content.alias("content"))
    one = F.lit("a").alias("analysis")
    article = F.when(i % 5 == 1, "en").when(i % 5 == 2, "fr").when(i % 5 == 3, "de").when(i % 5 == 4, "es")
    none = F.array().cast("array<string>")
    asked = table(spark, d, "benchmark").select(one, i.alias("claim_id"), F.col("text").alias("claim_text"), F.lit("").alias("quote"), F.when(i % 3 != 0, F.array(F.concat(F.lit("SRC"), i % 20))).otherwise(none).alias("laws"), article.alias("article"))
    sources = F.when(i % 4 == 0, F.array(F.lit("UNLINKED"))).when(i % 4 == 1, none).when(i % 4 == 2, F.array(F.lit("reference_data"))).otherwise(F.array((i * 7).cast("string"), (i * 3).cast("string")))
    claim = F.concat(F.lit("[claim]: "), "text", F.lit(" штраф "), i % 5 + 1, F.lit(" мрп"))
    facts = table(spark, d, "benchmark").select(one, i.alias("fact_id"), i.alias("claim_id"), claim.alias("claim"), sources.alias("source_ids"), (i % 10 / 10.0).alias("confidence"))
    out = assess.audit_facts(facts, asked, chunks)
    return out.select(F.col("fact_id").alias("item_id"), "branch", F.round("bm25_score", 6).alias("bm25_score"), "validation_status", F.array_join("source_ids", ",").alias("source_ids"))


@query(f"""WITH {_bm25_sql("SELECT doc_id AS id, text FROM documents", "SELECT doc_id AS query_id, substr(text, 1, 200) AS text FROM documents")}, h AS (SELECT doc_id AS query_id FROM documents WHERE len({_tokens_sql('substr(text, 1, 200)')}) > 0)
SELECT query_id AS doc_id, round(greatest(coalesce(best, 0), 0), 6) AS best FROM h LEFT JOIN (SELECT query_id, max(score) AS best FROM scored GROUP BY query_id) USING (query_id)""")
def head_scores(spark, d):
    """RNK-02 before its median: the best score of every document's head over the whole corpus, by bounds in shards."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("query_id"), "text")
    heads = docs.select("query_id", F.substring("text", 1, 200).alias("text")).where(F.size(T.tokens(F.col("text"))) > 0)
    found = search.head_bests(search.build_index(docs, id_col="query_id"), heads)
    return found.select(F.col("query_id").alias("doc_id"), F.round(F.greatest("best", F.lit(0.0)), 6).alias("best"))


def _parts(spark, d) -> DataFrame:
    """Part names as titles: a registry of every third one, asked for as they are, cut, and with other words."""
    return table(spark, d, "part").select("p_partkey", F.lower("p_name").alias("name"))


@query("""WITH n AS (SELECT p_partkey, lower(p_name) AS name FROM part), reg AS (SELECT min(p_partkey) AS law, name AS title FROM n WHERE p_partkey % 3 = 0 GROUP BY name),
  q AS (SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN name WHEN 1 THEN name || ' extra' WHEN 2 THEN substr(name, 2, 12) ELSE 'zzzz qqqq ' || p_partkey END AS raw FROM n WHERE p_partkey % 3 = 0),
  h AS (SELECT raw, min({'step': CASE WHEN trim(raw) = title THEN 6 ELSE 7 END, 'law': 'LAW ' || lpad(law::VARCHAR, 9, '0')}) AS m FROM q JOIN reg ON contains(trim(raw), title) OR contains(title, trim(raw)) GROUP BY raw)
SELECT trim(q.raw) AS raw, coalesce(m.law, trim(q.raw)) AS law_id FROM q LEFT JOIN h USING (raw)""")
def title_resolution(spark, d):
    """SCA-17, titles: exact, parts of either side, and names that nothing is near to."""
    rows = _parts(spark, d).where("p_partkey % 3 = 0")
    i = F.col("p_partkey")
    named = F.concat(F.lit("LAW "), F.lpad(i.cast("string"), 9, "0"))
    registry = rows.groupBy(F.col("name").alias("title")).agg(F.min(named).alias("law_id")).select("law_id", F.lit(None).cast("string").alias("code"), "title")
    raw = F.when(i % 4 == 0, F.col("name")).when(i % 4 == 1, F.concat("name", F.lit(" extra"))).when(i % 4 == 2, F.substring("name", 2, 12)).otherwise(F.concat(F.lit("zzzz qqqq "), i))
    return corpus.resolve_laws(rows.select(raw.alias("raw")), registry).select("raw", "law_id")


@query("""WITH c AS (SELECT item_id, CASE item_id % 6 WHEN 0 THEN 'Z' || lpad(item_id::VARCHAR, 9, '0') WHEN 1 THEN 'k' || lpad((item_id % 20)::VARCHAR, 9, '0') WHEN 2 THEN '12-V' WHEN 3 THEN 'штраф' END AS e, item_id % 6 = 4 AS target FROM benchmark)
SELECT item_id, CASE WHEN target THEN 'TARGET-' || item_id WHEN item_id % 6 = 0 THEN e WHEN item_id % 6 = 1 THEN 'LAW-' || (item_id % 20) WHEN item_id % 6 = 2 THEN '12-V' ELSE '' END AS laws FROM c""")
def claim_registry_laws(spark, d):
    """SCA-13 with the registry: entities as unknown codes, known codes, ids, words, and target laws."""
    i = F.col("item_id")
    known = F.concat(F.lit("K"), F.lpad(F.col("id").cast("string"), 9, "0"))
    registry = spark.range(20).select(F.concat(F.lit("LAW-"), "id").alias("law_id"), known.alias("code"), F.concat(F.lit("заголовок "), "id").alias("title"))
    entity = F.when(i % 6 == 0, F.concat(F.lit("Z"), F.lpad(i.cast("string"), 9, "0"))).when(i % 6 == 1, F.concat(F.lit("k"), F.lpad((i % 20).cast("string"), 9, "0"))).when(i % 6 == 2, "12-V").when(i % 6 == 3, "штраф")
    none = F.array().cast("array<string>")
    asked = table(spark, d, "benchmark").select("item_id", F.col("text").alias("claim_text"), F.lit("").alias("quote"), F.array_compact(F.array(entity)).alias("entities"), F.when(i % 6 == 4, F.array(F.concat(F.lit("TARGET-"), i))).otherwise(none).alias("target_law_ids"))
    return laws.laws_of_claims(asked, registry, ["item_id"]).select("item_id", F.array_join("laws", ",").alias("laws"))


@query("""WITH c AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'CONTRADICTED' ELSE 'CONFIRMED' END END AS known FROM documents), l AS (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id)
SELECT doc_id, coalesce(known, CASE WHEN toxic = 1 THEN 'CONTRADICTED' ELSE 'CONFIRMED' END) AS status, known IS NOT NULL AS is_deterministic, CASE WHEN known IS NOT NULL THEN 'reference_data' ELSE 'S1' END AS source_ids,
  CASE WHEN known = 'CONTRADICTED' THEN 'not ' || doc_id END AS contradiction_detail FROM c LEFT JOIN l USING (doc_id) WHERE known IS NOT NULL OR toxic IS NOT NULL""")
def known_verdicts_first(spark, d):
    """VRD-02: every fifth document's verdict is known from reference data; labels are the answers of the others."""
    one, i = F.lit(1).alias("analysis"), F.col("doc_id")
    said = F.when(F.col("toxic") == 1, "CONTRADICTED").otherwise("CONFIRMED")
    answers = table(spark, d, "labels").where("toxic is not null").select(one, i.alias("seq"), F.to_json(F.struct(i.cast("string").alias("claim_id"), said.alias("status"), F.array(F.lit("S1")).alias("source_ids"))).alias("json"))
    known = i % 5 == 0
    asked = table(spark, d, "documents").select(one, i.cast("string").alias("claim_id"), F.lit("low").alias("severity"), F.when(known, F.concat(F.lit("not "), i)).alias("deterministic_verdict"), F.when(known & (i % 2 == 0), "CONTRADICTED").when(known, "CONFIRMED").alias("deterministic_status"), F.array().cast("array<string>").alias("entities"))
    out = audit.parse_verdicts(answers, asked, ["analysis"])
    return out.select(F.col("claim_id").cast("long").alias("doc_id"), "status", "is_deterministic", F.array_join("source_ids", ",").alias("source_ids"), "contradiction_detail")
