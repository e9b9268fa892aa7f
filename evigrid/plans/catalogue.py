"""Queries on the driver's tables: each operator with re-bound columns, over whole tables, with its DuckDB equivalent.

Bindings: chunk = documents (law_id = source, article = lang, rank = 1 + doc_id % 11), claim = benchmark, web row = pages,
verdict = events (analysis = user_id), vectors = embeddings. Thresholds that the synthetic vectors never reach are
parameters. Doubles are rounded before they are compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, claims, corpus, evaluation, fusion, report, search
from ..sources import ingest
from ..streaming import events as ev

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL of the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_STOP = "[" + ", ".join("'" + w + "'" for w in T.dims.STOP_WORDS) + "]"


def _tokens_sql(x: str) -> str:
    return rf"list_filter(string_split_regex(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}_\s\-]', ' ', 'g'), '\s+'), lambda t: length(t) >= 3 AND NOT list_contains({_STOP}, t))"


def _bm25_sql(corpus_sql: str, queries_sql: str) -> str:
    """CTEs ending in scored(query_id, id, score); corpus_sql gives (id, text), queries_sql (query_id, text)."""
    return f"""corpus AS ({corpus_sql}), asked AS ({queries_sql}),
  dt AS (SELECT id, {_tokens_sql('text')} AS ts FROM corpus), sizes AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM dt),
  p AS (SELECT id, len(ts) AS length, unnest(ts) AS term FROM dt), tf AS (SELECT id, term, any_value(length) AS length, count(*) AS tf FROM p GROUP BY id, term),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM df, sizes),
  idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
  q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({_tokens_sql('text')}) AS term FROM asked) GROUP BY query_id, term),
  scored AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * length / avgdl))), 9) AS score
             FROM q JOIN idf USING (term) JOIN tf USING (term), sizes GROUP BY query_id, id)"""


def _scored(corpus_df: DataFrame, queries_df: DataFrame) -> DataFrame:
    return search.score(search.build_index(corpus_df), queries_df).withColumn("score", F.round("score", 9))


# --- scans, scalars, tokenisers ---------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT doc_id, text, CASE WHEN regexp_matches(text, '(?i)[áéíóúüñğqw]|gh|zh|sh|ch|kh') THEN translate(
  replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,'Gh','Ғ'),'Zh','Ж'),'Sh','Ш'),'Ch','Ч'),'Kh','Қ'),'gh','ғ'),'zh','ж'),'sh','ш'),'ch','ч'),'kh','қ'),
  'áÁıIñÑóÓúÚ', 'әӘіІңҢөӨүҮ') ELSE text END AS n FROM documents)
SELECT doc_id, sha256(coalesce(nfc_normalize(n), '')) AS content_id, length(text) AS char_count, len(regexp_extract_all(text, '\S+')) AS word_count FROM t""")
def doc_normalise(spark, d):
    """SCA-01, SCA-03."""
    docs = table(spark, d, "documents")
    normal = T.nfc(T.transliterate(F.col("text")))
    return docs.select("doc_id", T.content_id(F.coalesce(normal, F.lit(""))).alias("content_id"), F.length("text").cast("long").alias("char_count"), T.word_count(F.col("text")).cast("long").alias("word_count"))


@query(rf"""WITH t AS (SELECT doc_id, text, substr(text, 1, 500) AS h, lower(substr(text, 1, 1000)) AS s FROM documents),
c AS (SELECT doc_id, text, s, len(regexp_extract_all(h, '[\x{{0400}}-\x{{04ff}}]')) AS cy, len(regexp_extract_all(h, '[a-zA-ZáñóúığşýÁÑÓÚĞŞÝ]')) AS la FROM t)
SELECT doc_id, CASE WHEN regexp_matches(substr(text, 1, 3000), '[әғқңөұүһіӘҒҚҢӨҰҮҺІ]') THEN 'kk' WHEN cy > 2 * la THEN 'ru'
WHEN la > 2 * cy THEN CASE WHEN regexp_matches(s, '[áñóúığşý]') OR list_has_any(string_split_regex(s, '\s+'), {list(T.dims.KAZAKH_LATIN_WORDS)}) THEN 'kk' ELSE 'en' END ELSE 'mixed' END AS language FROM c""")
def language_heuristic(spark, d):
    """SCA-02."""
    return table(spark, d, "documents").select("doc_id", T.language(F.col("text")).alias("language"))


@query(f"""SELECT doc_id, len(ts)::BIGINT AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM (SELECT doc_id, {_tokens_sql('text')} AS ts FROM documents)""")
def tokenize_simple(spark, d):
    """SCA-06."""
    rows = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("ts"))
    return rows.select("doc_id", F.size("ts").cast("long").alias("n_tokens"), F.md5(F.array_join("ts", " ").cast("binary")).alias("tokens_md5"))


_SUFFIXES = "[" + ", ".join(f"'{x}'" for x in T.dims.SUFFIXES) + "]"
_LEGAL_STOP = "[" + ", ".join(f"'{x}'" for x in T.dims.LEGAL_STOP_WORDS) + "]"


@query(rf"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(regexp_replace(lower(text || ' статья граждан законами белсенді ' || conv_id), '[^\p{{L}}\p{{N}}_\s\-]', ' ', 'g'), '\s+'), lambda t: length(t) >= 3) AS ws FROM conversations),
k AS (SELECT conv_id, turn, CASE WHEN len(list_filter(ws, lambda t: NOT list_contains({_LEGAL_STOP}, t))) > 0 THEN list_filter(ws, lambda t: NOT list_contains({_LEGAL_STOP}, t)) ELSE ws END AS ws FROM w),
s AS (SELECT conv_id, turn, list_transform(ws, lambda t: CASE WHEN length(t) <= 4 THEN t ELSE substr(t, 1, length(t) - coalesce(length(list_filter({_SUFFIXES}, lambda x: ends_with(t, x) AND length(t) - length(x) >= 3)[1]), 0)) END) AS ts FROM k)
SELECT conv_id, turn, len(ts)::BIGINT AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM s""")
def tokenize_morph(spark, d):
    """SCA-07 on conversations with some Russian and Kazakh words behind them."""
    text = F.concat("text", F.lit(" статья граждан законами белсенді "), "conv_id")
    rows = table(spark, d, "conversations").select("conv_id", "turn", T.morph_tokens(text).alias("ts"))
    return rows.select("conv_id", "turn", F.size("ts").cast("long").alias("n_tokens"), F.md5(F.array_join("ts", " ").cast("binary")).alias("tokens_md5"))


@query(r"""WITH x AS (SELECT doc_id, regexp_extract_all(text, '(\d+(?:[.,]\d+)?)\s*([\p{L}%]+)', 1) AS v, regexp_extract_all(text, '(\d+(?:[.,]\d+)?)\s*([\p{L}%]+)', 2) AS u FROM documents),
y AS (SELECT doc_id, lower(unnest(u)) AS unit, replace(unnest(v), ',', '.') AS value FROM x) SELECT doc_id, unit, count(DISTINCT value) AS n_values, min(value) AS first_value FROM y GROUP BY doc_id, unit""")
def number_units(spark, d):
    """SCA-09 with a unit pattern of any word."""
    rows = table(spark, d, "documents").select("doc_id", F.explode(T.numbers_with_units(F.col("text"), r"(\d+(?:[.,]\d+)?)\s*([\p{L}%]+)")).alias("x"))
    return rows.groupBy("doc_id", F.col("x.unit").alias("unit")).agg(F.countDistinct("x.value").alias("n_values"), F.min("x.value").alias("first_value"))


@query(r"""WITH h AS (SELECT page_id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)', 1)), '^www\.', '') AS h FROM pages)
SELECT page_id, h AS host, CASE WHEN contains(lower(url), 'forum') OR contains(lower(url), 'm.ththth') THEN 'BLACKLIST' WHEN h = 'example.org' OR h LIKE '%.example.org' THEN 'TIER_1'
WHEN h = 'example.net' OR h LIKE '%.example.net' THEN 'TIER_2' ELSE 'TIER_3' END AS web_tier FROM h""")
def web_tier(spark, d):
    """SCA-22 with the tables' domains as tiers."""
    tier = T.web_tier(F.col("url"), ("example.org",), ("example.net",), ("example.com",), ("forum", "m.ththth"))
    return table(spark, d, "pages").select("page_id", T.host(F.col("url")).alias("host"), tier.alias("web_tier"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'g') AS h FROM pages)
SELECT page_id, trim(regexp_replace(regexp_replace(regexp_extract(h, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')) AS title,
len(regexp_extract_all(h, '(?i)<p(?:\s[^>]*)?>')) AS n_paragraphs FROM p WHERE len(regexp_extract_all(h, '(?i)<p(?:\s[^>]*)?>')) > 0""")
def html_blocks(spark, d):
    """SRC-08/09: paragraphs of pages in document order."""
    blocks = ingest.html_paragraphs(table(spark, d, "pages"))
    return blocks.groupBy("page_id").agg(F.max("title").alias("title"), F.count("*").alias("n_paragraphs"))


@query()
def html_articles(spark, d):
    """SRC-08: bold paragraphs as headings; body is what follows."""
    blocks = ingest.html_paragraphs(table(spark, d, "pages"))
    out = ingest.html_articles(blocks, heading=r"^(.+)()()$")
    return out.select("page_id", "nth", "article", F.length("body").cast("long").alias("body_chars"))


@query("""WITH t AS (SELECT doc_id, text, CASE WHEN length(text) <= 4000 THEN 0 ELSE (length(text) - 1) // 3800 END AS last FROM documents)
SELECT doc_id, k AS k, md5(substr(text, (k * 3800 + 1)::BIGINT, 4000)) AS chunk_md5 FROM (SELECT doc_id, text, unnest(range(0, last + 1)) AS k FROM t)""")
def sliding_chunks(spark, d):
    """SCA-25, fallback."""
    out = ingest.sliding_chunks(table(spark, d, "documents").where("text is not null"))
    return out.select("doc_id", F.col("k").cast("long").alias("k"), F.md5(F.col("content").cast("binary")).alias("chunk_md5"))


@query("""WITH t AS (SELECT doc_id, text, CASE WHEN length(text) <= 8000 THEN 0 ELSE ceil((length(text) - 8000) / 6500.0)::BIGINT END AS last FROM documents)
SELECT doc_id, k AS k, length(substr(text, (k * 6500 + 1)::BIGINT, 8000)) AS n_chars FROM (SELECT doc_id, text, unnest(range(0, last + 1)) AS k FROM t)""")
def llm_windows(spark, d):
    """SCA-26."""
    out = ingest.sliding_chunks(table(spark, d, "documents").where("text is not null"), 8000, 1500, early_stop=True)
    return out.select("doc_id", F.col("k").cast("long").alias("k"), F.length("content").cast("long").alias("n_chars"))


@query(r"""WITH p AS (SELECT conv_id, turn, upper(text) AS o, list_distinct(list_transform(flatten([regexp_extract_all(text, '\b\d{1,4}-[IVXLCDM]{1,7}\b'), regexp_extract_all(text, '\b[A-Z]\d{6,}[A-Z]?\b'), regexp_extract_all(text, '\d+(?:[.,]\d+)?\s*%'),
 regexp_extract_all(text, '\b\d{1,2}\.\d{1,2}\.\d{4}\b'), regexp_extract_all(text, 'https?://\S+'), regexp_extract_all(text, '\[[А-ЯЁA-Z][А-ЯЁA-Z \-]{2,}\]')]), lambda x: regexp_replace(trim(x), '\s+', ' ', 'g'))) AS t
 FROM (SELECT conv_id, turn, text || ' https://e.kz/' || turn || ' 5 % ' AS text FROM conversations WHERE turn % 2 = 0 UNION ALL SELECT conv_id, turn, text || ' 7% [NOT PROVED]' FROM conversations WHERE turn % 2 = 1))
SELECT conv_id, turn, len(t) AS n_tokens, regexp_matches(o, '\S') AND len(list_filter(t, lambda x: NOT contains(regexp_replace(o, '\s+', ' ', 'g'), x))) = 0 AS preserved FROM p""")
def token_preservation(spark, d):
    """FLT-13: upper case as the translation, which loses links and keeps percentages and tags."""
    added = F.when(F.col("turn") % 2 == 0, F.concat(F.lit(" https://e.kz/"), "turn", F.lit(" 5 % "))).otherwise(" 7% [NOT PROVED]")
    rows = table(spark, d, "conversations").withColumn("t", F.concat("text", added))
    return rows.select("conv_id", "turn", F.size(T.protected_tokens(F.col("t"))).cast("long").alias("n_tokens"), T.preserved(F.col("t"), F.upper("t")).alias("preserved"))


@query(r"""WITH a AS (SELECT conv_id, turn, text || ' вывод (S1, S2), источник S3: норма (S4, ст. 5) и (п. 1, S6) в редакции S7, S8 .  Bare S1' AS t FROM conversations),
b AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(t, '\(\s*S\d+(?:\s*,\s*S\d+)*\s*\)', '', 'g'), '(\()\s*S\d+(?:\s*,\s*S\d+)*\s*,\s*', '\1', 'g'), '\s*,\s*S\d+(?:\s*,\s*S\d+)*\s*(\))', '\1', 'g') AS t FROM a),
c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(t, '(?i),?\s*источник[аи]?\s+S\d+(?:\s*,\s*S\d+)*\s*:?', '', 'g'), '(?i),?\s*в\s+ред(?:акции|\.)?\s+S\d+(?:\s*,\s*S\d+)*', '', 'g') AS t FROM b),
e AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\(\s*[;:,]\s*', '(', 'g'), '\(\s*\)', '', 'g'), '\s{2,}', ' ', 'g'), '\s+([.,;:)])', '\1', 'g') AS t FROM c)
SELECT conv_id, turn, md5(trim(t, ' ' || chr(9) || chr(10) || chr(13))) AS cleaned_md5 FROM e""")
def label_clean(spark, d):
    """SCA-28 on whole texts with labels added."""
    added = F.lit(" вывод (S1, S2), источник S3: норма (S4, ст. 5) и (п. 1, S6) в редакции S7, S8 .  Bare S1")
    rows = table(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.md5(T.clean_labels(F.concat("text", added)).cast("binary")).alias("cleaned_md5"))


@query(r"""WITH t AS (SELECT item_id, text, regexp_extract(text, '([A-Z])', 1) AS a FROM benchmark) SELECT item_id, (item_id % 100)::DOUBLE / 100 AS score,
 CASE WHEN (item_id % 100)::DOUBLE / 100 >= 0.75 THEN 'green' WHEN (item_id % 100)::DOUBLE / 100 >= 0.5 THEN 'yellow' ELSE 'red' END AS light,
 repeat('█', (item_id % 100)::INT // 10) || repeat('░', 10 - (item_id % 100)::INT // 10) AS bar FROM t""")
def score_bands(spark, d):
    """SCA-31."""
    score = (F.col("item_id") % 100).cast("double") / 100
    return table(spark, d, "benchmark").select("item_id", score.alias("score"), T.traffic_light(score).alias("light"), T.score_bar(score).alias("bar"))


# --- filters and classifiers ------------------------------------------------------------------------------------------

#: What DuckDB's trim takes off: the space separators of Unicode.
_SPACES = "".join(map(chr, (0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000)))


@query(r"""WITH p AS (SELECT page_id, url, trim(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS c FROM pages)
SELECT page_id, contains(lower(url), '?page=') OR regexp_matches(c, '(?i)cookie|subscribe') OR length(c) < 600 OR (NOT regexp_matches(c, '(?i)tion\b') AND NOT contains(lower(url), 'example.org')) AS is_spam FROM p""")
def spam_filter(spark, d):
    """FLT-01 with the tables' own lists. As in the SQL, a word ends before anything but an ASCII letter, digit or underscore (tioné
    has one), the signs that fold to k and s count as these, and all space separators are trimmed."""
    content = F.trim(F.regexp_replace("html", r"<[^>]+>", " "), F.lit(_SPACES))
    null = F.lit(None).cast("string")
    return table(spark, d, "pages").select("page_id", fusion.is_spam(F.col("url"), content, null, null, 600, r"(?i)coo[k\x{212A}]ie|[s\x{17F}]ub[s\x{17F}]cribe", r"(?i)tion(?![0-9A-Za-z_])", ("?page=",), ("example.org",)).alias("is_spam"))


def _any_sql(x: str, needles) -> str:
    return "(" + " OR ".join(f"contains({x}, '{n}')" for n in needles) + ")"


_MADE = (*claims.COMMENCEMENT, *claims.AMENDMENT_VERBS, *claims.MODAL_VERBS, *claims.STRUCTURAL, "5 мрп", "10 дней", "документ является проектом закона", "настоящий закон", "статья 12 о новых условиях", "никакое слово", "коротко")
_KINDS = ("legal_ref", "temporal", "factual", "legal_id", "normative")


@query(rf"""WITH w AS (SELECT doc_id, [{", ".join(f"'{m}'" for m in _MADE)}][doc_id % {len(_MADE)} + 1] AS made, [{", ".join(f"'{k}'" for k in _KINDS)}][doc_id % {len(_KINDS)} + 1] AS kind, regexp_replace(coalesce(text, ''), '\d', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, kind, CASE WHEN made = 'коротко' THEN made ELSE made || ' ' || t END AS t, doc_id % 2 = 0 AS det, doc_id % 3 = 0 AS target FROM w)
SELECT doc_id, length(trim(t)) < 20 OR {" OR ".join("regexp_matches(t, '" + p.replace("(?iuU)", "(?i)").replace("(?iu)", "(?i)").replace(chr(92) + "w", "[" + chr(92) + "p{L}" + chr(92) + "p{N}_]") + "')" for p in claims.META)} AS is_meta,
  CASE WHEN {_any_sql("lower(t)", claims.COMMENCEMENT)} THEN true WHEN {_any_sql("lower(t)", claims.AMENDMENT_VERBS)} THEN false WHEN {_any_sql("lower(t)", claims.MODAL_VERBS)} THEN false
  WHEN regexp_matches(lower(t), '(^|[^\p{{L}}\p{{N}}_])\d+\s*(?:мрп|аек|мзп|тәм|тенге|теңге|часов?|сағат|дней?|күн|күні|месяц|ай|лет|жыл|процент|пайыз|%)') THEN false WHEN kind IN ('factual', 'normative') THEN false WHEN kind = 'legal_id' THEN NOT det
  WHEN kind = 'legal_ref' THEN NOT (det OR target OR regexp_matches(lower(t), 'стать[яи]\s*\d+.*[а-яё\s]{{10,}}')) ELSE {_any_sql("lower(t)", claims.STRUCTURAL)} END AS is_structural FROM l""")
def structural_claims(spark, d):
    """FLT-02, FLT-03: each word of the rules' lists, numbers with units, meta sentences and plain ones before the documents, by all kinds of claims."""
    i = F.col("doc_id")
    made = F.element_at(F.array(*[F.lit(m) for m in _MADE]), (i % len(_MADE) + 1).cast("int"))
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (i % len(_KINDS) + 1).cast("int"))
    text = F.when(made == "коротко", made).otherwise(F.concat(made, F.lit(" "), F.regexp_replace(F.coalesce("text", F.lit("")), r"\d", "")))
    rows = table(spark, d, "documents").select("doc_id", text.alias("t"), kind.alias("kind"), F.when(i % 2 == 0, "said").alias("det"), F.when(i % 3 == 0, F.array(F.lit("94-V"))).otherwise(F.array().cast("array<string>")).alias("target"))
    return rows.select("doc_id", claims.is_meta(F.col("t")).alias("is_meta"), claims.is_structural(F.col("t"), F.col("kind"), F.col("det"), F.col("target")).alias("is_structural"))


# --- de-duplication ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS is_duplicate FROM documents")
def exact_dedup(spark, d):
    """DED-01."""
    return fusion.flag_exact_duplicates(table(spark, d, "documents"), T.content_id(F.col("text")), "doc_id").select("doc_id", "is_duplicate")


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) >= 0.35""")
def cosine_pairs(spark, d):
    """JOI-11 at a threshold that these vectors reach."""
    pairs = fusion.cosine_pairs(table(spark, d, "embeddings"), 0.35 - 1e-5, "vec_id", "embedding")
    return pairs.withColumn("cosine", F.round("cosine", 5)).where("cosine >= 0.35")


@query("""WITH p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) >= 0.35),
f AS (SELECT list_reduce(list([a, b, 1 + a % 11, 1 + b % 11] ORDER BY a, b), lambda gone, x: CASE WHEN list_contains(gone, x[1]) OR list_contains(gone, x[2]) THEN gone WHEN x[3] > x[4] THEN gone || [x[1], -1 - x[2]] ELSE gone || [x[2], -1 - x[1]] END, []::BIGINT[]) AS gone FROM p)
SELECT gone[2 * i + 1] AS id, -1 - gone[2 * i + 2] AS kept_id FROM (SELECT gone, unnest(range(len(gone) // 2)) AS i FROM f)""")
def greedy_cosine_dedup(spark, d):
    """DED-02."""
    vectors = table(spark, d, "embeddings")
    pairs = fusion.cosine_pairs(vectors, 0.35 - 1e-5, "vec_id", "embedding").where(F.round("cosine", 5) >= 0.35)
    return fusion.greedy_losers(pairs.select("a", "b"), vectors.select(F.col("vec_id").alias("id"), (1 + F.col("vec_id") % 11).alias("legal_rank")))


_JACCARD_SQL = r"""WITH s AS (SELECT doc_id AS id, list_distinct(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}_]+'), lambda w: length(w) > 3)) AS w FROM documents)
SELECT a, b, round(i / (na + nb - i), 6) AS similarity FROM (SELECT x.id AS a, y.id AS b, len(x.w) AS na, len(y.w) AS nb, len(list_intersect(x.w, y.w)) AS i FROM s x JOIN s y ON x.id < y.id) WHERE i > 0 AND i / (na + nb - i) >= 0.6"""


@query(_JACCARD_SQL)
def jaccard_dedup_pairs(spark, d):
    """DED-04, pairs."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fusion.jaccard_pairs(rows).withColumn("similarity", F.round("similarity", 6))


@query(rf"""WITH p AS ({_JACCARD_SQL}), n AS (SELECT b, list(a) AS earlier FROM p GROUP BY b)
SELECT unnest(list_reduce(list([b] || earlier ORDER BY b), lambda gone, x: CASE WHEN len(list_filter(x[2:], lambda y: NOT list_contains(gone, y))) > 0 THEN gone || [x[1]] ELSE gone END, []::BIGINT[])) AS id FROM n""")
def jaccard_greedy(spark, d):
    """DED-04, rows that go."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    return fusion.near_texts_dropped(rows)


@query(r"""WITH b AS (SELECT doc_id, lang, text, array_to_string(list_filter(string_split_regex(translate(lower(text), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~«»—–' || chr(160), ''), '\s+'), lambda t: length(t) > 2 AND NOT list_contains(STOP, t)), ' ') AS n FROM documents),
k AS (SELECT doc_id, lang, text, CASE WHEN n <> '' THEN n ELSE substr(lower(text), 1, 40) END AS key FROM b)
SELECT doc_id, lang, n_group FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang, key) AS n_group, row_number() OVER (PARTITION BY lang, key ORDER BY length(text) DESC, doc_id) AS r FROM k) WHERE r = 1""".replace("STOP", _STOP))
def claim_group_best(spark, d):
    """DED-03 with normalised text as key: the longest claim of each group."""
    rows = table(spark, d, "documents").withColumn("key", F.coalesce(F.nullif(T.normalise_claim(F.col("text")), F.lit("")), F.substring(F.lower("text"), 1, 40)))
    rows = rows.withColumn("n_group", F.count("*").over(Window.partitionBy("lang", "key")))
    return fusion.keep_first(rows, ["lang", "key"], [F.length("text").desc(), F.col("doc_id")]).select("doc_id", "lang", "n_group")


@query()
def claim_dedup(spark, d):
    """DED-03 with its whole key."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.col("text").alias("claim_text"), F.col("text").alias("quote"), F.lit("temporal").alias("claim_type"), F.array().cast("array<string>").alias("entities"), F.array().cast("array<string>").alias("target_law_ids"), F.lit(None).cast("string").alias("deterministic_verdict"))
    out = claims.dedup_claims(rows, ["conv_id"], "turn")
    return out.select("conv_id", "turn", "group_seq", F.size("quote_variants").alias("n_variants"))


# --- search -----------------------------------------------------------------------------------------------------------


@query(f"""WITH {_bm25_sql('SELECT doc_id AS id, text FROM documents', 'SELECT item_id AS query_id, text FROM benchmark')}
SELECT query_id, id, rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 5""")
def bm25_topk(spark, d):
    """RNK-01, SRT-01."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    found = search.top_k(_scored(docs, table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")), 5)
    return found.select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query(f"""WITH {_bm25_sql('SELECT item_id AS id, text FROM benchmark', "SELECT 'c' || conv_id || '_' || turn AS query_id, text FROM conversations UNION ALL SELECT 'self_' || item_id, substr(text, 1, 200) FROM benchmark")},
  norm AS (SELECT greatest(median(greatest(coalesce(best, 0), 0)), 0) AS m FROM (SELECT 'self_' || id AS query_id FROM corpus WHERE len({_tokens_sql('substr(text, 1, 200)')}) > 0) LEFT JOIN (SELECT query_id, max(score) AS best FROM scored GROUP BY query_id) USING (query_id)),
  v AS (SELECT query_id, round(least(1, greatest(0, max(score) / CASE WHEN m < 0.001 THEN 1 ELSE m END)), 6) AS score FROM scored, norm WHERE query_id LIKE 'c%' GROUP BY query_id, m)
SELECT query_id, score, CASE WHEN score >= 0.25 THEN 'HIGH' WHEN score >= 0.12 THEN 'MEDIUM' ELSE 'LOW' END AS status FROM v""")
def bm25_normalised_status(spark, d):
    """RNK-02, VRD-08."""
    bench = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    index = search.build_index(bench)
    asked = table(spark, d, "conversations").select(F.concat(F.lit("c"), F.col("conv_id"), F.lit("_"), F.col("turn")).alias("query_id"), "text")
    best = search.score(index, asked).groupBy("query_id").agg(F.max(F.round("score", 9)).alias("best"))
    rows = best.join(F.broadcast(search.normaliser(index, bench))).withColumn("score", F.round(search.normalised(F.col("best"), F.col("norm")), 6))
    return rows.select("query_id", "score", search.status(F.col("score")).alias("status"))


def _candidates(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    scored = _scored(docs, asked)
    vectors = table(spark, d, "embeddings")
    n = F.broadcast(vectors.agg(F.count("*").alias("n")))
    rows = scored.join(n).withColumns({"qv": F.pmod(F.col("query_id"), F.col("n")), "dv": F.pmod(F.col("id"), F.col("n"))})
    rows = rows.join(vectors.select(F.col("vec_id").alias("qv"), F.col("embedding").alias("qe")), "qv").join(vectors.select(F.col("vec_id").alias("dv"), F.col("embedding").alias("de")), "dv")
    rows = rows.join(docs.select("id", "lang"), "id")
    return rows.select("query_id", "id", F.col("score").alias("bm25"), F.round(search.cosine(F.col("qe"), F.col("de")), 9).alias("semantic"), (F.col("id") % 40 == F.col("query_id")).cast("int").alias("exact"), (F.col("lang") == "en").alias("language_match"), (2018 + F.col("id") % 10).cast("int").alias("year"))


_CANDIDATES_SQL = f"""{_bm25_sql('SELECT doc_id AS id, text FROM documents', 'SELECT item_id AS query_id, text FROM benchmark')}, nv AS (SELECT count(*) AS n FROM embeddings),
  cand AS (SELECT query_id, id, score AS bm25, round(list_cosine_similarity(qe.embedding::DOUBLE[], de.embedding::DOUBLE[]), 9) AS semantic, (id % 40 = query_id)::INT AS exact, lang = 'en' AS language_match, (2018 + id % 10)::INT AS year
   FROM scored, nv, embeddings qe, embeddings de, documents d WHERE qe.vec_id = query_id % n AND de.vec_id = id % n AND d.doc_id = id)"""
_FUSED_SQL = """mm AS (SELECT *, min(semantic) OVER w AS s0, max(semantic) OVER w AS s1, min(bm25) OVER w AS b0, max(bm25) OVER w AS b1 FROM cand WINDOW w AS (PARTITION BY query_id)),
  wl AS (SELECT *, 0.55::DOUBLE * (CASE WHEN s1 > s0 THEN (semantic - s0) / (s1 - s0) ELSE 0 END) + 0.30::DOUBLE * (CASE WHEN bm25 > 0 AND b1 > b0 THEN (bm25 - b0) / (b1 - b0) ELSE 0 END) + 0.15::DOUBLE * exact AS wlc FROM mm)"""


@query(f"""WITH {_CANDIDATES_SQL}, {_FUSED_SQL}, pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY wlc DESC, id) AS r0 FROM wl) WHERE r0 <= 50),
  fin AS (SELECT *, wlc * (CASE WHEN language_match THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END) + greatest(0, (year - 2020) * 0.01::DOUBLE) AS final FROM pool)
SELECT query_id, id, rank, round(final, 6) AS final FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, id) AS rank FROM fin) WHERE rank <= 10""")
def hybrid_wlc(spark, d):
    """RNK-04."""
    return search.fuse(_candidates(spark, d)).select("query_id", "id", F.col("rank").cast("long").alias("rank"), F.round("final", 6).alias("final"))


@query(f"""WITH {_bm25_sql('SELECT doc_id AS id, text FROM documents', 'SELECT item_id AS query_id, text FROM benchmark')},
  j AS (SELECT s.query_id, s.id, least(1, greatest(0, score / 40.0)) AS value, d.source AS law, doc_id % 7 = 0 AS web, lang AS article, d.text AS text, 'src' || (query_id % 20) AS l1, 'src' || ((query_id + 1) % 20) AS f1, query_id % 3 <> 0 AS named, CASE WHEN query_id % 2 = 0 THEN 'en' END AS ca
    FROM scored s JOIN documents d ON d.doc_id = s.id),
  layers AS (SELECT *, 1 AS layer FROM j WHERE named AND (law = l1 OR web) UNION ALL SELECT *, 2 FROM j WHERE named AND law = f1 UNION ALL SELECT *, 3 FROM j),
  best AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l.query_id, layer ORDER BY s.score DESC, l.id) AS r FROM layers l JOIN scored s USING (query_id, id)) WHERE r = 1),
  ok AS (SELECT * FROM best WHERE CASE WHEN layer = 3 THEN value >= 0.20 AND (ca IS NULL OR article = ca OR regexp_matches(text, '(^|[^\\p{{L}}\\p{{N}}_])' || ca || '([^\\p{{L}}\\p{{N}}_]|$)')) ELSE value >= 0.12 END)
SELECT query_id, id, layer::BIGINT AS layer, round(value, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY layer) AS rn FROM ok) WHERE rn = 1""")
def layered_fallback(spark, d):
    """RNK-03."""
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    scored = _scored(docs.select(F.col("doc_id").alias("id"), "text"), bench.select(F.col("item_id").alias("query_id"), "text"))
    named, q = F.col("item_id") % 3 != 0, F.col("item_id")
    none = F.array().cast("array<string>")
    asked = bench.select(q.alias("query_id"), F.when(named, F.array(F.concat(F.lit("src"), q % 20))).otherwise(none).alias("laws"), F.when(named, F.array(F.concat(F.lit("src"), (q + 1) % 20))).otherwise(none).alias("families"), F.when(q % 2 == 0, "en").alias("claim_article"))
    chunks = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("law"), (F.col("doc_id") % 7 == 0).alias("web"), F.col("lang").alias("article"), "text")
    norm = spark.range(1).select(F.lit(40.0).alias("norm"))
    out = search.layered_fallback(scored, asked, chunks, norm)
    return out.select("query_id", "id", F.col("layer").cast("long").alias("layer"), F.round("score", 6).alias("score"))


@query("""WITH w AS (SELECT source, doc_id, sum(n_chars) OVER (PARTITION BY source ORDER BY lang <> 'en', doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total, row_number() OVER (PARTITION BY source ORDER BY lang <> 'en', doc_id) AS r FROM documents)
SELECT source, doc_id, 'S' || r AS label, total::BIGINT AS total FROM w WHERE total <= 20000""")
def prompt_pack(spark, d):
    """RNK-07."""
    return search.pack_prefix(table(spark, d, "documents"), "source", [F.col("lang") != "en", F.col("doc_id")], F.col("n_chars"), 20_000).select("source", "doc_id", "label", "total")


@query("SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY CASE WHEN lang='en' THEN 0 WHEN lang='fr' THEN 1 WHEN lang='de' THEN 2 ELSE 3 END, doc_id) - 1) // 5 AS batch FROM documents")
def claim_batches(spark, d):
    """RNK-08, RNK-09."""
    severity = F.when(F.col("lang") == "en", "critical").when(F.col("lang") == "fr", "high").when(F.col("lang") == "de", "medium").otherwise("low")
    return search.batches(table(spark, d, "documents"), "source", [search.severity_order(severity), F.col("doc_id")]).select("source", "doc_id", "batch")


@query()
def batch_retrieval(spark, d):
    """RNK-06."""
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    scored = _scored(docs.select(F.col("doc_id").alias("id"), "text"), bench.select(F.col("item_id").alias("query_id"), "text"))
    ranked = search.top_k(scored, 60).select(F.floor(F.col("query_id") / 5).alias("batch"), "id", F.col("query_id").cast("int").alias("claim_seq"), "score")
    batches = bench.select(F.floor(F.col("item_id") / 5).alias("batch"), F.col("item_id").alias("id"))
    return search.select_for_batch(batches, batches, ranked)


@query("""WITH s AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) SELECT doc_id, source, r AS round FROM s ORDER BY r, source LIMIT 100""")
def stratified_round_robin(spark, d):
    """RNK-10; the limit is the sample size."""
    return search.stratified_round_robin(table(spark, d, "documents"), "source", "doc_id", 100).select("doc_id", "source", F.col("round").cast("long").alias("round"))


_RANKED_SQL = f"""{_bm25_sql('SELECT doc_id AS id, text FROM documents', 'SELECT item_id AS query_id, text FROM benchmark')}, ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 10),
  ex AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark, documents WHERE doc_id % 40 = item_id)"""


@query(f"""WITH {_RANKED_SQL} SELECT query_id, round(coalesce(max(1.0 / rank), 0), 6) AS mrr, round(count(rank) / count(*), 6) AS recall, round(coalesce(max(1.0 / log2(rank + 1.0)), 0), 6) AS ndcg FROM ex LEFT JOIN ranked USING (query_id, id) GROUP BY query_id""")
def retrieval_metrics(spark, d):
    """RNK-12."""
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    ranked = search.top_k(_scored(docs.select(F.col("doc_id").alias("id"), "text"), bench.select(F.col("item_id").alias("query_id"), "text")), 10)
    expected = docs.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id")).join(bench.select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    out = search.retrieval_metrics(ranked, expected)
    return out.select("query_id", *[F.round(c, 6).alias(c) for c in ("mrr", "recall", "ndcg")])


@query(f"""WITH {_CANDIDATES_SQL}, ex AS (SELECT item_id AS query_id, doc_id AS id FROM benchmark, documents WHERE doc_id % 40 = item_id),
  mm AS (SELECT *, min(semantic) OVER w AS s0, max(semantic) OVER w AS s1, min(bm25) OVER w AS b0, max(bm25) OVER w AS b1 FROM cand WINDOW w AS (PARTITION BY query_id)),
  g AS (SELECT * FROM (VALUES (0, 0.55::DOUBLE, 0.30::DOUBLE, 0.15::DOUBLE), (1, 0.35::DOUBLE, 0.50::DOUBLE, 0.15::DOUBLE), (2, 0.2::DOUBLE, 0.2::DOUBLE, 0.6::DOUBLE)) t(combo, ws, wb, we)),
  v AS (SELECT combo, query_id, id, ws * (CASE WHEN s1 > s0 THEN (semantic - s0) / (s1 - s0) ELSE 0 END) + wb * (CASE WHEN bm25 > 0 AND b1 > b0 THEN (bm25 - b0) / (b1 - b0) ELSE 0 END) + we * exact AS value FROM mm, g),
  r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY combo, query_id ORDER BY value DESC, id) AS rank FROM v) WHERE rank <= 10),
  h AS (SELECT combo, query_id, 1.0 / min(rank) AS rr, count(*) AS hits FROM r JOIN ex USING (query_id, id) GROUP BY combo, query_id),
  e AS (SELECT combo, query_id, count(*) AS wanted FROM ex, g GROUP BY combo, query_id)
SELECT combo::BIGINT AS combo, round(avg(coalesce(rr, 0)), 6) AS mrr, round(avg(coalesce(hits, 0) / wanted), 6) AS recall FROM e LEFT JOIN h USING (combo, query_id) GROUP BY combo""")
def grid_search(spark, d):
    """RNK-13."""
    docs, bench = table(spark, d, "documents"), table(spark, d, "benchmark")
    expected = docs.select((F.col("doc_id") % 40).alias("query_id"), F.col("doc_id").alias("id")).join(bench.select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    out = search.grid_search(_candidates(spark, d), expected, [(0.55, 0.30, 0.15), (0.35, 0.50, 0.15), (0.2, 0.2, 0.6)])
    return out.select(F.col("combo").cast("long").alias("combo"), F.round("mrr", 6).alias("mrr"), F.round("recall", 6).alias("recall"))


@query("""WITH s AS (SELECT value / 400 AS score, event_type = 'purchase' AS relevant FROM events), g AS (SELECT unnest([0.05::DOUBLE, 0.1, 0.2, 0.4]) AS threshold),
 c AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND relevant) AS tp, count(*) FILTER (WHERE score >= threshold) AS picked, count(*) FILTER (WHERE relevant) AS rel FROM s, g GROUP BY threshold),
 p AS (SELECT threshold, CASE WHEN picked > 0 THEN tp / picked ELSE 0 END AS precision, CASE WHEN rel > 0 THEN tp / rel ELSE 0 END AS recall FROM c)
SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 6) AS f1 FROM p""")
def threshold_search(spark, d):
    """RNK-14."""
    rows = table(spark, d, "events").select((F.col("value") / 400).alias("score"), (F.col("event_type") == "purchase").alias("relevant"))
    out = search.threshold_search(rows, [0.05, 0.1, 0.2, 0.4])
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


# --- conflicts --------------------------------------------------------------------------------------------------------


@query("""SELECT a.source AS law_id, count(*) AS n_pairs FROM documents a JOIN documents b ON a.source = b.source AND a.doc_id < b.doc_id WHERE abs((1 + a.doc_id % 11) - (1 + b.doc_id % 11)) > 2 GROUP BY a.source""")
def hierarchy_conflicts(spark, d):
    """JOI-05, pairs counted from counts by rank."""
    rows = table(spark, d, "documents").select(F.col("source").alias("law_id"), (1 + F.col("doc_id") % 11).alias("legal_rank"))
    return fusion.hierarchy_counts(rows)


def _lines(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("law_id"), F.col("l_suppkey").alias("article"), F.to_date("l_shipdate").alias("effective_date"), F.col("l_returnflag").alias("unit"), F.col("l_quantity").alias("value"))


_LINES_SQL = "l AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS law_id, l_suppkey AS article, l_shipdate::DATE AS dt, l_returnflag AS unit, l_quantity AS value FROM lineitem)"


@query(f"""WITH {_LINES_SQL} SELECT a.law_id, a.id AS a_id, b.id AS b_id FROM l a JOIN l b ON a.law_id = b.law_id AND a.article = b.article AND a.id < b.id WHERE a.dt <> b.dt""")
def temporal_conflicts(spark, d):
    """JOI-06."""
    return fusion.temporal_pairs(_lines(spark, d)).drop("conflict_type")


@query(r"""WITH y AS (SELECT doc_id AS id, source || ' ' || lang AS law_id, [2000 + doc_id % 30] || CASE WHEN doc_id % 4 = 0 THEN [2000 + doc_id % 7] ELSE [] END AS ys FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL),
p AS (SELECT a.law_id, a.id AS a_id, b.id AS b_id, a.ys AS ya, b.ys AS yb FROM y a JOIN y b ON a.law_id = b.law_id AND a.id < b.id WHERE a.id // 20 % 5 <> b.id // 20 % 5),
m AS (SELECT law_id, a_id, b_id, min(abs(u - v)) AS gap FROM (SELECT law_id, a_id, b_id, u, unnest(yb) AS v FROM (SELECT law_id, a_id, b_id, yb, unnest(ya) AS u FROM p)) GROUP BY law_id, a_id, b_id)
SELECT law_id, a_id, b_id FROM m WHERE gap > 2""")
def temporal_text_conflicts(spark, d):
    """JOI-07: a year or two at the end of every text, which loses its own digits; five base URLs, laws source and language."""
    i = F.col("doc_id")
    content = F.concat(F.regexp_replace("text", r"\d", ""), F.lit(" "), 2000 + i % 30, F.when(i % 4 == 0, F.concat(F.lit(" "), 2000 + i % 7)).otherwise(""))
    chunks = table(spark, d, "documents").select(i.alias("id"), F.concat("source", F.lit(" "), "lang").alias("law_id"), F.lit(None).cast("date").alias("effective_date"), F.concat(F.lit("http://x/"), F.floor(i / 20) % 5, F.lit("?p="), i).alias("source_url"), content.alias("content"))
    return fusion.temporal_text_pairs(chunks).drop("conflict_type")


@query(f"""WITH {_LINES_SQL}, s AS (SELECT law_id, article, unit, id, list_distinct(list(value)) AS vs FROM l GROUP BY ALL)
SELECT DISTINCT a.law_id, a.id AS a_id, b.id AS b_id FROM s a JOIN s b ON a.law_id = b.law_id AND a.article = b.article AND a.unit = b.unit AND a.id < b.id
WHERE len(list_filter(a.vs, lambda x: NOT list_contains(b.vs, x))) > 0 AND len(list_filter(b.vs, lambda x: NOT list_contains(a.vs, x))) > 0""")
def factual_conflicts(spark, d):
    """JOI-08."""
    return fusion.factual_pairs(_lines(spark, d)).drop("conflict_type")


@query("""WITH c AS (SELECT doc_id AS id, source AS law_id, 1 + doc_id % 11 AS r, CASE doc_id % 3 WHEN 1 THEN 'TIER_2' WHEN 2 THEN 'TIER_3' END AS tier, lower(text) AS t FROM documents),
n AS (SELECT law_id, id FROM c WHERE tier IS NULL AND r <= 7), p AS (SELECT law_id, id FROM c WHERE tier IS NOT NULL AND (contains(t, 'licen') OR contains(t, '@')))
SELECT law_id, count(*) AS n_pairs, count(DISTINCT n.id) AS n_norms, count(DISTINCT p.id) AS n_practice FROM n JOIN p USING (law_id) GROUP BY law_id""")
def enforcement_gap(spark, d):
    """JOI-09."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("law_id"), (1 + F.col("doc_id") % 11).alias("legal_rank"), F.when(F.col("doc_id") % 3 == 1, "TIER_2").when(F.col("doc_id") % 3 == 2, "TIER_3").alias("web_tier"), F.col("text").alias("content"))
    return fusion.gap_pairs(rows, ("licen", "@")).groupBy("law_id").agg(F.count("*").alias("n_pairs"), F.countDistinct("a_id").alias("n_norms"), F.countDistinct("b_id").alias("n_practice"))


@query(f"""WITH {_LINES_SQL}, p AS (SELECT a.id AS a_id, b.id AS b_id FROM l a JOIN l b ON a.law_id = b.law_id AND a.article = b.article AND a.id < b.id WHERE a.dt <> b.dt),
s AS (SELECT a_id AS id, b_id AS other FROM p UNION ALL SELECT b_id, a_id FROM p) SELECT id, array_to_string(list_sort(list(DISTINCT other)), ',') AS conflict_with_ids FROM s GROUP BY id""")
def conflict_marking(spark, d):
    """JOI-10."""
    lines = _lines(spark, d)
    out = fusion.mark_conflicts(lines.select("id").distinct(), fusion.temporal_pairs(lines)).where("is_conflict")
    return out.select("id", F.array_join(F.transform("conflict_with_ids", lambda x: x.cast("string")), ",").alias("conflict_with_ids"))


@query("""WITH e AS (SELECT user_id, floor(epoch(ts) / 60)::BIGINT AS pos, DATE '2024-01-01' + (event_id % 30)::INT AS dt, event_id::VARCHAR AS txt, event_type FROM events),
p AS (SELECT a.user_id, a.pos AS a_pos, e.pos AS e_pos, a.txt AS a_text, e.txt AS e_text FROM e JOIN e a ON a.user_id = e.user_id AND a.event_type = 'purchase' AND e.event_type = 'signup' WHERE abs(a.pos - e.pos) <= 500 AND e.dt < a.dt)
SELECT user_id, a_pos, e_pos, a_text, e_text FROM p""")
def band_join_chronology(spark, d):
    """JOI-15: positions are minutes."""
    e = table(spark, d, "events").select("user_id", F.floor(F.unix_timestamp("ts") / 60).alias("pos"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("event_id") % 30).cast("int")).alias("date"), F.col("event_id").cast("string").alias("text"), "event_type")
    return claims.chronology(e.where("event_type = 'purchase'"), e.where("event_type = 'signup'"), "user_id").select("user_id", "a_pos", "e_pos", "a_text", "e_text")


# --- corpus and registry ----------------------------------------------------------------------------------------------

_CLAIMS_SQL = "c AS (SELECT item_id, 'SRC' || (item_id % 20) AS law, CASE item_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'en' WHEN 2 THEN 'fr' WHEN 3 THEN 'de' ELSE 'es' END AS article FROM benchmark)"


def _claims(spark, d) -> DataFrame:
    i = F.col("item_id")
    article = F.when(i % 5 == 1, "en").when(i % 5 == 2, "fr").when(i % 5 == 3, "de").when(i % 5 == 4, "es")
    return table(spark, d, "benchmark").select("item_id", F.array(F.concat(F.lit("SRC"), i % 20)).alias("laws"), article.alias("article"))


def _chunks(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("law_id"), F.col("lang").alias("article"), F.col("text").alias("content"))


@query(f"WITH {_CLAIMS_SQL} SELECT item_id, doc_id AS id FROM c JOIN documents d ON upper(d.source) = c.law AND d.lang = c.article")
def metadata_exact(spark, d):
    """JOI-01, JOI-02."""
    return corpus.exact_metadata(_claims(spark, d), _chunks(spark, d), ["item_id"])


@query(f"WITH {_CLAIMS_SQL} SELECT DISTINCT doc_id AS id, source AS law_id, 'LOCAL_CACHE' AS tag FROM documents d JOIN c ON upper(d.source) = c.law AND d.lang = c.article WHERE doc_id % 3 <> 0")
def claim_driven_inject(spark, d):
    """JOI-03."""
    chunks = _chunks(spark, d)
    return corpus.inject_claim_driven(_claims(spark, d), chunks, chunks.where("id % 3 = 0")).select("id", "law_id", F.col("adilet_fallback_used").alias("tag"))


@query("""WITH q AS (SELECT DISTINCT 'SRC' || (item_id % 20) AS law, item_id % 2 = 0 AS whole, 'en' AS article FROM benchmark), a AS (SELECT law, bool_or(whole) AS whole FROM q GROUP BY law),
r AS (SELECT doc_id, source, lang, whole, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents d JOIN a ON upper(d.source) = a.law WHERE whole OR lang = 'en')
SELECT doc_id AS id, source AS law_id FROM r WHERE NOT whole OR n <= 150""")
def plan_driven_inject(spark, d):
    """JOI-04; the limit of 150 chunks a law is the feature."""
    i = F.col("item_id")
    asked = table(spark, d, "benchmark").select(F.concat(F.lit("SRC"), i % 20).alias("law"), F.when(i % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("en"))).alias("articles"))
    return corpus.inject_plan_driven(asked, _chunks(spark, d), "id").select("id", "law_id")


@query("SELECT DISTINCT ON (sha256(text)) sha256(text) AS chunk_id, doc_id FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) ORDER BY sha256(text), doc_id")
def insert_if_absent(spark, d):
    """SNK-01, SNK-02."""
    rows = table(spark, d, "documents").withColumn("chunk_id", T.content_id(F.col("text")))
    return corpus.insert_if_absent(rows, rows.where("doc_id % 2 = 0"), "chunk_id", "doc_id").select("chunk_id", "doc_id")


@query("""SELECT o_custkey AS key, 'new' AS state, max(o_orderkey) AS seq FROM orders GROUP BY 1 UNION ALL SELECT c_custkey, 'old', -1 FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def insert_or_replace(spark, d):
    """SNK-03."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("old").alias("state"), F.lit(-1).cast("long").alias("seq"))
    new = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.lit("new").alias("state"), F.col("o_orderkey").alias("seq"))
    return corpus.insert_or_replace(new, old, "key", "seq")


@query("""WITH n AS (SELECT o_custkey AS k, CASE WHEN count(*) > 8 THEN '' ELSE min(o_orderpriority) END AS title, count(*) AS cnt, max(o_orderdate)::DATE AS stamp FROM orders GROUP BY 1)
SELECT coalesce(c_custkey, k) AS law_id, coalesce(nullif(title, ''), c_mktsegment) AS title, (CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END + coalesce(cnt, 0))::BIGINT AS chunk_count, coalesce(stamp, DATE '1990-01-01') AS updated FROM customer FULL JOIN n ON c_custkey = k""")
def upsert_registry(spark, d):
    """SNK-04."""
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("law_id"), F.col("c_mktsegment").alias("title"), F.lit(1).cast("long").alias("chunk_count"), F.lit("1990-01-01").cast("date").alias("updated"))
    new = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("law_id")).agg(F.when(F.count("*") > 8, "").otherwise(F.min("o_orderpriority")).alias("title"), F.count("*").alias("chunk_count"), F.to_date(F.max("o_orderdate")).alias("updated"))
    return corpus.upsert_registry(old, new, "law_id", ["title"], "chunk_count", "updated")


@query("""WITH k AS (SELECT event_id, sha256('v1:' || event_type || ':' || user_id) AS key, ts, CASE WHEN event_type <> 'view' THEN ts + INTERVAL 7 DAY END AS expires_at FROM events),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS r FROM k) WHERE r = 1) SELECT key, event_id FROM l WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '2024-01-20 00:00:00'""")
def ttl_cache(spark, d):
    """SNK-05 at a fixed time."""
    e = table(spark, d, "events")
    key = corpus.cache_key(F.lit("1"), F.col("event_type"), F.col("user_id").cast("string"))
    expires = F.when(F.col("event_type") != "view", F.col("ts") + F.expr("INTERVAL 7 DAY"))
    latest = fusion.keep_first(e.select(key.alias("key"), "event_id", expires.alias("expires_at")), ["key"], [F.col("event_id").desc()])
    return corpus.cache_live(latest, F.lit("2024-01-20 00:00:00").cast("timestamp")).select("key", "event_id")


@query("""SELECT doc_id AS id, CASE WHEN source = 'src3' THEN 'LAW-3' ELSE source END AS law_id FROM documents WHERE source <> 'src5'""")
def corpus_repair(spark, d):
    """SNK-06, SNK-07: raw codes to short ids, an invalid law dropped."""
    registry = spark.createDataFrame([("SRC3_", "LAW-3")], "code string, law_id string")
    return corpus.relabel(_chunks(spark, d), registry, ("src5",)).select("id", "law_id")


@query("""SELECT doc_id AS id, CASE WHEN lang <> 'en' THEN source WHEN contains(lower(text), 'worthless') THEN 'B-2' WHEN contains(lower(text), 'idiot') THEN 'A-1' ELSE 'UNKNOWN' END AS law_id FROM documents""")
def heal_unknown(spark, d):
    """SNK-08: English documents have lost their law."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("lang") == "en", "UNKNOWN").otherwise(F.col("source")).alias("law_id"), F.regexp_replace("text", r"\d", "").alias("content"))
    return corpus.heal_unknown(rows, {"idiot": "A-1", "worthless": "B-2"}).select("id", "law_id")


@query("""SELECT n.n_name AS raw, CASE WHEN n.n_nationkey % 4 <> 3 THEN 'LAW-' || n.n_nationkey ELSE coalesce((SELECT min('LAW-' || r.n_nationkey) FROM nation r WHERE r.n_nationkey % 4 <> 3 AND (contains(n.n_name, r.n_name) OR contains(r.n_name, n.n_name))), n.n_name) END AS law_id FROM nation n""")
def law_resolution(spark, d):
    """SCA-17: nation names against a registry of three quarters of them."""
    n = table(spark, d, "nation")
    registry = n.where("n_nationkey % 4 <> 3").select(F.concat(F.lit("LAW-"), F.col("n_nationkey")).alias("law_id"), F.concat(F.lit("Z"), F.col("n_nationkey"), F.lit("_")).alias("code"), F.col("n_name").alias("title"))
    return corpus.resolve_laws(n.select(F.col("n_name").alias("raw")), registry).select("raw", "law_id")


@query("SELECT 'customer' AS table_name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lineitem', count(*) FROM lineitem")
def table_counts(spark, d):
    """SNK-13."""
    return corpus.table_counts(**{n: table(spark, d, n) for n in ("customer", "orders", "lineitem")})


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def missing_vectors(spark, d):
    """JOI-21."""
    return corpus.missing_vectors(_chunks(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))).select("id")


# --- verdicts ---------------------------------------------------------------------------------------------------------


def _verdicts(spark, d) -> DataFrame:
    e = table(spark, d, "events")
    status = F.when(F.col("value") < 10, "UNVERIFIED").when(F.col("value") < 40, "CONFIRMED").otherwise("CONTRADICTED")
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "purchase", "high").when(F.col("event_type") == "click", "medium").otherwise("low")
    rank = F.when(F.col("event_id") % 13 < 11, 1 + F.col("event_id") % 13)
    return e.select("user_id", F.concat(F.when(F.col("event_id") % 17 == 0, "structural_").otherwise("claim_"), F.col("event_id")).alias("claim_id"), "event_id", status.alias("status"), severity.alias("severity"), rank.alias("best_rank"), F.least(F.lit(1.0), F.col("value") / 50).alias("bm25_score"))


_VERDICTS_SQL = """v AS (SELECT user_id, event_id, (CASE WHEN event_id % 17 = 0 THEN 'structural_' ELSE 'claim_' END) || event_id AS claim_id, CASE WHEN value < 10 THEN 'UNVERIFIED' WHEN value < 40 THEN 'CONFIRMED' ELSE 'CONTRADICTED' END AS status,
 CASE event_type WHEN 'error' THEN 'critical' WHEN 'purchase' THEN 'high' WHEN 'click' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN event_id % 13 < 11 THEN 1 + event_id % 13 END AS r, least(1.0, value / 50) AS bm25 FROM events)"""


@query(f"""WITH {_VERDICTS_SQL}, w AS (SELECT *, CASE severity WHEN 'critical' THEN 3.0 WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.0 ELSE 0.5 END::DOUBLE AS w, CASE WHEN r IS NULL THEN 0.5 WHEN r <= 3 THEN 1.0 WHEN r <= 6 THEN 0.8 WHEN r <= 9 THEN 0.5 ELSE 0.2 END::DOUBLE AS c,
  CASE severity WHEN 'critical' THEN 0.08 WHEN 'high' THEN 0.05 WHEN 'medium' THEN 0.03 ELSE 0.01 END::DOUBLE AS p FROM v WHERE claim_id NOT LIKE 'structural%'),
a AS (SELECT user_id, count(*) AS n_total, count(*) FILTER (WHERE status = 'CONFIRMED') AS n_confirmed, count(*) FILTER (WHERE status = 'CONTRADICTED') AS n_contradicted, count(*) FILTER (WHERE status = 'UNVERIFIED') AS n_unverified,
  count(*) FILTER (WHERE status = 'UNVERIFIED' AND severity IN ('critical', 'high')) AS n_unverified_risks, count(*) FILTER (WHERE status = 'CONFIRMED' AND r IS NOT NULL) AS n_real,
  coalesce(sum(w * c) FILTER (WHERE status = 'CONFIRMED'), 0) / sum(w) AS v, coalesce(avg(c) FILTER (WHERE status = 'CONFIRMED'), 0) AS q, greatest(0, least(1, coalesce(avg(bm25) FILTER (WHERE status = 'CONFIRMED'), 0.5))) AS t, least(0.85, coalesce(sum(p) FILTER (WHERE status = 'CONTRADICTED'), 0)) AS p FROM w GROUP BY user_id)
SELECT user_id, n_total, n_confirmed, n_contradicted, n_unverified, n_unverified_risks, CASE WHEN n_total <= 2 AND n_unverified = n_total THEN NULL ELSE round(greatest(CASE WHEN n_real > 0 THEN 0.05 ELSE 0 END, least(1, (0.5 * v + 0.3 * q + 0.2 * t) * (1 - p))), 6) END AS reliability FROM a""")
def reliability_score(spark, d):
    """AGG-01..06."""
    out = audit.reliability(_verdicts(spark, d), ["user_id"])
    return out.select("user_id", "n_total", "n_confirmed", "n_contradicted", "n_unverified", "n_unverified_risks", F.round("reliability", 6).alias("reliability"))


@query(f"""WITH {_VERDICTS_SQL} SELECT user_id, count(*) AS total, count(*) FILTER (WHERE status = 'CONFIRMED') AS confirmed, trunc((count(*) FILTER (WHERE status <> 'UNVERIFIED')) / count(*) * 100)::BIGINT AS coverage_pct FROM v GROUP BY user_id""")
def executive_summary(spark, d):
    """AGG-09."""
    return report.executive_summary(_verdicts(spark, d), ["user_id"]).select("user_id", "total", "confirmed", F.col("coverage_pct").cast("long").alias("coverage_pct"))


@query(f"""WITH {_VERDICTS_SQL}, f AS (SELECT *, CASE WHEN status = 'CONTRADICTED' THEN 'LOW' ELSE CASE event_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'LOW' ELSE 'UNVERIFIED' END END AS state, CASE WHEN status = 'CONTRADICTED' THEN 0 ELSE bm25 END AS s FROM v)
SELECT claim_id, CASE WHEN status = 'CONTRADICTED' THEN status WHEN state IN ('LOW', 'UNVERIFIED') AND status = 'CONFIRMED' THEN 'UNVERIFIED' WHEN state IN ('HIGH', 'MEDIUM') AND status = 'UNVERIFIED' AND s >= CASE WHEN state = 'HIGH' THEN 0.4 ELSE 0.6 END THEN 'CONFIRMED' ELSE status END AS status, state AS fact_status FROM f""")
def verdict_sync(spark, d):
    """VRD-10."""
    v = _verdicts(spark, d).withColumns({"confidence": F.lit("LOW"), "source_ids": F.array(F.lit("UNLINKED"))})
    m = F.col("event_id") % 4
    facts = v.select("claim_id", F.when(m == 0, "HIGH").when(m == 1, "MEDIUM").when(m == 2, "LOW").otherwise("UNVERIFIED").alias("validation_status"), "bm25_score", F.array(F.lit("x")).alias("source_ids"))
    facts = audit.sync_facts(facts, v, ["claim_id"])
    out = audit.sync_verdicts(v, facts, ["claim_id"])
    return out.select("claim_id", "status").join(facts.select("claim_id", F.col("validation_status").alias("fact_status")), "claim_id")


@query("""WITH c AS (SELECT l_orderkey AS k, l_returnflag AS unit, l_quantity AS v FROM lineitem WHERE l_linenumber % 2 = 1), s AS (SELECT l_orderkey AS k, l_returnflag AS unit, list_distinct(list(l_quantity)) AS h FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2)
SELECT k AS l_orderkey, bool_and(h IS NULL OR len(list_filter(h, lambda x: x = v OR abs(v - x) / greatest(abs(x), 0.001) < 0.05)) > 0) AS arithmetic_ok FROM c LEFT JOIN s USING (k, unit) GROUP BY k""")
def arithmetic_check(spark, d):
    """VRD-09."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("unit"), F.col("l_quantity").alias("value"), "l_linenumber")
    return audit.arithmetic(l.where("l_linenumber % 2 = 1"), l.where("l_linenumber % 2 = 0"), ["l_orderkey"])


def _linked(spark, d) -> tuple[DataFrame, DataFrame]:
    i = F.col("item_id")
    none = F.lit(None).cast("string")
    ids = F.array_compact(F.array(i.cast("string"), (i * 7).cast("string"), F.when(i % 3 == 0, "UNLINKED").otherwise(none), F.when(i % 4 == 0, F.concat(F.lit("x"), i)).otherwise(none)))
    v = table(spark, d, "benchmark").select("item_id", ids.alias("source_ids"), F.lit("CONFIRMED").alias("status"), (i % 5 == 0).alias("is_deterministic"), F.lit("HIGH").alias("confidence"))
    doc = F.col("doc_id")
    chunks = table(spark, d, "documents").select(doc.cast("string").alias("id"), F.when(doc % 2 == 0, F.col("source")).alias("law_id"), F.when(doc % 5 == 1, "TIER_1").when(doc % 5 == 2, "TIER_3").alias("web_tier"), (1 + doc % 11).cast("int").alias("legal_rank"))
    return v, chunks


_LINKED_SQL = """s AS (SELECT item_id, unnest([1, 2, 3, 4]) AS pos, unnest([item_id::VARCHAR, (item_id * 7)::VARCHAR, CASE WHEN item_id % 3 = 0 THEN 'UNLINKED' END, CASE WHEN item_id % 4 = 0 THEN 'x' || item_id END]) AS sid FROM benchmark),
  ch AS (SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 2 = 0 THEN source END AS law_id, CASE doc_id % 5 WHEN 1 THEN 'TIER_1' WHEN 2 THEN 'TIER_3' END AS tier, 1 + doc_id % 11 AS r FROM documents),
  kept AS (SELECT item_id, pos, sid, id, r FROM s LEFT JOIN ch ON ch.id = sid WHERE sid IS NOT NULL AND (sid = 'UNLINKED' OR id IS NULL OR law_id IS NOT NULL OR coalesce(tier IN ('TIER_1', 'TIER_2'), false)))"""


@query(f"""WITH {_LINKED_SQL} SELECT b.item_id, coalesce(string_agg(sid, ',' ORDER BY pos), '') AS source_ids,
 CASE WHEN b.item_id % 5 <> 0 AND count(id) = 0 AND count(*) FILTER (WHERE sid = 'UNLINKED') = 0 THEN 'UNVERIFIED' ELSE 'CONFIRMED' END AS status FROM benchmark b LEFT JOIN kept USING (item_id) GROUP BY b.item_id""")
def source_filter(spark, d):
    """FLT-05, FLT-06."""
    v, chunks = _linked(spark, d)
    out = audit.downgrade_unsupported(audit.filter_sources(v, chunks, ["item_id"]), chunks, ["item_id"])
    return out.select("item_id", F.array_join("source_ids", ",").alias("source_ids"), "status")


@query(f"""WITH {_LINKED_SQL} SELECT item_id, least(11, coalesce(min(ch.r), 11))::BIGINT AS best_rank FROM s LEFT JOIN ch ON ch.id = sid WHERE sid IS NOT NULL AND sid <> 'UNLINKED' GROUP BY item_id""")
def authority_rank(spark, d):
    """AGG-02: the strongest rank of the real sources."""
    v, chunks = _linked(spark, d)
    return audit.best_rank(v, chunks, ["item_id"]).where("best_rank is not null").select("item_id", F.col("best_rank").cast("long").alias("best_rank"))


@query("""WITH s AS (SELECT item_id, unnest([item_id, item_id * 7]) AS id FROM benchmark) SELECT b.item_id, coalesce(bool_or(d.doc_id IS NOT NULL AND upper(d.source) = 'SRC' || (b.item_id % 20)), false) AS topology_ok FROM benchmark b JOIN s USING (item_id) LEFT JOIN documents d ON d.doc_id = s.id GROUP BY b.item_id""")
def topology_check(spark, d):
    """FLT-07 without the cross-domain words, which these tables lack."""
    i = F.col("item_id")
    facts = table(spark, d, "benchmark").select("item_id", F.col("text").alias("claim_text"), F.array(F.concat(F.lit("SRC"), i % 20)).alias("laws"), F.array(i.cast("string"), (i * 7).cast("string")).alias("source_ids"))
    return audit.topology(facts, _chunks(spark, d).withColumn("id", F.col("id").cast("string")), ["item_id"])


@query("""SELECT d.doc_id AS claim_id, CASE WHEN l.doc_id IS NULL THEN 'UNVERIFIED' WHEN toxic = 1 THEN 'CONTRADICTED' ELSE 'CONFIRMED' END AS status, CASE WHEN l.doc_id IS NULL THEN substr(text, 1, 100) END AS document_value FROM documents d LEFT JOIN labels l USING (doc_id)""")
def coverage_backfill(spark, d):
    """JOI-13."""
    one = F.lit(1).alias("analysis")
    asked = table(spark, d, "documents").select(one, F.col("doc_id").alias("claim_id"), F.lit("low").alias("severity"), F.col("text").alias("claim_text"))
    v = table(spark, d, "labels").select(one, F.col("doc_id").alias("claim_id"), F.when(F.col("toxic") == 1, "CONTRADICTED").otherwise("CONFIRMED").alias("status"))
    return audit.backfill(v, asked, ["analysis"]).select("claim_id", "status", "document_value")


@query("""WITH v AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'CONTRADICTED' ELSE 'CONFIRMED' END AS status, event_id % 50 AS claim, CASE event_id % 3 WHEN 0 THEN 'спор о коап' WHEN 1 THEN 'Срок 24 часа' ELSE 'Сумма' END AS detail FROM events),
f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, claim ORDER BY event_id) AS r FROM v WHERE status = 'CONTRADICTED') WHERE r = 1)
SELECT user_id, 'conflict_' || lpad((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::VARCHAR, 4, '0') AS record_id, claim::VARCHAR AS claim_id, CASE event_id % 3 WHEN 0 THEN 'HIERARCHY' WHEN 1 THEN 'TEMPORAL' ELSE 'FACTUAL' END AS conflict_type FROM f""")
def conflict_records(spark, d):
    """VRD-12, DED-08."""
    k = F.col("event_id") % 3
    v = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", "CONTRADICTED").otherwise("CONFIRMED").alias("status"), (F.col("event_id") % 50).cast("string").alias("claim_id"), F.when(k == 0, "спор о коап").when(k == 1, "Срок 24 часа").otherwise("Сумма").alias("contradiction_detail"))
    return audit.conflict_records(v, ["user_id"], "event_id").select("user_id", "record_id", "claim_id", "conflict_type")


@query("""WITH r AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'CONTRADICTED' WHEN 'view' THEN 'CONFIRMED' ELSE 'UNVERIFIED' END AS status, event_id % 7 AS c FROM events),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id, c ORDER BY event_id) AS n FROM r WHERE c < 5) SELECT user_id, 'c' || c AS claim_id, status, CASE WHEN event_id % 2 = 0 THEN 'S1' ELSE '' END AS source_ids FROM f WHERE n = 1""")
def parse_verdicts(spark, d):
    """VRD-02, DED-09: JSON answers, the first for each known claim."""
    e = table(spark, d, "events")
    said = F.when(F.col("event_type") == "error", "contradicted!").when(F.col("event_type") == "view", "Confirmed").otherwise("?")
    body = F.to_json(F.struct(F.concat(F.lit("c"), F.col("event_id") % 7).alias("claim_id"), said.alias("status"), F.when(F.col("event_id") % 2 == 0, F.array(F.lit("S1"))).otherwise(F.array().cast("array<string>")).alias("source_ids")))
    raw = e.select("user_id", F.col("event_id").alias("seq"), body.alias("json"))
    known = e.select("user_id").distinct().withColumn("claim_id", F.explode(F.array(*[F.lit(f"c{i}") for i in range(5)]))).withColumn("severity", F.lit("low"))
    return audit.parse_verdicts(raw, known, ["user_id"]).select("user_id", "claim_id", "status", F.array_join("source_ids", ",").alias("source_ids"))


@query("""WITH l AS (SELECT source, 'S' || row_number() OVER (PARTITION BY source ORDER BY doc_id) AS label, doc_id FROM documents), i AS (SELECT item_id, 'src' || (item_id % 20) AS source FROM benchmark)
SELECT i.item_id, concat_ws(',', a.doc_id::VARCHAR, 'UNLINKED', b.doc_id::VARCHAR) AS source_ids FROM i LEFT JOIN l a ON a.source = i.source AND a.label = 'S' || (item_id % 9 + 1) LEFT JOIN l b ON b.source = i.source AND b.label = 'S99999'""")
def remap_labels(spark, d):
    """JOI-14."""
    i = F.col("item_id")
    v = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("src"), i % 20).alias("source"), F.array(F.concat(F.lit("S"), i % 9 + 1), F.lit("UNLINKED"), F.lit("S99999")).alias("source_ids"))
    labels = table(spark, d, "documents").withColumn("label", F.concat(F.lit("S"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")))).select("source", "label", F.col("doc_id").cast("string").alias("id"))
    return audit.remap_labels(v, labels, ["item_id"], ["source"]).select("item_id", F.array_join("source_ids", ",").alias("source_ids"))


@query()
def verify_contradictions(spark, d):
    """VRD-03, VRD-04: whole texts as values, without their first word as found values; rules are tested on fixtures."""
    i = F.col("item_id")
    v = table(spark, d, "benchmark").select("item_id", F.lit("CONTRADICTED").alias("status"), F.array((i * 3).cast("string")).alias("source_ids"), (i % 7 == 0).alias("is_deterministic"), F.col("text").alias("document_value"), F.regexp_replace("text", r"^\S+\s+", "").alias("found_value"), F.col("text").alias("contradiction_detail"))
    return audit.verify_contradictions(v, _chunks(spark, d).withColumn("id", F.col("id").cast("string")), ["item_id"]).select("item_id", "status", "rule")


@query("""WITH c AS (SELECT item_id, [item_id::VARCHAR] AS s, [item_id * 2, item_id * 50] AS f FROM benchmark) SELECT item_id AS conclusion_id, CASE WHEN item_id NOT IN (SELECT doc_id FROM documents) THEN 'UNVERIFIED' WHEN len(list_filter(f, lambda x: x >= 400)) > 0 THEN 'LOW' ELSE 'MEDIUM' END AS validation_status FROM c""")
def conclusions_status(spark, d):
    """VRD-11: facts are the numbers below 400."""
    i = F.col("item_id")
    c = table(spark, d, "benchmark").select(i.alias("conclusion_id"), F.array(i.cast("string")).alias("source_ids"), F.array(i * 2, i * 50).alias("supporting_fact_ids"))
    return audit.conclusions_status(c, _chunks(spark, d).withColumn("id", F.col("id").cast("string")), spark.range(400).withColumnRenamed("id", "fact_id")).select("conclusion_id", "validation_status")


# --- claims -----------------------------------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_returnflag, array_to_string(list_sort(list(DISTINCT l_quantity::INT)), ' vs ') AS deadlines FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_quantity::INT) >= 2""")
def deadline_collisions(spark, d):
    """AGG-14 on lines: several quantities under one order and flag."""
    return claims.collisions(table(spark, d, "lineitem").withColumn("value", F.col("l_quantity").cast("int")), ["l_orderkey", "l_returnflag"])


@query("SELECT doc_id, 'claim_0000' AS claim_id, 'fine_mrp' AS tag, '500' AS entity, NULL::VARCHAR AS deterministic_status FROM documents UNION ALL SELECT doc_id, 'claim_0001', 'law_id', '87-IV', 'CONTRADICTED' FROM documents")
def extract_claims(spark, d):
    """SCA-08, VRD-01 over whole texts after two made lines; the texts hold no Cyrillic of their own."""
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("влечет штраф в размере 500 МРП\nпо № 87-IV\n"), F.coalesce("text", F.lit(""))).alias("text"))
    return claims.check_entities(claims.extract_claims(docs), docs).select("doc_id", "claim_id", "tag", "entity", "deterministic_status")


@query("""SELECT lang, source AS kind, array_to_string(list_sort(list(DISTINCT (doc_id % 9)::VARCHAR)), ',') AS entities, count(DISTINCT doc_id % 9) AS n_entities, count(*) AS n FROM documents GROUP BY 1, 2""")
def structural_checklist(spark, d):
    """AGG-18."""
    rows = table(spark, d, "documents").select("lang", F.col("source").alias("kind"), (F.col("doc_id") % 9).cast("string").alias("entity"))
    return report.structural_checklist(rows, ["lang"], "kind", "entity")


# --- report and evaluation --------------------------------------------------------------------------------------------


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY source, n_chars % 50, lang ORDER BY doc_id) AS r, 1 + length(source) AS rank FROM documents)
SELECT rank::BIGINT AS legal_rank, source AS law, string_agg(lang, ',' ORDER BY doc_id) AS refs, count(*) AS n_refs FROM c WHERE r = 1 GROUP BY 1, 2""")
def normative_base(spark, d):
    """AGG-10, DED-06."""
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("law_id"), F.lit(None).cast("string").alias("source_title"), (F.col("n_chars") % 50).alias("source_url"), F.col("lang").alias("article"), (1 + F.length("source")).cast("long").alias("legal_rank"))
    return report.normative_base(rows, "doc_id", [])


@query("SELECT md5(text) AS title_md5, array_to_string(list_sort(list(DISTINCT source)), ',') AS law_ids, count(DISTINCT source) AS n_laws FROM documents WHERE text IS NOT NULL AND source IS NOT NULL GROUP BY text HAVING count(DISTINCT source) > 1")
def grounding_integrity(spark, d):
    """AGG-11: whole texts as titles, copies under several sources."""
    out = report.grounding_integrity(table(spark, d, "documents").select(F.col("text").alias("source_title"), F.col("source").alias("law_id")))
    return out.select(F.md5(F.col("source_title").cast("binary")).alias("title_md5"), "law_ids", "n_laws")


@query("""SELECT source, count(*) AS n_chunks, count(DISTINCT lang) AS n_articles, arg_min(t, doc_id) FILTER (WHERE t <> '') AS title FROM (SELECT *, CASE WHEN doc_id % 2 = 0 THEN '' ELSE lang || '-' || (doc_id % 5) END AS t FROM documents) GROUP BY source""")
def law_summary(spark, d):
    """AGG-12, AGG-13."""
    rows = table(spark, d, "documents").withColumns({"article": F.col("lang"), "t": F.when(F.col("doc_id") % 2 == 0, "").otherwise(F.concat("lang", F.lit("-"), F.col("doc_id") % 5))})
    return report.law_summary(rows, ["source"], "t", "doc_id")


@query()
def report_markdown(spark, d):
    """SNK-10, SNK-14, AGG-07."""
    v = _verdicts(spark, d)
    stats = audit.recommendation(audit.reliability(v, ["user_id"])).withColumnsRenamed({"n_total": "total", "n_confirmed": "confirmed", "n_contradicted": "contradicted", "n_unverified": "unverified"})
    conflicts = audit.conflict_records(v.withColumn("contradiction_detail", F.col("severity")), ["user_id"], "event_id").withColumn("claim_text", F.col("claim_id"))
    facts = v.select("user_id", F.col("event_id").cast("string").alias("fact_id"), "claim_id", F.concat(F.lit("Факт "), F.col("claim_id")).alias("claim"), search.status(F.col("bm25_score")).alias("validation_status"))
    out = report.render_report(stats, conflicts, facts, "user_id")
    return out.select("user_id", F.length("markdown").cast("long").alias("n_chars"), T.content_id(F.col("markdown")).alias("content_id"))


@query("""WITH c AS (SELECT 'nation' AS source, n_regionkey AS law_id, n_nationkey AS code FROM nation UNION ALL SELECT 'customer', c_nationkey % 5, c_nationkey FROM customer UNION ALL SELECT 'supplier', s_nationkey % 5, s_nationkey FROM supplier)
SELECT law_id, count(DISTINCT code) AS n_codes, count(DISTINCT source) AS n_sources, count(DISTINCT code) > 1 AS drift FROM c GROUP BY law_id""")
def drift_check(spark, d):
    """JOI-16."""
    n = table(spark, d, "nation").select(F.lit("nation").alias("source"), F.col("n_regionkey").alias("law_id"), F.col("n_nationkey").alias("code"))
    c = table(spark, d, "customer").select(F.lit("customer").alias("source"), (F.col("c_nationkey") % 5).alias("law_id"), F.col("c_nationkey").alias("code"))
    s = table(spark, d, "supplier").select(F.lit("supplier").alias("source"), (F.col("s_nationkey") % 5).alias("law_id"), F.col("s_nationkey").alias("code"))
    return evaluation.drift(n.unionByName(c).unionByName(s))


@query("""WITH c AS (SELECT DISTINCT c_nationkey AS law_id, c_mktsegment AS article FROM customer WHERE c_custkey % 3 = 0), s AS (SELECT DISTINCT c_nationkey AS law_id, c_mktsegment AS article FROM customer WHERE c_custkey % 2 = 0)
SELECT law_id, count(*) FILTER (WHERE s.law_id IS NULL) AS missing, count(*) FILTER (WHERE s.law_id IS NOT NULL AND c.law_id IS NOT NULL) AS covered,
CASE WHEN count(s.law_id) > 0 THEN trunc(count(*) FILTER (WHERE s.law_id IS NOT NULL AND c.law_id IS NOT NULL) / count(s.law_id) * 100)::INT ELSE 0 END AS coverage_pct FROM c FULL JOIN s USING (law_id, article) GROUP BY law_id""")
def article_coverage(spark, d):
    """JOI-17."""
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("law_id"), F.col("c_mktsegment").alias("article"))
    return evaluation.article_coverage(c.where("c_custkey % 3 = 0"), c.where("c_custkey % 2 = 0"))


@query("""WITH b AS (SELECT n_nationkey AS law_id, 0.0 AS rate FROM nation WHERE n_nationkey % 2 = 0), f AS (SELECT n_nationkey AS law_id, CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 3 = 0 THEN 0.1 ELSE 0.0 END AS rate FROM nation WHERE n_nationkey % 7 <> 0)
SELECT coalesce(b.law_id, f.law_id) AS law_id, CASE WHEN f.law_id IS NULL THEN 'SKIP' WHEN f.rate IS NULL OR f.rate > 0 OR f.rate > coalesce(b.rate, 0) THEN 'FAIL' ELSE 'PASS' END AS verdict FROM b FULL JOIN f ON b.law_id = f.law_id""")
def baseline_gate(spark, d):
    """JOI-18."""
    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    fresh = n.where(k % 7 != 0).select(k.alias("law_id"), F.when(k % 5 == 0, None).when(k % 3 == 0, 0.1).otherwise(0.0).alias("rate"))
    return evaluation.gate(n.where(k % 2 == 0).select(k.alias("law_id"), F.lit(0.0).alias("rate")), fresh)


@query("""WITH c AS (SELECT l_partkey AS law, l_linenumber AS article, l_orderkey, l_suppkey FROM lineitem), i AS (SELECT DISTINCT law, article FROM c WHERE l_orderkey % 4 = 0),
r AS (SELECT l_suppkey, count(*) AS n_claims, count(i.law) AS n_grounded FROM c LEFT JOIN i USING (law, article) WHERE l_orderkey % 4 <> 0 GROUP BY l_suppkey)
SELECT l_suppkey, n_claims, round(n_grounded / n_claims, 3) AS grounding_rate FROM r""")
def grounding_rates(spark, d):
    """JOI-19, AGG-15."""
    c = table(spark, d, "lineitem").select(F.col("l_partkey").alias("law"), F.col("l_linenumber").alias("article"), "l_orderkey", "l_suppkey")
    g = evaluation.grounding(c.where("l_orderkey % 4 <> 0"), c.where("l_orderkey % 4 = 0"), ["l_suppkey"])
    per = g.groupBy("l_suppkey").agg(F.count("*").alias("n_claims"), F.count_if("grounded").alias("n_grounded")).withColumns({"n_false": F.lit(0), "n_mutated": F.lit(0), "stable": F.lit(True)})
    return evaluation.eval_aggregate(per, ["l_suppkey"]).select("l_suppkey", "n_claims", "grounding_rate")


@query(r"""WITH t AS (SELECT o_orderkey, (o_orderkey % 900 + 10)::VARCHAR AS n FROM orders) SELECT o_orderkey, CASE WHEN n <> substr(n, 1, length(n) - 2) || substr(n, length(n), 1) || substr(n, length(n) - 1, 1) THEN substr(n, 1, length(n) - 2) || substr(n, length(n), 1) || substr(n, length(n) - 1, 1) ELSE (n::BIGINT + 1)::VARCHAR END || '-IV' AS mutated FROM t""")
def mutate_laws(spark, d):
    """VRD-14."""
    return table(spark, d, "orders").select("o_orderkey", evaluation.mutate_law(F.concat((F.col("o_orderkey") % 900 + 10).cast("string"), F.lit("-IV"))).alias("mutated"))


# --- event log --------------------------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), c AS (SELECT * FROM p WHERE prev IS DISTINCT FROM event_type)
SELECT user_id, event_id, 'stage_done' AS event, prev AS stage FROM c WHERE prev IS NOT NULL UNION ALL SELECT user_id, event_id, 'stage_start', event_type FROM c""")
def progress_fold(spark, d):
    """EVT-01."""
    return ev.progress_fold(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("user_id", "event_id", "event", "stage")


@query("SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def job_latest(spark, d):
    """EVT-04, SNK-12."""
    return ev.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", F.col("event_type").alias("status"), "event_id")


@query("SELECT user_id, CASE WHEN event_type = 'view' THEN 'error' ELSE event_type END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def job_reconcile(spark, d):
    """EVT-04: a view stands for a running job."""
    jobs = ev.latest(table(spark, d, "events"), "user_id", ["ts", "event_id"]).select("user_id", F.when(F.col("event_type") == "view", "running").otherwise(F.col("event_type")).alias("status"))
    return ev.reconcile(jobs)


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY ts, event_id) AS events FROM events GROUP BY user_id")
def event_replay(spark, d):
    """EVT-02."""
    out = ev.replay(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    return out.select("user_id", F.array_join("events", ",").alias("events"))


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
r AS (SELECT user_id, event_id, n, t, true AS accepted, [t] AS kept FROM e WHERE n = 1 UNION ALL
 SELECT e.user_id, e.event_id, e.n, e.t, len(list_filter(r.kept, lambda x: x > e.t - 86400)) < 2, CASE WHEN len(list_filter(r.kept, lambda x: x > e.t - 86400)) < 2 THEN list_append(list_filter(r.kept, lambda x: x > e.t - 86400), e.t) ELSE list_filter(r.kept, lambda x: x > e.t - 86400) END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
SELECT user_id, event_id, accepted FROM r""")
def rate_limit(spark, d):
    """EVT-03: two accepted hits a day."""
    return ev.rate_limit(table(spark, d, "events"), "user_id", "ts", "event_id", 2, 86_400).select("user_id", "event_id", "accepted")


@query("""WITH f AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error'), s AS (SELECT unnest(['view', 'click', 'purchase', 'signup', 'refund']) AS event_type)
SELECT user_id, event_type, 'stage_error' AS event FROM f, s WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = f.user_id AND e.event_type = s.event_type)""")
def unsent_stages(spark, d):
    """EVT-05."""
    e = table(spark, d, "events").withColumn("status", F.when(F.col("event_type") == "error", "error"))
    stages = spark.createDataFrame([("view",), ("click",), ("purchase",), ("signup",), ("refund",)], "event_type string")
    return ev.unsent_stages(e, stages, "user_id", "event_type").select("user_id", "event_type", "event")
