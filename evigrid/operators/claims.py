"""Claims: pattern extraction, classification, de-duplication and self-checks of a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T

#: SCA-08: (pattern, claim type, severity, tag) in order; group 1 is the entity. Fixed values of the extraction.
PATTERNS = (
    (r"(?iuU)(?:Закон\w*|Кодекс\w*|ЗРК|Заңы*|ҚРЗ)\s+[^№]*?№\s*(\d{2,4}[-‐–]\w{1,5}(?:\s*(?:ЗРК|ҚРЗ))?)", "legal_id", "critical", "law_id"),
    (r"(?iuU)№\s*(\d{2,4}[-‐–][IVXivxІі]{1,5}(?:\s*(?:ЗРК|ҚРЗ))?)\b", "legal_id", "critical", "law_id"),
    (r"(?iuU)стать[яиею]\s*(\d+(?:[-.]?\d+)?)\s*КоАП", "legal_ref", "critical", "koap_article"),
    (r"(?iuU)ӘҚБтК\w*\s*(?:-\s*)?(\d+(?:[-.\d]+)?)\s*(?:-|–)?\s*(?:бап|бабы|бабында|бапта|баптың|бабының)", "legal_ref", "critical", "koap_article"),
    (r"(?iuU)(\d+(?:[-.\d]+)?)\s*(?:-|–)?\s*(?:бап|бабы|бабында|бапта|баптың|бабының)(?:[^0-9\n]*?)ӘҚБтК", "legal_ref", "critical", "koap_article"),
    (r"(?iuU)стать[яиеюй]\w?\s+(\d+(?:[-.]?\d+)?)\s+(?:Уголовн\w+\s+[Кк]одекс\w*|УК)", "legal_ref", "critical", "uk_article"),
    (r"(?iuU)ҚК\w*\s*(?:-\s*)?(\d+(?:[-.\d]+)?)\s*(?:-|–)?\s*(?:бап|бабы|бабында|бапта|баптың|бабының)", "legal_ref", "critical", "uk_article"),
    (r"(?iuU)(\d+(?:[-.\d]+)?)\s*(?:-|–)?\s*(?:бап|бабы|бабында|бапта|баптың|бабының)(?:[^0-9\n]*?)ҚК", "legal_ref", "critical", "uk_article"),
    (r"(?iuU)(?:в\s+)?стать[яиеюй]\w?\s+(\d+(?:[-.]?\d+)?)\b(?!\s*(?:КоАП|ӘҚБтК|УК|ҚК))", "legal_ref", "high", "article_ref"),
    (r"(?iuU)(\d+(?:[-.\d]+)?)\s*(?:-|–)?\s*(?:бап|бабы|бабында|бапта|баптың|бабының)\b(?!\s*(?:КоАП|ӘҚБтК|УК|ҚК))", "legal_ref", "high", "article_ref"),
    (r"(?iuU)(?:ППРК|Постановлени[яею]\s+Правительства)[^№]*№?\s*(\d+)", "legal_ref", "critical", "pprkz_num"),
    (r"(?iuU)(\d[\d\s]*)\s*(?:\([^)]*\)\s*)?(?:МРП|АЕК)", "financial", "critical", "fine_mrp"),
    (r"(?iuU)айлық\s+есептік\s+көрсеткіш\w*\s*(?:дегеніміз\s*)?(\d[\d\s]*)\s*(?:\([^)]*\)\s*)?(?:еселенген|еселі|мөлшер)", "financial", "critical", "fine_mrp"),
    (r"(?iuU)(?:МРП|АЕК)[^.]*?(\d[\d\s]+)\s*тенге", "financial", "high", "mrp_value"),
    (r"(?iuU)(?:в\s*течени[ие]|не\s*позднее)\s*(\d+)\s*(?:\([^)]*\)\s*)?час", "temporal", "high", "hours_deadline"),
    (r"(?iuU)в\s*течени[ие]\s*(\d+)\s*рабочих\s*дн", "temporal", "high", "workdays_deadline"),
    (r"(?iuU)(\d+)\s*жұмыс\s*күні\s*ішінде", "temporal", "high", "workdays_deadline"),
    (r"(?iuU)с\s+(\d{1,2}\s+\w+\s+\d{4})\s*года", "temporal", "high", "effective_date"),
    (r"(?iuU)вводится\s+в\s+действие\s+(.*?(?:дня|после))", "temporal", "high", "enforcement_date"),
    (r"(?iuU)қолданысқа\s+енгізіледі\s+(.*?(?:бастап|кейін))", "temporal", "high", "enforcement_date"),
    (r"(?iuU)қолданысқа\s+енгiзiледi\s+(.*?(?:бастап|кейін))", "temporal", "high", "enforcement_date"),
)


def extract_claims(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCA-08: (doc_id, claim_id, claim_text, quote, claim_type, severity, tag, entity), by line, pattern and match.

    The pattern table is a literal array, so one pass over the lines makes all matches. Equal claim texts of a document
    count once; then table rows with a numeric second cell where the text mentions MRP.
    """
    table = F.array(*[F.struct(F.lit(i).alias("p"), F.lit(t).alias("type"), F.lit(s).alias("severity"), F.lit(g).alias("tag")) for i, (_, t, s, g) in enumerate(PATTERNS)])
    lines = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).rlike("(?iu)МРП").alias("mrp"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line"))
    found = F.array(*[F.regexp_extract_all("line", F.lit(p), F.lit(1)) for p, *_ in PATTERNS])
    hits = lines.withColumn("m", F.explode(F.arrays_zip(table.alias("t"), found.alias("f")))).select("doc_id", "line_no", "line", "m.t.*", F.posexplode("m.f").alias("k", "raw"))
    flat = F.translate(F.trim("raw"), "‑‐Іі", "--Ii")
    entity = F.when(F.col("tag").isin("enforcement_date", "effective_date"), F.regexp_replace(flat, r"\s+", " ")).otherwise(F.regexp_replace(flat, r"\s+", ""))
    claim = F.concat(F.lit("Документ утверждает: "), F.col("tag"), F.lit("="), entity, F.lit(" (строка: «"), F.substring(F.trim("line"), 1, 120), F.lit("»)"))
    found = hits.select("doc_id", F.lit(0).alias("kind"), "line_no", "p", "k", "line", claim.alias("claim_text"), F.col("type").alias("claim_type"), "severity", "tag", entity.alias("entity"))
    cells = F.transform(F.split("line", r"\|"), F.trim)
    value = F.regexp_replace(cells[1], r"\s+", "")
    rows = lines.where(F.col("mrp") & F.col("line").contains("|")).where((F.size(cells) >= 3) & cells[0].rlike(r"^\D") & value.rlike(r"^\d+$"))
    number = F.regexp_replace(value, r"^0+(?=\d)", "")
    tabular = rows.select("doc_id", F.lit(1).alias("kind"), "line_no", F.lit(0).alias("p"), F.lit(0).alias("k"), "line", F.concat(F.lit("Документ утверждает: fine_mrp="), number, F.lit(" (таблица: «"), F.substring(F.trim("line"), 1, 120), F.lit("»)")).alias("claim_text"), F.lit("financial").alias("claim_type"), F.lit("critical").alias("severity"), F.lit("fine_mrp").alias("tag"), number.alias("entity"))
    order = ["kind", "line_no", "p", "k"]
    every = found.unionByName(tabular).withColumn("_rn", F.row_number().over(Window.partitionBy("doc_id", "claim_text").orderBy(*order))).where("_rn = 1")
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return every.select("doc_id", F.concat(F.lit("claim_"), F.lpad(number.cast("string"), 4, "0")).alias("claim_id"), "claim_text", F.substring(F.trim("line"), 1, 200).alias("quote"), "claim_type", "severity", "tag", "entity")


def check_entities(claims: DataFrame, docs: DataFrame, known_articles: DataFrame | None = None) -> DataFrame:
    """VRD-01: deterministic_status of claims by reference data; null where only the corpus can tell.

    known_articles: optional (code, article) registry, one row an article, of the offence (koap) and criminal (uk) codes. A
    known article of the offence code is confirmed, an unknown one unverified; a known one of the criminal code is unverified.
    """
    rows = claims.join(docs.select("doc_id", F.coalesce(F.try_element_at(F.regexp_extract_all("text", F.lit(r"\b(202[0-9])\b"), F.lit(1)), F.lit(-1)).cast("int"), F.lit(2025)).alias("year")), "doc_id", "left")
    mrp = F.create_map(*[F.lit(x) for pair in dims.MRP_BY_YEAR.items() for x in pair])
    value, entity = F.regexp_replace("entity", r"\s", "").try_cast("long"), F.btrim(F.regexp_replace(F.upper("entity"), r"ЗРК|\s", ""), F.lit("-"))
    state = F.when((F.col("tag") == "law_id") & entity.isin(*dims.INVALID_LAWS), "CONTRADICTED")
    state = state.when((F.col("tag") == "pprkz_num") & entity.isin(*dims.INVALID_DECREES), "CONTRADICTED")
    state = state.when((F.col("tag") == "mrp_value") & (value == mrp[F.col("year")]), "CONFIRMED")
    state = state.when((F.col("tag") == "mrp_value") & value.isNotNull() & ~value.isin(*dims.MRP_BY_YEAR.values()) & mrp[F.col("year")].isNotNull(), "CONTRADICTED")
    state = state.when((F.col("tag") == "fine_mrp") & (value > dims.MAX_FINE_MRP) & F.col("quote").rlike(r"(?iuU)ст\.?\s*79\b|перс\w*\s+данны"), "CONTRADICTED")
    if known_articles is not None:
        known = known_articles.select(F.concat(F.col("code"), F.lit("_article")).alias("tag"), F.upper("article").alias("_entity"), F.lit(True).alias("_known")).distinct()
        rows = rows.withColumn("_entity", F.upper("entity")).join(known, ["tag", "_entity"], "left")
        state = state.when(F.col("tag") == "koap_article", F.when(F.col("_known"), "CONFIRMED").otherwise("UNVERIFIED"))
        state = state.when((F.col("tag") == "uk_article") & F.col("_known"), "UNVERIFIED")
    return rows.withColumn("deterministic_status", state).drop("year", "_known", "_entity")


META = (r"(?iu)документ\s+является\s+(?:проектом\s+)?закон", r"(?iu)документ\s+представляет\s+собой", r"(?iuU)это\s+(?:проект\s+)?закон\w*\s+о\s+внесении", r"(?iu)настоящий\s+(?:проект\s+)?закон", r"(?iu)осы\s+заң", r"(?iu)законопроект\s+(?:вносит|направлен|посвящен)")
COMMENCEMENT = ("вводится в действие", "вступает в силу", "вступлении в силу", "по истечении шести месяцев со дня", "по истечении десяти календарных дней", "по истечении одного года со дня", "қолданысқа енгізіледі", "қолданысқа енгiзiледi", "жарияланған күнінен бастап", "алғашқы ресми жарияланған")
AMENDMENT_VERBS = ("дополнить", "исключить", "изложить", "после слов", "словами", "точку заменить", "толықтырылсын", "алып тасталсын", "ауыстырылсын", "сөздерінен кейін")
#: FLT-03, fixed list.
MODAL_VERBS = (
    "обязан", "должен", "запрещается", "влечет", "устанавливается", "предусмотрено", "установлено", "нарушение", "ответственность", "штраф",
    "вводится", "приостанавливается", "прекращается", "возобновляется", "подлежит", "является", "несет", "вправе", "может", "должны",
    "міндетті", "тиіс", "салынады", "әкеп", "соғады", "белгіленеді", "айқындалады", "көзделген", "жауаптылық", "айыппұл", "тоқтатылады", "құқылы", "болады",
)
UNITS = r"(?iu)\b\d+[\s\xa0]*(?:мрп|аек|мзп|тәм|тенге|теңге|часов?|сағат|дней?|күн|күні|месяц|ай|лет|жыл|процент|пайыз|%)"
STRUCTURAL = ("присутствует", "существует", "указано в документе", "содержится в", "в документе упоминается", "статья изложена", "внести изменения в", "изложить в редакции")


def is_meta(text: Column) -> Column:
    """FLT-02."""
    out = F.length(F.trim(text)) < 20
    for p in META:
        out = out | text.rlike(p)
    return out


def is_structural(text: Column, claim_type: Column, deterministic: Column, target_laws: Column) -> Column:
    """FLT-03: ordered rules, the first that applies decides; FLT-04 splits by it."""
    low = F.lower(text)
    plain = ~(deterministic.isNotNull() | (F.size(target_laws) > 0) | low.rlike(r"(?iu)стать[яи]\s*\d+.*[а-яё\s]{10,}"))
    return (
        F.when(T.contains_any(low, COMMENCEMENT), True).when(T.contains_any(low, AMENDMENT_VERBS), False).when(T.contains_any(low, MODAL_VERBS), False)
        .when(low.rlike(UNITS), False).when(claim_type.isin("factual", "normative"), False).when(claim_type == "legal_id", deterministic.isNull())
        .when(claim_type == "legal_ref", plain).otherwise(T.contains_any(low, STRUCTURAL))
    )


EVENTS = (
    ("amnesty", ("амнист", "рақымшылық")), ("consent", ("согласи", "келісім")), ("constitution", ("конституц",)), ("edsig", ("эцп", "цифрлық қолтаңба", "электронн", "электрондық")),
    ("enforcement", ("исполнен", "орындал", "атқарушылық")), ("fine", ("штраф", "айыппұл")), ("notification", ("уведомл", "хабарлам")), ("registry", ("реестр", "тізілім")),
    ("release", ("освобожд", "босату")), ("termination", ("прекращ", "тоқтат")),
)


def semantic_key(claim_text: Column, quote: Column) -> Column:
    """SCA-15: art<number>:<events>, null without either."""
    text = F.lower(F.regexp_replace(claim_text, r"(?s)\(строка:.*?\)", ""))
    article = F.nullif(F.regexp_extract(text, r"(?iu)(?:стать[яиеюй]\s*|ст\.?\s*|(?:^|\s))(\d{1,4}(?:[-]\d{1,3})?)", 1), F.lit(""))
    both = F.lower(F.concat_ws(" ", text, quote))
    events = F.array_join(F.array_compact(F.array(*[F.when(T.contains_any(both, keys), F.lit(name)) for name, keys in EVENTS])), "|")
    return F.nullif(F.concat_ws(":", F.concat(F.lit("art"), article), F.nullif(events, F.lit(""))), F.lit(""))


def claim_key(claims: DataFrame) -> Column:
    """DED-03 key: entities of deterministic claims, else semantic, else normalised text, else the first 40 characters."""
    entities = F.array_join(F.array_sort(F.transform("entities", lambda e: F.upper(F.replace(F.trim(e), F.lit(" "), F.lit(""))))), "_")
    fixed = F.when((F.size("entities") > 0) & F.col("deterministic_verdict").isNotNull(), F.concat(F.lit("regex_"), F.col("claim_type"), F.lit("_"), entities))
    return F.coalesce(fixed, F.concat(F.lit("sem_"), semantic_key(F.col("claim_text"), F.col("quote"))), F.nullif(T.normalise_claim(F.col("claim_text")), F.lit("")), F.substring(F.lower("claim_text"), 1, 40))


def dedup_claims(claims: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """DED-03: the best claim of each key with the other quotes, in order of the group's first claim.

    claims: claim_text, quote, claim_type, entities, target_law_ids, deterministic_verdict and an order column.
    """
    rows = claims.withColumn("_key", claim_key(claims))
    best = Window.partitionBy(*by, "_key").orderBy(F.col("deterministic_verdict").isNotNull().desc(), (F.size("target_law_ids") > 0).desc(), F.size("entities").desc(), F.length("claim_text").desc(), F.col(seq).asc())
    group = Window.partitionBy(*by, "_key")
    rows = rows.withColumn("_rn", F.row_number().over(best)).withColumn("group_seq", F.min(seq).over(group))
    quotes = rows.groupBy(*by, "_key").agg(F.transform(F.array_sort(F.collect_list(F.struct(seq, "quote"))), lambda x: x["quote"]).alias("_quotes"))
    rows = rows.where("_rn = 1").join(quotes, [*by, "_key"])
    return rows.withColumn("quote_variants", F.filter("_quotes", lambda q: (F.coalesce(q, F.lit("")) != "") & ~q.eqNullSafe(F.col("quote")))).drop("_rn", "_quotes", "_key")


def deadline_collisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """AGG-14: (doc_id, article, unit, deadlines 'a vs b') of articles that give different deadlines in one unit."""
    blocks = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.split(text_col, r"(?=\n[Сс]тать[яиею]\s+\d)")).alias("block"))
    article = F.nullif(F.regexp_extract(F.substring("block", 1, 50), r"(?iu)стать[яиею]\s+(\d+(?:[-.]\d+)?)", 1), F.lit(""))
    pattern = F.lit(r"(?iuU)(\d+)\s*(?:\([^)]*\)\s*)?((?:рабочих|календарных)?\s*(?:час\w*|дн\w*|месяц\w*|сут\w*))")
    rows = blocks.select("doc_id", article.alias("article"), F.explode(F.arrays_zip(F.regexp_extract_all("block", pattern, F.lit(1)).alias("v"), F.regexp_extract_all("block", pattern, F.lit(2)).alias("u"))).alias("x")).where("article is not null")
    return collisions(rows.select("doc_id", "article", T.unit_bucket(F.col("x.u")).alias("unit"), F.col("x.v").try_cast("long").alias("value")), ["doc_id", "article", "unit"])


def collisions(values: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with at least two distinct values, and these joined in order."""
    sets = values.groupBy(*keys).agg(F.array_sort(F.collect_set("value")).alias("v")).where(F.size("v") >= 2)
    return sets.select(*keys, F.array_join(F.transform("v", lambda x: x.cast("string")), " vs ").alias("deadlines"))


def chronology(adopted: DataFrame, effective: DataFrame, key: str, distance: int = dims.CHRONOLOGY_DISTANCE) -> DataFrame:
    """JOI-15: effective dates before an adoption date within `distance` characters; (key, pos, date, text) each.

    A band join by buckets of `distance`: a position meets its own bucket and both neighbours.
    """
    a = adopted.select(key, F.col("pos").alias("a_pos"), F.col("date").alias("a_date"), F.col("text").alias("a_text"), F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col("pos") / distance) + k)).alias("bucket"))
    e = effective.select(key, F.col("pos").alias("e_pos"), F.col("date").alias("e_date"), F.col("text").alias("e_text"), F.floor(F.col("pos") / distance).alias("bucket"))
    pairs = e.join(a, [key, "bucket"]).where((F.abs(F.col("e_pos") - F.col("a_pos")) <= distance) & (F.col("e_date") < F.col("a_date")))
    first = F.row_number().over(Window.partitionBy(key, "a_text", "e_text").orderBy("e_pos", "a_pos"))
    return pairs.withColumn("_rn", first).where("_rn = 1").select(key, "a_pos", "e_pos", "a_date", "e_date", "a_text", "e_text")


def dates_of(docs: DataFrame, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, date, text) of the matches of a pattern with groups day, month name and year; SCA-27 months.

    The position is that of the n-th occurrence of the matched text.
    """
    whole = F.regexp_extract_all(text_col, F.lit(pattern), F.lit(0))
    parts = [F.regexp_extract_all(text_col, F.lit(pattern), F.lit(k)) for k in (1, 2, 3)]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"), F.posexplode(F.arrays_zip(whole.alias("w"), parts[0].alias("d"), parts[1].alias("m"), parts[2].alias("y"))).alias("nth", "x"))
    same = F.row_number().over(Window.partitionBy("doc_id", "x.w").orderBy("nth"))
    rows = rows.withColumn("k", same)
    before = F.length(F.call_function("substring_index", F.col("_text"), F.col("x.w"), F.col("k")))
    month = F.coalesce(*[F.when(F.lower("x.m").startswith(k), F.lit(v)) for k, v in sorted(dims.MONTHS.items(), key=lambda kv: -len(kv[0]))])
    date = F.try_to_date(F.concat_ws("-", F.col("x.y"), F.lpad(month.cast("string"), 2, "0"), F.lpad("x.d", 2, "0")), "yyyy-MM-dd")
    return rows.select("doc_id", before.alias("pos"), date.alias("date"), F.col("x.w").alias("text")).where("date is not null")


ADOPTED = r"(?iuU)от\s+(\d{1,2})\s+(январ\w*|феврал\w*|март\w*|апрел\w*|ма[яй]\w*|июн\w*|июл\w*|август\w*|сентябр\w*|октябр\w*|ноябр\w*|декабр\w*)\s+(\d{4})"
EFFECTIVE = r"(?iuU)(?:вступ\w+\s+в\s+силу|вводится\s+в\s+действие)\s+(?:с\s+)?(\d{1,2})\s+(январ\w*|феврал\w*|март\w*|апрел\w*|ма[яй]\w*|июн\w*|июл\w*|август\w*|сентябр\w*|октябр\w*|ноябр\w*|декабр\w*)\s+(\d{4})"
