"""Texts of prompts and reports, translations that may be shown, and the rows that a report is made of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from . import audit
from .fusion import keep_first


def _some(c: Column | str) -> Column:
    return F.nullif(c, F.lit(""))


# --- prompts ----------------------------------------------------------------------------------------------------------


def shortened(text: Column, most: int, mark: Column | str) -> Column:
    """SCA-30: the first `most` characters, with a mark if something is cut."""
    mark = F.lit(mark) if isinstance(mark, str) else mark
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), mark)).otherwise(text)


def planner_text(text: Column, most: int = 12_000) -> Column:
    """SCA-30: a document in the planner's prompt; the mark tells its whole length."""
    return shortened(text, most, F.concat(F.lit("\n\n[... текст обрезан — оригинал содержит "), F.length(text), F.lit(" символов ...]")))


def source_block(label: Column, law_id: Column, article: Column, expired: Column, web_tier: Column, url: Column, conflict: Column, title: Column, content: Column, most: int = 3000) -> Column:
    """SCA-30: a source in the auditor's prompt: [AD|law|article|a or x], or [WB|tier|domain|! or -] without a law; title and text cut."""
    domain = F.when(F.coalesce(url, F.lit("")) != "", F.substring(F.get(F.split(url, "/"), 2), 1, 20)).otherwise("?")
    tier = F.replace(F.coalesce(_some(web_tier), F.lit("T?")), F.lit("TIER_"), F.lit("t"))
    law = F.concat(F.lit("[AD|"), law_id, F.lit("|"), F.coalesce(_some(article), F.lit("*")), F.when(expired, "|x]").otherwise("|a]"))
    web = F.concat(F.lit("[WB|"), tier, F.lit("|"), F.coalesce(domain, F.lit("?")), F.when(conflict, "|!]").otherwise("|-]"))
    head = F.concat(F.lit("### "), label, F.when(conflict, " ⚠️КОНФЛИКТ").otherwise(""), F.lit("\n"), F.when(_some(law_id).isNotNull(), law).otherwise(web))
    return F.concat(head, F.lit(" "), F.substring(F.coalesce(title, F.lit("")), 1, 60), F.lit("\n---\n"), shortened(F.coalesce(content, F.lit("")), most, " [ОБРЕЗАНО]"))


def hint_lines(hints: DataFrame, order: str = "seq") -> DataFrame:
    """SCA-39: one row, the lines `- name = code` of (order, name, code) for the planner's prompt. A registry's size, not a corpus's."""
    line = F.concat(F.lit("- "), "name", F.lit(" = "), "code")
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line"))))
    return hints.agg(F.array_join(F.transform(rows, lambda x: x["line"]), "\n").alias("hints"))


def law_title(chunks: DataFrame, order: str) -> DataFrame:
    """SCA-39: (law_id, title): the first title of a law's chunks that isn't empty before its article mark."""
    title = F.trim(F.substring_index("source_title", "| Ст.", 1))
    return keep_first(chunks.select("law_id", order, title.alias("title")).where("title <> ''"), ["law_id"], [F.col(order)]).select("law_id", "title")


def hinted_law(title: Column, content: Column) -> Column:
    """SCA-23: the law that a page is about, before the registry: the first code whose word it has, else the first id in it."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(content, F.lit("")))
    low = F.lower(both)
    words = [F.when(T.contains_any(low, needles), F.lit(law)) for needles, law in dims.PAGE_HINTS]
    return F.coalesce(*words, _some(F.upper(F.regexp_extract(both, r"(?i)\b\d+-[IVXLCDM]+(?:-[A-Z]+)?\b", 0))))


# --- reference data ---------------------------------------------------------------------------------------------------


def look_up(rows: DataFrame, spark: SparkSession, law: str | None = None, offence: str | None = None, crime: str | None = None, year: str | None = None) -> DataFrame:
    """SCA-38: rows with what the fixed tables say of a law id, an article of the offence or criminal code, and a year; null where
    they say nothing. The tables are of fixed size, which is why they are sent to every task."""
    def known(values: dict, names: str, key: str) -> DataFrame:
        return F.broadcast(spark.createDataFrame([(k, *v) for k, v in values.items()], names).withColumnRenamed("key", key))

    if law:
        rows = rows.join(known(dims.KNOWN_LAWS, "key string, law_title string, law_date string, law_valid boolean", law), law, "left")
    if offence:
        rows = rows.join(known(dims.OFFENCES, "key string, offence_title string, fine_person int, fine_entity int, offence_notes string", offence), offence, "left")
    if crime:
        rows = rows.join(known(dims.CRIMES, "key string, crime_title string, crime_notes string", crime), crime, "left")
    if year:
        rows = rows.join(known({k: (v, dims.MRP_SOURCES.get(k)) for k, v in dims.MRP_BY_YEAR.items()}, "key int, mrp int, mrp_source string", year), year, "left")
    return rows


def reference_text() -> str:
    """SCA-34: the reference data as the block of text that the auditor's prompt carries."""
    out = ["### СПРАВОЧНИК: МРП по годам (Месячный Расчётный Показатель)"]
    for year, value in sorted(dims.MRP_BY_YEAR.items()):
        source = dims.MRP_SOURCES.get(year)
        out.append(f"  {year}: {value} тг" + (f" ({source})" if source else ""))
    out.append("\n### СПРАВОЧНИК: Штрафы КоАП РК по теме персональных данных")
    out += [f"  Ст. {k} КоАП: «{title}». Макс штраф: {person} МРП (физлица), {entity} МРП (юрлица). {notes}" for k, (title, person, entity, notes) in dims.OFFENCES.items()]
    most = dims.MOST_FINES
    out.append(f"  АБСОЛЮТНЫЙ МАКСИМУМ штрафов по КоАП за нарушения ПД: {most['absolute_max']} МРП (юрлица). Физлица: {most['физлица']} МРП. Должностные: {most['должностные']} МРП. МСБ: {most['юрлица_мсб']} МРП.")
    out.append("\n### СПРАВОЧНИК: Статьи УК РК")
    out += [f"  Ст. {k} УК: «{title}». {notes}" for k, (title, notes) in dims.CRIMES.items()]
    out.append("\n### СПРАВОЧНИК: Известные сроки уведомлений")
    out.append(f"  {dims.BREACH_NOTICE}")
    out.append(f"  Срок уведомления третьих лиц: {dims.THIRD_PARTY_DAYS} рабочих дней (ст.27 Закона о ПД)")
    return "\n".join(out)


# --- reports ----------------------------------------------------------------------------------------------------------

#: SCA-32, fixed patterns in order.
READABLE = (
    (r"(?im)^>\s*\[!(?:NOTE|WARNING|CAUTION|TIP|IMPORTANT)\]\s*$", ""),
    (r"\bfact_claim_0*(\d+)", "утверждение №$1"),
    (r"\bclaim_0*(\d+)", "утверждение №$1"),
    (r"\s*\[утверждение №\d+\]:\s*", " "),
    (r"\barticle_ref\s*=\s*(\d+)", "статья $1"),
    (r"\(\s*BM25:\s*([\d.]+)\s*\)", "(релевантность $1)"),
    (r"\bconflict_0*(\d+)", "коллизия №$1"),
)


def readable(report: Column) -> Column:
    """SCA-32: a report with its internal ids as words."""
    for pattern, with_ in READABLE:
        report = F.regexp_replace(report, pattern, with_)
    return report


def kept_translation(original: Column, translated: Column) -> Column:
    """LLM-09: the translation without a fence around it if it isn't blank and has every protected token of the original
    (FLT-13), else the original. A null translation is a call that failed."""
    bare = T.strip_fences(translated)
    sound = F.coalesce(F.trim(original) != "", F.lit(False)) & F.coalesce(bare.rlike(r"\S"), F.lit(False)) & F.coalesce(T.preserved(original, bare), F.lit(False))
    return F.when(sound, bare).otherwise(original)


def localised(reports: DataFrame, stored: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """EVT-06: reports (report_id, content) in the other language: stored translations first, then answers that pass the guard, else the
    original. Returns (shown: report_id, content, origin), the ids still to translate, and the new rows to store.

    stored and answers: (report_id, content). An answer that fell back to the original isn't stored, so it is asked for again.
    """
    rows = reports.join(stored.select("report_id", F.col("content").alias("_stored")), "report_id", "left").join(answers.select("report_id", F.col("content").alias("_answer")), "report_id", "left")
    new = kept_translation(F.col("content"), F.col("_answer"))
    origin = F.when(F.col("_stored").isNotNull(), "stored").when(F.col("_answer").isNotNull() & (new != F.col("content")), "answer").otherwise("original")
    rows = rows.withColumns({"origin": origin, "_new": new})
    shown = rows.select("report_id", F.when(F.col("origin") == "stored", F.col("_stored")).otherwise(F.col("_new")).alias("content"), "origin")
    return shown, rows.where("origin = 'original'").select("report_id"), rows.where("origin = 'answer'").select("report_id", F.col("_new").alias("content"))


def claim_number(claim_id: Column) -> Column:
    """The first number in a claim's id; a million without one."""
    return F.coalesce(F.regexp_extract(F.coalesce(claim_id, F.lit("")), r"(\d+)", 1).try_cast("long"), F.lit(1_000_000))


def report_facts(facts: DataFrame, by: list[str], order: str) -> DataFrame:
    """DED-05: facts by claim number, the first of each text without regard to case; facts with a blank text all stay. `nth` is the place."""
    from pyspark.sql import Window

    text = F.lower(F.trim(F.coalesce("claim", F.lit(""))))
    number = claim_number(F.col("claim_id"))
    key = F.when(text == "", F.concat(F.lit("blank "), F.col(order).cast("string"))).otherwise(F.concat(F.lit("text "), text))
    kept = keep_first(facts.withColumn("_number", number), [*by, key], [F.col("_number"), F.col(order)])
    return kept.withColumn("nth", F.row_number().over(Window.partitionBy(*by).orderBy("_number", order))).drop("_number")


def active_chunks(chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """FLT-10: chunks of the report: no duplicates, and named by a fact or in a conflict."""
    named = facts.select(F.explode("source_ids").alias("id")).where(~audit.is_virtual(F.col("id"))).distinct().withColumn("_named", F.lit(True))
    rows = chunks.where(~F.col("is_duplicate")).join(named, "id", "left")
    return rows.where(F.col("_named") | F.col("is_conflict")).drop("_named")


def facts_with_verdicts(facts: DataFrame, verdicts: DataFrame, by: list[str], order: str, last: bool = True) -> DataFrame:
    """JOI-12: facts with their claim's verdict_status and verdict_severity; of several verdicts the last (audit) or the first (verifier)."""
    one = keep_first(verdicts.where(F.coalesce("claim_id", F.lit("")) != ""), [*by, "claim_id"], [F.col(order).desc() if last else F.col(order).asc()])
    return facts.join(one.select(*by, "claim_id", F.col("status").alias("verdict_status"), F.col("severity").alias("verdict_severity")), [*by, "claim_id"], "left")


def derived_fields(analyses: DataFrame, facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """SCA-36: analyses (analysis, stats struct<pros, recommendation>, custom_pros, custom_recommendation) with the counts of validated and unverified facts,
    and pros and recommendation by the first source that has them: the audit's statistics, the analysis's own, made from the verdicts."""
    f = facts.groupBy("analysis").agg(F.count_if(F.col("validation_status").isin("HIGH", "MEDIUM")).alias("validated_facts"), F.count_if(F.col("validation_status") == "UNVERIFIED").alias("unverified_facts"))
    n = lambda s: F.count_if(F.col("status") == s)
    v = verdicts.groupBy("analysis").agg(F.count("*").alias("_n"), n("CONFIRMED").alias("_yes"), n("CONTRADICTED").alias("_no"), n("UNVERIFIED").alias("_open"))
    rows = analyses.join(f, "analysis", "left").join(v, "analysis", "left").fillna(0, ["validated_facts", "unverified_facts", "_n", "_yes", "_no", "_open"])
    own_pros = F.concat(F.lit("Подтверждено "), "_yes", F.lit(" из "), "_n", F.lit(" анализируемых утверждений законопроекта."))
    own = F.concat(
        F.lit("Юридический аудит завершен. Из "), "_n", F.lit(" выдвинутых утверждений: "), "_yes", F.lit(" подтверждено действующим законодательством Республики Казахстан, "), "_no",
        F.lit(" опровергнуто, "), "_open", F.lit(" не верифицировано (отсутствуют в предоставленном корпусе)."), F.when(F.col("_no") > 0, F.concat(F.lit(" КРИТИЧЕСКИ: "), "_no", F.lit(" ошибок."))).otherwise(""),
    )
    made = F.col("stats").isNotNull()
    pros = F.when(made, F.col("stats.pros")).when(F.size(F.coalesce("custom_pros", F.array().cast("array<string>"))) > 0, F.col("custom_pros")).otherwise(F.array(own_pros))
    text = F.when(made, F.col("stats.recommendation")).when(_some("custom_recommendation").isNotNull(), F.col("custom_recommendation")).otherwise(own)
    return rows.select("analysis", "validated_facts", "unverified_facts", pros.alias("pros"), text.alias("recommendation"))


def first_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """LIM-02, SRT-02: the first n rows of each group in an order."""
    from pyspark.sql import Window

    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


#: SRT-09: states of a check from worst to best, fixed order.
STATE_ORDER = ("broken", "stale", "title_differs", "missing", "verified")


def state_order(state: Column) -> Column:
    """SRT-09: place of a state in the lists of the checks; unknown ones come last."""
    return F.coalesce(*[F.when(state == s, F.lit(k)) for k, s in enumerate(STATE_ORDER)], F.lit(len(STATE_ORDER)))


def listed(rows: DataFrame, by: list[str], state: str, size: str, key: str) -> DataFrame:
    """SRT-07, SRT-09, SRT-12: rows with nth, their place in their group by state, then size from the largest, then key by length and value."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(state_order(F.col(state)), F.col(size).desc(), F.length(key), F.col(key))
    return rows.withColumn("nth", F.row_number().over(order))
