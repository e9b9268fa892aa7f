"""Report tables and the Markdown report, as ordered aggregations and string expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .fusion import keep_first


def executive_summary(verdicts: DataFrame, by: list[str], score: Column | None = None) -> DataFrame:
    """AGG-09: counts, whole percent by truncation, coverage 0 without verdicts."""
    s = F.col("status")
    out = verdicts.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(s == "CONFIRMED").alias("confirmed"), F.count_if(s == "CONTRADICTED").alias("contradicted"), F.count_if(s == "UNVERIFIED").alias("unverified"), *([score.alias("reliability")] if score is not None else []))
    covered = F.when(F.col("total") == 0, 0).otherwise(((F.col("confirmed") + F.col("contradicted")) / F.col("total") * 100).cast("int"))
    out = out.withColumn("coverage_pct", covered)
    return out.withColumn("reliability_pct", (F.col("reliability") * 100).cast("int")) if score is not None else out


def normative_base(chunks: DataFrame, order: str, by: list[str]) -> DataFrame:
    """AGG-10: (by, legal_rank, law, refs): references of each law in order of first use, each (url, article) once."""
    rows = chunks.withColumn("law", F.coalesce("law_id", "source_title"))
    rows = keep_first(rows, [*by, "law", "source_url", "article"], [F.col(order)])
    return rows.groupBy(*by, "legal_rank", "law").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "article"))), lambda x: F.coalesce(x["article"], F.lit("-"))), ",").alias("refs"), F.count("*").alias("n_refs"))


def grounding_integrity(chunks: DataFrame) -> DataFrame:
    """AGG-11: titles that more than one law id has."""
    return chunks.where("source_title is not null and law_id is not null").groupBy("source_title").agg(F.array_join(F.array_sort(F.collect_set("law_id")), ",").alias("law_ids"), F.countDistinct("law_id").alias("n_laws")).where("n_laws > 1")


def placeholder_code(code: Column) -> Column:
    """FLT-09: a code whose digits after the year are all zero."""
    return code.rlike(r"^[A-Za-z]*\d\d0+_*$")


def law_summary(chunks: DataFrame, by: list[str], title: str, order: str) -> DataFrame:
    """AGG-12/13: chunks, distinct articles and the first title that isn't empty."""
    first = F.min_by(F.nullif(title, F.lit("")), F.when(F.coalesce(title, F.lit("")) != "", F.col(order)))
    return chunks.groupBy(*by).agg(F.count("*").alias("n_chunks"), F.countDistinct("article").alias("n_articles"), first.alias("title"))


def structural_checklist(claims: DataFrame, by: list[str], kind: str, entity: str) -> DataFrame:
    """AGG-18: sorted distinct entities of each kind."""
    return claims.groupBy(*by, kind).agg(F.array_join(F.array_sort(F.collect_set(entity)), ",").alias("entities"), F.countDistinct(entity).alias("n_entities"), F.count("*").alias("n"))


def facts_section(facts: DataFrame, by: list[str]) -> DataFrame:
    """DED-05: facts by claim number, equal texts (case aside) once, blank ones all."""
    number = F.coalesce(F.regexp_extract("claim_id", r"(\d+)", 1).try_cast("long"), F.lit(1_000_000))
    rows = facts.withColumn("_n", number).withColumn("_key", F.lower(F.trim("claim")))
    rn = F.row_number().over(Window.partitionBy(*by, "_key").orderBy("_n", "fact_id"))
    return rows.withColumn("_rn", rn).where((F.col("_rn") == 1) | (F.col("_key") == "")).withColumn("claim", T.clean_labels(F.col("claim"))).drop("_rn", "_key")


def render_report(summary: DataFrame, conflicts: DataFrame, facts: DataFrame, by: str) -> DataFrame:
    """SNK-10/14: (by, markdown): sections in fixed order, empty ones left out.

    summary: total, confirmed, contradicted, unverified, reliability, recommendation. conflicts: record_id, conflict_type,
    claim_text. facts: claim_id, claim, validation_status.
    """
    c = conflicts.groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("record_id"), F.lit(" ["), F.col("conflict_type"), F.lit("] "), F.coalesce("claim_text", F.lit(""))))), "\n").alias("_c"))
    f = facts_section(facts, [by]).groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "fact_id", F.concat(F.lit("- **"), F.col("validation_status"), F.lit("** "), F.col("claim")).alias("line")))), lambda x: x["line"]), "\n").alias("_f"))
    rows = summary.join(c, by, "left").join(f, by, "left")
    percent = F.coalesce(F.concat((F.col("reliability") * 100).cast("int").cast("string"), F.lit("% "), T.score_bar(F.col("reliability"))), F.lit("N/A"))
    sections = F.array(
        F.concat(F.lit("# Отчёт\n\nНадёжность: "), percent),
        F.concat(F.lit("## Итоги\n\nВсего "), F.col("total"), F.lit(", подтверждено "), F.col("confirmed"), F.lit(", опровергнуто "), F.col("contradicted"), F.lit(", не верифицировано "), F.col("unverified")),
        F.concat(F.lit("## Конфликты\n\n"), F.col("_c")), F.concat(F.lit("## Факты\n\n"), F.col("_f")),
        F.concat(F.lit("## Рекомендация\n\n"), F.col("recommendation")),
    )
    return rows.select(by, F.array_join(F.array_compact(sections), "\n\n---\n\n").alias("markdown"))


def write_reports(reports: DataFrame, by: str, path: str) -> None:
    """SNK-10: one text file a report, in a folder of its key."""
    reports.select(by, F.col("markdown").alias("value")).write.partitionBy(by).mode("overwrite").text(path)
