"""Corpus upkeep and evaluation: lookups, title and version refresh, vectors on demand, planted cases, admission of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..storage import written
from . import corpus


def get_chunks(ids: DataFrame, chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """SRC-05: the chunk of each id with its rank healed by the registry's title: ids (id), chunks (id, json).

    Returns id, law_id, content, legal_rank, changed (the stored rank was another), failed (no chunk, or one that can't be read).
    """
    body = F.from_json("json", "law_id string, content string, legal_rank int")
    rows = ids.select("id").distinct().join(chunks.select("id", body.alias("c")), "id", "left").select("id", "c.law_id", "c.content", F.col("c.legal_rank").alias("stored"))
    titles = registry.select("law_id", F.concat_ws(" ", "title_ru", "title_kz").alias("_title")).dropDuplicates(["law_id"])
    rows = rows.join(titles, "law_id", "left")
    healed = F.when(F.col("law_id").isNotNull(), corpus.heal_rank(F.col("_title"), F.col("stored"), F.col("law_id"))).otherwise(F.col("stored"))
    failed = F.col("content").isNull()
    return rows.select("id", "law_id", "content", healed.alias("legal_rank"), F.coalesce(healed != F.col("stored"), F.lit(False)).alias("changed"), failed.alias("failed"))


def law_chunks(chunks: DataFrame, law: str) -> DataFrame:
    """SRC-24: readable chunks (id, json) of one law by canonical id."""
    rows = chunks.select("id", F.from_json("json", "law_id string, content string, legal_rank int").alias("c")).where("c.content is not null")
    return rows.select("id", "c.*").where(corpus.canonical(F.col("law_id")) == law)


def refresh_titles(registry: DataFrame, fresh: DataFrame) -> DataFrame:
    """SNK-09: registry with the title of fresh (law_id, title) where that is not empty and differs; `refreshed` tells where."""
    new = fresh.where("title is not null and title <> ''").groupBy("law_id").agg(F.min("title").alias("_new"))
    rows = registry.join(new, "law_id", "left")
    changed = F.coalesce(F.col("_new") != F.coalesce("title_ru", F.lit("")), F.lit(False))
    return rows.withColumn("refreshed", changed).withColumn("title_ru", F.coalesce("_new", "title_ru")).drop("_new")


def stale_laws(manifest: DataFrame, latest: DataFrame) -> DataFrame:
    """SRC-19: laws of the manifest (law_id, version) with a later version: (law_id, version, latest). A null version is stale."""
    rows = manifest.join(latest.groupBy("law_id").agg(F.max("version").alias("latest")), "law_id")
    return rows.where(F.col("version").isNull() | (F.col("latest") > F.col("version"))).select("law_id", "version", "latest")


def replace_laws(chunks: DataFrame, stale: DataFrame, fresh: DataFrame) -> DataFrame:
    """SRC-19: chunks without those of stale laws that fresh chunks replace, and the fresh chunks of stale laws."""
    arrived = fresh.join(stale.select("law_id").distinct(), "law_id", "left_semi")
    return chunks.join(arrived.select("law_id").distinct(), "law_id", "left_anti").unionByName(arrived)


def vectors_for(wanted: DataFrame, stored: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """JOI-22: (found, missing): stored vectors of wanted ids in the wanted order, and distinct ids to compute."""
    rows = wanted.join(stored.select("id", "vector"), "id", "left")
    return rows.select(order, "id", "vector"), rows.where("vector is null").select("id").distinct()


def best_article(chunks: DataFrame, prefer: str | None = None) -> DataFrame:
    """RNK-11: of each law the preferred article, else the longest content, among chunks of over 200 characters with an article.

    chunks (law_id, id, article, content); ties go to the smallest id.
    """
    some = chunks.where((F.coalesce("article", F.lit("")) != "") & (F.length("content") > 200))
    preferred = F.coalesce(F.col("article") == F.lit(prefer), F.lit(False))
    rank = F.row_number().over(Window.partitionBy("law_id").orderBy(preferred.desc(), F.when(preferred, 0).otherwise(F.length("content")).desc(), "id"))
    return some.withColumn("_rn", rank).where("_rn = 1").drop("_rn")


def planted_cases(best: DataFrame, new_article: str) -> DataFrame:
    """VRD-15: four claims a law: a verbatim one and three planted ones, with the verdict that each must not get.

    best (law_id, article, content): one real article a law.
    """
    law, article = F.col("law_id"), F.col("article")
    quote = F.btrim(F.substring("content", 1, 180), F.lit(" \t\n\r"))

    def case(claim_id: str, kind: str, text: Column, cited: Column, claim_type: str, severity: str, expect_not: str) -> Column:
        return F.struct(F.lit(claim_id).alias("claim_id"), F.lit(kind).alias("kind"), text.alias("claim_text"), cited.alias("quote"), F.lit(claim_type).alias("claim_type"), F.lit(severity).alias("severity"), F.lit(expect_not).alias("expect_not"))

    cases = F.array(
        case("true_real_article", "true", quote, quote, "legal_ref", "medium", "UNVERIFIED"),
        case("planted_new_article", "planted", F.concat(F.lit("Кодекс "), law, F.lit(f" дополняется новой статьёй {new_article}, вводящей цифровой реестр и алгоритмическое прекращение производства.")), F.lit(f"«статья {new_article}». Цифровой реестр..."), "legal_ref", "high", "CONFIRMED"),
        case("planted_absurd_article", "planted", F.concat(F.lit("Статья 99999 закона "), law, F.lit(" устанавливает обязательную биометрию для всех граждан.")), F.lit("«статья 99999»"), "legal_ref", "high", "CONFIRMED"),
        case("planted_fabricated_fact", "planted", F.concat(F.lit("Статья "), article, F.lit(" закона "), law, F.lit(" вводит смертную казнь за административные правонарушения и конфискацию всего имущества.")), F.lit("«смертная казнь за административные правонарушения»"), "factual", "critical", "CONFIRMED"),
    )
    return best.select("law_id", F.explode(cases).alias("c")).select("law_id", "c.*")


def smoke_summary(rows: DataFrame) -> DataFrame:
    """AGG-19: rows (ok, target_law_ids, regex_claims) to counts of files, read ones, ones with a target law, ones with claims."""
    ok = F.coalesce("ok", F.lit(False))
    return rows.agg(F.count("*").alias("files"), F.count_if(ok).alias("ok"), F.count_if(ok & (F.size("target_law_ids") > 0)).alias("with_target"), F.count_if(ok & (F.col("regex_claims") > 0)).alias("with_claims"))


def natural_key(article: Column) -> Column:
    """SRT-11: article numbers in natural order: the parts between hyphens as numbers; what isn't a number comes last."""
    return F.transform(F.split(article, "-"), lambda x: F.coalesce(F.regexp_extract(x, r"^\d+$", 0).try_cast("long"), F.lit((1 << 62))))


def natural_order(rows: DataFrame, article: Column, tie: str) -> DataFrame:
    """SRT-11: rows with nth, their place from 1 in the natural order of their article numbers, ties by a column.

    The rows are sorted by ranges and written once; a place is the row's own in its range after the rows of the ranges before,
    of which there is one count each, so no task numbers them all.
    """
    placed = written(rows.withColumn("_key", natural_key(article)).orderBy("_key", tie).drop("_key").withColumn("_at", F.monotonically_increasing_id()), "ordered")
    ranges = placed.groupBy(F.shiftright("_at", 33).alias("_range")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = placed.withColumn("_range", F.shiftright("_at", 33)).join(ranges.select("_range", before.alias("_before")), "_range")
    return placed.select(*rows.columns, (F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).alias("nth"))


def is_authoritative(rank: Column) -> Column:
    """FLT-08: a rank of 6 or stronger."""
    return F.coalesce(rank <= 6, F.lit(False))


def is_render_authority(rank: Column, url: Column) -> Column:
    """FLT-08 of reports: not of unknown rank, and fetched from the primary source."""
    return F.coalesce((rank != 11) & F.lower(url).contains("adilet.zan.kz"), F.lit(False))


def admitted(name: Column, size: Column, suffixes: tuple[str, ...] = (".pdf", ".docx", ".txt"), most: int = 25 << 20) -> Column:
    """FLT-12: files of a known suffix, not empty and not over the size cap."""
    low = F.lower(name)
    known = F.lit(False)
    for suffix in suffixes:
        known = known | low.endswith(suffix)
    return F.coalesce(known & (size > 0) & (size <= most), F.lit(False))


def with_mrp(rows: DataFrame, year: str) -> DataFrame:
    """SCA-38: rows with the monthly index of their year, null for years without one."""
    spark = rows.sparkSession
    return rows.join(F.broadcast(dims.table(spark, dims.MRP_BY_YEAR, "_year", "mrp")), F.col(year) == F.col("_year"), "left").drop("_year")  # a fixed table
