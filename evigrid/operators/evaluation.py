"""Evaluation: drift and coverage joins, gates, claim mutation and quality rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift(codes: DataFrame) -> DataFrame:
    """JOI-16: (law_id, n_codes, n_sources, drift) of (source, law_id, code) rows."""
    return codes.groupBy("law_id").agg(F.countDistinct("code").alias("n_codes"), F.countDistinct("source").alias("n_sources")).withColumn("drift", F.col("n_codes") > 1)


def article_coverage(corpus: DataFrame, site: DataFrame) -> DataFrame:
    """JOI-17: (law_id, missing, covered, coverage_pct) of distinct (law_id, article) in the corpus and on the site."""
    c, s = corpus.select("law_id", "article").distinct().withColumn("c", F.lit(1)), site.select("law_id", "article").distinct().withColumn("s", F.lit(1))
    rows = c.join(s, ["law_id", "article"], "full_outer").groupBy("law_id").agg(F.count_if(F.col("s").isNull()).alias("missing"), F.count_if(F.col("s").isNotNull() & F.col("c").isNotNull()).alias("covered"), F.count("s").alias("site"))
    return rows.select("law_id", "missing", "covered", F.when(F.col("site") > 0, (F.col("covered") / F.col("site") * 100).cast("int")).otherwise(0).alias("coverage_pct"))


def gate(baseline: DataFrame, fresh: DataFrame) -> DataFrame:
    """JOI-18: (law_id, verdict) of (law_id, rate): FAIL if fresh is unreadable (null), above 0 or above the baseline; SKIP without fresh."""
    b, f = baseline.select("law_id", F.col("rate").alias("base")), fresh.select("law_id", F.col("rate").alias("new"), F.lit(True).alias("seen"))
    rows = b.join(f, "law_id", "full_outer")
    fails = F.col("new").isNull() | (F.col("new") > 0) | (F.col("new") > F.coalesce("base", F.lit(0.0)))
    return rows.select("law_id", F.when(F.col("seen").isNull(), "SKIP").when(fails, "FAIL").otherwise("PASS").alias("verdict"))


def gate_passes(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.bool_and(F.col("verdict") != "FAIL"), F.lit(True)).alias("passes"))


def mutate_law(law: Column) -> Column:
    """VRD-14: the last two digits of a law number swapped; one more where that changes nothing; null if it isn't an id."""
    number, rest = F.regexp_extract(law, r"^(\d+)(-.*)$", 1), F.regexp_extract(law, r"^(\d+)(-.*)$", 2)
    n = F.length(number)
    swapped = F.concat(F.substring(number, F.lit(1), n - 2), F.substring(number, n, F.lit(1)), F.substring(number, n - 1, F.lit(1)))
    changed = F.when((n >= 2) & (swapped != number), swapped).otherwise((number.try_cast("long") + 1).cast("string"))
    return F.when(number != "", F.concat(changed, rest))


def mutate_article(text: Column, number: str = "99999") -> Column:
    """VRD-14: the first article number replaced; null where nothing changes."""
    pattern = r"(?isu)^(.*?\b(?:стать[яиюе]|ст\.?)\s*)(\d+[\-\d]*)(.*)$"
    new = F.concat(F.regexp_extract(text, pattern, 1), F.lit(number), F.regexp_extract(text, pattern, 3))
    return F.when(text.rlike(r"(?isu)\b(?:стать[яиюе]|ст\.?)\s*\d") & (new != text), new)


def grounding(claims: DataFrame, index: DataFrame, keys: list[str]) -> DataFrame:
    """JOI-19: claims (keys, law, article) with grounded: the index has a chunk of that law and article."""
    have = index.select("law", "article").distinct().withColumn("grounded", F.lit(True))
    return claims.join(have, ["law", "article"], "left").withColumn("grounded", F.coalesce("grounded", F.lit(False)))


def eval_aggregate(results: DataFrame, by: list[str]) -> DataFrame:
    """AGG-15/16: grounding and false-confirm rates rounded to 3, all(stable)."""
    rate = lambda hit, all_: F.round(F.when(F.sum(all_) > 0, F.sum(hit) / F.sum(all_)).otherwise(0.0), 3)
    return results.groupBy(*by).agg(F.sum("n_claims").alias("n_claims"), rate("n_grounded", "n_claims").alias("grounding_rate"), rate("n_false", "n_mutated").alias("false_rate"), F.bool_and("stable").alias("all_stable"))


def golden_scores(expected: DataFrame, verdicts: DataFrame) -> DataFrame:
    """AGG-17: recall, precision, F1 of issues (case, issue_id, keywords array, status) against verdicts (case, seq, text, status).

    An issue is decided by the first verdict whose text has one of its keywords.
    """
    pairs = expected.withColumnRenamed("status", "want").join(verdicts, "case").where(F.exists("keywords", lambda k: F.contains(F.lower(F.col("text")), F.lower(k))))
    first = pairs.groupBy("case", "issue_id").agg(F.min_by(F.col("status") == F.col("want"), F.col("seq")).alias("hit"), F.min("seq").alias("seq"))
    per = expected.select("case", "issue_id").join(first, ["case", "issue_id"], "left").groupBy("case").agg(F.count("*").alias("issues"), F.count_if("hit").alias("tp"))
    matched = first.where("hit").select("case", "seq").distinct()
    flagged = verdicts.where("status = 'CONTRADICTED'").join(matched, ["case", "seq"], "left_anti").groupBy("case").agg(F.count("*").alias("fp"))
    rows = per.join(flagged, "case", "left").withColumn("fp", F.coalesce("fp", F.lit(0)))
    recall, precision = F.col("tp") / F.col("issues"), F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    return rows.select("case", recall.alias("recall"), precision.alias("precision"), F.when(recall + precision > 0, 2 * recall * precision / (recall + precision)).otherwise(0.0).alias("f1"))


def verdict_rates(cases: DataFrame, by: list[str]) -> DataFrame:
    """AGG-16: of (by, kind, status) rows the planted ones (kind planted) and true ones, how many of either were confirmed, and the
    two rates rounded to 3; 0 where there are none."""
    planted, confirmed = F.col("kind") == "planted", F.col("status") == "CONFIRMED"
    out = cases.groupBy(*by).agg(F.count_if(planted).alias("planted_total"), F.count_if(planted & confirmed).alias("planted_confirmed"), F.count_if(~planted).alias("true_total"), F.count_if(~planted & confirmed).alias("true_confirmed"))
    rate = lambda hit, total: F.when(F.col(total) > 0, F.round(F.col(hit) / F.col(total), 3)).otherwise(0.0)
    return out.withColumns({"false_confirm_rate": rate("planted_confirmed", "planted_total"), "true_confirm_rate": rate("true_confirmed", "true_total")})
