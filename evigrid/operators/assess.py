"""The audit of facts as one plan: sources, retrieval in each claim's own candidates, arithmetic, states, then verdicts and scores.

facts (analysis, fact_id, claim_id, claim, source_ids, confidence); claims (analysis, claim_id, claim_text, quote, laws, article)
with canonical laws; verdicts as in `audit`; chunks (id, law, article, web_tier, content) without duplicates, law canonical.
One index of all chunks serves all analyses.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from ..storage import written
from . import audit, search

FACT = ["analysis", "fact_id"]
#: RNK-03: words of a claim that open its code family, and the marks that a fact's text has around the claim's.
FAMILY_WORDS = ("гражданск", "земельн", "коап")
FACT_MARKS = r"\[claim_\d{4}\]:\s*['\"]?"


def _none() -> Column:
    return F.array().cast("array<string>")


def families(text: Column) -> Column:
    """RNK-03: canonical ids of the codes whose word the text has."""
    low = F.lower(text)
    found = [F.when(low.contains(w), F.array(*[F.lit(dims.LAW_ALIASES.get(x, x)) for x in dims.LAW_NAMES[w]])) for w in FAMILY_WORDS]
    return F.array_distinct(F.flatten(F.array_compact(F.array(*found))))


def with_claims(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """Facts with their claim: laws, families, article (of the fact's own text without a claim), and the text to search with."""
    own = claims.select("analysis", "claim_id", F.coalesce("claim_text", F.lit("")).alias("_text"), F.coalesce("quote", F.lit("")).alias("_quote"), F.coalesce("laws", _none()).alias("laws"), F.col("article").alias("_article"), F.lit(True).alias("_claimed"))
    rows = facts.join(own, ["analysis", "claim_id"], "left").withColumn("laws", F.coalesce("laws", _none()))
    claimed = F.coalesce("_claimed", F.lit(False))
    both = F.concat("_text", F.lit(" "), "_quote")
    bare = F.rtrim(F.regexp_replace("claim", FACT_MARKS, ""), F.lit("'\""))
    return rows.withColumns(
        {
            "claimed": claimed, "article": F.when(claimed, F.col("_article")).otherwise(T.article_of(F.lower("claim"))), "families": F.when(F.size("laws") > 0, families(both)).otherwise(_none()),
            "search_text": F.when(claimed, both).otherwise(bare), "exact_text": F.coalesce(F.nullif(F.trim(both), F.lit("")), "claim"), "topology_text": F.concat("claim", F.lit(" "), F.coalesce("_text", F.lit(""))),
        }
    ).drop("_text", "_quote", "_article", "_claimed")


def branches(facts: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """VRD-06: facts with their branch, and the candidates (analysis, fact_id, id) of those scored against given chunks.

    exact: the corpus holds the article of a law that the claim names; its chunks become the sources. Then search without
    a linked source, virtual with reference data alone, linked with chunks that the answer named.
    """
    asked = facts.where(F.col("claimed") & F.col("article").isNotNull()).select(*FACT, F.explode("laws").alias("law"), "article")
    exact = asked.join(chunks.select("id", "law", "article"), ["law", "article"]).select(*FACT, "id").distinct()
    matched = exact.groupBy(*FACT).agg(F.array_sort(F.collect_list("id")).alias("_matched"))
    real = F.filter("source_ids", lambda s: ~audit.is_virtual(s))
    free = (F.size("source_ids") == 0) | F.array_contains("source_ids", "UNLINKED")
    rows = facts.withColumn("source_ids", F.coalesce("source_ids", _none())).join(matched, FACT, "left")
    rows = rows.withColumn("branch", F.when(F.col("_matched").isNotNull(), "exact").when(free, "search").when(F.size(real) == 0, "virtual").otherwise("linked"))
    rows = rows.withColumn("source_ids", F.coalesce("_matched", "source_ids")).drop("_matched")
    named = rows.where("branch = 'linked'").select(*FACT, F.explode(F.array_distinct("source_ids")).alias("id")).join(chunks.select("id"), "id", "left_semi").select(*FACT, "id")
    return rows, exact.unionByName(named)


def audit_facts(facts: DataFrame, claims: DataFrame, chunks: DataFrame, tokenize=T.tokens) -> DataFrame:
    """VRD-06 and VRD-07: facts with source_ids, branch, validation_status and bm25_score.

    A fact is scored against the best of its own candidates by BM25 over the whole corpus, divided by the corpus's normaliser; the
    candidates meet their documents' rows, so no posting list is read for them. Facts without a source go through
    the layered search. A number that the candidates contradict lowers the state. Whatever has no evidence is UNVERIFIED.
    """
    index = search.kept(search.build_index(chunks, tokenize, text_col="content"))
    ready = search.vectors(index)
    norm = written(search.normaliser(index, chunks, tokenize, text_col="content", ready=ready), "norm")
    rows, pairs = branches(with_claims(facts, claims), chunks)
    rows, pairs = written(rows, "branches"), written(pairs, "candidates")
    key = F.struct(*FACT).alias("query_id")

    asked = search.query_terms(rows.where("branch in ('exact', 'linked')").select(key, F.when(F.col("branch") == "exact", F.col("exact_text")).otherwise(F.col("claim")).alias("text")), tokenize)
    scored = search.vector_scores(index, ready, asked, pairs.select(key, "id")).groupBy("query_id").agg(F.max("score").alias("raw"))
    scored = scored.join(F.broadcast(norm)).select("query_id.*", search.normalised(F.col("raw"), F.col("norm")).alias("_score"))

    wanted = rows.where("branch = 'search'")
    # equal texts tie: sums that differ in their last digits only are made equal
    found = search.score(index, wanted.select(key, F.col("search_text").alias("text")), tokenize).withColumn("score", F.round("score", 9))
    layers = search.layered_fallback(
        found, wanted.select(key, "laws", "families", F.col("article").alias("claim_article")),
        chunks.select("id", "law", F.col("web_tier").isNotNull().alias("web"), "article", F.lower("content").alias("text")), norm,
    )
    layers = layers.select("query_id.*", F.col("id").alias("_found"), F.col("score").alias("_fallback"))

    linked = rows.where("branch = 'linked'").select(*FACT, F.col("topology_text").alias("claim_text"), "laws", "source_ids")
    topology = audit.topology(linked, chunks.select("id", F.col("law").alias("law_id")), FACT)
    used = chunks.join(pairs.select("id").distinct(), "id", "left_semi")
    numbers = pairs.join(audit.claim_numbers(used, ["id"], "content").distinct(), "id").select(*FACT, "unit", "value").distinct()
    sums = audit.arithmetic(audit.claim_numbers(rows.where("branch in ('exact', 'linked')"), FACT, "claim"), numbers, FACT)

    out = rows
    for part in (scored, layers, topology, sums):
        out = out.join(part, FACT, "left")
    score = F.coalesce("_score", F.lit(0.0))
    state = audit.fact_status(
        score, F.col("confidence"), F.when(F.col("branch") == "search", F.array(F.lit("UNLINKED"))).otherwise(F.col("source_ids")), F.when(F.col("branch") == "exact", score),
        F.coalesce("topology_ok", F.lit(True)), F.coalesce("arithmetic_ok", F.lit(True)), F.col("_fallback"),
    )
    out = out.withColumn("_state", state).withColumn("source_ids", F.when(F.col("_found").isNotNull(), F.array("_found")).otherwise(F.col("source_ids")))
    return out.select(*facts.columns, "branch", "_state.*")


@dataclass
class Audited:
    """verdicts and facts after the audit, scores (analysis, counts, reliability) and conflict records."""

    verdicts: DataFrame
    facts: DataFrame
    scores: DataFrame
    conflicts: DataFrame


def audit_analyses(facts: DataFrame, verdicts: DataFrame, claims: DataFrame, chunks: DataFrame, tokenize=T.tokens) -> Audited:
    """The whole audit in its order: FLT-05, FLT-06, VRD-06/07, VRD-10, AGG-01..06 with AGG-08, VRD-12.

    verdicts also has seq, their order; chunks also law_id and legal_rank. A claim has one verdict and one fact.
    """
    keys = ["analysis", "claim_id"]
    said = audit.downgrade_unsupported(audit.filter_sources(verdicts, chunks, keys), chunks, keys)
    said = written(said, "verdicts")
    fell = said.where("downgraded").select(*keys, F.coalesce("document_value", F.lit("None")).alias("_value"))
    rows = facts.join(fell, keys, "left")
    hit = F.col("_value").isNotNull()
    rows = rows.withColumn("claim", F.when(hit, F.concat(F.lit("["), "claim_id", F.lit("]: '"), "_value", F.lit("'"))).otherwise(F.col("claim"))).withColumn("confidence", F.when(hit, 0.4).otherwise(F.col("confidence"))).drop("_value")
    audited = written(audit.sync_facts(audit_facts(rows, claims, chunks, tokenize), said, keys), "facts")
    settled = written(audit.sync_verdicts(said.drop("downgraded"), audited, keys), "verdicts")
    ranked = audit.best_rank(settled, chunks, keys).join(audited.select(*keys, "bm25_score"), keys, "left")
    scores = audit.reliability(ranked, ["analysis"])
    counted = (F.col("branch") != "search") | (F.col("bm25_score") >= dims.FALLBACK)
    alone = audit.mean_score(audited.where(counted).join(verdicts.select("analysis").distinct(), "analysis", "left_anti"), ["analysis"])
    return Audited(settled, audited, scores.unionByName(alone, allowMissingColumns=True), audit.conflict_records(settled, ["analysis"], "seq"))
