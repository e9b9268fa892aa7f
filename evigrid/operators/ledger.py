"""LLM-05, LLM-07, LLM-08: answers with attempts, as a ledger: failures stay in their batch, retries are an anti-join.

A ledger has a row an attempt: (batch, attempt, status, json). ok ends a batch; failed and empty are tried again, up to three times
in all. The calls are made elsewhere: their answers come in as a table (batch, json, error), those that don't come count as failed.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MOST_ATTEMPTS = 3
PLAN_LISTS = ("adilet_queries", "web_queries_ru", "web_queries_kk", "web_queries_en")


def has_queries(json: Column) -> Column:
    """LLM-05: some list of a plan isn't empty."""
    lists = [F.coalesce(F.get_json_object(json, f"$.{name}"), F.lit("[]")) for name in PLAN_LISTS]
    out = F.lit(False)
    for x in lists:
        out = out | ~F.trim(x).isin("[]", "null", "", "{}")
    return out


def is_object(json: Column) -> Column:
    """LLM-07: an answer of the auditor counts if it is an object."""
    return F.ltrim(json).startswith("{") & F.get_json_object(json, "$").isNotNull()


def pending(batches: DataFrame, ledger: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """(batch, attempt): batches without an answer that have attempts left, with the number of the next one."""
    tried = ledger.groupBy("batch").agg(F.count("*").alias("n"), F.bool_or(F.col("status") == "ok").alias("done"))
    rows = batches.select("batch").distinct().join(tried, "batch", "left")
    rows = rows.where(~F.coalesce("done", F.lit(False)) & (F.coalesce("n", F.lit(0)) < most))
    return rows.select("batch", (F.coalesce("n", F.lit(0)) + 1).cast("int").alias("attempt"))


def attempts(asked: DataFrame, answers: DataFrame, good=is_object) -> DataFrame:
    """Ledger rows of the batches asked, from their answers (batch, json, error): failed on an error or without an answer,
    empty if the answer isn't good, else ok. Answers nobody asked for go; of several for a batch the first by its text counts."""
    one = answers.groupBy("batch").agg(F.min(F.struct(F.col("error").isNotNull().alias("bad"), "json", "error")).alias("a"))
    rows = asked.join(one, "batch", "left")
    json = F.col("a.json")
    status = F.when(F.col("a").isNull() | F.col("a.error").isNotNull() | json.isNull(), "failed").when(~F.coalesce(good(json), F.lit(False)), "empty").otherwise("ok")
    return rows.select("batch", "attempt", status.alias("status"), json.alias("json"))


def settled(batches: DataFrame, ledger: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """(batch, state, attempts, json): ok with the first good answer; exhausted, with the last one there is; or pending."""
    first = F.row_number().over(Window.partitionBy("batch").orderBy((F.col("status") != "ok").cast("int"), F.when(F.col("status") == "ok", F.col("attempt")).otherwise(-F.col("attempt"))))
    best = ledger.withColumn("_rn", first).where("_rn = 1").select("batch", "status", "json")
    n = ledger.groupBy("batch").agg(F.count("*").cast("int").alias("attempts"))
    rows = batches.select("batch").distinct().join(n, "batch", "left").join(best, "batch", "left")
    state = F.when(F.col("status") == "ok", "ok").when(F.coalesce("attempts", F.lit(0)) >= most, "exhausted").otherwise("pending")
    return rows.select("batch", state.alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "json")


def batch_failures(done: DataFrame) -> DataFrame:
    """LLM-07: one row with the batches that no attempt answered; their claims are left to `audit.backfill`."""
    return done.agg(F.count_if(F.col("state") == "exhausted").alias("batch_failures"))


def answer_or_null(done: DataFrame) -> DataFrame:
    """LLM-08: (batch, json), null after any failure: this answer is wanted, never needed."""
    return done.select("batch", F.when(F.col("state") == "ok", F.col("json")).alias("json"))


class AttemptLedger:
    """A ledger kept between runs in a folder: one Parquet batch a round, written under its own name with overwrite."""

    SCHEMA = "batch string, attempt int, status string, json string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/round=*")
        except AnalysisException:  # no round yet
            return self.spark.createDataFrame([], self.SCHEMA)

    def append(self, rows: DataFrame, round_id: str | None = None) -> None:
        """Add a round's attempts; the same round again replaces itself."""
        rows.select(F.col("batch").cast("string").alias("batch"), "attempt", "status", "json").write.mode("overwrite").parquet(f"{self.path}/round={round_id or uuid.uuid4().hex}")
