"""Answers of language models as input tables: query plans, claim rows, batches of requests and their cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import corpus

PLAN_SCHEMA = "adilet_queries string, web_queries_ru string, web_queries_kk string, web_queries_en string"

def iso_date(value: Column) -> Column:
    """FN-01: a date, or null for what isn't one."""
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))


def string_list(value: Column) -> Column:
    """A JSON list as its non-empty strings; anything else is an empty list."""
    none = F.array().cast("array<string>")
    return F.coalesce(F.filter(F.when(value.startswith("["), F.from_json(value, "array<string>")), lambda x: x.isNotNull() & (x != "")), none)


def patch_ids(text: Column, wrong: Column, right: Column) -> Column:
    """SCA-35: every wrong id in the text replaced by the right one at the same place of the lists, in order."""
    return F.aggregate(F.arrays_zip(wrong.alias("w"), right.alias("r")), text, lambda t, p: F.when(p["w"] != p["r"], F.replace(t, p["w"], p["r"])).otherwise(t))


def _items(value: Column) -> Column:
    """Elements of a JSON list as JSON texts; anything else is an empty list."""
    return F.coalesce(F.when(value.startswith("["), F.from_json(value, "array<string>")), F.array().cast("array<string>"))


def _field(item: Column, name: str) -> Column:
    return F.when(item.startswith("{"), F.get_json_object(item, f"$.{name}"))


def plan_queries(raw: DataFrame, keys: list[str]) -> DataFrame:
    """VRD-16, web part: (keys, language, nth, query_text, include_domains, max_results) of the plans' lists in three languages.

    raw (keys, json). Rows that aren't objects and empty query texts go; nth is the place among all rows of the list; a missing
    number of results is 10, one that isn't a number drops the row. A list that isn't one counts as empty.
    """
    plan = raw.select(*keys, F.from_json("json", PLAN_SCHEMA).alias("p"))
    lists = F.array(*[F.struct(F.lit(lang).alias("language"), _items(F.col(f"p.web_queries_{lang}")).alias("items")) for lang in ("ru", "kk", "en")])  # SET-08
    rows = plan.select(*keys, F.explode(lists).alias("l")).select(*keys, "l.language", F.posexplode("l.items").alias("nth", "item"))
    item, most = F.col("item"), _field(F.col("item"), "max_results")
    rows = rows.select(
        *keys, "language", "nth", _field(item, "query_text").alias("query_text"), string_list(_field(item, "include_domains")).alias("include_domains"),
        F.when(most.isNull(), 10).otherwise(most.try_cast("int")).alias("max_results"),
    )
    return rows.where("query_text <> '' and max_results is not null")


def plan_law_queries(raw: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """VRD-16, law part: (keys, nth, query_text, law_ids, articles, date_from, date_to) of the plans' law queries.

    Law ids are resolved by the registry (law_id, code, title), each once in order, and put right in the query text too; empty
    query texts and rows that aren't objects go; dates that aren't dates are null.
    """
    item = F.col("item")
    rows = raw.select(*keys, F.posexplode(_items(F.from_json("json", PLAN_SCHEMA)["adilet_queries"])).alias("nth", "item"))
    rows = rows.select(
        *keys, "nth", _field(item, "query_text").alias("query_text"), string_list(_field(item, "law_ids")).alias("raw_ids"), string_list(_field(item, "articles")).alias("articles"),
        iso_date(_field(item, "date_from")).alias("date_from"), iso_date(_field(item, "date_to")).alias("date_to"),
    ).where("query_text <> ''")
    named = rows.select(*keys, "nth", F.posexplode("raw_ids").alias("pos", "raw")).withColumn("key", F.trim("raw"))
    found = corpus.resolve_laws(named, registry).select(F.col("raw").alias("key"), "law_id")
    ids = named.join(found, "key", "left").withColumn("law_id", F.coalesce("law_id", "raw"))
    ids = ids.groupBy(*keys, "nth").agg(F.array_sort(F.collect_list(F.struct("pos", "raw", "law_id"))).alias("m"))  # the ids of one query
    rows = rows.join(ids, [*keys, "nth"], "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<pos:int,raw:string,law_id:string>>")))
    right = F.transform("m", lambda x: x["law_id"])
    return rows.select(*keys, "nth", patch_ids(F.col("query_text"), F.transform("m", lambda x: x["raw"]), right).alias("query_text"), F.array_distinct(right).alias("law_ids"), "articles", "date_from", "date_to")


CLAIM_TYPES = ("legal_id", "legal_ref", "financial", "temporal", "factual", "normative")
SEVERITIES = ("critical", "high", "medium", "low")


def claim_rows(raw: DataFrame, keys: list[str], order: str, types: tuple[str, ...] = CLAIM_TYPES) -> DataFrame:
    """LLM-06: raw (keys, order, json), one answer a window, to numbered claims of a document.

    An answer is a list or an object with a list `claims`. Strings of more than 10 characters are factual claims of medium
    severity; other values that aren't objects, unknown types and severities and empty texts go. Ids count the
    accepted claims of a document, over its windows in order.
    """
    body = F.coalesce(F.when(F.ltrim("json").startswith("["), F.col("json")), F.get_json_object("json", "$.claims"), F.lit("[]"))
    items = F.coalesce(F.from_json(body, "array<string>"), F.array().cast("array<string>"))
    rows = raw.select(*keys, order, F.posexplode(items).alias("nth", "item"))
    is_object = F.col("item").startswith("{")
    field = lambda name: F.get_json_object("item", f"$.{name}")
    rows = rows.select(
        *keys, order, "nth", F.when(is_object, field("claim_text")).when(F.length("item") > 10, F.col("item")).alias("claim_text"),
        F.when(is_object, F.substring(F.coalesce(field("quote"), F.lit("")), 1, 200)).otherwise("").alias("quote"),
        F.when(is_object, F.coalesce(field("claim_type"), F.lit("factual"))).otherwise("factual").alias("claim_type"),
        F.when(is_object, F.coalesce(field("severity"), F.lit("medium"))).otherwise("medium").alias("severity"),
    ).where((F.coalesce("claim_text", F.lit("")) != "") & F.col("claim_type").isin(*types) & F.col("severity").isin(*SEVERITIES))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order, "nth")) - 1
    return rows.withColumn("claim_id", F.concat(F.lit("claim_"), F.lpad(number.cast("string"), 4, "0"))).drop("nth")


def request_batches(rows: DataFrame, order: str, text: str, size: int = 50, most: int = 8000, groups: int = 64) -> DataFrame:
    """LLM-10, SRT-14: texts cut to `most` characters in batches of `size`, with the place that puts answers back in order.

    Batches are numbered in `groups` ranges of the order's hash, so that no task holds them all: (batch, index, order, input).
    """
    own = F.pmod(F.xxhash64(order), F.lit(groups)).cast("long")
    place = F.row_number().over(Window.partitionBy(own).orderBy(order)) - 1
    rows = rows.withColumn("_g", own).withColumn("_place", place)
    return rows.select((F.col("_g") * (1 << 32) + F.floor(F.col("_place") / size)).alias("batch"), F.pmod("_place", F.lit(size)).cast("int").alias("index"), F.col(order), F.substring(F.col(text), 1, most).alias("input"))


def answer_counters(calls: DataFrame) -> DataFrame:
    """AGG-20: calls (model, status) to (model, calls, parsed, empty, malformed, fallback)."""
    counted = [F.count_if(F.col("status") == s).alias(s) for s in ("parsed", "empty", "malformed", "fallback")]
    return calls.groupBy("model").agg(F.count("*").alias("calls"), *counted)
