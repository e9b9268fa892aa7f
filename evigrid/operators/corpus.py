"""Corpus tables: copy-on-write inserts and updates, registry resolution, metadata joins, repairs and the TTL cache.

Plain Parquet has no MERGE; each function returns the new content of a table (or the rows to append), made by joins on its key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .. import dims
from ..functions import text as T
from ..storage import written
from .fusion import keep_first


def insert_if_absent(new: DataFrame, old: DataFrame, key: str, order: str) -> DataFrame:
    """SNK-01/02: rows to append: first of each key, none that the table has."""
    return keep_first(new, [key], [F.col(order)]).join(old.select(key), key, "left_anti")


def insert_or_replace(new: DataFrame, old: DataFrame, key: str, order: str) -> DataFrame:
    """SNK-03: the table with new rows in place of old ones, the last new row of a key."""
    latest = keep_first(new, [key], [F.col(order).desc()])
    return old.join(latest.select(key), key, "left_anti").unionByName(latest)


def upsert_registry(old: DataFrame, new: DataFrame, key: str, texts: list[str], count: str, stamp: str) -> DataFrame:
    """SNK-04: empty new texts keep the old ones, counts add, the time stamp is the new one."""
    o = old.select(key, *[F.col(c).alias(f"_o_{c}") for c in [*texts, count, stamp]])
    n = new.select(key, *[F.col(c).alias(f"_n_{c}") for c in [*texts, count, stamp]])
    rows = o.join(n, key, "full_outer")
    return rows.select(
        key, *[F.coalesce(F.nullif(f"_n_{c}", F.lit("")), F.col(f"_o_{c}")).alias(c) for c in texts],
        (F.coalesce(f"_o_{count}", F.lit(0)) + F.coalesce(f"_n_{count}", F.lit(0))).alias(count), F.coalesce(f"_n_{stamp}", f"_o_{stamp}").alias(stamp),
    )


def delete_law(chunks: DataFrame, vectors: DataFrame, law: str) -> tuple[DataFrame, DataFrame]:
    """SNK-06: chunks without a law's, and vectors of the chunks that stay."""
    kept = chunks.where(~F.col("law_id").eqNullSafe(law))
    return kept, vectors.join(kept.select("id"), "id", "left_semi")


def relabel(chunks: DataFrame, registry: DataFrame, drop: tuple[str, ...] = dims.INVALID_LAWS) -> DataFrame:
    """SNK-07: raw codes become short ids by registry (code, law_id); chunks of invalid laws go."""
    code = F.rtrim(F.upper("law_id"), F.lit("_"))
    names = registry.select(F.rtrim(F.upper("code"), F.lit("_")).alias("_code"), F.col("law_id").alias("_short")).dropDuplicates(["_code"])
    rows = chunks.where(~F.coalesce(F.col("law_id").isin(*drop), F.lit(False))).withColumn("_code", code).join(names, "_code", "left")
    return rows.withColumn("law_id", F.coalesce("_short", "law_id")).drop("_code", "_short")


def heal_unknown(chunks: DataFrame, signatures: dict[str, str]) -> DataFrame:
    """SNK-08: chunks without a law get one by content signature, longest first, else by the id in the text."""
    low = F.lower("content")
    rules = [F.when(low.contains(k.lower()), F.lit(v)) for k, v in sorted(signatures.items(), key=lambda kv: (-len(kv[0]), kv[0]))]
    found = F.coalesce(*rules, F.try_element_at(T.law_ids(F.col("content")), F.lit(1)))
    unknown = F.coalesce(F.upper("law_id"), F.lit("UNKNOWN")) == "UNKNOWN"
    return chunks.withColumn("healed", unknown & found.isNotNull()).withColumn("law_id", F.when(unknown, F.coalesce(found, "law_id")).otherwise(F.col("law_id")))


def heal_rank(title: Column, rank: Column, law_id: Column | None = None) -> Column:
    """SCA-20: rank from the registry title: constitution 3, code or the offence code 2, else as it was."""
    low = F.lower(F.coalesce(title, F.lit("")))
    code = low.contains("кодекс")
    if law_id is not None:
        code = code | F.coalesce(canonical(law_id) == dims.OFFENCE_CODE, F.lit(False))
    return F.when(low.contains("конституц"), 3).when(code, 2).otherwise(rank)


#: SCA-21, fixed patterns and the ranks of document prefixes and tiers.
FALSE_CODE = r"(?iuU)\b(?:этическ\w*|поведени\w*|корпоративн\w*)\s+кодекс"
STRICT_CODE = r"(?iuU)\b(?:Гражданск\w*|Налогов\w*|Уголовн\w*|Трудов\w*|Экологическ\w*|Бюджетн\w*|Предпринимательск\w*|Административн\w*)\s+кодекс"
REPUBLIC_CODE = r"(?iu)Кодекс\s+Республики\s+Казахстан"
ARTICLE_REFERENCE = r"(?iuU)\b(?:Статья\s+\d+|ст\.\s*\d+|бап\s+\d+)"
OFFICIAL_MARKER = r"(?iuU)\b(?:закон\s+РК|Республики\s+Казахстан|о\s+внесении\s+изменений)\b"
PREFIX_RANK = {"k": 2, "z": 4, "p": 6, "u": 6, "v": 7}
TIER_RANK = {"TIER_1": 7, "TIER_2": 10, "TIER_3": 11, "BLACKLIST": 11}


def rank_score(tier: Column, title: Column, content: Column, url: Column) -> Column:
    """SCA-21: struct(rank, confidence, points): blacklist, then the document prefix of the primary source's address, then points."""
    both = F.concat(F.coalesce(title, F.lit("")), F.lit(" \n "), F.coalesce(content, F.lit("")))
    host = F.coalesce(T.host(url), F.lit(""))
    official = (tier == "TIER_1") | F.exists(F.array(*[F.lit(d) for d in dims.TIER_1]), lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))
    strict, false = both.rlike(STRICT_CODE) | both.rlike(REPUBLIC_CODE), both.rlike(FALSE_CODE)
    points = (
        F.when(official, 3).otherwise(0) + F.when(strict & ~false, 4).when(F.contains(F.lower(both), F.lit("кодекс")) & ~false, 1).otherwise(0)
        + F.when(both.rlike(ARTICLE_REFERENCE), 2).otherwise(0) + F.when(both.rlike(OFFICIAL_MARKER), 1).otherwise(0)
    )
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    prefix = F.when(host.contains("adilet.zan.kz"), F.regexp_extract(path, r"/docs/([kzvpu])\d", 1))
    by_prefix, by_tier = (F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for m in (PREFIX_RANK, TIER_RANK))

    def found(rank: Column, confidence: Column, n: Column) -> Column:
        return F.struct(rank.cast("int").alias("rank"), confidence.cast("double").alias("confidence"), n.cast("int").alias("points"))

    return (
        F.when(tier == "BLACKLIST", found(F.lit(11), F.lit(1.0), F.lit(0)))
        .when(F.coalesce(prefix, F.lit("")) != "", found(by_prefix[prefix], F.lit(1.0), F.lit(0)))
        .when(points >= 6, found(F.lit(2), F.least(F.lit(1.0), 0.5 + 0.05 * points), points))
        .when(points >= 4, found(F.lit(4), F.least(F.lit(0.9), 0.4 + 0.05 * points), points))
        .otherwise(found(by_tier[tier], F.lit(0.5), points))
    )


def canonical(law: Column) -> Column:
    """Law id in canonical form: upper case, without a tag, aliases of renumbered laws followed."""
    core = F.coalesce(T.law_core(law), F.upper(F.trim(law)))
    out = core
    for old, new in dims.LAW_ALIASES.items():
        out = F.when(core == old, F.lit(new)).otherwise(out)
    return out


@F.pandas_udf(DoubleType())
def title_ratio(title: pd.Series, asked: pd.Series) -> pd.Series:
    """Matching-block ratio of a title to what was asked; not an edit distance, which is why it runs in Python, on candidates alone."""
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() if x and y else 0.0 for x, y in zip(title, asked, strict=True)])


def title_key(title: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(title), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


#: SCA-17: least ratio of a fuzzy title, least characters of what was asked, least characters of a word of content.
TITLE_RATIO, TITLE_LEAST, TITLE_WORD = 0.6, 10, 4


def grams(text: Column) -> Column:
    """Distinct runs of one to three characters."""
    return F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda q: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - q + 1)), lambda i: F.substr(text, i, q)))))


def title_parts(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """SCA-17, step 6: (key, title_key) where one holds the other. The shorter one's first characters, up to three, are among
    the longer one's runs of characters, which makes it a join by equal keys. An empty key is part of every title."""
    begins = F.substring("x", 1, 3)
    a = asked.where("key <> ''").select("key", F.col("key").alias("x"))
    t = titles.where("title_key <> ''").select("title_key", F.col("title_key").alias("x"))
    inside = t.withColumn("gram", begins).drop("x").join(a.select("key", F.explode(grams(F.col("x"))).alias("gram")), "gram").where(F.contains("key", "title_key"))
    around = a.withColumn("gram", begins).drop("x").join(t.select("title_key", F.explode(grams(F.col("x"))).alias("gram")), "gram").where(F.contains("title_key", "key"))
    every = asked.where("key = ''").select("key").join(titles.where("title_key <> ''").orderBy("place").limit(1).select("title_key"))
    return inside.select("key", "title_key").unionByName(around.select("key", "title_key")).unionByName(every).distinct()


def letters(text: Column) -> Column:
    """Characters with their number of occurrence, so that common ones of two texts can be counted as a set."""
    chars = F.array_sort(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.transform(chars, lambda c, i: F.concat(c, i - F.array_position(chars, c)))


def fuzzy_titles(asked: DataFrame, titles: DataFrame) -> DataFrame:
    """SCA-17, step 7: (key, title_key) of the nearest title at a ratio of 0.6 or more, if it shares a word of four characters.

    The nearest is sought first and the word asked for then: a farther title with a common word is no substitute. Matching
    blocks of a ratio r over lengths m and n hold r * (m + n) / 2 characters, so both texts have that many characters in common,
    neither is much longer, and they meet in their rarest characters: an index of numbered characters with length, prefix and count
    filters gives the candidates, without loss, and the ratio itself is computed for these alone. Ties: the greater title.
    """
    half = TITLE_RATIO / 2
    short = TITLE_RATIO / (2 - TITLE_RATIO)
    sides = {}
    df = titles.select("title_key", F.explode(letters(F.col("title_key"))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    for name, rows in (("key", asked.where(F.length("key") >= TITLE_LEAST)), ("title_key", titles.where("title_key <> ''"))):
        own = rows.select(name, letters(F.col(name)).alias("ws")).withColumn("n", F.size("ws"))
        ranked = own.select(name, "n", F.explode("ws").alias("w")).join(df, "w", "left")
        nth = F.row_number().over(Window.partitionBy(name).orderBy(F.coalesce("df", F.lit(0)), "w"))
        needed = F.ceil(half * (F.col("n") + F.ceil(short * F.col("n") - 1e-9)) - 1e-9)
        sides[name] = own, ranked.withColumn("nth", nth).where(F.col("nth") <= F.col("n") - needed + 1).select(name, "w")
    near = sides["key"][1].join(sides["title_key"][1], "w").select("key", "title_key").distinct()
    full = near.join(sides["key"][0], "key").join(sides["title_key"][0].select("title_key", F.col("ws").alias("vs"), F.col("n").alias("m")), "title_key")
    enough = F.size(F.array_intersect("ws", "vs")) >= half * (F.col("n") + F.col("m")) - 1e-9
    rated = full.where(enough).select("key", "title_key").withColumn("ratio", title_ratio("title_key", "key")).where(F.col("ratio") >= TITLE_RATIO)
    nearest = rated.groupBy("key").agg(F.max(F.struct("ratio", "title_key")).alias("m")).select("key", "m.title_key")
    words = lambda c: F.filter(F.split(c, " "), lambda w: F.length(w) >= TITLE_WORD)
    return nearest.where(F.arrays_overlap(words(F.col("key")), words(F.col("title_key"))))


def resolve_laws(raw: DataFrame, registry: DataFrame, column: str = "raw") -> DataFrame:
    """SCA-17: distinct raw strings to canonical law ids, by the first of the ordered steps that hits.

    registry (law_id, code, title): one row a law and title; with a column `place` its order breaks ties, else the id does.
    Steps: exact id, code, same core, alias, id-shaped input as it is (never fuzzy), exact title, title part, fuzzy title, input.
    All joins are by equal keys; Spark decides whether the registry is small enough to be sent to every task.
    """
    ids = raw.select(F.trim(column).alias("raw")).where("raw <> ''").distinct().withColumns({"up": F.upper("raw"), "key": title_key(F.col("raw"))})
    ids = written(ids.withColumn("core", T.law_core(F.col("up"))), "asked")
    place = F.col("place") if "place" in registry.columns else F.col("law_id")
    reg = registry.select("law_id", place.alias("place"), F.upper("law_id").alias("id_up"), F.rtrim(F.upper("code"), F.lit("_")).alias("code_up"), T.law_core(F.col("law_id")).alias("reg_core"), title_key(F.col("title")).alias("title_key"))

    def step(n: int, mine: Column, own: str) -> DataFrame:
        first = reg.where(F.col(own).isNotNull()).groupBy(F.col(own).alias("_key")).agg(F.min_by("law_id", F.struct("place", "law_id")).alias("law_id"))
        return ids.select("raw", mine.alias("_key")).join(first, "_key").select("raw", "law_id", F.lit(n).alias("step"))

    shaped = F.col("core").isNotNull()
    alias = F.create_map(*[F.lit(x) for kv in dims.LAW_ALIASES.items() for x in kv])
    steps = step(1, F.col("up"), "id_up").unionByName(step(2, F.rtrim("up", F.lit("_")), "code_up")).unionByName(step(3, F.col("core"), "reg_core"))
    steps = steps.unionByName(ids.select("raw", F.try_element_at(alias, F.col("up")).alias("law_id"), F.lit(4).alias("step")).where("law_id is not null"))
    steps = steps.unionByName(ids.where(shaped).select("raw", F.col("raw").alias("law_id"), F.lit(5).alias("step")))
    titles = reg.where("title_key <> ''").groupBy("title_key").agg(F.min(F.struct("place", "law_id")).alias("m")).select("title_key", "m.place", "m.law_id")
    titled = ids.where(~shaped).select("raw", "key")
    keys = titled.select("key").distinct()
    parts = titled.join(title_parts(keys, titles), "key").join(titles, "title_key")
    parts = parts.groupBy("raw").agg(F.min(F.struct(F.when(F.col("key") == F.col("title_key"), 6).otherwise(7).alias("step"), "place", "law_id")).alias("m")).select("raw", "m.law_id", "m.step")
    steps = written(steps.unionByName(parts), "resolved")
    left = titled.join(steps.select("raw"), "raw", "left_anti")
    fuzzy = left.join(fuzzy_titles(left.select("key").distinct(), titles), "key").join(titles, "title_key")
    steps = steps.unionByName(fuzzy.select("raw", "law_id", F.lit(8).alias("step"))).unionByName(ids.select("raw", F.col("raw").alias("law_id"), F.lit(9).alias("step")))
    return steps.groupBy("raw").agg(F.min(F.struct("step", "law_id")).alias("m")).select("raw", "m.law_id", "m.step")


def exact_metadata(claims: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """JOI-02: (keys, id) of chunks of a law and article that the claim names. claims: laws (canonical), article."""
    asked = claims.where("article is not null").select(*keys, F.explode("laws").alias("law"), "article")
    have = chunks.select("id", canonical(F.col("law_id")).alias("law"), "article")
    return asked.join(have, ["law", "article"]).select(*keys, "id").distinct()


def inject_claim_driven(claims: DataFrame, corpus: DataFrame, present: DataFrame) -> DataFrame:
    """JOI-03: corpus chunks of the laws and articles that claims name and that aren't present, tagged as local."""
    wanted = claims.where("article is not null").select(F.explode("laws").alias("law"), "article").distinct()
    have = corpus.withColumn("law", canonical(F.col("law_id")))
    return have.join(wanted, ["law", "article"], "left_semi").join(present.select("id"), "id", "left_anti").drop("law").withColumn("adilet_fallback_used", F.lit("LOCAL_CACHE"))


def inject_plan_driven(queries: DataFrame, corpus: DataFrame, order: str, limit: int = 150) -> DataFrame:
    """JOI-04, as intended: per law the asked articles, or the whole law (first `limit` chunks) if a query names none.

    queries: (law, articles array).
    """
    asked = queries.groupBy("law").agg(F.array_distinct(F.flatten(F.collect_list("articles"))).alias("articles"), F.bool_or(F.size("articles") == 0).alias("whole"))
    rows = corpus.withColumn("law", canonical(F.col("law_id"))).join(asked, "law").where(F.col("whole") | F.array_contains("articles", F.col("article")))
    nth = F.row_number().over(Window.partitionBy("law").orderBy(order))
    return rows.withColumn("_n", nth).where(~F.col("whole") | (F.col("_n") <= limit)).drop("_n", "articles", "whole", "law")


def by_metadata(chunks: DataFrame, law: str, article: str | None = None, limit: int | None = None, order: str = "id") -> DataFrame:
    """SRC-06: chunks of a law and maybe article; the limit holds for whole laws only."""
    rows = chunks.where(F.upper("law_id") == law.upper())
    if article is not None:
        return rows.where(F.col("article") == article)
    return rows.orderBy(order).limit(limit) if limit else rows


def cache_key(version: Column, model: Column, prompt: Column) -> Column:
    """SNK-05: sha256 of v<version>:<model>:<prompt key>."""
    return F.sha2(F.concat(F.lit("v"), version, F.lit(":"), model, F.lit(":"), prompt), 256)


def cache_put(cache: DataFrame, new: DataFrame, now: Column, ttl_seconds: int | None) -> DataFrame:
    """SNK-05: replace by key with an expiry time."""
    expires = now + F.make_interval(secs=F.lit(ttl_seconds)) if ttl_seconds is not None else F.lit(None).cast("timestamp")
    return insert_or_replace(new.withColumn("expires_at", expires), cache, "key", "seq")


def cache_live(cache: DataFrame, now: Column) -> DataFrame:
    """SNK-05: entries that haven't expired; the purge writes these back."""
    return cache.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def cache_misses(prompts: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """LLM-01: the work list, prompts without a live answer, each key once."""
    return prompts.dropDuplicates(["key"]).join(cache_live(cache, now).select("key"), "key", "left_anti")


def missing_vectors(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """JOI-21: chunks still to embed."""
    return chunks.join(vectors.select("id"), "id", "left_anti")


def table_counts(**tables: DataFrame) -> DataFrame:
    """SNK-13: (table_name, n) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = row if out is None else out.unionByName(row)
    return out
