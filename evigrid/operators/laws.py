"""Law registry: loading, codes and addresses, laws that texts and claims name, ids of files, verification.

A registry is a table (law_id, code, title_ru, title_kz), one row a law: a dimension whose size doesn't follow the corpus. It
is joined by equal keys; Spark decides whether it is small enough to send to every task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions import text as T
from ..storage import written
from . import corpus

BASE = "https://adilet.zan.kz"
#: Fixed patterns: registry codes, short ids, and the references of SCA-14 and SCA-19.
CODE = r"^[A-Z]\d{8,10}_?$"
SHORT = r"(?i)^\d+-[IVXLCDM]+$"
PREAMBLE = r"(?iuUs)(?:вносятся?|внести|внесении)\s+изменений?\s+(?:и\s+дополнений?\s+)?в\s+.{0,80}?(?:№\s*)?(\d{2,4}[-–]\w{1,5})"
TITLED = r"(?iuUs)(?:Закон\w*|Кодекс\w*)\s+.{0,120}?(?:№\s*)?(\d{2,4}[-–][IVXivxІі]{1,5})\b"
REFERENCES = (
    r"(?iuU)от\s+\d+\s+\w+\s+\d{4}\s+года?\s*№\s*(\d+-[IVXLCD]+)",
    r"(?iuU)№\s*(\d+-[IVXLCD]+)",
    r"(?iuU)№\s*([A-Z]\d{8,10}_?)",
    r"(?U)\b(\d{2,4}-[IVXLCD]{1,6})\b",
)


def load_registry(stored: DataFrame, static: DataFrame) -> DataFrame:
    """SRC-21: stored rows, and static ones whose title equals no stored title in either language (normalised)."""
    titles = stored.select(corpus.title_key(F.col("title_ru")).alias("_key")).unionByName(stored.select(corpus.title_key(F.col("title_kz")).alias("_key"))).where("_key is not null and _key <> ''").distinct()
    added = static.withColumn("_key", corpus.title_key(F.col("title_ru"))).join(titles, "_key", "left_anti").drop("_key")
    return stored.unionByName(added, allowMissingColumns=True)


def title_of(title_ru: Column, title_kz: Column, law_id: Column, lang: str = "ru") -> Column:
    """SCA-18: the title in a language, else in Russian, else the id."""
    some = lambda c: F.nullif(c, F.lit(""))
    return F.coalesce(some(title_kz), some(title_ru), law_id) if lang == "kz" else F.coalesce(some(title_ru), law_id)


def id_variants(law_id: Column, raw: Column, code: Column) -> Column:
    """SCA-18: all equal writings of a law: id, raw string, code with and without its trailing mark; sorted."""
    every = F.array(law_id, F.upper(law_id), F.upper(F.trim(raw)), code, F.rtrim(code, F.lit("_")))
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: x.isNotNull() & (x != ""))))


def law_url(code: Column, lang: str = "rus") -> Column:
    """SCA-18: the address of a law; empty without a code, never guessed."""
    return F.coalesce(F.concat(F.lit(f"{BASE}/{lang}/docs/"), F.nullif(code, F.lit(""))), F.lit(""))


def candidate_urls(law_id: Column, code: Column) -> Column:
    """SRC-12: addresses to try: by the registry's code, with and without the mark; a code as it is, with and without; a
    short id that the registry lacks gives none; anything else as it is."""
    one = lambda c: F.concat(F.lit(f"{BASE}/rus/docs/"), c)
    bare = F.rtrim(law_id, F.lit("_"))
    other = F.when(law_id.endswith("_"), bare).otherwise(F.concat(law_id, F.lit("_")))
    known = F.when(code.endswith("_"), F.array(one(code), one(F.rtrim(code, F.lit("_"))))).otherwise(F.array(one(code)))
    return F.when(code.isNotNull(), known).when(law_id.rlike(r"^[A-Z]\d{9}"), F.array(one(law_id), one(other))).when(law_id.rlike(SHORT), F.array().cast("array<string>")).otherwise(F.array(one(law_id)))


def _resolved(named: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """named (keys, pos, raw) with law_id by SCA-17, one row a law at its first place, numbered."""
    found = corpus.resolve_laws(named, registry.select("law_id", "code", F.col("title_ru").alias("title"))).select("raw", "law_id")
    rows = named.withColumn("raw", F.trim("raw")).join(found, "raw").groupBy(*keys, "law_id").agg(F.min("pos").alias("pos"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy("pos", "law_id")) - 1).drop("pos")


def target_candidates(text: Column) -> Column:
    """SCA-14: ids in the first 1200 characters after the words for amending, then after law or code, then by title phrases."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 1200)
    flat = lambda x: F.upper(F.translate(x, "–‑", "--"))
    by_number = F.transform(F.concat(F.regexp_extract_all(head, F.lit(PREAMBLE), F.lit(1)), F.regexp_extract_all(head, F.lit(TITLED), F.lit(1))), flat)
    low = F.lower(head)
    hints = F.array_compact(F.array(*[F.when(low.contains(k), F.lit(v)) for k, v in dims.TITLE_HINTS.items()]))
    return F.array_distinct(F.concat(by_number, hints))


def target_laws(docs: DataFrame, registry: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCA-14: (doc_id, nth, law_id) of the laws that a bill amends, canonical, each once, in order of their first place."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(target_candidates(F.col(text_col))).alias("pos", "raw"))
    return _resolved(named, registry, ["doc_id"])


def law_references(docs: DataFrame, registry: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCA-19: (doc_id, law_id) of laws named in the first 10 000 characters: what the registry knows, and short ids that it lacks."""
    head = F.substring(F.col(text_col), 1, 10_000)
    raw = F.flatten(F.array(*[F.regexp_extract_all(head, F.lit(p), F.lit(1)) for p in REFERENCES]))
    named = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(raw)).alias("raw"))
    found = corpus.resolve_laws(named, registry.select("law_id", "code", F.col("title_ru").alias("title"))).select("raw", "law_id")
    rows = named.withColumn("raw", F.trim("raw")).join(found, "raw")
    law = F.when(F.col("law_id") != F.col("raw"), F.col("law_id")).when(F.col("raw").rlike(r"(?i)^\d{2,4}-[IVXLCD]{1,6}$"), F.upper("raw"))
    return rows.select("doc_id", law.alias("law_id")).where("law_id is not null").distinct()


def clean_entities(entities: Column) -> Column:
    """SCA-13: entities in upper case without spaces, the mark of laws and hyphens at the ends."""
    none = F.array().cast("array<string>")
    return F.transform(F.coalesce(entities, none), lambda e: F.btrim(F.regexp_replace(F.replace(F.upper(F.trim(e)), F.lit(" "), F.lit("")), "ЗРК", ""), F.lit("-")))


def claim_laws(claim_text: Column, quote: Column, entities: Column, target_laws: Column) -> Column:
    """SCA-13: ids of the laws that a claim names, sorted. Target laws override everything else; else entities in id form, names
    and abbreviations, and ids in the text."""
    none = F.array().cast("array<string>")
    by_entity = F.filter(clean_entities(entities), lambda e: e.rlike(r"^\d+-[-‐–A-Z]+$"))
    low = F.lower(F.concat(F.coalesce(claim_text, F.lit("")), F.lit(" "), F.coalesce(quote, F.lit(""))))

    def named(name: str) -> Column:
        return low.rlike(rf"(?iuU)\b{name}\b") if len(name) <= 3 else low.contains(name.lower())

    by_name = F.flatten(F.array_compact(F.array(*[F.when(named(k), F.array(*[F.lit(x) for x in v])) for k, v in dims.LAW_NAMES.items()])))
    ids = F.transform(F.regexp_extract_all(low, F.lit(r"(?iuU)\b(\d+[-‐–][IVXivxІі]{1,5})\b"), F.lit(1)), lambda x: F.translate(F.upper(x), "Іі", "Ii"))
    own = F.concat(by_entity, by_name, ids)
    return F.array_sort(F.array_distinct(F.when(F.size(F.coalesce(target_laws, none)) > 0, target_laws).otherwise(own)))


#: SCA-13: what a registry code looks like; a code counts even if the registry lacks it.
CODE_SHAPE = r"^[A-Z]\d{8,10}_?$"


def laws_of_claims(claims: DataFrame, registry: DataFrame, keys: list[str]) -> DataFrame:
    """SCA-13 with the registry: (keys, laws) of claims (keys, claim_text, quote, entities, target_law_ids), canonical, sorted.

    Beside id forms, names and ids in the text, an entity counts if the registry locates it: it resolves to a law with a code,
    or is a code. Target laws override everything. registry as in `resolve_laws`.
    """
    none = F.array().cast("array<string>")
    rows = claims.select(*keys, clean_entities(F.col("entities")).alias("_entities"), F.coalesce("target_law_ids", none).alias("_targets"), claim_laws(F.col("claim_text"), F.col("quote"), F.col("entities"), F.col("target_law_ids")).alias("_named"))
    entities = rows.where(F.size("_targets") == 0).select(*keys, F.explode("_entities").alias("raw")).where("raw <> ''")
    coded = registry.where(F.coalesce("code", F.lit("")) != "").select("law_id").distinct()
    located = corpus.resolve_laws(entities, registry).select("raw", "law_id").join(coded, "law_id", "left_semi").select("raw")
    by_code = entities.where(F.col("raw").rlike(CODE_SHAPE)).select("raw").unionByName(located).distinct()
    found = written(entities.join(by_code, "raw").select(*keys, "raw").unionByName(rows.select(*keys, F.explode("_named").alias("raw"))), "named")
    canonical = corpus.resolve_laws(found, registry).select("raw", F.upper("law_id").alias("law"))
    laws = found.withColumn("raw", F.trim("raw")).join(canonical, "raw").groupBy(*keys).agg(F.array_sort(F.collect_set("law")).alias("laws"))
    return claims.select(*keys).join(laws, keys, "left").withColumn("laws", F.coalesce("laws", none))


def file_law_id(path: Column, text: Column, codes: dict[str, str]) -> Column:
    """SCA-24: the law of a file: constitution, known codes or a short id in its name, codes in its folder's name, then the same
    in the first 2000 characters of its text; else UNKNOWN. codes: registry code to short id, checked in order."""
    parts = F.split(path, "/")
    name, folder, head = F.lower(F.element_at(parts, -1)), F.lower(F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))), F.substring(F.coalesce(text, F.lit("")), 1, 2000)
    low = F.lower(head)

    def coded(where: Column) -> Column:
        return F.coalesce(*[F.when(where.contains(k.lower()) | where.contains(k.lower().replace("_", "")), F.lit(v)) for k, v in codes.items()], F.lit(None).cast("string"))

    def found(where: Column, pattern: str) -> Column:
        return F.nullif(F.upper(F.regexp_extract(where, pattern, 1)), F.lit(""))

    def constitution(where: Column) -> Column:
        return F.when(where.contains("k2600000000") & ~where.contains("k950001000"), "K2600000000_").otherwise("K950001000_")

    header = F.when(low.contains("k2600000000"), "K2600000000_").otherwise("K950001000_")
    return F.coalesce(
        F.when(name.contains("конституция") | folder.contains("конституция"), constitution(name)), coded(name), found(name, r"(?iuU)\b(\d+-[ivxldc]+)\b"), coded(folder),
        F.when(low.contains("конституция"), header), coded(low), found(head, r"(?iuU)№\s*(\d+-[IVXLCD]+)"), found(head, r"(?iuU)\b(\d+-[IVXLCD]+)\b"), F.lit("UNKNOWN"),
    )


def source_title(law_id: Column, registry_title: Column, article: Column, own_title: Column) -> Column:
    """SCA-29: the caption of a source: the registry's title with the article, else its own title."""
    known = F.coalesce(registry_title != law_id, F.lit(False))
    return F.when(known, F.when(F.coalesce(article, F.lit("")) != "", F.concat(registry_title, F.lit(" | Ст. "), article)).otherwise(registry_title)).otherwise(own_title)


def source_link(code: Column, article: Column, own_url: Column) -> Column:
    """SCA-29: the address by the registry's code with the article as anchor, else the source's own."""
    url = law_url(code)
    anchored = F.when(F.coalesce(article, F.lit("")) != "", F.concat(url, F.lit("#"), article)).otherwise(url)
    return F.when(url != "", anchored).otherwise(F.coalesce(own_url, F.lit("")))


def verify_registry(stored: DataFrame, static: DataFrame, pages: DataFrame) -> DataFrame:
    """JOI-20: (law_id, code, state) of every law, the stored pair before the static one, by the page fetched for its code.

    pages (code, status, title, text). broken without a page of status 200 and a title; stale if the text says repealed;
    title_differs if the first 12 letters and digits of the titles differ; else verified.
    """
    every = stored.select("law_id", "code", "title_ru", F.lit(0).alias("_p")).unionByName(static.select("law_id", "code", "title_ru", F.lit(1).alias("_p")))
    first = F.row_number().over(Window.partitionBy("law_id").orderBy("_p", "code"))
    rows = every.withColumn("_rn", first).where("_rn = 1").join(pages.select("code", "status", "title", "text"), "code", "left")
    short = lambda c: F.substring(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), 1, 12)
    bad = F.coalesce((F.col("status") != 200) | (F.trim("title") == ""), F.lit(True)) | F.col("title").isNull()
    state = F.when(bad, "broken").when(F.lower("text").contains("утратил силу"), "stale").when(short(F.col("title")) != short(F.col("title_ru")), "title_differs").otherwise("verified")
    return rows.select("law_id", "code", state.alias("state"))
