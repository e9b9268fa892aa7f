"""Text functions as Column expressions; nothing here runs Python on executors but `nfc`, and that on few texts.

Operator ids of the inventory stand in the docstrings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .. import dims

#: A word character on both Java and RE2, for plans that have an SQL oracle.
WORD = r"[\p{L}\p{N}_]"


def contains_any(text: Column, needles: tuple[str, ...] | list[str]) -> Column:
    """True if the text contains one of a fixed list of strings."""
    out = F.lit(False)
    for needle in needles:
        out = out | text.contains(needle)
    return out


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    import unicodedata

    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


#: Characters that NFC leaves as they are whatever stands beside them: up to U+02FF, Cyrillic letters, dashes and quotes.
COMPOSED = r"^[\u0000-\u02FF\u0400-\u0482\u048A-\u04FF\u2010-\u2027]*$"


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no such function: texts of characters that can't change stay in the plan, others go to Python."""
    same = text.rlike(COMPOSED)
    return F.coalesce(F.when(same, text), _composed(F.when(~same, text)))


def transliterate(text: Column) -> Column:
    """SCA-01 without NFC: Kazakh Latin digraphs and diacritics to Cyrillic where the trigger pattern is found."""
    out = text
    for latin, cyrillic in dims.DIGRAPHS.items():
        out = F.replace(out, F.lit(latin), F.lit(cyrillic))
    out = F.translate(out, "".join(dims.DIACRITICS), "".join(dims.DIACRITICS.values()))
    return F.when(text.rlike(r"(?iu)[áéíóúüñğqw]|gh|zh|sh|ch|kh"), out).otherwise(text)


def content_id(text: Column) -> Column:
    """SCA-03: sha256 of the content."""
    return F.sha2(text, 256)


def word_count(text: Column) -> Column:
    """SCA-03: words between white space; 0 for null or blank."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def language(text: Column) -> Column:
    """SCA-02 heuristic: kk by its letters in the first 3000 characters; else by a ratio of 2 over the first 500 ru or Latin, which
    is kk if the first 1000 hold a letter or word of Kazakh in Latin script and else en; else mixed. Null is mixed."""
    text = F.coalesce(text, F.lit(""))
    head, sample = F.substring(text, 1, 500), F.lower(F.substring(text, 1, 1000))
    cyrillic = F.regexp_count(head, F.lit(r"[\u0400-\u04ff]"))
    latin = F.regexp_count(head, F.lit(f"[a-zA-Z{dims.KAZAKH_LATIN_LETTERS}ÁÑÓÚĞŞÝ]"))
    kazakh = F.substring(text, 1, 3000).rlike(f"[{dims.KAZAKH_LETTERS}]")
    kazakh_latin = sample.rlike(f"[{dims.KAZAKH_LATIN_LETTERS}]") | F.arrays_overlap(F.split(sample, r"\s+"), F.array(*[F.lit(w) for w in dims.KAZAKH_LATIN_WORDS]))
    by_ratio = F.when(cyrillic > 2 * latin, "ru").when(latin > 2 * cyrillic, F.when(kazakh_latin, "kk").otherwise("en")).otherwise("mixed")
    return F.when(kazakh, "kk").otherwise(by_ratio)


def query_language(text: Column) -> Column:
    """RNK-05: kk, ru or null."""
    return F.when(text.rlike(f"[{dims.KAZAKH_LETTERS}]"), "kk").when(text.rlike("[а-яА-ЯёЁ]"), "ru")


def tokens(text: Column, stop_words: list[str] = dims.STOP_WORDS, least: int = 3) -> Column:
    """SCA-06: lower-case words of at least `least` characters that aren't stop words; punctuation but the hyphen splits."""
    cleaned = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s\-]", " ")
    words = F.filter(F.split(cleaned, r"\s+"), lambda t: F.length(t) >= least)
    kept = F.filter(words, lambda t: ~t.isin(*stop_words)) if stop_words else words  # a set of literals: one lookup a word
    return F.coalesce(kept, F.array().cast("array<string>"))


def stem(word: Column) -> Column:
    """SCA-07 suffix rule: the first suffix of the list that leaves at least 3 characters of a word longer than 4."""
    rule = F.coalesce(*[F.when(word.endswith(s) & (F.length(word) - len(s) >= 3), F.lit(len(s))) for s in dims.SUFFIXES], F.lit(0))
    return F.when(F.length(word) <= 4, word).otherwise(F.substring(word, F.lit(1), F.length(word) - rule))


def morph_tokens(text: Column) -> Column:
    """SCA-07: legal stop words go before stemming; a text of stop words alone keeps them."""
    words = tokens(text, [])
    kept = F.filter(words, lambda t: ~t.isin(*dims.LEGAL_STOP_WORDS))
    return F.transform(F.when(F.size(kept) > 0, kept).otherwise(words), stem)


def normalise_claim(text: Column) -> Column:
    """SCA-16: lower case without punctuation, stop words and words of up to 2 characters."""
    bare = F.translate(F.lower(text), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»—– ", "")
    return F.array_join(F.filter(F.split(bare, r"\s+"), lambda t: (F.length(t) > 2) & ~t.isin(*dims.STOP_WORDS)), " ")


FUSION_NUMBER = r"(?iuU)\b(\d[\d\s]{0,4}(?:[.,]\d{1,3})?)\s*(%|млн\.?|млрд\.?|тыс\.?|тг\.?|kzt|мрп|мзп|лет|месяц\w*|дн\w*|час\w*)\b"
AUDIT_NUMBER = r"(?iuU)\b(\d[\d\s]{0,5}(?:[.,]\d{1,4})?)\s*(%|млн\.?|млрд\.?|тыс\.?|тг\.?|kzt|мрп|мзп|лет|месяц\w*|дн\w*|тенге|процент\w*)\b"


def numbers_with_units(text: Column, pattern: str = FUSION_NUMBER) -> Column:
    """SCA-09: array of (unit, value) as found, values without spaces and with a decimal point."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
    return F.zip_with(
        units, values, lambda u, v: F.struct(F.rtrim(F.lower(u), F.lit(".")).alias("unit"), F.replace(F.replace(v, F.lit(" "), F.lit("")), F.lit(","), F.lit(".")).alias("value"))
    )


def safe_number(value: Column) -> Column:
    """SCA-10: double, or null for ranges and whatever else isn't one."""
    return F.when(value.rlike(r"^-?[\d.]+$"), value.try_cast("double"))


def years(text: Column) -> Column:
    """SCA-11: all years 2000 to 2029."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(20[0-2]\d)"), F.lit(1)), lambda y: y.cast("int"))


def _first(*found: Column) -> Column:
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def article_of(text: Column) -> Column:
    """SCA-12: article number of a claim, by the first rule that hits (RU, KK, KK reversed)."""
    return _first(
        F.regexp_extract(text, r"(?iu)\b(?:стать[яиюе]|ст\.?)\s*(\d+[\-\d]*)", 1),
        F.regexp_extract(text, r"(?iu)\b(\d+[\-\d]*)-(?:бап|бабы|бабының|бапта|баптың|бабына)", 1),
        F.regexp_extract(text, r"(?iu)\b(?:бап|бабы|бабының|бапта|баптың|бабына)\s*(\d+[\-\d]*)", 1),
    )


def law_core(law_id: Column) -> Column:
    """FN-12: <number>-<roman> without a tag, or null."""
    return _first(F.regexp_extract(F.upper(F.trim(law_id)), r"^(\d+-[IVXLCDM]+)(?:-[A-Z]+)?$", 1))


def law_ids(text: Column) -> Column:
    """SCA-13, pattern part: ids such as 413-IV, upper case, each once in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?iu)\b(\d+[-‐–][IVXІі]{1,5})\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.translate(F.upper(x), "‐–І", "--I")))


def host(url: Column) -> Column:
    """Host without www., lower case; null where there is none."""
    return _first(F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@]*@)?([^/:?#]+)", 1)), r"^www\.", ""))


def web_tier(url: Column, tier_1=dims.TIER_1, tier_2=dims.TIER_2, tier_3=dims.TIER_3, blacklist=dims.BLACKLIST) -> Column:
    """SCA-22: blacklist by substring, then the tiers by domain or sub-domain; unknown hosts are TIER_3."""

    def tier(h: Column) -> Column:
        def within(domains: tuple[str, ...]) -> Column:
            return F.exists(F.array(*[F.lit(d) for d in domains]), lambda d: (h == d) | F.endswith(h, F.concat(F.lit("."), d)))

        black = contains_any(F.lower(url), blacklist) | contains_any(h, blacklist)
        return F.when(black, "BLACKLIST").when(within(tier_1), "TIER_1").when(within(tier_2), "TIER_2").when(within(tier_3), "TIER_3").otherwise("TIER_3")

    return F.get(F.transform(F.array(F.coalesce(host(url), F.lit(""))), tier), F.lit(0))  # the host is made once


def repair_spacing(text: Column) -> Column:
    """SCA-04: a line of more than two words, over 40% of them single characters, is split at runs of two spaces; groups that
    are mostly single characters are joined."""

    def fixed(line: Column) -> Column:
        words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
        single = F.size(F.filter(words, lambda w: F.length(w) == 1))
        groups = F.transform(F.split(F.trim(line), r"\s{2,}"), _join_group)
        return F.when((F.size(words) > 2) & (single > 0.4 * F.size(words)), F.array_join(groups, " ")).otherwise(line)

    return F.array_join(F.transform(F.split(text, "\n"), fixed), "\n")


def _join_group(group: Column) -> Column:
    parts = F.split(F.trim(group), r"\s+")
    return F.when(F.size(F.filter(parts, lambda w: F.length(w) == 1)) > 0.5 * F.size(parts), F.array_join(parts, "")).otherwise(group)


def repair_breaks(text: Column) -> Column:
    """SCA-05: numbers broken over a line end."""
    return F.regexp_replace(F.regexp_replace(text, r"(\d+)-\s*\n\s*(\d+)", "$1-$2"), r"(?iu)(\d+)\s*\n\s*-(бап)", "$1-$2")


#: SCA-28, fixed patterns in order.
LABEL_RULES = (
    (r"\(\s*S\d+(?:\s*,\s*S\d+)*\s*\)", ""),
    (r"(?<=\()\s*S\d+(?:\s*,\s*S\d+)*\s*,\s*", ""),
    (r"\s*,\s*S\d+(?:\s*,\s*S\d+)*\s*(?=\))", ""),
    (r"(?iu),?\s*источник[аи]?\s+S\d+(?:\s*,\s*S\d+)*\s*:?", ""),
    (r"(?iu),?\s*в\s+ред(?:акции|\.)?\s+S\d+(?:\s*,\s*S\d+)*", ""),
    (r"\(\s*[;:,]\s*", "("),
    (r"\(\s*\)", ""),
    (r"\s{2,}", " "),
    (r"\s+([.,;:)])", "$1"),
)


def clean_labels(text: Column) -> Column:
    """SCA-28: source labels in brackets, and after the words for source and wording, go with the marks they leave behind."""
    for pattern, with_ in LABEL_RULES:
        text = F.regexp_replace(text, pattern, with_)
    return F.btrim(text, F.lit(" \t\n\r\x0b\x0c"))


def strip_fences(text: Column) -> Column:
    """SCA-33: the content of a fenced block, or the text."""
    return F.coalesce(_first(F.regexp_extract(text, r"(?s)^\s*```[a-zA-Z]*\n(.*?)\n?```\s*$", 1)), text)


def score_bar(score: Column) -> Column:
    """SCA-31: ten blocks, filled by truncation."""
    full = (score * 10).cast("int")
    return F.concat(F.rpad(F.lit(""), full, "█"), F.rpad(F.lit(""), 10 - full, "░"))


def traffic_light(score: Column) -> Column:
    """SCA-31 bands; null is unknown."""
    return F.when(score.isNull(), "unknown").when(score >= 0.75, "green").when(score >= 0.5, "yellow").otherwise("red")


#: FLT-13, fixed patterns: law ids, registry codes, articles, percentages, dates, links, the primary source, status tags.
PROTECTED = (
    r"(?U)\b\d{1,4}-[IVXLCDM]{1,7}\b",
    r"(?U)\b[A-Z]\d{6,}[A-Z]?\b",
    r"(?iuU)\bст\.?\s*\d+",
    r"\d+(?:[.,]\d+)?\s*%",
    r"(?U)\b\d{1,2}\.\d{1,2}\.\d{4}\b",
    r"https?://\S+",
    r"adilet\.zan\.kz",
    r"\[[А-ЯЁA-Z][А-ЯЁA-Z \-]{2,}\]",
)


def one_space(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def protected_tokens(text: Column) -> Column:
    """FLT-13: the distinct tokens that a translation has to keep, white space inside as one space."""
    found = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda t: one_space(F.trim(t))) for p in PROTECTED]
    return F.array_distinct(F.flatten(F.array(*found)))


def preserved(source: Column, other: Column) -> Column:
    """FLT-13: other isn't blank and holds every protected token of source, white space as one space."""
    flat = one_space(other)
    return other.rlike(r"\S") & F.forall(protected_tokens(source), lambda t: F.contains(flat, t))


def unit_bucket(unit: Column) -> Column:
    """SCA-27: hours, working days, days, months or days-and-nights; else the unit itself."""
    u = F.lower(F.trim(unit))
    return F.when(u.contains("час"), "часов").when(u.contains("рабоч") & u.contains("дн"), "рабочих дней").when(u.contains("дн"), "дней").when(u.contains("месяц"), "месяцев").when(u.contains("сут"), "суток").otherwise(u)
