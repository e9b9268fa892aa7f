"""Document sources: binary files to text, HTML articles, text splitters and report listings.

Files are read by Spark's binaryFile source, so that every file is a row, bad ones keep their error, and paths may be in
any store that Spark reads.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as T


def document_format(path: Column) -> Column:
    """SRC-01: pdf, docx or txt by suffix, else null."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(suffix.isin("pdf", "docx", "txt"), suffix)


def docx_text(content: bytes, keep_empty: bool = False) -> str:
    """SRC-04/28: paragraphs, then table rows with cells joined by ' | '."""
    import io
    import xml.etree.ElementTree as ET
    import zipfile

    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    body = ET.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml")).find(f"{w}body")

    def text(node) -> str:
        return "".join(t.text or "" for t in node.iter(f"{w}t"))

    out = [text(p) for p in body.findall(f"{w}p")]
    out = [p for p in out if keep_empty or p.strip()]
    for row in body.iter(f"{w}tr"):
        cells = [text(c).strip() for c in row.findall(f"{w}tc")]
        if any(cells):
            out.append(" | ".join(cells))
    return "\n".join(out)


def txt_text(content: bytes) -> str:
    """SRC-02: UTF-8 with or without mark, UTF-16 by mark, else the Cyrillic code page; bad bytes are replaced."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if content.startswith(mark):
            return content.decode(name, "replace")
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("cp1251", "replace")


#: SRC-03: a text layer of fewer characters is read again by its blocks.
LEAST_LAYER = 100


def ordered_blocks(blocks: list[tuple[float, float, float, float, str]]) -> list[str]:
    """SRC-03/28: texts of blocks (left, top, right, bottom, text) in reading order, tops growing downwards.

    Blocks whose middles lie inside one another's height stand in one row; rows go down the page, blocks of a row from the left.
    """
    rows: list[list[tuple[float, float, float, float, str]]] = []
    for block in sorted((b for b in blocks if b[4].strip()), key=lambda b: (b[1] + b[3], b[0])):
        middle = (block[1] + block[3]) / 2
        if rows and any(r[1] <= middle <= r[3] and block[1] <= (r[1] + r[3]) / 2 <= block[3] for r in rows[-1]):
            rows[-1].append(block)
        else:
            rows.append([block])
    return [b[4].strip() for row in rows for b in sorted(row)]


def page_blocks(page) -> list[tuple[float, float, float, float, str]]:
    """Runs of text of a page with their boxes, as the library reports them while it reads; a run's width isn't known to it."""
    found: list[tuple[float, float, float, float, str]] = []

    def visit(text, cm, tm, font, size):
        if text.strip():
            found.append((tm[4], -tm[5] - (size or 1), tm[4], -tm[5], text))

    page.extract_text(visitor_text=visit)
    return found


def pdf_text(content: bytes) -> str:
    """SRC-03: the text layer, by an optional library; if it has fewer than 100 characters, its blocks in reading order, if those
    say more. Scanned pages need OCR, which isn't available offline."""
    import io

    from pypdf import PdfReader  # optional

    pages = PdfReader(io.BytesIO(content)).pages
    layer = "\n".join(page.extract_text() or "" for page in pages)
    if len(layer.strip()) >= LEAST_LAYER:
        return layer
    by_block = "\n".join(t for page in pages for t in ordered_blocks(page_blocks(page)))
    return by_block if len(by_block) > len(layer.strip()) else layer


def parse_files(rows: DataFrame) -> DataFrame:
    """SRC-01..04: (path, format, raw_text, error) of files (path, content)."""
    rows = rows.select("path", document_format(F.col("path")).alias("format"), "content")

    def parse(batches):
        readers = {"docx": docx_text, "txt": txt_text, "pdf": pdf_text}
        for pdf in batches:
            texts, errors = [], []
            for kind, content in zip(pdf["format"], pdf["content"], strict=True):
                try:
                    texts.append(readers[kind](content) if kind else None)
                    errors.append(None if kind else "unsupported format")
                except Exception as error:  # one bad file must not end the job
                    texts.append(None)
                    errors.append(f"{type(error).__name__}: {error}")
            yield pd.DataFrame({"path": pdf["path"], "format": pdf["format"], "raw_text": texts, "error": errors})

    parsed = rows.mapInPandas(parse, "path string, format string, raw_text string, error string")
    text = F.when(F.col("format") == "pdf", T.repair_breaks(T.repair_spacing(F.col("raw_text")))).otherwise(F.col("raw_text"))
    return parsed.withColumn("raw_text", text)


def read_documents(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC-01..04, SRC-22: (path, format, raw_text, error, doc_id, char_count, word_count) of all files under a path, or of given files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    parsed = parse_files(files)
    return parsed.withColumns({"doc_id": T.content_id(F.col("raw_text")), "char_count": F.length("raw_text"), "word_count": T.word_count(F.col("raw_text")), "language": T.language(F.col("raw_text"))})


def html_paragraphs(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, title, pos, bold, text): paragraphs in order, scripts and styles aside; an unclosed paragraph ends at the next."""
    html = F.regexp_replace(F.col(html_col), r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    title = F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", " "), r"\s+", " ")), F.lit(""))
    blocks = F.regexp_extract_all(html, F.lit(r"(?is)<p(?:\s[^>]*)?>(.*?)(?=</p>|<p[\s>]|</body|</div|$)"), F.lit(1))
    rows = pages.select(F.col(id_col).alias("page_id"), title.alias("title"), F.posexplode(blocks).alias("pos", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"<[^>]+>", " "), r"\s+", " "))
    return rows.select("page_id", "title", "pos", F.col("raw").rlike(r"(?i)<b[\s>]").alias("bold"), text.alias("text"))


HEADING = r"(?iu)^(?:Статья\s+(\d+(?:[-.]\d+)?)\.?|(\d+(?:[-.]\d+)?)-бап\.?)\s*(.*)$"


def html_articles(paragraphs: DataFrame, heading: str = HEADING) -> DataFrame:
    """SRC-08: bold headings start an article, the paragraphs after it are its body; what comes before the first goes."""
    number = F.coalesce(F.nullif(F.regexp_extract("text", heading, 1), F.lit("")), F.nullif(F.regexp_extract("text", heading, 2), F.lit("")))
    rows = paragraphs.withColumn("number", F.when(F.col("bold"), number))
    nth = F.count("number").over(Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("nth", nth).where("nth > 0")
    body = F.filter(F.array_sort(F.collect_list(F.when(F.col("number").isNull(), F.struct("pos", "text")))), lambda x: x["text"] != "")
    return rows.groupBy("page_id", "nth").agg(F.max("title").alias("title"), F.max("number").alias("article"), F.max(F.when(F.col("number").isNotNull(), F.regexp_extract("text", heading, 3))).alias("heading"), F.array_join(F.transform(body, lambda x: x["text"]), "\n").alias("body"))


def article_chunks(articles: DataFrame, pages: DataFrame, wanted: DataFrame | None = None, cap: int = 50, least: int = 30) -> DataFrame:
    """SRC-09: chunks of a page's articles; the asked ones, or the first `cap`."""
    content = F.concat(F.lit("Статья "), F.col("article"), F.lit(". "), F.col("heading"), F.lit("\n"), F.col("body"))
    language = F.when(F.col("url").contains("/kaz/"), "kk").otherwise("ru")
    rows = articles.join(pages.select("page_id", "url"), "page_id").withColumns({"content": content, "language": language, "law_id": F.nullif(F.regexp_extract("url", r"/docs/([A-Z]\d+)", 1), F.lit(""))}).where(F.length("content") >= least)
    if wanted is not None:
        return rows.join(wanted, ["page_id", "article"], "left_semi")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("page_id").orderBy("nth"))).where(F.col("_n") <= cap).drop("_n")


def split_articles(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", longest: int = 3000) -> DataFrame:
    """SRC-10: plain text split before each heading; content is the rest of the heading's line and the body."""
    parts = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, r"(?iu)(?=(?:^|\n)\s*Статья\s+\d+)")).alias("pos", "part"))
    number = F.nullif(F.regexp_extract("part", r"(?iu)^\s*Статья\s+(\d+(?:[-.]\d+)?)", 1), F.lit(""))
    content = F.substring(F.trim(F.regexp_replace("part", r"(?iu)^\s*Статья\s+\d+(?:[-.]\d+)?\.?", "")), 1, longest)
    return parts.select("doc_id", "pos", number.alias("article"), content.alias("content")).where("article is not null")


def sliding_chunks(docs: DataFrame, size: int = 4000, overlap: int = 200, early_stop: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """SCA-25 fallback and SCA-26: windows of `size` characters, `size - overlap` apart.

    With early_stop the window that reaches the end is the last; without it, starts go on to the end of the text.
    """
    step, n = size - overlap, F.length(text_col)
    last = F.when(n <= size, 0).otherwise(F.ceil((n - size) / step)) if early_stop else F.when(n <= size, 0).otherwise(F.floor((n - 1) / step))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_t"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("k"))
    return rows.select("doc_id", "k", F.expr(f"substring(_t, k * {step} + 1, {size})").alias("content"))


def adaptive_chunks(docs: DataFrame, limit: int = 4000, carry: int = 200, id_col: str = "doc_id", text_col: str = "text", article_col: str | None = None) -> DataFrame:
    """SCA-25: texts over the limit are split before numbered clauses, which fill chunks greedily; each next chunk starts with
    the last `carry` characters of the one before. A text without clauses gets sliding windows."""
    parts = F.split(text_col, r"\n(?=\d+[.)])")
    bare = lambda x: F.btrim(x, F.lit(" \t\n\r\x0b\x0c"))
    # the fold carries the finished chunks and the open one; a chunk may exceed the limit by what it carries over
    fold = F.aggregate(
        parts, F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open")),
        lambda acc, p: F.when((acc["open"] == "") | (F.length(acc["open"]) + F.length(p) <= limit), F.struct(acc["done"].alias("done"), bare(F.concat(acc["open"], F.lit("\n"), p)).alias("open")))
        .otherwise(F.struct(F.array_append(acc["done"], acc["open"]).alias("done"), F.concat(F.right(acc["open"], F.lit(carry)), F.lit("\n"), p).alias("open"))),
        lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])),
    )
    step = limit - carry
    windows = F.transform(F.sequence(F.lit(0), F.floor((F.length(text_col) - 1) / step).cast("int")), lambda k: F.substring(F.col(text_col), k * step + 1, F.lit(limit)))
    pieces = F.when(F.length(text_col) <= limit, F.array(text_col)).when(F.size(parts) > 1, fold).otherwise(windows)
    name = F.col(article_col) if article_col else F.col(id_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), name.alias("_name"), F.posexplode(pieces).alias("k", "content"))
    one = F.count("*").over(Window.partitionBy("doc_id", "_name")) == 1
    return rows.select("doc_id", "k", F.when(one, F.col("_name")).otherwise(F.concat("_name", F.lit("_p"), F.col("k") + 1)).alias("chunk_name"), "content")


def version_date(name: Column) -> Column:
    """FN-02: DD-MM-YYYY in a file name."""
    return F.try_to_date(F.nullif(F.regexp_extract(name, r"(\d{2}-\d{2}-\d{4})", 1), F.lit("")), "dd-MM-yyyy")


def stamp_of(name: Column) -> Column:
    """FN-02: YYYYMMDD_HHMMSS in a file name."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{8}_\d{6})", 1), F.lit("")), F.lit("yyyyMMdd_HHmmss"))


def web_chunks(results: DataFrame) -> DataFrame:
    """SRC-14/15: search results (url, title, content, priority) to chunks; the first provider with rows wins a query elsewhere."""
    rows = results.where((F.coalesce("url", F.lit("")) != "") & (F.length("content") >= 50)).withColumn("web_tier", T.web_tier(F.col("url"))).where("web_tier <> 'BLACKLIST'")
    return rows.withColumns({"id": T.content_id(F.col("content")), "legal_rank": F.lit(4)})


def first_non_empty(candidates: DataFrame, query: str, priority: str) -> DataFrame:
    """SRC-11/14: of each query the rows of the first source that has any."""
    best = F.min(priority).over(Window.partitionBy(query))
    return candidates.withColumn("_best", best).where(F.col(priority) == F.col("_best")).drop("_best")


def list_reports(spark: SparkSession, path: str) -> DataFrame:
    """SRC-20: Markdown reports with the score of their sidecar, else of their text, newest first."""
    texts = spark.read.text(f"{path}/*.md", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.md$", 1).alias("report_id"), F.col("value").alias("text"))
    side = spark.read.text(f"{path}/*.json", wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1).alias("report_id"), F.from_json("value", "reliability double, total long").alias("meta"))
    found = F.regexp_extract("text", r"(\d{1,3})\s*%", 1).try_cast("double") / 100
    rows = texts.join(side, "report_id", "left").select("report_id", F.coalesce("meta.reliability", found).alias("score"), stamp_of(F.col("report_id")).alias("created_at"))
    return rows.orderBy(F.col("created_at").desc_nulls_last(), "report_id")


def repair_json(text: str | None) -> str | None:
    """FN-11: truncated model output: fences off, cut to the last complete item, brackets balanced; null if nothing is left."""
    import json

    if not text:
        return None
    s = text.strip()
    if s.startswith("```"):
        s = s.split("\n", 1)[-1].rsplit("```", 1)[0]
    at = min((i for i in (s.find("{"), s.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    s = s[at:]
    for end in range(len(s), 0, -1):
        if s[end - 1] not in "}]" and end != len(s):
            continue
        stack, quoted, escaped = [], False, False
        for c in s[:end]:
            if quoted:
                quoted, escaped = c != '"' or escaped, c == "\\" and not escaped
            elif c == '"':
                quoted = True
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            elif c in "}]" and stack:
                stack.pop()
        whole = s[:end].rstrip().rstrip(",") + "".join(reversed(stack))
        try:
            return json.dumps(json.loads(whole), ensure_ascii=False)
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repaired_json(text: pd.Series) -> pd.Series:
    return text.map(repair_json)
