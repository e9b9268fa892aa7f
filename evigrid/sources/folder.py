"""A folder of legal texts as a corpus: incremental ingest with a manifest, and the scan of the first bills.

State of an ingest is a folder with three parts: the stream's own checkpoint, a log of chunks and a log of manifests (path,
modified, length, content_hash). A batch writes its chunks and then its manifest, both under a name of its own, with
overwrite: a batch that is repeated after a failure leaves nothing twice, and chunks count only once their manifest is there.
What is current is the last manifest row of each path and the chunks of that content.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import claims as claim_rules
from ..operators import laws
from ..operators.fusion import keep_first
from ..storage import written
from . import ingest

MANIFEST = "path string, modified timestamp, length long, content_hash string, error string, run string, seq long"
FILES = "path string, modificationTime timestamp, length long, content binary"
#: SRC-16: shortest paragraph that stands for an article, codes by id, marks of languages in file names.
LEAST_PARAGRAPH = 10
CODES = ("235-V", "226-V", "350-VI", "212-IV", "1000-XIII", "409-I", "442-II", "414-I")


def file_language(name: Column) -> Column:
    """SRC-16: kk by the file name, else ru."""
    return F.when(name.contains("kaz") | name.contains("kk"), "kk").otherwise("ru")


def corpus_chunks(docs: DataFrame, codes: dict[str, str]) -> DataFrame:
    """SRC-16: chunks of documents (path, raw_text): articles, or paragraphs of ten characters where a text has none, cut to size.

    (path, chunk_id, law_id, article, content, language, effective_date, legal_rank, source_url, source_title); texts without
    a visible character have none.
    """
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    rows = docs.where(F.coalesce("raw_text", F.lit("")).rlike(r"\S")).select("path", F.col("raw_text").alias("text"))
    rows = written(rows.withColumns({"law_id": laws.file_law_id(F.col("path"), F.col("text"), codes), "language": file_language(name), "effective_date": ingest.version_date(name)}), "texts")
    articles = ingest.split_articles(rows, "path").select(F.col("doc_id").alias("path"), "article", "content")
    bare = rows.join(articles.select("path").distinct(), "path", "left_anti").select("path", F.posexplode(F.split("text", "\n\n")).alias("pos", "content"))
    content = F.btrim("content", F.lit(" \t\n\r\x0b\x0c"))
    paragraphs = bare.select("path", F.concat(F.lit("p"), F.col("pos") + 1).alias("article"), content.alias("content")).where(F.length("content") >= LEAST_PARAGRAPH)
    pieces = ingest.adaptive_chunks(articles.unionByName(paragraphs), id_col="path", text_col="content", article_col="article")
    out = pieces.select(F.col("doc_id").alias("path"), F.col("chunk_name").alias("article"), "content").join(rows.drop("text"), "path")
    code = F.col("law_id").startswith("K") | F.lower("path").contains("кодекс") | F.col("law_id").isin(*CODES)
    return out.select(
        "path", T.content_id(F.col("content")).alias("chunk_id"), "law_id", "article", "content", "language", "effective_date", F.when(code, 2).otherwise(4).alias("legal_rank"),
        F.concat(F.lit(f"{laws.BASE}/rus/docs/"), "law_id", F.lit("#"), "article").alias("source_url"), F.concat(F.lit("НПА "), "law_id", F.lit(" | Ст. "), "article").alias("source_title"),
    )


class FolderIngest:
    """SRC-16: files of a folder's subfolders, pdf and docx, as chunks; a run reads what is new or has changed."""

    def __init__(self, spark: SparkSession, folder: str, state: str, codes: dict[str, str], files_per_batch: int = 1000):
        self.spark, self.folder, self.state, self.codes, self.files_per_batch = spark, folder.rstrip("/"), state.rstrip("/"), codes, files_per_batch

    def _log(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.state}/{name}/batch=*")
        except AnalysisException:  # nothing written yet
            return self.spark.createDataFrame([], schema)

    def manifest(self) -> DataFrame:
        """The last row of each path."""
        return keep_first(self._log("manifest", MANIFEST), ["path"], [F.desc("seq")])

    def chunks(self) -> DataFrame:
        """Chunks of the current content of every path."""
        schema = "path string, chunk_id string, law_id string, article string, content string, language string, effective_date date, legal_rank int, source_url string, source_title string, content_hash string"
        return self._log("chunks", schema).join(self.manifest().select("path", "content_hash"), ["path", "content_hash"], "left_semi").drop("content_hash").distinct()

    def _eligible(self, files: DataFrame) -> DataFrame:
        """Files of subfolders alone, pdf and docx."""
        inner = F.regexp_extract("path", r"^[a-z]+:/*(.*)$", 1)
        root = self.folder.split(":", 1)[-1].strip("/")
        return files.where(F.substring(F.ltrim(inner, F.lit("/")), len(root) + 2, 1 << 30).contains("/") & ingest.document_format(F.col("path")).isin("pdf", "docx"))

    def _take(self, files: DataFrame, batch: str, seq: int) -> None:
        """One batch: contents that the manifest lacks become chunks, then manifest rows."""
        seen = self.manifest().select("path", "content_hash")
        every = self._eligible(files).withColumn("content_hash", F.sha2("content", 256))
        new = written(every.join(seen, ["path", "content_hash"], "left_anti").select("path", "content", "content_hash"), "files")
        parsed = written(ingest.parse_files(new), "parsed")
        made = corpus_chunks(parsed, self.codes).join(new.select("path", "content_hash"), "path")
        made.write.mode("overwrite").parquet(f"{self.state}/chunks/batch={batch}")
        # a file with a new time and its old content gets a manifest row too, or it would be read again and again
        rows = every.join(parsed.select("path", "error"), "path", "left").select("path", F.col("modificationTime").alias("modified"), "length", "content_hash", "error", F.lit(batch).alias("run"), F.lit(seq).cast("long").alias("seq"))
        rows.write.mode("overwrite").parquet(f"{self.state}/manifest/batch={batch}")

    def run(self) -> None:
        """Take all files there are: new paths as an available-now stream, then known paths whose time or length has changed.

        The stream remembers paths; a listing without contents finds the changed ones, and the time of the oldest among them is
        pushed to the scan that reads them again.
        """
        first = self._log("manifest", MANIFEST).agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0] + 1
        stream = self.spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", self.files_per_batch).option("maxFileAge", "100000d").load(self.folder)
        query = stream.writeStream.foreachBatch(lambda df, k: self._take(df, f"stream-{k}", first)).option("checkpointLocation", f"{self.state}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(self.folder)
        known = self.manifest().select("path", "modified", F.col("length").alias("known"))
        changed = files.select("path", "modificationTime", "length").join(known, "path").where((F.col("modificationTime") != F.col("modified")) | (F.col("length") != F.col("known")))
        oldest = changed.agg(F.min("modificationTime")).first()[0]
        if oldest is not None:
            self._take(files.where(F.col("modificationTime") >= F.lit(oldest)).join(changed.select("path"), "path", "left_semi"), f"changed-{uuid.uuid4().hex}", first + 1)


def replace_law(spark: SparkSession, path: str, law_id: str, fresh: DataFrame, least_articles: int = 15, apply: bool = True) -> dict:
    """SRC-17: put a law's fresh chunks (article, ...) in place of its own in a table partitioned by law_id, or leave it alone.

    The rows are staged and counted first; a law without rows or with fewer than `least_articles` distinct articles is
    refused, and a dry run stops there too: nothing of the table is touched. The write replaces that law's partition
    alone; if it fails, the old rows are written back. Returns law_id, chunks, articles, applied and reason.
    """
    staged = written(fresh.withColumn("law_id", F.lit(law_id)), "staged")
    n, articles = staged.agg(F.count("*"), F.count_distinct("article")).first()
    reason = "no chunks" if not n else "dry run" if not apply else f"{articles} articles of {least_articles}" if articles < least_articles else None
    report = {"law_id": law_id, "chunks": n, "articles": articles, "applied": reason is None, "reason": reason}
    if reason:
        return report
    try:
        backup = written(spark.read.parquet(path).where(F.col("law_id") == law_id).select(*staged.columns), "backup")
    except AnalysisException:  # the first law of the table
        backup = None

    def put(rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("law_id").parquet(path)

    try:
        put(staged)
    except Exception:
        if backup is not None:
            put(backup)
        raise
    return report


def claims_with_article(claims: DataFrame) -> DataFrame:
    """FLT-11: claims with a target law and an article, which they get as `article`."""
    text = F.lower(F.concat(F.coalesce("claim_text", F.lit("")), F.lit(" "), F.coalesce("quote", F.lit(""))))
    return claims.withColumn("article", T.article_of(text)).where((F.size("target_law_ids") > 0) & F.col("article").isNotNull())


def first_bills(spark: SparkSession, folder: str, registry: DataFrame, max_scan: int) -> DataFrame:
    """SRC-23: (path, target_law_ids, n_claims) of the bills among the first `max_scan` docx files by path that amend a known law and have
    a claim on one of its articles.

    The listing reads no contents, and only the files chosen are read; their number is the parameter, whatever the folder holds.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.docx").load(folder).select("path")
    paths = [r["path"] for r in listed.orderBy("path").limit(max_scan).collect()]
    if not paths:
        return spark.createDataFrame([], "path string, target_law_ids array<string>, n_claims long")
    docs = written(ingest.read_documents(spark, paths).where("error is null").select("path", "raw_text"), "bills")
    found = laws.target_laws(docs, registry, "path", "raw_text").groupBy(F.col("doc_id").alias("path")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "law_id"))), lambda x: x["law_id"]).alias("target_law_ids"))
    made = claim_rules.extract_claims(docs.select(F.col("path").alias("doc_id"), F.col("raw_text").alias("text"))).withColumnRenamed("doc_id", "path")
    usable = claims_with_article(made.select("path", "claim_text", "quote").join(found, "path"))
    return usable.groupBy("path", "target_law_ids").agg(F.count("*").alias("n_claims"))


REPORT = "law string, canonical string, false_confirm_rate string, true_confirm_rate string, error string, _corrupt string"


def verdict_reports(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-25: (law_id, rate, true_rate, error, file) of verdict_*.json and baseline_*.json, one row a law, the last file by name.

    The law is the report's own, else the file's name without its prefix. A file that isn't one JSON object, or says
    error, has a null rate and an error, which the gate fails on; other files are left alone.
    """
    texts = spark.read.option("pathGlobFilter", "{verdict_,baseline_}*.json").text(folder, wholetext=True).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    rows = texts.withColumn("r", F.from_json(F.trim("value"), REPORT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    broken = F.col("r._corrupt").isNotNull() | ~F.ltrim("value").startswith("{") | F.col("r").isNull()
    stem = F.regexp_extract("file", r"^(?:verdict_|baseline_)(.*)\.json$", 1)
    own = F.coalesce(F.nullif("r.law", F.lit("")), F.nullif("r.canonical", F.lit("")), stem)
    error = F.when(broken, F.lit("load failed")).otherwise(F.col("r.error"))
    rows = rows.select(F.when(broken, stem).otherwise(own).alias("law_id"), F.when(error.isNull(), F.col("r.false_confirm_rate").try_cast("double")).alias("rate"), F.when(error.isNull(), F.col("r.true_confirm_rate").try_cast("double")).alias("true_rate"), error.alias("error"), "file")
    return keep_first(rows, ["law_id"], [F.desc("file")])
