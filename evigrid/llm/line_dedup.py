"""Line de-duplication over levelled sorted runs of line hashes. DataFrame operations only.

A run is a sorted table of (hash, hash2, n, keeper): a line's 128-bit hash, the documents of the run that hold
it and the largest id among them. Batches arrive by falling document id. Each batch anti-joins the settled runs (the
lines already known to be frequent; their keeper is in a run, since later ids are smaller) and adds what is left as a run of level 0; when a
level holds `fanout` runs they are compacted into one run of the next level, and lines that have reached the
frequency move to a settled run. Lines below the frequency stay in the batches' runs, since their counts are needed; so a
batch is joined against the settled runs alone. A run has as many files as its size asks for, not one for each shuffle
partition: its entries are small, so that to shuffle a run again costs less than to write and open many small files.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STRIP_CHARS, materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: F.Column) -> F.Column:
    """The line without ASCII white space at both ends, A to Z in lower case."""
    bare = F.btrim(line, F.lit(STRIP_CHARS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


class LineRuns:
    """The levelled runs of one store, in the shared folder."""

    def __init__(self, min_docs: int, fanout: int = 4):
        self.min_docs, self.fanout = min_docs, fanout
        self.levels: list[list[DataFrame]] = []
        self.settled: list[DataFrame] = []

    def add(self, counted: DataFrame) -> None:
        """Add one batch, (hash, hash2, n, keeper) with each hash once: what no settled run holds becomes a run."""
        for run in self.settled:
            counted = counted.join(run, ["hash", "hash2"], "left_anti")
        self._place(materialize(counted.sortWithinPartitions("hash", "hash2"), "line-run"), 0)

    def _place(self, run: DataFrame, level: int) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == self.fanout:
            self._compact(level)

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        every = functools.reduce(DataFrame.unionByName, runs)
        return every.groupBy("hash", "hash2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"))

    def _compact(self, level: int) -> None:
        runs, self.levels[level] = self.levels[level], []
        merged = self._merged(runs).withColumn("settled", F.col("n") >= self.min_docs)
        # both runs in one pass, in a folder each
        both = materialize(merged.sortWithinPartitions("settled", "hash", "hash2"), "line-run", ["settled"])
        self.settled.append(both.where("settled").drop("settled"))
        if len(self.settled) == self.fanout:  # lines settle once, so settled runs only need to be put together
            self.settled = [materialize(self._merged(self.settled).sortWithinPartitions("hash", "hash2"), "line-run")]
        self._place(both.where("NOT settled").drop("settled"), level + 1)

    def frequent(self) -> DataFrame:
        """(hash, hash2, keeper) of all lines in at least min_docs documents."""
        # a settled line may have entries in older runs too, whose ids are larger
        runs = [run for level in self.levels for run in level] + self.settled
        return self._merged(runs).where(F.col("n") >= self.min_docs).select("hash", "hash2", "keeper")


def dedup_lines(
    docs: DataFrame, min_length: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3,
    id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None,
) -> DataFrame:
    """Drop lines whose key has at least min_length code points and is in at least min_docs documents, but for the largest id.

    Returns the columns in `keep` (default: the id) with n_lines, n_dropped and kept_text. A null or empty text is one
    empty line. Rows that share an id count as one document, and a null id is smaller than any other; each row is
    returned once, equal rows included. Other columns are ignored, also those named like the added ones.
    """
    kept_columns = keep if keep is not None else [id_col]
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(kept_columns)], F.col(id_col).alias("_id"), text.alias("_text"))
    src = src.withColumn("_same", F.xxhash64("_text"))
    lines = src.select("_id", "_same", F.posexplode(F.split("_text", "\n", -1)).alias("_pos", "_line"))
    lines = lines.where(F.length("_line") >= min_length).select("_id", "_same", "_pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= min_length)
    # a line that a document repeats, and rows that repeat a document, come down to one row here
    lines = lines.select("_id", "_same", "_pos", F.xxhash64("_key").alias("hash"), F.xxhash64(F.lit(0x5BD1E995), "_key").alias("hash2"))
    bounds = docs.agg(F.percentile_approx(F.col(id_col).cast("double"), [k / batches for k in range(1, batches)], 1000)).first()[0] if batches > 1 else []
    batch = F.lit(0)
    for bound in bounds or []:  # batch 0 has the largest ids; null ids come last
        batch = batch + F.when(F.coalesce(F.col("_id").cast("double") > F.lit(bound), F.lit(False)), 0).otherwise(1)
    found = lines.groupBy("_id", "_same", "hash", "hash2").agg(F.collect_set("_pos").alias("positions")).withColumn("_batch", batch)
    found = materialize(found, "lines", ["_batch"])
    store = LineRuns(min_docs, fanout)
    for k in range(len(bounds or []) + 1):
        own = found.where(F.col("_batch") == k)
        distinct = own.groupBy("hash", "hash2").agg(F.countDistinct(F.struct("_id")).alias("n"), F.max("_id").alias("keeper"))
        store.add(distinct)
    frequent = materialize(store.frequent(), "frequent")
    gone = found.join(frequent, ["hash", "hash2"]).where(~F.col("_id").eqNullSafe(F.col("keeper")))
    gone = gone.groupBy("_id", "_same").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("_gone"))
    gone = gone.select(F.col("_id").alias("_gid"), F.col("_same").alias("_gsame"), "_gone")
    joined = src.join(gone, F.col("_id").eqNullSafe(F.col("_gid")) & (F.col("_same") == F.col("_gsame")), "left")
    every = F.split("_text", "\n", -1)
    # the lines between dropped ones, taken as slices: linear in the lines
    ends = F.concat(F.col("_gone"), F.array(F.size("_lines")))
    slices = F.flatten(
        F.transform(ends, lambda end, i: F.slice(F.col("_lines"), F.when(i == 0, 1).otherwise(F.element_at("_gone", i) + 2), end - F.when(i == 0, 0).otherwise(F.element_at("_gone", i) + 1)))
    )
    joined = joined.withColumn("_lines", every)
    return joined.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(kept_columns)], F.size("_lines").cast("long").alias("n_lines"),
        F.when(F.col("_gone").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long").alias("n_dropped"),
        F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(slices, "\n")).alias("kept_text"),
    )
