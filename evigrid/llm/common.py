"""Shared plumbing: the shared folder, materialised tables, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space of every word and line contract: \x20 and \x09 to \x0D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
STRIP_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share: spark.checkpoint.dir. Unset is an error except in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "evigrid-shared")
    return root.rstrip("/")


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back.

    The files survive the loss of any executor. They stay until the folder is cleaned with the application.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/evigrid/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hashed_share(column: str, wanted: int, total: int) -> F.Column:
    """Condition that about half as many values again as `wanted` of `total` meet, by a hash of a column; all of few.

    A bounded sample is then cut from these rows alone, so that what tasks send to the driver follows the sample and not the
    number of tasks.
    """
    share = min(1.0, 1.5 * (wanted + 8) / max(1, total))
    return F.pmod(F.xxhash64(F.lit("sample"), F.col(column)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(node, component): component is the smallest node reachable over the edges.

    Alternating large-star and small-star rounds. Every round is two aggregations and two joins on nodes, written
    to the shared folder; a hub's neighbours are spread by the skew join, never gathered in one row. Nodes without an
    edge are not returned; edges with a null end are ignored, loops and repeats have no effect.
    """
    x, y = F.col(a), F.col(b)
    e = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v"))
    e = materialize(e.distinct(), "edges")

    def digest(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen = digest(e)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: smaller neighbours of u, and u, move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = large.join(low, "u")
        small = pairs.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))
        )
        e = materialize(small.where("u > v").distinct(), "edges")
        now = digest(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
