"""Tables in the shared folder, which cut lineage and survive the loss of executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which the driver and all executors share. Unset is an error except in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = os.path.join(tempfile.gettempdir(), "evigrid-shared")
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet under a new name and read back."""
    path = f"{shared_folder(df.sparkSession)}/evigrid/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
