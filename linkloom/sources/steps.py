"""Steps of a long plan as written tables: a lost executor costs a step at most, and later plans stay short."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_OWN: list[str] = []  # the local master's temporary folder, made once


def base_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder on a local master and an error on any other."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="linkloom-"))
    return f"file://{_OWN[0]}"


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once into Parquet under the shared folder and read from there; whoever owns that folder deletes it."""
    spark = df.sparkSession
    path = f"{base_folder(spark)}/linkloom-step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
