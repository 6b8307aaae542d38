"""Readers and writers: raw TSV sources, Parquet stages, list files, JSON side outputs."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "entity_id string, business_name string, business_address string, country string"


def _path(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def read_raw(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """Tab-separated text without quoting; every cell is text, an empty one is ''; "NULL" and "NA" are text."""
    reader = spark.read.schema(schema).option("sep", "\t").option("quote", "").option("header", True).option("nullValue", "\u0000").option("emptyValue", "")
    return reader.csv(path).na.fill("")


def read_table(spark: SparkSession, folder: str, split: str, stem: str, schema: str = RAW) -> DataFrame:
    """A Parquet copy (flat or by split) where there is one, else the TSV."""
    for path in (f"{folder}/{split}_{stem}.parquet", f"{folder}/{split}/{split}_{stem}.parquet"):
        if exists(spark, path):
            return spark.read.parquet(path).na.fill("")
    return read_raw(spark, f"{folder}/{split}_{stem}.tsv", schema)


def load_records(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """The three sources as one table: src, entity_id, num (the id's number), country, name, addr."""
    out = None
    for src in (1, 2, 3):
        part = read_table(spark, folder, split, f"source{src}").select(
            F.lit(src).alias("src"), "entity_id", F.substring("entity_id", 4, 20).cast("bigint").alias("num"), "country", F.col("business_name").alias("name"), F.col("business_address").alias("addr")
        )
        out = part if out is None else out.unionByName(part)
    return out


def explode_lists(gt: DataFrame, key: str = "source1_entity_id", lists: str = "matched_entity_ids") -> DataFrame:
    """(s1, rid) of a table of comma lists; empty lists give no rows."""
    return gt.select(F.col(key).alias("s1"), F.explode(F.split(F.coalesce(F.col(lists), F.lit("")), ",")).alias("rid")).where("rid <> ''")


def list_table(entities: DataFrame, pairs: DataFrame, key: str = "s1", item: str = "rid", name: str = "matched_entity_ids") -> DataFrame:
    """One row per entity with its distinct items, sorted, joined by commas; '' where it has none."""
    lists = pairs.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), ",").alias(name))
    return entities.select(key).distinct().join(lists, key, "left").select(key, F.coalesce(name, F.lit("")).alias(name))


def write_list_file(df: DataFrame, path: str) -> None:
    """A headed TSV without quoting; partitions stay as they are, so the folder holds one file for each."""
    df.write.mode("errorifexists").option("sep", "\t").option("quote", "").option("header", True).option("emptyValue", "").csv(path)


def stage(spark: SparkSession, path: str, make: Callable[[], DataFrame], partition_by: tuple[str, ...] = ()) -> DataFrame:
    """The stage's Parquet, made first where it is not complete yet."""
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return spark.read.parquet(path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    p, fs = _path(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(json.dumps(value, indent=2, sort_keys=True).encode()))
    out.close()


def safe_tag(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", "_", text.lower()).strip("_") or "none"


def profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, share of nulls and empties, distinct values (approximate), mean length. One pass."""
    cols = df.columns
    text = lambda c: F.col(c).cast("string")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        aggs += [
            F.struct(
                F.lit(c).alias("column"),
                F.avg(F.col(c).isNull().cast("double")).alias("null_share"),
                F.avg((F.coalesce(text(c), F.lit("")) == "").cast("double")).alias("empty_share"),
                F.avg(F.length(text(c))).alias("mean_length"),
            ).alias(f"c{i}")
        ]
    row = df.agg(*aggs)
    return row.select("n", F.inline(F.array(*[f"c{i}" for i in range(len(cols))])))
