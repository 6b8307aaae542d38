"""Cleaning and appending new raw records as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linkloom.functions.line_a import clean_frame
from linkloom.sources.tables import RAW


def raw_stream(spark: SparkSession, folder: str, schema: str = RAW) -> DataFrame:
    """New TSV files of a folder, same rules as the batch reader."""
    return spark.readStream.schema(schema).option("sep", "\t").option("quote", "").option("header", True).option("nullValue", "\u0000").csv(folder)


def clean_to_parquet(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Clean each record once (exactly-once through the checkpoint), write by country, stop when the input is used up."""
    return clean_frame(stream).writeStream.format("parquet").partitionBy("country").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
