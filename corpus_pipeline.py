"""Corpus pipeline: quality classifier, exact dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
in the shared folder and reads it again as the next stage's documents. All stages but the last return
the columns of ``documents``. Rows are known by id and text, null ids included: rows that repeat an id with
different texts are judged each by its own text, and rows that repeat both are copies of each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import Cuts, ascii_lower, table, text_key
from linkloom.llm.exact_dedup import content_sort
from linkloom.llm.near_dedup import near_dedup
from linkloom.llm.packing import pack_word_bpe
from linkloom.llm.passages import cut_passages
from linkloom.llm.quality import accepted

#: Words that packing remembers here: executors also hold what earlier stages left in their Python workers.
PACK_MEMO = 450_000


def _row(id_col: str, key: Column) -> Column:
    """One text for an id (or none) and a key, so that a join and a window deal rows alike and share a shuffle."""
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("bigint").cast("string"), F.lit("none")), key)


def _one_of_each(docs: DataFrame, kept: DataFrame, key: Column) -> DataFrame:
    """The rows of ``docs`` whose id and ``key`` (of the text) are rows (id, key) of ``kept``, one for each."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), _row("doc_id", key).alias("_key"))
    ids = kept.toDF("_kept_id", "_kept_key").select(_row("_kept_id", F.col("_kept_key")).alias("_key")).distinct()
    met = held.join(ids, "_key", "left_semi")
    alike = Window.partitionBy("_key").orderBy(F.col("_row").getField("text"))
    return met.withColumn("_n", F.row_number().over(alike)).where("_n = 1").select("_row.*")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return accepted(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z lower-cased): the smallest id."""
    kept = content_sort(docs).where("kept").select("doc_id", "text_sha256")
    return _one_of_each(docs, kept, F.sha2(ascii_lower(F.col("text")), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the smallest id."""
    kept = near_dedup(docs).where("first").select("doc_id", "row_key")
    return _one_of_each(docs, kept, text_key(F.col("text")))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier document holds as well; n_chars follows the text."""
    cut = cut_passages(docs)
    return cut.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed documents (see ``packing.pack_documents``)."""
    return pack_word_bpe(docs, memo=PACK_MEMO).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


STAGES = [
    ("quality classifier", keep_good),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("packing", pack),
]

#: The stages hold trained models and tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = Cuts(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = cuts.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            cuts.drop(f"stage-{k - 1}")
    return docs
