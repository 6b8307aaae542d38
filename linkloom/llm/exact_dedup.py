"""Exact dedup by content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised content, an external sort inside each range places
equals adjacent, and neighbours are compared in full. The sort key ends with the document id, so a
group of copies of any size is spread over as many ranges as its share of the rows asks for; the
runs of one group that lie in several ranges meet again as one small row for each range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import Cuts, ascii_lower, table

#: Bounds of what reaches the driver: ranges, and sampled keys for each range (about 170 bytes a key).
MAX_RANGES = 65_536
OVERSAMPLE = 16


def _splitters(keys: DataFrame, rows: int, ranges: int) -> list[str]:
    rate = max(1, rows // (OVERSAMPLE * ranges))
    picked = keys.where(F.pmod(F.xxhash64("_id", F.lit("splitter")), F.lit(rate)) == 0).select("_k")
    found = sorted(r[0] for r in picked.collect())
    step = max(1, len(found) // ranges)
    return sorted(set(found[step::step]))[: ranges - 1]


def content_sort(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", ranges: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z. ``keep`` names the row of a group that
    stays: "smallest" or "largest" id. Null text counts as empty; empty texts are one group. Rows that
    repeat an id each count in ``group_size``, and all rows with the kept id are kept. An empty table gives an empty result.
    Other columns of ``docs`` are not read, whatever their names.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "content-sort")
    ranges = min(MAX_RANGES, ranges or max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    base = docs.select(F.col(id_col).cast("bigint").alias("_id"), ascii_lower(F.col(text_col)).alias("_n"))
    sha = F.sha2(F.col("_n"), 256)
    # Byte order of a bounded prefix, then of the digest, then of the id: equal texts are neighbours in it.
    key = F.concat_ws("!", F.hex(F.encode(F.substring("_n", 1, 24), "UTF-8")), sha, F.lpad(F.hex(F.coalesce("_id", F.lit(0))), 16, "0"))
    keyed = base.withColumn("_sha", sha).withColumn("_k", key)
    split_at = _splitters(keyed.select("_id", "_k"), docs.count(), ranges)
    if split_at:
        bounds = F.split(F.lit(",".join(split_at)), ",")  # folded to one literal
        steps = F.array(*[F.lit(1 << i) for i in reversed(range(len(split_at).bit_length()))])
        # Binary search for the number of splitters that are not above the key.
        part = F.aggregate(steps, F.lit(0), lambda lo, s: F.when(F.coalesce(F.get(bounds, lo + s - 1) <= F.col("_k"), F.lit(False)), lo + s).otherwise(lo))
    else:
        part = F.lit(0)
    order = Window.partitionBy("_part").orderBy("_k")
    new_run = F.when(F.lag("_n").over(order) == F.col("_n"), 0).otherwise(1)
    rows = (
        keyed.withColumn("_part", part)
        .select("_id", "_sha", "_part", "_k", new_run.alias("_new"))
        .select("_id", "_sha", "_part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("_run"))
    )
    rows = cuts.write(rows, "rows")
    best = {"smallest": F.min, "largest": F.max}[keep]
    runs = rows.groupBy("_part", "_run", "_sha").agg(best("_id").alias("_best"), F.count(F.lit(1)).alias("_n"))
    groups = runs.groupBy("_sha").agg(best("_best").alias("keep_id"), F.sum("_n").alias("group_size"))
    # Rows meet their group by run, not by digest: a run is no longer than its range, however large the group.
    found = runs.join(groups, "_sha").select("_part", "_run", "keep_id", "group_size")
    return rows.join(found, ["_part", "_run"]).select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256")
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort(table(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""
