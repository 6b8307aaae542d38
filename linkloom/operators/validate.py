"""Checks of list files: (source id, comma list) as two-column TSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_findings(lists: DataFrame, required: DataFrame, key: str, items: str, known: DataFrame | None = None) -> DataFrame:
    """(rule, n, example): a row for each broken rule of a list table against the required ids.

    Rules: duplicate row, duplicate id in a list, an entity matched to itself or another entity (prefix S1-), an id of
    another prefix than S2- or S3-, an id that ``known`` (id) does not hold, missing and extra entities.
    """
    rows = lists.select(F.col(key).alias("k"), F.split(F.coalesce(F.col(items), F.lit("")), ",").alias("l")).withColumn("l", F.filter("l", lambda x: x != ""))
    need = required.select(F.col(required.columns[0]).alias("k")).distinct()
    each = rows.select("k", F.explode("l").alias("x"))
    broken = [
        ("duplicate row", rows.groupBy("k").count().where("count > 1").select("k")),
        ("duplicate id in list", rows.where(F.size("l") > F.size(F.array_distinct("l"))).select("k")),
        ("entity in list", each.where(F.startswith("x", F.lit("S1-"))).select("k")),
        ("bad prefix", each.where(~F.col("x").rlike("^S[123]-")).select("k")),
        ("missing entity", need.join(rows.select("k"), "k", "left_anti")),
        ("extra entity", rows.select("k").distinct().join(need, "k", "left_anti")),
    ]
    if known is not None:
        ids = known.select(F.col(known.columns[0]).alias("x")).distinct()
        broken.append(("unknown id", each.where(F.col("x").rlike("^S[23]-")).join(ids, "x", "left_anti").select("k")))
    out = None
    for rule, df in broken:
        part = df.groupBy().agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("n"), F.min("k").alias("example"))
        out = part if out is None else out.unionAll(part)
    return out.where("n > 0").select("rule", "n", "example")


def subset_warning(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """(s1, rid) matched without being candidates."""
    return matches.join(candidates, ["s1", "rid"], "left_anti")


def file_findings(spark: SparkSession, path: str, required: DataFrame, header: tuple[str, str], known: DataFrame | None = None) -> DataFrame:
    """Findings of a list file: layout first (missing, empty, comma header, wrong header, rows without a tab), then its lists."""
    from linkloom.sources.tables import exists

    say = lambda rule, n, example: spark.range(1).select(F.lit(rule).alias("rule"), F.lit(n).cast("bigint").alias("n"), F.lit(example).alias("example"))
    if not exists(spark, path):
        return say("missing file", 1, path)
    lines = spark.read.text(path)
    first = lines.limit(1).collect()
    if not first:
        return say("empty file", 1, path)
    head = first[0][0]
    if "\t" not in head:
        return say("comma header" if "," in head else "no tab in header", 1, head)
    if tuple(head.split("\t")) != header:
        return say("wrong header", 1, head)
    body = lines.where(F.col("value") != head)
    flat = body.where(~F.col("value").contains("\t"))
    parts = F.split("value", "\t", 2)
    table = body.where(F.col("value").contains("\t")).select(F.get(parts, F.lit(0)).alias("k"), F.get(parts, F.lit(1)).alias("l"))
    layout = flat.groupBy().agg(F.lit("no tab").alias("rule"), F.count(F.lit(1)).alias("n"), F.min("value").alias("example")).where("n > 0")
    return layout.unionAll(list_findings(table, required, "k", "l", known))
