"""Exact nearest neighbours of dense vectors within groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.shipping import ship

#: Rows in a block of targets or queries: a task holds one block of each.
BLOCK = 4096


def knn_by_group(queries: DataFrame, targets: DataFrame, group: str, q_key: str, s_key: str, vector: str, k: int = 10, exclude_self: bool = False, block: int = BLOCK) -> DataFrame:
    """(group, q, s, score, rank): the k targets of the query's group with the greatest dot products, ties by smaller key.

    Both sides are cut into blocks of bounded size by hash; each pair of a query block and a target block of one
    group is one matrix product, and gives k rows a query, which a window merges. So a group of any size is spread
    over as many tasks as it has pairs of blocks, and no task holds more than two blocks.
    """
    ship(queries.sparkSession)
    sizes = targets.groupBy(F.col(group).alias("g")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    q_sizes = queries.groupBy(F.col(group).alias("g")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("q_parts"))
    counts = q_sizes.join(sizes, "g")
    q = queries.select(F.col(group).alias("g"), F.col(q_key).alias("k"), F.col(vector).alias("v")).join(counts, "g")
    q = q.select("g", "k", "v", F.pmod(F.xxhash64("k"), F.col("q_parts")).cast("int").alias("qp"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("sp"))
    s = targets.select(F.col(group).alias("g"), F.col(s_key).alias("k"), F.col(vector).alias("v")).join(counts, "g")
    s = s.select("g", "k", "v", F.pmod(F.xxhash64("k"), F.col("parts")).cast("int").alias("sp"), F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("qp"))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"g": [], "q": [], "s": [], "score": []})
        right = right.sort_values("k", kind="stable")
        a = np.stack(left["v"].to_numpy()).astype(np.float64)
        b = np.stack(right["v"].to_numpy()).astype(np.float64)
        out: list[pd.DataFrame] = []
        keys, ids = left["k"].to_numpy(), right["k"].to_numpy()
        for i in range(0, len(a), 512):
            sims = a[i : i + 512] @ b.T
            if exclude_self:
                sims[keys[i : i + 512, None] == ids[None, :]] = -np.inf
            top = np.argsort(-np.round(sims, 9), axis=1, kind="stable")[:, :k]
            rows = np.repeat(np.arange(len(top)), top.shape[1])
            score = sims[rows, top.ravel()]
            ok = np.isfinite(score)
            out.append(pd.DataFrame({"g": left["g"].iloc[0], "q": keys[i : i + 512][rows][ok], "s": ids[top.ravel()][ok], "score": score[ok]}))
        return pd.concat(out)

    kind = dict(queries.dtypes)
    schema = f"g {kind[group]}, q {kind[q_key]}, s {dict(targets.dtypes)[s_key]}, score double"
    found = q.groupBy("g", "qp", "sp").cogroup(s.groupBy("g", "qp", "sp")).applyInPandas(best, schema)
    order = Window.partitionBy("g", "q").orderBy(F.round("score", 9).desc(), "s")
    return found.withColumn("rank", F.row_number().over(order).cast("bigint")).where(F.col("rank") <= k)


def neighbour_stats(nb: DataFrame) -> DataFrame:
    """(g, q, top1, top2, margin12) of each query; -1 where there is no such neighbour."""
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("score")))
    return nb.groupBy("g", "q").agg(F.coalesce(at(1), F.lit(-1.0)).alias("top1"), F.coalesce(at(2), F.lit(-1.0)).alias("top2")).withColumn("margin12", F.col("top1") - F.col("top2"))


def batches(df: DataFrame, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """``fn`` over pandas batches of each partition."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield fn(part)

    ship(df.sparkSession)
    return df.mapInPandas(run, schema)
