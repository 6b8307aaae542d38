"""Candidate policies over neighbour lists in long form (view, q, s, rank, score)."""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the sweep: ranks, margins and floors of the three views, caps, tolerances.
GRID = {"k": (3, 5, 10), "margin": (0.05, 0.1, 0.2), "floor": (-1.0, 0.5, 0.7, 0.8), "cap": (15, 20, 30, 50, 100)}


def view_policy(nb: DataFrame, rules: Mapping[str, tuple[int, float, float]]) -> DataFrame:
    """Neighbours that their view's (k, margin, floor) keeps: rank within k, score within the margin of the best, at the floor or above."""
    best = F.max("score").over(Window.partitionBy("view", "q"))
    scored = nb.withColumn("best", best)
    keep = F.lit(False)
    for view, (k, margin, floor) in rules.items():
        keep = keep | ((F.col("view") == view) & (F.col("rank") <= k) & (F.col("score") >= F.col("best") - margin) & (F.col("score") >= floor))
    return scored.where(keep).drop("best")


def hub_cap(nb: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` queries for each entity and view, the best scores first."""
    order = Window.partitionBy("view", "s").orderBy(F.round("score", 9).desc(), "q")
    return nb.withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= cap).drop("_at")


def pair_union(nb: DataFrame) -> DataFrame:
    return nb.select("q", "s").distinct()


def policy_quality(entities: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: pair recall, F0.5 ceiling, candidates per entity (mean, 99th percentile, most), number of pairs.

    entities: (s); truth and pairs: (q, s), distinct. The ceiling of an entity is its score if all its candidates that are
    true were chosen and nothing else; entities without true pairs count 1.
    """
    hit = pairs.join(truth, ["q", "s"], "left_semi").groupBy("s").agg(F.count(F.lit(1)).alias("n_hit"))
    n_true = truth.groupBy("s").agg(F.count(F.lit(1)).alias("n_true"))
    n_cand = pairs.groupBy("s").agg(F.count(F.lit(1)).alias("n_cand"))
    per = entities.select("s").distinct().join(n_true, "s", "left").join(hit, "s", "left").join(n_cand, "s", "left").na.fill(0)
    r = F.col("n_hit") / F.col("n_true")
    ceiling = F.when(F.col("n_true") == 0, 1.0).when(F.col("n_hit") == 0, 0.0).otherwise(1.25 * r / (0.25 + r))
    return per.agg(
        (F.sum("n_hit") / F.sum("n_true")).alias("pair_recall"),
        F.avg(ceiling).alias("ceiling"),
        F.avg("n_cand").alias("cand_mean"),
        F.percentile("n_cand", 0.99).alias("cand_p99"),
        F.max("n_cand").alias("cand_max"),
        F.sum("n_cand").alias("n_pairs"),
    )


def smallest_within(results: DataFrame, tolerance: float, score: str = "ceiling", size: str = "n_pairs") -> DataFrame:
    """The smallest candidate set whose score is within the tolerance of the best; ``results`` has a row per policy."""
    best = results.agg(F.max(score).alias("_best"))
    return results.join(F.broadcast(best), F.col(score) >= F.col("_best") - tolerance).drop("_best").orderBy(size, F.col(score).desc()).limit(1)


def _graded(chosen: DataFrame, entities: DataFrame, truth: DataFrame, rules: Column, keys: list[str]) -> DataFrame:
    """``policy_quality`` of each rule, for chosen pairs (keys, q, s); ``rules``: the array of all rules' keys."""
    met = chosen.join(truth.select("q", "s", F.lit(1).alias("hit")), ["q", "s"], "left")
    n_cand = met.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("n_cand"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit"))
    n_true = truth.groupBy("s").agg(F.count(F.lit(1)).alias("n_true"))
    per = entities.select("s").distinct().join(n_true, "s", "left").select("s", "n_true", F.inline(rules)).join(n_cand, [*keys, "s"], "left").na.fill(0)
    r = F.col("n_hit") / F.col("n_true")
    ceiling = F.when(F.col("n_true") == 0, 1.0).when(F.col("n_hit") == 0, 0.0).otherwise(1.25 * r / (0.25 + r))
    return per.groupBy(*keys).agg(
        (F.sum("n_hit") / F.sum("n_true")).alias("pair_recall"), F.avg(ceiling).alias("ceiling"), F.avg("n_cand").alias("cand_mean"), F.percentile("n_cand", 0.99).alias("cand_p99"),
        F.max("n_cand").alias("cand_max"), F.sum("n_cand").alias("n_pairs"),
    )


def sweep(nb: DataFrame, entities: DataFrame, truth: DataFrame, view: str, grid: Mapping[str, tuple] = GRID) -> DataFrame:
    """Quality of every (k, margin, floor) of one view, from one pass: a neighbour is counted for the policies that keep it."""
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(float(m)).alias("margin"), F.lit(float(f)).alias("floor")) for k, m, f in itertools.product(grid["k"], grid["margin"], grid["floor"])])
    scored = nb.where(F.col("view") == view).withColumn("best", F.max("score").over(Window.partitionBy("view", "q")))
    keeps = F.filter(steps, lambda p: (p["k"] >= F.col("rank")) & (F.col("score") >= F.col("best") - p["margin"]) & (F.col("score") >= p["floor"]))
    return _graded(scored.select("q", "s", F.inline(keeps)), entities, truth, steps, ["k", "margin", "floor"])


def cap_sweep(nb: DataFrame, entities: DataFrame, truth: DataFrame, caps: tuple[int, ...] = GRID["cap"]) -> DataFrame:
    """Quality of every cap of an entity's queries in a view, from one pass over its neighbours."""
    at = F.row_number().over(Window.partitionBy("view", "s").orderBy(F.round("score", 9).desc(), "q"))
    steps = F.array(*[F.struct(F.lit(c).alias("cap")) for c in caps])
    kept = nb.withColumn("_at", at).select("q", "s", F.inline(F.filter(steps, lambda c: c["cap"] >= F.col("_at")))).distinct()
    return _graded(kept, entities, truth, steps, ["cap"])


def choose(nb: DataFrame, entities: DataFrame, truth: DataFrame, view: str, tolerance: float = 0.0005, cap_tolerance: float = 0.0002, grid: Mapping[str, tuple] = GRID) -> tuple[tuple[int, float, float], int | None]:
    """The (k, margin, floor) of the smallest candidate set within the tolerance of the best ceiling, then the cap of the
    smallest set within the second tolerance of that ceiling; no cap where every one costs more."""
    top = smallest_within(sweep(nb, entities, truth, view, grid), tolerance).first()
    rule = (top.k, top.margin, top.floor)
    capped = cap_sweep(view_policy(nb.where(F.col("view") == view), {view: rule}), entities, truth, grid["cap"])
    fit = capped.where(F.col("ceiling") >= top.ceiling - cap_tolerance).orderBy("n_pairs", "cap").first()
    return rule, None if fit is None else fit.cap
