"""Looking into results: where missed records went, error samples, counts of exact candidates, rows for plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators.sample import pair_uniform


def missed_records(truth: DataFrame, predicted: DataFrame, scores: DataFrame) -> DataFrame:
    """(rid, s1, went_to, p_there, p_here) of each true pair that was not predicted: the entity that its record was given to
    (the smallest of several, null: none), and the scores of both pairs (null: no candidate)."""
    missed = truth.join(predicted, ["rid", "s1"], "left_anti")
    given = predicted.groupBy("rid").agg(F.min("s1").alias("went_to"))
    there = scores.select("rid", F.col("s1").alias("went_to"), F.col("p").alias("p_there"))
    here = scores.select("rid", "s1", F.col("p").alias("p_here"))
    return missed.join(given, "rid", "left").join(there, ["rid", "went_to"], "left").join(here, ["rid", "s1"], "left").select("rid", "s1", "went_to", "p_there", "p_here")


def error_samples(truth: DataFrame, predicted: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    """(kind, rid, s1, p): the ``n`` wrong pairs of the greatest score, and ``n`` missed pairs in an order mixed from their ids."""
    wrong = predicted.join(truth, ["rid", "s1"], "left_anti").join(scores, ["rid", "s1"]).orderBy(F.col("p").desc(), "rid", "s1").limit(n)
    missed = truth.join(predicted, ["rid", "s1"], "left_anti").withColumn("u", pair_uniform(F.col("rid"), F.col("s1"))).orderBy("u", "rid", "s1").limit(n)
    missed = missed.join(scores, ["rid", "s1"], "left")
    return wrong.select(F.lit("wrong").alias("kind"), "rid", "s1", "p").unionByName(missed.select(F.lit("missed").alias("kind"), "rid", "s1", "p"))


def exact_counts(pairs: DataFrame, rec: str, **flags: Column) -> DataFrame:
    """Adds ``rec_n_<name>``: how many candidates of the pair's record have the flag."""
    own = Window.partitionBy(rec)
    return pairs.withColumns({f"rec_n_{name}": F.sum(F.coalesce(flag, F.lit(False)).cast("bigint")).over(own) for name, flag in flags.items()})


def plot_rows(pairs: DataFrame, share: float, a: str = "rid", b: str = "s1") -> DataFrame:
    """A share of the rows, the same on every run, for plots."""
    return pairs.where(pair_uniform(F.col(a), F.col(b)) < share)
