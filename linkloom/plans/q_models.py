"""Learned queries: rows only, no SQL form."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import encoder, models
from linkloom.plans.q_retrieval import t


def _table(spark, sf):  # noqa: ANN001, ANN202
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    n = F.greatest(F.length("text"), F.lit(1))
    count = lambda pattern: F.regexp_count("text", F.lit(pattern)) / n
    return d.select(
        F.col("doc_id").alias("rid"), F.col("quality").alias("label"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"), "lang", F.col("n_chars").cast("double").alias("n_chars"),
        count("[A-Z]").alias("upper"), count("[^A-Za-z0-9\\s]").alias("marks"), count("[0-9]").alias("digits"), count("\\|").alias("pipes"), F.when(F.col("n_chars") > 200, count("\n")).alias("lines"),
    )


COLUMNS = ("n_chars", "upper", "marks", "digits", "pipes", "lines")


def gbt_matcher_oof(spark, sf):  # noqa: ANN001, ANN201
    return models.out_of_fold(_table(spark, sf), lambda: models.Matcher(COLUMNS, rounds=5, depth=3), 3).select("rid", "label", "fold", "p")


def pruner_cascade(spark, sf):  # noqa: ANN001, ANN201
    """Every fold is pruned and scored by models of the others."""
    rows, out = _table(spark, sf), None
    for fold in range(3):
        others = rows.where(F.col("fold") != fold)
        pruner = models.Matcher(("n_chars", "upper"), kind="logistic", rounds=20).fit(others)
        part = models.Matcher(COLUMNS, rounds=5, depth=3).fit(models.prune(others, pruner, 0.3)).score(models.prune(rows.where(F.col("fold") == fold), pruner, 0.3)).select("rid", "label", "q", "p")
        out = part if out is None else out.unionByName(part)
    return out


def stacker(spark, sf):  # noqa: ANN001, ANN201
    first = models.out_of_fold(_table(spark, sf), lambda: models.Matcher(COLUMNS, kind="logistic", rounds=20), 3, out="p1")
    return models.out_of_fold(first, lambda: models.Matcher(("p1", "marks"), rounds=5, depth=2), 3).select("rid", "label", "p1", "p")


def country_transfer(spark, sf):  # noqa: ANN001, ANN201
    return models.transfer(_table(spark, sf), lambda: models.Matcher(COLUMNS, kind="logistic", rounds=20), "lang").select("rid", "lang", "label", "p")


def bi_encoder_views(spark, sf):  # noqa: ANN001, ANN201
    d = t(spark, sf, "documents").select("doc_id", F.col("text").alias("a"), F.concat_ws(" ", "lang", "text").alias("b"))
    return encoder.encode_views(d, "doc_id", {"z": "a", "za": "b"}, encoder.Encoder(32))


QUERIES = {f.__name__: f for f in (gbt_matcher_oof, pruner_cascade, stacker, country_transfer, bi_encoder_views)}
ORACLES: dict = {}
