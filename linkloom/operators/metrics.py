"""Per-entity F0.5 and what is built on it. entities: (s1); truth and predictions: (rid, s1)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators import decide


def f05(n_true: Column, n_pred: Column, n_hit: Column) -> Column:
    p, r = n_hit / n_pred, n_hit / n_true
    return F.when((n_true == 0) & (n_pred == 0), 1.0).when((n_hit == 0) | (n_true == 0) | (n_pred == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def per_entity(entities: DataFrame, truth: DataFrame, pred: DataFrame) -> DataFrame:
    """(s1, n_true, n_pred, n_hit, f05) for every entity, those without pairs included."""
    marks = truth.select("s1", "rid", F.lit(1).alias("t"), F.lit(0).alias("p")).unionAll(pred.select("s1", "rid", F.lit(0), F.lit(1)))
    each = marks.groupBy("s1", "rid").agg(F.sum("t").alias("t"), F.sum("p").alias("p"))
    counts = each.groupBy("s1").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"), F.sum(F.when(F.col("t") > 0, F.col("p")).otherwise(0)).alias("n_hit"))
    per = entities.select("s1").distinct().join(counts, "s1", "left").na.fill(0)
    return per.withColumn("f05", f05(F.col("n_true"), F.col("n_pred"), F.col("n_hit")))


def summary(per: DataFrame, by: Sequence[str] = (), no_pred: float = 1.0) -> DataFrame:
    """Macro F0.5, pair precision (``no_pred`` without predictions) and recall, accuracy on entities without matches."""
    hit, pred, true = F.sum("n_hit"), F.sum("n_pred"), F.sum("n_true")
    return per.groupBy(*by).agg(
        F.avg("f05").alias("macro_f05"),
        F.when(pred == 0, no_pred).otherwise(hit / pred).alias("pair_precision"),
        F.when(true == 0, no_pred).otherwise(hit / true).alias("pair_recall"),
        F.avg(F.when(F.col("n_true") == 0, F.col("f05"))).alias("singleton_acc"),
        F.count(F.lit(1)).alias("n_entities"),
        pred.alias("n_pred_pairs"),
    )


def sweep(entities: DataFrame, truth: DataFrame, scored: DataFrame, thresholds: Sequence[float], one_to_one: bool = True) -> DataFrame:
    """Summary at each threshold, from one pass: a pair is explode-counted only at thresholds it reaches."""
    base = decide.assign(scored) if one_to_one else scored
    marked = base.select("rid", "s1", "p").join(truth.select("rid", "s1", F.lit(1).alias("hit")), ["rid", "s1"], "left")
    steps = F.array(*[F.lit(float(t)) for t in thresholds])
    at = marked.select("s1", F.coalesce("hit", F.lit(0)).alias("hit"), F.explode(F.filter(steps, lambda t: t <= F.col("p"))).alias("threshold"))
    pred = at.groupBy("s1", "threshold").agg(F.count(F.lit(1)).alias("n_pred"), F.sum("hit").alias("n_hit"))
    n_true = truth.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    grid = entities.select("s1").distinct().select("s1", F.explode(steps).alias("threshold"))
    per = grid.join(pred, ["s1", "threshold"], "left").join(n_true, "s1", "left").na.fill(0)
    return summary(per.withColumn("f05", f05(F.col("n_true"), F.col("n_pred"), F.col("n_hit"))), ["threshold"], no_pred=0.0)


def ranks_at(nb: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(q, s, rank) of every true pair in its neighbour list; k + 1 where it is absent."""
    return truth.select("q", "s").join(nb.select("q", "s", "rank"), ["q", "s"], "left").select("q", "s", F.coalesce("rank", F.lit(k + 1)).alias("rank"))


def recall_at(ranks: DataFrame, ks: Sequence[int], most: int) -> DataFrame:
    """One row: recall at each k, and mean reciprocal rank (absent pairs count 0)."""
    return ranks.agg(*[F.avg((F.col("rank") <= k).cast("double")).alias(f"r_at_{k}") for k in ks], F.avg(F.when(F.col("rank") <= most, 1.0 / F.col("rank")).otherwise(0.0)).alias("mrr"))


def loss_cases(per: DataFrame) -> DataFrame:
    """Entities and lost score by case."""
    t, p, h = F.col("n_true"), F.col("n_pred"), F.col("n_hit")
    case = (
        F.when((t == 0) & (p == 0), "singleton kept empty").when(t == 0, "singleton given matches").when(p == 0, "all matches missed")
        .when(h == 0, "only wrong matches").when((h == p) & (h == t), "exact").when(h == p, "partly missed").otherwise("some wrong")
    )
    return per.groupBy(case.alias("case")).agg(F.count(F.lit(1)).alias("n"), F.sum(1 - F.col("f05")).alias("loss"))


def tune_rules(entities: DataFrame, truth: DataFrame, scored: DataFrame, rules: Sequence[dict] = tuple(decide.RULES)) -> DataFrame:
    """(rule_no, rule, macro_f05) of every rule from one pass: a pair is counted for the rules that choose it.

    Entities without a chosen pair need no row for a rule: they score 1 without true pairs, else 0, which one count gives.
    """
    true = truth.select("rid", "s1").distinct()
    chosen = decide.chosen_by(decide.assign(scored), rules).join(true.select("rid", "s1", F.lit(1).alias("hit")), ["rid", "s1"], "left")
    n_true = true.groupBy("s1").agg(F.count(F.lit(1)).alias("n_true"))
    ents = entities.select("s1").distinct().join(n_true, "s1", "left").na.fill(0)
    per = chosen.groupBy("rule_no", "s1").agg(F.count(F.lit(1)).alias("n_pred"), F.coalesce(F.sum("hit"), F.lit(0)).alias("n_hit")).join(ents, "s1")
    by_rule = per.groupBy("rule_no").agg(F.sum(f05(F.col("n_true"), F.col("n_pred"), F.col("n_hit"))).alias("won"), F.sum((F.col("n_true") == 0).cast("bigint")).alias("spoilt"))
    whole = ents.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("n_true") == 0).cast("bigint")), F.lit(0)).alias("single"))
    names = scored.sparkSession.createDataFrame([(i, str(r)) for i, r in enumerate(rules)], "rule_no int, rule string")
    met = names.join(by_rule, "rule_no", "left").na.fill({"won": 0.0, "spoilt": 0}).join(F.broadcast(whole))  # one row
    return met.select("rule_no", "rule", ((F.col("won") + F.col("single") - F.col("spoilt")) / F.col("n")).alias("macro_f05"))


def best_rule(entities: DataFrame, truth: DataFrame, scored: DataFrame, rules: Sequence[dict] = tuple(decide.RULES)) -> tuple[dict, float]:
    """The rule with the greatest macro F0.5, the first of equals, and that score."""
    top = tune_rules(entities, truth, scored, rules).orderBy(F.round("macro_f05", 12).desc(), "rule_no").first()
    return rules[top.rule_no], top.macro_f05
