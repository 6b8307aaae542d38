"""Learned pair scoring on pyspark.ml: matcher, pruner, out-of-fold scores, blend, stacker."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml import Pipeline
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.operators import metrics

#: Stand-in for a missing or infinite feature; a flag column says where it stands.
MISSING = -9.0
#: Columns that are never features.
NOT_FEATURES = ("rid", "s1", "label", "weight", "fold", "role", "p", "entity_id", "block")


def feature_columns(df: DataFrame, deny: Sequence[str] = NOT_FEATURES) -> list[str]:
    return [c for c, k in df.dtypes if c not in deny and k in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")]


def _clean(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), MISSING).otherwise(v)


def assemble(df: DataFrame, columns: Sequence[str], flags: bool = True) -> DataFrame:
    """Adds ``features``: the columns without gaps, and one flag for each column that says where there was one."""
    ready = df.withColumns({f"_f_{c}": _clean(c) for c in columns} | ({f"_m_{c}": F.col(c).isNull().cast("double") for c in columns} if flags else {}))
    names = [f"_f_{c}" for c in columns] + ([f"_m_{c}" for c in columns] if flags else [])
    return VectorAssembler(inputCols=names, outputCol="features").transform(ready).drop(*names)


class Matcher:
    """A gradient-boosted (or logistic, or perceptron) scorer over named columns."""

    def __init__(self, columns: Sequence[str], kind: str = "gbt", rounds: int = 30, depth: int = 5, rate: float = 0.2, seed: int = 7):
        self.columns, self.kind, self.model = list(columns), kind, None
        common = {"featuresCol": "features", "labelCol": "label"}
        if kind == "gbt":
            self.estimator = GBTClassifier(**common, maxIter=rounds, maxDepth=depth, stepSize=rate, seed=seed, weightCol="weight")
        elif kind == "logistic":
            self.estimator = LogisticRegression(**common, maxIter=rounds, regParam=1e-4, weightCol="weight")
        else:
            net = MultilayerPerceptronClassifier(featuresCol="scaled", labelCol="label", layers=[2 * len(self.columns), 32, 16, 2], maxIter=rounds, seed=seed)
            self.estimator = Pipeline(stages=[StandardScaler(inputCol="features", outputCol="scaled", withMean=True), net])

    def fit(self, df: DataFrame, held: Column | None = None) -> Matcher:
        """Train on ``label`` (weights default to 1); rows where ``held`` is true stop the boosting early, and other kinds leave them out."""
        data = assemble(df if "weight" in df.columns else df.withColumn("weight", F.lit(1.0)), self.columns).withColumn("label", F.col("label").cast("double"))
        est = self.estimator
        if held is not None and self.kind == "gbt":
            est, data = est.copy({est.validationIndicatorCol: "_held"}), data.withColumn("_held", held)
        elif held is not None:
            data = data.where(~held)
        self.model = est.fit(data)
        return self

    def score(self, df: DataFrame, out: str = "p") -> DataFrame:
        scored = self.model.transform(assemble(df, self.columns))
        return scored.withColumn(out, vector_to_array("probability")[1]).drop("features", "scaled", "rawPrediction", "probability", "prediction")

    def trees(self) -> int:
        """Boosting rounds that the early stop left (0 for other kinds)."""
        return self.model.getNumTrees if self.kind == "gbt" else 0

    def importance(self) -> list[tuple[str, float]]:
        if self.kind != "gbt":
            return []
        values = self.model.featureImportances.toArray()[: len(self.columns)]
        return sorted(zip(self.columns, values.tolist(), strict=True), key=lambda x: -x[1])


def out_of_fold(df: DataFrame, make, folds: int = 5, fold: str = "fold", out: str = "p") -> DataFrame:  # noqa: ANN001
    """Scores of each fold from a model of the other folds."""
    parts = [make().fit(df.where(F.col(fold) != k)).score(df.where(F.col(fold) == k), out) for k in range(folds)]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result


def cross_validated(df: DataFrame, make, folds: int, train: Column, fold: str = "fold", out: str = "p") -> tuple[DataFrame, int]:  # noqa: ANN001
    """Scores of all rows by models that saw no row of their fold, and the number of rounds for a refit.

    Models train on rows where ``train`` is true; the fold's own training rows stop the boosting. A refit on all of them takes
    1.1 times the mean number of rounds.
    """
    result, rounds = None, []
    for k in range(folds):
        mine = F.col(fold) == k
        model = make().fit(df.where(train), mine)
        part = model.score(df.where(mine), out)
        rounds.append(model.trees())
        result = part if result is None else result.unionByName(part)
    return result, max(1, int(1.1 * sum(rounds) / len(rounds)))


#: Shares of the trees in a blend with the net.
BLENDS = (0.0, 0.3, 0.5, 0.7, 1.0)


def blend(df: DataFrame, a: str, b: str, weight: float, out: str = "p") -> DataFrame:
    return df.withColumn(out, weight * F.col(a) + (1 - weight) * F.col(b))


def best_blend(scored: DataFrame, a: str, b: str, entities: DataFrame, truth: DataFrame, weights: Sequence[float] = BLENDS) -> tuple[float, dict, float]:
    """(weight, rule, macro F0.5) of the blend whose best rule scores highest, the first of equals."""
    tried = [(w, *metrics.best_rule(entities, truth, blend(scored, a, b, w))) for w in weights]  # a fixed list
    return max(tried, key=lambda x: x[2])


def prune(pairs: DataFrame, pruner: Matcher, least: float = 0.003) -> DataFrame:
    """Pairs whose cheap score reaches the bound: the expensive features are made for these only."""
    return pruner.score(pairs, "q").where(F.col("q") >= least)


def area(df: DataFrame, score: str, metric: str = "areaUnderPR") -> float:
    """Area under the precision-recall (or areaUnderROC) curve."""
    ready = df.select(F.col("label").cast("double").alias("label"), F.col(score).alias("score"))
    return BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="label", metricName=metric).evaluate(ready)


def transfer(df: DataFrame, make, group: str) -> DataFrame:  # noqa: ANN001
    """Scores of each group from a model of all other groups."""
    groups = [r[0] for r in df.select(group).distinct().orderBy(group).collect()]  # blocks, a bounded set here
    parts = [make().fit(df.where(F.col(group) != g)).score(df.where(F.col(group) == g)) for g in groups]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result
