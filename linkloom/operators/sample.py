"""Deterministic samples, roles and splits from integer keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def holdout(key: Column, digits: Sequence[int]) -> Column:
    """True where the hundreds digit of the key is one of these."""
    return (F.floor(key / 100) % 10).isin(list(digits))


def fold(key: Column, n: int = 5) -> Column:
    """Fold of a key by a multiplicative hash."""
    return F.pmod(F.shiftright(F.pmod(key * 2654435761, F.lit(4294967296)), 16), F.lit(n))


def curve_keep(key: Column, share: float) -> Column:
    """Keys that a learning-curve sample of this share keeps."""
    return F.pmod(key * 2246822519, F.lit(1000)) < share * 1000


def role(key: Column, train_pct: int = 30, valid_pct: int = 4) -> Column:
    """2 and 3: the two validation sets, 1: training, 0: unused, by an integer mix of the key that every engine can repeat."""
    at = pair_uniform(key, F.lit(42)) * 100
    return F.when(at < valid_pct, 2).when(at < 2 * valid_pct, 3).when(at < 2 * valid_pct + train_pct, 1).otherwise(0)


def number_of(key: Column) -> Column:
    """An integer under 2 ** 31 for a key of any type, to feed the mixes here."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 31))


def pair_uniform(a: Column, b: Column) -> Column:
    """A number in [0, 1) mixed from two integers, the same on every engine."""
    two32 = F.lit(4294967296)
    h = F.pmod(a * 2654435761 + b * 2246822519, two32)
    h = F.pmod(h.bitwiseXOR(F.shiftright(h, 15)) * 739982445, two32)
    return h.bitwiseXOR(F.shiftright(h, 12)) / 4294967296.0


def easy_negatives(pairs: DataFrame, score: str, best: str, label: str, rel: float = 0.8, keep: float = 1.0) -> DataFrame:
    """Keeps a share of the easy negatives (score under rel times the record's best) with weight 1 / keep."""
    easy = (F.col(label) == 0) & (F.col(score) < rel * F.col(best))
    return pairs.withColumn("weight", F.when(easy, 1.0 / keep).otherwise(1.0)).where(~easy | (pair_uniform(F.col("rid"), F.col("s1")) < keep))


def subworld(entities: DataFrame, records: DataFrame, truth: DataFrame, key: str, rec_key: str, pct: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A consistent part of a world: entities by their key's last two digits, all their records, and the same share of records without an entity."""
    ents = entities.where(F.col(key) % 100 < pct)
    pairs = truth.join(ents.select(F.col(key).alias("s1")), "s1", "left_semi")
    mine = records.join(pairs.select(F.col("rid").alias(rec_key)), rec_key, "left_semi")
    free = records.join(truth.select(F.col("rid").alias(rec_key)), rec_key, "left_anti").where(F.col(rec_key) % 100 < pct)
    return ents, mine.unionByName(free), pairs


def touching(candidates: DataFrame, held: DataFrame) -> DataFrame:
    """All candidates of records that have a candidate among the held-out entities (s1)."""
    records = candidates.join(held, "s1", "left_semi").select("rid").distinct()
    return candidates.join(records, "rid", "left_semi")


def subworld_fraction(entities: DataFrame, records: DataFrame, truth: DataFrame, key: str, rec_key: str, share: float, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``subworld``, for any share of the entities, drawn by a mix of key and seed."""
    drawn = lambda c: pair_uniform(F.col(c), F.lit(seed)) < share
    ents = entities.where(drawn(key))
    pairs = truth.join(ents.select(F.col(key).alias("s1")), "s1", "left_semi")
    mine = records.join(pairs.select(F.col("rid").alias(rec_key)), rec_key, "left_semi")
    free = records.join(truth.select(F.col("rid").alias(rec_key)), rec_key, "left_anti").where(drawn(rec_key))
    return ents, mine.unionByName(free), pairs


def reindexed(rows: DataFrame, key: str, order: Sequence[str] = (), ranges: int = 4096) -> DataFrame:
    """Adds ``row``, a dense number from 0 in the order of an integer key: positions within ranges of the key plus the ranges' offsets."""
    ends = rows.agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))  # one row
    cut = rows.join(F.broadcast(ends)).withColumn("_range", F.floor((F.col(key) - F.col("_lo")) * ranges / (F.col("_hi") - F.col("_lo") + 1)))
    sizes = cut.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # at most ``ranges`` rows
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy("_range").orderBy(key, *order))
    return cut.withColumn("_at", at).join(F.broadcast(before), "_range").withColumn("row", F.col("_before") + F.col("_at") - 1).drop("_lo", "_hi", "_range", "_at", "_before")
