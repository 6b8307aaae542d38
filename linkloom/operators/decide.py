"""Decisions over scored pairs (rid, s1, p)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assign(pairs: DataFrame) -> DataFrame:
    """The best entity of each record; ties go to the smaller entity."""
    order = Window.partitionBy("rid").orderBy(F.col("p").desc(), "s1")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def select_threshold(pairs: DataFrame, t: float, one_to_one: bool = False) -> DataFrame:
    return (assign(pairs) if one_to_one else pairs).where(F.col("p") >= t)


def _prefix_gain(pairs: DataFrame, q, n_scale: float = 1.0) -> DataFrame:  # noqa: ANN001
    """Adds q, m (place within the entity, ties by record), ef (expected F0.5 of the first m) and ef0 (no match at all)."""
    whole = Window.partitionBy("s1")
    order = whole.orderBy(F.col("q").desc(), "rid")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    out = pairs.withColumn("q", q).withColumn("m", F.row_number().over(order))
    out = out.withColumns({"_tp": F.sum("q").over(run), "_all": F.sum("q").over(whole), "ef0": F.exp(F.sum(F.log1p(-F.col("q"))).over(whole))})
    return out.withColumn("ef", 1.25 * F.col("_tp") / (F.col("m") + 0.25 * n_scale * F.col("_all"))).drop("_tp", "_all")


def select_expected_power(pairs: DataFrame, power: float = 1.0, min_p: float = 0.0) -> DataFrame:
    """The first m records of each entity that maximise expected F0.5 of q = p ** power; none where no match is likelier; then q >= min_p."""
    q = F.least(F.greatest(F.pow("p", F.lit(power)), F.lit(1e-6)), F.lit(1 - 1e-6))
    return _best_prefix(pairs.withColumn("q", q), ["s1"]).where(F.col("q") >= min_p).drop("q")


def select_expected_calib(pairs: DataFrame, calib: float = 1.0, floor: float = 0.0) -> DataFrame:
    """As above, but ``calib`` multiplies the expected number of matches and only records at the floor or above can end the set."""
    q = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    d = _prefix_gain(pairs, q, calib)
    whole = Window.partitionBy("s1")
    ok = F.when(F.col("q") >= floor, F.round("ef", 12))
    d = d.withColumn("_ef", ok).withColumn("_best", F.max("_ef").over(whole))
    d = d.withColumn("_m", F.min(F.when(F.col("_ef") == F.col("_best"), F.col("m"))).over(whole))
    return d.where((F.col("m") <= F.col("_m")) & (F.col("_best") > F.col("ef0"))).drop("_best", "_m", "_ef", "ef", "ef0", "m", "q")


def apply_rule(pairs: DataFrame, rule: dict) -> DataFrame:
    """A rule is {"rule": "threshold", "t": ...} or {"rule": "expected_f", "alpha": ..., "min_p": ...}; one entity per record first."""
    one = assign(pairs)
    return select_threshold(one, rule["t"]) if rule["rule"] == "threshold" else select_expected_power(one, rule["alpha"], rule["min_p"])


#: The rules that tuning tries.
RULES = [{"rule": "threshold", "t": t} for t in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)] + [{"rule": "expected_f", "alpha": a, "min_p": m} for a in (0.7, 1.0, 1.5, 2.0, 3.0) for m in (0.0, 0.2, 0.4)]


def chosen_by(assigned: DataFrame, rules: Sequence[dict]) -> DataFrame:
    """(rule_no, rid, s1) of all pairs that each rule chooses, from one reading of pairs with one entity a record."""
    cuts = [(i, float(r["t"])) for i, r in enumerate(rules) if r["rule"] == "threshold"]
    powers = sorted({r["alpha"] for r in rules if r["rule"] != "threshold"})
    pairs, parts = assigned.select("rid", "s1", "p"), []
    if cuts:
        steps = F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(t).alias("t")) for i, t in cuts])
        parts.append(pairs.select("rid", "s1", F.inline(F.filter(steps, lambda c: c["t"] <= F.col("p")))).select("rule_no", "rid", "s1"))
    if powers:
        each = pairs.withColumn("power", F.explode(F.array(*[F.lit(float(a)) for a in powers])))
        q = F.least(F.greatest(F.pow("p", F.col("power")), F.lit(1e-6)), F.lit(1 - 1e-6))
        kept = _best_prefix(each.withColumn("q", q), ["power", "s1"])
        floors = F.array(*[F.struct(F.lit(i).alias("rule_no"), F.lit(float(r["alpha"])).alias("power"), F.lit(float(r["min_p"])).alias("min_p")) for i, r in enumerate(rules) if r["rule"] != "threshold"])
        met = F.filter(floors, lambda c: (c["power"] == F.col("power")) & (c["min_p"] <= F.col("q")))
        parts.append(kept.select("rid", "s1", F.inline(met)).select("rule_no", "rid", "s1"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _best_prefix(d: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of the prefix (by q, ties by record) with the greatest expected F0.5 within a key, none where no match is likelier."""
    whole = Window.partitionBy(*key)
    order = whole.orderBy(F.col("q").desc(), "rid")
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_m": F.row_number().over(order), "_tp": F.sum("q").over(run), "_all": F.sum("q").over(whole), "_none": F.exp(F.sum(F.log1p(-F.col("q"))).over(whole))})
    d = d.withColumn("_ef", F.round(1.25 * F.col("_tp") / (F.col("_m") + 0.25 * F.col("_all")), 12))
    d = d.withColumn("_top", F.max("_ef").over(whole))
    d = d.withColumn("_last", F.min(F.when(F.col("_ef") == F.col("_top"), F.col("_m"))).over(whole))
    return d.where((F.col("_m") <= F.col("_last")) & (F.col("_top") > F.col("_none"))).drop("_m", "_tp", "_all", "_none", "_ef", "_top", "_last")
