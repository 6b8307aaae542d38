"""Competition, context and frequency columns over candidate pairs (rid, s1, scores)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TIE = 0.02


def _two(c: str, key: str) -> tuple[Column, Column]:
    """Greatest and second greatest value of a column within a key, -1 where absent."""
    order = Window.partitionBy(key).orderBy(F.col(c).desc())
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.first(c).over(whole), F.lit(-1.0)), F.coalesce(F.nth_value(c, 2).over(whole), F.lit(-1.0))


def top_two(pairs: DataFrame, key: str, score: str) -> DataFrame:
    """(key, top1, top2, n, n_tie): rivals within TIE of the best are near-ties, the best itself included."""
    ranked = pairs.select(key, score).withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.col(score).desc()))).withColumn("_m", F.max(score).over(Window.partitionBy(key)))
    return ranked.groupBy(key).agg(
        F.max(score).alias("top1"), F.coalesce(F.max(F.when(F.col("_r") == 2, F.col(score))), F.lit(-1.0)).alias("top2"), F.count(F.lit(1)).alias("n"), F.sum((F.col(score) >= F.col("_m") - TIE).cast("bigint")).alias("n_tie")
    )


def competition(pairs: DataFrame, score: str, key: str, tag: str) -> DataFrame:
    """Adds grp_{tag}_n, _rel, _margin, _gap12 against the key's other candidates."""
    t1, t2 = _two(score, key)
    v = F.col(score)
    out = pairs.withColumns({"_t1": t1, "_t2": t2, f"grp_{tag}_n": F.count(F.lit(1)).over(Window.partitionBy(key))})
    zero = F.greatest(F.col("_t2"), F.lit(0.0))
    return out.withColumns(
        {
            f"grp_{tag}_rel": v / F.greatest(F.col("_t1"), F.lit(1e-6)),
            f"grp_{tag}_margin": F.when(v >= F.col("_t1"), v - zero).otherwise(v - F.col("_t1")),
            f"grp_{tag}_gap12": F.col("_t1") - zero,
        }
    ).drop("_t1", "_t2")


def context(pairs: DataFrame, score: str) -> DataFrame:
    """Adds s1_ncand, rec_ncand, s1_rank (ties by record), s1_gap over the full candidate set."""
    by_s1, by_rec = Window.partitionBy("s1"), Window.partitionBy("rid")
    return pairs.withColumns(
        {
            "s1_ncand": F.count(F.lit(1)).over(by_s1),
            "rec_ncand": F.count(F.lit(1)).over(by_rec),
            "s1_rank": F.row_number().over(by_s1.orderBy(F.col(score).desc(), "rid")).cast("bigint"),
            "s1_gap": F.max(score).over(by_s1) - F.col(score),
        }
    )


def leads(pairs: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds lead_c for each column: its distance to the record's best other candidate (-1 where there is none).

    The best other is the greatest value, or for a pair that holds it the greatest below it or the same again where several
    hold it: mergeable aggregates, so no task gathers a record's values.
    """
    best = pairs.groupBy("rid").agg(*[F.max(c).alias(f"_best_{c}") for c in columns])
    met = pairs.join(best, "rid")
    next_ = met.groupBy("rid").agg(
        *[F.max(F.when(F.col(c) < F.col(f"_best_{c}"), F.col(c))).alias(f"_next_{c}") for c in columns], *[F.sum((F.col(c) == F.col(f"_best_{c}")).cast("int")).alias(f"_ties_{c}") for c in columns]
    )
    out = met.join(next_, "rid")
    for c in columns:
        top = F.col(f"_best_{c}")
        second = F.when(F.col(f"_ties_{c}") > 1, top).otherwise(F.coalesce(f"_next_{c}", F.lit(-1.0)))
        out = out.withColumn(f"lead_{c}", F.col(c) - F.when(F.col(c) < top, top).otherwise(second))
    return out.select(*pairs.columns, *[f"lead_{c}" for c in columns])


def value_frequency(entities: DataFrame, others: DataFrame, block: str, value: str) -> DataFrame:
    """``others`` with freq: how many entities of the block carry exactly the value; empty values count 0."""
    freq = entities.where(F.col(value) != "").groupBy(block, value).agg(F.count(F.lit(1)).alias("freq"))
    return others.join(freq, [block, value], "left").withColumn("freq", F.coalesce("freq", F.lit(0)).cast("bigint"))


def exact_counts(pairs: DataFrame) -> DataFrame:
    """Adds rec_n_core_exact, rec_n_skel_exact, s1_n_core_exact: how many candidates of the record (the entity) carry exactly its name."""
    rec, s1 = Window.partitionBy("rid"), Window.partitionBy("s1")
    return pairs.withColumns({"rec_n_core_exact": F.sum("core_exact").over(rec), "rec_n_skel_exact": F.sum("skel_exact").over(rec), "s1_n_core_exact": F.sum("core_exact").over(s1)})


def name_frequency(entities: DataFrame, others: DataFrame, block: str, columns: dict[str, str]) -> DataFrame:
    """``others`` with, for each value column, the number of entities of the block that carry its value (0 for none), under the name given."""
    out = others
    for value, name in columns.items():
        freq = entities.groupBy(block, value).agg(F.count(F.lit(1)).cast("double").alias(name))
        out = out.join(freq, [block, value], "left").na.fill({name: 0.0})
    return out


def view_columns(pairs: DataFrame, nb: DataFrame, views: Sequence[str], k: int) -> DataFrame:
    """Six columns a view for pairs (rid, s1, {v}_cos): rank (k + 1 where not found), top1, gap1, margin12, vs2.

    nb: neighbours (view, q, s, rank, score). A record's absent neighbours score -1. gap1 is the distance to its best
    neighbour, margin12 that of its two best, vs2 the lead over the best other entity.
    """
    at = lambda v, r: F.max(F.when((F.col("view") == v) & (F.col("rank") == r), F.col("score")))
    tops = nb.where("rank <= 2").groupBy(F.col("q").alias("rid")).agg(*[at(v, r).alias(f"{v}_top{r}") for v in views for r in (1, 2)])
    ranks = nb.groupBy(F.col("q").alias("rid"), F.col("s").alias("s1")).agg(*[F.max(F.when(F.col("view") == v, F.col("rank"))).cast("double").alias(f"{v}_rank") for v in views])
    out = pairs.join(ranks, ["rid", "s1"], "left").join(tops, "rid", "left")
    out = out.na.fill({f"{v}_rank": float(k + 1) for v in views} | {f"{v}_top{r}": -1.0 for v in views for r in (1, 2)})
    for v in views:
        cos, one, two = (F.col(f"{v}_{c}") for c in ("cos", "top1", "top2"))
        out = out.withColumns({f"{v}_gap1": one - cos, f"{v}_margin12": one - two, f"{v}_vs2": cos - F.when(F.col(f"{v}_rank") == 1, two).otherwise(one)})
    return out.drop(*[f"{v}_top2" for v in views])


def stack_features(pairs: DataFrame, p: str = "p") -> DataFrame:
    """Second-stage columns from first-stage scores over a record's and an entity's candidates."""
    rec, s1 = Window.partitionBy("rid"), Window.partitionBy("s1")
    v = F.col(p)
    high = (v > 0.5).cast("bigint")
    first, second = _two(p, "rid")
    out = pairs.withColumns(
        {
            "rec_pmax": F.max(p).over(rec),
            "rec_prank": F.row_number().over(rec.orderBy(v.desc(), "s1")).cast("bigint"),
            "rec_n05": F.sum(high).over(rec),
            "rec_psum_other": F.sum(p).over(rec) - v,
            "s1_pmax": F.max(p).over(s1),
            "s1_psum": F.sum(p).over(s1),
            "s1_prank": F.row_number().over(s1.orderBy(v.desc(), "rid")).cast("bigint"),
            "s1_n05": F.sum(high).over(s1),
            "_f": first,
            "_s": F.greatest(second, F.lit(0.0)),
        }
    )
    return out.withColumns(
        {"p_minus_recmax": v - F.col("rec_pmax"), "p_over_s1max": v / F.greatest(F.col("s1_pmax"), F.lit(1e-6)), "rec_p_other_best": F.when(v >= F.col("_f"), F.col("_s")).otherwise(F.col("_f"))}
    ).drop("_f", "_s")
