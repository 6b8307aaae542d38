"""Competition, decision and metric queries over lineitem as scored pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.operators import compete, decide, metrics
from linkloom.plans.q_retrieval import t


def scored(spark, sf) -> DataFrame:  # noqa: ANN001
    """(rid, s1, p): one row per order and supplier, p from discount and quantity, distinct to 6 digits."""
    p = F.round(F.max(F.col("l_discount") * 5 + F.col("l_quantity") / 101), 6)
    return t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("rid"), F.col("l_suppkey").alias("s1")).agg(F.least(p, F.lit(0.999999)).alias("p"))


def truth(spark, sf) -> DataFrame:  # noqa: ANN001
    return t(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("rid"), F.col("l_suppkey").alias("s1")).distinct()


def entities(spark, sf) -> DataFrame:  # noqa: ANN001
    return t(spark, sf, "supplier").select(F.col("s_suppkey").alias("s1"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


def competition_top2(spark, sf):  # noqa: ANN001, ANN201
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("rid"), (F.col("o_totalprice") / 1e6).alias("v"))
    return rounded(compete.top_two(o, "rid", "v"), "top1", "top2")


def competition_rel(spark, sf):  # noqa: ANN001, ANN201
    out = compete.competition(scored(spark, sf), "p", "rid", "r")
    return rounded(out, "grp_r_rel", "grp_r_margin", "grp_r_gap12")


def cand_context(spark, sf):  # noqa: ANN001, ANN201
    return rounded(compete.context(scored(spark, sf), "p"), "s1_gap")


def competition_leads(spark, sf):  # noqa: ANN001, ANN201
    li = t(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("rid"), F.col("l_suppkey").alias("s1")).agg(F.max("l_quantity").alias("a"), F.max("l_discount").alias("b"), F.max("l_tax").alias("c"))
    return rounded(compete.leads(li, ("a", "b", "c")), "lead_a", "lead_b", "lead_c")


def name_frequency(spark, sf):  # noqa: ANN001, ANN201
    p = t(spark, sf, "part").select("p_partkey", "p_brand", "p_name")
    return compete.value_frequency(p, p, "p_brand", "p_name").select("p_partkey", "freq")


def stack_features(spark, sf):  # noqa: ANN001, ANN201
    out = compete.stack_features(scored(spark, sf))
    return rounded(out, "rec_pmax", "rec_psum_other", "s1_pmax", "s1_psum", "p_minus_recmax", "p_over_s1max", "rec_p_other_best")


def one_to_one_assign(spark, sf):  # noqa: ANN001, ANN201
    return decide.assign(scored(spark, sf))


def threshold_select(spark, sf):  # noqa: ANN001, ANN201
    return decide.select_threshold(scored(spark, sf), 0.6, one_to_one=True).select("rid", "s1")


def expected_f_power(spark, sf):  # noqa: ANN001, ANN201
    return decide.select_expected_power(decide.assign(scored(spark, sf)), 2.0, 0.2).select("rid", "s1")


def expected_f_calib(spark, sf):  # noqa: ANN001, ANN201
    return decide.select_expected_calib(decide.assign(scored(spark, sf)), 1.2, 0.3).select("rid", "s1")


def macro_f05(spark, sf):  # noqa: ANN001, ANN201
    pred = decide.select_threshold(scored(spark, sf), 0.6, one_to_one=True)
    out = metrics.summary(metrics.per_entity(entities(spark, sf), truth(spark, sf), pred))
    return rounded(out, "macro_f05", "pair_precision", "pair_recall", "singleton_acc")


def f05_threshold_sweep(spark, sf):  # noqa: ANN001, ANN201
    out = metrics.sweep(entities(spark, sf), truth(spark, sf), scored(spark, sf), [round(0.05 * i, 2) for i in range(1, 20)])
    return rounded(out, "macro_f05", "pair_precision", "pair_recall", "singleton_acc")


def rule_grid(spark, sf):  # noqa: ANN001, ANN201
    rules = decide.RULES[:7] + [decide.RULES[10], decide.RULES[17]]
    return metrics.tune_rules(entities(spark, sf), truth(spark, sf), scored(spark, sf), rules).select("rule_no", F.round("macro_f05", 6).alias("macro_f05"))


def loss_decomposition(spark, sf):  # noqa: ANN001, ANN201
    pred = decide.select_threshold(scored(spark, sf), 0.6, one_to_one=True)
    return rounded(metrics.loss_cases(metrics.per_entity(entities(spark, sf), truth(spark, sf), pred)), "loss")


def anti_semi_errors(spark, sf):  # noqa: ANN001, ANN201
    """Per order: how many predicted pairs are wrong and how many true pairs are missed."""
    pred, true = decide.select_threshold(scored(spark, sf), 0.6, one_to_one=True).select("rid", "s1"), truth(spark, sf)
    wrong = pred.join(true, ["rid", "s1"], "left_anti").groupBy("rid").agg(F.count(F.lit(1)).alias("n_wrong"))
    missed = true.join(pred, ["rid", "s1"], "left_anti").groupBy("rid").agg(F.count(F.lit(1)).alias("n_missed"))
    return wrong.join(missed, "rid", "full").na.fill(0)


def ceiling_analysis(spark, sf):  # noqa: ANN001, ANN201
    """Macro F0.5 if exactly the true candidates were chosen, the candidates being pairs of p >= 0.4."""
    cand = scored(spark, sf).where("p >= 0.4")
    out = metrics.summary(metrics.per_entity(entities(spark, sf), truth(spark, sf), cand.join(truth(spark, sf), ["rid", "s1"], "left_semi")))
    return out.select(F.round("macro_f05", 6).alias("ceiling"), F.round("pair_recall", 6).alias("pair_recall"))


def gate_kill_rescue(spark, sf):  # noqa: ANN001, ANN201
    """Pairs after a gate: entities with a weak best candidate lose all pairs, entities left empty get back their best one if it is strong."""
    base = decide.assign(scored(spark, sf))
    best = base.groupBy("s1").agg(F.max("p").alias("best"), F.count(F.lit(1)).alias("n"))
    kept = decide.select_threshold(base, 0.7).join(best.where("best < 0.75"), "s1", "left_anti")
    empty = best.where("best >= 0.75").join(kept, "s1", "left_anti")
    rescued = base.join(empty, "s1").where("p = best").select("rid", "s1", "p")
    return kept.select("rid", "s1", "p").unionByName(rescued).select("rid", "s1")


def entity_gate_features(spark, sf):  # noqa: ANN001, ANN201
    """Per entity: numbers, best and second best, product of complements, and the best of odd and even records (two sources)."""
    s = scored(spark, sf)
    tops = compete.top_two(s, "s1", "p")
    more = s.groupBy("s1").agg(
        F.exp(F.sum(F.log1p(-F.col("p")))).alias("p_none"), F.sum(F.when(F.col("rid") % 2 == 0, F.col("p"))).alias("sum_even"), F.max(F.when(F.col("rid") % 2 == 1, F.col("p"))).alias("max_odd"), F.max_by("rid", F.struct("p", "rid")).alias("best_rid")
    )
    return rounded(tops.join(more, "s1"), "top1", "top2", "p_none", "sum_even", "max_odd")


def score_distribution(spark, sf):  # noqa: ANN001, ANN201
    """Per nation: mean best score of its suppliers, share above a half, matches per supplier."""
    s = t(spark, sf, "supplier").select(F.col("s_suppkey").alias("s1"), F.col("s_nationkey").alias("nation"))
    per = s.join(scored(spark, sf).groupBy("s1").agg(F.max("p").alias("best")), "s1", "left").join(decide.select_threshold(scored(spark, sf), 0.6, True).groupBy("s1").agg(F.count(F.lit(1)).alias("m")), "s1", "left")
    out = per.groupBy("nation").agg(F.avg("best").alias("mean_best"), F.avg((F.coalesce("best", F.lit(0.0)) > 0.5).cast("double")).alias("share_high"), F.avg(F.coalesce("m", F.lit(0))).alias("matches"))
    return rounded(out, "mean_best", "share_high", "matches")


QUERIES = {
    f.__name__: f
    for f in (competition_top2, competition_rel, cand_context, competition_leads, name_frequency, stack_features, one_to_one_assign, threshold_select, expected_f_power, expected_f_calib, macro_f05, f05_threshold_sweep, rule_grid, loss_decomposition, anti_semi_errors, ceiling_analysis, gate_kill_rescue, entity_gate_features, score_distribution)
}

_S = "sc AS (SELECT l_orderkey AS rid, l_suppkey AS s1, least(round(max(l_discount * 5 + l_quantity / 101), 6), 0.999999::DOUBLE) AS p FROM lineitem GROUP BY ALL)"
_T = "tr AS (SELECT DISTINCT l_orderkey AS rid, l_suppkey AS s1 FROM lineitem WHERE l_returnflag = 'R')"
_A = "asg AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY rid ORDER BY p DESC, s1) = 1)"
_P = "pr AS (SELECT rid, s1 FROM asg WHERE p >= 0.6)"
_F = "CASE WHEN nt = 0 AND np = 0 THEN 1.0::DOUBLE WHEN nh = 0 OR nt = 0 OR np = 0 THEN 0 ELSE 1.25::DOUBLE * (nh / np::DOUBLE) * (nh / nt::DOUBLE) / (0.25::DOUBLE * (nh / np::DOUBLE) + nh / nt::DOUBLE) END"


def _per(pred: str = "pr", name: str = "per") -> str:
    return f"""{name} AS (SELECT s1, nt, np, nh, {_F} AS f FROM (SELECT s_suppkey AS s1, coalesce(t.n, 0) AS nt, coalesce(p.n, 0) AS np, coalesce(h.n, 0) AS nh FROM supplier
 LEFT JOIN (SELECT s1, count(*) AS n FROM tr GROUP BY s1) t ON t.s1 = s_suppkey LEFT JOIN (SELECT s1, count(*) AS n FROM {pred} GROUP BY s1) p ON p.s1 = s_suppkey
 LEFT JOIN (SELECT s1, count(*) AS n FROM {pred} JOIN tr USING (rid, s1) GROUP BY s1) h ON h.s1 = s_suppkey))"""


def _ef(power: float, min_p: float, tag: str = "", out: str = "sel") -> str:
    return f"""d{tag} AS (SELECT *, least(greatest(pow(p, {power}::DOUBLE), 1e-6), 1 - 1e-6) AS q FROM asg),
e{tag} AS (SELECT *, row_number() OVER w AS m, sum(q) OVER w AS tp, sum(q) OVER (PARTITION BY s1) AS g, exp(sum(ln(1 - q)) OVER (PARTITION BY s1)) AS ef0 FROM d{tag} WINDOW w AS (PARTITION BY s1 ORDER BY q DESC, rid ROWS UNBOUNDED PRECEDING)),
b{tag} AS (SELECT *, max(round(1.25::DOUBLE * tp / (m + 0.25::DOUBLE * g), 12)) OVER (PARTITION BY s1) AS best, round(1.25::DOUBLE * tp / (m + 0.25::DOUBLE * g), 12) AS ef FROM e{tag}),
c{tag} AS (SELECT *, min(CASE WHEN ef = best THEN m END) OVER (PARTITION BY s1) AS ms FROM b{tag}), {out} AS (SELECT rid, s1 FROM c{tag} WHERE m <= ms AND best > ef0 AND q >= {min_p})"""


_TOP2 = "coalesce(max(CASE WHEN r = 2 THEN v END), -1)"
_SUM = "round(avg(f), 6) AS macro_f05, round(CASE WHEN sum(np) = 0 THEN {none} ELSE sum(nh) / sum(np)::DOUBLE END, 6) AS pair_precision, round(sum(nh) / sum(nt)::DOUBLE, 6) AS pair_recall, round(avg(CASE WHEN nt = 0 THEN f END), 6) AS singleton_acc, count(*) AS n_entities, sum(np)::BIGINT AS n_pred_pairs"
_RULES = [("t", x) for x in (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)]

ORACLES = {
    "competition_top2": "WITH x AS (SELECT o_custkey AS rid, o_totalprice / 1e6 AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC) AS r, max(o_totalprice / 1e6) OVER (PARTITION BY o_custkey) AS mx FROM orders) SELECT rid, round(max(v), 6) AS top1, round(" + _TOP2 + ", 6) AS top2, count(*) AS n, sum((v >= mx - 0.02::DOUBLE)::INT)::BIGINT AS n_tie FROM x GROUP BY rid",
    "competition_rel": f"""WITH {_S}, y AS (SELECT rid, max(CASE WHEN r = 1 THEN p END) AS t1, coalesce(max(CASE WHEN r = 2 THEN p END), -1) AS t2, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p DESC) AS r FROM sc) GROUP BY rid)
SELECT rid, s1, p, n AS grp_r_n, round(p / greatest(t1, 1e-6), 6) AS grp_r_rel, round(CASE WHEN p >= t1 THEN p - greatest(t2, 0) ELSE p - t1 END, 6) AS grp_r_margin, round(t1 - greatest(t2, 0), 6) AS grp_r_gap12 FROM sc JOIN y USING (rid)""",
    "cand_context": f"WITH {_S} SELECT rid, s1, p, count(*) OVER (PARTITION BY s1) AS s1_ncand, count(*) OVER (PARTITION BY rid) AS rec_ncand, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, rid) AS s1_rank, round(max(p) OVER (PARTITION BY s1) - p, 6) AS s1_gap FROM sc",
    "competition_leads": """WITH l AS (SELECT l_orderkey AS rid, l_suppkey AS s1, max(l_quantity) AS a, max(l_discount) AS b, max(l_tax) AS c FROM lineitem GROUP BY ALL),
y AS (SELECT rid, list_sort(list(a), 'DESC') AS ta, list_sort(list(b), 'DESC') AS tb, list_sort(list(c), 'DESC') AS tc FROM l GROUP BY rid)
SELECT rid, s1, a, b, c, """ + ", ".join(f"round({x} - CASE WHEN {x} >= t{x}[1] THEN coalesce(t{x}[2], -1) ELSE t{x}[1] END, 6) AS lead_{x}" for x in "abc") + " FROM l JOIN y USING (rid)",
    "name_frequency": "SELECT p_partkey, CASE WHEN p_name = '' THEN 0 ELSE count(*) OVER (PARTITION BY p_brand, p_name) END AS freq FROM part",
    "stack_features": f"""WITH {_S}, y AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p DESC, s1) AS rr, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, rid) AS sr FROM sc), z AS (SELECT rid, max(CASE WHEN rr = 1 THEN p END) AS f1, greatest(coalesce(max(CASE WHEN rr = 2 THEN p END), -1), 0) AS f2 FROM y GROUP BY rid)
SELECT rid, s1, p, round(f1, 6) AS rec_pmax, rr AS rec_prank, (sum((p > 0.5)::INT) OVER (PARTITION BY rid))::BIGINT AS rec_n05, round(sum(p) OVER (PARTITION BY rid) - p, 6) AS rec_psum_other, round(max(p) OVER (PARTITION BY s1), 6) AS s1_pmax, round(sum(p) OVER (PARTITION BY s1), 6) AS s1_psum, sr AS s1_prank,
(sum((p > 0.5)::INT) OVER (PARTITION BY s1))::BIGINT AS s1_n05, round(p - f1, 6) AS p_minus_recmax, round(p / greatest(max(p) OVER (PARTITION BY s1), 1e-6), 6) AS p_over_s1max, round(CASE WHEN p >= f1 THEN f2 ELSE f1 END, 6) AS rec_p_other_best FROM y JOIN z USING (rid)""",
    "one_to_one_assign": f"WITH {_S}, {_A} SELECT rid, s1, p FROM asg",
    "threshold_select": f"WITH {_S}, {_A}, {_P} SELECT rid, s1 FROM pr",
    "expected_f_power": f"WITH {_S}, {_A}, {_ef(2.0, 0.2)} SELECT rid, s1 FROM sel",
    "expected_f_calib": f"""WITH {_S}, {_A}, d AS (SELECT *, least(greatest(p, 1e-6), 1 - 1e-6) AS q FROM asg),
e AS (SELECT *, row_number() OVER w AS m, sum(q) OVER w AS tp, sum(q) OVER (PARTITION BY s1) AS g, exp(sum(ln(1 - q)) OVER (PARTITION BY s1)) AS ef0 FROM d WINDOW w AS (PARTITION BY s1 ORDER BY q DESC, rid ROWS UNBOUNDED PRECEDING)),
b AS (SELECT *, CASE WHEN q >= 0.3 THEN round(1.25::DOUBLE * tp / (m + 0.25::DOUBLE * 1.2::DOUBLE * g), 12) END AS ef FROM e), b2 AS (SELECT *, max(ef) OVER (PARTITION BY s1) AS best FROM b),
c AS (SELECT *, min(CASE WHEN ef = best THEN m END) OVER (PARTITION BY s1) AS ms FROM b2) SELECT rid, s1 FROM c WHERE m <= ms AND best > ef0""",
    "macro_f05": f"WITH {_S}, {_A}, {_P}, {_T}, {_per()} SELECT {_SUM.format(none=1.0)} FROM per",
    "f05_threshold_sweep": f"""WITH {_S}, {_A}, {_T}, th AS (SELECT unnest([{', '.join(str(round(0.05 * i, 2)) for i in range(1, 20))}]::DOUBLE[]) AS threshold),
g AS (SELECT s_suppkey AS s1, threshold, coalesce(t.n, 0) AS nt FROM supplier CROSS JOIN th LEFT JOIN (SELECT s1, count(*) AS n FROM tr GROUP BY s1) t ON t.s1 = s_suppkey),
a AS (SELECT asg.s1, threshold, count(*) AS np, count(tr.rid) AS nh FROM asg JOIN th ON p >= threshold LEFT JOIN tr ON tr.rid = asg.rid AND tr.s1 = asg.s1 GROUP BY ALL),
per AS (SELECT threshold, nt, np, nh, {_F} AS f FROM (SELECT g.threshold, nt, coalesce(np, 0) AS np, coalesce(nh, 0) AS nh FROM g LEFT JOIN a ON a.s1 = g.s1 AND a.threshold = g.threshold))
SELECT threshold, {_SUM.format(none=0.0)} FROM per GROUP BY threshold""",
    "rule_grid": f"WITH {_S}, {_A}, {_T}, " + ", ".join(f"r{i} AS (SELECT rid, s1 FROM asg WHERE p >= {x})" for i, (_, x) in enumerate(_RULES)) + ", "
    + _ef(1.0, 0.0, "7", "r7") + ", " + _ef(2.0, 0.2, "8", "r8") + ", "
    + ", ".join(_per(f"r{i}", f"per{i}") for i in range(9)) + " " + " UNION ALL ".join(f"SELECT {i} AS rule_no, round(avg(f), 6) AS macro_f05 FROM per{i}" for i in range(9)),
    "loss_decomposition": f"""WITH {_S}, {_A}, {_P}, {_T}, {_per()} SELECT CASE WHEN nt = 0 AND np = 0 THEN 'singleton kept empty' WHEN nt = 0 THEN 'singleton given matches' WHEN np = 0 THEN 'all matches missed' WHEN nh = 0 THEN 'only wrong matches'
 WHEN nh = np AND nh = nt THEN 'exact' WHEN nh = np THEN 'partly missed' ELSE 'some wrong' END AS "case", count(*) AS n, round(sum(1 - f), 6) AS loss FROM per GROUP BY ALL""",
    "anti_semi_errors": f"""WITH {_S}, {_A}, {_P}, {_T}, w AS (SELECT rid, count(*) AS n FROM pr ANTI JOIN tr USING (rid, s1) GROUP BY rid), m AS (SELECT rid, count(*) AS n FROM tr ANTI JOIN pr USING (rid, s1) GROUP BY rid)
SELECT coalesce(w.rid, m.rid) AS rid, coalesce(w.n, 0) AS n_wrong, coalesce(m.n, 0) AS n_missed FROM w FULL JOIN m ON w.rid = m.rid""",
    "ceiling_analysis": f"WITH {_S}, {_T}, pr AS (SELECT rid, s1 FROM sc JOIN tr USING (rid, s1) WHERE p >= 0.4), {_per()} SELECT round(avg(f), 6) AS ceiling, round(sum(nh) / sum(nt)::DOUBLE, 6) AS pair_recall FROM per",
    "gate_kill_rescue": f"""WITH {_S}, {_A}, b AS (SELECT s1, max(p) AS best FROM asg GROUP BY s1), k AS (SELECT rid, s1 FROM asg JOIN b USING (s1) WHERE p >= 0.7 AND best >= 0.75)
SELECT rid, s1 FROM k UNION ALL SELECT rid, s1 FROM asg JOIN b USING (s1) WHERE best >= 0.75 AND p = best AND s1 NOT IN (SELECT s1 FROM k)""",
    "entity_gate_features": f"""WITH {_S}, x AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC) AS r, max(p) OVER (PARTITION BY s1) AS mx FROM sc)
SELECT s1, round(max(p), 6) AS top1, round(coalesce(max(CASE WHEN r = 2 THEN p END), -1), 6) AS top2, count(*) AS n, sum((p >= mx - 0.02::DOUBLE)::INT)::BIGINT AS n_tie, round(exp(sum(ln(1 - p))), 6) AS p_none, round(sum(CASE WHEN rid % 2 = 0 THEN p END), 6) AS sum_even, round(max(CASE WHEN rid % 2 = 1 THEN p END), 6) AS max_odd, max_by(rid, (p, rid)) AS best_rid FROM x GROUP BY s1""",
    "score_distribution": f"""WITH {_S}, {_A}, {_P} SELECT s_nationkey AS nation, round(avg(best), 6) AS mean_best, round(avg((coalesce(best, 0) > 0.5)::INT), 6) AS share_high, round(avg(coalesce(m, 0)), 6) AS matches FROM supplier
 LEFT JOIN (SELECT s1, max(p) AS best FROM sc GROUP BY s1) b ON b.s1 = s_suppkey LEFT JOIN (SELECT s1, count(*) AS m FROM pr GROUP BY s1) q ON q.s1 = s_suppkey GROUP BY s_nationkey""",
}
