"""Queries that look into results, sizes and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.operators import decide, inspect, sample
from linkloom.plans.q_decisions import _A, _P, _S, _T, scored, truth
from linkloom.plans.q_retrieval import t
from linkloom.plans.q_tables import _uniform
from linkloom.sources import transfer


def source_sizes(spark, sf):  # noqa: ANN001, ANN201
    return transfer.source_sizes({n: t(spark, sf, n) for n in ("supplier", "customer", "part", "orders", "lineitem")})


def _predicted(spark, sf):  # noqa: ANN001, ANN202
    return decide.select_threshold(scored(spark, sf), 0.6, one_to_one=True).select("rid", "s1")


def missed_records(spark, sf):  # noqa: ANN001, ANN201
    """Missing entities and scores are shown as -1."""
    return inspect.missed_records(truth(spark, sf), _predicted(spark, sf), scored(spark, sf)).na.fill(-1)


def error_samples(spark, sf):  # noqa: ANN001, ANN201
    """The 25 worst wrong pairs and 25 missed ones (a report)."""
    return inspect.error_samples(truth(spark, sf), _predicted(spark, sf), scored(spark, sf), 25).na.fill(-1.0)


def rec_exact_counts(spark, sf):  # noqa: ANN001, ANN201
    """Line items as candidates of orders; two flags stand for equal core names and equal skeletons."""
    li = t(spark, sf, "lineitem").select(F.col("l_orderkey").alias("rid"), F.col("l_linenumber").alias("line"), "l_returnflag", "l_linestatus")
    return inspect.exact_counts(li, "rid", core_exact=F.col("l_returnflag") == "A", skel_exact=F.col("l_linestatus") == "F").select("rid", "line", "rec_n_core_exact", "rec_n_skel_exact")


def plot_rows(spark, sf):  # noqa: ANN001, ANN201
    return inspect.plot_rows(scored(spark, sf), 0.05)


def subworld_fraction(spark, sf):  # noqa: ANN001, ANN201
    c, o = t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").select("o_orderkey")
    pairs = t(spark, sf, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_custkey").alias("s1"), F.col("o_orderkey").alias("rid"))
    ents, recs, left = sample.subworld_fraction(c, o, pairs, "c_custkey", "o_orderkey", 0.125)
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("id"))
    return tag(ents, "entity").unionByName(tag(recs, "record")).unionByName(tag(left.select("rid"), "pair"))


def subworld_reindex(spark, sf):  # noqa: ANN001, ANN201
    """A sub-world of customers and orders with dense row numbers on both sides; pairs name rows."""
    c, o = t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").select("o_orderkey")
    pairs = t(spark, sf, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_custkey").alias("s1"), F.col("o_orderkey").alias("rid"))
    ents, recs, left = sample.subworld(c, o, pairs, "c_custkey", "o_orderkey", 10)
    e = sample.reindexed(ents, "c_custkey").select(F.col("c_custkey").alias("s1"), F.col("row").alias("s1_row"))
    r = sample.reindexed(recs, "o_orderkey").select(F.col("o_orderkey").alias("rid"), F.col("row").alias("rec_row"))
    return left.join(e, "s1").join(r, "rid").select("s1", "rid", "s1_row", "rec_row")


QUERIES = {f.__name__: f for f in (source_sizes, missed_records, error_samples, rec_exact_counts, plot_rows, subworld_fraction, subworld_reindex)}

_TR = "tr AS (SELECT o_custkey AS s1, o_orderkey AS rid FROM orders WHERE o_orderkey % 4 <> 0)"
ORACLES = {
    "source_sizes": " UNION ALL ".join(f"SELECT '{n}' AS source, count(*) AS n FROM {n}" for n in ("supplier", "customer", "part", "orders", "lineitem")),
    "missed_records": f"""WITH {_S}, {_A}, {_P}, {_T}, m AS (SELECT rid, s1 FROM tr ANTI JOIN pr USING (rid, s1)), g AS (SELECT rid, min(s1) AS went_to FROM pr GROUP BY rid)
SELECT m.rid, m.s1, coalesce(g.went_to, -1) AS went_to, coalesce(a.p, -1) AS p_there, coalesce(b.p, -1) AS p_here FROM m LEFT JOIN g ON g.rid = m.rid LEFT JOIN sc a ON a.rid = m.rid AND a.s1 = g.went_to LEFT JOIN sc b ON b.rid = m.rid AND b.s1 = m.s1""",
    "error_samples": f"""WITH {_S}, {_A}, {_P}, {_T}, w AS (SELECT rid, s1, p FROM pr ANTI JOIN tr USING (rid, s1) JOIN sc USING (rid, s1) ORDER BY p DESC, rid, s1 LIMIT 25),
m AS (SELECT rid, s1 FROM tr ANTI JOIN pr USING (rid, s1) ORDER BY {_uniform('rid', 's1')}, rid, s1 LIMIT 25)
SELECT 'wrong' AS kind, rid, s1, p FROM w UNION ALL SELECT 'missed', m.rid, m.s1, coalesce(sc.p, -1) FROM m LEFT JOIN sc ON sc.rid = m.rid AND sc.s1 = m.s1""",
    "rec_exact_counts": "SELECT l_orderkey AS rid, l_linenumber AS line, (sum((l_returnflag = 'A')::INT) OVER w)::BIGINT AS rec_n_core_exact, (sum((l_linestatus = 'F')::INT) OVER w)::BIGINT AS rec_n_skel_exact FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)",
    "plot_rows": f"WITH {_S} SELECT rid, s1, p FROM sc WHERE {_uniform('rid', 's1')} < 0.05",
    "subworld_fraction": f"""WITH {_TR}, e AS (SELECT c_custkey FROM customer WHERE {_uniform('c_custkey', '42')} < 0.125), k AS (SELECT * FROM tr WHERE s1 IN (SELECT c_custkey FROM e))
SELECT 'entity' AS kind, c_custkey AS id FROM e UNION ALL SELECT 'record', o_orderkey FROM orders WHERE o_orderkey IN (SELECT rid FROM k)
UNION ALL SELECT 'record', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT rid FROM tr) AND {_uniform('o_orderkey', '42')} < 0.125 UNION ALL SELECT 'pair', rid FROM k""",
    "subworld_reindex": f"""WITH {_TR}, e AS (SELECT c_custkey AS s1, row_number() OVER (ORDER BY c_custkey) - 1 AS s1_row FROM customer WHERE c_custkey % 100 < 10), k AS (SELECT * FROM tr WHERE s1 IN (SELECT s1 FROM e)),
r AS (SELECT o_orderkey AS rid, row_number() OVER (ORDER BY o_orderkey) - 1 AS rec_row FROM orders WHERE o_orderkey IN (SELECT rid FROM k) OR (o_orderkey NOT IN (SELECT rid FROM tr) AND o_orderkey % 100 < 10))
SELECT s1, rid, s1_row, rec_row FROM k JOIN e USING (s1) JOIN r USING (rid)""",
}
