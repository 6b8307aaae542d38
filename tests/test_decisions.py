import pytest

from linkloom.operators import decide, metrics, policy, sample, validate


@pytest.mark.parametrize(("t", "p", "h", "f"), [(0, 0, 0, 1.0), (0, 2, 0, 0.0), (3, 0, 0, 0.0), (4, 2, 2, 0.833333), (1, 2, 1, 0.555556)])
def test_f05_edges(spark, t, p, h, f):
    from pyspark.sql import functions as F

    got = spark.range(1).select(metrics.f05(F.lit(t), F.lit(p), F.lit(h))).first()[0]
    assert round(got, 6) == f


def pairs(spark, rows):
    return spark.createDataFrame(rows, "rid bigint, s1 bigint, p double")


def test_assign_and_expected_f(spark):
    df = pairs(spark, [(1, 1, 0.6), (2, 2, 0.4), (2, 3, 0.4), (3, 4, 0.1)])
    assert sorted((r.rid, r.s1) for r in decide.assign(df).collect()) == [(1, 1), (2, 2), (3, 4)]
    kept = decide.select_expected_power(decide.assign(df)).collect()
    assert (1, 1) in {(r.rid, r.s1) for r in kept} and (3, 4) not in {(r.rid, r.s1) for r in kept}
    calib = decide.select_expected_calib(decide.assign(df), 1.0, 0.5).collect()
    assert {(r.rid, r.s1) for r in calib} == {(1, 1)}


def test_decisions_are_subsets_with_one_entity_per_record(spark):
    rows = [(r, s, ((r * 7 + s * 13) % 100) / 100) for r in range(40) for s in range(5)]
    df = pairs(spark, rows)
    for rule in decide.RULES[::4]:
        got = [(x.rid, x.s1) for x in decide.apply_rule(df, rule).collect()]
        assert len({r for r, _ in got}) == len(got)


def test_policy_and_cap(spark):
    nb = spark.createDataFrame([("z", 1, 1, 1, 0.9), ("z", 1, 2, 2, 0.88), ("z", 1, 3, 3, 0.5), ("z", 2, 1, 1, 0.95)], "view string, q bigint, s bigint, rank bigint, score double")
    assert {(r.q, r.s) for r in policy.view_policy(nb, {"z": (3, 0.05, -1.0)}).collect()} == {(1, 1), (1, 2), (2, 1)}
    assert {(r.q, r.s) for r in policy.hub_cap(nb, 1).where("s = 1").collect()} == {(2, 1)}
    truth = spark.createDataFrame([(1, 2), (2, 1)], "q bigint, s bigint")
    row = policy.policy_quality(spark.createDataFrame([(1,), (2,), (9,)], "s bigint"), truth, policy.pair_union(nb)).first()
    assert row.pair_recall == 1.0 and row.ceiling == 1.0 and row.cand_max == 2


def test_subworld_keeps_pairs_whole(spark):
    from pyspark.sql import functions as F

    ents = spark.range(0, 300).select(F.col("id").alias("k"))
    recs = spark.range(0, 900).select(F.col("id").alias("r"))
    truth = spark.range(0, 600).select((F.col("id") % 300).alias("s1"), F.col("id").alias("rid"))
    e, r, p = sample.subworld(ents, recs, truth, "k", "r", 10)
    assert e.count() == 30 and p.count() == 60 and r.count() == 60 + 30


def test_validator(spark):
    lists = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-1", "S1-3"), ("S1-9", "X-1")], "k string, l string")
    need = spark.createDataFrame([("S1-1",), ("S1-2",)], "k string")
    found = {r.rule: r.n for r in validate.list_findings(lists, need, "k", "l").collect()}
    assert found == {"duplicate row": 1, "duplicate id in list": 1, "entity in list": 1, "bad prefix": 1, "missing entity": 1, "extra entity": 1}
