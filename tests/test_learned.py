"""Rules, policies and encoder against plain Python, on small inputs."""

import itertools
import random

import numpy as np
import pytest

from linkloom.operators import compete, decide, metrics, models, policy
from linkloom.operators.encoder import Encoder


def scored_world(spark):
    rnd = random.Random(3)
    pairs = [(f"r{r}", f"e{e}", round(rnd.random(), 3)) for r in range(60) for e in rnd.sample(range(25), 3)]
    truth = [(r, s) for r, s, p in pairs if rnd.random() < p * 0.6]
    ents = spark.createDataFrame([(f"e{i}",) for i in range(25)], "s1 string")
    return spark.createDataFrame(pairs, "rid string, s1 string, p double").cache(), spark.createDataFrame(truth, "rid string, s1 string").cache(), ents.cache()


def test_rules_in_one_pass(spark):
    scored, truth, ents = scored_world(spark)
    got = {r.rule_no: r.macro_f05 for r in metrics.tune_rules(ents, truth, scored).collect()}
    assert sorted(got) == list(range(len(decide.RULES)))
    for i in (0, 3, 6, 7, 10, 15, 21):
        alone = metrics.summary(metrics.per_entity(ents, truth, decide.apply_rule(scored, decide.RULES[i]))).first().macro_f05
        assert got[i] == pytest.approx(alone)
    rule, best = metrics.best_rule(ents, truth, scored)
    assert best == pytest.approx(max(got.values())) and rule == decide.RULES[max(got, key=lambda i: (round(got[i], 12), -i))]
    weight, _, f = models.best_blend(scored.withColumn("q", 1 - scored.p), "p", "q", ents, truth, (0.0, 1.0))
    assert weight == 1.0 and f == pytest.approx(best)


def test_policies_in_one_pass(spark):
    rnd = random.Random(5)
    nb = []
    for q in range(40):
        scores = sorted((round(rnd.random(), 3) for _ in range(6)), reverse=True)
        nb += [("z", q, s, i + 1, x) for i, (s, x) in enumerate(zip(rnd.sample(range(12), 6), scores, strict=True))]
    truth = [(q, s) for _, q, s, r, _ in nb if rnd.random() < 0.5 / r]
    frame = spark.createDataFrame(nb, "view string, q long, s long, rank long, score double").cache()
    known, ents = spark.createDataFrame(truth, "q long, s long").cache(), spark.createDataFrame([(i,) for i in range(15)], "s long").cache()
    grid = {"k": (2, 5), "margin": (0.1, 0.5), "floor": (-1.0, 0.6), "cap": (2, 50)}
    got = {(r.k, r.margin, r.floor): r for r in policy.sweep(frame, ents, known, "z", grid).collect()}
    assert set(got) == set(itertools.product(grid["k"], grid["margin"], grid["floor"]))
    for rule in ((2, 0.1, -1.0), (5, 0.5, 0.6)):
        alone = policy.policy_quality(ents, known, policy.pair_union(policy.view_policy(frame, {"z": rule}))).first()
        assert all(alone[c] == pytest.approx(got[rule][c]) for c in alone.asDict())
    rule, cap = policy.choose(frame, ents, known, "z", grid=grid)
    top = max(r.ceiling for r in got.values())
    assert got[rule].n_pairs == min(r.n_pairs for r in got.values() if r.ceiling >= top - 0.0005) and cap in (2, 50, None)


def test_view_columns(spark):
    pairs = spark.createDataFrame([("r", "a", 0.9), ("r", "b", 0.7), ("r", "c", 0.1), ("x", "a", 0.4)], "rid string, s1 string, z_cos double")
    nb = spark.createDataFrame([("z", "r", "a", 1, 0.9), ("z", "r", "b", 2, 0.7)], "view string, q string, s string, rank long, score double")
    got = {(r.rid, r.s1): [round(r[f"z_{c}"], 6) for c in ("rank", "top1", "gap1", "margin12", "vs2")] for r in compete.view_columns(pairs, nb, ["z"], 5).collect()}
    assert got == {("r", "a"): [1, 0.9, 0, 0.2, 0.2], ("r", "b"): [2, 0.9, 0.2, 0.2, -0.2], ("r", "c"): [6, 0.9, 0.8, 0.2, -0.8], ("x", "a"): [6, -1, -1.4, 0, 1.4]}


def test_net_and_area(spark):
    rows = [(i, float(i % 7), None if i % 11 == 0 else float(i % 5), int(i % 7 > 3), i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "rid long, a double, b double, label int, fold int").cache()
    done, _ = models.cross_validated(df, lambda: models.Matcher(("a", "b"), kind="net", rounds=30), 2, df.label >= 0)
    assert done.count() == 200 and models.area(done, "p") > 0.95 and models.area(done, "p", "areaUnderROC") > 0.95


def test_encoder_learns():
    rnd = random.Random(1)
    words = "amber birch cedar delta ember falcon granite harbor".split()
    left = [f"{rnd.choice(words)} {rnd.choice(words)} {i * 37 % 1009}" for i in range(150)]
    right = [t.replace("e", "3", 1) + " group holding inc" for t in left]
    at_one = lambda e: (np.argmax(e.encode(right) @ e.encode(left).T, axis=1) == np.arange(150)).mean()
    encoder = Encoder(32)
    before = at_one(encoder)
    losses = encoder.fit(left, right, owner=left, group=[i % 2 for i in range(150)], wrong=[*left[1:], ""], epochs=4)
    assert losses[-1] < losses[0] and at_one(encoder) > before and np.isfinite(encoder.weights).all()
    assert not encoder.encode([""]).any() and Encoder(32).fit([], [], epochs=1) == [0.0]
    one = Encoder(32)
    alone = np.concatenate([one.encode([t]) for t in ["", *left[:3], "x" * 200_000]])
    assert np.allclose(one.encode(["", *left[:3], "x" * 200_000]), alone)
