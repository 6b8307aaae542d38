"""End to end on a synthetic world with known truth."""

import random

import pytest
from pyspark.sql import functions as F

from linkloom.plans import linkage

FIRST = "amber birch cedar delta ember falcon granite harbor indigo jasper keystone lumen maple nova orchid pioneer quartz raven summit timber".split()
SECOND = "bakery carpets dental equipment foods garage hotels imports jewels kitchens labs motors nursery optics press".split()


def world(spark, n=60):
    rnd, raw, truth = random.Random(4), {"1": [], "2": [], "3": []}, []
    for i in range(n):
        name = f"{FIRST[i % 20]} {SECOND[(i * 7) % 15]} {'Inc' if i % 2 else 'LLC'}"
        addr = f"{100 + i * 7} {rnd.choice(FIRST)} St, {rnd.choice(['TX', 'CA'])}, {75000 + i}"
        raw["1"].append((f"S1-{i}", name.title(), addr, "US" if i % 3 else "India"))
        for src in ("2", "3"):
            if rnd.random() < 0.7:
                noisy = name.upper() if rnd.random() < 0.5 else name.replace("e", "3", 1) + " Group"
                raw[src].append((f"S{src}-{i}", noisy, addr.replace("St", "Street") if rnd.random() < 0.7 else "", "US" if i % 3 else "India"))
                truth.append((f"S1-{i}", f"S{src}-{i}"))
    for j in range(10):
        raw["2"].append((f"S2-{900 + j}", f"{rnd.choice(SECOND)} {rnd.choice(SECOND)} Co", f"{j} elm rd", "US"))
    schema = "entity_id string, business_name string, business_address string, country string"
    return {k: spark.createDataFrame(v, schema) for k, v in raw.items()}, spark.createDataFrame(truth, "s1 string, rid string")


GRID = {"k": (3, 5), "margin": (0.2,), "floor": (-1.0,), "cap": (15, 20)}


@pytest.mark.parametrize("line", ["a", "b"])
def test_line(spark, line):
    sources, truth = world(spark)
    result = linkage.run_line_a(sources, truth, k=5, rounds=4) if line == "a" else linkage.run_line_b(sources, truth, k=5, rounds=3, folds=2, dims=32, grid=GRID)
    result["scored"] = result["scored"].cache()
    matches = result["matches"].cache()
    assert matches.groupBy("rid").count().where("count > 1").count() == 0
    assert matches.join(result["candidates"], ["s1", "rid"], "left_anti").count() == 0
    row = linkage.evaluate(result | {"matches": matches}, truth).first()
    assert row.n_entities == 60 and row.macro_f05 > 0.6
    lists, _ = linkage.lists(result | {"matches": matches})
    assert lists.count() == 60 and lists.where(F.col("matched_entity_ids").isNull()).count() == 0
    told = result["report"].first()
    if line == "a":
        assert 0.3 <= told.threshold <= 1 and 0 <= told.macro_f05 <= 1 and told.n_entities < 60
    else:
        assert told.stacked == (told.second > told.first) and told.trees >= 1
        assert len(linkage.models.feature_columns(result["features"])) == 118 + 1  # and the split
        model = linkage.refitted(result, told.trees)
        assert model.trees() <= told.trees and len(model.importance()) == 118
