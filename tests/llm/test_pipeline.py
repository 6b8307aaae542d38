"""Pipeline against plain expectations, and held-out accuracy of the classifier."""

import os
import re

import pytest

import corpus_pipeline
from linkloom.llm import quality, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == first.columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] == sizes[-2]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_stages_against_plain_rules(spark):
    """Exact dedup, near-dedup and substring dedup of the pipeline against plain Python on the driver's documents."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect())
    low = lambda t: t.translate({c: c + 32 for c in range(65, 91)})
    first = {}
    for i, t in rows:
        first.setdefault(low(t), i)
    got = {r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()}
    assert got == set(first.values())

    sets, up = {}, {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", low(t))
        sets[i], up[i] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set(), i
    held = {}
    for i, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(i)

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a, b in {(a, b) for ids in held.values() for a in ids for b in ids if a < b}:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    assert got == {i for i in up if root(i) == i}

    after = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, SF).collect()}
    seen, clean = set(), 0
    for i, t in rows:  # no 50-word window of a cut text comes again, and texts without repeats stay as they are
        w = low(after[i]).split()
        own = {tuple(w[j : j + 50]) for j in range(len(w) - 49)}
        assert not own & seen
        seen |= own
        clean += after[i] == t
    assert clean > len(rows) / 2


def test_rows_are_judged_by_id_and_text(spark):
    """Null ids stay, ids that repeat are judged by text, equal rows and copies under one id go; clashing columns come along."""
    good = [" ".join(f"word{chr(97 + (7 * i + k) % 26)}{chr(97 + i % 26)}{chr(97 + (i + k) % 23)}" for k in range(80)).capitalize() + "." for i in range(24)]
    bad = " ".join("zz$$$" for _ in range(80))
    rows = [(i, g, "en") for i, g in enumerate(good)] + [(0, bad, "en"), (None, good[3] + " Once more with a tail that differs enough " + good[4][:200], "x"), (5, good[5], "en"), (6, good[6].upper(), "en"), (40, good[7], "en"), (41, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _id string")
    kept = corpus_pipeline.keep_good(spark, docs, "")
    assert kept.columns == docs.columns and kept.where("doc_id is null").count() == 1
    assert [r.text for r in kept.where("doc_id = 0").collect()] == [good[0]]
    once = corpus_pipeline.drop_copies(spark, docs, "")
    assert once.columns == docs.columns and sorted(r.doc_id for r in once.collect() if r.doc_id is not None) == sorted([*range(24), 0, 41])
    near = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r.doc_id for r in near if r.doc_id is not None) == sorted([*range(24), 0, 41])


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_classifier_on_held_out_labels(spark):
    got = quality.classify(spark.read.parquet(f"{SF}/documents.parquet")).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    assert (got["keep"] == (got["quality"] == 1)).mean() > 0.95
    assert got.loc[got["quality"] == 1, "keep"].mean() > 0.98


def test_names():
    assert sorted({int(n[2:].split("_")[0]) for n in registry.QUERIES}) == list(range(1, 11))
    assert set(registry.ORACLES) <= set(registry.QUERIES)
