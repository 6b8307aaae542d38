"""Pairs of parts against SQL, by both ways to measure them, and how many rows their joins make."""

import math
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from linkloom.operators import bands, near_texts, retrieve
from linkloom.plans import catalogue
from test_queries import rows

COLUMNS = "p_partkey long, p_name string, p_brand string, p_type string, p_size int"


@pytest.fixture(scope="module")
def parts(tmp_path_factory):
    """Few names, nulls, an empty name, and a group with many rows of one size."""
    words = ["red", "hot", "old", "co", "ltd"]
    made = [(i, f"{words[i % 5]} {words[i * 7 % 3]}", f"B{i % 3}", f"T {i % 2}", i * 5 % 17) for i in range(600)]
    made += [(1000 + i, words[i % 4], "B9", "T 9", 4) for i in range(120)]
    made += [(2000, None, "B9", "T 9", 5), (2001, None, "B9", "T 9", 5), (2002, "", "B9", "T 9", 3), (2003, "red", None, "T 9", 4), (2004, "red", "B9", "T 9", None)]
    return written(tmp_path_factory.mktemp("parts"), made)


@pytest.fixture(scope="module")
def named(tmp_path_factory):
    """As ``parts``, but with a name in every row."""
    made = [(i, f"{'red hot old co ltd'.split()[i % 5]} {'iron hot red'.split()[i * 7 % 3]}", f"B{i % 3}" if i % 41 else None, f"T {i % 2}", i * 5 % 17 if i % 37 else None) for i in range(600)]
    return written(tmp_path_factory.mktemp("named"), made)


def written(sf, made):
    frame = pd.DataFrame(made, columns=["p_partkey", "p_name", "p_brand", "p_type", "p_size"]).astype({"p_size": "Int32"})
    frame.to_parquet(sf / "part.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{sf}/part.parquet')")
    return str(sf), con


def equals_sql(spark, named, name):
    sf, con = named
    assert rows(catalogue.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(catalogue.ORACLES[name]).df())


def joins_by_size(frame):
    """The pairs meet by size as well: no join of whole groups, whose pairs are mostly thrown away."""
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    return "explode(sequence" in plan and not re.search(r"abs\(+p_size", plan)


def test_blocks_hold_every_pair_once(spark, parts, monkeypatch):
    sf, con = parts
    monkeypatch.setattr(bands, "BLOCK", 16)
    found = bands.band_pairs(spark.read.parquet(f"{sf}/part.parquet"), "p_partkey", ("p_brand", "p_type"), "p_size", 2, {"n1": F.col("p_name")}, {}).select("q", "s").toPandas()
    want = con.execute("SELECT a.p_partkey AS q, b.p_partkey AS s FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 2").df()
    assert rows(found) == rows(want)


@pytest.mark.parametrize("most", [0, bands.LOOKED_UP])
def test_both_ways_to_measure(spark, parts, most):
    sf, con = parts
    seen = bands.text_pairs(
        spark.read.parquet(f"{sf}/part.parquet"), "p_partkey", ("p_brand", "p_type"), "p_size", 2, {"n1": F.col("p_name")}, {"n2": F.col("p_name")},
        lambda pairs: pairs.withColumn("v", F.concat_ws("|", "n1", "n2")), most,
    ).select("q", "s", "v").toPandas()
    want = con.execute("SELECT a.p_partkey AS q, b.p_partkey AS s, concat_ws('|', a.p_name, b.p_name) AS v FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 2").df()
    assert rows(seen) == rows(want)


def test_alias_best(spark):
    assert joins_by_size(catalogue.QUERIES["alias_best"](spark, "/root/testdata/sf0.001"))


def test_token_cover_miss(spark, named):
    assert joins_by_size(catalogue.QUERIES["token_cover_miss"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "token_cover_miss")


def test_partial_ratio(spark, named):
    assert joins_by_size(catalogue.QUERIES["partial_ratio"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "partial_ratio")


def test_exact_flags(spark, named):
    assert joins_by_size(catalogue.QUERIES["exact_flags"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "exact_flags")


def test_acronym_match(spark, named):
    assert joins_by_size(catalogue.QUERIES["acronym_match"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "acronym_match")


def test_indel_ratio_pairs(spark, named):
    assert joins_by_size(catalogue.QUERIES["indel_ratio_pairs"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "indel_ratio_pairs")


def test_legal_overlap(spark, named):
    assert joins_by_size(catalogue.QUERIES["legal_overlap"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "legal_overlap")


def test_number_features(spark, named):
    assert joins_by_size(catalogue.QUERIES["number_features"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "number_features")


def test_similarity_bins_crosstab(spark, named):
    assert joins_by_size(catalogue.QUERIES["similarity_bins_crosstab"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "similarity_bins_crosstab")


def test_token_set_ratio(spark, named):
    assert joins_by_size(catalogue.QUERIES["token_set_ratio"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "token_set_ratio")


def test_token_jaccard(spark, named):
    assert joins_by_size(catalogue.QUERIES["token_jaccard"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "token_jaccard")


def test_token_miss(spark, named):
    assert joins_by_size(catalogue.QUERIES["token_miss"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "token_miss")


def test_token_sort_ratio(spark, named):
    assert joins_by_size(catalogue.QUERIES["token_sort_ratio"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, named, "token_sort_ratio")


@pytest.mark.parametrize("names", ["parts", "named"])
def test_s1_exact_name_count(spark, request, names):
    assert " Join " not in catalogue.QUERIES["s1_exact_name_count"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    sf, con = request.getfixturevalue(names)
    found = catalogue.QUERIES["s1_exact_name_count"](spark, sf).select("q", "n_exact", "n_cand", "n_names").collect()
    want = con.execute(f"SELECT q, n_exact, n_cand, n_names FROM ({catalogue.ORACLES['s1_exact_name_count']})").fetchall()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


@pytest.mark.parametrize("names", ["parts", "named"])
def test_pair_tfidf_cosine(spark, request, names):
    assert joins_by_size(catalogue.QUERIES["pair_tfidf_cosine"](spark, "/root/testdata/sf0.001"))
    equals_sql(spark, request.getfixturevalue(names), "pair_tfidf_cosine")


@pytest.mark.parametrize("names", ["parts", "named"])
def test_tfidf_two_part_score(spark, request, names, monkeypatch):
    """Products are summed over distinct texts, not over the parts that repeat them."""
    sf, con = request.getfixturevalue(names)
    seen, combine = [], retrieve.combine_parts
    monkeypatch.setattr(retrieve, "combine_parts", lambda parts: seen.append(combine(parts)) or seen[-1])
    equals_sql(spark, (sf, con), "tfidf_two_part_score")
    texts = con.execute("SELECT count(*) FROM (SELECT DISTINCT p_brand, p_name, p_type FROM part)").fetchall()[0][0]
    assert all(w.select("block", "key").distinct().count() <= texts for w in seen)


def test_doc_neardup_topk_keeps_terms_in_place(spark, monkeypatch):
    """No table has a row for each term of each text, and a block's name may be a word of another block."""
    monkeypatch.setattr(retrieve, "term_counts", None)
    texts = [("en", 1, "de en fr x y z"), ("en", 2, "de en fr x y w"), ("de", 3, "en de en de q"), ("de", 4, "en de en de q r"), ("fr", 5, "z"), (None, 6, "z")]
    frame = spark.createDataFrame(texts, "block string, key long, words string")
    found = near_texts.near_texts(frame, 3, 0.3).select("block", "q", "s", "score").collect()

    def vector(block, words):
        mine = lambda t: Counter(t.split() + [f"{a} {b}" for a, b in zip(t.split(), t.split()[1:])])
        others = [mine(t) for b, _, t in texts if b == block]
        x = {g: math.log1p(n) * (math.log((1 + len(others)) / (1 + sum(g in o for o in others))) + 1) for g, n in mine(words).items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / norm for g, v in x.items()}

    for block, q, s in (("en", 1, 2), ("de", 3, 4)):
        a, b = (vector(block, next(t for _, k, t in texts if k == key)) for key in (q, s))
        want = sum(v * b.get(g, 0) for g, v in a.items())
        assert sorted((r.q, r.s) for r in found if r.block == block) == [(q, s), (s, q)]
        assert all(abs(r.score - want) < 1e-9 for r in found if r.block == block)
    assert {r.block for r in found} == {"en", "de"}


def test_doc_neardup_topk_compares_like_texts_in_cells(spark, monkeypatch):
    """Texts chained by shared words are no group that grows with the input: what cannot reach the threshold never meets, and a
    group of truly like texts is cut into cells of bounded size, with each pair in one cell."""
    held = []
    cosines = near_texts._cosines
    monkeypatch.setattr(near_texts, "_cosines", lambda pairs, vectors: held.extend(r.asDict() for r in pairs.collect()) or cosines(pairs, vectors))
    monkeypatch.setattr(near_texts, "TERMS", 300, raising=False)
    monkeypatch.setattr(near_texts, "PAIRS", 200, raising=False)
    chained = [("en", i, " ".join(f"c{i + j // 4}x{j}" for j in range(8)) + f" d{i} d{i + 1}") for i in range(60)]
    like = [("en", 100 + i, "a b c d e f g h i j k l m n " + f"v{i % 7} w{i}") for i in range(30)]
    texts = chained + like
    found = near_texts.near_texts(spark.createDataFrame(texts, "block string, key long, words string"), 100, 0.6).collect()
    assert not any(r["q"] < 100 for r in held)
    groups = Counter(tuple(v for c, v in sorted(r.items()) if c not in ("block", "q", "s")) for r in held)
    assert len({(r["q"], r["s"]) for r in held}) == len(held) and max(groups.values()) < 0.5 * len(held)
    mine = {k: Counter(t.split() + [f"{a} {b}" for a, b in zip(t.split(), t.split()[1:])]) for _, k, t in texts}
    df = Counter(g for c in mine.values() for g in c)
    x = {k: {g: math.log1p(n) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, n in c.items()} for k, c in mine.items()}
    norm = {k: math.sqrt(sum(v * v for v in c.values())) for k, c in x.items()}
    want = {(q, s): sum(v * x[s].get(g, 0) for g, v in x[q].items()) / norm[q] / norm[s] for q in x for s in x if q != s}
    want = {p: v for p, v in want.items() if v >= 0.6}
    assert want and {(r.q, r.s) for r in found} == set(want)
    assert all(abs(r.score - want[r.q, r.s]) < 1e-9 for r in found)
