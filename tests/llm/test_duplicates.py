import random
import re

import numpy as np
import pytest

from linkloom.llm import near_dedup, passages, quality, repeats
from linkloom.llm.common import Cuts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(n, seed):
    rnd = random.Random(seed)
    return ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 7))) for _ in range(n)]


def world():
    base, rows = words(120, 1), []
    for i in range(30):
        w = base[:]
        rnd = random.Random(i)
        for _ in range(rnd.randint(0, 6)):
            w[rnd.randrange(len(w))] = f"edit{i}{rnd.randrange(99)}"
        rows.append((100 + i, " ".join(w)))
    rows += [(200 + i, " ".join(words(80, 50 + i))) for i in range(10)]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one two"), (304, "ONE  two"), (305, "one two three"), (100, rows[0][1]), (400, " ".join(words(9000, 9)))]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, row string")


def brute_components(rows, k=5):
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(LOW))
        sets.setdefault(i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    up = {i: i for i in sets}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize("small", [24, 1])
def test_near_dedup_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_dedup, "SMALL", small)
    rows = world()
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark, rows)).collect()}
    assert got == {(i, n, c, i == c) for i, (n, c) in brute_components(rows).items()}


def test_blocks_find_links(spark, monkeypatch):
    """With every node its own component, the block comparison alone finds all links between components."""
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 40)
    sets = {1: range(0, 40), 2: range(0, 38), 3: range(100, 140), 4: range(2, 40), 5: range(101, 141)}
    spark_sets = spark.createDataFrame([(k, list(v)) for k, v in sets.items()], "node bigint, shingles array<bigint>")
    large = spark.createDataFrame([(k, len(v), k, 1) for k, v in sets.items()], "node bigint, n bigint, label bigint, low bigint")
    got = {tuple(sorted((r.a, r.b))) for r in near_dedup._families(Cuts(spark, "t"), large, spark_sets, 75).collect()}
    assert got == {(1, 2), (1, 4), (2, 4), (3, 5)}


def test_near_dedup_with_ids_that_repeat(spark):
    """Each row is judged by its own text, whatever its id; a null id is nobody's smallest."""
    a, b, c = " ".join(words(60, 71)), " ".join(words(60, 72)), " ".join(words(60, 73))
    rows = [(5, a), (5, b), (7, a + " tail"), (9, b + " tail"), (None, c), (11, c + " tail"), (None, "alone here"), (5, b)]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_dedup(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(5, 5, True), (5, 5, True), (5, 5, True), (7, 5, False), (9, 5, False), (None, 11, False), (11, 11, True), (None, None, True)], key=str)


def test_near_dedup_empty(spark):
    assert near_dedup.near_dedup(frame(spark, [])).count() == 0
    assert near_dedup.near_dedup(frame(spark, [(1, None)])).first().component_id == 1


def brute_repeats(rows, n=200):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = {}
    for _, b in data:
        for j in range(len(b) - n + 1):
            count[b[j : j + n]] = count.get(b[j : j + n], 0) + 1
    out = []
    for i, b in data:
        mark = np.zeros(len(b), bool)
        for j in range(len(b) - n + 1):
            if count[b[j : j + n]] > 1:
                mark[j : j + n] = True
        out.append((i, len(b), int(mark.sum()), int((mark & ~np.r_[False, mark[:-1]]).sum()) if len(b) else 0, np.frombuffer(b, np.uint8)[~mark].tobytes()))
    return sorted(out)


def test_repeats_against_brute_force(spark):
    p = " ".join(words(60, 3))
    q = " ".join(words(45, 4))
    rows = [(1, p + " tail one"), (2, "head " + p), (3, q), (4, "x" * 1500), (5, None), (6, ""), (7, "x" * 150), (8, q[:199]), (9, q[1:240] + "é" + q[:230]), (10, p[:150] + "#" + p[151:]), (3, q), (11, "ab" * 400), (12, " ".join(words(900, 8)) + p[20:290])]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(frame(spark, rows)).collect())
    assert got == brute_repeats(rows)
    assert repeats.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("length", [12, 50, 333])
def test_repeats_of_other_lengths(spark, length):
    p = " ".join(words(120, 31))
    rows = [(1, p + " tail"), (2, "head " + p[:140] + " other"), (3, p[5 : 5 + length]), (3, p[6 : 5 + length]), (4, "z" * (length + 3)), (5, " ".join(words(60, 32)))]
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in repeats.remove_repeats(frame(spark, rows), length=length).collect())
    assert got == brute_repeats(rows, length)


def test_passages(spark):
    p = words(70, 5)
    fuzzy = p[:]
    fuzzy[30] = "changed"
    del fuzzy[50]
    rows = [(1, " ".join(words(40, 6) + p + words(30, 7))), (2, " ".join(words(90, 8) + p)), (3, " ".join(fuzzy + words(60, 9))), (4, " ".join(words(200, 10))), (5, " ".join(words(100, 12) + p[:30])), (6, None), (7, ""), (8, "short")]
    got = passages.find_passages(frame(spark, rows)).collect()
    assert {r.doc_id for r in got} == {2, 3} and {r.other_id for r in got} == {1}
    two = next(r for r in got if r.doc_id == 2)
    assert (two.start_word, two.end_word, two.other_start, two.other_end) == (90, 160, 40, 110)
    cut = {r.doc_id: r for r in passages.cut_passages(frame(spark, rows)).collect()}
    assert len(cut) == len(rows) and cut[2].text.strip() == " ".join(words(90, 8)) and cut[1].text == rows[0][1] and cut[6].text is None and cut[2].row == "x"
    assert passages.find_passages(frame(spark, [])).count() == 0


def test_chain_orders_matches():
    pos, other = np.array([0, 10, 20, 30, 12]), np.array([100, 110, 121, 130, 500])
    best = passages.chain(pos, other)[0]
    assert best == [0, 1, 2, 3]


def test_quality(spark):
    good = [(i, " ".join(words(60, i)).capitalize() + ".") for i in range(40)]
    bad = [(100 + i, " ".join(w + "$$$" for w in words(60, i))) for i in range(8)] + [(110 + i, " | ".join(words(60, i))) for i in range(8)]
    rows = [*good, *bad, (200, None), (201, "  "), (202, "tiny text"), (203, " ".join(words(40000, 77)))]
    got = {r.doc_id: r for r in quality.classify(frame(spark, rows)).collect()}
    assert all(got[i].keep for i, _ in good) and not any(got[i].keep for i, _ in bad)
    assert not got[200].keep and not got[201].keep and got[202].keep and got[203].keep
    assert quality.classify(frame(spark, [])).count() == 0


def test_quality_sample_stays_off_the_driver(spark):
    """The scorer is fitted where its sample lies: 400 rows of 8 KB each pass a driver that takes 1 MB of results."""
    texts = [" ".join(words(60, i)).capitalize() + "." for i in range(320)] + [" ".join(w + "$$$" for w in words(60, i)) for i in range(80)]
    docs = frame(spark, list(enumerate(texts)))
    conf = spark.sparkContext._jsc.sc().conf()
    most = conf.get("spark.driver.maxResultSize", "1g")
    conf.set("spark.driver.maxResultSize", "1m")
    try:
        judge = quality.learn(docs)
    finally:
        conf.set("spark.driver.maxResultSize", most)
    raw = [t.encode() for t in texts]
    x = np.zeros((len(raw), 2 * quality.BINS + quality.LEVELS), np.float16)
    for i, t in enumerate(raw):
        at, weight = quality.features(t)
        x[i, at] = weight
    plain = quality.fit_scorer(x.astype(np.float64), judge.labels(quality.votes(raw)))
    assert np.allclose(judge.weights, plain, atol=1e-6)


def test_labellers_learn_their_accuracy():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    right = rng.random((4000, 4)) < np.array([0.95, 0.9, 0.8, 0.6])
    vote = np.where(right == truth[:, None], quality.ACCEPT, quality.REJECT)
    patterns, counts = np.unique(vote, axis=0, return_counts=True)
    good, accuracy = quality.fit_labellers(patterns, counts.astype(float))
    assert abs(good - 0.7) < 0.05 and accuracy[0].min() > accuracy[3].max()


def test_passages_composed_of_earlier_parts(spark):
    """A long repeat is found though its parts come first, or last before it, from different documents."""
    a, b = words(30, 21), words(30, 22)
    texts = {1: a, 2: b, 5: a + b, 6: a, 7: b, 9: a + b}
    rows = [(i, " ".join(words(40, 300 + i) + t + words(40, 400 + i))) for i, t in texts.items()]
    got = passages.find_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(9, 5)} and all((r.start_word, r.end_word) == (40, 100) for r in got)


def test_passages_with_even_substitutions(spark):
    """Of 50-word passages with every fifth word changed, none is lost."""
    rows = []
    for i in range(40):
        p = words(50, 500 + i)
        q = [f"other{i}x{j}" if j % 5 == 2 else w for j, w in enumerate(p)]
        rows += [(2 * i, " ".join(words(60, 600 + i) + p + words(60, 700 + i))), (2 * i + 1, " ".join(words(60, 800 + i) + q + words(60, 900 + i)))]
    got = passages.find_passages(frame(spark, rows)).collect()
    assert {(r.doc_id, r.other_id) for r in got} == {(2 * i + 1, 2 * i) for i in range(40)}
