import math
import time
from collections import Counter, defaultdict

import duckdb
import pytest

from linkloom.llm import exact_dedup, licenses, url_filter

SCHEMA = "doc_id bigint, text string, lang string, source string, _id string"
ROWS = [(1, "Abc", "en", "s", "x"), (2, "aBC", "en", "s", "x"), (3, None, None, None, None), (4, "", "en", "s", "x"), (5, "É", "fr", "s", "x"), (6, "é", "fr", "s", "x"), (7, "abc" * 20000, "en", "s", "x"), (7, "abc" * 20000, "en", "s", "x")]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("ranges", [1, 3, 7])
def test_exact_dedup(spark, ranges):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.content_sort(docs(spark), keep="largest", ranges=ranges).collect()}
    assert got == {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, True)}


def test_exact_dedup_spreads_a_hot_group(spark):
    rows = [(i, "same" if i % 3 else f"own {i}", "en", "s", "x") for i in range(600)]
    got = exact_dedup.content_sort(docs(spark, rows), ranges=8).where("group_size > 1").collect()
    assert len(got) == 400 and {r.keep_id for r in got} == {1} and {r.group_size for r in got} == {400}


def test_empty_tables(spark):
    assert exact_dedup.content_sort(docs(spark, [])).count() == 0
    assert licenses.scan_licences(docs(spark, [])).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0


def test_licences_against_sql(spark):
    by_name = {}
    for name, text in licenses.TEMPLATES:
        by_name.setdefault(name, []).append(text)
    prose = "some words of the text that are in no way part of a license or under the terms of it "
    bodies = {name: texts[-1] for name, texts in by_name.items()}
    texts = [
        "x\nReleased under the MIT License.\ny z", "licensed under   CC BY-NC 4.0", None, "Licensed under the Apache\nLicense, Version 2.0.", "word " * 30000, "",
        prose + "This work is licensed under the GNU\nGeneral Public License, version 3. " + prose, "released under the MIT license. " * 30, "Released under the MIT License.\n" * 25,
        prose * 3 + bodies["MIT"].replace(" ", "\n", 40) + prose, prose + bodies["BSD-2-Clause"].replace("BINARY", "OTHER").replace("DAMAGES", "HARM") + prose, bodies["BSD-3-Clause"].upper(),
        bodies["GPL-2.0"], prose + bodies["GPL-3.0"] + prose + by_name["GPL-2.0"][0], bodies["Apache-2.0"] + bodies["ISC"], "This license was released under pressure. MIT is a school.", "license",
        "Dedicated to the public domain under CC0 1.0, released under MIT License", " ".join(t for _, t in licenses.TEMPLATES),
    ]
    rows = [(i, t, "", "", "") for i, t in enumerate(texts)] + [(0, "Released under the MIT license", "", "", ""), (0, texts[0], "", "", ""), (None, texts[1], "", "", "")]
    got = {(r.doc_id, r.licence, r.dice, r.first_word, r.n_words) for r in licenses.scan_licences(docs(spark, rows)).collect()}
    frame = docs(spark, rows).toPandas().astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", frame)
    want = {tuple(r) for r in con.execute(licenses.ORACLE).fetchall()}
    assert got == want
    found = {(i, name): d for i, name, d, _, _ in got}
    assert found[0, "MIT"] == found[3, "Apache-2.0"] == found[6, "GPL-3.0"] == found[7, "MIT"] == found[8, "MIT"] == found[9, "MIT"] == found[11, "BSD-3-Clause"] == 1.0
    assert found[12, "GPL-2.0"] == found[13, "GPL-3.0"] == found[13, "GPL-2.0"] == found[14, "ISC"] == 1.0 and (12, "GPL-3.0") not in found
    assert 0.8 <= found[10, "BSD-2-Clause"] < 1 and not {2, 4, 5, 15, 16} & {i for i, _ in found} and (None, "CC-BY-NC-4.0") in found


def test_licence_triggers_are_needed():
    """Whatever bigrams a stretch at the threshold lacks, it holds a trigger."""
    for i, (name, text) in enumerate(licenses.TEMPLATES):
        t = licenses.Template(i, name, text, licenses.THRESHOLD)
        assert t.size - t.covered() < t.shared


def model_scores(urls, labels, order):
    """Interpolated Markov models counted in plain Python."""
    n = {c: defaultdict(Counter) for c in "ab"}
    pad = lambda u: "\x02" * order + u + "\x03"
    for u, c in labels:
        p = pad(u)
        for i in range(order, len(p)):
            for k in range(order + 1):
                n[c][p[i - k : i]][p[i]] += 1

    def logp(c, p, i):
        q = 1 / url_filter.ALPHABET
        for k in range(order + 1):
            seen = n[c].get(p[i - k : i])
            if seen:
                total, kinds = sum(seen.values()), len(seen)
                q = (seen[p[i]] + kinds * q) / (total + kinds)
        return math.log(q)

    out = {}
    for u in urls:
        p = pad(u)
        out[u] = sum(logp("a", p, i) - logp("b", p, i) for i in range(order, len(p))) / (len(p) - order)
    return out


def test_url_filter_against_plain_models(spark):
    urls = ["http://a.com/x", "https://www.example.com/en/1", "http://b.example.com/en/2?x", "http://c.net/es/q", "http://d.org/en/", None, "no scheme", "HTTP://UP.COM/", "http://x.com", "http://e.net/fr/" + "z" * 300]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert [got[i].rule for i in range(10)] == ["com/", "www.example.com/en/", "example.com/en/", "net/es/", None, None, None, "com/", None, "net/fr/"]
    assert (got[5].host, got[5].path, got[7].host, got[7].path) == ("", "", "up.com", "/")
    low = [(u or "").lower() for u in urls]
    labels = [(u, "a" if got[i].verdict == "allow" else "b") for i, u in enumerate(low) if got[i].rule]
    want = model_scores(low, labels, url_filter.ORDER)
    for i, u in enumerate(low):
        assert abs(got[i].score - want[u]) < 1e-6
        assert got[i].verdict == ("allow" if got[i].score >= got[i].threshold else "block") or got[i].rule


def test_url_rules(spark):
    from pyspark.sql import functions as F

    host, path = url_filter.url_parts(F.col("u"))
    df = spark.createDataFrame([("a://H.x/p?q#f",), ("http://notexample.com/en/a",)], "u string")
    rule, verdict = url_filter.match_rules(F.col("h"), F.col("p"), url_filter.RULES)
    got = df.select(host.alias("h"), path.alias("p")).select("h", "p", rule.alias("r"), verdict.alias("v")).collect()
    assert tuple(got[0]) == ("h.x", "/p", None, None) and tuple(got[1]) == ("notexample.com", "/en/a", "com/", "allow")


def test_url_filter_without_labelled_urls(spark):
    """Tables that no rule fits keep all rows, at score and threshold 0."""
    for urls in ([None, None], ["http://d.org/en/", None, "no scheme", "", "http://d.org/en/"]):
        got = url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")).collect()
        assert sorted(r.page_id for r in got) == list(range(len(urls)))
        assert {(r.rule, r.verdict, r.score, r.threshold) for r in got} == {(None, "allow", 0.0, 0.0)}


def test_url_filter_long_urls_other_columns_and_ties(spark):
    """A very long URL costs in proportion to its length; columns of any name stay out of the way; equal URLs get equal answers."""
    long = "http://long.org/" + "ab/" * 20_000
    rows = [(1, long, "u", 1.0), (2, "http://a.com/x", "text", None), (3, "http://c.net/fr/q", "gram", 2.0), (4, "http://q.org/", None, 3.0), (4, "http://q.org/", None, 3.0), (None, "http://Q.org/", "", 0.0), (6, "http://c.net/FR/q", "", 0.0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, text string, score double")
    began = time.time()
    got = url_filter.filter_urls(df).collect()
    assert time.time() - began < 60 and len(got) == len(rows)
    same = {(r.score, r.verdict) for r in got if r.host == "q.org"}
    assert len(same) == 1
    low, up = (next(r for r in got if r.page_id == i) for i in (3, 6))
    assert (low.rule, up.rule, low.score) == ("net/fr/", None, up.score)
    want = model_scores([long], [("http://a.com/x", "a"), ("http://c.net/fr/q", "b")], url_filter.ORDER)
    assert abs(next(r.score for r in got if r.page_id == 1) - want[long]) < 1e-6
