import pytest
from pyspark.sql import functions as F

from linkloom.operators import inspect, retrieve, sample
from linkloom.sources import transfer


def test_parts_hooks_and_readers(spark, tmp_path):
    made = []

    def make(k):
        return lambda: made.append(k) or spark.range(10).select("id", F.lit(k).alias("country"))

    parts = {k: make(k) for k in ("a", "b", "skipped")}
    post = lambda df: df.withColumn("twice", F.col("id") * 2)
    assert transfer.build_parts(spark, str(tmp_path), parts, post=post, skip=lambda n: n == "skipped", keep=F.col("id") < 4) == ["a", "b"]
    assert transfer.build_parts(spark, str(tmp_path), parts, skip=lambda n: n == "skipped") == [] and made == ["a", "b"]
    both = transfer.read_parts(spark, f"{tmp_path}/[ab]")
    assert both.count() == 8 and {r.twice for r in both.collect()} == {0, 2, 4, 6}
    one = transfer.read_part(spark, f"{tmp_path}/a", ["id"], country="a")
    assert one.columns == ["id"] and one.count() == 4 and transfer.read_part(spark, f"{tmp_path}/a", country="x").count() == 0
    assert len(transfer.list_parts(spark, f"{tmp_path}/*")) == 2
    with pytest.raises(FileNotFoundError):
        transfer.read_parts(spark, f"{tmp_path}/none*")


def test_mirror_fetch_and_progress(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "small.txt").write_text("x" * 10)
    (tmp_path / "src" / "deep" / "other.txt").write_text("y" * 20)
    (tmp_path / "src" / "large.bin").write_text("z" * 500)
    first = transfer.mirror(spark, str(tmp_path / "src"), str(tmp_path / "dst"), most=100)
    assert first == {"copied": ["deep/other.txt", "small.txt"], "same": [], "too_large": ["large.bin"]}
    assert transfer.mirror(spark, str(tmp_path / "src"), str(tmp_path / "dst"), most=100)["same"] == ["deep/other.txt", "small.txt"]
    assert (tmp_path / "dst" / "deep" / "other.txt").read_text() == "y" * 20
    assert transfer.fetch(spark, f"{tmp_path}/none", f"{tmp_path}/dst/small.txt").endswith("small.txt")
    p = transfer.Progress(spark, f"{tmp_path}/progress.json")
    p.note("pairs", 3, 12)
    assert p.read()["share"] == 0.25 and p.read()["stage"] == "pairs"


def test_reindex_is_dense(spark):
    rows = spark.createDataFrame([(k,) for k in (5, -7, 1000000, 12, 13)], "k bigint")
    assert {r.k: r.row for r in sample.reindexed(rows, "k").collect()} == {-7: 0, 5: 1, 12: 2, 13: 3, 1000000: 4}
    assert sample.reindexed(rows.limit(0), "k").count() == 0


def test_missed_records_name_where_they_went(spark):
    pairs = lambda rows: spark.createDataFrame(rows, "rid bigint, s1 bigint")
    scores = spark.createDataFrame([(1, 10, 0.3), (1, 11, 0.9), (2, 12, 0.2)], "rid bigint, s1 bigint, p double")
    got = inspect.missed_records(pairs([(1, 10), (2, 12), (3, 13), (4, 14)]), pairs([(1, 11), (4, 14)]), scores)
    assert {tuple(r) for r in got.collect()} == {(1, 10, 11, 0.9, 0.3), (2, 12, None, None, 0.2), (3, 13, None, None, None)}


def test_threshold_neighbours_against_all_pairs(spark):
    """The prefix join finds every pair at the threshold, near copies of frequent terms included."""
    texts = {i: " ".join(["common", "words", *(f"w{(i // 4) * 3 + j}" for j in range(5)), f"own{i}"]) for i in range(40)}
    df = spark.createDataFrame([(i, "b", t) for i, t in texts.items()], "k bigint, block string, x string")
    terms = retrieve.term_counts(df, "k", "block", F.split("x", " "))
    w = retrieve.weights(terms, retrieve.doc_freq(terms), df.groupBy("block").agg(F.count(F.lit(1)).alias("n")))
    for least in (0.2, 0.5, 0.7):
        want = {(r.q, r.s, r["rank"], round(r.score, 9)) for r in retrieve.topk_join(w, w, 3, min_sim=least, exclude_self=True).collect()}
        assert {(r.q, r.s, r["rank"], round(r.score, 9)) for r in retrieve.threshold_topk(w, 3, least).collect()} == want and want
    assert retrieve.scaled_max_df(1000) == 500 and retrieve.scaled_max_df(5_000_000) == 20_000 and retrieve.scaled_max_df(220_000) == 2000
