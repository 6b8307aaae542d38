"""Retrieval, neighbour and policy queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.similarity import dot
from linkloom.functions.tokens import char_wb_grams, word_grams
from linkloom.operators import bands, knn, metrics, near_texts, policy, retrieve


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _out(found: DataFrame) -> DataFrame:
    return found.select("block", "q", "s", F.round("score", 6).alias("score"), "rank")


def tfidf_topk_block(spark, sf, max_df=None, min_sim=None):  # noqa: ANN001, ANN201
    """Top 3 suppliers of each customer's nation; terms over the size-scaled bound are dropped unless one is given."""
    c, s = t(spark, sf, "customer").withColumn("b", F.col("c_nationkey")), t(spark, sf, "supplier").withColumn("b", F.col("s_nationkey"))
    max_df = max_df or retrieve.scaled_max_df(c.count() + s.count())
    return _out(retrieve.tfidf_topk(c, s, "c_custkey", "s_suppkey", "b", char_wb_grams(F.lower("c_name")), char_wb_grams(F.lower("s_name")), 3, max_df, min_sim))


def tfidf_topk_maxdf(spark, sf):  # noqa: ANN001, ANN201
    return tfidf_topk_block(spark, sf, max_df=50, min_sim=0.05)


def tfidf_two_part_score(spark, sf):  # noqa: ANN001, ANN201
    p, grams = t(spark, sf, "part"), word_grams(F.col("text"))
    parts = [(F.lower(col), grams, 0.5) for col in ("p_name", "p_type")]
    top = retrieve.topk_of_texts(p, "p_partkey", "p_brand", parts, 3, retrieve.scaled_max_df(p.count()))
    return top.select("block", "q", "s", F.round("score", 6).alias("score"), "rank", F.round("part", 6).alias("name_part"))


def pair_tfidf_cosine(spark, sf):  # noqa: ANN001, ANN201
    """Cosines are of distinct names, whose weights count the parts that have them; pairs of parts look theirs up."""
    p = t(spark, sf, "part")
    texts = p.groupBy(F.lit("all").alias("block"), F.lower("p_name").alias("key")).agg(F.count(F.lit(1)).alias("copies"))
    sizes = texts.groupBy("block").agg(F.sum("copies").alias("n"))
    w = retrieve.text_weights(texts, char_wb_grams(F.col("key")), sizes).select("key", "term", "w")

    def cosines(pairs: DataFrame) -> DataFrame:
        cos = retrieve.pair_cosine(pairs.select(F.col("n1").alias("q"), F.col("n2").alias("s")).distinct().where("q IS NOT NULL AND s IS NOT NULL"), w, w)
        found = cos.select(F.col("q").alias("n1"), F.col("s").alias("n2"), "cos")
        return pairs.join(found, ["n1", "n2"], "left").withColumn("cos", F.round(F.coalesce("cos", F.lit(0.0)), 6))

    name = F.lower("p_name")
    return bands.text_pairs(p, "p_partkey", ("p_brand", "p_type"), "p_size", 2, {"n1": name}, {"n2": name}, cosines).select("q", "s", "cos")


def benchmark_overlap(spark, sf):  # noqa: ANN001, ANN201
    """Documents that hold at least half of a benchmark item's distinct word 5-grams."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 4, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(c, i, 5))))
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    # The generator keeps the words from being computed again for each gram.
    cut = lambda df, key: df.select(key, F.explode(F.array(words(F.col("text")))).alias("w")).select(key, grams(F.col("w")).alias("g"))
    items = cut(t(spark, sf, "benchmark"), "item_id").select("item_id", "g").select("item_id", F.size("g").alias("n"), F.explode("g").alias("gram"))
    docs = cut(t(spark, sf, "documents"), "doc_id").select("doc_id", F.explode("g").alias("gram"))
    hits = docs.join(items, "gram").groupBy("item_id", "doc_id", "n").agg(F.count(F.lit(1)).alias("shared"))
    return hits.where(F.col("shared") * 2 >= F.col("n")).select("item_id", "doc_id", "shared", F.round(F.col("shared") / F.col("n"), 6).alias("containment"))


def _vectors(spark, sf, group="label"):  # noqa: ANN001, ANN202
    return t(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").alias("label"))


def knn_exact_group(spark, sf):  # noqa: ANN001, ANN201
    v = _vectors(spark, sf)
    found = knn.knn_by_group(v, v, "label", "vec_id", "vec_id", "embedding", 10, exclude_self=True)
    return found.select(F.col("g").alias("label"), "q", "s", F.round("score", 6).alias("score"), "rank")


def _all_nb(spark, sf):  # noqa: ANN001, ANN202
    v = _vectors(spark, sf).withColumn("one", F.lit(1))
    found = knn.knn_by_group(v, v, "one", "vec_id", "vec_id", "embedding", 10, exclude_self=True)
    return found.select(F.lit("z").alias("view"), "q", "s", "rank", "score")


def knn_margin12(spark, sf):  # noqa: ANN001, ANN201
    nb = _all_nb(spark, sf).withColumn("g", F.lit(1))
    return knn.neighbour_stats(nb).select("q", *[F.round(c, 6).alias(c) for c in ("top1", "top2", "margin12")])


def view_policy_union(spark, sf):  # noqa: ANN001, ANN201
    nb = _all_nb(spark, sf)
    views = nb.unionByName(nb.withColumn("view", F.lit("za")))
    return policy.pair_union(policy.view_policy(views, {"z": (5, 0.05, -1.0), "za": (2, 0.1, 0.3)}))


def hub_cap(spark, sf):  # noqa: ANN001, ANN201
    return policy.hub_cap(_all_nb(spark, sf), 8).select("q", "s", "rank")


def _label_truth(spark, sf):  # noqa: ANN001, ANN202
    """A vector's nearest neighbour of its own label, as truth."""
    v = _vectors(spark, sf)
    return knn.knn_by_group(v, v, "label", "vec_id", "vec_id", "embedding", 1, exclude_self=True).select("q", "s")


def policy_quality(spark, sf):  # noqa: ANN001, ANN201
    nb = policy.view_policy(_all_nb(spark, sf), {"z": (5, 0.1, -1.0)})
    row = policy.policy_quality(_vectors(spark, sf).select(F.col("vec_id").alias("s")), _label_truth(spark, sf), policy.pair_union(nb))
    return row.select(*[F.round(c, 6).alias(c) for c in ("pair_recall", "ceiling", "cand_mean", "cand_p99")], "cand_max", "n_pairs")


def recall_at_k_mrr(spark, sf):  # noqa: ANN001, ANN201
    ranks = metrics.ranks_at(_all_nb(spark, sf), _label_truth(spark, sf), 10)
    row = metrics.recall_at(ranks, (1, 3, 5, 10), 10)
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


def emb_dot(spark, sf):  # noqa: ANN001, ANN201
    """Dot products of the query set (ids divisible by 100) with all vectors of their label."""
    v = _vectors(spark, sf)
    a, b = v.where("vec_id % 100 = 0").alias("a"), v.alias("b")
    near = (F.col("a.label") == F.col("b.label")) & (F.col("b.vec_id") != F.col("a.vec_id"))
    return a.join(b, near).select(F.col("a.vec_id").alias("q"), F.col("b.vec_id").alias("s"), F.round(dot(F.col("a.embedding"), F.col("b.embedding")), 6).alias("dot"))


def doc_neardup_topk(spark, sf):  # noqa: ANN001, ANN201
    """Each text's three nearest of the same language, at a cosine of 0.75 or more of TF-IDF over words and word pairs.

    Equal texts (as words) are one, known by their smallest id: weights and neighbours are among distinct texts, and every copy
    comes with that id at rank 0. No term is dropped; the join goes through prefixes (see ``near_texts``).
    """
    words = F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    d = t(spark, sf, "documents").select("doc_id", "lang", words.alias("words")).where("words <> ''")
    steps = near_texts.Steps(spark)
    d = steps.write(d.withColumn("text_key", F.md5("words")), "rows")  # words are made once
    keys = steps.write(d.drop("words"), "keys")
    first = d.groupBy("lang", "text_key").agg(F.min("doc_id").alias("first"), F.any_value("words").alias("words"))
    near = _out(near_texts.near_texts(first.select(F.col("lang").alias("block"), F.col("first").alias("key"), "words"), 3, 0.75, read=lambda: steps.drop("rows")))
    copies = keys.join(keys.groupBy("lang", "text_key").agg(F.min("doc_id").alias("first")), ["lang", "text_key"]).where("doc_id <> first")
    return near.unionByName(copies.select(F.col("lang").alias("block"), F.col("doc_id").alias("q"), F.col("first").alias("s"), F.lit(1.0).alias("score"), F.lit(0).cast("bigint").alias("rank")))


QUERIES = {
    f.__name__: f
    for f in (tfidf_topk_block, tfidf_topk_maxdf, tfidf_two_part_score, pair_tfidf_cosine, benchmark_overlap, knn_exact_group, knn_margin12, view_policy_union, hub_cap, policy_quality, recall_at_k_mrr, emb_dot, doc_neardup_topk)
}

_GRAMS = """
tok AS (SELECT side, block, key, unnest(list_filter(string_split(txt, ' '), lambda w: w <> '')) AS w FROM src),
gram AS (SELECT side, block, key, unnest(CASE WHEN length(w) + 2 <= 3 THEN [' ' || w || ' '] ELSE list_transform(range(1, length(w) + 1), lambda i: substr(' ' || w || ' ', i, 3)) END) AS term FROM tok),
"""
_WEIGHTS = """
tf AS (SELECT side, block, key, term, count(*) AS tf FROM gram GROUP BY ALL),
dfs AS (SELECT block, term, count(*) AS df FROM tf GROUP BY ALL {having}),
n AS (SELECT block, count(*) AS n FROM src GROUP BY ALL),
x AS (SELECT side, block, key, term, ln(1 + tf::DOUBLE) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS x FROM tf JOIN dfs USING (block, term) JOIN n USING (block)),
wt AS (SELECT side, block, key, term, x / sqrt(sum(x * x) OVER (PARTITION BY side, block, key)) AS w FROM x)
"""
_TOP = """
sc AS (SELECT q.block, q.key AS q, s.key AS s, sum(q.w * s.w) AS score FROM wt q JOIN wt s USING (block, term) WHERE q.side = 'r' AND s.side = 'e' GROUP BY ALL {having})
SELECT block, q, s, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY block, q ORDER BY round(score, 9) DESC, s) AS rank FROM sc) WHERE rank <= 3
"""
_SCALED = "HAVING count(*) <= greatest(500, floor(20000 * least(1.0, (SELECT count(*) FROM src) / 2200000.0)))"
_SRC_CS = "src AS (SELECT 'r' AS side, c_nationkey AS block, c_custkey AS key, lower(c_name) AS txt FROM customer UNION ALL SELECT 'e', s_nationkey, s_suppkey, lower(s_name) FROM supplier),"
_PART_PAIRS = "pp AS (SELECT a.p_partkey AS q, b.p_partkey AS s, a.p_name AS n1, b.p_name AS n2, a.p_size AS z1, b.p_size AS z2, a.p_type AS t1, b.p_brand AS b2 FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND a.p_partkey < b.p_partkey AND abs(a.p_size - b.p_size) <= 2)"
_ALL = """
allp AS (SELECT a.vec_id AS q, b.vec_id AS s, a.label AS la, b.label AS lb, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
nb AS (SELECT * FROM (SELECT q, s, score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, s) AS rank FROM allp) WHERE rank <= 10),
truth AS (SELECT q, s FROM (SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, s) AS r FROM allp WHERE la = lb) WHERE r = 1)
"""
_WORDPAIRS = "unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term"

ORACLES = {
    "tfidf_topk_block": "WITH " + _SRC_CS + _GRAMS + _WEIGHTS.format(having=_SCALED) + "," + _TOP.format(having=""),
    "tfidf_topk_maxdf": "WITH " + _SRC_CS + _GRAMS + _WEIGHTS.format(having="HAVING count(*) <= 50") + "," + _TOP.format(having="HAVING sum(q.w * s.w) >= 0.05"),
    "tfidf_two_part_score": f"""
WITH src2 AS (SELECT 'n' AS part, p_brand AS block, p_partkey AS key, list_filter(string_split(lower(p_name), ' '), lambda w: w <> '') AS ws FROM part
 UNION ALL SELECT 't', p_brand, p_partkey, list_filter(string_split(lower(p_type), ' '), lambda w: w <> '') FROM part),
gram AS (SELECT part, block, key, {_WORDPAIRS} FROM src2),
tf AS (SELECT part, block, key, term, count(*) AS tf FROM gram GROUP BY ALL),
dfs AS (SELECT part, block, term, count(*) AS df FROM tf GROUP BY ALL HAVING count(*) <= greatest(500, floor(20000 * least(1.0, (SELECT count(*) FROM part) / 2200000.0)))),
n AS (SELECT p_brand AS block, count(*) AS n FROM part GROUP BY ALL),
x AS (SELECT part, block, key, term, ln(1 + tf::DOUBLE) * (ln((1.0::DOUBLE + n) / (1.0::DOUBLE + df)) + 1) AS x FROM tf JOIN dfs USING (part, block, term) JOIN n USING (block)),
wt AS (SELECT part, block, key, term, x / sqrt(sum(x * x) OVER (PARTITION BY part, block, key)) * sqrt(0.5::DOUBLE) AS w FROM x),
sc AS (SELECT a.block, a.key AS q, b.key AS s, sum(a.w * b.w) AS score, sum(CASE WHEN a.part = 'n' THEN a.w * b.w ELSE 0 END) AS np FROM wt a JOIN wt b USING (part, block, term) WHERE a.key <> b.key GROUP BY ALL)
SELECT block, q, s, round(score, 6) AS score, rank, round(np, 6) AS name_part FROM (SELECT *, row_number() OVER (PARTITION BY block, q ORDER BY round(score, 9) DESC, s) AS rank FROM sc) WHERE rank <= 3
""",
    "pair_tfidf_cosine": "WITH src AS (SELECT 'e' AS side, 'all' AS block, p_partkey AS key, lower(p_name) AS txt FROM part)," + _GRAMS + _WEIGHTS.format(having="") + f""", {_PART_PAIRS},
c AS (SELECT pp.q, pp.s, sum(a.w * b.w) AS cos FROM pp JOIN wt a ON a.key = pp.q JOIN wt b ON b.key = pp.s AND b.term = a.term GROUP BY ALL)
SELECT pp.q, pp.s, round(coalesce(c.cos, 0), 6) AS cos FROM pp LEFT JOIN c ON c.q = pp.q AND c.s = pp.s
""",
    "benchmark_overlap": """
WITH w AS (SELECT 'i' AS kind, item_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS ws FROM benchmark
 UNION ALL SELECT 'd', doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') FROM documents),
g AS (SELECT kind, id, list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i : i + 4], ' '))) AS g FROM w),
i AS (SELECT id AS item_id, len(g) AS n, unnest(g) AS gram FROM g WHERE kind = 'i'),
d AS (SELECT id AS doc_id, unnest(g) AS gram FROM g WHERE kind = 'd')
SELECT item_id, doc_id, count(*) AS shared, round(count(*) / n::DOUBLE, 6) AS containment FROM d JOIN i USING (gram) GROUP BY item_id, doc_id, n HAVING count(*) * 2 >= n
""",
    "knn_exact_group": """
WITH s AS (SELECT a.label, a.vec_id AS q, b.vec_id AS s, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id)
SELECT label, q, s, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY label, q ORDER BY round(score, 9) DESC, s) AS rank FROM s) WHERE rank <= 10
""",
    "knn_margin12": f"WITH {_ALL} SELECT q, round(max(CASE WHEN rank = 1 THEN score END), 6) AS top1, round(max(CASE WHEN rank = 2 THEN score END), 6) AS top2, round(max(CASE WHEN rank = 1 THEN score END) - max(CASE WHEN rank = 2 THEN score END), 6) AS margin12 FROM nb GROUP BY q",
    "view_policy_union": f"WITH {_ALL} SELECT DISTINCT q, s FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM nb) WHERE (rank <= 5 AND score >= best - 0.05::DOUBLE AND score >= -1) OR (rank <= 2 AND score >= best - 0.1::DOUBLE AND score >= 0.3)",
    "hub_cap": f"WITH {_ALL} SELECT q, s, rank FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY round(score, 9) DESC, q) AS r FROM nb) WHERE r <= 8",
    "policy_quality": f"""
WITH {_ALL}, p AS (SELECT DISTINCT q, s FROM (SELECT *, max(score) OVER (PARTITION BY q) AS best FROM nb) WHERE rank <= 5 AND score >= best - 0.1::DOUBLE),
per AS (SELECT e.vec_id AS s, coalesce(t.n, 0) AS nt, coalesce(h.n, 0) AS nh, coalesce(c.n, 0) AS nc FROM embeddings e
 LEFT JOIN (SELECT s, count(*) AS n FROM truth GROUP BY s) t ON t.s = e.vec_id LEFT JOIN (SELECT s, count(*) AS n FROM p JOIN truth USING (q, s) GROUP BY s) h ON h.s = e.vec_id
 LEFT JOIN (SELECT s, count(*) AS n FROM p GROUP BY s) c ON c.s = e.vec_id)
SELECT round(sum(nh) / sum(nt)::DOUBLE, 6) AS pair_recall, round(avg(CASE WHEN nt = 0 THEN 1.0::DOUBLE WHEN nh = 0 THEN 0 ELSE 1.25::DOUBLE * (nh / nt::DOUBLE) / (0.25::DOUBLE + nh / nt::DOUBLE) END), 6) AS ceiling,
 round(avg(nc), 6) AS cand_mean, round(quantile_cont(nc, 0.99), 6) AS cand_p99, max(nc) AS cand_max, sum(nc)::BIGINT AS n_pairs FROM per
""",
    "recall_at_k_mrr": f"""
WITH {_ALL}, r AS (SELECT t.q, t.s, coalesce(nb.rank, 11) AS rank FROM truth t LEFT JOIN nb ON nb.q = t.q AND nb.s = t.s)
SELECT round(avg((rank <= 1)::INT), 6) AS r_at_1, round(avg((rank <= 3)::INT), 6) AS r_at_3, round(avg((rank <= 5)::INT), 6) AS r_at_5, round(avg((rank <= 10)::INT), 6) AS r_at_10, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr FROM r
""",
    "emb_dot": "SELECT a.vec_id AS q, b.vec_id AS s, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0",
    "doc_neardup_topk": f"""
WITH txt AS (SELECT doc_id, lang, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS words FROM documents),
firsts AS (SELECT lang, words, min(doc_id) AS first FROM txt WHERE words <> '' GROUP BY ALL),
src AS (SELECT 'r' AS side, lang AS block, first AS key, string_split(words, ' ') AS ws FROM firsts),
gram AS (SELECT side, block, key, {_WORDPAIRS} FROM src), {_WEIGHTS.format(having="")},
sc AS (SELECT q.block, q.key AS q, s.key AS s, sum(q.w * s.w) AS score FROM wt q JOIN wt s USING (block, term) WHERE q.key <> s.key GROUP BY ALL HAVING sum(q.w * s.w) >= 0.75)
SELECT block, q, s, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY block, q ORDER BY round(score, 9) DESC, s) AS rank FROM sc) WHERE rank <= 3
UNION ALL SELECT lang, doc_id, first, 1.0::DOUBLE, 0 FROM txt JOIN firsts USING (lang, words) WHERE doc_id <> first
""",
}
