"""Split, sample, list and block queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from linkloom.operators import sample, validate
from linkloom.plans.q_decisions import scored, truth
from linkloom.plans.q_retrieval import t
from linkloom.sources import tables


def holdout_digits(spark, sf):  # noqa: ANN001, ANN201
    c = t(spark, sf, "customer")
    return c.select("c_custkey", sample.holdout(F.col("c_custkey"), (3, 7)).alias("held"), sample.fold(F.col("c_custkey")).alias("fold"), sample.curve_keep(F.col("c_custkey"), 0.25).alias("in_quarter"))


def pair_uniform(spark, sf):  # noqa: ANN001, ANN201
    li = t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    return li.select("l_orderkey", "l_linenumber", F.round(sample.pair_uniform(F.col("l_orderkey"), F.col("l_suppkey")), 9).alias("u"))


def entity_roles(spark, sf):  # noqa: ANN001, ANN201
    return t(spark, sf, "customer").select("c_custkey", sample.role(F.col("c_custkey")).alias("role"))


def easy_negative_sample(spark, sf):  # noqa: ANN001, ANN201
    p = scored(spark, sf).join(truth(spark, sf).withColumn("label", F.lit(1)), ["rid", "s1"], "left").na.fill(0, ["label"])
    p = p.withColumn("best", F.max("p").over(Window.partitionBy("rid")))
    return sample.easy_negatives(p, "p", "best", "label", 0.8, 0.1).select("rid", "s1", "label", "weight")


def holdout_touching(spark, sf):  # noqa: ANN001, ANN201
    held = t(spark, sf, "supplier").where(F.col("s_suppkey") % 20 == 0).select(F.col("s_suppkey").alias("s1"))
    return sample.touching(scored(spark, sf).select("rid", "s1"), held)


def subworld_sample(spark, sf):  # noqa: ANN001, ANN201
    c, o = t(spark, sf, "customer").select("c_custkey"), t(spark, sf, "orders").select("o_orderkey")
    pairs = t(spark, sf, "orders").where("o_orderkey % 4 <> 0").select(F.col("o_custkey").alias("s1"), F.col("o_orderkey").alias("rid"))
    ents, recs, left = sample.subworld(c, o, pairs, "c_custkey", "o_orderkey", 10)
    tag = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("id"))
    return tag(ents, "entity").unionByName(tag(recs, "record")).unionByName(tag(left.select("rid"), "pair"))


def _lists(spark, sf):  # noqa: ANN001, ANN202
    o = t(spark, sf, "orders").select(F.col("o_custkey").alias("s1"), F.col("o_orderkey").alias("rid"))
    return tables.list_table(t(spark, sf, "customer").select(F.col("c_custkey").alias("s1")), o)


def id_list_sink(spark, sf):  # noqa: ANN001, ANN201
    return _lists(spark, sf)


def gt_explode_pairs(spark, sf):  # noqa: ANN001, ANN201
    pairs = tables.explode_lists(_lists(spark, sf), "s1")
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("rid"), "o_custkey")
    return pairs.withColumn("rid", F.col("rid").cast("bigint")).join(o, "rid").select("s1", "rid")


def list_file_validate(spark, sf):  # noqa: ANN001, ANN201
    """A faulty list file made of orders: every 50th customer is missing or twice, some ids repeat, are strange or name entities."""
    name = lambda c, p: F.concat(F.lit(p), F.col(c).cast("string"))
    o = t(spark, sf, "orders").where("o_custkey % 50 <> 0").withColumn("x", F.when(F.col("o_orderkey") % 97 == 0, name("o_orderkey", "S1-")).when(F.col("o_orderkey") % 89 == 0, name("o_orderkey", "X-")).when(F.col("o_orderkey") % 83 == 0, F.lit("S2-1")).otherwise(name("o_orderkey", "S2-")))
    lists = o.groupBy(name("o_custkey", "S1-").alias("k"), "o_custkey").agg(F.array_join(F.array_sort(F.collect_list("x")), ",").alias("l"))
    lists = lists.select("k", "l").unionAll(lists.where("o_custkey % 49 = 0").select("k", "l"))
    need = t(spark, sf, "customer").select(name("c_custkey", "S1-").alias("k"))
    known = t(spark, sf, "orders").select(name("o_orderkey", "S2-").alias("id"))
    return validate.list_findings(lists, need, "k", "l", known)


#: Ranges that a source's keys are cut into: the offsets, one for each, are broadcast.
RANGES = 4096


def union_sources_dense_id(spark, sf):  # noqa: ANN001, ANN201
    """Three sources under one schema with a dense id over (source, key): positions within ranges of keys plus the ranges' offsets.
    A source has ``RANGES`` ranges between its least and greatest key, however many rows it has."""
    one = t(spark, sf, "supplier").select(F.lit(1).alias("src"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    two = t(spark, sf, "customer").select(F.lit(2).alias("src"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"))
    three = t(spark, sf, "part").select(F.lit(3).alias("src"), F.col("p_partkey").alias("key"), F.col("p_name").alias("name"))
    every = one.unionByName(two).unionByName(three)
    ends = every.groupBy("src").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))  # one row for each source
    cut = every.join(F.broadcast(ends), "src").withColumn("range", F.floor((F.col("key") - F.col("lo")) * RANGES / (F.col("hi") - F.col("lo") + 1)))
    sizes = cut.groupBy("src", "range").agg(F.count(F.lit(1)).alias("n"))
    totals = sizes.groupBy("src").agg(F.sum("n").alias("rows"))
    earlier = ends.select("src").alias("a").join(totals.alias("b"), F.col("b.src") < F.col("a.src"), "left").groupBy("a.src").agg(F.coalesce(F.sum("b.rows"), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.withColumn("inside", inside).join(earlier, "src").select("src", "range", (F.col("inside") + F.col("base")).alias("before"))
    at = F.row_number().over(Window.partitionBy("src", "range").orderBy("key"))
    return cut.withColumn("at", at).join(F.broadcast(before), ["src", "range"]).select("src", "key", "name", (F.col("before") + F.col("at") - 1).alias("rid"))


def block_report(spark, sf):  # noqa: ANN001, ANN201
    s, c = t(spark, sf, "supplier"), t(spark, sf, "customer")
    n1 = s.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_entities"))
    n2 = c.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("n_records"))
    pairs = F.col("n_entities") * F.col("n_records")
    total = F.sum("n_entities").over(Window.partitionBy()) * F.sum("n_records").over(Window.partitionBy())
    return n1.join(n2, "nation", "full").na.fill(0).select("nation", "n_entities", "n_records", pairs.alias("pairs"), F.round(1 - pairs / total, 9).alias("reduction"))


def true_count(spark, sf):  # noqa: ANN001, ANN201
    """How many entities have how many matches."""
    per = t(spark, sf, "customer").select(F.col("c_custkey").alias("s1")).join(t(spark, sf, "orders").groupBy(F.col("o_custkey").alias("s1")).agg(F.count(F.lit(1)).alias("n")), "s1", "left").na.fill(0)
    return per.groupBy("n").agg(F.count(F.lit(1)).alias("entities"))


def feature_summary(spark, sf):  # noqa: ANN001, ANN201
    """Null share, and mean by label, of features of labelled documents."""
    d = t(spark, sf, "documents").join(t(spark, sf, "labels"), "doc_id")
    feats = {"n_chars": F.col("n_chars").cast("double"), "n_lines": (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("double"), "long_flag": F.when(F.col("n_chars") > 1000, 1.0)}
    rows = d.select("quality", F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("v")) for k, v in feats.items()])))
    out = rows.groupBy("feature").agg(F.avg(F.col("v").isNull().cast("double")).alias("null_share"), F.avg(F.when(F.col("quality") == 1, F.col("v"))).alias("mean_1"), F.avg(F.when(F.col("quality") == 0, F.col("v"))).alias("mean_0"))
    return out.withColumn("gap", F.col("mean_1") - F.col("mean_0")).select("feature", *[F.round(c, 4).alias(c) for c in ("null_share", "mean_1", "mean_0", "gap")])


QUERIES = {
    f.__name__: f
    for f in (holdout_digits, pair_uniform, entity_roles, easy_negative_sample, holdout_touching, subworld_sample, id_list_sink, gt_explode_pairs, list_file_validate, union_sources_dense_id, block_report, true_count, feature_summary)
}

_S = "sc AS (SELECT l_orderkey AS rid, l_suppkey AS s1, least(round(max(l_discount * 5 + l_quantity / 101), 6), 0.999999::DOUBLE) AS p FROM lineitem GROUP BY ALL)"
_MIX = "(((({a} * 2654435761 + {b} * 2246822519) % 4294967296)))"


def _uniform(a: str, b: str) -> str:
    h = f"(({a}::HUGEINT * 2654435761 + {b}::HUGEINT * 2246822519) % 4294967296)::BIGINT"
    h2 = f"(((xor({h}, {h} >> 15))::HUGEINT * 739982445) % 4294967296)::BIGINT"
    return f"(xor({h2}, {h2} >> 12) / 4294967296.0::DOUBLE)"


ORACLES = {
    "entity_roles": f"WITH x AS (SELECT c_custkey, {_uniform('c_custkey', '42')} * 100 AS u FROM customer) SELECT c_custkey, CASE WHEN u < 4 THEN 2 WHEN u < 8 THEN 3 WHEN u < 38 THEN 1 ELSE 0 END AS role FROM x",
    "holdout_digits": "SELECT c_custkey, (c_custkey // 100) % 10 IN (3, 7) AS held, (((c_custkey * 2654435761) % 4294967296) >> 16) % 5 AS fold, (c_custkey * 2246822519) % 1000 < 250 AS in_quarter FROM customer",
    "pair_uniform": f"SELECT l_orderkey, l_linenumber, round({_uniform('l_orderkey', 'l_suppkey')}, 9) AS u FROM lineitem",
    "easy_negative_sample": f"""WITH {_S}, tr AS (SELECT DISTINCT l_orderkey AS rid, l_suppkey AS s1 FROM lineitem WHERE l_returnflag = 'R'), x AS (SELECT sc.rid, sc.s1, p, (tr.rid IS NOT NULL)::INT AS label, max(p) OVER (PARTITION BY sc.rid) AS best FROM sc LEFT JOIN tr ON tr.rid = sc.rid AND tr.s1 = sc.s1)
SELECT rid, s1, label, CASE WHEN label = 0 AND p < 0.8::DOUBLE * best THEN 10.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM x WHERE NOT (label = 0 AND p < 0.8::DOUBLE * best) OR {_uniform('rid', 's1')} < 0.1""",
    "holdout_touching": f"WITH {_S} SELECT rid, s1 FROM sc WHERE rid IN (SELECT rid FROM sc WHERE s1 % 20 = 0)",
    "subworld_sample": """WITH tr AS (SELECT o_custkey AS s1, o_orderkey AS rid FROM orders WHERE o_orderkey % 4 <> 0), e AS (SELECT c_custkey FROM customer WHERE c_custkey % 100 < 10), k AS (SELECT * FROM tr WHERE s1 IN (SELECT c_custkey FROM e))
SELECT 'entity' AS kind, c_custkey AS id FROM e UNION ALL SELECT 'record', o_orderkey FROM orders WHERE o_orderkey IN (SELECT rid FROM k) UNION ALL SELECT 'record', o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT rid FROM tr) AND o_orderkey % 100 < 10 UNION ALL SELECT 'pair', rid FROM k""",
    "id_list_sink": "SELECT c_custkey AS s1, coalesce(string_agg(DISTINCT o_orderkey::VARCHAR, ',' ORDER BY o_orderkey::VARCHAR), '') AS matched_entity_ids FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey",
    "gt_explode_pairs": "SELECT o_custkey AS s1, o_orderkey AS rid FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)",
    "list_file_validate": """WITH o AS (SELECT 'S1-' || o_custkey AS k, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'S1-' || o_orderkey WHEN o_orderkey % 89 = 0 THEN 'X-' || o_orderkey WHEN o_orderkey % 83 = 0 THEN 'S2-1' ELSE 'S2-' || o_orderkey END AS x FROM orders WHERE o_custkey % 50 <> 0),
l AS (SELECT k, o_custkey, list(x) AS l FROM o GROUP BY ALL), r AS (SELECT k, l FROM l UNION ALL SELECT k, l FROM l WHERE o_custkey % 49 = 0), e AS (SELECT k, unnest(l) AS x FROM r), need AS (SELECT 'S1-' || c_custkey AS k FROM customer)
SELECT * FROM (SELECT 'duplicate row' AS rule, count(*) AS n, min(k) AS example FROM (SELECT k FROM r GROUP BY k HAVING count(*) > 1)
UNION ALL SELECT 'duplicate id in list', count(*), min(k) FROM r WHERE len(l) > len(list_distinct(l)) UNION ALL SELECT 'entity in list', count(*), min(k) FROM e WHERE starts_with(x, 'S1-') UNION ALL SELECT 'bad prefix', count(*), min(k) FROM e WHERE NOT regexp_matches(x, '^S[123]-')
UNION ALL SELECT 'missing entity', count(*), min(k) FROM need WHERE k NOT IN (SELECT k FROM r) UNION ALL SELECT 'extra entity', count(*), min(k) FROM (SELECT DISTINCT k FROM r) WHERE k NOT IN (SELECT k FROM need)
UNION ALL SELECT 'unknown id', count(*), min(k) FROM e WHERE regexp_matches(x, '^S[23]-') AND x NOT IN (SELECT 'S2-' || o_orderkey FROM orders)) WHERE n > 0""",
    "union_sources_dense_id": "SELECT *, row_number() OVER (ORDER BY src, key) - 1 AS rid FROM (SELECT 1 AS src, s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT 2, c_custkey, c_name FROM customer UNION ALL SELECT 3, p_partkey, p_name FROM part)",
    "block_report": """WITH a AS (SELECT s_nationkey AS nation, count(*) AS n FROM supplier GROUP BY 1), b AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), j AS (SELECT coalesce(a.nation, b.nation) AS nation, coalesce(a.n, 0) AS n_entities, coalesce(b.n, 0) AS n_records FROM a FULL JOIN b USING (nation))
SELECT nation, n_entities, n_records, n_entities * n_records AS pairs, round(1 - n_entities * n_records / (SELECT sum(n_entities) * sum(n_records) FROM j)::DOUBLE, 9) AS reduction FROM j""",
    "true_count": "SELECT n, count(*) AS entities FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey) GROUP BY n",
    "feature_summary": """WITH d AS (SELECT quality, n_chars::DOUBLE AS n_chars, (length(text) - length(replace(text, chr(10), '')) + 1)::DOUBLE AS n_lines, CASE WHEN n_chars > 1000 THEN 1.0::DOUBLE END AS long_flag FROM documents JOIN labels USING (doc_id)) """
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg(({f} IS NULL)::INT), 4) AS null_share, round(avg({f}) FILTER (quality = 1), 4) AS mean_1, round(avg({f}) FILTER (quality = 0), 4) AS mean_0, round(avg({f}) FILTER (quality = 1) - avg({f}) FILTER (quality = 0), 4) AS gap FROM d" for f in ("n_chars", "n_lines", "long_flag")),
}
