"""Pair-feature queries on part pairs and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions.tokens import glued, initials
from linkloom.operators import bands
from linkloom.operators import pairs as P
from linkloom.plans.q_retrieval import _PART_PAIRS, t
from linkloom.shipping import ship


def token_jaccard(spark, sf):  # noqa: ANN001, ANN201
    a, b = F.col("n1"), F.col("n2")
    return _part_texts(spark, sf, {"n1": F.col("p_name")}, {"n2": F.col("p_name")}, jaccard=F.round(P.jaccard(a, b), 6), shared=P.set_counts(a, b)[0].cast("bigint")).select("q", "s", "jaccard", "shared")


def token_miss(spark, sf):  # noqa: ANN001, ANN201
    x, y = F.split("n1", " "), F.split("n2", " ")
    miss = F.size(F.array_except(x, y))
    return _part_texts(spark, sf, {"n1": F.col("p_name")}, {"n2": F.col("p_name")}, miss=miss.cast("bigint"), frac=F.round(miss / F.greatest(F.size(x), F.lit(1)), 6)).select("q", "s", "miss", "frac")


def number_features(spark, sf):  # noqa: ANN001, ANN201
    """Numbers of made-up addresses: key and size of either part."""
    side = P.number_side(F.concat_ws(" ", F.lit("no"), F.col("p_partkey"), F.lit("rd"), F.col("p_size")))
    p = bands.band_pairs(t(spark, sf, "part"), "p_partkey", ("p_brand", "p_type"), "p_size", 2, {"a": side}, {"b": side})
    six = lambda c: F.floor(c * 1e6 + 0.5) / 1e6  # noqa: E731  # as round(), which costs a decimal number for each value
    return p.select("q", "s", *[(six(c) if k in ("num_first_logdiff", "num_jacc") else c).alias(k) for k, c in P.number_pair(F.col("a"), F.col("b")).items()])


def acronym_match(spark, sf):  # noqa: ANN001, ANN201
    other = F.when(F.col("m") == 0, initials(F.col("n1"))).when(F.col("m") == 1, F.concat(initials(F.col("n1")), F.lit("x"))).otherwise(F.col("n2"))
    got = P.acronym_features(F.col("n1"), other) | {"glued": glued(F.col("n1"))}
    return _part_texts(spark, sf, {"n1": F.col("p_name"), "m": F.col("p_partkey") % 3}, {"n2": F.col("p_name")}, **got).select("q", "s", *got)


def legal_overlap(spark, sf):  # noqa: ANN001, ANN201
    k, got = F.col("p_partkey"), P.legal_features(F.col("l1"), F.col("l2"))
    l1, l2 = F.when(k % 3 == 0, "co ltd").when(k % 3 == 1, "ltd").otherwise(""), F.when(k % 2 == 0, "ltd").otherwise("inc")
    return _part_texts(spark, sf, {"l1": l1}, {"l2": l2}, **got).select("q", "s", *got)


def exact_flags(spark, sf):  # noqa: ANN001, ANN201
    # Two empty names have no ratio, and pairs of names are measured before it is known which of them occur.
    ratio = F.round(F.try_divide(F.least(F.length("n1"), F.length("n2")), F.greatest(F.length("n1"), F.length("n2"))), 6)
    p = _part_texts(spark, sf, {"n1": F.col("p_name")}, {"n2": F.col("p_name")}, exact=P.flag(F.col("n1") == F.col("n2")), len_ratio=ratio)
    return p.select("q", "s", "exact", P.flag(F.col("z1") == F.col("z2")).alias("size_eq"), F.least(F.greatest(F.col("z1") - F.col("z2"), F.lit(-1)), F.lit(1)).alias("clipped"), "len_ratio")


def jaro_winkler_pairs(spark, sf):  # noqa: ANN001, ANN201
    ship(spark)
    n = t(spark, sf, "nation").select(F.col("n_nationkey").alias("q"), F.lower("n_name").alias("a"), "n_regionkey")
    m = n.select(F.col("q").alias("s"), F.col("a").alias("b"), "n_regionkey")
    return n.join(m, "n_regionkey").select("q", "s", F.round(S.jaro_winkler_sim(F.col("a"), F.col("b")), 6).alias("jw"))


def _part_texts(spark, sf, left, right, **measures):  # noqa: ANN001, ANN003, ANN202
    """Pairs q < s of parts of one brand and type, sizes at most 2 apart, with measures of texts that either side has alone."""
    return bands.text_pairs(t(spark, sf, "part"), "p_partkey", ("p_brand", "p_type"), "p_size", 2, left, right, lambda pairs: pairs.withColumns(measures))


def _named(spark, sf, **measures):  # noqa: ANN001, ANN003, ANN202
    """Measures of a part's name ``a`` and the other's name and type ``b``."""
    ship(spark)
    return _part_texts(spark, sf, {"a": F.lower("p_name")}, {"b": F.lower(F.concat_ws(" ", "p_name", "p_type"))}, **measures).select("q", "s", *measures)


def indel_ratio_pairs(spark, sf):  # noqa: ANN001, ANN201
    return _named(spark, sf, ratio=F.round(S.ratio(F.col("a"), F.col("b")), 6))


def token_sort_ratio(spark, sf):  # noqa: ANN001, ANN201
    return _named(spark, sf, ratio=F.round(S.token_sort(F.col("a"), F.col("b")), 6))


def token_set_ratio(spark, sf):  # noqa: ANN001, ANN201
    return _named(spark, sf, ratio=F.round(S.token_set(F.col("a"), F.col("b")), 6))


def partial_ratio(spark, sf):  # noqa: ANN001, ANN201
    return _named(spark, sf, ratio=F.round(S.partial(F.col("a"), F.col("b")), 6))


def token_cover_miss(spark, sf):  # noqa: ANN001, ANN201
    return _named(spark, sf, miss_12=S.misses(F.col("a"), F.col("b")), miss_21=S.misses(F.col("b"), F.col("a")))


def alias_best(spark, sf):  # noqa: ANN001, ANN201
    return _named(spark, sf, best=F.round(F.greatest(S.token_set(F.col("a"), F.col("b")), S.token_set(F.reverse("a"), F.col("b"))), 6))


def similarity_bins_crosstab(spark, sf):  # noqa: ANN001, ANN201
    j = P.jaccard(F.col("n1"), F.col("n2"))
    bins = F.when(j == 0, "0").when(j < 0.5, "0-0.5").when(j < 1, "0.5-1").otherwise("1")
    p = _part_texts(spark, sf, {"n1": F.col("p_name")}, {"n2": F.col("p_name")}, bin=bins)
    return p.select("bin", F.abs(F.col("z1") - F.col("z2")).alias("d")).groupBy("bin").pivot("d", [0, 1, 2]).count().na.fill(0).select("bin", F.col("0").alias("d0"), F.col("1").alias("d1"), F.col("2").alias("d2"))


def s1_exact_name_count(spark, sf):  # noqa: ANN001, ANN201
    counts = bands.band_counts(t(spark, sf, "part"), "p_partkey", ("p_brand", "p_type"), "p_size", 2, "p_name")
    return counts.select("q", "n_exact", "n_cand", F.col("n_texts").alias("n_names"))


QUERIES = {
    f.__name__: f
    for f in (token_jaccard, token_miss, number_features, acronym_match, legal_overlap, exact_flags, jaro_winkler_pairs, indel_ratio_pairs, token_sort_ratio, token_set_ratio, partial_ratio, token_cover_miss, alias_best, similarity_bins_crosstab, s1_exact_name_count)
}

_J = "list_distinct(string_split(n1, ' ')) AS x, list_distinct(string_split(n2, ' ')) AS y"
_INI = "array_to_string(list_transform(string_split({}, ' '), lambda w: substr(w, 1, 1)), '')"
_NAMES = f"{_PART_PAIRS}, nm AS (SELECT q, s, lower(n1) AS a, lower(n2 || ' ' || t1) AS b FROM pp)"


def _ratios(pairs: str) -> str:
    """CTEs up to ``ratio (a, b, r)``: the normalised indel ratio of each distinct pair of the relation ``pairs``, by a table of common subsequences a row a step."""
    return f"""dp(a, b, i, best) AS (SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0) FROM (SELECT DISTINCT a, b FROM {pairs})
UNION ALL SELECT a, b, i + 1, list_reduce(list_concat([[0]], list_transform(range(1, length(b) + 1), lambda j: [greatest(best[j + 1], best[j] + (substr(b, j, 1) = substr(a, i + 1, 1))::INT)])), lambda acc, e: list_append(acc, greatest(acc[-1], e[1])))
FROM dp WHERE i < length(a)), ratio AS (SELECT a, b, CASE WHEN a = b THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * best[-1] / (length(a) + length(b)) END AS r FROM dp WHERE i = length(a))"""


def _token_set(names: str, out: str) -> str:
    """CTE ``out (q, s, r)``: the token-set ratio of the names' sides."""
    sort = lambda c: f"array_to_string({c}, ' ')"
    return f"""ts0 AS (SELECT q, s, list_sort(list_distinct(string_split(a, ' '))) AS x, list_sort(list_distinct(string_split(b, ' '))) AS y FROM {names}),
ts1 AS (SELECT q, s, list_filter(x, lambda w: list_contains(y, w)) AS c, list_filter(x, lambda w: NOT list_contains(y, w)) AS o, list_filter(y, lambda w: NOT list_contains(x, w)) AS t FROM ts0),
ts2 AS (SELECT q, s, len(c) AS nc, len(o) AS no, len(t) AS nt, {sort("c")} AS m, {sort("c || o")} AS l, {sort("c || t")} AS r FROM ts1),
ts3 AS (SELECT q, s, nc, no, nt, unnest(CASE WHEN nc = 0 THEN [{{'a': l, 'b': r}}] ELSE [{{'a': l, 'b': r}}, {{'a': m, 'b': l}}, {{'a': m, 'b': r}}] END) AS ab FROM ts2),
ts4 AS (SELECT q, s, nc, no, nt, ab.a AS a, ab.b AS b FROM ts3), {_ratios("ts4")},
{out} AS (SELECT q, s, CASE WHEN nc > 0 AND (no = 0 OR nt = 0) THEN 1.0::DOUBLE ELSE max(r) END AS r FROM ts4 JOIN ratio USING (a, b) GROUP BY q, s, nc, no, nt)"""


ORACLES = {
    "indel_ratio_pairs": f"WITH RECURSIVE {_NAMES}, {_ratios('nm')} SELECT q, s, round(r, 6) AS ratio FROM nm JOIN ratio USING (a, b)",
    "token_sort_ratio": f"""WITH RECURSIVE {_NAMES}, so AS (SELECT q, s, array_to_string(list_sort(string_split(a, ' ')), ' ') AS a, array_to_string(list_sort(string_split(b, ' ')), ' ') AS b FROM nm), {_ratios('so')}
SELECT q, s, round(r, 6) AS ratio FROM so JOIN ratio USING (a, b)""",
    "token_set_ratio": f"WITH RECURSIVE {_NAMES}, {_token_set('nm', 'tset')} SELECT q, s, round(r, 6) AS ratio FROM tset",
    "partial_ratio": f"""WITH RECURSIVE {_NAMES}, sides AS (SELECT q, s, a AS x, b AS y FROM nm WHERE length(a) <= length(b) UNION ALL SELECT q, s, b, a FROM nm WHERE length(b) <= length(a)),
win AS (SELECT q, s, x AS a, unnest(list_transform(range(1 - length(x), length(y)), lambda i: substr(y, greatest(i, 0) + 1, least(length(y), i + length(x)) - greatest(i, 0)))) AS b FROM sides), {_ratios('win')}
SELECT q, s, round(max(r), 6) AS ratio FROM win JOIN ratio USING (a, b) GROUP BY q, s""",
    "token_cover_miss": f"""WITH RECURSIVE {_NAMES}, tk AS (SELECT q, s, 1 AS side, unnest(string_split(a, ' ')) AS a, generate_subscripts(string_split(a, ' '), 1) AS k, string_split(b, ' ') AS o FROM nm
UNION ALL SELECT q, s, 2, unnest(string_split(b, ' ')), generate_subscripts(string_split(b, ' '), 1), string_split(a, ' ') FROM nm), tp AS (SELECT q, s, side, k, a, unnest(o) AS b FROM tk), {_ratios('tp')},
best AS (SELECT q, s, side, k, max(r) AS r FROM tp JOIN ratio USING (a, b) GROUP BY ALL) SELECT q, s, count(*) FILTER (side = 1 AND r < 0.8) AS miss_12, count(*) FILTER (side = 2 AND r < 0.8) AS miss_21 FROM best GROUP BY q, s""",
    "alias_best": f"""WITH RECURSIVE {_NAMES}, two AS (SELECT q * 2 AS q, s, a, b FROM nm UNION ALL SELECT q * 2 + 1, s, reverse(a), b FROM nm), {_token_set('two', 'tset')}
SELECT q // 2 AS q, s, round(max(r), 6) AS best FROM tset GROUP BY q // 2, s""",
    "token_jaccard": f"WITH {_PART_PAIRS}, j AS (SELECT q, s, {_J} FROM pp) SELECT q, s, round(len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE, 6) AS jaccard, len(list_intersect(x, y)) AS shared FROM j",
    "token_miss": f"WITH {_PART_PAIRS}, j AS (SELECT q, s, string_split(n1, ' ') AS x, string_split(n2, ' ') AS y FROM pp), k AS (SELECT *, len(list_distinct(list_filter(x, lambda w: NOT list_contains(y, w)))) AS m FROM j) SELECT q, s, m AS miss, round(m / len(x)::DOUBLE, 6) AS frac FROM k",
    "number_features": f"""WITH {_PART_PAIRS}, n AS (SELECT q, s, [q::VARCHAR, z1::VARCHAR] AS x, [s::VARCHAR, z2::VARCHAR] AS y, q::VARCHAR AS f1, s::VARCHAR AS f2 FROM pp), m AS (SELECT *, len(list_distinct(list_intersect(x, y))) AS i, len(list_distinct(x || y)) AS u FROM n)
SELECT q, s, 2.0::DOUBLE AS num_n1, 2.0::DOUBLE AS num_n2, len(list_distinct(list_filter(x, lambda w: NOT list_contains(y, w))))::DOUBLE AS num_only_1, len(list_distinct(list_filter(y, lambda w: NOT list_contains(x, w))))::DOUBLE AS num_only_2, round(ln(1 + abs(q - s)::DOUBLE), 6) AS num_first_logdiff,
(right(f1, 2) = right(f2, 2))::INT::DOUBLE AS num_first_last2_eq, round(i / u::DOUBLE, 6) AS num_jacc, (i > 0)::INT::DOUBLE AS num_any, (i = 0)::INT::DOUBLE AS num_conflict, (f1 = f2)::INT::DOUBLE AS num_first_eq, (length(f1) > 1 AND length(f2) > 1 AND (suffix(f1, f2) OR suffix(f2, f1)))::INT::DOUBLE AS num_first_suffix FROM m""",
    "acronym_match": f"""WITH {_PART_PAIRS}, n AS (SELECT q, s, n1, CASE WHEN q % 3 = 0 THEN {_INI.format("n1")} WHEN q % 3 = 1 THEN {_INI.format("n1")} || 'x' ELSE n2 END AS n2 FROM pp),
m AS (SELECT q, s, {_INI.format("n1")} AS ia, {_INI.format("n2")} AS ib, replace(n1, ' ', '') AS ga, replace(n2, ' ', '') AS gb FROM n)
SELECT q, s, (ia = gb AND length(ia) > 1)::INT::DOUBLE AS acro_12, (ib = ga AND length(ib) > 1)::INT::DOUBLE AS acro_21, (starts_with(gb, ia) AND length(ia) > 1)::INT::DOUBLE AS acro_prefix, ga AS glued FROM m""",
    "legal_overlap": f"""WITH {_PART_PAIRS}, l AS (SELECT q, s, CASE WHEN q % 3 = 0 THEN ['co', 'ltd'] WHEN q % 3 = 1 THEN ['ltd'] ELSE []::VARCHAR[] END AS x, CASE WHEN s % 2 = 0 THEN ['ltd'] ELSE ['inc'] END AS y FROM pp)
SELECT q, s, len(x)::DOUBLE AS legal_n1, len(y)::DOUBLE AS legal_n2, len(list_intersect(x, y))::DOUBLE AS legal_inter, (len(x) > 0 AND len(list_intersect(x, y)) = 0)::INT::DOUBLE AS legal_conflict FROM l""",
    "exact_flags": f"WITH {_PART_PAIRS} SELECT q, s, (n1 = n2)::INT::DOUBLE AS exact, (z1 = z2)::INT::DOUBLE AS size_eq, least(greatest(z1 - z2, -1), 1) AS clipped, round(least(length(n1), length(n2)) / greatest(length(n1), length(n2))::DOUBLE, 6) AS len_ratio FROM pp",
    "jaro_winkler_pairs": "SELECT a.n_nationkey AS q, b.n_nationkey AS s, round(jaro_winkler_similarity(lower(a.n_name), lower(b.n_name)), 6) AS jw FROM nation a JOIN nation b USING (n_regionkey)",
    "similarity_bins_crosstab": f"WITH {_PART_PAIRS}, j AS (SELECT abs(z1 - z2) AS d, {_J} FROM pp), k AS (SELECT d, len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y)))::DOUBLE AS j FROM j) SELECT CASE WHEN j = 0 THEN '0' WHEN j < 0.5 THEN '0-0.5' WHEN j < 1 THEN '0.5-1' ELSE '1' END AS bin, count(*) FILTER (d = 0) AS d0, count(*) FILTER (d = 1) AS d1, count(*) FILTER (d = 2) AS d2 FROM k GROUP BY bin",
    "s1_exact_name_count": f"WITH {_PART_PAIRS} SELECT q, sum((n1 = n2)::INT)::BIGINT AS n_exact, count(*) AS n_cand, count(DISTINCT n2) AS n_names FROM pp GROUP BY q",
}
