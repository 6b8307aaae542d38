"""End-to-end linkage: both lines, from raw sources to list tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions import line_a, line_b
from linkloom.functions.similarity import dot
from linkloom.functions.tokens import char_wb_grams
from linkloom.operators import compete, decide, encoder, knn, metrics, models, pairs, policy, retrieve, sample
from linkloom.sources import tables
from linkloom.sources.steps import written

KEEP_A = ("entity_id", "country", "name_clean", "name_core", "name_alt", "legal", "addr_clean", "addr_nums", "state", "postcode", "name_len", "name_phon", "addr_phon")


def _sides(pairs_: DataFrame, entities: DataFrame, records: DataFrame, columns: tuple[str, ...], key: str = "entity_id") -> DataFrame:
    left = entities.select(F.col(key).alias("s1"), *[F.col(c).alias(f"{c}_1") for c in columns])
    right = records.select(F.col(key).alias("rid"), *[F.col(c).alias(f"{c}_2") for c in columns])
    return pairs_.join(left, "s1").join(right, "rid")


def candidates_a(entities: DataFrame, records: DataFrame, k: int = 15, min_sim: float = 0.05, max_df: int = 20_000) -> DataFrame:
    """(rid, s1, ret, ret_nm, rk): four-part TF-IDF retrieval (core name, name skeleton, address, address skeleton, a quarter each)."""
    parts_r, parts_e = [], []
    sizes = entities.select(F.col("country").alias("block")).unionAll(records.select(F.col("country").alias("block"))).groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    for col in ("name_core", "name_phon", "addr_clean", "addr_phon"):
        r, e = (retrieve.term_counts(df, "entity_id", "country", char_wb_grams(F.col(col))) for df in (records, entities))
        dfs = retrieve.doc_freq(r, e)
        parts_r.append((retrieve.weights(r, dfs, sizes, max_df), 0.25))
        parts_e.append((retrieve.weights(e, dfs, sizes, max_df), 0.25))
    top = retrieve.topk_join(retrieve.combine_parts(parts_r), retrieve.combine_parts(parts_e), k, min_sim)
    names_r, names_e = retrieve.combine_parts(parts_r[:2]), retrieve.combine_parts(parts_e[:2])
    named = retrieve.pair_cosine(top.select("q", "s"), names_r, names_e)
    return top.join(named, ["q", "s"]).select(F.col("q").alias("rid"), F.col("s").alias("s1"), F.col("score").alias("ret"), F.col("cos").alias("ret_nm"), F.col("rank").alias("rk"))


def retrieval_features(cand: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """The cheap columns: scores, rank, competition on both sides, ambiguity of names and addresses."""
    out = cand.withColumn("ret_ad", F.col("ret") - F.col("ret_nm"))
    for tag, key in (("r", "rid"), ("s1", "s1")):
        for comp in ("", "_nm", "_ad"):
            out = compete.competition(out, f"ret{comp}", key, f"{tag}{comp}")
    ties = compete.top_two(cand.select("rid", "ret"), "rid", "ret").select("rid", F.col("n_tie").alias("grp_r_ntie"))
    out = out.join(ties, "rid")
    for col, short in (("name_core", "name"), ("addr_clean", "addr")):
        for df, key, tag in ((entities, "s1", "s1"), (records, "rid", "r")):
            freq = compete.value_frequency(entities, df, "country", col).select(F.col("entity_id").alias(key), F.col("freq").alias(f"freq_{tag}_{short}"))
            out = out.join(freq, key)
    return out


#: Thresholds that line A tries on its first validation set.
THRESHOLDS_A = tuple(round(0.3 + 0.02 * i, 2) for i in range(34))


def run_line_a(sources: dict[str, DataFrame], truth: DataFrame, k: int = 15, least: float = 0.003, rounds: int = 20, train_pct: int = 50, valid_pct: int = 10, prune_share: float = 1.0) -> dict[str, DataFrame]:
    """Clean, retrieve, prune, score and decide. sources: raw "1", "2", "3"; truth: (s1, rid).

    Entities have roles: 1 trains the models (the pruner on a share of them), 2 stops the boosting and tunes the threshold,
    3 is for the report ("report": macro F0.5 of the entities with role 3, "threshold": the chosen one).
    """
    ents = written(line_a.clean_frame(sources["1"]))
    recs = written(line_a.clean_frame(sources["2"].unionByName(sources["3"])))
    cand = retrieval_features(written(candidates_a(ents, recs, k)), ents, recs)
    labelled = cand.join(truth.withColumn("label", F.lit(1)), ["rid", "s1"], "left").na.fill(0, ["label"])
    number = sample.number_of(F.col("s1"))
    labelled = written(labelled.withColumn("role", sample.role(number, train_pct, valid_pct)))
    cheap = models.feature_columns(labelled)
    for_pruner = (F.col("role") == 1) & (sample.pair_uniform(number, F.lit(7)) < prune_share)
    pruner = models.Matcher(cheap, rounds=max(5, rounds // 2), depth=4).fit(labelled.where(for_pruner))
    pruned = models.prune(labelled, pruner, least)
    full = written(pairs.features_a(_sides(pruned, ents, recs, KEEP_A)))
    columns = [c for c in models.feature_columns(full) if not c.endswith(("_1", "_2")) and c not in ("q",)]
    matcher = models.Matcher(columns, rounds=rounds).fit(full.where("role IN (1, 2)"), F.col("role") == 2)
    scored = written(matcher.score(full).select("rid", "s1", "p", "label", "role"))
    roles = ents.select(F.col("entity_id").alias("s1"), sample.role(sample.number_of(F.col("entity_id")), train_pct, valid_pct).alias("role"))
    tune, report = (roles.where(F.col("role") == r).select("s1") for r in (2, 3))
    known = lambda part: truth.join(part, "s1", "left_semi")
    steps = metrics.sweep(tune, known(tune), scored.where("role = 2"), THRESHOLDS_A)
    threshold = steps.orderBy(F.col("macro_f05").desc(), "threshold").first().threshold  # one row
    matches = decide.select_threshold(scored, threshold, one_to_one=True).select("s1", "rid")
    told = metrics.summary(metrics.per_entity(report, known(report), matches.join(report, "s1", "left_semi")))
    return {"entities": ents, "records": recs, "candidates": labelled.select("s1", "rid"), "scored": scored, "matches": matches, "report": told.withColumn("threshold", F.lit(threshold))}


VIEWS = {"z": "t_z", "za": "t_za", "zn": "t_zn"}
COLUMNS_B = ("name_n", "core_n", "skel", "addr_n", "core_c", "addr_c", "legal", "src", "f_core", "f_skel")
#: Columns in which a pair is held against its record's other candidates, and those that the second stage reads.
RIVAL_COLUMNS = (
    "z_cos", "za_cos", "zn_cos", "core_tset", "core_ratio", "name_tset", "skel_ratio", "addr_tset", "addr_ratio", "num_first_eq", "core_exact", "skel_exact", "corec_tset", "addrc_tset", "num_jacc", "legal_inter",
)
STAGE_TWO = ("z_cos", "za_cos", "zn_cos", "z_vs2", "core_tset", "addr_tset", "num_first_eq", "num_conflict", "addr_empty_2", "s1_ncand", "rec_ncand")


def prepared_b(sources: dict[str, DataFrame]) -> DataFrame:
    """All sources' records with their normal forms and the three texts that are embedded."""
    raw = None
    for src, df in sources.items():
        part = df.select(F.lit(int(src)).alias("src"), "entity_id", F.trim(F.lower("country")).alias("country"), F.col("business_name").alias("name"), F.col("business_address").alias("addr"))
        raw = part if raw is None else raw.unionByName(part)
    recs = line_b.prepared(raw)
    return recs.withColumns({"t_z": F.concat_ws(" ", "core_n", "skel", "addr_n"), "t_za": F.col("addr_n"), "t_zn": F.concat_ws(" ", "core_n", "skel")})


def neighbours_b(ents: DataFrame, others: DataFrame, k: int) -> DataFrame:
    """(view, q, s, rank, score): by the joint view for all records, by address for those that have one, by name for the rest."""
    nb = None
    for view, queries in (("z", others), ("za", others.where("addr_n <> ''")), ("zn", others.where("addr_n = ''"))):
        found = knn.knn_by_group(queries, ents, "country", "entity_id", "entity_id", view, k).select(F.lit(view).alias("view"), "q", "s", "rank", "score")
        nb = found if nb is None else nb.unionByName(found)
    return nb


def features_b(cand: DataFrame, ents: DataFrame, others: DataFrame, nb: DataFrame, k: int) -> DataFrame:
    """All columns of candidate pairs (rid, s1): views, context, strings, rules, tokens, name frequencies, markers, rivals."""
    freq = {"core_n": "f_core", "skel": "f_skel"}
    left, right = (compete.name_frequency(ents, side, "country", freq) for side in (ents, others))
    vector = lambda side, key, i: side.select(F.col("entity_id").alias(key), *[F.col(v).alias(f"{v}_{i}") for v in VIEWS])
    met = cand.join(vector(ents, "s1", 1), "s1").join(vector(others, "rid", 2), "rid")
    met = met.select("rid", "s1", *[dot(F.col(f"{v}_1"), F.col(f"{v}_2")).alias(f"{v}_cos") for v in VIEWS])
    met = compete.context(compete.view_columns(met, nb, list(VIEWS), k), "z_cos")
    feats = compete.exact_counts(pairs.features_b(_sides(met, left, right, COLUMNS_B)))
    feats = compete.leads(feats, RIVAL_COLUMNS)
    return feats.join(others.select(F.col("entity_id").alias("rid"), *line_b.MARKERS), "rid")


def run_line_b(
    sources: dict[str, DataFrame], truth: DataFrame, k: int = 10, rounds: int = 20, folds: int = 3, dims: int = 64, held_pct: int = 50, net: bool = False, train_pairs: int = 20_000, epochs: int = 3, grid: dict | None = None
) -> dict[str, DataFrame]:
    """Normalise, embed, search, choose candidates, score out of fold, stack and decide.

    Encoders train on true pairs of entities that are not held out; the candidate policy, the matchers, the blend with the
    net (``net``) and the decision rule go by the held-out ones. The second stage counts only if it scores higher.
    "report": a row with the scores, the rule, the policy and the rounds of the refitted model (``model``).
    """
    recs = written(prepared_b(sources))
    held = lambda key: sample.pair_uniform(sample.number_of(F.col(key)), F.lit(11)) * 100 < held_pct
    heads = encoder.trained(recs, truth.where(~held("s1")), VIEWS, "country", dims, train_pairs, epochs)
    base = written(recs.join(encoder.encode_views(recs.select("entity_id", *VIEWS.values()), "entity_id", VIEWS, heads), "entity_id"))
    ents, others = base.where("src = 1"), base.where("src > 1")
    nb = written(neighbours_b(ents, others, k))
    entities = ents.where(held("entity_id")).select(F.col("entity_id").alias("s1"))
    known = truth.join(entities, "s1", "left_semi").select("rid", "s1")
    grid = grid or policy.GRID
    rule, cap = policy.choose(nb, entities.select(F.col("s1").alias("s")), known.select(F.col("rid").alias("q"), F.col("s1").alias("s")), "z", grid=grid)
    kept = policy.view_policy(nb, {"z": rule, "za": (2, 0.05, 0.8), "zn": (5, 0.1, -1.0)})
    cand = policy.pair_union(kept if cap is None else policy.hub_cap(kept, cap)).select(F.col("q").alias("rid"), F.col("s").alias("s1"))
    labelled = features_b(cand, ents, others, nb, k).join(truth.withColumn("label", F.lit(1)), ["rid", "s1"], "left").na.fill(0, ["label"])
    labelled = written(labelled.withColumns({"fold": F.pmod(F.xxhash64("s1"), F.lit(folds)), "is_hold": held("s1")}))  # every fold and both stages read it
    texts = {f"{c}_{i}" for c in COLUMNS_B if not c.startswith("f_") for i in (1, 2)}
    columns = [c for c in models.feature_columns(labelled) if c not in texts and c != "is_hold"]
    first, n_trees = models.cross_validated(labelled, lambda: models.Matcher(columns, rounds=rounds), folds, F.col("is_hold"))
    if net:
        first, _ = models.cross_validated(written(first.withColumnRenamed("p", "p_trees")), lambda: models.Matcher(columns, kind="net", rounds=rounds), folds, F.col("is_hold"), out="p_net")
        first = written(first)
        weight, rule1, f1 = models.best_blend(first.where("is_hold"), "p_trees", "p_net", entities, known)
        first = models.blend(first, "p_trees", "p_net", weight).drop("p_trees", "p_net")
    else:
        first = written(first)
        weight, (rule1, f1) = 1.0, metrics.best_rule(entities, known, first.where("is_hold"))
    stacked = written(compete.stack_features(first.select("rid", "s1", "label", "fold", "is_hold", "p", *STAGE_TWO)).withColumnRenamed("p", "p1"))
    more = [c for c in models.feature_columns(stacked) if c not in ("fold", "is_hold")]
    second, _ = models.cross_validated(stacked, lambda: models.Matcher(more, rounds=max(5, rounds // 2), depth=3), folds, F.col("is_hold"))
    second = written(second)
    rule2, f2 = metrics.best_rule(entities, known, second.where("is_hold"))
    best, rule_, f = (second, rule2, f2) if f2 > f1 else (first, rule1, f1)
    scored = best.select("rid", "s1", "p", "label", "is_hold")
    report = recs.sparkSession.createDataFrame(
        [(f1, f2, f2 > f1, weight, str(rule_), str(rule), cap, n_trees)], "first double, second double, stacked boolean, weight double, rule string, policy string, cap int, trees int"
    )
    matches = decide.apply_rule(scored, rule_).select("s1", "rid")
    return {"entities": ents, "records": others, "candidates": labelled.select("s1", "rid"), "scored": scored, "first": first.select("rid", "s1", "p", "label"), "matches": matches, "features": labelled.select("rid", "s1", "label", "is_hold", *columns), "report": report}


def refitted(result: dict[str, DataFrame], rounds: int) -> models.Matcher:
    """The matcher of line B fitted on all held-out rows with this number of rounds, for new splits."""
    rows = result["features"]
    columns = [c for c in models.feature_columns(rows) if c != "is_hold"]
    return models.Matcher(columns, rounds=rounds).fit(rows.where("is_hold"))


def evaluate(result: dict[str, DataFrame], truth: DataFrame) -> DataFrame:
    ents = result["entities"].select(F.col("entity_id").alias("s1"))
    return metrics.summary(metrics.per_entity(ents, truth, result["matches"]))


def lists(result: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The two list tables: matches and candidates, one row per entity."""
    ents = result["entities"].select(F.col("entity_id").alias("s1"))
    return tables.list_table(ents, result["matches"]), tables.list_table(ents, result["candidates"], name="candidate_entity_ids")
