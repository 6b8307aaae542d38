"""Pair features (left side ``_1``: entity, right side ``_2``: record) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import similarity as S
from linkloom.functions.tokens import glued, initials, tokens


def flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")


def set_counts(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(shared, left, right) numbers of distinct tokens."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.size(F.array_intersect(x, y)), F.size(x), F.size(y)


def jaccard(a: Column, b: Column) -> Column:
    """Token Jaccard; null where both sides are empty."""
    i, x, y = set_counts(a, b)
    return F.when(x + y - i > 0, i / (x + y - i))


def number_features(a: Column, b: Column) -> dict[str, Column]:
    """Numbers of two (cleaned) addresses, line B."""
    return number_pair(number_side(a), number_side(b))


def number_side(c: Column) -> Column:
    """What one address gives to ``number_pair``: its numbers, distinct ones, the first, its value and last two digits."""
    x = F.regexp_extract_all(c, F.lit("[0-9]+"), 0)
    f = F.coalesce(F.get(x, F.lit(0)), F.lit(""))
    return F.struct(F.size(x).alias("n"), F.array_distinct(x).alias("x"), F.size(F.array_distinct(x)).alias("d"), f.alias("f"), F.substring(f, 1, 9).try_cast("bigint").alias("v"), F.substring(f, -2, 2).alias("e"))


def number_pair(a: Column, b: Column) -> dict[str, Column]:
    f1, f2, inter = a["f"], b["f"], F.size(F.array_intersect(a["x"], b["x"]))
    return {
        "num_n1": a["n"].cast("double"),
        "num_n2": b["n"].cast("double"),
        "num_only_1": (a["d"] - inter).cast("double"),
        "num_only_2": (b["d"] - inter).cast("double"),
        "num_first_logdiff": F.coalesce(F.log1p(F.abs(a["v"] - b["v"]).cast("double")), F.lit(-1.0)),
        "num_first_last2_eq": flag(a["e"] == b["e"]),
        "num_jacc": inter / F.greatest(a["d"] + b["d"] - inter, F.lit(1)),
        "num_any": flag(inter > 0),
        "num_conflict": flag((a["n"] > 0) & (b["n"] > 0) & (inter == 0)),
        "num_first_eq": flag((f1 == f2) & (f1 != "")),
        "num_first_suffix": flag((F.length(f1) > 1) & (F.length(f2) > 1) & (F.endswith(f1, f2) | F.endswith(f2, f1))),
    }


def acronym_features(a: Column, b: Column) -> dict[str, Column]:
    ia, ib, ga, gb = initials(a), initials(b), glued(a), glued(b)
    return {
        "acro_12": flag((ia == gb) & (F.length(ia) > 1)),
        "acro_21": flag((ib == ga) & (F.length(ib) > 1)),
        "acro_prefix": flag(F.startswith(gb, ia) & (F.length(ia) > 1)),
    }


def legal_features(a: Column, b: Column) -> dict[str, Column]:
    x, y = tokens(a), tokens(b)
    inter = F.size(F.array_intersect(x, y))
    return {"legal_n1": F.size(x).cast("double"), "legal_n2": F.size(y).cast("double"), "legal_inter": inter.cast("double"), "legal_conflict": flag((F.size(x) > 0) & (F.size(y) > 0) & (inter == 0))}


def _c(name: str, side: int) -> Column:
    return F.col(f"{name}_{side}")


#: Text columns and measures of line B.
MEASURES_B = (
    ("name", "name_n", ("ratio", "tsort", "tset", "partial")), ("core", "core_n", ("ratio", "tsort", "tset", "jw")), ("skel", "skel", ("ratio", "tsort")),
    ("addr", "addr_n", ("ratio", "tsort", "tset", "partial")), ("corec", "core_c", ("ratio", "tsort", "tset")), ("addrc", "addr_c", ("ratio", "tsort", "tset", "partial")),
    ("glued", "_glued", ("partial", "ratio")),
)


def features_b(p: DataFrame) -> DataFrame:
    """String, rule and token columns of line B for pairs with name_n, core_n, skel, addr_n, core_c, addr_c, legal, src on both sides."""
    wanted = {f"{tag}_{kind}": (kind, f"{col}_1", f"{col}_2") for tag, col, kinds in MEASURES_B for kind in kinds}
    for tag, col in (("tok", "core_n"), ("tokc", "core_c")):
        wanted |= {f"{tag}_miss_1": ("miss", f"{col}_1", f"{col}_2"), f"{tag}_miss_2": ("miss", f"{col}_2", f"{col}_1")}
    done = S.measured(p.withColumns({f"_glued_{i}": glued(_c("core_n", i)) for i in (1, 2)}), wanted).drop("_glued_1", "_glued_2")
    out = number_features(_c("addr_c", 1), _c("addr_c", 2)) | acronym_features(_c("core_n", 1), _c("core_n", 2)) | legal_features(_c("legal", 1), _c("legal", 2))
    for k, col in (("addr_exact", "addr_n"), ("addrc_exact", "addr_c"), ("corec_exact", "core_c"), ("core_exact", "core_n"), ("skel_exact", "skel")):
        out[k] = flag(_c(col, 1) == _c(col, 2))
    out |= {"addr_empty_1": flag(_c("addr_n", 1) == ""), "addr_empty_2": flag(_c("addr_n", 2) == ""), "is_s3": flag(_c("src", 2) == 3)}
    out |= {"name_len_1": F.length(_c("name_n", 1)).cast("double"), "name_len_2": F.length(_c("name_n", 2)).cast("double"), "addr_len_2": F.length(_c("addr_n", 2)).cast("double")}
    n = lambda i: F.size(tokens(_c("core_n", i))).cast("double")
    x, y = F.split(_c("addr_c", 1), " "), F.split(_c("addr_c", 2), " ")
    out |= {
        "tok_frac_miss_1": F.col("tok_miss_1") / F.greatest(n(1), F.lit(1.0)),
        "tok_frac_miss_2": F.col("tok_miss_2") / F.greatest(n(2), F.lit(1.0)),
        "tok_n_1": n(1),
        "addr_tok_miss_1": F.size(F.array_except(x, y)).cast("double"),
        "addr_tok_frac_miss_1": F.size(F.array_except(x, y)) / F.greatest(F.size(x), F.lit(1)),
    }
    return done.withColumns(out)


#: Text columns and measures of line A.
MEASURES_A = (
    ("name", "name_core", ("ratio", "partial", "tsort", "tset", "jw")), ("full", "name_clean", ("tset",)), ("gluedn", "_gn", ("ratio",)), ("phon", "name_phon", ("ratio", "tset")),
    ("gluedp", "_gp", ("ratio",)), ("addr", "addr_clean", ("ratio", "tset", "tsort", "partial")), ("aphon", "addr_phon", ("tset",)),
)


def features_a(p: DataFrame) -> DataFrame:
    """Name, address, number and source columns of line A (percent scale) for pairs of clean records; cosines come from ``retrieve.pair_cosine``."""
    hundred = lambda c: 100.0 * c
    n1, n2, a1, a2 = _c("name_core", 1), _c("name_core", 2), _c("addr_clean", 1), _c("addr_clean", 2)
    both_addr = (a1 != "") & (a2 != "")
    alias = (_c("name_alt", 1) != "") | (_c("name_alt", 2) != "")
    alt = lambda i: F.when(_c("name_alt", i) != "", _c("name_alt", i)).otherwise(_c("name_core", i))
    first = lambda c: F.get(F.split(c, " "), F.lit(0))
    ni, _, _ = set_counts(n1, n2)
    ai, ax, ay = set_counts(a1, a2)
    li, lx, ly = set_counts(_c("legal", 1), _c("legal", 2))
    mi, mx, my = set_counts(_c("addr_nums", 1), _c("addr_nums", 2))
    both_num = (mx > 0) & (my > 0)
    eq_if_both = lambda col: F.when((_c(col, 1) != "") & (_c(col, 2) != ""), (_c(col, 1) == _c(col, 2)).cast("double"))
    wanted = {f"_{tag}_{kind}": (kind, f"{col}_1", f"{col}_2") for tag, col, kinds in MEASURES_A for kind in kinds}
    wanted |= {"_alt_12": ("tset", "name_core_1", "_alt_2"), "_alt_21": ("tset", "_alt_1", "name_core_2")}
    helped = p.withColumns({f"_{k}_{i}": c for i in (1, 2) for k, c in (("alt", alt(i)), ("gn", glued(_c("name_core", i))), ("gp", glued(_c("name_phon", i))))})
    got = lambda name: hundred(F.col(f"_{name}"))
    out = S.measured(helped, wanted).withColumns(
        {
            "name_ratio": got("name_ratio"),
            "name_partial": got("name_partial"),
            "name_tsort": got("name_tsort"),
            "name_tset": got("name_tset"),
            "name_jw": F.col("_name_jw"),
            "name_full_tset": got("full_tset"),
            "name_nospace": got("gluedn_ratio"),
            "name_alt_best": F.when(alias, hundred(F.greatest("_alt_12", "_alt_21"))),
            "name_jacc": jaccard(n1, n2),
            "name_tok_overlap": ni,
            "name_first_eq": ((first(n1) == first(n2)) & (n1 != "")).cast("int"),
            "name_exact": ((n1 == n2) & (n1 != "")).cast("int"),
            "name_len_ratio": F.least(_c("name_len", 1), _c("name_len", 2)) / F.greatest(_c("name_len", 1), _c("name_len", 2), F.lit(1)),
            "legal_jacc": F.when((lx > 0) & (ly > 0), li / (lx + ly - li)),
            "name_phon_ratio": got("phon_ratio"),
            "name_phon_tset": got("phon_tset"),
            "name_phon_nospace": got("gluedp_ratio"),
            "addr_ratio": F.when(both_addr, got("addr_ratio")),
            "addr_tset": F.when(both_addr, got("addr_tset")),
            "addr_tsort": F.when(both_addr, got("addr_tsort")),
            "addr_partial": F.when(both_addr, got("addr_partial")),
            "addr_phon_tset": F.when(both_addr, got("aphon_tset")),
            "addr_jacc": F.when(both_addr, ai / (ax + ay - ai)),
            "addr_tok_overlap": ai,
            "addr_contain": F.when(F.least(ax, ay) > 0, ai / F.least(ax, ay)),
            "addr_empty_a": (a1 == "").cast("int"),
            "addr_empty_b": (a2 == "").cast("int"),
            "num_jacc": F.when(both_num, mi / (mx + my - mi)),
            "num_shared": mi,
            "num_conflict": (both_num & (mi == 0)).cast("int"),
            "num_first_eq": F.when(both_num, (first(_c("addr_nums", 1)) == first(_c("addr_nums", 2))).cast("double")),
            "postcode_eq": eq_if_both("postcode"),
            "state_eq": eq_if_both("state"),
            "b_is_s3": F.startswith(_c("entity_id", 2), F.lit("S3-")).cast("int"),
        }
    )
    return out.drop(*wanted, *[f"_{k}_{i}" for k in ("alt", "gn", "gp") for i in (1, 2)])
