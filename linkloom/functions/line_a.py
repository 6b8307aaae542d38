"""Name and address normalisation of line A as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.functions import vocab as V
from linkloom.functions.tokens import collapse_initials, dedupe_consecutive, drop_tokens, fix_leet, joined, literal_map, map_tokens, tokens
from linkloom.functions.translit import ascii_text

# Fixed patterns.
ALIAS = r"\b(?:f[\s/.]?k[\s/.]?a|d[\s/.]?b[\s/.]?a|a[\s/.]?k[\s/.]?a|formerly(?: known as)?|trading as)\b\.?"
DOMAIN = r"^(?:https?://)?(?:www\.)?([a-z0-9\-]+)\.(?:com|net|org|in|co\.in|co|fr|io|biz|us|info)\b"
ID_TAG = r"(?i)\(\s*id\s*:?\s*\d+\s*\)"
URL_TAIL = r"(?i)\|\s*(?:https?://)?(?:www\.)?\S+\s*$"
NON_LATIN = "[^\u0000-ɏḀ-ỿ]+"
PO_BOX = r"\b(?:p\s?o\s?box|pmb|post box)\s*#?\s*\d+\b"
POSTCODE = r"\b(\d{5,6})[\s,]*$"


def nonlatin_flag(raw: Column) -> Column:
    return F.when(raw == "", 0).otherwise((F.length(F.regexp_replace(raw, NON_LATIN, "")) < 0.5 * F.length(raw)).cast("int"))


def strip_tags(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, ID_TAG, " "), URL_TAIL, " ")


def domain_stem(s: Column) -> tuple[Column, Column]:
    """(text, is_domain): a name that is one web domain becomes its label."""
    stem = F.regexp_extract(s, DOMAIN, 1)
    hit = (stem != "") & ~s.contains(" ")
    return F.when(hit, F.replace(stem, F.lit("-"), F.lit(" "))).otherwise(s), hit.cast("int")


def name_tokens(s: Column) -> Column:
    s = F.replace(F.replace(s, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus "))
    return dedupe_consecutive(collapse_initials(fix_leet(tokens(F.regexp_replace(s, "[^a-z0-9 ]+", " ")))))


def core_of(arr: Column) -> Column:
    return drop_tokens(drop_tokens(arr, V.LEGAL_A), V.NAME_STOP_A)


def legal_of(arr: Column) -> Column:
    known = F.filter(arr, lambda t: F.map_contains_key(literal_map(V.LEGAL_A), t))
    return F.array_sort(F.array_distinct(tokens(joined(map_tokens(known, V.LEGAL_A)))))


def clean_name(df: DataFrame, raw: str) -> DataFrame:
    """Adds name_clean, name_core, name_alt, legal, name_nonlatin, name_is_domain."""
    text = F.coalesce(F.col(raw), F.lit(""))
    out = df.withColumn("name_nonlatin", nonlatin_flag(text)).withColumn("_s", F.trim(F.lower(ascii_text(strip_tags(text)))))
    stem, flag = domain_stem(F.col("_s"))
    out = out.withColumns({"_d": stem, "name_is_domain": flag}).withColumn("_parts", F.split("_d", ALIAS))
    out = out.withColumn("_t", name_tokens(F.array_join("_parts", " "))).withColumn("_t", map_tokens(F.col("_t"), V.LEGAL_A))
    out = out.withColumns({"_first": joined(core_of(name_tokens(F.element_at("_parts", 1)))), "_last": joined(core_of(name_tokens(F.element_at("_parts", -1)))), "_core": joined(core_of(F.col("_t")))})
    alias = F.size("_parts") > 1
    return out.withColumns(
        {
            "name_clean": joined(F.col("_t")),
            "name_core": F.when(alias & (F.col("_last") != ""), F.col("_last")).otherwise(F.col("_core")),
            "name_alt": F.when(alias, F.col("_first")).otherwise(""),
            "legal": joined(legal_of(F.col("_t"))),
        }
    ).drop("_s", "_d", "_parts", "_t", "_first", "_last", "_core")


def clean_address(df: DataFrame, raw: str, country: str) -> DataFrame:
    """Adds addr_clean, addr_nums, state, postcode."""
    states = sorted({*V.US_STATES_A, *V.US_STATES_A.values(), *V.IN_STATES_A, *V.IN_STATES_A.values(), *V.MORE_STATES_A})
    known = F.array(*[F.lit(s) for s in states])
    text = F.lower(ascii_text(F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), NON_LATIN, " ")))
    out = df.withColumn("_c", F.transform(F.split(text, ","), lambda c: F.struct(c.alias("raw"), joined(tokens(F.regexp_replace(c, "[^a-z0-9 ]+|\\s+", " "))).alias("c"))))
    out = out.withColumn("_c", F.filter("_c", lambda c: c["c"] != ""))
    out = out.withColumn("_hits", F.filter(F.transform("_c", lambda c, i: F.when(F.array_contains(known, c["c"]), i)), lambda i: i.isNotNull()))
    out = out.withColumn("_hit", F.get("_hits", F.lit(0)))
    token = F.get("_c", F.col("_hit"))["c"]
    named = F.when(F.col(country) == "us", F.try_element_at(literal_map(V.US_STATES_A), token)).when(F.col(country) == "india", F.try_element_at(literal_map(V.IN_STATES_A), token))
    out = out.withColumn("state", F.coalesce(named, token, F.lit("")))
    out = out.withColumn("_rest", F.array_join(F.transform(F.filter("_c", lambda c, i: F.col("_hit").isNull() | (i != F.col("_hit"))), lambda c: c["raw"]), " , "))
    out = out.withColumn("_rest", F.regexp_replace("_rest", PO_BOX, " "))
    bare = lambda t: F.when(F.ltrim(F.translate(t, "0", " ")) == "", "0").otherwise(F.regexp_replace(t, "^0+", ""))
    code = F.regexp_extract("_rest", POSTCODE, 1)
    out = out.withColumn("postcode", F.when(code == "", "").otherwise(bare(code)))
    abbreviated = lambda t: F.coalesce(F.try_element_at(literal_map(V.ADDR_ABBR_A), t), t)
    each = F.transform(tokens(F.regexp_replace("_rest", "[^a-z0-9 ]+|\\s+", " ")), lambda t: F.when(t.rlike("^[0-9]+$"), bare(t)).otherwise(F.regexp_replace(abbreviated(t), "^([0-9]+)(?:st|nd|rd|th)$", "$1")))
    out = out.withColumn("_toks", dedupe_consecutive(drop_tokens(each, V.ADDR_STOP_A)))
    return out.withColumns({"addr_clean": joined(F.col("_toks")), "addr_nums": joined(F.filter("_toks", lambda t: t.rlike("[0-9]")))}).drop("_c", "_hits", "_hit", "_rest", "_toks")


def phonetic(c: Column) -> Column:
    """Consonant skeleton of each token; tokens with digits stay."""

    def word(t: Column) -> Column:
        w = t
        for a, b in V.PHONETIC_PAIRS_A:
            w = F.replace(w, F.lit(a), F.lit(b))
        w = F.regexp_replace(F.regexp_replace(w, "c(?=[eiy])", "s"), "g(?=[eiy])", "j")
        w = F.regexp_replace(F.translate(w, "cqxzwydm", "kkksvitn"), "(?<!^)[aeiou]+", "")
        return F.when(t.rlike("[0-9]"), t).otherwise(F.regexp_replace(w, r"(.)\1+", "$1"))

    return joined(F.transform(tokens(c), word))


def clean_frame(df: DataFrame) -> DataFrame:
    """A raw source (entity_id, business_name, business_address, country) as clean records, one per row."""
    out = df.na.fill("").withColumn("country", F.trim(F.lower("country")))
    out = clean_address(clean_name(out, "business_name"), "business_address", "country")
    n_tok = lambda c: F.size(tokens(F.col(c)))
    name = F.when(F.col("name_core") != "", F.col("name_core")).otherwise(F.col("name_clean"))
    return out.withColumns(
        {
            "name_len": F.length("name_core"),
            "addr_len": F.length("addr_clean"),
            "name_ntok": n_tok("name_core"),
            "addr_ntok": n_tok("addr_clean"),
            "name_phon": phonetic(name),
            "addr_phon": phonetic(F.col("addr_clean")),
        }
    ).drop("business_name", "business_address")
