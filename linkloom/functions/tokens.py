"""Column expressions over token arrays; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def squash(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Non-empty space-separated tokens."""
    return F.filter(F.split(c, " "), lambda t: t != "")


def joined(c: Column) -> Column:
    return F.array_join(c, " ")


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def map_tokens(arr: Column, mapping: Mapping[str, str]) -> Column:
    table = literal_map(mapping)
    return F.transform(arr, lambda t: F.coalesce(F.try_element_at(table, t), t))


def drop_tokens(arr: Column, words: Iterable[str]) -> Column:
    gone = F.array(*[F.lit(w) for w in words])
    return F.filter(arr, lambda t: ~F.array_contains(gone, t))


def dedupe_consecutive(arr: Column) -> Column:
    """Drop a token that equals the one before it. The tokens are paired with their predecessors first: an array expression
    inside the lambda would be computed again for each of them."""
    none = F.array(F.lit(None).cast("string"))
    pairs = F.zip_with(arr, F.concat(none, arr), lambda t, before: F.struct(t.alias("t"), before.alias("b")))
    return F.transform(F.filter(pairs, lambda x: x["t"].isNotNull() & ~x["t"].eqNullSafe(x["b"])), lambda x: x["t"])


def collapse_initials(arr: Column) -> Column:
    """Runs of two or more single letters become one token."""
    return tokens(F.regexp_replace(joined(arr), r"(?<=(?:^| )[a-z]) (?=[a-z](?: |$))", ""))


def fix_leet(arr: Column) -> Column:
    """In tokens of letters and digits with two letters or more, digits that look like letters become them (not 6)."""
    mixed = lambda t: t.rlike("[0-9]") & (F.length(F.regexp_replace(t, "[^a-z]", "")) >= 2)
    return F.transform(arr, lambda t: F.when(mixed(t), F.translate(t, "0134578", "oleastb")).otherwise(t))


def initials(c: Column) -> Column:
    return F.array_join(F.transform(F.split(c, " "), lambda t: F.substring(t, 1, 1)), "")


def glued(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def char_wb_grams(c: Column, n: int = 3) -> Column:
    """Character n-grams inside tokens padded by one space; a padded token shorter than n is one gram."""
    padded = F.transform(tokens(c), lambda t: F.concat(F.lit(" "), t, F.lit(" ")))
    each = F.transform(padded, lambda p: F.when(F.length(p) <= n, F.array(p)).otherwise(F.transform(F.sequence(F.lit(1), F.length(p) - (n - 1)), lambda i: F.substring(p, i, F.lit(n)))))
    return F.flatten(each)


def word_grams(c: Column) -> Column:
    """Single tokens and pairs of neighbours."""
    t = tokens(c)
    pairs = F.zip_with(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))), F.slice(t, 2, F.greatest(F.size(t), F.lit(1))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(t, pairs)


def bool_flag(c: Column) -> Column:
    return F.coalesce(c, F.lit(False)).cast("double")
