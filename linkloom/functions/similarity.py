"""String similarities as Arrow-batched functions, scale 0 to 1.

``indel_ratio`` is 2 * LCS / (len(a) + len(b)); the LCS is bit-parallel, one Python integer for a row of the
table. Two empty strings are equal (1.0).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return 0
    full = (1 << len(a)) - 1
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    if a == b:
        return 1.0
    total = len(a) + len(b)
    return 2.0 * lcs_length(a, b) / total if total else 1.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter string with a window of the longer of its length, cut ones at both ends included."""
    if len(a) == len(b):
        return max(_windows(a, b), _windows(b, a))
    return _windows(a, b) if len(a) < len(b) else _windows(b, a)


def _windows(a: str, b: str) -> float:
    if not a:
        return 1.0 if not b else 0.0
    if a in b:
        return 1.0
    chars, n, best = set(a), len(a), 0.0
    for i in range(1 - n, len(b)):
        lo, hi = max(0, i), min(len(b), i + n)
        # A window that matches best starts (or, cut short, ends) with a character of the shorter string.
        if (b[lo] in chars if i >= 0 else b[hi - 1] in chars) or hi - lo == n and b[hi - 1] in chars:
            best = max(best, indel_ratio(a, b[lo:hi]))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among the shared words and the shared words with either side's rest; no words on a side: 0."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, one, two = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not one or not two):
        return 1.0
    shared, left, right = " ".join(both), " ".join(both + one), " ".join(both + two)
    best = indel_ratio(left, right)
    return max(best, indel_ratio(shared, left), indel_ratio(shared, right)) if both else best


def jaro_winkler(a: str, b: str, weight: float = 0.1) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, mine = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                mine.append(ch)
                break
    m = len(mine)
    if not m:
        return 0.0
    theirs = [b[j] for j in range(len(b)) if used[j]]
    t = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - t) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > 0.7 else jaro


def token_misses(a: str, b: str, least: float = 0.8) -> int:
    """Words of ``a`` that no word of ``b`` matches at this ratio."""
    others = b.split() or [""]
    return sum(max(indel_ratio(t, u) for u in others) < least for t in a.split())


#: Measures by name, for ``measured``.
KINDS = {"ratio": indel_ratio, "partial": partial_ratio, "tsort": token_sort_ratio, "tset": token_set_ratio, "jw": jaro_winkler, "miss": token_misses}


def measured(df: DataFrame, wanted: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Adds a double for each measure (name: kind, left column, right column), all from one Arrow pass; null where a side is null.

    A batch holds each distinct pair of texts once for a kind, so repeated names cost one look.
    """
    sides = sorted({c for _, a, b in wanted.values() for c in (a, b)})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        memo: dict[str, dict] = {kind: {} for kind, _, _ in wanted.values()}
        texts = {c: rows[c].tolist() for c in sides}
        out = {}
        for name, (kind, a, b) in wanted.items():
            fn, seen, values = KINDS[kind], memo[kind], []
            for pair in zip(texts[a], texts[b], strict=True):
                if pair not in seen:
                    seen[pair] = None if pair[0] is None or pair[1] is None else float(fn(*pair))
                values.append(seen[pair])
            out[name] = pd.Series(values, dtype="float64")
        return pd.DataFrame(out)

    kind = T.StructType([T.StructField(name, T.DoubleType()) for name in wanted])
    return df.withColumn("_measures", F.pandas_udf(run, kind)(F.struct(*sides))).select(*[F.col(f"`{c}`") for c in df.columns], "_measures.*")


def _pairwise(fn, kind):  # noqa: ANN001, ANN202
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        memo: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a, b, strict=True):
            if pair[0] is None or pair[1] is None:
                out.append(None)
                continue
            if pair not in memo:
                memo[pair] = fn(*pair)
            out.append(memo[pair])
        return pd.Series(out, dtype=object)

    return F.pandas_udf(run, kind)


def ratio(a: Column, b: Column) -> Column:
    return _pairwise(indel_ratio, T.DoubleType())(a, b)


def partial(a: Column, b: Column) -> Column:
    return _pairwise(partial_ratio, T.DoubleType())(a, b)


def token_sort(a: Column, b: Column) -> Column:
    return _pairwise(token_sort_ratio, T.DoubleType())(a, b)


def token_set(a: Column, b: Column) -> Column:
    return _pairwise(token_set_ratio, T.DoubleType())(a, b)


def jaro_winkler_sim(a: Column, b: Column) -> Column:
    return _pairwise(jaro_winkler, T.DoubleType())(a, b)


def misses(a: Column, b: Column) -> Column:
    return _pairwise(token_misses, T.IntegerType())(a, b)


def dot(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
