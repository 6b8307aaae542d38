"""URL filter: host and path rules first, then a character language-model ratio, in DataFrame operations only.

Two variable-order Markov models (contexts of 0 to ``order`` characters, Witten-Bell interpolation) are
counted from the URLs that the rules accept and from those they reject. A URL's score is the mean
log-likelihood difference per character; the threshold is calibrated on the same labelled URLs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkloom.llm.common import Cuts, ascii_lower, table

#: (verdict, host, path) of the production rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
ORDER = 4
#: Characters that the uniform start of the interpolation spreads over.
ALPHABET = 256
#: Scores are binned by this width, and clipped to +-RANGE bins, for the calibration (at most 2 * RANGE + 1 rows).
BIN, RANGE = 0.02, 500


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where no ``://`` stands."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    return ascii_lower(raw), F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), "^[^?#]*", 0)


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):  # later, so longer, ones win
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _with_grams(urls: DataFrame, order: int, *carried: str) -> DataFrame:
    """One row (``carried`` columns and gram) for each character of ``text`` and the end mark: the gram that ends there. Cost is
    linear in the text: it is split once, by the first generator, and does not go along."""
    padded = F.concat(F.lit("\u0002" * order), F.col("text"), F.lit("\u0003"))
    chars = urls.select(*carried, F.explode(F.array(F.split(padded, ""))).alias("_c"))
    ends = F.sequence(F.lit(1), F.size("_c") - order)
    return chars.select(*carried, F.explode(F.transform(ends, lambda i: F.array_join(F.slice("_c", i, order + 1), ""))).alias("gram"))


def _gram_scores(cuts: Cuts, grams: DataFrame, order: int) -> DataFrame:
    """(gram, llr) of each distinct gram: the interpolated log probability of its last character under both models.

    Levels build on each other: a tail of k + 1 characters takes the probability of its last k from the level below. So no key
    of any join holds more rows than there are distinct characters, whatever the number of grams.
    """
    counted = cuts.write(grams.groupBy("gram").agg(F.sum("acc").alias("a"), F.sum("rej").alias("r")), "grams")
    sums = [F.sum("na").alias("sa"), F.sum((F.col("na") > 0).cast("int")).alias("ta"), F.sum("nr").alias("sr"), F.sum((F.col("nr") > 0).cast("int")).alias("tr")]

    def mixed(n: str, total: Column, kinds: Column, below: Column) -> Column:
        return F.when(total > 0, (F.col(n) + kinds * below) / (total + kinds)).otherwise(below)

    level = None
    for k in range(order + 1):
        tails = counted.groupBy(F.substring("gram", order + 1 - k, k + 1).alias("tail")).agg(F.sum("a").alias("na"), F.sum("r").alias("nr"))
        if level is None:
            whole = tails.agg(*sums).first()  # one row
            sa, ta, sr, tr = (F.lit(whole[c] or 0) for c in ("sa", "ta", "sr", "tr"))
            below_a = below_r = F.lit(1.0 / ALPHABET)
            found = tails
        else:
            context = F.substring("tail", 1, k)
            totals = tails.groupBy(context.alias("ctx")).agg(*sums)
            found = tails.withColumn("ctx", context).join(totals, "ctx").withColumn("short", F.substring("tail", 2, k))
            found = found.join(level.select(F.col("tail").alias("short"), F.col("pa").alias("qa"), F.col("pr").alias("qr")), "short")
            sa, ta, sr, tr, below_a, below_r = (F.col(c) for c in ("sa", "ta", "sr", "tr", "qa", "qr"))
        level = cuts.write(found.select("tail", mixed("na", sa, ta, below_a).alias("pa"), mixed("nr", sr, tr, below_r).alias("pr")), f"level-{k}")
    return level.select(F.col("tail").alias("gram"), (F.log("pa") - F.log("pr")).alias("llr"))


def _calibrate(scored: DataFrame) -> float:
    """The bin edge that best separates the labelled URLs (accepted share above it minus rejected share); 0 if a class is absent."""
    clipped = F.greatest(F.lit(-RANGE), F.least(F.lit(RANGE), F.floor(F.col("score") / BIN)))
    bins = scored.where("acc + rej > 0").groupBy(clipped.cast("int").alias("b")).agg(F.sum("acc").alias("a"), F.sum("rej").alias("r"))
    rows = sorted(bins.collect())  # at most 2 * RANGE + 1 rows
    all_a, all_r = sum(x[1] for x in rows), sum(x[2] for x in rows)
    if not all_a or not all_r:
        return 0.0
    best, edge, below_a, below_r = 0.0, 0.0, 0, 0
    for b, a, r in rows:
        gain = below_r / all_r - below_a / all_a
        if gain > best + 1e-12:
            best, edge = gain, b * BIN
        below_a, below_r = below_a + a, below_r + r
    return edge


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """One row per input row: ``page_id, host, path, rule, verdict, score, threshold``.

    A null, empty or very long URL is judged like any other: its text (null: empty) gets a score from
    its end mark at least. With no accepted or no rejected URLs to learn from, or in an empty table,
    scores are differences against an empty model or no rows, and the threshold is 0. Ties at the
    threshold are allowed. Rows that repeat an id are judged each on its own URL.
    """
    spark = pages.sparkSession
    cuts = Cuts(spark, "url-filter")
    host, path = url_parts(F.col("url"))
    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    text = ascii_lower(F.col("url"))
    judged = base.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), text.alias("text"))
    # Copies of a URL are modelled and scored once, with their number as weight.
    urls = judged.groupBy("text", "by_rule").agg(F.count(F.lit(1)).alias("n"))
    acc = F.when(F.col("by_rule") == "allow", F.col("n")).otherwise(0)
    rej = F.when(F.col("by_rule") == "block", F.col("n")).otherwise(0)
    urls = cuts.write(urls.select("text", F.monotonically_increasing_id().alias("u"), acc.alias("acc"), rej.alias("rej")), "urls")
    scores = _gram_scores(cuts, _with_grams(urls, order, "acc", "rej"), order)
    # Where no URL is labelled, both models are uniform and every difference is 0.
    # A gram that most URLs hold ("://", "http") makes a skewed key here; its partition can be split, as this is a plain join.
    each = _with_grams(urls, order, "u").join(scores, "gram")
    means = each.groupBy("u").agg((F.sum(F.col("llr").cast("decimal(20,9)")) / F.count(F.lit(1))).cast("double").alias("score"))
    scored = cuts.write(urls.join(means, "u").select("text", "acc", "rej", "score"), "urls-scored")
    cuts.drop("urls", "grams", *[f"level-{k}" for k in range(order + 1)])
    edge = _calibrate(scored)
    by_model = F.when(F.col("score") >= edge, "allow").otherwise("block")
    # Paths that differ in case alone may fall to different rules, but have one text and one score.
    return judged.join(scored.select("text", "score").distinct(), "text").select(
        "page_id", "host", "path", "rule", F.coalesce("by_rule", by_model).alias("verdict"), "score", F.lit(edge).alias("threshold")
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))
