"""MinHash near-dedup: one-permutation hashing with optimal densification, banded buckets, star edges.

Documents with the same shingle set meet first and are one node. The others share a bucket where all
bins of a band agree; each bucket gives star-shaped candidate edges (to its smallest and its largest
node), so the number of pairs grows with nodes times bands, whatever the size of a bucket. Every
candidate is confirmed on the full sets. Buckets whose nodes still lie in several components after
that are looked at once more: only there are nodes of different components compared, so that no link
that a bucket shows is lost. Small buckets give pairs; large ones are compared in blocks from which
only links come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import Cuts, RollingHash, mix64, shingle_hashes, slices, table, text_key, word_hashes

SHINGLE, PERCENT = 5, 75
#: Rows in a band and bands: a pair at 0.75 shares no bucket with probability (1 - 0.75**5)**48, about 2 in a million.
ROWS, BANDS = 5, 48
SLICE = 1_500_000
#: Buckets of up to this many nodes are compared pair by pair; larger ones by families, in blocks of about this many shingles.
SMALL, BLOCK_SHINGLES = 24, 100_000


class Sketcher:
    """One-permutation MinHash signatures as band hashes."""

    def __init__(self, rows: int = ROWS, bands: int = BANDS, seed: int = 11):
        self.rows, self.bands, self.bins = rows, bands, rows * bands
        rng = np.random.default_rng(seed)
        # For each bin its own random order of all bins: an empty bin copies the first filled one in its order.
        self.order = np.argsort(rng.random((self.bins, self.bins)), axis=1).argsort(axis=1).astype(np.int16)
        self.salt = rng.integers(0, 2**63, bands).astype(np.uint64)

    def bands_of(self, shingles: np.ndarray) -> np.ndarray:
        """Band hashes of a sorted, distinct, non-empty array of 64-bit shingle hashes."""
        at = ((shingles >> np.uint64(32)) * np.uint64(self.bins)) >> np.uint64(32)
        filled, first = np.unique(at, return_index=True)
        filled = filled.astype(np.int64)
        sig = np.zeros(self.bins, np.uint64)
        sig[filled] = shingles[first]
        if len(filled) < self.bins:
            empty = np.setdiff1d(np.arange(self.bins), filled, assume_unique=True)
            sig[empty] = sig[filled[self.order[np.ix_(empty, filled)].argmin(axis=1)]]
        h = self.salt.copy()
        for row in sig.reshape(self.bands, self.rows).T:
            h = mix64(h * np.uint64(0xC2B2AE3D27D4EB4F) + row)
        return h


def shingle_sets(roll: RollingHash, texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, _, _, first = word_hashes(roll, texts)
    for s, e in zip(first[:-1], first[1:], strict=True):
        yield np.unique(shingle_hashes(words[s:e], k))


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    kinds = pa.schema([("doc_id", pa.int64()), ("row_key", pa.string()), ("n", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll, sketcher = RollingHash(SLICE + SLICE // 2), Sketcher()
        for batch, texts in slices(batches, "text", SLICE):
            sizes, keys, bands = [], [], []
            for s in shingle_sets(roll, texts, k):
                sizes.append(len(s))
                if len(s):
                    b = sketcher.bands_of(s)
                    with np.errstate(over="ignore"):
                        keys.append(np.array([s.sum(), mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(), len(s)], np.uint64).tobytes())
                    bands.append(b.view(np.int64))
                else:
                    keys.append(None)
                    bands.append(np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, bands)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(bands)))], schema=kinds
            )

    return docs.mapInArrow(run, "doc_id bigint, row_key string, n bigint, set_key binary, bands array<bigint>")


def _sets(docs: DataFrame, k: int) -> DataFrame:
    kinds = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = RollingHash(SLICE + SLICE // 2)
        for batch, texts in slices(batches, "text", SLICE):
            sets = [s.view(np.int64) for s in shingle_sets(roll, texts, k)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))], schema=kinds)

    return docs.mapInArrow(run, "node bigint, shingles array<bigint>")


def components(cuts: Cuts, edges: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node of each node's component, by label propagation with pointer jumps.

    ``edges`` has columns a and b. Each round is written, so a lost executor costs one round.
    """
    both = cuts.write(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-both")
    labels = cuts.write(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    step = 0
    while True:
        step += 1
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        moved = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        hops = moved.select(F.col("node").alias("label"), F.col("label").alias("hop"))
        after = moved.join(hops, "label", "left").select("node", F.least("label", F.coalesce("hop", "label")).alias("label"), "was")
        after = cuts.write(after, f"{name}-{step}")
        cuts.drop(f"{name}-{step - 1}")
        changed = after.where("label <> was").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            cuts.drop(f"{name}-both")
            return labels


def _families(cuts: Cuts, large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links across components in large buckets (node, n, label, low: the bucket's smallest node).

    Buckets that share nodes form a family. Its nodes outside its most frequent component are compared with all its
    nodes, in blocks of bounded size, on full sets; only links leave a block, one for each node and component met.
    """
    # Buckets are known by their smallest node: a node ties its buckets to the smallest of those, and few such ties are distinct.
    tops = large.groupBy("node").agg(F.min("low").alias("top"))
    ties = large.join(tops, "node").where("low <> top").select(F.col("top").alias("a"), F.col("low").alias("b")).distinct()
    family = components(cuts, ties, "families").select(F.col("node").alias("top"), F.col("label").alias("family"))
    nodes = large.select("node", "n", "label").distinct().join(tops, "node").join(family, "top", "left").select("node", "n", "label", F.coalesce("family", "top").alias("family"))
    nodes = cuts.write(nodes, "family-nodes")
    votes = nodes.groupBy("family", "label").agg(F.count(F.lit(1)).alias("c"))
    main = votes.groupBy("family").agg(F.min_by("label", F.struct(-F.col("c"), F.col("label"))).alias("main"))
    parts = nodes.join(main, "family")
    blocks = parts.groupBy("family", "main").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("n_all"), F.greatest(F.lit(1), F.ceil(F.sum(F.when(F.col("label") != F.col("main"), F.col("n"))) / BLOCK_SHINGLES)).cast("int").alias("n_rest")
    )
    parts = nodes.join(blocks, "family").select("node", "n", "label", "family", "main", "n_all", "n_rest")
    at = lambda count: F.pmod(F.xxhash64("node"), F.col(count)).cast("int")
    every = parts.select("node", "label", "family", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), F.col("n_rest") - 1)).alias("i"), at("n_all").alias("j"))
    rest = parts.where("label <> main").select("node", "label", "family", F.lit(0).alias("side"), at("n_rest").alias("i"), F.explode(F.sequence(F.lit(0), F.col("n_all") - 1)).alias("j"))
    dealt = every.union(rest).join(sets, "node")

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] == 0].sort_values("node"), rows[rows["side"] == 1].sort_values("node")
        if not len(left) or not len(right):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        size = [side["shingles"].map(len).to_numpy() for side in (left, right)]
        flat = [np.concatenate(side["shingles"].to_list()) for side in (left, right)]
        shared = np.intersect1d(*(np.unique(f) for f in flat))
        inter = np.zeros((len(left), len(right)), np.float32)
        columns = [np.searchsorted(shared, f) for f in flat]
        hits = [(c < len(shared)) & (shared[np.minimum(c, len(shared) - 1)] == f) if len(shared) else np.zeros(len(f), bool) for c, f in zip(columns, flat, strict=True)]
        owner = [np.repeat(np.arange(len(s)), s)[h] for s, h in zip(size, hits, strict=True)]
        columns = [c[h] for c, h in zip(columns, hits, strict=True)]
        for lo in range(0, len(shared), 4096):
            dense = []
            for side in (0, 1):
                part = (columns[side] >= lo) & (columns[side] < lo + 4096)
                m = np.zeros((len(size[side]), min(4096, len(shared) - lo)), np.float32)
                m[owner[side][part], columns[side][part] - lo] = 1
                dense.append(m)
            inter += dense[0] @ dense[1].T
        union = size[0][:, None] + size[1][None, :] - inter
        lab = [side["label"].to_numpy() for side in (left, right)]
        a, b = np.nonzero((inter * 100 >= union * percent) & (lab[0][:, None] != lab[1][None, :]))
        out = pd.DataFrame({"a": left["node"].to_numpy()[a], "b": right["node"].to_numpy()[b], "label": lab[1][b]})
        return out.drop_duplicates(["a", "label"])[["a", "b"]]

    return dealt.groupBy("family", "i", "j").applyInPandas(links, "a bigint, b bigint")


def near_dedup(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept, row_key, first``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a document's set holds its distinct k-word
    shingles, or its whole sequence where it has fewer words. Documents are linked where the shared part
    is ``percent`` of the union or more; a component's smallest id stays. Null texts and texts without
    words have no set and stand alone. Rows that repeat an id are judged each by its own text, and all rows with a component's
    smallest id are kept; a null id is never the smallest, unless it is the only one. ``first`` marks the one row (with its copies
    under its id) of each component that stays where one is asked for; ``row_key`` is the text's MD5. Ties and copies need no order: the result
    depends on ids and texts alone. An empty table gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark, "near-dedup")
    text = F.col(text_col).cast("string")
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(text).alias("row_key"), text.alias("text"))
    rows = cuts.write(_sketches(base, k), "sketches")
    # A node is a set, numbered in the order of the smallest id that has it (and the smallest text under that id).
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")).alias("f")
    nodes = rows.where("n > 0").groupBy("set_key").agg(first, F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = nodes.orderBy("f", "set_key").select(F.monotonically_increasing_id().alias("node"), "set_key", "f.doc_id", "f.row_key", "n", "bands")
    nodes = cuts.write(nodes, "nodes")
    buckets = nodes.select("node", "n", F.posexplode("bands").alias("band", "h"))
    stars = buckets.groupBy("band", "h").agg(F.min(F.struct("node", "n")).alias("low"), F.max(F.struct("node", "n")).alias("high")).where("low.node < high.node")
    stars = cuts.write(stars, "stars")
    # Members of buckets with two nodes or more.
    members = cuts.write(buckets.join(stars, ["band", "h"]).select("band", "h", "node", "n", "low", "high"), "members")
    ends = members.select(F.struct("node", "n").alias("x"), F.explode(F.array("low", "high")).alias("y")).where("x.node <> y.node")
    pair = lambda p, q: [F.col(f"{p}.node").alias("a"), F.col(f"{p}.n").alias("na"), F.col(f"{q}.node").alias("b"), F.col(f"{q}.n").alias("nb")]
    tried = cuts.write(ends.select(F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).select(*pair("p", "q")).distinct(), "tried")
    # Full sets of the nodes that share a bucket; the texts of all others stay where they are.
    wanted = nodes.select("node", "doc_id", "row_key").join(members.select("node").distinct(), "node", "left_semi").alias("w")
    one = base.alias("d").join(wanted, (F.col("d.row_key") == F.col("w.row_key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id"))).select("node", "text")
    sets = cuts.write(_sets(one.dropDuplicates(["node"]), k), "sets")

    def confirm(pairs: DataFrame, name: str) -> DataFrame:
        sized = pairs.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
        full = sized.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
        shared = full.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).cast("bigint").alias("i"))
        return cuts.write(shared.where(F.col("i") * 100 >= (F.col("na") + F.col("nb") - F.col("i")) * percent).select("a", "b"), name)

    links = confirm(tried, "links")
    labels = components(cuts, links, "near")
    # Buckets whose nodes lie in several components: compare across components there.
    named = members.join(labels, "node", "left").select("band", "h", "node", "n", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("band", "h").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("m"), F.min("node").alias("low")).where("lo < hi").select("band", "h", "m", "low")
    named = cuts.write(named.join(mixed, ["band", "h"]), "mixed")
    small = named.where(F.col("m") <= SMALL)
    x, y = small.alias("x"), small.alias("y")
    across = (F.col("x.band") == F.col("y.band")) & (F.col("x.h") == F.col("y.h")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label"))
    sized = (F.least("x.n", "y.n") * 100 >= F.greatest("x.n", "y.n") * percent)
    more = x.join(y, across & sized).select(*pair("x", "y")).distinct().join(tried, ["a", "b"], "left_anti")
    found = confirm(cuts.write(more, "more"), "more-links")
    large = cuts.write(named.where(F.col("m") > SMALL).select("node", "n", "label", "low").distinct(), "large")
    if large.limit(1).count():
        found = cuts.write(found.union(_families(cuts, large, sets, percent)), "all-links")
    if found.limit(1).count():
        labels = components(cuts, links.union(found), "all")
    cuts.drop("stars", "members", "tried", "sets", "links", "mixed", "more", "more-links", "large", "all-links", "family-nodes")
    ids = nodes.select(F.col("node").alias("label"), F.col("doc_id").alias("component_id"), F.col("row_key").alias("first_key"))
    named_sets = nodes.select("node", "set_key").join(labels, "node", "left").select("set_key", F.coalesce("label", "node").alias("label")).join(ids, "label").select("set_key", "component_id", "first_key")
    named = F.col("first_key").isNotNull()
    smallest = F.when(named, F.col("component_id")).otherwise(F.col("doc_id"))
    kept = F.col("doc_id").eqNullSafe(smallest)
    return rows.join(named_sets, "set_key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), smallest.alias("component_id"), kept.alias("kept"), "row_key", (kept & (~named | (F.col("row_key") == F.col("first_key")))).alias("first")
    )


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")
