"""Exact substring dedup over a phrase parse: every byte of a long string that starts twice is removed.

Rolling-hash triggers cut each text into phrases: a trigger is the smallest rolling hash of the first
``REACH`` places of a window, so a window's trigger and its offset depend on the window's bytes alone,
wherever it stands. The windows that one trigger governs are one phrase. The dictionary holds distinct
phrases with their surroundings; phrases that occur again are settled as a whole. Only at the edges of
repeated regions, where phrases differ, are the dictionary's phrases resolved further, by blocks of
windows at equal offsets from equal triggers and at last by single windows.

Order among different strings is never needed here, only equality, so the classes come from 128-bit
hashes (two of 64 bits, of different bases) of phrase suffixes with what follows them, not from materialised suffix arrays
(see README for the figures). A single 64-bit hash of a phrase's core only decides what is looked at further.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import Cuts, RollingHash, mix64, slices, table

#: Bytes of a string that must not start twice; bytes hashed for a trigger; places a trigger is looked for in.
LENGTH, GRAM, REACH = 200, 16, 150
#: Windows in a block of the second level.
STEP = 8
SLICE = 1_500_000


def row_key(doc_id: Column, text: Column) -> Column:
    """Rows that repeat both id and text share a key; each of them counts as an occurrence."""
    return F.xxhash64(doc_id, text)


class Hashes:
    """Two independent rolling hashes of the same bytes; only the first finds triggers."""

    def __init__(self, most: int):
        self.one, self.two = RollingHash(most), RollingHash(most, seed=23, base=0xD1342543DE82EF95)


def reach_of(length: int) -> tuple[int, int]:
    """(bytes hashed for a trigger, places a trigger is looked for in) of windows of ``length`` bytes."""
    gram = min(GRAM, length)
    return gram, min(REACH, length - gram + 1)


def phrases(roll: Hashes, texts: list[bytes], length: int = LENGTH, whole: bool = True) -> tuple[np.ndarray, ...]:
    """Arrays over all phrases: text index, trigger place, least and greatest offset of governed windows, core hash, and (``whole``)
    both full hashes."""
    gram, reach = reach_of(length)
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(sizes) - sizes
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if len(buf) < length:
        return none
    prefix = roll.one.prefix(buf)
    places = np.arange(len(buf) - gram + 1)
    bits = np.uint64(max(1, int(len(buf)).bit_length()))
    least = (roll.one.spans(prefix, places, places + gram) >> bits << bits) | places.astype(np.uint64)
    width = 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < reach:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    starts = len(buf) - length + 1
    trigger = (least[:starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    text = np.repeat(np.arange(len(texts)), sizes)[:starts]
    place = np.arange(starts)
    valid = place + length <= (begin + sizes)[text]
    i, owner, at = place[valid], text[valid], trigger[valid]
    if not len(i):
        return none
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
    last = np.r_[new[1:], len(i)] - 1
    lo, hi, at, owner = i[new], i[last], at[new], owner[new]
    core = roll.one.spans(prefix, at, at + length - reach + 1)
    both = [_shifted(h.spans(p, lo, hi + length), at - lo) for h, p in ((roll.one, prefix), (roll.two, roll.two.prefix(buf)))] if whole else [core, core]
    return owner, at - begin[owner], at - hi, at - lo, core, *both


def _shifted(h: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Hashes of strings together with where they stand."""
    return mix64(h + offset.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def window_blocks(roll: Hashes, text: bytes, at: np.ndarray, low: np.ndarray, high: np.ndarray, step: int, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """For phrases of one text: index of the phrase, and for each block of windows its least
    and greatest offset, the hash of what all its windows share, and both hashes of its bytes."""
    data = np.frombuffer(text, np.uint8)
    prefix = roll.one.prefix(data)
    first, count = low // step, high // step - low // step + 1
    which = np.repeat(np.arange(len(at)), count)
    block = first[which] + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    lo, hi = np.maximum(low[which], block * step), np.minimum(high[which], block * step + step - 1)
    both = [_shifted(h.spans(p, at[which] - hi, at[which] - lo + length), hi) for h, p in ((roll.one, prefix), (roll.two, roll.two.prefix(data)))]
    # Bytes that every window of the block holds, wherever the phrase cuts the block short.
    inner = roll.one.spans(prefix, at[which] - block * step, at[which] - (block * step + step - 1) + length) + block.astype(np.uint64)
    return which, lo, hi, mix64(inner), *both


_PHRASES = "row bigint, at int, low smallint, high smallint, core bigint, h bigint, h2 bigint"
_KINDS = pa.schema([("row", pa.int64()), ("at", pa.int32()), ("low", pa.int16()), ("high", pa.int16()), ("core", pa.int64()), ("h", pa.int64()), ("h2", pa.int64())])


def _cores(base: DataFrame, length: int) -> DataFrame:
    """The core of every phrase."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Hashes(SLICE + SLICE // 2)
        for _, texts in (pair for batch in batches for pair in slices([batch], "text", SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(phrases(roll, texts, length, whole=False)[4].view(np.int64))], names=["core"])

    return base.mapInArrow(run, "core bigint")


def _parse(base: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Hashes(SLICE + SLICE // 2)
        for batch, texts in slices(batches, "text", SLICE):
            owner, at, low, high, core, full, second = phrases(roll, texts, length)
            rows = batch.column(0).to_numpy()[owner] if len(owner) else np.zeros(0, np.int64)
            values = (rows, at.astype(np.int32), low.astype(np.int16), high.astype(np.int16), core.view(np.int64), full.view(np.int64), second.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in values], schema=_KINDS)

    return base.mapInArrow(run, _PHRASES)


def _resolve(texts: DataFrame, step: int, length: int) -> DataFrame:
    """Blocks of ``step`` windows of the listed phrases: ``texts`` has row, text and phrases (structs of at, low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roll = Hashes(SLICE)
        for batch, bodies in slices(batches, "text", SLICE):
            listed = batch.column(batch.schema.get_field_index("phrases"))
            rows = batch.column(batch.schema.get_field_index("row")).to_pylist()
            ends = listed.offsets.to_numpy()
            at, low, high = (listed.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            for k, body in enumerate(bodies):
                s, e = ends[k], ends[k + 1]
                which, lo, hi, inner, h, h2 = window_blocks(roll, body, at[s:e], low[s:e], high[s:e], step, length)
                values = (np.full(len(which), rows[k]), at[s:e][which].astype(np.int32), lo.astype(np.int16), hi.astype(np.int16), inner.view(np.int64), h.view(np.int64), h2.view(np.int64))
                for column, v in zip(out, values, strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], schema=_KINDS)

    return texts.mapInArrow(run, _PHRASES)


def find_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", cuts: Cuts | None = None) -> tuple[DataFrame, DataFrame]:
    """(base, starts): rows with key and text, and for each row the ranges [first, last] of window places whose bytes start elsewhere as well."""
    cuts = cuts or Cuts(docs.sparkSession, "repeats")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text.alias("text")).withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    keyed = base.select("row", "text")
    twice = lambda df, *by: df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    # Phrases (at the next level: blocks) whose core occurs once hold no repeated window: most of the corpus ends here.
    found, held = _parse(keyed, length), None
    ranges = []
    for step, name in ((STEP, "blocks"), (1, "windows")):
        cores = cuts.write(twice(_cores(keyed, length) if held is None else found.select("core"), "core"), f"{name}-cores")
        todo = cuts.write(found.join(cores, "core", "left_semi").select("row", "at", "low", "high", "core", "h", "h2"), f"{name}-todo")
        again = cuts.write(twice(todo, "h", "h2").withColumn("again", F.lit(True)), f"{name}-again")
        marked = cuts.write(todo.join(again, ["h", "h2"], "left").select("row", "at", "low", "high", "core", "h", "h2", F.coalesce("again", F.lit(False)).alias("again")), f"{name}-marked")
        cuts.drop(f"{name}-todo", f"{name}-again", f"{name}-cores")
        ranges.append(marked.where("again"))
        # The unsettled ones, and one of each settled kind that they may share windows with (the same core).
        open_ = marked.where("not again").select("row", "at", "low", "high", "core")
        shown = marked.where("again").groupBy("h", "h2").agg(F.min(F.struct("row", "at", "low", "high", "core")).alias("p")).select("p.*")
        listed = open_.union(shown.join(open_.select("core").distinct(), "core", "left_semi").select("row", "at", "low", "high", "core"))
        listed = listed.groupBy("row").agg(F.collect_list(F.struct("at", "low", "high")).alias("phrases"))
        if held is None:
            held = cuts.write(keyed.join(listed, "row").dropDuplicates(["row"]), "texts")
            texts = held
        else:
            texts = held.select("row", "text").join(listed, "row")
        found = cuts.write(_resolve(texts, step, length), name)
    todo = found
    again = twice(todo, "h", "h2")
    ranges.append(todo.join(again, ["h", "h2"], "left_semi"))
    spans = [r.select("row", (F.col("at") - F.col("high")).alias("s"), (F.col("at") - F.col("low")).alias("e")) for r in ranges]
    starts = spans[0].union(spans[1]).union(spans[2]).distinct().groupBy("row").agg(F.collect_list(F.struct("s", "e")).alias("starts"))
    return base, starts


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes, concatenated).

    Texts are UTF-8 bytes; null is empty. Each byte covered by a ``length``-byte string that also starts
    anywhere else goes, in all its occurrences; strings are judged on the input and never cross texts.
    Texts shorter than ``length`` stay whole. Rows that repeat id and text are occurrences of each other.
    An empty table gives an empty result. Other columns are not read.
    """
    base, starts = find_repeats(docs, length, id_col, text_col)
    joined = base.join(starts, "row", "left").select("doc_id", "text", "starts")
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE):
            listed = batch.column(2)
            ends = listed.offsets.to_numpy()
            s, e = (listed.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            removed, spans, kept = [], [], []
            for k, text in enumerate(texts):
                a, b = ends[k], ends[k + 1]
                if not listed[k].is_valid or a == b:
                    removed.append(0)
                    spans.append(0)
                    kept.append(text)
                    continue
                edge = np.zeros(len(text) + 1, np.int64)
                np.add.at(edge, s[a:b], 1)
                np.add.at(edge, e[a:b] + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.r_[False, gone[:-1]]).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary())], schema=kinds
            )

    return joined.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
