"""Shared helpers of the corpus operators: lineage cuts, bounded batches, byte hashes."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_OWN_DIR: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir); a temporary one where that is unset and all runs on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="linkloom-"))
    return f"file://{_OWN_DIR[0]}"


class Cuts:
    """Written tables in the shared folder that cut lineage: a lost executor never costs more than one step."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, step: str) -> DataFrame:
        path = f"{self.base}/{step}"
        df.write.option("compression", "zstd").parquet(path)
        gc.collect()  # frees the shuffle files of what was just written
        self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *steps: str) -> None:
        """Delete tables that nothing returned still reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for step in steps:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{step}")
            path.getFileSystem(conf).delete(path, True)


def ascii_lower(col: Column) -> Column:
    """A-Z to lower case, nothing else; null becomes empty."""
    return F.translate(F.coalesce(col.cast("string"), F.lit("")), UPPER, LOWER)


def text_key(text: Column) -> Column:
    """128-bit digest of a text, by which its row is known beside the id; null and empty are one text."""
    return F.md5(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 6_000_000) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Sub-batches holding about ``most`` text bytes (a longer text stands alone), with their texts as UTF-8; null is empty."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        col = batch.column(at).cast(pa.binary())
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0), dtype=np.int64)
        ends, start, total = [], 0, 0
        for i, n in enumerate(sizes.tolist()):
            if total and total + n > most:
                ends.append(i)
                total = 0
            total += n
        for stop in [*ends, batch.num_rows]:
            part = col.slice(start, stop - start)
            yield batch.slice(start, stop - start), [b or b"" for b in part.to_pylist()]
            start = stop


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


class RollingHash:
    """Polynomial prefix hashes (mod 2**64, odd base, random byte values) of up to ``most`` bytes."""

    def __init__(self, most: int, seed: int = 7, base: int = 0x9E3779B97F4A7C15):
        self.seed, self.base = seed, base
        self.values = np.random.default_rng(seed).integers(1, 2**63, 256).astype(np.uint64)
        self.up, self.down = (self._powers(b, most) for b in (base, pow(base, -1, 2**64)))

    @staticmethod
    def _powers(base: int, most: int) -> np.ndarray:
        out = np.full(most + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def grow(self, n: int) -> None:
        if n >= len(self.up):
            self.__init__(n + n // 4, self.seed, self.base)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """h with h[i] - h[j] the hash of data[j:i], times base**j."""
        self.grow(len(data))
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of the spans [start, end); equal for equal bytes wherever they stand."""
        h = (prefix[end] - prefix[start]) * self.down[start]
        h += (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return mix64(h)


_SPACES = np.zeros(256, bool)
_SPACES[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(roll: RollingHash, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of A-Z lower-cased texts: hashes, byte starts and ends in their own text, and the
    index of each text's first word (one more at the end)."""
    buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    begins = np.cumsum(sizes) - sizes
    gap = _SPACES[buf]
    start = np.flatnonzero(~gap & np.r_[True, gap[:-1]])
    end = np.flatnonzero(gap & np.r_[False, ~gap[:-1]])
    hashes = roll.spans(roll.prefix(_LOWER[buf]), start, end)
    first = np.searchsorted(start, np.r_[begins, len(buf)])
    own = np.repeat(begins, np.diff(first))
    return hashes, start - own, end - own, first


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k neighbouring words (as many as words - k + 1); fewer words than k make one shingle."""
    if not len(words):
        return words[:0]
    if len(words) < k:
        n, k = 1, len(words)
    else:
        n = len(words) - k + 1
    h = np.full(n, np.uint64(k))
    with np.errstate(over="ignore"):
        for i in range(k):
            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + words[i : i + n]
    return mix64(h)
