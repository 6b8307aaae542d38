"""Files around the stages: sizes of sources, pruned readers, parts, mirrors with a size cap, progress. All through Hadoop's file systems."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.sources.tables import _path, exists, write_json

#: Files above this many bytes stay out of a mirror.
MIRROR_MOST = 25 * 1024 * 1024


def source_sizes(sources: dict[str, DataFrame]) -> DataFrame:
    """(source, n): rows of each source; for Parquet the footers answer."""
    out = None
    for name, df in sources.items():
        part = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("source"), "n")
        out = part if out is None else out.unionByName(part)
    return out


def read_part(spark: SparkSession, path: str, columns: Sequence[str] = (), country: str | None = None) -> DataFrame:
    """A Parquet source with these columns alone, of one country where one is given; both reach the scan."""
    df = spark.read.parquet(path)
    if country is not None:
        df = df.where(F.col("country") == country)
    return df.select(*columns) if columns else df


def list_parts(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob pattern, sorted."""
    path, fs = _path(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(path) or []))


def read_parts(spark: SparkSession, pattern: str) -> DataFrame:
    """One table of all Parquet parts that match a glob pattern."""
    found = list_parts(spark, pattern)
    if not found:
        raise FileNotFoundError(pattern)
    return spark.read.option("mergeSchema", "true").parquet(*found)


def build_parts(
    spark: SparkSession, folder: str, parts: dict[str, Callable[[], DataFrame]], post: Callable[[DataFrame], DataFrame] | None = None, skip: Callable[[str], bool] | None = None, keep=None  # noqa: ANN001
) -> list[str]:
    """Write each named part that is not complete yet; ``keep`` (a condition) filters its rows, ``post`` transforms it, ``skip`` leaves
    a name out. Returns the names written. A part is visible once its success mark is."""
    done = []
    for name, make in parts.items():
        path = f"{folder}/{name}"
        if (skip and skip(name)) or exists(spark, f"{path}/_SUCCESS"):
            continue
        df = make()
        df = df.where(keep) if keep is not None else df
        (df.transform(post) if post else df).write.mode("overwrite").option("compression", "zstd").parquet(path)
        done.append(name)
    return done


def mirror(spark: SparkSession, source: str, target: str, most: int = MIRROR_MOST) -> dict[str, list[str]]:
    """Copy the files of a folder that are not in the target yet with that size; larger ones than ``most`` are left and named."""
    src, fs = _path(spark, source)
    out: dict[str, list[str]] = {"copied": [], "same": [], "too_large": []}
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    base = fs.makeQualified(src).toUri().getPath().rstrip("/")
    found = fs.listFiles(src, True)
    while found.hasNext():
        status = found.next()
        name = status.getPath().toUri().getPath()[len(base) + 1 :]
        to, to_fs = _path(spark, f"{target}/{name}")
        if status.getLen() > most:
            out["too_large"].append(name)
        elif to_fs.exists(to) and to_fs.getFileStatus(to).getLen() == status.getLen():
            out["same"].append(name)
        else:
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, status.getPath(), to_fs, to, False, conf)
            out["copied"].append(name)
    return {k: sorted(v) for k, v in out.items()}


def fetch(spark: SparkSession, path: str, *mirrors: str) -> str:
    """The first of a path and its mirrors that exists."""
    for candidate in (path, *mirrors):
        if exists(spark, candidate):
            return candidate
    raise FileNotFoundError(path)


class Progress:
    """A JSON file that says which stage a run is in, how much of it is done, and for how long it has run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.began = spark, path, time.time()

    def note(self, stage: str, done: int, total: int) -> None:
        share = round(done / total, 4) if total else 1.0
        write_json(self.spark, self.path, {"stage": stage, "done": done, "total": total, "share": share, "seconds": round(time.time() - self.began, 1)})

    def read(self) -> dict:
        path, fs = _path(self.spark, self.path)
        with_lines = self.spark.read.text(str(fs.makeQualified(path).toString()), wholetext=True).first()
        return json.loads(with_lines[0])
