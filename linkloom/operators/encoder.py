"""Hashed n-gram views of records, with trainable bucket weights.

A record's view is the weighted, signed sum of its n-grams' hashed directions, scaled to length one. Weights start
at 1 (untrained) and can be fitted by contrastive steps in numpy on a bounded sample of true pairs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.operators import knn
from linkloom.shipping import ship

BUCKETS = 1 << 14


def gram_ids(text: str, n: Sequence[int] = (2, 3), buckets: int = BUCKETS) -> np.ndarray:
    if not text:
        return np.zeros(0, np.int64)
    data = np.frombuffer(f" {text} ".encode(), np.uint8).astype(np.uint64)
    out = []
    for k in n:
        if len(data) < k:
            continue
        h = np.full(len(data) - k + 1, np.uint64(k))
        with np.errstate(over="ignore"):
            for i in range(k):
                h = h * np.uint64(0x9E3779B97F4A7C15) + data[i : len(data) - k + 1 + i]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        out.append((h >> np.uint64(33)) % np.uint64(buckets))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


class Encoder:
    """dims-long unit vectors; ``weights`` has one number for each bucket, never under ``LEAST``."""

    LEAST = 0.01

    def __init__(self, dims: int = 64, buckets: int = BUCKETS, seed: int = 3):
        self.dims, self.buckets = dims, buckets
        self.weights = np.ones(buckets)
        self.directions = np.random.default_rng(seed).choice([-1.0, 1.0], size=(buckets, dims)).astype(np.float32)

    def _sums(self, ids: Sequence[np.ndarray]) -> np.ndarray:
        """The weighted sum of each row's directions; rows without grams are zero."""
        out, sizes = np.zeros((len(ids), self.dims)), np.array([len(x) for x in ids], dtype=np.int64)
        full = np.flatnonzero(sizes)
        # A bounded number of grams at a time, so that long texts need no large table.
        for part in np.split(full, np.flatnonzero(np.diff(np.cumsum(sizes[full]) // 65536)) + 1) if len(full) else ():
            flat = np.concatenate([ids[i] for i in part])
            starts = np.cumsum(sizes[part]) - sizes[part]
            out[part] = np.add.reduceat(self.weights[flat, None] * self.directions[flat], starts, axis=0)
        return out

    def encode(self, texts: Sequence[str]) -> np.ndarray:
        out = self._sums([gram_ids(t, buckets=self.buckets) for t in texts])
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    def fit(
        self, left: Sequence[str], right: Sequence[str], owner: Sequence | None = None, group: Sequence | None = None, wrong: Sequence[str] | None = None,
        epochs: int = 3, batch: int = 128, rate: float = 0.05, warm: float = 0.1, scale: float = 12.0, seed: int = 5,
    ) -> list[float]:
        """Contrastive steps over true pairs, from ``right`` to ``left``; returns the loss of each epoch.

        A pair's negatives are the lefts of its batch that belong to another ``owner`` (the entity), and its ``wrong`` text
        if there is one (empty: none). Batches are of one ``group``. The rate rises over the first ``warm`` share of all
        steps, then falls by a cosine.
        """
        rng, log, n = np.random.default_rng(seed), [], len(left)
        lefts, rights, wrongs = ([gram_ids(t, buckets=self.buckets) for t in side] for side in (left, right, wrong if wrong is not None else [""] * n))
        has_wrong = np.array([bool(t) for t in wrong]) if wrong is not None else np.zeros(n, bool)
        owners = np.unique(np.asarray(owner), return_inverse=True)[1] if owner is not None else np.arange(n)
        groups = np.unique(np.asarray(group), return_inverse=True)[1] if group is not None else np.zeros(n, int)
        plan = lambda order: [rows[i : i + batch] for g in np.unique(groups) for rows in [order[groups[order] == g]] for i in range(0, len(rows), batch)]
        total, step = epochs * len(plan(np.arange(n))), 0
        for _ in range(epochs):
            batches, losses = plan(rng.permutation(n)), []
            for at in rng.permutation(len(batches)):
                rows = batches[at]
                now = rate * (min(1.0, (step + 1) / max(1.0, warm * total)) * 0.5 * (1 + np.cos(np.pi * step / max(1, total))))
                losses.append(self._step([rights[i] for i in rows], [lefts[i] for i in rows], [wrongs[i] for i in rows], owners[rows], has_wrong[rows], scale, now))
                step += 1
            log.append(float(np.mean(losses)) if losses else 0.0)
        return log

    def _step(self, queries: list, targets: list, wrongs: list, owners: np.ndarray, has_wrong: np.ndarray, scale: float, rate: float) -> float:
        sides = []
        for ids in (queries, targets, wrongs):
            raw = self._sums(ids)
            norm = np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-9)
            sides.append((ids, raw / norm, norm))
        q, t, w = (unit for _, unit, _ in sides)
        n, eye = len(queries), np.eye(len(queries), dtype=bool)
        logits = np.concatenate([scale * q @ t.T, (scale * (q * w).sum(axis=1))[:, None]], axis=1)
        logits[:, :n][(owners[:, None] == owners[None, :]) & ~eye] = -np.inf
        logits[~has_wrong, n] = -np.inf
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        g = p.copy()
        g[:, :n] -= eye
        g *= scale / n
        grads = (g[:, :n] @ t + g[:, n:] * w, g[:, :n].T @ q, g[:, n:] * q)
        change = np.zeros_like(self.weights)
        for (ids, unit, norm), grad in zip(sides, grads, strict=True):
            own = (grad - (grad * unit).sum(axis=1, keepdims=True) * unit) / norm  # through the scaling to length one
            for row, d in zip(ids, own, strict=True):
                np.add.at(change, row, self.directions[row] @ d)
        self.weights = np.maximum(self.weights - rate * n * change, self.LEAST)
        return float(-np.log(np.maximum(p[np.arange(n), np.arange(n)], 1e-12)).mean())


def encode_views(df: DataFrame, key: str, views: dict[str, str], encoder: Encoder | dict[str, Encoder]) -> DataFrame:
    """(key, one vector for each view): ``views`` names the text column of each, which has an encoder of its own or shares one."""
    ship(df.sparkSession)
    names = list(views)
    heads = encoder if isinstance(encoder, dict) else dict.fromkeys(names, encoder)
    schema = ", ".join([f"{key} {dict(df.dtypes)[key]}", *(f"{v} array<double>" for v in names)])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            columns = [part.column(0)]
            for v in range(len(names)):
                texts = [t or "" for t in part.column(v + 1).to_pylist()]
                columns.append(pa.array(list(heads[names[v]].encode(texts)), pa.list_(pa.float64())))
            yield pa.RecordBatch.from_arrays(columns, names=[key, *names])

    return df.select(key, *views.values()).mapInArrow(run, schema)


def hard_negatives(neighbours: DataFrame, truth: DataFrame, most: int = 3) -> DataFrame:
    """(q, s): the nearest wrong entities of each query, ``most`` at most."""
    wrong = neighbours.join(truth, ["q", "s"], "left_anti")
    return wrong.withColumn("_r", F.row_number().over(Window.partitionBy("q").orderBy("rank"))).where(F.col("_r") <= most).select("q", "s")


def trained(
    texts: DataFrame, truth: DataFrame, views: dict[str, str], group: str, dims: int = 64, most_pairs: int = 20_000, epochs: int = 3, mine_k: int = 5, seed: int = 5
) -> dict[str, Encoder]:
    """One encoder a view, fitted on at most ``most_pairs`` true pairs (s1, rid), the first by hash: a bounded sample.

    texts: (entity_id, group, the views' texts). After a first fit, wrong entities are mined by an exact search of the sampled
    records among the sampled entities of their group, one of the three nearest is drawn for each pair, and a second fit adds them.
    """
    pick = truth.select("s1", "rid").orderBy(F.xxhash64("s1", "rid"), "s1", "rid").limit(most_pairs)
    sides = list(dict.fromkeys(views.values()))
    left = texts.select(F.col("entity_id").alias("s1"), F.col(group).alias("g"), *[F.col(c).alias(f"{c}_1") for c in sides])
    right = texts.select(F.col("entity_id").alias("rid"), *[F.col(c).alias(f"{c}_2") for c in sides])
    rows = pick.join(left, "s1").join(right, "rid").toPandas().sort_values(["s1", "rid"], ignore_index=True)  # at most ``most_pairs`` rows
    heads = {v: Encoder(dims) for v in views}
    if not len(rows):
        return heads
    rng = np.random.default_rng(seed)
    for v, c in views.items():
        full = rows[(rows[f"{c}_1"] != "") & (rows[f"{c}_2"] != "")]
        heads[v].fit(list(full[f"{c}_1"]), list(full[f"{c}_2"]), list(full["s1"]), list(full["g"]), epochs=epochs, seed=seed)
    first, spark = next(iter(views)), texts.sparkSession

    def vectors(key: str, col: str) -> DataFrame:
        seen = rows.astype({key: str}).drop_duplicates(key)
        units = heads[first].encode(list(seen[col]))
        return spark.createDataFrame([(g, k, x.tolist()) for g, k, x in zip(seen["g"], seen[key], units, strict=True)], f"g {dict(left.dtypes)['g']}, k string, v array<double>")

    queries, targets = vectors("rid", f"{views[first]}_2"), vectors("s1", f"{views[first]}_1")
    nb = knn.knn_by_group(queries, targets, "g", "k", "k", "v", mine_k)
    known = spark.createDataFrame([(str(r), str(s)) for r, s in zip(rows["rid"], rows["s1"], strict=True)], "q string, s string")
    mined = hard_negatives(nb, known).toPandas().sort_values(["q", "s"]).groupby("q")["s"].apply(list).to_dict()  # three a sampled record
    drawn = [str(rng.choice(mined[str(r)])) if str(r) in mined else "" for r in rows["rid"]]
    for v, c in views.items():
        by_entity = dict(zip(rows["s1"].astype(str), rows[f"{c}_1"], strict=True))
        wrong = np.array([by_entity.get(d, "") for d in drawn], dtype=object)
        ok = ((rows[f"{c}_1"] != "") & (rows[f"{c}_2"] != "")).to_numpy()
        full = rows[ok]
        heads[v].fit(list(full[f"{c}_1"]), list(full[f"{c}_2"]), list(full["s1"]), list(full["g"]), list(wrong[ok]), epochs=epochs, seed=seed + 1)
    return heads
