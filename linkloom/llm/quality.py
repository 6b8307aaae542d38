"""Quality classifier from weak labels: EM over heuristic labellers, then a hashed linear scorer.

Eight overlapping heuristics vote accept, reject or abstain on every document. The counts of vote
patterns (at most 3**8 rows, over all documents) are all that expectation-maximisation needs to
estimate each labeller's accuracy. Posterior labels of a bounded sample train a logistic scorer on
hashed byte n-grams, and the scorer judges every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import Cuts, slices, table

REJECT, ABSTAIN, ACCEPT = 0, 1, 2
LABELLERS = ("letter_share", "marks_per_word", "odd_marks", "plain_marks", "mark_runs", "shouting", "repeated_words", "repeated_pairs")
#: Hash bins for byte trigrams and for 4-grams of byte classes.
BINS = 2048
#: Bins for the share of words that equal the word before, above those of the n-grams.
LEVELS = 16
#: Most documents that train the scorer.
TRAIN_ROWS = 4000
#: Texts of fewer words say too little: all labellers abstain, and the score leans on the posterior by half.
SHORT = 12
#: A document is rejected when its score (probability of good quality) is below this.
THRESHOLD = 0.5
SLICE = 2_000_000

_CLASS = np.arange(256, dtype=np.int64)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_LETTER = np.isin(_CLASS, [ord("a"), ord("A")])
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_PLAIN = np.isin(np.arange(256), np.frombuffer(b".,;:'\"-()?", np.uint8))
_MARK = ~_LETTER & ~_BLANK & (_CLASS != ord("0"))


def repeated_share(words: list[bytes]) -> float:
    """Share of words that equal the word before."""
    return sum(map(bytes.__eq__, words[1:], words)) / max(1, len(words))


def votes(texts: list[bytes]) -> np.ndarray:
    """One vote of each labeller for each text; labellers for one defect abstain where they do not see it."""
    out = np.full((len(texts), len(LABELLERS)), ABSTAIN, np.int8)

    def say(value: float, low: float, high: float) -> int:
        """Reject at ``high`` or more, accept at ``low`` or less, abstain between."""
        return REJECT if value >= high else ACCEPT if value <= low else ABSTAIN

    for i, text in enumerate(texts):
        words = text.split()
        if len(words) < SHORT:
            if not words:
                out[i] = REJECT
            continue
        data = np.frombuffer(text, np.uint8)
        count = np.bincount(data, minlength=256)
        n, letters = len(words), max(1, int(count[_LETTER].sum()))
        seen = max(1, len(data) - int(count[_BLANK].sum()))
        marks = int(count[_MARK].sum())
        mark, blank = np.pad(_MARK[data], 1), np.pad(_BLANK[data], 1, constant_values=True)
        # Marks inside or before a word, and marks that stand alone.
        odd = int((mark[1:-1] & (~blank[2:] | blank[:-2])).sum())
        runs = int((_MARK[data[1:]] & (data[1:] == data[:-1])).sum())
        digits = int(count[48:58].sum())
        out[i] = (
            say(1 - (letters + digits) / seen, 0.08, 0.14),
            say(marks / n, 0.35, 0.6),
            say(odd / n, 0.1, 0.3),
            say(1 - int(count[_PLAIN].sum()) / marks if marks else 0.0, 0.3, 0.6),
            REJECT if runs / n >= 0.15 else ABSTAIN,
            REJECT if int(count[65:91].sum()) / letters >= 0.3 else ABSTAIN,
            say(repeated_share(words), 0.05, 0.2),
            say(1 - len(set(zip(words[1:], words))) / n, 0.25, 0.5),
        )
        if out[i, 6] == REJECT:  # clean marks say nothing for a text that repeats itself
            out[i, :4][out[i, :4] == ACCEPT] = ABSTAIN
    return out


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Bins and weights (log counts, unit length) of one text's hashed n-grams."""
    data = np.frombuffer(text, np.uint8).astype(np.int64)
    if len(data) < 4:
        data = np.r_[data, np.zeros(4 - len(data), np.int64)]
    kind = _CLASS[data]
    raw = ((data[:-2] * 0x9E37 + data[1:-1] * 0x85EB + data[2:] * 0xC2B3) >> 4) % BINS
    shape = BINS + ((kind[:-3] * 0x27D5 + kind[1:-2] * 0x1656 + kind[2:-1] * 0x6C8F + kind[3:] * 0x4F4D) >> 3) % BINS
    count = np.bincount(np.r_[raw, shape], minlength=2 * BINS)
    at = np.flatnonzero(count)
    weight = np.log1p(count[at]).astype(np.float32)
    level = 2 * BINS + int(LEVELS * min(0.999, repeated_share(text.split())))
    return np.r_[at, level], np.r_[weight / np.sqrt((weight * weight).sum()), np.float32(0.5)]


def fit_labellers(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(share of good documents, accuracy of each labeller's votes on [bad, good]) by EM; ``patterns`` are distinct vote rows.

    Abstaining says nothing. Accuracies stay between 0.55 and 0.99, so classes cannot change places.
    """
    good, accuracy = 0.8, np.full((patterns.shape[1], 2), 0.8)
    weight = counts / max(1, counts.sum())
    cast = patterns != ABSTAIN
    for _ in range(rounds):
        p = posterior(patterns, good, accuracy)
        before = good
        good = float(np.clip((weight * p).sum(), 1e-3, 1 - 1e-3))
        for c, q, right in ((0, 1 - p, REJECT), (1, p, ACCEPT)):
            mass = (weight * q)[:, None]
            # One-sided labellers never cast the other vote; two pseudo-votes keep rare ones in bounds.
            accuracy[:, c] = ((mass * (patterns == right)).sum(axis=0) + 1.6e-4) / ((mass * cast).sum(axis=0) + 2e-4)
        accuracy = np.clip(accuracy, 0.55, 0.99)
        if abs(good - before) < 1e-9:
            break
    return good, accuracy


def posterior(patterns: np.ndarray, good: float, accuracy: np.ndarray) -> np.ndarray:
    """P(good | votes) of each pattern."""
    accept, reject = patterns == ACCEPT, patterns == REJECT
    for_good = np.log(good) + accept @ np.log(accuracy[:, 1]) + reject @ np.log(1 - accuracy[:, 1])
    for_bad = np.log(1 - good) + reject @ np.log(accuracy[:, 0]) + accept @ np.log(1 - accuracy[:, 0])
    return 1 / (1 + np.exp(np.clip(for_bad - for_good, -50, 50)))


def fit_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Weights (last: bias) of a logistic scorer on soft labels, both classes weighing the same."""
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    balance = y * 0.5 / share + (1 - y) * 0.5 / (1 - share)
    w = np.zeros(x.shape[1] + 1, np.float64)
    speed = np.full(len(w), 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w[:-1].astype(x.dtype) + w[-1], -30, 30)))
        g = balance * (p - y) / len(y)
        grad = np.r_[g.astype(x.dtype) @ x + l2 * w[:-1], g.sum()]
        speed += grad * grad
        w -= 0.5 * grad / np.sqrt(speed)
    return w


class Judge:
    """What the corpus taught: posteriors of vote patterns, share of good documents, weights of the scorer (None: no two classes)."""

    def __init__(self, weak: dict[int, float], good: float, weights: np.ndarray | None):
        self.weak, self.good, self.weights = weak, good, weights

    def labels(self, voted: np.ndarray) -> np.ndarray:
        return np.array([self.weak.get(c, self.good) for c in codes(voted).tolist()])

    def scores(self, texts: list[bytes], label: np.ndarray | None = None) -> np.ndarray:
        """Probability of good quality; ``label`` holds the posteriors, where they are known already."""
        short = np.array([len(t.split(None, SHORT)) < SHORT for t in texts], bool)
        leans = short if self.weights is not None else np.ones(len(texts), bool)
        if label is None:  # few texts lean on their votes
            label = np.zeros(len(texts))
            at = np.flatnonzero(leans)
            if len(at):
                label[at] = self.labels(votes([texts[i] for i in at]))
        if self.weights is None:
            p = label.copy()
        else:
            p = np.empty(len(texts))
            for i, text in enumerate(texts):
                at, weight = features(text)
                p[i] = 1 / (1 + np.exp(-np.clip((self.weights[:-1][at] * weight).sum() + self.weights[-1], -30, 30)))
        p[short] = (p[short] + label[short]) / 2
        p[[not t.strip() for t in texts]] = 0.0
        return p


def codes(voted: np.ndarray) -> np.ndarray:
    """One number for each row of votes."""
    return (voted.astype(np.int64) * 3 ** np.arange(voted.shape[1])).sum(axis=1)


def _fit(weak: dict[int, float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scorer's weights as bytes, from all rows (code, x) of the sample; no row where their labels are not of two classes.

    Runs in one task: the sample is bounded, but many times what its weights take, so the driver gets those alone.
    """
    label, parts = [], []
    for batch in batches:
        label += [weak[c] for c in batch.column(0).to_pylist()]
        for i in range(0, batch.num_rows, 256):
            some = batch.column(1).slice(i, 256).to_pylist()
            parts.append(np.frombuffer(b"".join(some), np.float16).reshape(len(some), -1))
    y = np.array(label)
    if len(y) and y.min() < 0.5 < y.max():
        x = np.concatenate(parts, dtype=np.float64 if len(y) <= 500 else np.float32)
        parts.clear()
        yield pa.RecordBatch.from_arrays([pa.array([fit_scorer(x, y).tobytes()], pa.binary())], names=["weights"])


def learn(docs: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Judge:
    """Fit labellers on the votes of all documents and the scorer on the ``train_rows`` documents with the smallest hashes of
    text and id; one scan gives both. The driver holds vote counts and weights, never the sample."""
    cuts = Cuts(docs.sparkSession, "quality")
    n = docs.count()
    # Rows whose hash may be among the smallest: twice the share asked for, so that fewer have a chance of e**-500.
    share = min(1.0, 2 * train_rows / n) if n else 1.0
    edge = int(-(2**63) + share * 2**64) if share < 1 else 2**63 - 1
    body_type = pa.schema([("code", pa.int32()), ("pick", pa.int64()), ("x", pa.binary())])

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE):
            picked = batch.column(1).to_numpy() <= edge
            body: list[bytes | None] = [None] * len(texts)
            for i in np.flatnonzero(picked):
                dense = np.zeros(2 * BINS + LEVELS, np.float16)
                at, weight = features(texts[i])
                dense[at] = weight
                body[i] = dense.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(codes(votes(texts)), pa.int32()), batch.column(1), pa.array(body, pa.binary())], schema=body_type)

    text = F.col(text_col).cast("string")
    voted = docs.select(text.alias("text"), F.xxhash64(text, F.col(id_col).cast("bigint")).alias("pick")).mapInArrow(vote, "code int, pick bigint, x binary")
    voted = cuts.write(voted, "votes")
    seen = voted.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy("code").collect()  # at most 3**8 rows
    found = np.array([r[0] for r in seen], np.int64)
    patterns = found[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    good, accuracy = fit_labellers(patterns, np.array([r[1] for r in seen], np.float64))
    weak = dict(zip(found.tolist(), posterior(patterns, good, accuracy).tolist(), strict=True)) if len(found) else {}

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _fit(weak, batches)

    sample = voted.where("x is not null").orderBy("pick", "code").limit(train_rows).select("code", "x")
    fitted = sample.mapInArrow(fit, "weights binary").collect()  # one row at most
    weights = np.frombuffer(fitted[0][0], np.float64) if fitted else None
    cuts.drop("votes")
    return Judge(weak, good, weights)


def classify(docs: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, votes, weak_label, score, keep``.

    ``weak_label`` is the posterior of the votes, ``score`` the scorer's probability of good quality;
    documents with a score below ``threshold`` are rejected. Null and empty texts are rejected by
    all labellers, with score 0. Whole texts are read. Vote counts cover all documents; the scorer
    trains on the ``train_rows`` documents with the smallest hashes of text and id (repeated rows are repeated there; null ids have
    a hash as well). Ties at the threshold are kept.
    An empty table gives an empty result. Where all posteriors fall on one side, the posterior itself is the score.
    Other columns are not read.
    """
    judge = learn(docs, train_rows, id_col, text_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", SLICE):
            v = votes(texts)
            label = judge.labels(v)
            p = np.round(judge.scores(texts, label), 6)
            shown = ["".join("-?+"[k] for k in row) for row in v.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shown), pa.array(label), pa.array(p), pa.array(p >= threshold)], names=["doc_id", "votes", "weak_label", "score", "keep"])

    base = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return base.mapInArrow(score, "doc_id bigint, votes string, weak_label double, score double, keep boolean")


def accepted(docs: DataFrame, train_rows: int = TRAIN_ROWS, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that ``classify`` keeps, each judged by its own text, with all columns; no join and no shuffle."""
    judge = learn(docs, train_rows, id_col, text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text_col, SLICE):
            yield batch.filter(pa.array(np.round(judge.scores(texts), 6) >= threshold))

    return docs.mapInArrow(keep, docs.schema)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
