"""Hierarchical multi-length packing of tokenised documents.

Documents are tokenised where they are read (no shuffle) and packed in bounded groups of one task.
Each document is routed to a context-size tier: whole windows of the longest tier are cut from long
documents, and what remains goes to the shortest tier that holds it. Each tier is packed best-fit
decreasing; gaps of longer windows are filled with pieces of shorter tiers, cut where they must be;
every window that is emitted is exactly a tier's size. What is left of a task at its end is cut into
powers of two, so no sequence needs padding. Sequences of all tiers are dealt to step groups, the largest first to
the lightest group, so the groups of a task hold nearly equal token counts.
"""

from __future__ import annotations

import gc
import heapq
import re
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import slices, table
from linkloom.shipping import ship

TIERS = (2048, 1024, 512, 256)
#: Tokens that a task gathers before it packs them: the bound of its memory.
GROUP_TOKENS = 4_000_000
#: Tokens in a step group: each task makes as many groups as it can fill to this, and spreads the rest over them.
STEP_TOKENS = 65_536
#: Distinct words whose ids a task remembers.
MEMO = 600_000


def word_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts as the tokenizers library gives them, with white-space separated chunks remembered.

    Only for tokenizers that drop white space and never join over it; ``chunked=False`` encodes whole
    texts for any other. Special tokens are not added.
    """

    WITH_MARKS = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)\Z")

    def __init__(self, path: str, chunked: bool = True, memo: int = MEMO):
        from tokenizers import Tokenizer

        self.tokenizer, self.chunked, self.most = Tokenizer.from_file(path), chunked, memo
        self.memo: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, bool)
        self.is_end[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.chunked:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        if len(self.memo) > self.most:  # what is used again comes back from the older half
            self.old, self.memo = self.memo, {"": b""}
        # These four white-space characters end chunks; any other stays inside one, where the tokenizer sees it.
        chunks = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        watched = gc.isenabled()
        gc.disable()  # the many short-lived lists here hold no cycles
        got = [list(map(self.memo.get, c)) for c in chunks]
        gaps: list[tuple[list, list[str], int]] = []  # places of chunks that are new: few, and found without a loop over all
        for g, c in zip(got, chunks, strict=True):
            i = -1
            for _ in range(g.count(None)):
                i = g.index(None, i + 1)
                gaps.append((g, c, i))
        self._learn({c[i] for _, c, i in gaps})
        for g, c, i in gaps:
            g[i] = self.memo[c[i]]
        out = [b"".join(g) for g in got]
        if watched:
            gc.enable()
        for i, text in enumerate(texts):
            if "\u0130" in text:  # its lower case is longer; what the library makes of that depends on what stands around
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def _learn(self, new: set[str]) -> None:
        """Ids of new chunks. Letters alone, or with ASCII marks after them, split in known places: their letters are
        encoded many at a time and parted at end-of-word ids, their marks from the memo. Others are encoded alone."""
        memo, old, plain, same, marked, other = self.memo, self.old, set(), [], [], []
        for chunk in new:
            if (ids := old.get(chunk)) is not None:
                memo[chunk] = ids
                continue
            if chunk.isalpha():
                word = chunk
            elif (m := self.WITH_MARKS.match(chunk)) and m[1].isalpha():
                word, marks = m[1], m[2]
                marked.append((chunk, word, marks))
                if marks not in memo:
                    other.append(marks)
            else:
                other.append(chunk)
                continue
            if word not in memo:
                low = word.lower() if word.isascii() else word
                if low != word:
                    same.append((word, low))
                if low not in memo:
                    plain.add(low)
        words = list(plain)
        for i in range(0, len(words), 5_000):
            part = words[i : i + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(part):  # letters that this tokenizer parts after all
                other += part
                continue
            raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
            memo.update(zip(part, [raw[s:e] for s, e in zip(at, at[1:], strict=False)], strict=True))
        for i in range(0, len(other), 10_000):
            part = other[i : i + 10_000]
            for word, e in zip(part, self.tokenizer.encode_batch(part, add_special_tokens=False), strict=True):
                memo[word] = np.array(e.ids, "<u4").tobytes()
        for word, low in same:
            memo[word] = memo[low]
        for chunk, word, marks in marked:
            memo[chunk] = memo[word] + memo[marks]


_SHARED: dict[tuple[str, int], WordEncoder] = {}


def shared_encoder(path: str, memo: int = MEMO) -> WordEncoder:
    """One encoder for all tasks that a Python worker runs."""
    if (path, memo) not in _SHARED:
        _SHARED[path, memo] = WordEncoder(path, memo=memo)
    return _SHARED[path, memo]


class _Open:
    """Windows of one tier that still have room, by free tokens."""

    def __init__(self, size: int):
        self.size, self.free, self.held = size, [[] for _ in range(size + 1)], np.zeros(size + 1, bool)

    def put(self, free: int, window: list) -> None:
        self.free[free].append(window)
        self.held[free] = True

    def take(self, need: int) -> tuple[int, list] | None:
        """The window with the least room that holds ``need`` tokens."""
        at = need + int(self.held[need:].argmax())
        if at > self.size or not self.held[at]:
            return None
        window = self.free[at].pop()
        self.held[at] = bool(self.free[at])
        return at, window


def pack_group(lengths: list[int], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """Windows (size, pieces) over documents of these lengths, and the pieces left over.

    A piece is (document, start, length). Each window is filled exactly. Unless ``last``, what fills no
    window is left over; with it, it is cut into windows of powers of two.
    """
    longest = tiers[0]
    windows: list[tuple[int, list]] = []
    routed: dict[int, list[tuple[int, int, int]]] = {t: [] for t in tiers}
    for d, n in enumerate(lengths):
        whole = n // longest * longest
        windows += [(longest, [(d, s, longest)]) for s in range(0, whole, longest)]
        if rest := n - whole:
            routed[min(t for t in tiers if t >= rest)].append((d, whole, rest))
    spare: list[tuple[int, int, int]] = []  # pieces that cut gaps shut, the shortest tier's first
    for tier in tiers:  # the longest first: its gaps draw on shorter tiers
        pieces = sorted(routed[tier], key=lambda p: (-p[2], p[0]))
        room = _Open(tier)
        for p in pieces:
            got = room.take(p[2])
            free, window = got if got else (tier, [])
            window.append(p)
            if free == p[2]:
                windows.append((tier, window))
            else:
                room.put(free - p[2], window)
        shorter = sorted((p for t in tiers if t < tier for p in routed[t]), key=lambda p: (-p[2], p[0]))
        used = set()
        for p in shorter:  # whole pieces of shorter tiers into the gaps they fit
            got = room.take(p[2])
            if not got:
                continue
            free, window = got
            window.append(p)
            used.add(p)
            if free == p[2]:
                windows.append((tier, window))
            else:
                room.put(free - p[2], window)
        for t in tiers:
            if t < tier and used:
                routed[t] = [p for p in routed[t] if p not in used]
        # Windows that still have a gap are closed by cutting: the emptiest ones give their pieces to the others.
        gaps = sorted(((free, w) for free, ws in enumerate(room.free) for w in ws), key=lambda x: (x[0], x[1][0]))
        lo, hi = 0, len(gaps) - 1
        loose: list[tuple[int, int, int]] = []
        while lo <= hi:
            free, window = gaps[lo]
            lo += 1
            while free:
                if not loose:
                    if lo > hi:
                        break
                    loose = gaps[hi][1]
                    hi -= 1
                d, s, n = loose.pop()
                cut = min(n, free)
                window.append((d, s, cut))
                free -= cut
                if cut < n:
                    loose.append((d, s + cut, n - cut))
            if free:
                loose = window
            else:
                windows.append((tier, window))
        # What fills no window of this tier is routed on to the next shorter one.
        later = [t for t in tiers if t < tier]
        for d, s, n in loose:
            step = later[0] if later else 0
            while step and n > step:
                windows.append((step, [(d, s, step)]))
                s, n = s + step, n - step
            if step:
                routed[min(t for t in later if t >= n)].append((d, s, n))
            else:
                spare.append((d, s, n))
    if not last:
        return windows, spare
    total = sum(p[2] for p in spare)
    queue = spare[::-1]
    while total:
        size = 1 << (total.bit_length() - 1)
        total -= size
        window, free = [], size
        while free:
            d, s, n = queue.pop()
            cut = min(n, free)
            window.append((d, s, cut))
            free -= cut
            if cut < n:
                queue.append((d, s + cut, n - cut))
        windows.append((size, window))
    return windows, []


class StepGroups:
    """Deals windows to step groups, the largest first to the lightest group; groups stay open over the calls of a task."""

    def __init__(self, tokens: int):
        self.tokens, self.count, self.open = tokens, 0, []

    def deal(self, sizes: list[int]) -> list[int]:
        """The group of each window. A call opens as many groups as it can fill; a task's first call opens one at least."""
        more = max(sum(sizes) // self.tokens, 1 if sizes and not self.count else 0)
        if more:
            self.open = sorted(self.open)[:64] + [(0, self.count + i) for i in range(more)]  # the fullest groups close
            self.count += more
            heapq.heapify(self.open)
        out = [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
            load, group = self.open[0]
            heapq.heapreplace(self.open, (load + sizes[i], group))
            out[i] = group
        return out


_SCHEMA = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, step_group bigint"


def pack_documents(
    docs: DataFrame,
    make_encoder: Callable[[], Callable[[list[str]], list[bytes]]],
    end_id: int = 1,
    tiers: tuple[int, ...] = TIERS,
    group_tokens: int = GROUP_TOKENS,
    step_tokens: int = STEP_TOKENS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset, tier, step_group``.

    ``ids`` are little-endian unsigned 32-bit numbers. ``tier`` is the length of the piece's sequence, always a power of two. Null and empty texts are the
    end id alone; a text of any length is cut over as many windows as it needs. An empty table gives no
    pieces. Rows that repeat an id are packed each. Sequence ids carry the task's number above 36 bits,
    so a task that runs again gives the same ids. Other columns are not read.
    """
    ship(docs.sparkSession)
    kinds = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in _SCHEMA.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = make_encoder(), TaskContext.get()
        first = (context.partitionId() if context else 0) << 36
        tail = np.array([end_id], "<u4").tobytes()
        state: dict[str, Any] = {"next": 0, "steps": StepGroups(step_tokens)}
        ids: list[Any] = []
        bodies: list[bytes] = []
        begun: list[int] = []  # where a document that is carried on starts in its own ids
        totals: list[int] = []
        held = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal ids, bodies, begun, totals, held
            windows, left = pack_group([len(b) // 4 for b in bodies], tiers, last)
            rows: list[tuple] = []
            for (size, pieces), step in zip(windows, state["steps"].deal([w[0] for w in windows]), strict=True):
                seq = first + state["next"]
                state["next"] += 1
                offset = 0
                for d, s, n in pieces:
                    rows.append((d, s, n, seq, offset, size, first + step))
                    offset += n
            for i in range(0, len(rows), 20_000):
                part = rows[i : i + 20_000]
                body = [bodies[d][4 * s : 4 * (s + n)] for d, s, n, *_ in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([ids[r[0]] for r in part], pa.int64()),
                        pa.array([begun[r[0]] + r[1] for r in part], pa.int64()),
                        pa.array([r[2] for r in part], pa.int64()),
                        pa.array(body, pa.binary()),
                        pa.array([totals[r[0]] for r in part], pa.int64()),
                        *(pa.array([r[k] for r in part], pa.int64() if k != 5 else pa.int32()) for k in (3, 4, 5, 6)),
                    ],
                    schema=kinds,
                )
            kept = [(ids[d], bodies[d][4 * s : 4 * (s + n)], begun[d] + s, totals[d]) for d, s, n in left]
            ids, bodies, begun, totals = (list(x) for x in zip(*kept, strict=True)) if kept else ([], [], [], [])
            held = sum(len(b) // 4 for b in bodies)

        for batch, texts in slices(batches, "text", 2_000_000):
            for doc, body in zip(batch.column(0).to_pylist(), encode([t.decode() for t in texts]), strict=True):
                ids.append(doc)
                bodies.append(body + tail)
                begun.append(0)
                totals.append(len(body) // 4 + 1)
                held += totals[-1]
            if held >= group_tokens:
                yield from flush(last=False)
        yield from flush(last=True)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def pack_word_bpe(docs: DataFrame, path: str | None = None, memo: int = MEMO) -> DataFrame:
    """``pack_documents`` with the word tokenizer; ``memo`` (words remembered) trades memory for time and leaves the result alone."""
    path = path or word_bpe_path()
    return pack_documents(docs, lambda: shared_encoder(path, memo))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_word_bpe(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
