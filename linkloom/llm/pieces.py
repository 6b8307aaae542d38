"""SentencePiece BPE encoding and decoding in vectorised merge rounds.

Distinct words of a batch become one flat numpy array of symbols. Each round finds the best pair rank
of every word by a segmented minimum, merges its occurrences in all words at once (from the left, up to
the first whose result pairs as well or better with a neighbour, so that the order of merges is that of one at a
time), and drops words in which no pair remains. A word takes no more rounds than it meets different ranks, but for such
stops. Ids of words are remembered within a task, up to a bound.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import slices, table
from linkloom.shipping import ship

SPACE = "▁"
MEMO = 400_000
#: Symbols that go through the rounds together, and the length from which a word is not remembered.
ROUND_SYMBOLS, LONG_WORD = 400_000, 768
_NONE = np.int32(2**31 - 1)
#: A byte that starts no valid UTF-8 sequence becomes U+FFFD, alone.
codecs.register_error("each_byte", lambda e: ("\ufffd", e.start + 1))


def piece_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCodec:
    """Encoder and decoder of one model file.

    The model must be BPE with the identity normaliser, a dummy prefix, kept white space and byte
    fallback, and no piece may hold a space mark after another character; else ValueError.
    """

    def __init__(self, path: str, memo: int = MEMO):
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        model.ParseFromString(sp.SentencePieceProcessor(model_file=path).serialized_model_proto())
        norm, kind = model.normalizer_spec, {1: "normal", 2: "unknown", 3: "control", 6: "byte"}
        pieces = [(p.piece, p.score, kind.get(p.type, "other")) for p in model.pieces]
        plain = model.trainer_spec.model_type == 2 and norm.name == "identity" and norm.add_dummy_prefix and norm.escape_whitespaces and not norm.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix
        if not plain or any(k == "other" for *_, k in pieces) or any(SPACE in p.lstrip(SPACE) for p, _, k in pieces if k == "normal"):
            raise ValueError("this model needs rules that the codec does not have")
        self.size, self.end_id, self.most = len(pieces), next(i for i, (p, *_) in enumerate(pieces) if p == "</s>"), memo
        by_text = {p: i for i, (p, _, k) in enumerate(pieces) if k == "normal"}
        self.byte_ids = [next(i for i, (p, *_) in enumerate(pieces) if p == f"<0x{b:02X}>") for b in range(256)]
        # Characters that stand in pieces without being one get ids above the vocabulary.
        self.symbols = dict(by_text)
        for text in by_text:
            for ch in text:
                self.symbols.setdefault(ch, self.size + len(self.symbols))
        self.base = self.size + len(self.symbols) + 1
        levels = {s: i for i, s in enumerate(sorted({pieces[i][1] for i in by_text.values()}, reverse=True))}
        pairs: dict[int, tuple[int, int]] = {}
        for text, i in by_text.items():
            for cut in range(1, len(text)):
                a, b = self.symbols.get(text[:cut]), self.symbols.get(text[cut:])
                if a is not None and b is not None:
                    pairs[a * self.base + b] = (levels[pieces[i][1]], i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.ranks = np.array([pairs[k][0] for k in self.keys.tolist()], np.int32)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        self.memo: dict[str, bytes] = {}
        self.shown = [p.replace(SPACE, " ") if k == "normal" else " ⁇ " if k == "unknown" else "" for p, _, k in pieces]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        self.is_byte = np.zeros(self.size, bool)
        self.is_byte[self.byte_ids] = True
        self.chars: dict[str, int] = {}

    # -- encoding ---------------------------------------------------------------------------------
    def _rank(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.made[at], -1)

    def _char(self, ch: str) -> int:
        """Symbols of characters outside the model lie above ``base`` and join no pair."""
        return self.symbols.get(ch, self.base + ord(ch))

    def _out(self, symbols: list[int]) -> bytes:
        if max(symbols) < self.size:
            return np.array(symbols, "<i4").tobytes()
        ids: list[int] = []
        for s in symbols:
            if s < self.size:
                ids.append(s)
            else:
                ch = chr(s - self.base) if s >= self.base else next(c for c, i in self.symbols.items() if i == s)
                ids += [self.byte_ids[b] for b in ch.encode()]
        return np.array(ids, "<i4").tobytes()

    def _first_merges(self, sym: np.ndarray, seg: np.ndarray, made: np.ndarray, hits: np.ndarray, best: np.ndarray) -> np.ndarray:
        """Those of the best pairs' places ``hits`` that merge in this round."""
        # Of overlapping ones every second, counted from the left.
        run = np.r_[True, (hits[1:] != hits[:-1] + 1) | (seg[hits[1:]] != seg[hits[:-1]])]
        first = np.flatnonzero(run)
        at = hits[(np.arange(len(hits)) - first[np.cumsum(run) - 1]) % 2 == 0]
        new = np.r_[True, seg[at[1:]] != seg[at[:-1]]]
        single = new & np.r_[new[1:], True]
        if single.all():
            return at
        # Where the merged symbol pairs with a neighbour at this rank or a better one, what follows in the word has to wait.
        many = at[~single]
        rank_here, stop = best[many], np.zeros(len(many), bool)
        after = np.r_[False, many[1:] == many[:-1] + 2]
        left = np.where(after, np.r_[0, made[many[:-1]]], sym[many - 1])
        right_at = np.minimum(many + 2, len(sym) - 1)
        for a, b, inside in ((left, made[many], (many > 0) & (seg[many - 1] == seg[many])), (made[many], sym[right_at], (many + 2 < len(sym)) & (seg[right_at] == seg[many]))):
            ok = inside & (a < self.base) & (b < self.base)
            stop |= ok & (self._rank(np.where(ok, a, 0), np.where(ok, b, 0))[0] <= rank_here)
        before = np.cumsum(stop) - stop
        start = np.flatnonzero(np.r_[True, seg[many[1:]] != seg[many[:-1]]])
        own = before[start][np.cumsum(np.r_[True, seg[many[1:]] != seg[many[:-1]]]) - 1]
        take = np.ones(len(at), bool)
        take[~single] = before == own
        return at[take]

    def _merge_words(self, words: list[str]) -> None:
        """Fill the memo for these words, all rounds together."""
        sym = np.array([self._char(c) for w in words for c in w], np.int64)
        seg = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = np.full(len(sym), _NONE, np.int32)  # of the pair that starts here
        made = np.full(len(sym), -1, np.int64)
        inner = np.flatnonzero(seg[:-1] == seg[1:]) if len(seg) else np.zeros(0, np.int64)
        outside = self.base
        if len(inner):
            a, b = sym[inner], sym[inner + 1]
            r, m = self._rank(np.where(a < outside, a, 0), np.where(b < outside, b, 0))
            bad = (a >= outside) | (b >= outside)
            rank[inner], made[inner] = np.where(bad, _NONE, r), np.where(bad, -1, m)
        while len(sym):
            starts = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            open_ = np.repeat(best != _NONE, sizes)
            if not open_.all():
                done.append((seg[~open_], sym[~open_]))
                sym, seg, rank, made = sym[open_], seg[open_], rank[open_], made[open_]
                best, sizes = best[best != _NONE], sizes[best != _NONE]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            at = self._first_merges(sym, seg, made, hits, np.repeat(best, sizes))
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.arange(len(at))  # each merge before it took one place
            sym, seg, rank, made = sym[keep], seg[keep], rank[keep], made[keep]
            for where in (moved - 1, moved):  # the pairs on both sides of a merge
                where = where[(where >= 0) & (where < len(sym))]
                nxt = np.minimum(where + 1, len(sym) - 1)
                ok = (where + 1 < len(sym)) & (seg[where] == seg[nxt]) & (sym[where] < outside) & (sym[nxt] < outside)
                r, m = self._rank(np.where(ok, sym[where], 0), np.where(ok, sym[nxt], 0))
                rank[where], made[where] = np.where(ok, r, _NONE), np.where(ok, m, -1)
        segs = np.concatenate([s for s, _ in done])
        syms = np.concatenate([s for _, s in done])
        order = np.argsort(segs, kind="stable")
        segs, syms = segs[order], syms[order]
        ends = np.searchsorted(segs, np.arange(len(words) + 1))
        odd = set(segs[syms >= self.size].tolist())
        raw = np.where(syms < self.size, syms, 0).astype("<i4").tobytes()
        for i, w in enumerate(words):
            s, e = int(ends[i]), int(ends[i + 1])
            self.memo[w] = raw[4 * s : 4 * e] if i not in odd else self._out(syms[s:e].tolist())

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers, end id included; an empty text is the end id alone."""
        if len(self.memo) > self.most:
            self.memo = {}
        words = [re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        new = set().union(*words) - self.memo.keys()
        part: list[str] = []
        held = 0
        for w in new:
            part.append(w)
            held += len(w)
            if held >= ROUND_SYMBOLS:
                self._merge_words(part)
                part, held = [], 0
        if part:
            self._merge_words(part)
        tail, get = np.array([self.end_id], "<i4").tobytes(), self.memo.__getitem__
        out = [b"".join(map(get, ws)) + tail for ws in words]
        for w in new:
            if len(w) > LONG_WORD:  # long words are seldom seen again
                del self.memo[w]
        return out

    # -- decoding ---------------------------------------------------------------------------------
    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, byte pieces read as UTF-8 (a bad byte becomes U+FFFD), the dummy prefix dropped."""
        if not len(ids):
            return ""
        shown = self.shown
        if not self.is_byte[ids].any():
            text = "".join([shown[i] for i in ids.tolist()])
        else:
            runs: list[list[bytes]] = [[]]
            for i in ids.tolist():
                if i in self.byte_of or shown[i]:
                    runs[-1].append(bytes([self.byte_of[i]]) if i in self.byte_of else shown[i].encode())
                else:  # a control id shows nothing and ends a run of bytes
                    runs.append([])
            text = "".join([b"".join(r).decode("utf-8", errors="each_byte") for r in runs])
        first = next((i for i in ids.tolist() if shown[i] or self.is_byte[i]), None)
        return text[1:] if first is not None and not self.is_byte[first] and shown[first][:1] == " " and shown[first] != " ⁇ " else text


def encode_pieces(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, ids`` (array of int, end id last) and ``decoded``, the text of those ids.

    Null and empty texts give the end id and an empty text. A text of any length is encoded whole. Equal
    texts give equal rows. No shuffle; an empty table gives an empty result. Other columns are not read.
    """
    ship(docs.sparkSession)
    path = path or piece_bpe_path()
    kinds = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(path)
        for batch, texts in slices(batches, "text", 3_000_000):
            raw = codec.encode([t.decode() for t in texts])
            ends = np.cumsum([0, *(len(r) // 4 for r in raw)]).astype(np.int32)
            flat = np.frombuffer(b"".join(raw), "<i4")
            decoded = [codec.decode(flat[s:e]) for s, e in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(decoded, pa.string())], schema=kinds)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>, decoded string")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
