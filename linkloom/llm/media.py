"""Media columns: byte payloads as 8-bit WAV, read back, with spectral-peak pair fingerprints.

Each payload becomes one WAV column value (wave module). Fingerprints come from the stored bytes: a
short-time Fourier transform, the strongest local peak of each frequency band of each frame, and
pairs of a peak with the same band's and the next band's peaks a few frames later. A pair is one
integer (band bins and time step) beside the frame it starts at: two arrays, ordered by time.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.common import slices, table
from linkloom.shipping import ship

BLOCK, RATE = 64, 8000
WINDOW, HOP, BANDS, AHEAD = 512, 256, 4, 3


def pad(data: bytes, block: int = BLOCK) -> bytes:
    """Bytes 0 appended up to a positive multiple of ``block``."""
    return data + bytes(max(block, -(-len(data) // block) * block) - len(data))


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file with one unsigned 8-bit sample for each byte."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def fingerprints(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(start frames, pair codes) of each payload; the transforms of all payloads run together."""
    counts = [max(1, -(-max(0, len(p) - WINDOW) // HOP) + 1) for p in payloads]
    buf = np.full(sum((c - 1) * HOP + WINDOW for c in counts), 128, np.uint8)  # 128: silence
    starts, at = [], 0
    for p, c in zip(payloads, counts, strict=True):
        buf[at : at + len(p)] = np.frombuffer(p, np.uint8)
        starts.append(at + HOP * np.arange(c))
        at += (c - 1) * HOP + WINDOW
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    shape = np.hanning(WINDOW).astype(np.float32)
    bins = np.empty((len(starts), BANDS), np.int64)  # bin of the band's strongest local peak, -1: none
    width = WINDOW // 2 // BANDS
    for i in range(0, len(starts), 2048):
        frames = (buf[starts[i : i + 2048, None] + np.arange(WINDOW)].astype(np.float32) - 128) * shape
        power = np.abs(np.fft.rfft(frames, axis=1)).astype(np.float32)
        inner = power[:, 1:-1]
        peak = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]) & (inner > 1.0), inner, 0)
        peak = np.pad(peak, ((0, 0), (1, 0)))[:, : width * BANDS].reshape(len(frames), BANDS, width)
        best = peak.argmax(axis=2)
        bins[i : i + 2048] = np.where(peak.max(axis=2) > 0, best + width * np.arange(BANDS), -1)
    out, at = [], 0
    for c in counts:
        own = bins[at : at + c]
        at += c
        t_parts, code_parts = [], []
        for dt in range(1, AHEAD + 1):
            if c <= dt:
                break
            for up in (0, 1):
                a, b = own[:-dt, : BANDS - up], own[dt:, up:]
                t, band = np.nonzero((a >= 0) & (b >= 0))
                t_parts.append(t)
                code_parts.append((a[t, band] << 20) | (b[t, band] << 8) | (dt << 1) | up)
        t = np.concatenate(t_parts) if t_parts else np.zeros(0, np.int64)
        code = np.concatenate(code_parts) if code_parts else np.zeros(0, np.int64)
        order = np.lexsort((code, t))
        out.append((t[order], code[order]))
    return out


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: int = RATE) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, media`` (the WAV file), ``payload`` (read back), ``peak_time, peak_pair``.

    Null and empty texts give one block of zero bytes; a text of any length gives one media value, with
    memory in proportion to the longest text beside a batch of a few MB. Equal texts give equal values,
    whatever their batch. No shuffle; an empty table gives an empty result. Other columns are not read.
    """
    ship(docs.sparkSession)
    schema = "doc_id bigint, n_bytes bigint, media binary, payload binary, peak_time array<int>, peak_pair array<int>"
    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("payload", pa.binary()), ("peak_time", pa.list_(pa.int32())), ("peak_pair", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text", 4_000_000):
            media = [to_wav(pad(t), rate) for t in texts]
            payload = [from_wav(m) for m in media]
            found = fingerprints(payload)
            columns = [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary()), pa.array(payload, pa.binary())]
            ends = np.cumsum([0, *(len(t) for t, _ in found)]).astype(np.int32)
            for i in (0, 1):
                flat = np.concatenate([x[i] for x in found]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media_columns(table(spark, sf_dir, "documents"))
    digest = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), " ").cast("binary"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("peak_pair").cast("string"), digest("peak_time"), digest("peak_pair")).alias("feature"),
    )
