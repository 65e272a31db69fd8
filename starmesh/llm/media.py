"""Media columns: bytes as 8-bit WAV audio, with spectral-peak pair fingerprints as time-coded arrays.

The payload is stored as samples of a mono WAV file made and read by the wave module. Of the
samples read back, a short-time Fourier transform is taken, with frames that overlap by half, so
that every sample counts in two of them; in each frame the strongest bin of each of a few bands is
a peak if it stands out in its band; a peak is paired with the first ones of later frames. A pair's
hash is (first bin, second bin, frames between) and its time the first frame.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_chunks

RATE = 8000
BLOCK = 64
FRAME = 256
HOP = 128
#: Frames transformed at once, which bounds the memory of a very long text.
FRAMES_AT_ONCE = 2048
BANDS = ((1, 10), (10, 24), (24, 52), (52, 129))
#: Partners of a peak, and the most frames between them.
FAN_OUT, MOST_GAP = 3, 63
#: A peak is so many times its band's mean.
STANDS_OUT = 1.2
FIRST_PAIRS = 16


def to_wav(payload: bytes) -> bytes:
    """A mono WAV file whose 8-bit samples are the payload's bytes."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file as bytes."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


_WINDOW = np.hanning(FRAME).astype(np.float32)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Times (frame numbers) and hashes of the peak pairs, in order of time, then hash.

    Frame i begins at sample (i - 1) * HOP; outside the samples is the nearest one's value.
    """
    x = np.frombuffer(samples, np.uint8)
    n = -(-len(x) // HOP) + 1
    bins, whens = [], []
    for at in range(0, n, FRAMES_AT_ONCE):
        m = min(FRAMES_AT_ONCE, n - at)
        lo, hi = (at - 1) * HOP, (at + m - 2) * HOP + FRAME
        part = np.pad(x[max(lo, 0) : hi], (max(-lo, 0), max(hi - len(x), 0)), mode="edge").astype(np.float32)
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        frames = frames - frames.mean(axis=1, keepdims=True)
        power = np.abs(np.fft.rfft(frames * _WINDOW, axis=1)).astype(np.float32)
        for low, high in BANDS:
            best = power[:, low:high].argmax(axis=1)
            clear = power[np.arange(m), low + best] > STANDS_OUT * power[:, low:high].mean(axis=1)
            whens.append(np.flatnonzero(clear) + at)
            bins.append((low + best)[clear])
    when, peak = np.concatenate(whens), np.concatenate(bins)
    order = np.lexsort((peak, when))
    when, peak = when[order].astype(np.int64), peak[order].astype(np.int64)
    later = np.searchsorted(when, when, "right")
    times, hashes = [], []
    for k in range(FAN_OUT):
        own = np.flatnonzero(later + k < len(when))
        other = later[own] + k
        near = when[other] - when[own] <= MOST_GAP
        own, other = own[near], other[near]
        times.append(when[own])
        hashes.append((peak[own] << 20) | (peak[other] << 12) | (when[other] - when[own]))
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, times array<int>, hashes array<int>, media binary"


def _encode(arrays: bool, media_out: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch):
                cols: dict[str, list] = {k.split()[0]: [] for k in SCHEMA.split(", ")}
                for text in part.column(1).to_pylist():
                    raw = (text or "").encode()
                    media = to_wav(raw + bytes(-len(raw) % BLOCK or (0 if raw else BLOCK)))
                    back = from_wav(media)
                    times, hashes = fingerprint(back)
                    digest = hashlib.sha256(times.astype("<i4").tobytes() + hashes.astype("<i4").tobytes()).hexdigest()
                    first = " ".join(f"{t}:{h:x}" for t, h in zip(times[:FIRST_PAIRS].tolist(), hashes[:FIRST_PAIRS].tolist(), strict=True))
                    row = (len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{len(times)} {digest} {first}".rstrip(), times if arrays else None, hashes if arrays else None, media if media_out else None)
                    for k, v in zip(list(cols)[1:], row, strict=True):
                        cols[k].append(v)
                kinds = [pa.int64()] * 2 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(v, t) for v, t in zip(list(cols.values())[1:], kinds, strict=True))], names=list(cols))

    return run


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", arrays: bool = True, media: bool = True) -> DataFrame:
    """One row per input row: the stored WAV file, the checks of its payload as read back, and
    the fingerprint as time-coded arrays (times, hashes) and as a feature string.

    The payload is the text's UTF-8 bytes, padded with zeros to a positive multiple of 64; null
    counts as empty. Equal texts give equal values; repeated rows are kept; other columns are
    ignored, and an empty table gives an empty result. arrays and media choose the large columns.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_encode(arrays, media), SCHEMA)
    return out.drop(*([] if arrays else ["times", "hashes"]), *([] if media else ["media"]))
