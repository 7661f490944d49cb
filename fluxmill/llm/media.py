"""Media columns: bytes held as WAV, spectra by short-time Fourier transform, peak-pair fingerprints.

A payload becomes the 8-bit samples of a mono WAV file in a binary column.  The
features come from the stored file, read back by the ``wave`` module: the
strongest bin of each band that also stands out in time is a peak, and every
peak is paired with the next few; a pair's code holds both bins and their
distance in frames and is stored beside its frame number.

Null texts count as empty; an empty payload is one block of zero bytes; equal
payloads give equal features; repeated rows give equal rows; an empty table gives an
empty result; extra columns are dropped from the result unless named in ``keep``.  A
row holds its text's bytes, the file and the samples read back from it, as a binary
column must; frames, spectra and levels are made and dropped a block at a time, so
beside those only the peaks grow with a payload.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fluxmill.llm.common import slices

BLOCK = 64  # payloads are padded to a positive multiple of this
RATE = 8000
FRAME, HOP = 256, 128
BANDS = (1, 9, 25, 57, 129)  # edges of the bands, in bins; the constant bin 0 has no peak
FAN, REACH = 3, 63  # peaks paired with each anchor, and how many frames ahead they may lie
_FRAMES = 4096  # frames transformed at once

_HANN = (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(FRAME) / FRAME)).astype(np.float32)


def pad(data: bytes, block: int = BLOCK) -> bytes:
    return data + bytes(-len(data) % block or (block if not data else 0))


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        if (r.getnchannels(), r.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return r.readframes(r.getnframes())


def spectra(samples: np.ndarray) -> Iterator[np.ndarray]:
    """Levels in whole hundredths of a bel, a block of frames at a time; the last frame is padded with silence."""
    n = 1 + max(0, -(-(len(samples) - FRAME) // HOP))
    for first in range(0, n, _FRAMES):
        many = min(_FRAMES, n - first)
        part = np.zeros((many - 1) * HOP + FRAME, np.float32)
        got = samples[first * HOP : first * HOP + len(part)]
        part[: len(got)] = got.astype(np.float32) - 128
        frames = np.lib.stride_tricks.sliding_window_view(part, FRAME)[::HOP]
        bins = np.fft.rfft(frames * _HANN, axis=1)
        yield np.rint(100 * np.log10(bins.real**2 + bins.imag**2 + 1)).astype(np.int32)


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames and bins of the peaks, by frame, then bin: each band's strongest bin where it stands out in time."""
    bands = len(BANDS) - 1
    frames, bins, first = [], [], -1  # the number of the first frame held, a silent one before all others
    tops, level = np.zeros((1, bands), np.int64), np.full((1, bands), -1, np.int64)

    def settle(last: bool) -> None:
        """Note the peaks among the frames held whose neighbours are known, and keep two."""
        nonlocal tops, level, first
        if last:
            tops, level = np.r_[tops, np.zeros((1, bands), np.int64)], np.r_[level, np.full((1, bands), -1)]
        rows, cols = np.nonzero((level[1:-1] > level[:-2]) & (level[1:-1] >= level[2:]) & (level[1:-1] > 0))
        frames.append(first + 1 + rows)
        bins.append(tops[1:-1][rows, cols])
        first += len(tops) - 2
        tops, level = tops[-2:], level[-2:]

    for block in spectra(samples):
        top = np.stack([block[:, a:b].argmax(1) + a for a, b in zip(BANDS, BANDS[1:])], 1)
        tops, level = np.r_[tops, top], np.r_[level, np.take_along_axis(block, top, 1)]
        settle(False)
    settle(True)
    return np.concatenate(frames), np.concatenate(bins)


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Time codes and pair codes of a payload's samples."""
    t, f = peaks(np.frombuffer(payload, np.uint8))
    times, codes = [], []
    for step in range(1, FAN + 1):
        gap = t[step:] - t[:-step]
        near = gap <= REACH
        times.append(t[:-step][near])
        codes.append(f[:-step][near] << 16 | f[step:][near] << 8 | gap[near])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def describe(times: np.ndarray, codes: np.ndarray) -> str:
    """A short digest of a fingerprint: its number of pairs and a hash of all of them."""
    return f"{len(codes)}:{hashlib.sha256(times.astype('<i4').tobytes() + codes.astype('<i4').tobytes()).hexdigest()}"


def _media_row(text: str | None) -> dict:
    data = (text or "").encode()
    media = to_wav(pad(data))
    back = from_wav(media)
    times, codes = fingerprint(back)
    return {"n_bytes": len(data), "media": media, "payload": back, "fingerprint_times": times, "fingerprint_codes": codes}


def _digest(row: dict) -> dict:
    return {
        "n_bytes": row["n_bytes"],
        "payload_bytes": len(row["payload"]),
        "payload_sha256": hashlib.sha256(row["payload"]).hexdigest(),
        "tail_crc32": zlib.crc32(row["payload"][-BLOCK:]),
        "media_bytes": len(row["media"]),
        "media_sha256": hashlib.sha256(row["media"]).hexdigest(),
        "feature": describe(row["fingerprint_times"], row["fingerprint_codes"]),
    }


_MEDIA = {"n_bytes": ("bigint", pa.int64()), "media": ("binary", pa.binary()), "fingerprint_times": ("array<int>", pa.list_(pa.int32())), "fingerprint_codes": ("array<int>", pa.list_(pa.int32()))}
_DIGESTS = {"n_bytes": ("bigint", pa.int64()), "payload_bytes": ("bigint", pa.int64()), "payload_sha256": ("string", pa.string()), "tail_crc32": ("bigint", pa.int64()), "media_bytes": ("bigint", pa.int64()), "media_sha256": ("string", pa.string()), "feature": ("string", pa.string())}


def media_columns(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), digests: bool = False) -> DataFrame:
    """Per row: ``keep``, then n_bytes, the WAV file and its fingerprint arrays; with ``digests`` only what identifies them.

    Narrow: one pass over the texts, no shuffle.
    """
    made = _DIGESTS if digests else _MEDIA
    names = list(keep)
    source = df.select(*names, df[text].alias("__text"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name in names] + [f"`{n}` {t}" for n, (t, _) in made.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(names), 256):
            rows = [_media_row(t.as_py()) for t in batch.column(len(names))]
            if digests:
                rows = [_digest(r) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(names))] + [pa.array([r[n] for r in rows], t) for n, (_, t) in made.items()], names + list(made))

    return source.mapInArrow(run, schema)
