import hashlib
import io
import wave
import zlib

import numpy as np
import pytest

from fluxmill.llm import media

TEXTS = ["", None, "a", "x" * 64, "é" * 40, "the quick brown fox " * 60, "z" * 70_000]


def naive_fingerprint(payload):
    """The same peaks and pairs, frame by frame."""
    s = np.frombuffer(payload, np.uint8).astype(np.float32) - 128
    n = 1 + max(0, -(-(len(s) - media.FRAME) // media.HOP))
    levels = []
    for k in range(n):
        frame = np.zeros(media.FRAME, np.float32)
        part = s[k * media.HOP : k * media.HOP + media.FRAME]
        frame[: len(part)] = part
        z = np.fft.rfft(frame * media._HANN)
        levels.append(np.rint(100 * np.log10(z.real**2 + z.imag**2 + 1)).astype(int))
    tops = [[(max(range(a, b), key=lambda i: (lv[i], -i))) for a, b in zip(media.BANDS, media.BANDS[1:])] for lv in levels]
    found = []
    for k in range(n):
        for band, bin_ in enumerate(tops[k]):
            here = levels[k][bin_]
            before = levels[k - 1][tops[k - 1][band]] if k else -1
            after = levels[k + 1][tops[k + 1][band]] if k + 1 < n else -1
            if here > before and here >= after and here > 0:
                found.append((k, bin_))
    return sorted((t, f << 16 | g << 8 | (u - t)) for i, (t, f) in enumerate(found) for u, g in found[i + 1 : i + 1 + media.FAN] if u - t <= media.REACH)


@pytest.mark.parametrize("text", TEXTS)
def test_row(text):
    row = media._media_row(text)
    data = (text or "").encode()
    padded = data + bytes(64 if not data else -len(data) % 64)
    assert row["payload"] == padded and row["n_bytes"] == len(data)
    with wave.open(io.BytesIO(row["media"])) as w:
        assert w.readframes(w.getnframes()) == padded
    d = media._digest(row)
    assert d["payload_bytes"] % 64 == 0 and d["payload_bytes"] > 0
    assert d["payload_sha256"] == hashlib.sha256(padded).hexdigest()
    assert d["tail_crc32"] == zlib.crc32(padded[-64:])
    assert (d["media_bytes"], d["media_sha256"]) == (len(row["media"]), hashlib.sha256(row["media"]).hexdigest())


@pytest.mark.parametrize("text", [t for t in TEXTS if t and len(t) < 5000])
def test_fingerprint_is_that_of_single_frames(text):
    times, codes = media.fingerprint(media.pad(text.encode()))
    assert list(zip(times.tolist(), codes.tolist())) == naive_fingerprint(media.pad(text.encode()))


def test_blocks_of_frames_make_no_difference(monkeypatch):
    data = media.pad(bytes(np.random.default_rng(1).integers(0, 255, 60_000, np.uint8)))
    whole = media.fingerprint(data)
    monkeypatch.setattr(media, "_FRAMES", 7)
    assert all(np.array_equal(a, b) for a, b in zip(whole, media.fingerprint(data)))


def test_tone_lands_in_its_bin():
    t = np.arange(8192)
    tone = (128 + 90 * np.sin(2 * np.pi * 40 / media.FRAME * t)).astype(np.uint8).tobytes()
    frames, bins = media.peaks(np.frombuffer(tone[:256] + tone, np.uint8))
    assert 40 in bins


def test_frames(spark):
    df = spark.createDataFrame([(k, t, 5, "m") for k, t in enumerate(TEXTS)] + [(0, "", 5, "m"), (None, "a", 5, "m")], "doc_id long, text string, n_bytes int, media string")
    got = media.media_columns(df, digests=True).collect()
    assert len(got) == len(TEXTS) + 2
    assert len({tuple(r)[1:] for r in got if r["doc_id"] in (0, 1)}) == 1
    kept = media.media_columns(df).where("doc_id = 5").first()
    assert len(kept["fingerprint_times"]) == len(kept["fingerprint_codes"]) > 0
    assert media.from_wav(bytes(kept["media"])).rstrip(b"\0").decode() == TEXTS[5]
    assert media.media_columns(df.limit(0), digests=True).count() == 0
