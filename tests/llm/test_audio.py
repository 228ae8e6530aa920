import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa

from pairwright.llm import audio

SCHEMA = "doc_id long, text string, media string, n_bytes string"


def test_digests(spark):
    rows = [(1, "é€ abc", None, "x"), (2, None, None, None), (3, "", None, None), (4, "x" * 64, None, None), (5, "lorem ipsum " * 40_000, None, None), (4, "x" * 64, None, None), (None, "é€ abc", None, None)]
    got = audio.digests(audio.media(spark.createDataFrame(rows, SCHEMA))).collect()
    assert len(got) == len(rows)
    for r, (i, t, *_) in zip(sorted(got, key=str), sorted(rows, key=lambda r: f"Row(id={r[0]}, n_bytes={len((r[1] or '').encode())}")):
        raw = (t or "").encode()
        p = raw + b"\0" * ((64 - len(raw)) % 64 if raw else 64)
        assert (r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        m = audio.encode_wav(p)
        with wave.open(io.BytesIO(m)) as w:
            assert w.readframes(w.getnframes()) == p and w.getsampwidth() == 1
        assert (r.media_bytes, r.media_sha256) == (len(m), hashlib.sha256(m).hexdigest())
    by = {r.id: r.feature for r in got}
    assert by[1] == by[None] and by[2] == by[3] != by[5]


def test_resample_equals_direct_sum():
    x = np.random.default_rng(1).standard_normal(101).astype(np.float32)
    for up, down in ((1, 2), (1, 3), (2, 3), (3, 2)):
        filters = audio.low_pass(up, down)
        got = audio.resample(x, up, down)
        want = []
        for k in range(-(-len(x) * up // down)):
            at, phase = divmod(k * down, up)
            row = filters[[p for p in range(up) if p * down % up == phase][0]]
            want.append(sum(float(row[j]) * float(x[at - audio.TAPS + 1 + j]) for j in range(2 * audio.TAPS) if 0 <= at - audio.TAPS + 1 + j < len(x)))
        np.testing.assert_allclose(got, want, atol=1e-5)


def test_resample_keeps_low_and_drops_high():
    t = np.arange(16_000) / 16_000
    low, high = (audio.resample(np.sin(2 * np.pi * f * t).astype(np.float32)) for f in (500, 7_000))
    assert np.abs(low[100:-100]).max() > 0.95 and np.abs(high[100:-100]).max() < 0.05


def test_tone_peaks_in_its_band():
    t = np.arange(16_000) / 16_000
    tone = (128 + 100 * np.sin(2 * np.pi * 1_000 * t)).astype(np.uint8).tobytes()
    mels, _ = audio.log_mel(tone)
    assert set(mels[5:-5].argmax(axis=1).tolist()) == {int(audio.FILTERS[round(1_000 / (audio.RATE * audio.UP / audio.DOWN / 2) * 128)].argmax())}


def test_tiles_give_the_same(monkeypatch):
    s = np.random.default_rng(2).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    whole = audio.log_mel(s)
    monkeypatch.setattr(audio, "TILE", 37)
    for a, b in zip(whole, audio.log_mel(s)):
        np.testing.assert_allclose(a, b, atol=1e-4)


def test_hysteresis():
    e = np.array([0, 1, 3, 1, 0, 1, 1, 0, 3, 3, 1], float)
    assert audio.segments(e) == [(1, 4), (8, 11)] and audio.segments(np.zeros(3)) == []


def test_tensors(spark):
    df = audio.tensors(audio.media(spark.createDataFrame([(1, "abc " * 9_000, None, None)], SCHEMA)))
    rows = df.orderBy("start").collect()
    mels, _ = audio.log_mel(audio.payload(b"abc " * 9_000))
    assert len(rows) == -(-len(mels) // audio.FRAMES) and all(len(r.mel) == audio.FRAMES * audio.MELS for r in rows)
    np.testing.assert_allclose(np.concatenate([np.reshape(r.mel, (audio.FRAMES, -1)) for r in rows])[: len(mels)], mels, atol=1e-6)
    assert rows[0].start == 0 and all(a.start < a.end for a in rows)
    kind = audio.read(audio.write(audio.tensor_batch([audio.windows(mels)]))).schema.field("mel").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [audio.FRAMES, audio.MELS]


def test_empty(spark):
    assert audio.digests(audio.media(spark.createDataFrame([], SCHEMA))).count() == 0


def test_features_from_stored_tensors():
    clips = [audio.payload(b"abc " * n) for n in (0, 7, 900, 9_000)] + [b"\x80" * 64, bytes(range(256)) * 40]
    together, alone = audio.features(clips), [audio.features([c])[0] for c in clips]
    assert together == alone
    for c, f in zip(clips, alone):
        mels, energy = audio.log_mel(c)
        assert f.startswith(f"frames={len(mels)};segments={len(audio.segments(energy))};")
    assert audio.features([]) == []
