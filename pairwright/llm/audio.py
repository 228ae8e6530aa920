"""Media columns: audio as stored bytes, its features as fixed-shape tensors with time spans.

Audio is kept as a WAV of 8-bit samples. Features of the bytes read back:

* polyphase resampling: a windowed-sinc low-pass filter, split into one short filter for each phase, so
  that only samples which stay are computed;
* a log-mel filterbank of overlapped, windowed frames;
* segments of sound by hysteresis: a segment opens where a frame's energy is above a high threshold and
  goes on, either way, while it is above a low one.

Features are computed over tiles of frames of one clip, so that a clip of any length takes bounded
memory, and clip by clip, so that equal clips give equal values. They are cut into windows of ``FRAMES``
frames, the last one filled with zeros, and stored as fixed-shape Arrow tensors with start and end in
seconds, beside the spans of the segments; ``digests`` reads what it says of a clip back from these.

Defined results: a null or empty text gives one block of zero bytes; a text of any length is one clip;
repeated rows stay as rows; columns of other names have no effect; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import quoted, released, table, text_batches, texts, utf8

BLOCK = 64
RATE = 16_000
UP, DOWN = 2, 3
TAPS = 16
WINDOW, HOP, BINS = 200, 80, 256
MELS = 32
FRAMES = 96
TILE = 2_048
#: Bytes of clips whose tensors are stored together.
TOGETHER = 1 << 20
HIGH, LOW = 2.0, 0.5


def payload(text: bytes) -> bytes:
    """The text with zero bytes added up to a positive multiple of 64."""
    return text + bytes(-len(text) % BLOCK if text else BLOCK)


def encode_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV of unsigned 8-bit samples."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def decode_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate of a mono 8-bit WAV."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not a mono WAV of 8-bit samples")
        return w.readframes(w.getnframes()), w.getframerate()


@lru_cache
def low_pass(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Row p: the filter of output phase p, over 2 * taps input samples."""
    cut = 1.0 / max(up, down)
    rows = np.empty((up, 2 * taps))
    for p in range(up):
        t = np.arange(-taps + 1, taps + 1) - (p * down % up) / up
        rows[p] = np.sinc(t * cut * up if up > down else t * cut) * np.hanning(2 * taps + 2)[1:-1]
    return (rows / rows.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """x at up/down times its rate: ceil(len(x) * up / down) samples, zeros beyond both ends."""
    phases = low_pass(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate((np.zeros(taps - 1), x, np.zeros(taps + down + up)), dtype=np.float32)
    out = np.empty(n, dtype=np.float32)
    for first in range(min(up, n)):
        at, phase = divmod(first * down, up)
        row = phases[[p for p in range(up) if p * down % up == phase][0]]
        count = -(-(n - first) // up)
        y = np.zeros(count, dtype=np.float32)
        for d in range(down):
            taken = row[d::down]
            y += np.correlate(padded[at + d :: down][: count + len(taken) - 1], taken, "valid")
        out[first::up] = y
    return out


def mel_filters(rate: float, bins: int = BINS, mels: int = MELS) -> np.ndarray:
    """Triangles of equal width on the mel scale: (bins // 2 + 1, mels)."""
    to_mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(to_mel(20.0), to_mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.linspace(0, rate / 2, bins // 2 + 1)[:, None]
    rise = (f - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


FILTERS = mel_filters(RATE * UP / DOWN)
HANN = np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def log_mel(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) of log-mel energies and (frames,) of log energies, of the resampled audio."""
    n = -(-len(samples) * UP // DOWN)
    frames = max(1, 1 + -(-(n - WINDOW) // HOP))
    mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    raw = np.frombuffer(samples, dtype=np.uint8)
    edge = TAPS * DOWN
    for first in range(0, frames, TILE):
        count = min(TILE, frames - first)
        a, b = first * HOP, (first + count - 1) * HOP + WINDOW
        lo = max(0, a * DOWN // UP - edge)
        piece = (raw[lo : b * DOWN // UP + edge].astype(np.float32) - 128) / 128
        y = resample(piece)[a - lo * UP // DOWN :][: b - a]
        y = np.concatenate((y, np.zeros(b - a - len(y), np.float32)))
        cut = np.lib.stride_tricks.sliding_window_view(y, WINDOW)[::HOP][:count] * HANN
        wave_ = np.fft.rfft(cut, BINS, axis=1)
        power = wave_.real**2 + wave_.imag**2
        mels[first : first + count] = np.log(power.astype(np.float32) @ FILTERS + 1e-6)
        energy[first : first + count] = np.log(np.einsum("ij,ij->i", cut, cut) + 1e-6)
    return mels, energy


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """(first, end) frames of each run above ``low`` that somewhere reaches ``high``."""
    over = np.concatenate(([False], energy > low, [False]))
    edges = np.flatnonzero(over[1:] != over[:-1])
    loud = np.concatenate(([0], np.cumsum(energy >= high)))
    return [(s, e) for s, e in edges.reshape(-1, 2).tolist() if loud[e] > loud[s]]


def spans(runs: list[tuple[int, int]], rate: float = RATE * UP / DOWN) -> list[tuple[float, float]]:
    """Start and end in seconds."""
    return [(s * HOP / rate, ((e - 1) * HOP + WINDOW) / rate) for s, e in runs]


def windows(mels: np.ndarray) -> list[tuple[float, float, np.ndarray]]:
    """(start, end, tensor of FRAMES x MELS) for each window; the end is that of the last real frame."""
    found = []
    for i in range(0, len(mels), FRAMES):
        part = mels[i : i + FRAMES]
        (start, end), = spans([(i, i + len(part))])
        found.append((start, end, np.concatenate((part, np.zeros((FRAMES - len(part), MELS), np.float32)))))
    return found


def tensor_batch(clips: list[list[tuple[float, float, np.ndarray]]]) -> pa.RecordBatch:
    """The windows of some clips as an Arrow batch: clip, start, end, mel as a fixed-shape tensor."""
    found = [w for c in clips for w in c]
    kind = pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS))
    flat = pa.array(np.concatenate([t.ravel() for *_, t in found]) if found else np.zeros(0, np.float32), pa.float32())
    mel = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, FRAMES * MELS))
    clip = np.repeat(np.arange(len(clips)), [len(c) for c in clips])
    return pa.RecordBatch.from_arrays([pa.array(clip, pa.int64()), pa.array([s for s, *_ in found], pa.float64()), pa.array([e for _, e, _ in found], pa.float64()), mel], names=["clip", "start", "end", "mel"])


def segment_batch(clips: list[list[tuple[float, float]]]) -> pa.RecordBatch:
    """The segments of some clips: clip, start, end."""
    clip = np.repeat(np.arange(len(clips)), [len(c) for c in clips])
    return pa.RecordBatch.from_arrays([pa.array(clip, pa.int64()), *[pa.array([x[k] for c in clips for x in c], pa.float64()) for k in (0, 1)]], names=["clip", "start", "end"])


def write(batch: pa.RecordBatch) -> pa.Buffer:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema) as w:
        w.write_batch(batch)
    return out.getvalue()


def read(stored: pa.Buffer) -> pa.RecordBatch:
    with pa.ipc.open_stream(stored) as r:
        return r.read_next_batch()


def features(clips: list[bytes]) -> list[str]:
    """The features of each clip in short, read back from the stored tensors and spans: frames, segments,
    seconds of sound, mean and deviation of four mel bands."""
    found, sounds = [], []
    for c in clips:
        mels, energy = log_mel(c)
        found.append(windows(mels))
        sounds.append(spans(segments(energy)))
    tensors_, segments_ = read(write(tensor_batch(found))), read(write(segment_batch(sounds)))
    mel = tensors_.column(3).to_numpy_ndarray()
    clip, start, end = (tensors_.column(i).to_numpy() for i in range(3))
    real = np.rint(((end - start) * RATE * UP / DOWN - WINDOW) / HOP).astype(np.int64) + 1
    of, low, high = (segments_.column(i).to_numpy() for i in range(3))
    at, within = np.searchsorted(clip, np.arange(len(clips) + 1)), np.searchsorted(of, np.arange(len(clips) + 1))
    out = []
    for k in range(len(clips)):
        frames = int(real[at[k] : at[k + 1]].sum())
        bands = mel[at[k] : at[k + 1]].reshape(-1, MELS)[:frames].reshape(frames, 4, -1).mean(axis=2, dtype=np.float64)
        here = slice(within[k], within[k + 1])
        numbers = ",".join(f"{x:.2f}" for x in (*bands.mean(axis=0), *bands.std(axis=0)))
        out.append(f"frames={frames};segments={within[k + 1] - within[k]};sound={sum((high[here] - low[here]).tolist()):.3f};bands={numbers}")
    return out


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media (the WAV) for each row of docs."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in _slices(b):
                raw = list(texts(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([encode_wav(payload(t)) for t in raw], pa.binary())], names=["id", "n_bytes", "media"])

    return text_batches(docs).select(F.col(quoted(id_col)).alias("id"), utf8(text_col).alias("t")).mapInArrow(released(run), f"id {kind}, n_bytes long, media binary")


def _slices(b: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, b.num_rows, rows):
        yield b.slice(i, rows)


def digests(clips: DataFrame) -> DataFrame:
    """clips (id, n_bytes, media) -> id, n_bytes and digests of the bytes read back, with features."""
    kind = dict(clips.dtypes)["id"]
    out = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def told(part: pa.RecordBatch, rows: list[tuple], clips_: list[bytes]) -> pa.RecordBatch:
        cols = [pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)]
        return pa.RecordBatch.from_arrays([*part.columns[:2], *cols, pa.array(features(clips_), pa.string())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first, size, rows, held = 0, 0, [], []
            for i, x in enumerate(b.column(2)):
                m = x.as_py()
                s, _ = decode_wav(m)
                rows.append((len(s), hashlib.sha256(s).hexdigest(), zlib.crc32(s[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest()))
                held.append(s)
                size += len(s)
                if size >= TOGETHER or len(rows) >= 256 or i + 1 == b.num_rows:
                    yield told(b.slice(first, len(rows)), rows, held)
                    first, size, rows, held = i + 1, 0, [], []

    return clips.select("id", "n_bytes", "media").mapInArrow(released(run), out)


def tensors(clips: DataFrame) -> DataFrame:
    """clips (id, media) -> id, start, end, mel (FRAMES * MELS floats by row) for each window of each clip.

    Spark has no tensor type: the column holds the tensor's storage; ``tensor_batch`` gives the Arrow type, in
    which ``write`` stores it.
    """
    kind = dict(clips.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                t = tensor_batch([windows(log_mel(decode_wav(b.column(1)[i].as_py())[0])[0])])
                for part in _slices(t, 256):
                    mel = part.column(3).storage
                    yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * part.num_rows, b.column(0).type), part.column(1), part.column(2), mel.cast(pa.list_(pa.float32()))], names=["id", "start", "end", "mel"])

    return clips.select("id", "media").mapInArrow(released(run), f"id {kind}, start double, end double, mel array<float>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(media(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")
