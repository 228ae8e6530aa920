"""Language identification by a byte convolutional network, trained here in numpy.

Bytes are embedded; filters of several widths slide over windows of ``WINDOW`` bytes; each filter's
maximum over the window goes through a ReLU into a softmax over the languages. A text is cut into
consecutive windows, all of it, and its windows' logits are averaged by their bytes.

Training uses a bounded sample: of each language the ``per_language`` labelled rows with the smallest
hash, one piece of each at a place that the hash picks. That, the seeds and the order are fixed, so that
reruns agree.

Defined results: ``und`` with score 0 for a null text, a text without a letter, or if no language was
learned; the language, source and id of a row are never looked at when it is predicted; repeated rows
stay as rows; columns of other names have no effect; equal hashes in the sample go by text; a text of any
length is read whole; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.common import fresh, quoted, released, small, stored, table, text_batches, texts, utf8

WINDOW = 256
WIDE = 5
WIDTHS = (2, 3, 4, 5)
EACH = 8
DEPTH = 8
PER_LANGUAGE = 500
EPOCHS = 16
BATCH = 64
RATE = 4e-3
CHUNK = 512


@dataclass
class Network:
    languages: list[str]
    embed: np.ndarray  # (256, DEPTH)
    filters: np.ndarray  # (WIDE * DEPTH, filters); narrow ones are zero beyond their width
    bias: np.ndarray
    out: np.ndarray  # (filters, languages)
    out_bias: np.ndarray


def _columns(windows: np.ndarray, embed: np.ndarray) -> np.ndarray:
    """(windows, places, WIDE * DEPTH): the embedded bytes that each place of a filter sees."""
    e = embed[windows]
    n, w, d = e.shape
    view = np.lib.stride_tricks.as_strided(e, (n, w - WIDE + 1, WIDE * d), (e.strides[0], e.strides[1], e.itemsize), writeable=False)
    return np.ascontiguousarray(view)


def logits(net: Network, windows: np.ndarray) -> np.ndarray:
    """(windows, languages) for uint8 windows of WINDOW bytes."""
    found = []
    for i in range(0, len(windows), CHUNK):
        cols = _columns(windows[i : i + CHUNK], net.embed)
        n, places, k = cols.shape
        z = (cols.reshape(-1, k) @ net.filters).reshape(n, places, -1).max(axis=1)
        found.append(np.maximum(z + net.bias, 0) @ net.out + net.out_bias)
    return np.concatenate(found) if found else np.zeros((0, len(net.languages)), np.float32)


def cut(text: bytes, size: int = WINDOW) -> np.ndarray:
    """All of the text as windows of that many bytes, zeros after its end."""
    padded = text + bytes(-len(text) % size)
    return np.frombuffer(padded, dtype=np.uint8).reshape(-1, size)


def train(samples: list[tuple[bytes, str]], epochs: int = EPOCHS, seed: int = 1) -> Network | None:
    """A network for (text, language) samples, by Adam on the cross entropy; None without samples."""
    languages = sorted({y for _, y in samples})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    f = EACH * len(WIDTHS)
    mask = np.zeros((WIDE, DEPTH, f), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[:w, :, k * EACH : (k + 1) * EACH] = 1
    mask = mask.reshape(WIDE * DEPTH, f)
    normal = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
    net = Network(languages, normal(256, DEPTH, s=0.5), normal(WIDE * DEPTH, f, s=0.2) * mask, np.zeros(f, np.float32), normal(f, len(languages), s=0.2), np.zeros(len(languages), np.float32))
    names = ("embed", "filters", "bias", "out", "out_bias")
    moments = {n: [np.zeros_like(getattr(net, n)), np.zeros_like(getattr(net, n))] for n in names}
    x = np.stack([cut(t[:WINDOW].ljust(WINDOW, b"\0"))[0] for t, _ in samples])
    y = np.array([languages.index(v) for _, v in samples])
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            at = order[i : i + BATCH]
            batch = x[at].copy()
            short = rng.random(len(at)) < 0.3
            keep = np.where(short, rng.integers(12, WINDOW, len(at)), WINDOW)
            batch[np.arange(WINDOW)[None, :] >= keep[:, None]] = 0
            grads = _gradients(net, batch, y[at], mask)
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for n in names:
                m, v = moments[n]
                m += 0.1 * (grads[n] - m)
                v += 0.001 * (grads[n] ** 2 - v)
                setattr(net, n, getattr(net, n) - (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32))
    return net


def _gradients(net: Network, x: np.ndarray, y: np.ndarray, mask: np.ndarray) -> dict[str, np.ndarray]:
    cols = _columns(x, net.embed)
    n, places, k = cols.shape
    z = (cols.reshape(-1, k) @ net.filters).reshape(n, places, -1)
    where = z.argmax(axis=1)
    top = np.take_along_axis(z, where[:, None, :], 1)[:, 0] + net.bias
    hidden = np.maximum(top, 0)
    out = hidden @ net.out + net.out_bias
    p = np.exp(out - out.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(n), y] -= 1
    p /= n
    d_top = (p @ net.out.T) * (top > 0)
    seen = cols[np.arange(n)[:, None], where]  # (n, filters, k): what won
    d_filters = np.einsum("nf,nfk->kf", d_top, seen) * mask
    d_cols = (d_top[:, :, None] * net.filters.T[None]).reshape(n, -1, WIDE, DEPTH)
    bytes_ = x[np.arange(n)[:, None, None], where[:, :, None] + np.arange(WIDE)]
    d_embed = np.zeros_like(net.embed)
    np.add.at(d_embed, bytes_.ravel(), d_cols.reshape(-1, DEPTH))
    return {"embed": d_embed, "filters": d_filters, "bias": d_top.sum(axis=0), "out": hidden.T @ p, "out_bias": p.sum(axis=0)}


def least_hashes(rows: DataFrame, by: str, each: int, order: list[str]) -> DataFrame:
    """Of each value of ``by`` the ``each`` rows that come first in that order, which begins with a hash.

    Hashes beyond some threshold, by the number of rows, can't be among them and go first, so that what is
    ranked in one task is bounded, whatever the number of rows.
    """
    counts = small(stored(rows.groupBy(by).agg(F.count("*").alias("rows"))))
    share = F.least(F.lit(1.0), (each + 8 * math.sqrt(each) + 100) / F.col("rows"))
    low = rows.join(counts, by).where(F.col(order[0]).cast("double") <= -(2.0**63) + share * 2.0**64).drop("rows")
    n = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    (name,) = fresh(rows.columns, "n")
    return low.withColumn(name, n).where(F.col(name) <= each).select(rows.columns)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    """A network for the languages of the labelled rows (non-null language and text with a letter)."""
    rows = labelled.where(F.col(lang_col).isNotNull() & has_letter(F.col(quoted(text_col))))
    h = F.xxhash64(F.col(id_col), F.char_length(text_col))
    start = F.pmod(h, F.greatest(F.char_length(text_col) - WINDOW // 2, F.lit(1))) + 1
    rows = rows.select(F.col(lang_col).alias("lang"), h.alias("h"), F.substr(F.col(text_col), start.cast("int"), F.lit(WINDOW)).alias("piece"))
    chosen = least_hashes(rows, "lang", per_language, ["h", "piece"]).collect()  # per_language rows a language at most
    chosen.sort(key=lambda r: (r.h, r.lang, r.piece))
    return train([(r.piece.encode()[:WINDOW], r.lang) for r in chosen])


def has_letter(text: Column) -> Column:
    return F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))


def predict(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score for each row of docs."""
    kind = dict(docs.dtypes)[id_col]
    rows = text_batches(docs).select(F.col(quoted(id_col)).alias("id"), utf8(text_col).alias("t"), has_letter(F.col(quoted(text_col))).alias("letter"))

    def block(ids: list, parts: list[bytes], letter: list[bool]) -> pa.RecordBatch:
        windows = [cut(t) for t, yes in zip(parts, letter) if yes]
        lang, score = ["und"] * len(parts), [0.0] * len(parts)
        if windows and net:
            z = logits(net, np.concatenate(windows)).astype(np.float64)
            counts = np.array([len(w) for w in windows])
            weight = np.concatenate([np.minimum(WINDOW, len(t) - np.arange(len(w)) * WINDOW) for t, w in zip((t for t, yes in zip(parts, letter) if yes), windows)]).astype(np.float64)
            first = np.cumsum(counts) - counts
            mean = np.add.reduceat(z * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            for i, row in zip((i for i, yes in enumerate(letter) if yes), p):
                lang[i], score[i] = net.languages[int(row.argmax())], float(row.max())
        return pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, size, part = 0, 0, []
            letter = b.column(2).to_pylist()
            for i, t in enumerate(texts(b.column(1))):
                part.append(t)
                size += len(t)
                if size >= 1_000_000 or i + 1 == b.num_rows:
                    yield block(b.column(0).slice(at, len(part)), part, letter[at : at + len(part)])
                    at, size, part = i + 1, 0, []

    return rows.mapInArrow(released(run), f"id {kind}, lang_pred string, score double")


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % folds == fold, F.lit(False))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net = fit(docs.where(~held_out("doc_id", 4, 2)))
    found = predict(docs.select("doc_id", "text"), net).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
