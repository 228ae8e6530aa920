"""SentencePiece encoding and decoding in batched numpy.

A model file's pieces, kinds and scores are read from its bytes. Text is cut where no piece can cross
(before each run of spaces), and the different words of a batch are encoded together, the longest first:
place by place, all substrings that end there are looked up by their hash among the sorted piece keys, and
the best way to each place is kept with a pointer back, by maxima over whole arrays.

For a unigram model the best way has the largest sum of scores (Viterbi; of equal ways the one with the
longest last piece). A BPE model's scores are merge ranks, whose sum means nothing: summed, they give other
ids than the model's own for most words. There the lattice is the same, and a step from one piece to the
next costs nothing if merging their letters alone gives just these two pieces, and is barred otherwise;
the way that is left is the model's own encoding. What two pieces merge to is found for all new pairs of a
batch at once, and remembered.

Characters without a piece become byte pieces, or the unknown piece if the model has none (alike characters
in a row become one). Decoding gives back the text, but for unknown pieces.

A long word (text without spaces, base64) would advance alone, a letter at a time. It is cut into windows
that overlap, which advance together as words of one length do. What a place's best way is depends on the
last few places only; so a window is right from where it agrees, over as many places as the longest piece has letters,
with with the window before it. Where it doesn't, as in one letter repeated, places are gone through one by one.

``by_scores`` reads any model as a unigram one, whose piece of rank r has the probability 1 / (r + 10), but
for a factor: the largest sum of scores, over the pieces of a BPE model.

Defined results: a null or empty text has no ids and decodes to the empty text; invalid bytes become
U+FFFD; of ways of equal worth the one with the longest last piece is taken; repeated rows stay as rows;
columns of any name stay as they are; an empty table gives no rows. A word of any length is encoded whole.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
import struct
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import columns as named
from pairwright.llm.common import fresh, held, in_arrow, quoted, schema_of, table, text_batches, texts, utf8

#: Where the query finds its model.
MODEL = os.environ.get("PAIRWRIGHT_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
NORMAL, UNKNOWN, CONTROL, OWN, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Bytes of words and their ids that a worker remembers (with OVERHEAD for each), and slots for pairs of
#: pieces; both only save time.
KEPT, OVERHEAD, PAIRS = 48 << 20, 220, 1 << 21
#: Whose tasks of a worker share them.
OWNER = "pieces"
#: Letters from which on a word is cut into windows of CORE letters, each with WARM letters before it.
LONG, CORE, WARM = 400, 256, 64
#: Letters of words that advance together, with the room of the shorter ones.
CELLS = 400_000
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
BACK = np.uint64(pow(int(BASE), -1, 1 << 64))


def fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield tag >> 3, struct.unpack("<f" if kind == 5 else "<d", data[at : at + size])[0]
            at += size


class Pieces:
    """A model: its pieces with scores and kinds, and the look-up tables for encoding and decoding."""

    def __init__(self, model: bytes, by_scores: bool = False):
        self.text: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, self.prefix, self.squeeze, charsmap = UNIGRAM, True, True, b""
        for n, v in fields(model):
            if n == 1:
                piece = dict(fields(v))
                self.text.append(piece.get(1, b"").decode())
                self.scores.append(piece.get(2, 0.0))
                self.kinds.append(piece.get(3, NORMAL))
            elif n == 2:
                self.type = dict(fields(v)).get(3, UNIGRAM)
            elif n == 3:
                spec = dict(fields(v))
                charsmap = spec.get(2, b"")
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if self.type not in (UNIGRAM, BPE):
            raise ValueError("neither a unigram nor a BPE model")
        if charsmap:
            raise ValueError("the model maps characters before encoding, which is not supported")
        usable = [i for i, k in enumerate(self.kinds) if k in (NORMAL, OWN) and self.text[i]]
        if any(SPACE in self.text[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece crosses a space")
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else -1
        self.bytes = {int(self.text[i][1:-1], 16): i for i, k in enumerate(self.kinds) if k == BYTE}
        self.longest = max((len(self.text[i]) for i in usable), default=1)
        hashes = self._hashes([self.text[i] for i in usable])
        order = np.argsort(hashes, kind="stable")
        self.keys, self.ids = hashes[order], np.array(usable, dtype=np.int32)[order]
        self.maybe = np.zeros(1 << 21, dtype=bool)
        self.maybe[self.keys >> np.uint64(43)] = True
        if len(np.unique(self.keys)) < len(self.keys):
            raise ValueError("two pieces have one hash")
        heads = np.arange((1 << 18) + 1, dtype=np.uint64)
        self.head = np.searchsorted(self.keys >> np.uint64(46), heads).astype(np.int32)
        self.steps = int(np.diff(self.head).max())
        self.lengths = np.array([len(t) for t in self.text], dtype=np.int64)
        self.letters = np.zeros((len(self.text), self.longest), dtype=np.uint32)
        for i in usable:
            self.letters[i, : len(self.text[i])] = [ord(c) for c in self.text[i]]
        self.worth = np.array(self.scores, dtype=np.float32)
        if by_scores and self.type == BPE:
            self.type = UNIGRAM
            rank = np.empty(len(usable))
            rank[np.argsort(-self.worth[usable], kind="stable")] = np.arange(len(usable))
            self.worth[usable] = -np.log(rank + 10)
        self.pairs, self.fits = np.full(PAIRS, -1, dtype=np.int64), np.zeros(PAIRS, dtype=bool)
        self.fixed: np.ndarray | None = None
        self.words: dict[str, bytes] = {}
        self.kept = 0
        self.named: dict[str, int] = {}
        self.seen: dict[tuple[int, int, bool], bool] = {}
        spelled = [bytes([int(t[1:-1], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else t.encode() for t, k in zip(self.text, self.kinds)]
        self.spelled = [x.replace(SPACE.encode(), b" ") for x in spelled]
        if self.unknown >= 0:
            self.spelled[self.unknown] = " ⁇ ".encode()

    # Hashes -------------------------------------------------------------------------------------------

    @staticmethod
    def _sums(codes: np.ndarray) -> np.ndarray:
        """(words, length + 1): running polynomial sums of the letters, modulo 2**64."""
        powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(0, codes.shape[1] - 1), BASE, np.uint64))), dtype=np.uint64)[: codes.shape[1]]
        out = np.zeros((len(codes), codes.shape[1] + 1), dtype=np.uint64)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * powers, axis=1, dtype=np.uint64, out=out[:, 1:])
        return out

    @staticmethod
    def _mix(h: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        h = h + np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        return (h ^ (h >> np.uint64(31))) * BASE  # the first bits of one letter's sum are all alike before

    @staticmethod
    def _codes(words: list[str], size: int) -> np.ndarray:
        return np.array(words, dtype=f"<U{size}").view(np.uint32).reshape(-1, size)

    def _hashes(self, words: list[str]) -> np.ndarray:
        out = np.zeros(len(words), dtype=np.uint64)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(len(w), []).append(i)
        for size, at in by.items():
            out[at] = self._mix(self._sums(self._codes([words[i] for i in at], size))[:, -1], size)
        return out

    def _probe(self, h: np.ndarray) -> np.ndarray:
        """The piece with each hash, or -1: a bitmap of the keys' first bits spares most searches, the others
        go through the keys that have the same first bits."""
        out = np.full(h.shape, -1, dtype=np.int32)
        some = np.flatnonzero(self.maybe.take((h >> np.uint64(43)).view(np.int64)))
        wanted = h.take(some)
        at = self.head.take((wanted >> np.uint64(46)).view(np.int64))
        for _ in range(self.steps):
            if not len(some):
                break
            there = self.keys.take(at, mode="clip")
            same = there == wanted
            out[some[same]] = self.ids.take(at[same])
            on = np.flatnonzero(there < wanted)
            some, wanted, at = some.take(on), wanted.take(on), at.take(on) + 1
        return out

    @staticmethod
    def _back(n: int) -> np.ndarray:
        return np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(0, n - 1), BACK, np.uint64))), dtype=np.uint64)[:n]

    # Encoding of words side by side ---------------------------------------------------------------------

    def _ways(self, codes: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(words, length + 1): the last piece of the best way to each place (-1: a lone character), and where it starts.
        sizes: how many letters each word has, the longest first; by default all that codes has room for."""
        return self._best_ways(codes, sizes)[:2]

    def _best_ways(self, codes: np.ndarray, sizes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same, with each way's worth."""
        n, size = codes.shape
        reach = [n] * (size + 1) if sizes is None else np.searchsorted(-sizes, -np.arange(size + 1), side="right").tolist()
        back = self._back(size + 1)
        sums = np.ascontiguousarray(self._sums(codes).T)  # a row for each place: rows of words are gathered from it
        last = np.full((size + 1, n), -2, dtype=np.int32)
        start = np.zeros((size + 1, n), dtype=np.int32)
        best = np.full((size + 1, n), -np.inf, dtype=np.float32)
        best[0] = 0.0
        lone = np.float32(self.worth[self.ids].min() - 10.0)
        for end in range(1, size + 1):
            open_ = every = np.arange(reach[end])  # BPE: words whose only way to this place is still to be found
            for first in range(max(0, end - self.longest), end):
                rows = open_ if self.type == BPE else every
                if not len(rows):
                    break
                h = (sums[end].take(rows) - sums[first].take(rows)) * back[first]
                piece = self._probe(self._mix(h, end - first))
                single = end - first == 1
                known = np.flatnonzero((piece >= 0) | single)
                rows, piece = rows.take(known), piece.take(known)
                if not len(rows):
                    continue
                if self.type == BPE:
                    fits = self._follows(last[first].take(rows), piece, first)
                    if single:
                        fits |= last[end].take(rows) == -2  # nothing else is left
                    total = np.where(fits, np.float32(0), np.float32(-np.inf))
                else:
                    total = best[first].take(rows) + np.where(piece >= 0, self.worth[piece], lone)
                better = total > best[end].take(rows)
                rows, piece = rows[better], piece[better]
                best[end, rows], last[end, rows], start[end, rows] = total[better], piece, first
                if self.type == BPE and len(rows):
                    open_ = open_[last[end].take(open_) == -2]
        return tuple(np.ascontiguousarray(x.T) for x in (last, start, best))

    def _windows(self, word: str) -> tuple[list[int], list[int]]:
        """What _ways gives for one word of many letters, by windows that advance together."""
        codes, wide = self._codes([word], len(word))[0], CORE + WARM
        n = len(codes)
        count = max(1, -(-(n - WARM) // CORE))
        padded = np.concatenate((codes, np.zeros(max(0, count * CORE + WARM - n), codes.dtype)))  # zeros are in no piece
        cut = np.lib.stride_tricks.sliding_window_view(padded, wide)[::CORE]
        last, start, best = np.full(n + 1, -2, np.int32), np.zeros(n + 1, np.int64), np.zeros(n + 1, np.float64)
        for low in range(0, count, 4_096):
            found = self._best_ways(np.ascontiguousarray(cut[low : low + 4_096]))
            for i, (l, s, w) in enumerate(zip(*found)):
                first = (low + i) * CORE
                done, end = (first + WARM, min(n, first + wide)) if first else (-1, min(n, wide))
                back = slice(done - self.longest + 1, done + 1)
                if first and not self._agree((last[back], best[back]), (l[WARM - self.longest + 1 : WARM + 1], w[WARM - self.longest + 1 : WARM + 1])):
                    self._go_on(word, last, start, best, done + 1, end)
                    continue
                skip = WARM + 1 if first else 0
                part = slice(skip, skip + end - done)
                last[done + 1 : end + 1], start[done + 1 : end + 1] = l[part], s[part] + first
                best[done + 1 : end + 1] = w[part] + (best[done] - float(w[WARM]) if first else 0)
        return last.tolist(), start.tolist()

    def _agree(self, a: tuple, b: tuple) -> bool:
        """Whether what follows is the same after these ways to as many places as the longest piece has letters."""
        if not (a[0] == b[0]).all() or (b[0] == -2).any():
            return False
        return self.type == BPE or np.allclose(a[1] - a[1][-1], b[1] - b[1][-1], rtol=0, atol=1e-3)

    def _go_on(self, word: str, last: np.ndarray, start: np.ndarray, best: np.ndarray, low: int, high: int) -> None:
        """The ways to the places low to high, one by one, from those before."""
        if not self.named:
            self.named = {self.text[i]: i for i in self.ids.tolist()}
        lone = float(self.worth[self.ids].min()) - 10.0
        base = max(0, low - self.longest)
        ways, worth = last[base:low].tolist(), best[base:low].tolist()
        for end in range(low, high + 1):
            way, at, top = -2, 0, -math.inf
            for first in range(max(0, end - self.longest), end):
                piece = self.named.get(word[first:end], -1)
                if piece < 0 and end - first > 1:
                    continue
                if self.type != BPE:
                    total = worth[first - base] + (float(self.worth[piece]) if piece >= 0 else lone)
                    if total > top:
                        way, at, top = piece, first, total
                elif end - first == 1 or self._may_follow(ways[first - base], piece, first):
                    way, at, top = piece, first, 0.0
                    break
            ways.append(way)
            worth.append(top)
            last[end], start[end], best[end] = way, at, top

    def _may_follow(self, a: int, b: int, first: int) -> bool:
        known = self.seen.get((a, b, first == 0))
        if known is None:
            if len(self.seen) >= PAIRS >> 4:
                self.seen.clear()
            known = self.seen[a, b, first == 0] = bool(self._follows(np.array([a]), np.array([b]), first)[0])
        return known

    def _follows(self, a: np.ndarray, b: np.ndarray, first: int) -> np.ndarray:
        """Whether piece b (-1: a character without a piece) can stand after the piece a in a BPE encoding."""
        if self.fixed is None:
            self._histories()
        ok = (b < 0) | self.fixed[b]
        if first == 0:
            return ok
        ask = np.flatnonzero(ok & (a >= 0) & (b >= 0))
        if len(ask):
            key = a[ask].astype(np.int64) * len(self.text) + b[ask]
            slot = (key * 0x9E3779B1 >> 12) & (PAIRS - 1)
            new = np.flatnonzero(self.pairs[slot] != key)
            got = self.fits[slot]
            if len(new):
                some, which = np.unique(key[new], return_inverse=True)
                fits = self._stay(some)
                at = (some * 0x9E3779B1 >> 12) & (PAIRS - 1)
                self.pairs[at] = some  # of two in one slot the last stays
                keep = self.pairs[at] == some
                self.fits[at[keep]] = fits[keep]
                got[new] = fits[which]
            ok[ask] = got
        return ok & (a != -2)

    def _stay(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair of pieces (one number) stays as it is when the letters of both are merged."""
        a, b = pairs // len(self.text), pairs % len(self.text)
        fits = np.ones(len(pairs), dtype=bool)
        i, j = np.zeros(len(pairs), dtype=np.int64), np.zeros(len(pairs), dtype=np.int64)
        on = np.arange(len(pairs))
        while len(on):
            x, y, si, sj = a[on], b[on], i[on], j[on]
            size = self.right_size[x, si]
            across = self._probe(self._mix(self.right_sum[x, si] + self.left_sum[y, sj] * self.powers[size], size + self.left_size[y, sj]))
            worth = np.where(across >= 0, self.worth[across], -np.inf)
            mine, other = self.next_worth[x, si], self.next_worth[y, sj]
            joins = (worth > -np.inf) & (worth > mine) & (worth >= other)
            fits[on[joins]] = False
            left = mine >= other
            i[on] += left
            j[on] += ~left
            on = on[~joins & ((mine > -np.inf) | (other > -np.inf))]
        return fits

    def _histories(self) -> None:
        """How each piece comes about from its letters, by merging the pair of the highest score, the first of
        equal ones: before each merge its score, and sum and size of what then stands leftmost and rightmost.

        ``fixed`` tells which pieces come about at all. When two pieces stand side by side, either side goes
        through its own history, the better merge first, unless the pair across is better than both.
        """
        shape = (len(self.text), self.longest + 1)
        self.next_worth = np.full(shape, -np.inf)
        self.left_sum, self.right_sum = np.zeros(shape, np.uint64), np.zeros(shape, np.uint64)
        self.left_size, self.right_size = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.fixed = np.zeros(len(self.text), dtype=bool)
        self.powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(self.longest, BASE, np.uint64))), dtype=np.uint64)
        for size in np.unique(self.lengths[self.ids]).tolist():
            ids = self.ids[self.lengths[self.ids] == size]
            sums, back = self._sums(self.letters[ids, :size]), self._back(size + 1)
            row = np.arange(len(ids))
            starts = np.ones((len(ids), size + 1), dtype=bool)  # the last column: the end of the word
            for step in range(size):
                place = np.where(starts, np.arange(size + 1), size)
                after = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1]  # the first start at or after each place
                nxt = np.concatenate((after[:, 1:], np.full((len(ids), 1), size)), axis=1)
                end = np.take_along_axis(nxt, np.minimum(nxt, size), 1)
                r, c = np.nonzero(starts[:, :size] & (nxt[:, :size] < size))
                e = end[r, c]
                piece = self._probe(self._mix((sums[r, e] - sums[r, c]) * back[c], e - c))
                worth = np.full((len(ids), size), -np.inf)
                worth[r, c] = np.where(piece >= 0, self.worth[piece], -np.inf)
                top = worth.argmax(axis=1)
                final = size - 1 - starts[:, size - 1 :: -1].argmax(axis=1) if size > 1 else np.zeros(len(ids), np.int64)
                self.next_worth[ids, step] = worth[row, top]
                self.left_sum[ids, step], self.left_size[ids, step] = sums[row, nxt[:, 0]], nxt[:, 0]
                self.right_sum[ids, step], self.right_size[ids, step] = (sums[:, size] - sums[row, final]) * back[final], size - final
                some = np.flatnonzero(worth[row, top] > -np.inf)
                starts[some, nxt[some, top[some]]] = False
            self.fixed[ids] = starts[:, :size].sum(axis=1) == 1

    def _spell(self, word: str, last: np.ndarray, start: np.ndarray) -> bytes:
        """The ids of a word that has characters without a piece."""
        cut = []
        end = len(word)
        while end:
            first, piece = int(start[end]), int(last[end])
            cut.append((piece, word[first:end]))
            end = first
        out: list[int] = []
        for piece, part in reversed(cut):
            if piece >= 0:
                out.append(piece)
            elif len(self.bytes) == 256:
                out += [self.bytes[b] for b in part.encode("utf-8", "replace")]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return np.array(out, dtype=np.int32).tobytes()

    def _read_back(self, words: list[str], last: np.ndarray, start: np.ndarray) -> list[bytes]:
        """The ids of each word, following all pointers back together."""
        row = np.arange(len(words))
        end = np.array([len(w) for w in words])
        steps = []
        while end.any():
            steps.append(np.where(end > 0, last[row, end], -3))
            end = np.where(end > 0, start[row, end], 0)
        way = np.stack(steps[::-1], axis=1)
        flat = way[way != -3].astype(np.int32)
        ends = np.cumsum((way != -3).sum(axis=1)) * 4
        raw = flat.tobytes()
        out = [raw[i:j] for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())]
        for i in np.flatnonzero((way == -1).any(axis=1)).tolist():
            out[i] = self._spell(words[i], last[i], start[i])
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word (with its leading space marks) as int32; words of similar lengths advance together."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        long, some = int((sizes >= LONG).sum()), int((sizes > 0).sum())
        for i in order[:long].tolist():
            out[i] = self._spell(words[i], *self._windows(words[i]))
        k = long
        while k < some:
            size = int(sizes[k])
            upto = min(some, k + max(1, CELLS // size))
            at = order[k:upto].tolist()
            part = [words[i] for i in at]
            for i, x in zip(at, self._read_back(part, *self._ways(self._codes(part, size), sizes[k:upto]))):
                out[i] = x
            k = upto
        return out

    # Texts ----------------------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return []
        return WORD.findall((SPACE if self.prefix else "") + text.replace(" ", SPACE))

    def encode(self, docs: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        split = [self.split(t) for t in docs]
        if self.kept > KEPT:
            self.words, self.kept = {}, 0
        new = list(set().union(*split) - self.words.keys())
        ids = self.encode_words(new)
        self.words.update(zip(new, ids))
        self.kept += sum(map(len, new)) + sum(map(len, ids)) + OVERHEAD * len(new)
        known = self.words.__getitem__
        return [np.frombuffer(b"".join(map(known, d)), dtype=np.int32) for d in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids; bytes that are no UTF-8 become U+FFFD."""
        spelled = self.spelled
        raw = b"".join(map(spelled.__getitem__, ids.tolist()))
        if self.prefix and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode("utf-8", "replace")


def shared(model: bytes, by_scores: bool = False) -> Pieces:
    """The model's pieces, kept by the process with all that they have learned, over the tasks of a worker."""
    kept = held(OWNER)
    name = hashlib.sha256(model).hexdigest(), by_scores
    if name not in kept:
        kept.clear()
        kept[name] = Pieces(model, by_scores)
    return kept[name]


def blocks(b: pa.RecordBatch, most: int = 3_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with the texts of its first column, of some ``most`` bytes each."""
    first, size, found = 0, 0, []
    for i, t in enumerate(texts(b.column(0))):
        found.append(t.decode("utf-8", "replace"))
        size += len(t)
        if size >= most or i + 1 == b.num_rows:
            yield b.slice(first, len(found)), found
            first, size, found = i + 1, 0, []


def load(path: str = MODEL) -> Pieces:
    return Pieces(Path(path).read_bytes())


def encode(docs: DataFrame, model: bytes, columns: list[str], text_col: str = "text", check: bool = False, by_scores: bool = False) -> DataFrame:
    """The named columns of docs with ids (array<int>); with check, also text_sha256 of the decoded text
    and round_trip, whether it is the text."""
    (raw,) = fresh(columns, "utf8")
    rows = text_batches(docs).select(utf8(text_col).alias(raw), *named(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(model, by_scores)
        for b in batches:
            for part, docs_ in blocks(b):
                ids = pieces.encode(docs_)
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                out = [*part.columns[1:], pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int32)))]
                if check:
                    back = [pieces.decode(x) for x in ids]
                    out += [pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([x == y for x, y in zip(back, docs_)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(out, names=[*columns, "ids", *["text_sha256", "round_trip"] * check])

    return in_arrow(rows, run, schema_of(docs, columns, "ids array<int>", *["text_sha256 string", "round_trip boolean"] * check), OWNER)


def decode(encoded: DataFrame, model: bytes, columns: list[str], ids_col: str = "ids") -> DataFrame:
    """The named columns of encoded with text, decoded from the ids; null ids give the empty text."""
    (raw,) = fresh(columns, "ids")
    rows = encoded.select(F.coalesce(F.col(quoted(ids_col)), F.array().cast("array<int>")).alias(raw), *named(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared(model)
        for b in batches:
            found = [pieces.decode(np.array(x, dtype=np.int32)) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(found, pa.string())], names=[*columns, "text"])

    return in_arrow(rows, run, schema_of(encoded, columns, "text string"), OWNER)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_ids, sha256 of the text decoded from them, and whether that is the text."""
    found = encode(table(spark, sf_dir, "documents"), Path(MODEL).read_bytes(), ["doc_id"], check=True)
    return found.withColumn("n_ids", F.size("ids").cast("long"))


def by_scores_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the largest sum of scores."""
    found = encode(table(spark, sf_dir, "documents"), Path(MODEL).read_bytes(), ["doc_id"], check=True, by_scores=True)
    return found.withColumn("n_ids", F.size("ids").cast("long"))
