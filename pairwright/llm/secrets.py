"""Secret scans: fixed patterns, and guess costs of values that stand where credentials do.

The base kinds are patterns. The method's own kind, ``guess``, covers what they don't: values after
other credential words (pwd, passphrase, auth, secret key, bearer, ...) or after those of the base kind but with
characters that its pattern does not take, whose guess cost is high. Where a base kind ends before such a value
does, the guess covers the whole of it whatever the cost; only commas, brackets and the like that close a value
without quotes are the text's.
The guess cost is the least number of guesses, as a power of ten, over all ways to cut the value into
words of a list, dates, repeats, keyboard walks and brute-force spans: ``cost[j]`` is the least of
``cost[i] + cost of value[i:j]``, with a small charge for each further piece, since a guesser must
choose the order too. Values of the base kind ``assign`` get the same cost, which tells real secrets
from placeholders such as ``password=changeme2024``; the spans themselves stay whatever the cost.

Words are a few that guessers try first and then those of a public vocabulary file, by its ranks (``VOCABULARY``; without
such a file the few).

Whole texts are read as bytes; positions are code points, end exclusive. A null text counts as empty,
rows that repeat stay as rows; spans of one start go by kind; columns of other names stay as they are; an
empty table gives no rows. Runs and walks are found once in a value, so that a value of any length
takes time in proportion to its length.
"""

from __future__ import annotations

import math
import os
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.common import in_arrow, quoted, released, table, text_batches, texts, utf8
from pairwright.llm.pieces import NORMAL, SPACE, Pieces

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{32,}")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Credential words, those of the base kind too. The value may hold any printable ASCII but quotes.
CONTEXT = re.compile(
    rb"""(?i:pass[-_\x20]?phrase|pass[-_]?code|password|passwd|(?<!com)(?<!by)(?<!sur)(?<!tres)pass|pwd|credentials?|secret(?:[-_]?(?:access[-_]?)?key)?|token|api[-_]?key|private[-_]?key|access[-_]?key|client[-_]?key|auth(?:[-_]?key|orization)?|bearer|account[-_]?key|signing[-_]?key|encryption[-_]?key)"""
    rb"""["']?\x20*(?:[:=]|=>)\x20*(?:(?i:bearer|basic)\x20+)?(["']?)([\x21\x23-\x26\x28-\x7e]{8,})"""
)
CONTEXT_WORDS = (b"pass", b"pwd", b"credential", b"secret", b"token", b"api", b"private", b"access", b"client", b"auth", b"bearer", b"account", b"signing", b"encryption")
CLOSING = b",;:)]}>"

#: A file whose pieces are words by rank.
VOCABULARY = os.environ.get("PAIRWRIGHT_PIECES", "/opt/tokenizers/piece_bpe_32k.model")
#: Words that guessers try first, most likely first.
WORDS = """password admin welcome letmein secret master monkey dragon login qwerty test user root guest
changeme default example sample demo dummy placeholder hello sunshine princess football baseball
shadow superman batman trustno access hunter ranger summer winter spring autumn love money freedom
whatever ninja flower computer internet server database service system office company private public
token apikey key pass passwd value none null true false your the my for and with insert here
january february march april may june july august september october november december
monday tuesday wednesday thursday friday saturday sunday red green blue black white orange purple""".split()
#: The rows of a keyboard.
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
LEET = str.maketrans("013457@$!", "oleastasi")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?|(?:0[1-9]|[12]\d|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:(?:19|20)\d\d|\d\d)")
PIECE = math.log10(2.0)
STRONG = 9.0


def _next_keys() -> dict[tuple[str, str], int]:
    steps = {}
    for row in ROWS:
        for a, b in zip(row, row[1:]):
            steps[a, b], steps[b, a] = 1, -1
    return steps


STEPS = _next_keys()


@dataclass(frozen=True)
class Words:
    """Ranks, from 1, of words in lower case."""

    ranks: dict[str, int]
    longest: int

    @classmethod
    def of(cls, words: list[str]) -> Words:
        once = dict.fromkeys(words)
        return cls({w: i for i, w in enumerate(once, 1)}, max(map(len, once), default=0))


FIRST = Words.of(WORDS)


@cache
def ranked(path: str = VOCABULARY) -> Words:
    """WORDS, then the whole words among the pieces of a model file, the most frequent first."""
    if not Path(path).is_file():
        return FIRST
    model = Pieces(Path(path).read_bytes())
    found = [(-model.scores[i], t[1:].lower()) for i, t in enumerate(model.text) if model.kinds[i] == NORMAL and t[0] == SPACE and len(t) > 3 and t[1:].isascii() and t[1:].isalpha()]
    return Words.of(WORDS + [w for _, w in sorted(found)])


def _span(value: str) -> float:
    """log10 of the guesses for one character of a brute-force span: by the kinds of characters in it."""
    pool = 26 * bool(re.search("[a-z]", value)) + 26 * bool(re.search("[A-Z]", value)) + 10 * bool(re.search("[0-9]", value)) + 33 * bool(re.search("[^A-Za-z0-9]", value))
    return math.log10(max(pool, 2))


def pieces(value: str, words: Words = FIRST) -> Iterator[tuple[int, int, float, str]]:
    """start, end, log10 of guesses, kind of each span that a guesser has a short way to."""
    low, n = value.lower(), len(value)
    plain = low.translate(LEET)
    for form, extra in ((low, 0.0), (plain, 0.5)) if plain != low else ((low, 0.0),):
        for i in range(n):
            for j in range(i + 3, min(n, i + words.longest) + 1):
                rank = words.ranks.get(form[i:j])
                if rank:
                    part = value[i:j]
                    case = 0.0 if part == part.lower() else 0.3 if part[1:] == part[1:].lower() or part == part.upper() else math.log10(j - i + 1)
                    yield i, j, math.log10(rank + 1) + case + extra, "word"
    for i in range(n):
        for size in (10, 8, 7, 6, 4):
            if DATE.fullmatch(value, i, i + size) and i + size <= n:
                yield i, i + size, math.log10(120 * {4: 1, 6: 12, 7: 12}.get(size, 366)), "date"
    i = 0
    while i < n:
        j = i + 1
        while j < n and low[j] == low[i]:
            j += 1
        for end in {min(i + 3, j), j}:
            if end - i >= 3:
                yield i, end, math.log10(95 * (end - i)), "repeat"
        i = j
    for period in (2, 3, 4, 5, 6):
        i = 0
        while i + 2 * period <= n:
            j = i + period
            while j < n and low[j] == low[j - period]:
                j += 1
            if j - i >= 2 * period:
                yield i, j, math.log10(max(2, (j - i) // period)) + period * _span(value[i : i + period]), "repeat"
                i = j - period + 1
            else:
                i += 1
    i = 0
    while i + 1 < n:
        way = STEPS.get((low[i], low[i + 1]))
        j = i + 1
        while way and j < n and STEPS.get((low[j - 1], low[j])) == way:
            j += 1
        if j - i >= 3:
            for end in {i + 3, j}:
                yield i, end, math.log10(2 * 47 * (end - i)), "walk"
        i = max(j - 1, i + 1) if way else i + 1


def guess_cost(value: str, words: Words = FIRST) -> float:
    """log10 of the guesses of the cheapest segmentation of the value."""
    return segmentation(value, words)[0]


def segmentation(value: str, words: Words = FIRST) -> tuple[float, list[tuple[int, int, str]]]:
    """The least log10 of guesses, and the cut that has it: (start, end, kind) of each piece."""
    n = len(value)
    by_end: list[list[tuple[int, float, str]]] = [[] for _ in range(n + 1)]
    for i, j, cost, kind in pieces(value, words):
        by_end[j].append((i, cost, kind))
    each = _span(value)
    least: list[float] = [0.0] * (n + 1)
    back: list[tuple[int, str]] = [(0, "")] * (n + 1)
    for j in range(1, n + 1):
        joined = back[j - 1][1] == "brute"
        least[j], back[j] = least[j - 1] + each + (0.0 if joined or j == 1 else PIECE), (j - 1, "brute")
        for i, cost, kind in by_end[j]:
            total = least[i] + cost + (PIECE if i else 0.0)
            if total < least[j]:
                least[j], back[j] = total, (i, kind)
    cut: list[tuple[int, int, str]] = []
    j = n
    while j:
        i, kind = back[j]
        if cut and kind == "brute" == cut[-1][2]:
            cut[-1] = (i, cut[-1][1], kind)
        else:
            cut.append((i, j, kind))
        j = i
    return least[n], cut[::-1]


def _starts(low: bytes, words: tuple[bytes, ...]) -> list[int]:
    found = []
    for w in words:
        i = low.find(w)
        while i >= 0:
            found.append(i)
            i = low.find(w, i + 1)
    return sorted(found)


def scan(text: bytes, strong: float = STRONG, words: Words = FIRST) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, guess cost) of each span in bytes, sorted; the cost is 0 for access and hex."""
    low = text.lower()
    spans = []
    end = 0
    for i in _starts(low, ASSIGN_WORDS):
        if i >= end and (m := ASSIGN.match(text, i)):
            end = m.end()
            if end - m.start(1) >= 8:
                spans.append((i, 0, end, guess_cost(m[1].decode(), words)))
    if b"AKIA" in text:
        spans += [(m.start(), 1, m.end(), 0.0) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    spans += [(m.start(), 2, m.end(), 0.0) for m in HEX.finditer(text)]
    taken, end = sorted((s[0], s[2]) for s in spans), 0
    reach = list(accumulate((e for _, e in taken), max))
    for i in _starts(low, CONTEXT_WORDS):
        if i < end or not (m := CONTEXT.match(text, i)):
            continue
        end = m.end()
        inside = [(s, e) for s, e in taken[bisect_right(reach, m.start(2)) : bisect_left(taken, (end, 0))] if e > m.start(2)]
        covered = max((e for s, e in inside if s <= m.start(2)), default=0)
        if covered >= end or covered and not m[1] and not text[covered:end].strip(CLOSING):
            continue
        cost = guess_cost(m[2].decode(), words)
        if inside or cost >= strong:
            spans.append((i, 3, end, cost))
    return sorted(spans)


def code_points(text: bytes, spans: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """The spans with code points for bytes."""
    if text.isascii() or not spans:
        return spans
    at, marks, last, count = {}, sorted({x for s in spans for x in (s[0], s[2])}), 0, 0
    for m in marks:
        count += len(text[last:m].decode("utf-8", "replace"))
        at[m], last = count, m
    return [(at[s], k, at[e], c) for s, k, e, c in spans]


SPAN = "struct<kind:string,start:long,end:long,cost:double>"


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", strong: float = STRONG, words: Words | None = None) -> DataFrame:
    """id, spans (array of kind, start, end, guess cost; sorted by start, then kind) for each row of docs."""
    kind, known = dict(docs.dtypes)[id_col], words or ranked()
    into = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("cost", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e, "cost": c} for s, k, e, c in code_points(t, scan(t, strong, known))] for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, into)], names=["id", "spans"])

    return text_batches(docs).select(F.col(quoted(id_col)).alias("id"), utf8(text_col).alias("t")).mapInArrow(released(run), f"id {kind}, spans array<{SPAN}>")


def redact(docs: DataFrame, text_col: str = "text", strong: float = STRONG, words: Words | None = None) -> DataFrame:
    """docs with every span in the text replaced by its kind in capitals, as <ASSIGN>; overlapping spans
    are replaced as one, by the kind of the first. Other columns stay; a null text stays null."""
    names, known = docs.columns, words or ranked()
    place = names.index(text_col)

    def clean(text: bytes) -> str:
        out, at = [], 0
        for s, k, e, _ in scan(text, strong, known):
            if s >= at:
                out += [text[at:s], b"<" + KINDS[k].upper().encode() + b">"]
            at = max(at, e)
        return b"".join([*out, text[at:]]).decode("utf-8", "replace")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([None if not x.is_valid else clean(x.as_py().encode()) for x in b.column(place)], pa.string())
            yield pa.RecordBatch.from_arrays([new if i == place else c for i, c in enumerate(b.columns)], names=names)

    return in_arrow(text_batches(docs), run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    as_text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        F.col("id").alias("doc_id"),
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(as_text(F.filter("spans", lambda s: s["kind"] != "guess")), 256).alias("base_sha256"),
        as_text(F.col("spans")).alias("spans"),
        count("guess").alias("n_guess"),
        F.round(F.array_max(F.transform("spans", lambda s: s["cost"])), 6).alias("guess_cost"),
    )
