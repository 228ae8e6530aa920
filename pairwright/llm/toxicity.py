"""Toxicity scores: a lexicon matched with misspellings, and its hits weighed by their context.

The lexicon is learned from labelled rows: words, and openings of words, that toxic texts have far more
often than others. Its trie is intersected with Levenshtein automata into deterministic automata over the
lexicon's letters, once; a word then costs one table look-up a letter, and all different words of a batch
that have one length advance together. Any letter may be wrong, missing or too many, the first one too. An
opening matches whatever follows it.

Terms must hold on a second half of the labelled rows, too, and so must each number of errors: a term bears
as many as show no clean row there. Words of clean rows that are only near a term are no misspellings. Each
hit is looked at in a window of words: between quotation marks or beside a word of reporting it is a
quotation, beside a word of address it is aimed at someone. A logistic model over these sums, fitted to that
second half, gives the score.

The sample is bounded: of each label the ``2 * per_label`` rows with the smallest hash of their id. Rows that
are near copies of each other, by the min-hashes of their whole texts, count once and are in one half, so that copies
don't speak for a word. Everything that holds in the sample is a term; everything else looks at whole texts,
all of them.

Defined results: a null or empty text has no hits and gets the score of such; a text of any length is scored
whole; without labels of both kinds every score is 0; a label other than 0 or 1 is not used; ties in the
sample go by id, then text; repeated rows stay as rows; columns of any name stay as they are; an empty table
gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.common import columns as named
from pairwright.llm.common import fresh, in_arrow, quoted, released, schema_of, stored, table, text_batches, texts, utf8
from pairwright.llm.language import held_out, least_hashes

PER_LABEL = 1_500
OPENING = (4, 9)
LEAST_SHARE = 0.004
ODDS = math.log(25.0)
#: How likely by chance a term's rows of the first and of the second half may be.
FIRST, SECOND = 2e-3, 0.05
AROUND = 6
#: Marks of quotation, words of reporting and of address.
MARKS = "\"'«»“”„‘’‹›`"
ENDS = MARKS + ".,;:!?()[]{}…*_-–—|#&%/\\<>~=+"
REPORTING = frozenset("said says wrote writes quoted quote quotes called calling term word slur insult reported dijo dice escribió palabra insulto sagte sagt schrieb wort begriff beleidigung dit écrit mot insulte terme".split())
ADDRESS = frozenset("you your you're ur u yourself du dich dir dein deine ihr euch tu te toi vous ton ta votre tú ti usted vosotros".split())
FEATURES = ("exact", "near", "quoted", "terms", "density", "aimed")
#: Terms of one automaton; more of them take several.
TOGETHER = 16


def most_errors(text: str) -> int:
    return 0 if len(text) < 4 else 1 if len(text) < 9 else 2


@dataclass(frozen=True)
class Term:
    text: str
    opening: bool
    errors: int = -1

    def __post_init__(self):
        if self.errors < 0:
            object.__setattr__(self, "errors", most_errors(self.text))


class _Part:
    """The words within each term's number of errors, as a table of states by letters."""

    def __init__(self, terms: list[Term]):
        children: list[dict[str, int]] = [{}]
        ends: list[list[int]] = [[]]
        bears = [max((t.errors for t in terms), default=0)]
        for n, t in enumerate(terms):
            at = 0
            for c in t.text:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    ends.append([])
                    bears.append(0)
                at = children[at][c]
                bears[at] = max(bears[at], t.errors)
            ends[at].append(n)
        letters = sorted({c for t in terms for c in t.text})
        self.longest = max((len(t.text) + t.errors for t in terms), default=0) + 1

        def close(found: dict[int, int]) -> dict[int, int]:
            """With the nodes that a missing letter leads to."""
            todo = list(found)
            while todo:
                node = todo.pop()
                e = found[node] + 1
                for child in children[node].values():
                    if e <= bears[child] and e < found.get(child, 99):
                        found[child] = e
                        todo.append(child)
            return found

        def step(now: frozenset, letter: str | None) -> dict[int, int]:
            found: dict[int, int] = {}

            def put(node: int, e: int) -> None:
                if e <= bears[node] and e < found.get(node, 99):
                    found[node] = e

            for node, e in now:
                put(node, e + 1)  # a letter too many
                for c, child in children[node].items():
                    put(child, e + (c != letter))
            return close(found)

        def hit(now: dict[int, int], opening: bool) -> tuple[int, int] | None:
            return min(((e, n) for node, e in now.items() for n in ends[node] if terms[n].opening == opening and e <= terms[n].errors), default=None)

        start = (frozenset(close({0: 0}).items()), None)
        number = {start: 1}  # 0 is the state without a way on
        todo, rows, accepts = [start], [[0] * (len(letters) + 1)], [None]
        for now, best in todo:  # grows as it goes
            row = []
            for letter in (None, *letters):
                after = step(now, letter)
                met = min((x for x in (best, hit(after, True)) if x), default=None)
                state = (frozenset(after.items()), met)
                if not after and not met:
                    row.append(0)
                    continue
                if state not in number:
                    number[state] = len(number) + 1
                    todo.append(state)
                row.append(number[state])
            rows.append(row)
            accepts.append(min((x for x in (best, hit(dict(now), False)) if x), default=None))
        self.table = np.array(rows, dtype=np.int32)
        self.term = np.array([-1 if x is None else x[1] for x in accepts], dtype=np.int32)
        self.errors = np.array([0 if x is None else x[0] for x in accepts], dtype=np.int8)
        self.codes = np.zeros(1 + max((ord(c) for c in letters), default=0), dtype=np.int32)
        for i, c in enumerate(letters):
            self.codes[ord(c)] = i + 1


class Automaton:
    """The terms, TOGETHER at a time, as deterministic automata."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.parts = [_Part(terms[i : i + TOGETHER]) for i in range(0, len(terms), TOGETHER)]
        self.longest = max((p.longest for p in self.parts), default=1)

    def match(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The term (-1: none) and the errors of each word: of several the one with the fewest errors, then the
        first. Letters beyond the longest term and its errors change nothing."""
        term, errors = np.full(len(words), -1, np.int32), np.full(len(words), 99, np.int8)
        by: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            by.setdefault(min(len(w), self.longest), []).append(i)
        for size, at in by.items():
            if not size:
                continue
            at = np.array(at)
            cut = np.array([words[i][:size] for i in at], dtype=f"<U{size}").view(np.uint32).reshape(-1, size)
            for k, p in enumerate(self.parts):
                seen = p.codes[np.where(cut < len(p.codes), cut, 0)]
                state = np.ones(len(at), dtype=np.int32)
                for j in range(size):
                    state = p.table[state, seen[:, j]]
                better = (p.term[state] >= 0) & (p.errors[state] < errors[at])
                term[at[better]], errors[at[better]] = p.term[state[better]] + k * TOGETHER, p.errors[state[better]]
        return term, np.where(term < 0, 0, errors).astype(np.int8)


def tokens(text: bytes) -> list[str]:
    return text.decode("utf-8", "replace").lower().split()


def features(found: list[str], hits: dict[str, tuple[int, int]]) -> list[float] | None:
    """FEATURES of a text from its words and what the automaton says of them; None without a hit."""
    if hits.keys().isdisjoint(found):
        return None
    exact = near = quoted = aimed = 0.0
    seen = set()
    for i, w in enumerate(found):
        h = hits.get(w)
        if h is None:
            continue
        term, errors = h
        before, after = found[max(0, i - AROUND) : i + 1], found[i : i + AROUND + 1]
        around = {x.strip(ENDS) for x in (*before, *after)}
        opened = any(x[0] in MARKS for x in before)
        closed = any(x.rstrip(".,;:!?)")[-1:] in MARKS for x in after if x.rstrip(".,;:!?)"))
        if (opened and closed) or around & REPORTING:
            quoted += 1
        elif errors:
            near += 1
        else:
            exact += 1
            seen.add(term)
        aimed += bool(around & ADDRESS)
    every = exact + near + quoted
    return [math.log1p(exact), math.log1p(near), math.log1p(quoted), math.log1p(len(seen)), every / math.sqrt(len(found)), aimed / every]


def _hits(automaton: Automaton, docs: list[list[str]], known: frozenset = frozenset()) -> dict[str, tuple[int, int]]:
    """(term, errors) of each different word of these texts that matches. known: words that are no misspellings."""
    words = list(set().union(*docs)) if docs else []
    plain = [w.strip(ENDS) for w in words]
    term, errors = automaton.match(plain)
    return {words[i]: (int(term[i]), int(errors[i])) for i in np.flatnonzero(term >= 0) if not errors[i] or plain[i] not in known}


@dataclass
class Model:
    automaton: Automaton | None
    weights: np.ndarray  # of FEATURES, then of having a hit, then the constant
    known: frozenset = frozenset()  # words near a term that clean rows have

    def scores(self, rows: list[list[float] | None]) -> np.ndarray:
        if self.automaton is None:
            return np.zeros(len(rows))
        x = np.array([(r + [1.0, 1.0]) if r else [0.0] * (len(FEATURES) + 1) + [1.0] for r in rows]).reshape(-1, len(FEATURES) + 2)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _counts(sample: DataFrame) -> DataFrame:
    """gram, opening, toxic, n: rows of the sample (t, toxic) with a word or with a word's opening."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys = list(seen)
            return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), pa.array([k[2] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["gram", "opening", "toxic", "n"])

        for b in batches:
            for t, y in zip(texts(b.column(0)), b.column(1).to_pylist()):
                words = {w for x in set(tokens(t)) if (w := x.strip(ENDS)).isalpha() and len(w) >= 3}
                seen.update((w, False, y) for w in words)
                seen.update((p, True, y) for p in {w[:k] for w in words for k in range(OPENING[0], min(OPENING[1], len(w) - 1) + 1)})
                if len(seen) > 200_000:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    return sample.select("t", "toxic").mapInArrow(released(run), "gram string, opening boolean, toxic int, n long")


def chance(a: int, b: int, toxic: int, clean: int) -> float:
    """How likely at least a of a + b rows are toxic if the word has nothing to do with it."""
    n, p, q = a + b, math.log(toxic / (toxic + clean)), math.log(clean / (toxic + clean))
    each = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * p + (n - k) * q for k in range(a, n + 1)]
    return sum(map(math.exp, each))


def _holds(a: int, b: int, toxic: int, clean: int, by_chance: float) -> bool:
    """Enough toxic rows, of ``toxic``, far more often than of the others, and hardly by chance."""
    far = a >= max(2, LEAST_SHARE * toxic) and math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (clean + 1)) >= ODDS
    return far and chance(a, b, toxic, clean) <= by_chance


def choose(grams: list[tuple[str, bool, int, int]], toxic: int, clean: int) -> list[Term]:
    """The lexicon from (gram, is an opening, toxic rows, other rows): the shortest openings that hold, or a
    word where an opening is all but one word."""
    good = {(g, o): a for g, o, a, b in grams if _holds(a, b, toxic, clean, FIRST)}
    words = {g: a for (g, o), a in good.items() if not o}
    taken: set[Term] = set()
    for (g, o), a in sorted(good.items(), key=lambda x: (not x[0][1], len(x[0][0]), x[0][0])):
        if any(Term(g[:k], True) in taken for k in range(OPENING[0], len(g) + 1)):
            continue
        if o:
            main = max((w for w in words if w.startswith(g)), key=lambda w: (words[w], w), default=None)
            if main is not None and words[main] >= 0.8 * a:
                continue
        taken.add(Term(g, o))
    return sorted(taken, key=lambda t: (t.text, t.opening))


#: Min-hashes of a text's 3-word shingles, in bands; rows that agree in a band count as copies.
BANDS, EACH = 8, 3
_rng = np.random.default_rng(5)
FACTORS = _rng.integers(1, 1 << 63, BANDS * EACH).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(words: list[str]) -> np.ndarray:
    """BANDS mixes of EACH min-hashes of the 3-word shingles."""
    digest = xxhash.xxh64_intdigest
    h = np.array(list({digest(" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))}), dtype=np.uint64)
    least = np.full(BANDS * EACH, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(h), 4_096):
        x = h[i : i + 4_096, None] * FACTORS[None]
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(axis=0))
    out = np.zeros(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, EACH).T:
        out = (out ^ row) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return out


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [sketch(tokens(t)).view(np.int64).tolist() for t in texts(b.column(0))]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.list_(pa.int64()))], names=["t", "toxic", "h", "bands"])


def groups(bands: list[list[int]]) -> list[int]:
    """For each row the first row that it is joined to by equal bands."""
    above = list(range(len(bands)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    first: dict[tuple[int, int], int] = {}
    for i, row in enumerate(bands):
        for k in enumerate(row):
            x, y = top(first.setdefault(k, i)), top(i)
            above[max(x, y)] = min(x, y)
    return [top(i) for i in range(len(bands))]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = PER_LABEL) -> Model:
    """A model from the labels (id, label) and the texts of docs."""
    rows = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(quoted(id_col)).alias("id"), F.col(label_col).cast("int").alias("toxic"), F.xxhash64(id_col).alias("h")).distinct()
    chosen = least_hashes(stored(rows), "toxic", 2 * per_label, ["h", "id"])  # 4 * per_label rows at most: small enough to broadcast
    joined = docs.select(F.col(quoted(id_col)).alias("id"), utf8(text_col).alias("t")).join(F.broadcast(chosen), "id")
    read = joined.select("t", "toxic", F.xxhash64("h", "t").alias("h")).dropDuplicates(["toxic", "h"])
    sample = stored(read.mapInArrow(_sketches, "t binary, toxic int, h long, bands array<long>"))
    seen = sorted(tuple(r) for r in sample.select("h", "toxic", "bands").collect())  # BANDS numbers a row of the sample
    kept = {}
    for (h, y, _), g in zip(seen, groups([r[2] for r in seen])):
        kept.setdefault((g, y), (h, y, seen[g][0] >> 7 & 1))
    marks = docs.sparkSession.createDataFrame(list(kept.values()), "h long, toxic int, half int")
    sample = stored(sample.drop("bands").join(F.broadcast(marks), ["h", "toxic"]).select("t", "toxic", "half"))
    sizes = Counter((half, y) for _, y, half in kept.values())
    if any(not sizes[half, y] for half in (0, 1) for y in (0, 1)):
        return Model(None, np.zeros(len(FEATURES) + 2))
    sums = _counts(sample.where("half = 0")).groupBy("gram", "opening").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("b"))
    odds = (F.col("a") + 0.5) / (sizes[0, 1] + 1) * (sizes[0, 0] + 1) / (F.col("b") + 0.5)
    likely = sums.where((F.col("a") >= max(2, LEAST_SHARE * sizes[0, 1])) & (odds >= 0.99 * math.exp(ODDS)))
    terms = choose([tuple(r) for r in likely.collect()], sizes[0, 1], sizes[0, 0])  # bounded by the sample's words
    automaton = Automaton(terms)
    known = _near_words(automaton, sample.where("half = 0 and toxic = 0"))
    met: Counter = Counter()
    for r in sample.where("half = 1").select("t", "toxic").mapInArrow(_met(automaton, known), "met array<int>, toxic int").collect():
        met.update((x, r.toxic) for x in r.met)
    hold = []
    for n, t in enumerate(terms):
        if _holds(met[3 * n, 1], met[3 * n, 0], sizes[1, 1], sizes[1, 0], SECOND):
            errors = next((e for e in range(t.errors) if met[3 * n + e + 1, 0]), t.errors)
            hold.append(Term(t.text, t.opening, errors))
    automaton = Automaton(hold)
    known |= _near_words(automaton, sample.where("toxic = 0"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tokens(t) for t in texts(b.column(0))]
            hits = _hits(automaton, found, known)
            yield pa.RecordBatch.from_arrays([pa.array([features(f, hits) for f in found], pa.list_(pa.float64())), b.column(1)], names=["x", "toxic"])

    other = sample.where("half = 1").select("t", "toxic")
    rows = sorted(((r.x or [], r.toxic) for r in other.mapInArrow(released(run), "x array<double>, toxic int").collect()))
    # A term with a wrong letter is as bad as without, unless other rows show it to be another word: toxic rows
    # count a second time, as if all their hits had been misspelled.
    near = [([0.0, max(v[:2]), *v[2:3], 0.0, *v[4:]], y) for v, y in rows if v and y == 1]
    rows += near
    x = np.array([[*v, 1.0, 1.0] if v else [0.0] * (len(FEATURES) + 1) + [1.0] for v, _ in rows])
    return Model(automaton, logistic(x, np.array([y for _, y in rows], dtype=np.float64)), known)


def _met(automaton: Automaton, known: frozenset):
    """3 * term + errors of all that each row has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [tokens(t) for t in texts(b.column(0))]
            hits = _hits(automaton, found, known)
            yield pa.RecordBatch.from_arrays([pa.array([sorted({3 * n + e for n, e in map(hits.get, hits.keys() & set(f))}) for f in found], pa.list_(pa.int32())), b.column(1)], names=["met", "toxic"])

    return run


def _near_words(automaton: Automaton, rows: DataFrame) -> frozenset:
    """The words of these rows, which are part of the sample, that are near a term but none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hits = _hits(automaton, [tokens(t) for t in texts(b.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(sorted({w.strip(ENDS) for w, (_, e) in hits.items() if e}), pa.string())], names=["word"])

    return frozenset(r.word for r in rows.select("t").mapInArrow(released(run), "word string").distinct().collect())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 60) -> np.ndarray:
    """Weights by Newton's method; both labels weigh half, with a ridge on all of them."""
    w = np.zeros(x.shape[1])
    each = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    keep = np.full(len(w), ridge / 10)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (each * (p - y)) + keep * w
        h = (x * (each * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(keep)
        step = np.linalg.solve(h, g)
        w -= step / max(1.0, np.abs(step).max() / 3)
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, model: Model, columns: list[str], text_col: str = "text", out: str = "score") -> DataFrame:
    """The named columns of docs, with the score (0 to 1) in a column named out."""
    (raw,) = fresh(columns, "utf8")
    rows = text_batches(docs).select(utf8(text_col).alias(raw), *named(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1_000):
                part = b.slice(i, 1_000)
                if model.automaton is None:
                    s = np.zeros(part.num_rows)
                else:
                    found = [tokens(t) for t in texts(part.column(0))]
                    hits = _hits(model.automaton, found, model.known)
                    s = model.scores([features(f, hits) for f in found])
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s, pa.float64())], names=[*columns, out])

    return in_arrow(rows, run, schema_of(docs, columns, f"`{out}` double"))


def trained(spark: SparkSession, sf_dir: str, docs: DataFrame) -> Model:
    """A model from the labels beside docs, without those of the fold that is held out."""
    return fit(docs, table(spark, sf_dir, "labels").where(_learnable()))


def _learnable() -> Column:
    return F.col("doc_id").isNotNull() & ~held_out("doc_id", 5, 0)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, trained(spark, sf_dir, docs), ["doc_id"])
    return found.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
