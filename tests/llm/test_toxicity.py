import random

import numpy as np

from pairwright.llm import toxicity
from pairwright.llm.toxicity import Automaton, Term

SCHEMA = "doc_id long, text string, score string, t string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row, old = [i + 1], row
        for j, y in enumerate(b):
            row.append(min(old[j] + (x != y), old[j + 1] + 1, row[-1] + 1))
    return row[-1]


def brute(word, terms):
    best = None
    for n, t in enumerate(terms):
        ends = range(1, len(word) + 1) if t.opening else [len(word)]
        e = min((distance(word[:k], t.text) for k in ends), default=99)
        if e <= t.errors:
            best = min(best or (9, 9), (e, n))
    return best


def test_automaton_equals_edit_distances():
    rng = random.Random(1)
    terms = [Term("idiot", False), Term("scum", False), Term("abab", True), Term("worthless", False), Term("lowei", True), Term("loser", False), Term("üble", False), Term("disgusting", True)]
    terms += [Term(f"{c}ork{c}", False, 1) for c in "bcdfghjklm"]  # more than one automaton holds
    a = Automaton(terms)
    assert len(a.parts) > 1
    words = [t.text for t in terms] + ["dioti", "xidiot", "diot", "vloser", "oser", "cum", "vscum"] + ["", "i", "x" * 300, "lowei" + "z" * 300, "scums", "idio", "idiott", "loweö"]
    for _ in range(4_000):
        w = list(rng.choice(terms).text + rng.choice(["", "", "en", "schaft"]))
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randrange(2)] = rng.choice(["", "a", "o", "z", "t"])
        words.append("".join(w))
    term, errors = a.match(words)
    for w, t, e in zip(words, term.tolist(), errors.tolist()):
        assert (None if t < 0 else (e, t)) == brute(w, terms), w


def test_context_tells_quotation_from_abuse():
    hits = {"idiot": (0, 0), '"idiot"': (0, 0)}
    plain = toxicity.features("you are such an idiot".split(), hits)
    quoted = toxicity.features('the word "idiot" was used'.split(), hits)
    assert plain[0] > 0 and plain[2] == 0 and plain[5] == 1 and quoted[0] == 0 and quoted[2] > 0 and quoted[5] == 0
    assert toxicity.features(["fine"], hits) is None


def make(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        y = int(rng.random() < 0.3)
        words = ["".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 80))]
        for _ in range(rng.randrange(1, 4) * y):
            words.insert(rng.randrange(len(words)), rng.choice(["scumbag", "vermin" + rng.choice("aeio") + rng.choice("xyz"), "blockhead"]))
        rows.append((i, " ".join(words), None, "x"))
        labels.append((i, y))
    return rows, labels


def test_learns_and_finds_misspellings(spark):
    rows, labels = make(3, 1_200)
    docs = spark.createDataFrame(rows, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] % 5] + [(7, 5), (None, 1)], "doc_id long, toxic int"))
    assert {t.text[:5] for t in model.automaton.terms} >= {"scumb", "vermi", "block"} or {t.text[:4] for t in model.automaton.terms} >= {"scum", "verm", "bloc"}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    truth = dict(labels)
    assert np.mean([(got[i] >= 0.5) == truth[i] for i in truth if i % 5 == 0]) > 0.98
    extra = [(1, "a b blockhaed blokhead c", None, None), (2, None, None, None), (3, "", None, None), (4, "la " * 100_000 + "scumbag", None, None), (4, "la", None, None), (None, "la", None, None)]
    out = toxicity.score(spark.createDataFrame(extra, SCHEMA), model, ["doc_id", "t"]).collect()
    assert len(out) == len(extra) and all(0 <= r.score <= 1 for r in out)
    by = {r.doc_id: r.score for r in out}
    assert by[1] > by[2] == by[3] == by[None]


def test_a_common_opening_takes_no_rows_away(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioubdfgklmnprst") for _ in range(rng.randrange(3, 8)))
    rows, labels = [], []
    for i in range(400):
        y = i % 2
        text = "This document was collected by a crawler. " + " ".join(word() for _ in range(40)) + (" you scumbag " if y else " ") + word()
        rows.append((i, text, None, "x"))
        labels.append((i, y))
    truth, found = spark.createDataFrame(labels, "doc_id long, toxic int"), []
    for parts in (1, 7):
        model = toxicity.fit(spark.createDataFrame(rows, SCHEMA).repartition(parts), truth.repartition(parts))
        found.append(([t for t in model.automaton.terms], model.weights.round(9).tolist(), model.known))
    assert found[0] == found[1] and any(t.text.startswith("scum") for t in found[0][0])


def test_copies_speak_once():
    rng = random.Random(2)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(60)] for _ in range(3)]
    docs = base + [base[0][:30] + ["x"] + base[0][31:], base[0] + ["y"]]
    got = toxicity.groups([toxicity.sketch(d).tolist() for d in docs])
    assert got == [0, 1, 2, 0, 0]


def test_query(spark, tmp_path):
    from pairwright.llm.language import held_out

    rows, labels = make(5, 900)
    rows += [(None, "x", None, None), (5_000, None, None, None), (5_001, "", None, None)]
    spark.createDataFrame([(i, t, "en", "s") for i, t, *_ in rows], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.query(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == len(rows)
    assert got.where(held_out("doc_id", 5, 0) != got.held_out).isEmpty() and got.where((got.score >= 0.5) != (got.predicted == 1)).isEmpty()
    truth = dict(labels)
    fold = [r for r in got.where("held_out").collect() if r.doc_id in truth]
    assert len(fold) > 100 and np.mean([r.predicted == truth[r.doc_id] for r in fold]) > 0.97


def test_no_labels_and_empty(spark):
    docs = spark.createDataFrame([(1, "a", None, None)], SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(docs, model, ["doc_id"]).collect()] == [0.0]
    assert toxicity.score(docs.where("false"), model, ["doc_id"]).count() == 0
