import random
import re

from pairwright.llm import licenses

SCHEMA = "doc_id long, text string, key string, t string, spans string"


def brute_base(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return len(words), sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split())


def make(rng):
    bits = ["GNU General Public License", "Apache License", "CC BY-NC 4.0", "MIT\nlicense", "cc", "by", "wörd", "Ünder", "apache", "x", ",", ".", "-", "\x7f", "0"]
    return rng.choice([" ", "  ", "\n"]).join(rng.choice(bits) for _ in range(rng.randrange(40)))


def test_base_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, make(rng), "x", None, None) for i in range(200)] + [(900, None, None, None, None), (901, "", None, None, None), (None, "cc by", None, None, None), (5, "cc by", None, None, None), (902, "mit license " * 20_000, None, None, None)]
    got = licenses.licenses(spark.createDataFrame(rows, SCHEMA)).collect()
    want = sorted(((r[0], *brute_base(r[1])) for r in rows), key=str)
    assert sorted(((r.id, r.n_words, [(b.word, b.label) for b in r.base]) for r in got), key=str) == want


def test_templates_with_edits(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for n, (name, t) in enumerate(licenses.TEMPLATES.items()):
        words = t.split()
        if len(words) > 20:
            for _ in range(len(words) // 25):
                i = rng.randrange(5, len(words) - 5)
                words[i : i + 1] = rng.choice([[], ["inserted", words[i]], ["changed"]])
        before = [f"w{rng.randrange(99)}" for _ in range(rng.randrange(30))]
        rows.append((n, " ".join([*before, *words, "tail", "end"]).upper(), None, None, None))
        want[n] = (name, len(licenses.words(" ".join(before).encode())), len(licenses.words(" ".join(words).encode())))
    got = {r.id: r.spans for r in licenses.licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    for n, (name, start, size) in want.items():
        mine = [s for s in got[n] if s.template == name]
        assert mine and abs(mine[0].start - start) <= 3 and abs(mine[0].end - start - size) <= 3 and mine[0].share >= 0.75, (name, got[n])


def brute_verify(found, template, low, high):
    """The longest common sequence on the diagonals, by the whole table."""
    best = {}
    for i in range(len(found) + 1):
        for j in range(len(template) + 1):
            best[i, j] = max(best.get((i - 1, j), 0), best.get((i, j - 1), 0), best[i - 1, j - 1] + 1 if i and j and found[i - 1] == template[j - 1] and low <= i - j <= high else 0)
    return best[len(found), len(template)] / len(template)


def test_band_equals_whole_table():
    rng = random.Random(3)
    for _ in range(300):
        template = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 25))]
        found = [rng.choice("abcdefgh") for _ in range(rng.randrange(4))] + [w for w in template if rng.random() < 0.9 for w in ([w] if rng.random() < 0.9 else [w, "x"])]
        low = rng.randrange(-4, 4)
        high = low + rng.randrange(9)
        share, a, b = licenses.verify(found, template, low, high)
        assert share == brute_verify(found, template, low, high), (found, template, low, high)
        assert 0 <= a <= b <= len(found)


def test_notice_with_a_page_header_in_the_middle(spark):
    words = licenses.TEMPLATES["isc-notice"].split()
    header = "page two of nine acme corporation annual report of the year".split()
    rows = [(1, " ".join(words[:16] + header + words[16:]), None, None, None), (2, " ".join(words[:16] + header * 40 + words[:16]), None, None, None)]
    got = {r.id: [(s.template, s.start, s.end, s.share) for s in r.spans] for r in licenses.licenses(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1] == [("isc-notice", 0, len(words) + len(header), 1.0)] and got[2] == []


def test_whole_texts_of_a_folder(spark, tmp_path):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("aeioubdfg") for _ in range(5)) for _ in range(1_500))
    (tmp_path / "Own-1.0").write_text(text)
    known = licenses.texts_of(str(tmp_path))
    assert list(known) == ["own-1.0-text"] and licenses.texts_of(str(tmp_path / "none")) == {}
    rows = [(1, "before " + text.replace(" ", "\n", 40) + " after", None, None, None), (2, text[:3_000], None, None, None)]
    got = {r.id: r.spans for r in licenses.licenses(spark.createDataFrame(rows, SCHEMA), templates=known).collect()}
    assert [(s.template, s.start, s.end, s.share) for s in got[1]] == [("own-1.0-text", 1, 1_501, 1.0)] and not got[2]


def test_common_words_alone_are_no_license(spark):
    rows = [(1, "the terms of the work and the use of this software is free of any kind", None, None, None), (2, "licensed plumbers under the bridge", None, None, None)]
    assert all(not r.spans and not r.base for r in licenses.licenses(spark.createDataFrame(rows, SCHEMA)).collect())


def test_grams_and_empty(spark):
    a = licenses.gram_hashes([b"x", b"one", b"two", b"three", b"y"])
    assert a[1] == licenses.gram_hashes([b"one", b"two", b"three"])[0] and len(set(a.tolist())) == 3
    assert licenses.licenses(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_columns(spark, tmp_path):
    spark.createDataFrame([(1, "a MIT License b. Licensed under CC BY-NC 4.0.", None, None, None), (2, "nothing", None, None, None)], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    one, two = licenses.query(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert tuple(one) == (1, 11, 2, 1, 6, "cc-by,mit", "cc-by,cc-by-nc-4.0,mit", 1.0)
    assert tuple(two) == (2, 1, 0, None, None, "", "", 0.0)
