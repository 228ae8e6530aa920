import random
import struct
import weakref

import pytest

from pairwright.llm import common, pieces

sentencepiece = pytest.importorskip("sentencepiece")
SCHEMA = "doc_id long, text string, ids string, text_sha256 string"


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*parts):
    out = b""
    for number, v in parts:
        if isinstance(v, float):
            out += varint(number << 3 | 5) + struct.pack("<f", v)
        elif isinstance(v, int):
            out += varint(number << 3) + varint(v)
        else:
            out += varint(number << 3 | 2) + varint(len(v)) + v
    return out


def model(words, type_, bytes_=True):
    """words: {piece: score}"""
    rows = [("<unk>", 0.0, pieces.UNKNOWN), ("<s>", 0.0, pieces.CONTROL), ("</s>", 0.0, pieces.CONTROL)]
    rows += [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)] if bytes_ else []
    rows += [(w, s, pieces.NORMAL) for w, s in words.items()]
    trainer = message((3, type_), *([(35, 1)] if bytes_ else []))
    return b"".join(message((1, message((1, w.encode()), (2, float(s)), (3, k)))) for w, s, k in rows) + message((2, trainer), (3, message((1, b"identity"), (3, 1), (4, 0), (5, 1))))


def random_texts(seed, n, letters="abcdé ▁\n€"):
    rng = random.Random(seed)
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(n)]


def vocabulary(seed):
    rng = random.Random(seed)
    words = list("abcd▁") + sorted({"".join(rng.choice("abcd") for _ in range(rng.randrange(2, 6))) for _ in range(60)}) + ["▁a", "▁ab", "▁▁", "▁bcd"]
    return {w: float(round(-rng.uniform(1, 12), 3)) for w in dict.fromkeys(words)}


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("bytes_", [True, False])
def test_unigram_has_the_best_sum(seed, bytes_):
    words = vocabulary(seed)
    p = pieces.Pieces(model(words, pieces.UNIGRAM, bytes_))
    lone = min(words.values()) - 10.0

    def best(w):
        value = [0.0] + [-1e9] * len(w)
        for j in range(1, len(w) + 1):
            for i in range(j):
                value[j] = max(value[j], value[i] + words.get(w[i:j], lone if j - i == 1 else -1e9))
        return value[-1]

    every = [w for t in random_texts(seed, 300, "abcdé ") for w in p.split(t)]
    last, start = zip(*[(x[0], y[0]) for x, y in (p._ways(p._codes([w], len(w))) for w in every)])
    for w, a, b in zip(every, last, start):
        total, end = 0.0, len(w)
        while end:
            total += words[p.text[a[end]]] if a[end] >= 0 else lone
            end = b[end]
        assert total == pytest.approx(best(w), abs=1e-3)


@pytest.mark.parametrize("type_", [pieces.UNIGRAM, pieces.BPE])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_ids_as_the_library(type_, seed):
    words = vocabulary(seed)
    if type_ == pieces.BPE:
        words = {w: -float(i) for i, w in enumerate(sorted(words, key=lambda w: (len(w), words[w])))}
        words = dict(list(words.items())[5:]) | {c: -1000.0 - i for i, c in enumerate("abcd▁")}
    data = model(words, type_)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    p = pieces.Pieces(data)
    texts = random_texts(seed, 400, "abcdé €\n")
    for t, mine, want in zip(texts, p.encode(texts), theirs.encode(texts)):
        assert mine.tolist() == want, t
        assert p.decode(mine) == t


@pytest.mark.parametrize("type_", [pieces.UNIGRAM, pieces.BPE])
def test_long_words_equal_the_library(type_):
    words = vocabulary(4)
    if type_ == pieces.BPE:
        words = {w: -float(i) for i, w in enumerate(sorted(words, key=lambda w: (len(w), words[w])))}
        words = dict(list(words.items())[5:]) | {c: -1000.0 - i for i, c in enumerate("abcd▁")}
    data = model(words, type_)
    theirs, p = sentencepiece.SentencePieceProcessor(model_proto=data), pieces.Pieces(data)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcd") for _ in range(n)) for n in (399, 400, 401, 720, 3_000)] + ["a" * 2_000, "ab" * 900, "abcdé€" * 300, "é" * 700]
    for t, mine in zip(texts, p.encode(texts)):
        assert p.decode(mine) == t
        assert mine.tolist() == theirs.encode(t), t[:40]


def test_windows_equal_one_pass():
    rng = random.Random(7)
    for type_ in (pieces.UNIGRAM, pieces.BPE):
        words = vocabulary(5)
        p = pieces.Pieces(model(words if type_ == pieces.UNIGRAM else {w: -float(len(w) * 100 + i) for i, w in enumerate(words)}, type_))
        for n in (500, 1_000):
            w = "".join(rng.choice("aabcd") for _ in range(n))
            last, start = p._ways(p._codes([w], n))
            got = p._windows(w)
            assert got[0][1:] == last[0][1:].tolist() and got[1][1:] == start[0][1:].tolist()


@pytest.mark.parametrize("type_", [pieces.UNIGRAM, pieces.BPE])
def test_words_of_many_lengths_advance_together(type_, monkeypatch):
    words = vocabulary(8)
    p = pieces.Pieces(model(words if type_ == pieces.UNIGRAM else {w: -float(len(w) * 100 + i) for i, w in enumerate(words)}, type_))
    rng = random.Random(8)
    every = ["".join(rng.choice("abcdé") for _ in range(n)) for n in range(120) for _ in range(4)]
    rng.shuffle(every)
    alone = [p.encode_words([w])[0] for w in every]
    groups = []
    ways = p._ways
    monkeypatch.setattr(p, "_ways", lambda codes, *more: groups.append(codes.shape) or ways(codes, *more))
    assert p.encode_words(every) == alone and sum(n for n, _ in groups) == 476 and len(groups) == 1
    monkeypatch.setattr(pieces, "CELLS", 1_000)
    assert p.encode_words(every) == alone and all(n * size <= 1_000 for n, size in groups[1:])


def test_pieces_of_one_letter_are_told_apart_by_the_first_bits():
    letters = [chr(x) for x in range(0x4E00, 0x4E00 + 3_000)]
    p = pieces.Pieces(model({c: -float(i) for i, c in enumerate(letters)}, pieces.UNIGRAM))
    assert len(set((p.keys >> pieces.np.uint64(43)).tolist())) > 2_900 and p.steps <= 4
    assert [p.text[i] for i in p._probe(p._hashes(letters + ["㐀"]))[:-1]] == letters and p._probe(p._hashes(["㐀"])).tolist() == [-1]


def test_by_scores_takes_the_largest_sum():
    words = vocabulary(6)
    p = pieces.Pieces(model({w: -float(i) for i, w in enumerate(words)}, pieces.BPE), by_scores=True)
    worth = {p.text[i]: float(p.worth[i]) for i in p.ids}
    assert p.type == pieces.UNIGRAM and sorted(worth, key=worth.get, reverse=True) == list(words)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=model(worth, pieces.UNIGRAM))
    for t, mine in zip(texts := random_texts(6, 200, "abcd "), p.encode(texts)):
        want = theirs.encode(t)
        assert sum(worth[p.text[i]] for i in mine) == pytest.approx(sum(worth[theirs.id_to_piece(i)] for i in want), abs=1e-3)


def test_public_model_equals_the_library():
    try:
        p = pieces.load()
    except OSError:
        pytest.skip("no model file here")
    theirs = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(5)
    bits = ["the", "ing", "Straße", "été", "niño", " ", "  ", "\n", "tion", "er", "a", "x", "0", "19", "日本", "🙂", "-", "==", "\t", "▁", "wordy", "THE", "qu"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(600)] + ["", " ", "a" * 5_000, "ab" * 700 + "\x00", "日本" * 600, "Zm9v" * 500]
    for t, mine in zip(texts, p.encode(texts)):
        assert mine.tolist() == theirs.encode(t), t
        if "▁" not in t:
            assert p.decode(mine) == t


def test_other_operators_tasks_drop_what_a_worker_keeps():
    data = model(vocabulary(1), pieces.UNIGRAM)
    mine = common.released(lambda batches: iter([pieces.shared(data)]), pieces.OWNER)
    (first,), (again,) = mine([]), mine([])
    assert first is again
    kept = weakref.ref(first)
    del first, again
    assert list(common.released(lambda batches: iter([kept()]))([])) == [None]
    assert list(mine([]))[0].text[0] == "<unk>"


def test_over_spark(spark):
    data = model(vocabulary(1), pieces.UNIGRAM)
    rows = [(i, t, "x", None) for i, t in enumerate(random_texts(4, 80, "abcdé \n€"))] + [(900, None, None, None), (901, "", None, None), (902, "abcd " * 30_000, None, None), (902, "a", None, None), (None, "b" * 20_000, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = pieces.encode(df.drop("text_sha256"), data, ["doc_id"], check=True)
    got = out.collect()
    assert len(got) == len(rows) and all(r.round_trip for r in got)
    back = pieces.decode(out.select("doc_id", "ids"), data, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(r[0]), r[1] or "") for r in rows)
    assert pieces.encode(df.where("false"), data, ["doc_id"]).count() == 0
