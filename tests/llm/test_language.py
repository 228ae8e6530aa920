import numpy as np
import pytest

from pairwright.llm import language

SCHEMA = "doc_id long, text string, lang string, score string, t string"
WORDS = {"en": "the of and thing with over", "de": "und der schön größe nicht über", "fr": "été les avec où être garçon", "es": "niño que señor los también año"}


def rows_for(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[lang].split(), rng.integers(3, 120))), lang, None, None) for i, lang in enumerate(rng.choice(list(WORDS), n))]


def test_held_out_accuracy_and_undefined_texts(spark):
    rows = rows_for(600, 1)
    extra = [(9000, None, "en", None, None), (9001, "", "fr", None, None), (9002, "12 34 \n!", "de", None, None), (9003, "und der schön größe nicht über " * 15_000, None, None, None), (None, "los niño", None, None, None), (9003, "x", None, None, None)]
    df = spark.createDataFrame(rows + extra, SCHEMA)
    net = language.fit(df.where("doc_id % 4 <> 2"))
    got = language.predict(df.select("doc_id", "text", "score"), net).collect()
    assert len(got) == len(rows) + len(extra)
    want = {r[0]: r[2] for r in rows if r[0] % 4 == 2}
    assert np.mean([r.lang_pred == want[r.id] for r in got if r.id in want]) > 0.97
    assert {r.id: (r.lang_pred, r.score) for r in got if r.id in (9000, 9001, 9002)} == {i: ("und", 0.0) for i in (9000, 9001, 9002)}
    assert "de" in {r.lang_pred for r in got if r.id == 9003} and all(0 <= r.score <= 1 for r in got)


def test_gradients_equal_differences():
    net = language.train([(b"abc def", "x"), (b"xyz", "y")] * 4, epochs=1)
    x = np.stack([language.cut(t.ljust(256, b"\0"))[0] for t in (b"hello there", b"abc xyz")])
    y = np.array([0, 1])
    for n in ("embed", "filters", "bias", "out", "out_bias"):
        setattr(net, n, getattr(net, n).astype(np.float64))

    def loss():
        z = language.logits(net, x)
        z = z - z.max(axis=1, keepdims=True)
        return -(z[np.arange(2), y] - np.log(np.exp(z).sum(axis=1))).mean()

    grads = language._gradients(net, x, y, np.ones_like(net.filters))
    for n in ("embed", "filters", "bias", "out", "out_bias"):
        a, g = getattr(net, n), grads[n]
        for i in np.flatnonzero(np.abs(g).ravel() > 1e-6)[:4]:
            old = a.ravel()[i]
            a.ravel()[i] = old + 1e-6
            up = loss()
            a.ravel()[i] = old - 1e-6
            down = loss()
            a.ravel()[i] = old
            assert g.ravel()[i] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_convolution_by_hand():
    net = language.train([(b"abc", "x"), (b"xyz", "y")], epochs=1)
    w = language.cut(b"some text".ljust(256, b"."))
    pooled = [max(sum(net.embed[w[0, i + j]] @ net.filters.reshape(5, 8, -1)[j, :, f] for j in range(5)) for i in range(252)) + net.bias[f] for f in range(32)]
    np.testing.assert_allclose(language.logits(net, w)[0], np.maximum(pooled, 0) @ net.out + net.out_bias, atol=1e-4)


def test_nothing_learned_and_empty(spark):
    df = spark.createDataFrame([(1, "text", None, None, None)], SCHEMA)
    assert language.fit(df) is None
    assert language.predict(df, None).first().lang_pred == "und"
    assert language.predict(df.where("false"), None).count() == 0
