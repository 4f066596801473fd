import random

import numpy as np

from parchmint.llm import langid as G

WORDS = {"en": "the of and ing tion with that this for are".split(), "fr": "le la été ça où une des pour avec très".split(), "de": "der die und ß über nicht sch ich ein zu".split()}


def sentence(rng, lang, n):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_gradients_by_differences(monkeypatch):
    """Backpropagation through time against finite differences of the loss, for both directions."""
    monkeypatch.setattr(G, "HIDDEN", 3)
    rng = np.random.default_rng(0)
    m = {"x": rng.normal(0, 0.5, (2, 256, 9)), "u": rng.normal(0, 0.5, (2, 3, 9)), "b": rng.normal(0, 0.5, (2, 9))}
    codes, slope = rng.integers(97, 101, (6, 4)), rng.normal(size=(6, 4, 3))
    loss = lambda d: float((G._forward(m, d, codes)[0].astype(np.float64) * slope).sum())
    for d in (0, 1):
        grad = {k: np.zeros_like(v) for k, v in m.items()}
        G._backward(m, d, codes, G._forward(m, d, codes)[1], slope, grad)
        for k, at in (("x", (d, 98, 4)), ("x", (d, 99, 7)), ("u", (d, 1, 2)), ("u", (d, 2, 8)), ("b", (d, 5))):
            keep = m[k][at]
            m[k][at] = keep + 1e-3
            up = loss(d)
            m[k][at] = keep - 1e-3
            down = loss(d)
            m[k][at] = keep
            assert abs((up - down) / 2e-3 - grad[k][at]) < 2e-2


def test_prediction_equals_the_training_pass_at_every_position():
    rng = random.Random(0)
    model = G.train([(sentence(rng, k, 60), k) for k in WORDS for _ in range(5)], steps=20)
    m = {k: getattr(model, k) for k in ("x", "u", "b")}
    codes = np.frombuffer(sentence(rng, "fr", 40).encode()[:128], dtype=np.uint8).reshape(2, 64).T
    for d in (0, 1):
        assert np.allclose(G._forward(m, d, codes)[0].transpose(0, 2, 1), G._states(model, d, np.ascontiguousarray(codes)), atol=1e-4)
    assert np.allclose(G.position_probabilities(model, np.ascontiguousarray(codes)).sum(axis=1), 1, atol=1e-4)


def rows(rng, n=240):
    langs = list(WORDS)
    return [(i, sentence(rng, langs[i % 3], rng.randint(5, 80)), langs[i % 3]) for i in range(n)]


def test_held_out_accuracy_and_edge_cases(spark):
    rng = random.Random(1)
    data = rows(rng) + [(900, None, "en"), (901, "", "en"), (902, "123 -- 7 ² Ⅷ", None), (None, sentence(rng, "de", 30), None), (903, sentence(rng, "en", 4000), "en"), (5, "und die der", "de")]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").selectExpr("*", "'x' AS lang_pred", "1 AS score", "true AS held_out")
    model = G.fit(df)
    got = G.predict(df, model).collect()
    assert len(got) == len(data)
    by = {r.doc_id: r for r in got if r.doc_id != 5}
    held = [(by[d], lang) for d, t, lang in data if d is not None and d != 5 and by[d].held_out and by[d].lang_pred != "und"]
    assert len(held) > 30 and np.mean([r.lang_pred == lang for r, lang in held]) > 0.95
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (900, 901, 902)) and by[None].lang_pred == "de" and by[None].held_out is None
    assert all(0 <= r.score <= 1 for r in got)
    kept = G.keep_known(df, model)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, *_ in data} - {900, 901, 902}


def test_long_texts_are_pooled_whole():
    rng = random.Random(2)
    model = G.train([(sentence(rng, k, 60), k) for k in WORDS for _ in range(5)], steps=60)
    text = (sentence(rng, "en", 300) + " " + sentence(rng, "de", 3000)).encode()
    whole = G.pooled(model, [text, b"x"])
    parts = [text[i : i + G.WINDOW] for i in range(0, len(text), G.WINDOW)]
    each = G.pooled(model, parts)
    assert np.allclose(whole[0], sum(p * len(t) for p, t in zip(each, parts)) / len(text), atol=1e-5)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(2, "text", None)], "doc_id long, text string, lang string")
    assert G.fit(df) is None and G.predict(df, None).first().lang_pred == "und" and G.keep_known(df, None).count() == 0
    assert G.predict(df.limit(0), None).collect() == []
