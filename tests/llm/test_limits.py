"""Long texts, hot keys, clashing names, and two operators against plain loops."""

import random

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

from parchmint.llm import bpe, common, decontam, langid, packing, secrets, similarity, token_counts, warc


@pytest.mark.parametrize("space", [" ", "\t", "\n", " \n\t", " ", "  "])
def test_long_runs_of_spaces_have_the_tokenizers_ids(space):
    path = bpe.default_tokenizer()
    own, other = bpe.encoder(path), tokenizers.Tokenizer.from_file(path)
    for n in (1, 2, 1000, 10_000, 10_001, 200_000):
        run = (space * n)[:n]
        for text in (run, f"a{run}", f"a{run}b", f"{run}b c", f"x{run}<|endoftext|>y", f"1{run}..", f"a{run}b{run}"):
            assert own.ids(text).tolist() == other.encode(text, add_special_tokens=False).ids


def test_five_million_spaces(spark, docs):
    rows = docs([(1, "a" + " " * 5_000_000 + "b"), (2, " " * 1_200_000)])
    assert packing.token_pieces(rows).agg(F.sum("length").alias("n")).first().n == token_counts.section_token_counts(rows).agg(F.sum("n_tokens").alias("n")).first().n + 2


def test_a_long_item_in_a_repeating_document_takes_one_row_of_cells():
    rng = np.random.default_rng(0)
    item = rng.integers(1, 3000, 2000)
    best, matched = decontam.score(item, np.tile(item, 20))
    assert (best, matched) == (decontam.MATCH * len(item), len(item))


def test_any_number_of_distinct_words():
    items = decontam.Items([" ".join(f"w{k}" for k in range((1 << 20) + 5)), "one two three"])
    assert len(items.seed_key) == (1 << 20) + 4


def test_contaminated_pairs_equal_brute_force(spark, docs):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [[word() for _ in range(rng.randint(8, 40))] for _ in range(12)]
    texts = []
    for _ in range(80):
        text = [word() for _ in range(rng.randint(0, 60))]
        for w in rng.sample(items, rng.randint(0, 2)):
            part = [x if rng.random() > rng.choice([0, 0.1, 0.3]) else word() for x in w][: rng.randint(len(w) // 3, len(w))]
            at = rng.randint(0, len(text))
            text = text[:at] + part + text[at:]
        texts.append(text)
    texts += [texts[0], texts[1]]
    number: dict[str, int] = {}
    coded = lambda w: np.array([number.setdefault(x, len(number)) for x in w], dtype=int)
    grams = lambda w: {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    want = [(d, i) for d, t in enumerate(texts) for i, w in enumerate(items) if grams(t) & grams(w) and decontam.score(coded(w), coded(t))[0] >= len(w) * decontam.MATCH * decontam.MIN_SCORE]
    rows, bench = docs([(d, " ".join(t)) for d, t in enumerate(texts)] + [(3, " ".join(texts[3]))]), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([*items, items[2]]) if i < 12] + [(2, " ".join(items[2]))], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminated(rows, bench).collect()) == want and len(want) > 20


def test_prediction_equals_a_loop_over_bytes(spark):
    rng, words = random.Random(3), {"en": "the of and with that".split(), "fr": "le été ça où très".split()}
    texts = [" ".join(rng.choice(words[k]) for _ in range(rng.randint(1, 40))) for k in words for _ in range(8)]
    model = langid.train([(t, k) for t, k in zip(texts, [k for k in words for _ in range(8)])], steps=30)
    h = langid.HIDDEN

    def states(d, codes):
        out, s = {}, np.zeros(h)
        for t in range(len(codes)) if d == 0 else reversed(range(len(codes))):
            a, g = model.x[d][codes[t]] + model.b[d], s @ model.u[d]
            z, r = (1 / (1 + np.exp(-(a[k * h : k * h + h] + g[k * h : k * h + h]))) for k in (0, 1))
            s = z * s + (1 - z) * np.tanh(a[2 * h :] + r * g[2 * h :])
            out[t] = s
        return [out[t] for t in range(len(codes))]

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in langid.predict(df, model).collect():
        data, total = texts[r.doc_id].encode(), np.zeros(len(model.languages))
        for at in range(0, len(data), langid.WINDOW):
            part = data[at : at + langid.WINDOW]
            codes = part.ljust(langid.WINDOW, b"\0")
            for f, b, _ in zip(states(0, codes), states(1, codes), part):
                e = np.exp(np.concatenate([f, b]) @ model.o + model.c)
                total += e / e.sum()
        assert r.lang_pred == model.languages[total.argmax()] and abs(r.score - total.max() / len(data)) < 1e-4


def test_columns_of_a_user_with_the_operators_names(spark):
    names = "_ord _kept _again _sha _spans _n _part _hot sha spans kept again".split()
    rows = [(1, "password=abcdefghijklmnop " + "word " * 30), (2, "other words " * 20), (2, "other words " * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    for out, n in ((secrets.redact(df), 3), (similarity.keep_one(df), 2)):
        got = out.collect()
        assert out.columns == df.columns and len(got) == n and all(tuple(r)[2:] == tuple(range(len(names))) for r in got)


def test_pages_without_ids_do_not_all_reach_the_driver(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(warc, "train", lambda samples: seen.extend(samples) or b"")
    html = F.concat(F.lit("x" * 120), F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string"))
    pages = spark.range(6000).select(F.lit(None).cast("long").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), html.alias("html"))
    assert warc.read_archives(warc.write_archives(pages)).count() == 6000
    assert 0 < len(seen) <= warc.SAMPLE_PAGES


def test_hot_keys_are_joined_like_others(spark):
    left = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1500).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("_n")).filter("k % 2 = 0 OR k = -1").withColumn("v", F.col("k") * 2)
    got = {r.doc_id: r.v for r in common.joined_to_unique(left, right, "k", 5000, ["doc_id"]).collect()}
    key = lambda i: -1 if i % 3 == 0 else i % 1500
    assert got == {i: key(i) * 2 if key(i) == -1 or key(i) % 2 == 0 else None for i in range(5000)}


def test_pairs_at_the_threshold_share_a_group(spark, docs):
    """Exact Jaccard similarity against the groups, on lone pairs just above 0.8, which lose most: 92 of 100 were found when this was written."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(150):
        w = [word() for _ in range(rng.randint(120, 400))]
        v = list(w)
        for at in rng.sample(range(5, len(w) - 5, 10), max(1, round(len(w) / 47))):
            v[at] = word()
        texts += [" ".join(w), " ".join(v)]
    sets = [set(similarity.shingle_set(t, 5).tolist()) for t in texts]
    pairs = [(k, k + 1) for k in range(0, 300, 2) if len(sets[k] & sets[k + 1]) >= 0.8 * len(sets[k] | sets[k + 1])]
    group = {r.doc_id: r.component_id for r in similarity.components(docs(list(enumerate(texts)))).collect()}
    assert len(pairs) > 60 and sum(group[a] == group[b] for a, b in pairs) >= 0.9 * len(pairs)
