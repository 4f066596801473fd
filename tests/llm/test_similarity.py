import random

import numpy as np
import pytest

from parchmint.llm import similarity as S
from parchmint.llm.simhash import _labels


def words_(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n)]


def edited(rng, w, k):
    v = list(w)
    for at in rng.sample(range(0, len(w), 6), k):
        v[at] = words_(rng, 1)[0]
    return v


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def similar(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) >= S.SIMILARITY * len(a | b)


def fps_of(texts):
    return np.stack([S.wide_fingerprint(S.shingle_set(t, 5)) for t in texts])


def smallest(n, near):
    i, j = np.nonzero(np.triu(near, 1))
    return _labels(n, i, j).tolist()


def differing(fps):
    return np.unpackbits(fps[:, None] ^ fps[None], axis=2).sum(axis=2)


def ids(df):
    return sorted(r.doc_id for r in df.collect())


def test_repeated_lines_neither_join_nor_part_documents(spark, docs):
    rng, rows, keep = random.Random(5), [], []
    for d in range(0, 40, 4):
        line = " ".join(words_(rng, 20))
        x, y = (" ".join(words_(rng, 100)) for _ in range(2))
        rows += [(d, f"{x} {' '.join([line] * 10)}"), (d + 1, f"{y} {' '.join([line] * 10)}")]  # one line in common
        z = words_(rng, 100)
        one, ten = (" ".join([*z, *[line] * k]) for k in (2, 10))  # the same shingles
        rows += [(d + 2, one), (d + 3, ten)]
        assert not similar(rows[-4][1], rows[-3][1]) and shingles(one) == shingles(ten)
        keep += [d, d + 1, d + 2]
    assert ids(S.keep_one(docs(rows))) == keep


def test_equal_fingerprints_of_different_texts_are_compared(spark, docs, monkeypatch):
    monkeypatch.setattr(S, "wide_fingerprint", lambda hashes: np.zeros(S.BYTES, dtype=np.uint8))
    monkeypatch.setattr(S, "KEYS", 1)
    monkeypatch.setattr(S, "INDEX", S._positions(1, 1))
    rng = random.Random(6)
    rows = [(d, " ".join(words_(rng, 50))) for d in range(4)] + [(9, "a b")]
    rows += [(d + 10, t + " more") for d, t in rows[:4]]
    assert ids(S.components(docs(rows)).filter("doc_id = component_id")) == [0, 1, 2, 3, 9]


def test_a_true_pair_among_false_neighbours(spark, docs):
    rng = random.Random(7)
    base, texts = words_(rng, 300), []
    for _ in range(30):  # similar to each other at about 0.76, and each has one partner at about 0.82
        w = edited(rng, base, 4)
        texts += [" ".join(w), " ".join(edited(rng, w, 6))]
    fps = fps_of(texts)
    keys = S.keys_of(fps, S.INDEX)
    near = (differing(fps) <= S.MAX_DIFFERENT) & (keys[:, None] == keys[None]).any(axis=2)
    alike = np.array([[similar(a, b) for b in texts] for a in texts])
    want = smallest(len(texts), near & alike)
    got = {r.doc_id: r.component_id for r in S.components(docs(list(enumerate(texts)))).collect()}
    assert [got[k] for k in range(len(texts))] == want
    assert len(set(want)) > 5 and (near & ~alike).sum() > 500


@pytest.mark.parametrize("strip", [1, 1000, 1 << 19])
@pytest.mark.parametrize("n", [2, 60, 300])
def test_a_posting_is_compared_whole(monkeypatch, strip, n):
    monkeypatch.setattr(S, "STRIP", strip)
    rng, nodes = np.random.default_rng(n), np.arange(n) + 1000
    centres = rng.integers(0, 256, (max(1, n // 20), S.BYTES), dtype=np.uint8)
    flips = np.packbits(rng.random((n, S.BYTES * 8)) < rng.choice([0.05, 0.09, 0.12], (n, 1)), axis=1)
    fps = np.ascontiguousarray(centres[rng.integers(0, len(centres), n)] ^ flips)
    near = differing(fps) <= S.MAX_DIFFERENT
    a, b = (np.concatenate(x) - 1000 if x else np.empty(0, dtype=int) for x in zip(*S.posting_pairs(nodes, fps, None)) or ((), ()))
    assert near[a, b].all() and _labels(n, a, b).tolist() == smallest(n, near)
    assert len(a) == n - len(set(smallest(n, near)))  # a forest
    part = rng.integers(0, 3, n)
    found = {(min(x), max(x)) for i, j in S.posting_pairs(nodes, fps, part) for x in zip((i - 1000).tolist(), (j - 1000).tolist())}
    assert found == {(i, j) for i, j in zip(*np.nonzero(np.triu(near & (part[:, None] != part[None]), 1)))}


def test_each_near_pair_leaves_one_posting_and_a_forest_connects_them_all(spark):
    rng = np.random.default_rng(7)
    bits = np.unpackbits(np.repeat(rng.integers(0, 256, (4, S.BYTES), dtype=np.uint8), 40, axis=0), axis=1)
    fps = np.packbits(bits ^ (rng.random(bits.shape) < rng.choice([0.005, 0.03, 0.09], (len(bits), 1))), axis=1)
    keys = S.posting_keys(fps, 12)
    near = (differing(fps) <= S.MAX_DIFFERENT) & (keys[:, None] == keys[None]).any(axis=2)
    pairs = [(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(near, 1)))]
    assert len(pairs) > 1000
    for i, j in pairs[::7]:
        shared = np.unique(keys[i][keys[i] == keys[j]])
        x, y = (np.repeat(fps[k : k + 1], len(shared), axis=0) for k in (i, j))
        assert S.owned(shared, x, y, 12).tolist() == [True] + [False] * (len(shared) - 1)
    rows = [(k, f.tobytes(), k) for k, f in enumerate(fps)]
    classes = spark.createDataFrame(rows, "node long, fp binary, part long")
    assert sorted((r.a, r.b) for r in S.near(classes).collect()) == sorted(pairs)
    links = [(r.a, r.b) for r in S.near(classes.select("node", "fp")).collect()]
    assert set(links) <= set(pairs) and len(links) < len(pairs) / 2
    a, b = np.array(links).T
    assert _labels(len(fps), a, b).tolist() == smallest(len(fps), near)


def test_pairs_are_tallied_by_their_positional_bytes():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 256, (400, S.BYTES), dtype=np.uint8)
    y = x.copy()
    for k in range(400):  # one bit of all but k % 65 bytes
        at = rng.permutation(S.BYTES)[k % 65 :]
        y[k, at] ^= np.uint8(1) << rng.integers(0, 8, len(at)).astype(np.uint8)
    differ = x.view(np.uint64) ^ y.view(np.uint64)
    assert S.shared_bytes(differ).tolist() == [k % 65 for k in range(400)] == (x == y).sum(axis=1).tolist()
    ok, bits = S.verified(x.view(np.uint64), y.view(np.uint64), S.MAX_DIFFERENT)
    assert bits.tolist() == [64 - k % 65 for k in range(400)] and ok.tolist() == [k % 65 >= S.KEY_BYTES for k in range(400)]
    two = np.stack([x[2], y[2]])  # 62 differing bits, but met by a collision: two bytes in common make no combination
    assert not list(S.near_pairs(two, np.arange(2), S.MAX_DIFFERENT)) and not list(S.forest(two))
    three = np.stack([x[3], y[3]])
    assert len(list(S.near_pairs(three, np.arange(2), S.MAX_DIFFERENT))) == 1
