import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from parchmint.llm import similarity as S
from parchmint.llm import simhash as H
from parchmint.llm.components import connected_components


def brute_fingerprint(text, words=3):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    s = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] if len(w) >= words else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(n, linked):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, j in combinations(range(n), 2):
        if linked(i, j):
            a, b = find(i), find(j)
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_equals_brute_force(spark, docs):
    rng = random.Random(0)
    base = ["the of and to in that it is was for on are as with his they at be this from".split()[rng.randrange(20)] for _ in range(150)]
    rows = [(0, " ".join(base)), (1, None), (2, ""), (3, "  \n"), (4, "One"), (5, "one"), (6, "É é"), (7, "a b c"), (None, "one")]
    for d in range(10, 90):
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 30])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        rows.append((d, " ".join(w)))
    rows += [(10, rows[12][1]), (10, rows[12][1])]
    got = sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in H.near_duplicates(docs(rows).repartition(4)).collect()), key=repr)
    fps = [brute_fingerprint(t) for _, t in rows]
    root = roots(len(rows), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    smallest = {r: min((d for (d, _), q in zip(rows, root) if q == r and d is not None), default=None) for r in root}
    assert got == sorted(((d, f, smallest[r]) for (d, _), f, r in zip(rows, fps, root)), key=repr)
    assert len(set(root)) < len(set(fps)) < len(rows)


@pytest.mark.parametrize("split", [4096, 8])
def test_links_lose_no_pair(spark, monkeypatch, split):
    """Random walks of one to three bits, in dense postings that are split again or not."""
    monkeypatch.setattr(H, "SPLIT_ROWS", split)
    rng = random.Random(split)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for _ in range(250):
        x = rng.choice(fps)
        for b in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
            x ^= 1 << b
        fps.append(x)
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    edges = H.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    label = {r.node: r.label for r in connected_components(edges).collect()}
    root = roots(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 2)
    groups, want = {}, {}
    for i, x in enumerate(signed):
        groups.setdefault(label.get(x, x), set()).add(x)
        want.setdefault(root[i], set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1001 + i) for i in range(300)] + [(5, 5), (40, 0)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[1000 + i] for i in range(301)} == {1000}


def test_empty_tables(spark, docs):
    assert H.near_duplicates(docs([])).collect() == [] and S.keep_one(docs([])).collect() == []


def jaccard(a, b):
    s = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_similarity_keeps_one_of_each_group(spark, docs):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, near, d = [], 0, 0
    for _ in range(40):
        w = [word() for _ in range(200)]
        rows.append((d, " ".join(w)))
        v = list(w)
        for _ in range(3):
            v[rng.randrange(200)] = word()
        if jaccard(rows[-1][1], " ".join(v)) >= 0.85:
            near += 1
            rows.append((d + 1, " ".join(v)))
        d += 2
    rows += [(500, None), (501, ""), (502, rows[0][1]), (502, rows[0][1]), (600, "short text"), (None, "another text of its own here"), (700, "twice"), (700, "twice")]
    got = S.keep_one(docs(rows).repartition(3))
    assert got.columns == docs(rows).columns
    ids = sorted((r.doc_id for r in got.collect()), key=repr)
    assert ids == sorted([2 * k for k in range(40)] + [500, 600, 700, None], key=repr)
    assert near > 25


def test_wide_fingerprint_is_the_majority_of_bits():
    h = np.random.default_rng(0).integers(0, 2**63, 5000).astype("<u8")
    assert len(S.wide_fingerprint(h)) == S.BYTES and not S.wide_fingerprint(h[:0]).any()
    assert np.array_equal(S.wide_fingerprint(h), S.wide_fingerprint(h[::-1].copy()))
