import hashlib
import random

import numpy as np
import pytest

from parchmint.llm import dedup as D


def brute(rows):
    where = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - D.LENGTH + 1):
            k = b[i : i + D.LENGTH]
            where[k] = min(where.get(k, D.LAST), D.LAST if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - D.LENGTH + 1):
            if where[b[i : i + D.LENGTH]] < (D.LAST if d is None else d):
                gone[i : i + D.LENGTH] = b"\1" * D.LENGTH
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 6)))
    passage = [" ".join(word() for _ in range(30)) for _ in range(3)]
    rows = []
    for d in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 40)))]
        if rng.random() < 0.7:
            p = rng.choice(passage)
            a = rng.randint(0, 40)
            parts += [p[a : a + rng.randint(40, 120)], word()]
        rows.append((d * 3 % 61, " ".join(parts)))
    rows += [(100, rows[5][1]), (101, rows[5][1] + "x"), (7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1]), (None, rows[3][1]), (200, None), (201, ""), (202, "a" * 400), (203, "a" * 333), (204, "ab" * 120), (205, "é" * 60)]
    return rows


@pytest.mark.parametrize("hot, chunk, gram", [(64, 4 << 20, 24), (0, 700, 24), (1, 400, 16)])
def test_equals_brute_force(spark, docs, monkeypatch, hot, chunk, gram):
    """Nulls, empty texts, repeated rows, ties and periodic texts; hot anchors, many chunks and small shards as well."""
    monkeypatch.setattr(D, "HOT_PLACES", hot)
    monkeypatch.setattr(D, "SHARD_BYTES", 500)
    made = D.chunked
    monkeypatch.setattr(D, "chunked", lambda df: made(df, chunk))
    rows = corpus(gram)
    got = sorted((tuple(r) for r in D.dedup_substrings(docs(rows).repartition(3)).collect()), key=repr)
    assert got == brute(rows)


def test_empty_table(spark, docs):
    assert D.dedup_substrings(docs([])).collect() == []


def test_slabs(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "SLAB", 100)
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(1500))
    rows = [(1, text), (2, text[300:1200] + "z"), (3, "y" + text)]
    assert sorted((tuple(r) for r in D.dedup_substrings(docs(rows)).collect()), key=repr) == brute(rows)


def test_merge_is_the_sorted_order_of_all_rotations():
    rng = np.random.default_rng(0)
    texts = [rng.integers(97, 99, 70).astype(np.uint8).tobytes() for _ in range(12)]
    least = D.least_docs(texts, np.arange(12))
    for k, t in enumerate(texts):
        want = [min(j for j, u in enumerate(texts) if t[i : i + 50] in u) for i in range(21)]
        assert least[k].tolist() == want
