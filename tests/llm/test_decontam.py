import random

import pytest

from parchmint.llm import decontam as C


def brute_score(a, b):
    best = 0
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = C.MATCH if a[i - 1] == b[j - 1] else C.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + C.GAP, h[i][j - 1] + C.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_recurrence():
    import numpy as np

    rng = random.Random(0)
    for _ in range(80):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(0, 12))] for _ in range(2))
        assert C.score(np.array(a, dtype=int), np.array(b, dtype=int))[0] == brute_score(a, b)


def items(rng, n=6):
    return [(i, " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(30))) for i in range(n)]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS score")


@pytest.mark.parametrize("words", [500_000, 40])
def test_copies_edits_and_clean_documents(spark, docs, monkeypatch, words):
    monkeypatch.setattr(C, "ITEM_WORDS", words)
    rng = random.Random(1)
    items_, filler = items(rng), lambda n: " ".join(rng.choice("the of and to in that it is was for".split()) for _ in range(n))
    rows, want = [], set()
    for d in range(60):
        text = filler(50)
        if d % 3 == 0:  # one item in a third of all documents
            w = items_[0][1].split()
            for _ in range(d % 4):
                w[rng.randrange(len(w))] = "edited"
            text += " " + " ".join(w).upper() + ". " + filler(30)
            want.add((d, 0))
        if d % 10 == 1:
            i = 1 + d % 5
            w = items_[i][1].split()
            del w[rng.randrange(len(w))]
            text += " " + " ".join(w[:10]) + " extra " + " ".join(w[10:])
            want.add((d, i))
        rows.append((d, text))
    rows += [(200, None), (201, ""), (202, items_[2][1]), (202, items_[2][1]), (None, items_[3][1]), (203, filler(20_000) + " " + items_[4][1]), (204, " ".join(items_[5][1].split()[:5]))]
    want |= {(202, 2), (None, 3), (203, 4)}
    more = items_ + [items_[0], (90, None), (91, ""), (92, "two words"), (None, items_[1][1][:0])]
    got = [(r.doc_id, r.item_id) for r in C.contaminated(docs(rows).repartition(4), bench(spark, more)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("copies", [8, 9, 40])
def test_parts_and_edits_in_many_documents(spark, docs, copies):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    half, edited, both = ([word() for _ in range(40)] for _ in range(3))
    every4th = lambda w: " ".join(x if k % 4 < 3 else word() for k, x in enumerate(w))
    rows = [(d, " ".join(half[:20])) for d in range(copies)] + [(100 + d, every4th(edited)) for d in range(copies)]
    rows += [(200 + d, every4th(both)) for d in range(copies)] + [(300, " ".join(both))]  # one whole copy besides
    rows += [(400 + d, " ".join([word() for _ in range(30)] + half[:3])) for d in range(20)]  # a lone n-gram
    got = C.contaminated(docs(rows), bench(spark, [(0, " ".join(half)), (1, " ".join(edited)), (2, " ".join(both))])).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(d, d // 100) for d, _ in rows[: 3 * copies]] + [(300, 2)]


def test_a_lone_everyday_phrase_is_no_evidence(spark, docs):
    rows = [(d, f"w{d} is one of the x{d}") for d in range(30)]
    assert C.contaminated(docs(rows), bench(spark, [(0, "one of the best known rivers")])).collect() == []


def test_words_shared_bounds_the_score():
    import numpy as np

    rng = random.Random(3)
    for _ in range(80):
        a, b = (np.array([rng.randint(1, 5) for _ in range(rng.randint(1, 12))]) for _ in range(2))
        assert C.score(a, b)[0] <= C.MATCH * C.words_shared(a, b) == C.MATCH * sum(min((a == x).sum(), (b == x).sum()) for x in set(a.tolist()))


def test_short_items(spark, docs):
    got = C.contaminated(docs([(1, "so Two words."), (2, "two other words"), (3, "single")]), bench(spark, [(5, "two words"), (6, "single")])).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(1, 5), (3, 6)]


def test_empty_tables(spark, docs):
    assert C.contaminated(docs([]), bench(spark, [(1, "a b c d")])).collect() == []
    assert C.contaminated(docs([(1, "a b c d")]), bench(spark, [])).collect() == []
