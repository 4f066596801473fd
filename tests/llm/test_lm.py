import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path
from urllib.parse import urlparse

import pytest

from parchmint.llm import lm as L


def brute(rows):
    tokens = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), None]
    held = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 10 == 0
    count = Counter(x for d, t in rows if held(d) is False for x in tokens(t))
    n, v = sum(count.values()), len(count)
    contexts = [defaultdict(Counter) for _ in range(L.ORDER + 1)]
    framed = lambda t: bytes([L.BEGIN]) * L.ORDER + (t or "").encode() + bytes([L.END])
    for d, t in rows:
        if held(d) is False:
            s = framed(t)
            for i in range(L.ORDER, len(s)):
                for k in range(L.ORDER + 1):
                    contexts[k][s[i - k : i]][s[i]] += 1

    def log_p(s, i):
        out, gone = 0.0, set()
        for k in range(L.ORDER, -1, -1):
            left = {x: c for x, c in contexts[k].get(s[i - k : i], {}).items() if x not in gone}
            if not left:
                continue
            whole = sum(left.values()) + len(left)
            if s[i] in left:
                return out + math.log10(left[s[i]] / whole)
            out += math.log10(len(left) / whole)
            gone |= set(left)
        return out - math.log10(max(1, L.SYMBOLS - len(gone)))

    for d, t in rows:
        w, s = tokens(t), framed(t)
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        yield d, held(d), len(w), sum(count[x] > 0 for x in w), n, base, sum(log_p(s, i) for i in range(L.ORDER, len(s)))


def check(got, rows):
    key = lambda r: (repr(r[0]), r[2], round(r[5], 6))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(brute(rows), key=key), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9) and g[6] == pytest.approx(w[6], rel=1e-9)


@pytest.mark.parametrize("chunk", [4 << 20, 300])
def test_equals_brute_force(spark, docs, monkeypatch, chunk):
    made = L.chunked
    monkeypatch.setattr(L, "chunked", lambda df: made(df, chunk))
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("The the of Été banana nab ban 日本 x".split()) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    rows += [(7, rows[3][1]), (7, rows[3][1]), (None, "no id the"), (500, None), (501, ""), (502, "q" * 3000), (503, "unseen wörds")]
    check(L.score_documents(docs(rows).repartition(3)).collect(), rows)


def test_without_training_documents(spark, docs):
    held = next(i for i in range(100) if L.held_out(i))
    check(L.score_documents(docs([(held, "some text"), (None, "")])).collect(), [(held, "some text"), (None, "")])
    assert L.score_documents(docs([])).collect() == []


def test_wide_tries_are_numbered_alike(monkeypatch):
    import numpy as np

    data = np.frombuffer(bytes([L.BEGIN]) * 4 + b"banana band" + bytes([L.END]), dtype=np.uint8)
    ends = np.arange(4, len(data))
    keys, leaf = L.trie(data, ends)
    monkeypatch.setattr(L, "DENSE_NODES", 0)
    again = L.trie(data, ends)
    assert np.array_equal(keys, again[0]) and np.array_equal(leaf, again[1])
    assert [int(k).to_bytes(5, "big") for k in keys[leaf]] == [data[i - 4 : i + 1].tobytes() for i in ends]


def test_messages_and_answers_are_smaller_than_the_texts(spark, docs, monkeypatch):
    made, size = L.materialize, {}

    def measured(df, name, *args):
        out = made(df, name, *args)
        size[name] = sum(Path(urlparse(f).path).stat().st_size for f in out.inputFiles())
        return out

    monkeypatch.setattr(L, "materialize", measured)
    rng = random.Random(9)
    words = ["".join(rng.choice("aeiou") + rng.choice("bcdfghklmnprstvwz") for _ in range(rng.randint(1, 5))) for _ in range(20000)]
    rows = [(i, " ".join(words[int(20000 * rng.random() ** 3)] for _ in range(1000))) for i in range(200)]
    assert L.score_documents(docs(rows).coalesce(2)).count() == len(rows)
    text = sum(len(t) for _, t in rows)
    assert sorted(size) == ["answers", "counts"] and 10 * size["counts"] < 4 * text and 10 * size["answers"] < 2 * text


@pytest.mark.parametrize("values", [[], [0, 0], [1, 255, 256, 7], [2**64 - 1, 0, 3]])
def test_integers_come_back_from_their_planes(values):
    import numpy as np

    got = L.unpacked(L.packed(np.array(values, dtype=np.uint64), np.array([5])))
    assert [a.tolist() for a in got] == [values, [5]]
