import random
import zlib
from itertools import combinations

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from parchmint.llm import packing as P
from parchmint.llm import token_counts as T
from parchmint.llm.bpe import default_tokenizer, encoder

ODD = ["", " ", "a  b\n\n c", "It's 12,345 <|endoftext|> été 日本語 🙂", "x" * 3000, "  \t\r\n", "don't we'll I've"]


def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_are_the_tokenizers():
    t = tokenizer()
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice("abc AB\n.,'é1 ") for _ in range(200)) for _ in range(50)]
    for text in texts:
        assert encoder(default_tokenizer()).ids(text).tolist() == t.encode(text, add_special_tokens=False).ids


def test_fullest_is_the_best_subset():
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room = rng.randint(1, 60)
        counts = {x: sizes.count(x) for x in sizes}
        best = max(sum(c) for n in range(len(sizes) + 1) for c in combinations(sizes, n) if sum(c) <= room)
        got = P.fullest(counts, room)
        assert sum(got) == best and all(got.count(x) <= counts[x] for x in got)


def test_every_token_is_packed_once(spark, docs):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("the of and to".split()) for _ in range(rng.randint(0, 1500)))) for i in range(60)] + [(3, "again"), (None, "no id"), (70, None), (71, "")] + [(80 + i, t) for i, t in enumerate(ODD)] + [(99, "word " * 5000)] + [(300 + i, "same length") for i in range(200)]
    got = [r.asDict() for r in P.pack_documents(docs(rows).repartition(3), 256).collect()]
    enc, want = tokenizer(), []
    for d, t in rows:
        ids = np.array(enc.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(d, i, s, n, zlib.crc32(ids[s : s + n].tobytes())) for i, (s, n) in enumerate(P.cut(len(ids), 256))]
    assert sorted([(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got], key=repr) == sorted(want, key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in bins.values():
        end = 0
        for o, n in sorted(places):
            assert o == end
            end += n
        assert end <= 256
    least = -(-sum(r["length"] for r in got) // 256)
    assert len(bins) <= least + 1


def test_cut():
    assert P.cut(1, 8) == [(0, 1)] and P.cut(16, 8) == [(0, 8), (8, 8)] and P.cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_empty_tables(spark, docs):
    assert P.pack_documents(docs([])).collect() == [] and T.section_token_counts(docs([])).collect() == []


def test_token_counts_by_rule(spark, docs):
    texts = ["one two\nthree four\n", "no break", "", None, "\n\n\n", "日\n本 🙂x\n", "a\n b"] + ODD
    t = tokenizer()
    for rule in T.RULES:
        got = {}
        for r in T.section_token_counts(docs(list(enumerate(texts))), rule).collect():
            got.setdefault(r.doc_id, []).append(r)
        for d, text in enumerate(texts):
            text = text or ""
            rows = sorted(got[d], key=lambda r: r.section)
            assert [text[r.section_start : r.section_end] for r in rows] == (text.splitlines(keepends=True) or [""]) or "\r" in text or " " in text
            assert sum(r.n_tokens for r in rows) == len(t.encode(text, add_special_tokens=False).ids)
            byte, want = 0, [0] * len(rows)
            at = [i for i, c in enumerate(text) for _ in c.encode()]
            for i in encoder(default_tokenizer()).ids(text):
                n = int(encoder(default_tokenizer()).n_bytes[i])
                chars = list(dict.fromkeys(at[byte : byte + n]))
                of = [next(k for k, r in enumerate(rows) if r.section_start <= c < r.section_end) for c in chars]
                want[of[0] if rule == "first" else of[-1] if rule == "last" else max(dict.fromkeys(of), key=of.count)] += 1
                byte += n
            assert [r.n_tokens for r in rows] == want, (rule, text)
