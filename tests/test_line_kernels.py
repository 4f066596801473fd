import math
import random
import re
import unicodedata
from statistics import median_high

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchmint import schemas
from parchmint.functions import arrow_text as A
from parchmint.operators import folds
from parchmint.operators import line_kernels as K
from parchmint.operators import words as W
from parchmint.plans import catalog, derived

TOKENS = ["a", "x", "7", "night", "(", "“", ")", ",", "%", "p.m.", "é", "​", "", " two  words ", "don’t", "–", "So", "ocial", "wor’", "butIn", "ButIn", None, " ", "|", "l[", "]", "。"]
ONE, CLOSE, OPEN, MARKS = r"[^\W_]", r"[.,;:!?%…”’)}\]»,;]+", r"[({\[“‘«]+", r"[.,;:!?…'”’\")}\]»]+"


def clean(t):
    t = re.sub("[​-‍﻿]", "", unicodedata.normalize("NFC", t or ""))
    return re.sub("[‐‑‒–—]", "-", t).strip("  ").replace("  ", " ")


def line_of(rng):
    out, x = [], 0.0
    for _ in range(rng.randrange(0, 9)):
        t, h = rng.choice(TOKENS), rng.choice([5.0, 7.0, 20.0, 24.0])
        box = (x, 100.0 - h, x + 10 * len(t or "."), 100.0 + rng.choice([0, 0, 30])) if rng.random() > 0.1 else None
        base = (0.0, 0.0, 0.0, 100.0) if rng.random() < 0.2 else None
        out.append((t, rng.choice([10.0, 31.0, 40.0, 60.0, 81.0, 82.0, 95.0, None]), box, base))
        x += rng.choice([5.0, 60.0])
    return out


def by_hand(line):
    """(text, removed, flagged, confidence, box) of each word with text."""
    w = [(clean(t), c, b, base) for t, c, b, base in line if clean(t)]
    tall = [max(1.0, b[3] - b[1]) if b else 1.0 for _, _, b, _ in w]
    usual = median_high([*[h for h, x in zip(tall, w) if len(x[0]) > 1], *tall]) if w else 1.0
    low = [base[3] if base else b[3] if b else 0.0 for _, _, b, base in w]
    out = []
    for k, (t, c, b, _) in enumerate(w):
        gone = False
        if 0 < k < len(w) - 1 and len(t) == 1 and re.fullmatch(ONE, t) and t not in "aAI" and c is not None and b and w[k - 1][2] and w[k + 1][2]:
            faint = (c < 55 and tall[k] < usual * 0.68) or c < 32
            level = all(abs(low[k] - low[j]) <= usual * 0.8 for j in (k - 1, k + 1))
            gone = faint and level and b[0] >= w[k - 1][2][2] - usual * 0.2 and b[2] <= w[k + 1][2][0] + usual * 0.2
        plain = gone or re.fullmatch(MARKS, t) is not None
        out.append((t, gone, False if plain else None if c is None else c < 82, c, b))
    return out


def runs_by_hand(words):
    kept, out, before = [w for w in words if not w[1]], [], None
    for k, (t, _, flagged, c, b) in enumerate(kept):
        glued = k == 0 or re.fullmatch(CLOSE, t) or all(re.fullmatch(OPEN, x[0]) for x in kept[:k])
        piece = t if glued else " " + t
        if before is not None and (flagged is None or before[0] is None or flagged == before[0]):
            text, least, mark, box = out[-1]
            out[-1] = (text + piece, c if least is None else least if c is None else min(least, c), mark, box)
        else:
            out.append((piece, c, flagged, b))
        before = (flagged,)
    return out


def test_marks_and_runs_equal_their_definition_on_odd_lines(spark):
    rng = random.Random(4)
    rows = [line_of(rng) for _ in range(1500)] + [None, []]
    df = spark.createDataFrame([(k, line) for k, line in enumerate(rows)], f"k int, words array<{schemas.WORD}>").repartition(3)
    got = W.process_lines(df).orderBy("k").collect()
    removed = 0
    for r in got:
        want = by_hand(rows[r.k] or [])
        box = lambda b: tuple(b) if b else None
        assert [(w.text, w.removed, w.flagged, w.confidence, box(w.bbox)) for w in r.processed] == want
        assert r.n_words == len(want)
        assert [(x.text, x.confidence, x.flagged, box(x.bbox)) for x in r.runs] == runs_by_hand(want)
        removed += sum(w[1] for w in want)
    assert removed > 5


@pytest.mark.parametrize("name", ["joined_line_text", "ocr_noise_flags", "text_runs"])
def test_words_are_not_matched_one_by_one(spark, name):
    """A pattern in a lambda is interpreted word by word: at 1 GB these queries did not end in time."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" in plan and "RLIKE" not in plan and plan.count("regexp_replace") == 0
    assert plan.count("ArrowEvalPython") == 1


def pieces(rng, pieces_far):
    x, line = 0.0, []
    for _ in range(rng.randrange(0, 7)):
        t = rng.choice(["a", "b", "7", "ab", "stone", ",", "x.", "", None, "é"])
        w, h = 10 * len(t or "q"), rng.choice([5.0, 20.0])
        line.append({"text": t, "bbox": {"x0": x, "y0": 100 - h, "x1": x + w, "y1": 100.0} if rng.random() > 0.05 else None})
        x += w + rng.choice(pieces_far)
    return line


def test_split_words_are_found_for_all_lines_at_once(monkeypatch):
    rng, kind = random.Random(1), pa.list_(pa.struct([("text", pa.string()), ("bbox", pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")]))]))
    rows = [pieces(rng, [-5.0, -2.0, 2.0, 5.0, 30.0]) for _ in range(5000)] + [None, []]
    want = [folds.word_starts([w["text"] for w in r or []], [w["bbox"] for w in r or []]) for r in rows]
    got = folds._joined_words(pa.array(rows, type=kind)).to_pylist()
    assert [[run["at"] for run in r] for r in got] == want and [sum(run["n"] for run in r) for r in got] == [len(r or []) for r in rows]
    assert sum(run["n"] > 2 for r in got for run in r) > 10
    asked = []
    monkeypatch.setattr(folds, "word_starts", lambda *a: asked.append(a))
    far = [[{"text": t, "bbox": {"x0": x, "y0": 0.0, "x1": x + 10.0, "y1": 20.0}} for t, x in (("s", 0.0), ("tone", 12.0), ("wall", 90.0))]] * 3
    assert [[run["n"] for run in r] for r in folds._joined_words(pa.array(far, type=kind)).to_pylist()] == [[2, 1]] * 3 and not asked


def test_words_of_lines_follow_their_formula_and_stay_in_the_kernels(spark):
    """The words of ocr_noise_flags went into the JVM and back, and once more through a lambda for each of them."""
    lines = [(-40, 0, "a  é7 b"), (None, 1, "x yz"), (5, 2, ""), (5, 3, None), (2**40, 4, "x " * 30)]
    arrays = [pa.array([r[c] for r in lines], type=kind) for c, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.string()))]
    base = pa.array([None if d is None else 31 * d + 17 * i for d, i, _ in lines], type=pa.int64())
    want = []
    for d, i, t in lines:
        low, words = i * 24.0 + 20, []
        for k, w in enumerate(t.split(" ") if t is not None else []):
            sure = None if d is None else math.fmod(31 * d + 17 * i + 7 * k, 101)
            tall = 7.0 if len(w) == 1 and d is not None and (d + k) % 3 == 0 else 20.0
            words.append({"text": w, "confidence": sure, "bbox": {"x0": k * 300.0, "y0": low - tall, "x1": k * 300.0 + 10 * len(w), "y1": low}, "baseline": None})
        want.append(words)
    assert derived._words(arrays[0], arrays[1], base, arrays[2]).to_pylist() == want
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = catalog.QUERIES["ocr_noise_flags"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_marks(_words(" in plan and "bbox" not in plan.split("ArrowEvalPython")[0]


def test_tokens_that_are_passed_on_are_normal_already():
    words = pa.array(["stone", "a7", "", " a  b ", "é", "x​y", "–", "Å", None, "p.m.", "\ta"])
    assert A.normalize_tokens(words).to_pylist() == A.normalize_token(words).to_pylist() == ["stone", "a7", "", "a b", "é", "xy", "-", "Å", None, "p.m.", "a"]


def test_kernels_in_parts_find_what_they_find_at_once(monkeypatch):
    rng, box = random.Random(2), pa.struct([(c, pa.float64()) for c in ("x0", "y0", "x1", "y1")])
    kind = pa.list_(pa.struct([("text", pa.string()), ("confidence", pa.float64()), ("bbox", box), ("baseline", box)]))
    names = lambda b: dict(zip(("x0", "y0", "x1", "y1"), b)) if b else None
    rows = [[{"text": t, "confidence": c, "bbox": names(b), "baseline": names(base)} for t, c, b, base in line_of(rng)] for _ in range(300)]
    lists = pa.array([None, [], *rows, [], None], type=kind)
    whole = [f(lists).to_pylist() for f in (K._marks, K._texts, K._runs)]
    monkeypatch.setattr(K, "PART", 16)
    assert [f(lists).to_pylist() for f in (K._marks, K._texts, K._runs)] == whole
    assert [f(lists.slice(0, 0)).to_pylist() for f in (K._marks, K._texts, K._runs)] == [[], [], []]


def test_runs_leave_their_kernel_whole(spark):
    """text_runs sent all words to the JVM, for the box of each run's first."""
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    plan = catalog.QUERIES["text_runs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "_runs(_words(" in plan and "lambda" not in plan.split("ArrowEvalPython")[0]
    kind = "array<struct<text:string,confidence:double,bbox:struct<x0:int,y0:int,x1:int,y1:int,page:int>,extra:string>>"
    rows = [([("", 90.0, (0, 0, 9, 9, 1), "p"), ("a", 90.0, None, "q"), ("b", 20.0, (30, 1, 40, 9, 2), "r"), ("c", 30.0, (50, 1, 60, 9, 3), "s")],), (None,)]
    got = W.process_lines(spark.createDataFrame(rows, f"words {kind}").coalesce(1)).select("runs")
    assert got.dtypes == [("runs", f"array<{schemas.RUN}>")]
    assert [[tuple(x) for x in r.runs] for r in got.collect()] == [[("a", 90.0, False, None), (" b c", 20.0, True, (30.0, 1.0, 40.0, 9.0))], []]
