"""Operator 7, language ID by a bidirectional gated recurrent network over UTF-8 bytes.

The network is trained in numpy by backpropagation through time on a bounded sample: of each language at most
SAMPLE_DOCS distinct training documents (the smallest hashes), of each a window of SAMPLE_CHARS characters at a place drawn by
hash, from documents whose crc32(doc_id as text) mod 4 is not 2. Every label of these is learned, however rare; a table with
more than MAX_LABELS of them is refused, as its labels aren't languages. Prediction labels every byte of every whole text, in
windows of WINDOW bytes with a fresh state, and pools the positions' probabilities into the document's.

Defined results: null texts and texts without a letter are "und" with score 0, as is all where no labelled training row
exists; repeated rows are predicted alike; a null doc_id is predicted and held_out is null; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm.common import arrow_map, materialize, table

SAMPLE_DOCS, SAMPLE_CHARS, MAX_LABELS = 200, 4096, 65_536
HIDDEN, WINDOW, SLAB = 8, 64, 4096
SLAB_LABELS = 16  # more labels make slabs smaller, so that a slab's probabilities keep their size
STEP_LABELS = 64  # more labels make as many times more steps
STEPS, BATCH, TRAIN_WINDOW, RATE, SEED = 500, 256, 32, 0.02, 7
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    """x: 256 x 3H input rows, u: H x 3H recurrent, b: 3H, each for both directions; o: 2H x L and c: L for the labels."""

    languages: list[str]
    x: np.ndarray
    u: np.ndarray
    b: np.ndarray
    o: np.ndarray
    c: np.ndarray


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-a))


def _forward(m: dict, d: int, codes: np.ndarray) -> tuple[np.ndarray, list]:
    """States (T, B, H) of one direction over codes (T, B), with what the backward pass needs."""
    h, n = np.zeros((codes.shape[1], HIDDEN), dtype=np.float32), HIDDEN
    states, kept = np.empty((*codes.shape, n), dtype=np.float32), []
    for t in range(len(codes)) if d == 0 else range(len(codes) - 1, -1, -1):
        a, g = m["x"][d][codes[t]] + m["b"][d], h @ m["u"][d]
        z, r = _sigmoid(a[:, :n] + g[:, :n]), _sigmoid(a[:, n : 2 * n] + g[:, n : 2 * n])
        c = np.tanh(a[:, 2 * n :] + r * g[:, 2 * n :])
        kept.append((t, h, z, r, c, g[:, 2 * n :]))
        h = z * h + (1 - z) * c
        states[t] = h
    return states, kept


def _backward(m: dict, d: int, codes: np.ndarray, kept: list, into: np.ndarray, grad: dict) -> None:
    """Backpropagation through time: into (T, B, H) is the loss's slope at each state."""
    n, back = HIDDEN, np.zeros_like(into[0])
    for t, h, z, r, c, gn in reversed(kept):
        dh = into[t] + back
        dc = dh * (1 - z) * (1 - c * c)
        dz = dh * (h - c) * z * (1 - z)
        dr = dc * gn * r * (1 - r)
        da, dg = np.concatenate([dz, dr, dc], axis=1), np.concatenate([dz, dr, dc * r], axis=1)
        np.add.at(grad["x"][d], codes[t], da)
        grad["b"][d] += da.sum(axis=0)
        grad["u"][d] += h.T @ dg
        back = dh * z + dg @ m["u"][d].T


def train(texts: list[tuple[str, str]], seed: int = SEED, steps: int = STEPS) -> Model | None:
    """Fit on (text, language) pairs; None where there is nothing to learn."""
    by: dict[str, list[bytes]] = {}
    for text, lang in texts:
        if text and LETTER.search(text):
            by.setdefault(lang, []).append(text.encode())
    if not by:
        return None
    langs, rng = sorted(by), np.random.default_rng(seed)
    streams = [np.frombuffer(b"\n".join(by[x]) + b"\n" * TRAIN_WINDOW, dtype=np.uint8) for x in langs]
    m = {
        "x": rng.normal(0, 0.3, (2, 256, 3 * HIDDEN)), "u": rng.normal(0, 0.3, (2, HIDDEN, 3 * HIDDEN)), "b": np.zeros((2, 3 * HIDDEN)),
        "o": rng.normal(0, 0.3, (2 * HIDDEN, len(langs))), "c": np.zeros(len(langs)),
    }
    m = {k: v.astype(np.float32) for k, v in m.items()}
    first, second = ({k: np.zeros_like(v) for k, v in m.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = rng.integers(0, len(langs), BATCH)
        at = [rng.integers(0, len(streams[k]) - TRAIN_WINDOW + 1) for k in y]
        codes = np.stack([streams[k][a : a + TRAIN_WINDOW] for k, a in zip(y, at)], axis=1)
        ends = np.where(rng.random(BATCH) < 0.5, rng.integers(3, TRAIN_WINDOW + 1, BATCH), TRAIN_WINDOW)
        inside = np.arange(TRAIN_WINDOW)[:, None] < ends  # half of the windows end early, as a text's last window does
        codes = np.where(inside, codes, 0)
        (sf, kf), (sb, kb) = _forward(m, 0, codes), _forward(m, 1, codes)
        s = np.concatenate([sf, sb], axis=2)
        logits = s @ m["o"] + m["c"]
        p = np.exp(logits - logits.max(axis=2, keepdims=True))
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(BATCH), y] -= 1
        p *= (inside / ends / BATCH)[..., None].astype(np.float32)
        grad = {k: np.zeros_like(v) for k, v in m.items()}
        grad["o"], grad["c"] = np.tensordot(s, p, axes=([0, 1], [0, 1])), p.sum(axis=(0, 1))
        into = p @ m["o"].T
        _backward(m, 0, codes, kf, into[..., :HIDDEN], grad)
        _backward(m, 1, codes, kb, into[..., HIDDEN:], grad)
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():  # Adam, clipped
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            m[k] -= (RATE * min(1, 2 - 2 * step / steps) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(langs, **m)


def _states(m: Model, d: int, codes: np.ndarray) -> np.ndarray:
    """States (T, H, B) of one direction over codes (T, B): windows are columns, so that gates are contiguous."""
    n, (steps, width) = HIDDEN, codes.shape
    x, u = np.ascontiguousarray((m.x[d] + m.b[d]).T), np.ascontiguousarray(m.u[d].T)
    x[: 2 * n] *= -1  # for 1 / (1 + exp(-a))
    u[: 2 * n] *= -1
    out, h = np.empty((steps, n, width), dtype=np.float32), np.zeros((n, width), dtype=np.float32)
    a, g, zr, c = (np.empty((k * n, width), dtype=np.float32) for k in (3, 3, 2, 1))
    for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
        np.take(x, codes[t], axis=1, out=a, mode="clip")
        np.dot(u, h, out=g)
        np.add(a[: 2 * n], g[: 2 * n], out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        np.multiply(zr[n:], g[2 * n :], out=c)
        c += a[2 * n :]
        np.tanh(c, out=c)
        h = np.subtract(h, c, out=out[t])
        h *= zr[:n]
        h += c
    return out


def position_probabilities(m: Model, codes: np.ndarray) -> np.ndarray:
    """(T, L, B) probabilities of each label at each position of codes (T, B)."""
    s = np.concatenate([_states(m, 0, codes), _states(m, 1, codes)], axis=1)
    logits = np.matmul(np.ascontiguousarray(m.o.T), s)
    logits += m.c[:, None]
    np.exp(logits, out=logits)
    logits /= logits.sum(axis=1, keepdims=True)
    return logits


def pooled(m: Model, texts: list[bytes]) -> np.ndarray:
    """Mean label probabilities over all positions of each (not empty) text."""
    sizes = np.array([len(t) for t in texts])
    windows = -(-sizes // WINDOW)
    data = np.frombuffer(b"".join(t.ljust(int(w) * WINDOW, b"\0") for t, w in zip(texts, windows)), dtype=np.uint8).reshape(-1, WINDOW)
    left = np.repeat(sizes, windows) - (np.arange(len(data)) - np.repeat(np.cumsum(windows) - windows, windows)) * WINDOW
    owner, total = np.repeat(np.arange(len(texts)), windows), np.zeros((len(texts), len(m.languages)))
    slab = max(1, SLAB * SLAB_LABELS // max(SLAB_LABELS, len(m.languages)))
    for at in range(0, len(data), slab):
        p = position_probabilities(m, np.ascontiguousarray(data[at : at + slab].T))
        p *= (np.arange(WINDOW)[:, None] < left[None, at : at + slab])[:, None]
        np.add.at(total, owner[at : at + slab], p.sum(axis=0).T)
    return total / sizes[:, None]


def labels(m: Model | None, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out = [(UNKNOWN, 0.0)] * len(texts)
    known = [k for k, t in enumerate(texts) if t and LETTER.search(t)] if m else []
    if known:
        p = pooled(m, [texts[k].encode() for k in known])
        for k, best, value in zip(known, p.argmax(axis=1), p.max(axis=1)):
            out[k] = m.languages[best], min(1.0, float(value))
    return out


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


def fit(docs: DataFrame) -> Model | None:
    """Train on the bounded sample of labelled rows."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL").filter(~held_out(F.col("doc_id")))
    counts = materialize(rows.groupBy("lang").count(), "labels")
    n = counts.count()
    if n > MAX_LABELS:
        raise ValueError(f"{n} labels are more than the {MAX_LABELS} that lang may have")
    drawn = F.xxhash64("doc_id", "text").bitwiseAND(F.lit((1 << 30) - 1))
    at = F.pmod(F.xxhash64("doc_id"), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int") + 1
    share = F.least(F.lit(1.0), 1.5 * SAMPLE_DOCS / F.col("count")) * (1 << 30)
    some = rows.join(F.broadcast(counts), "lang").withColumn("h", drawn).filter(F.col("h") < share)  # MAX_LABELS rows at most
    some = some.select("lang", "h", F.substring("text", at, F.lit(SAMPLE_CHARS)).alias("text")).distinct()
    first = Window.partitionBy("lang").orderBy("h", "text")
    got = some.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= SAMPLE_DOCS).collect()
    return train([(r["text"], r["lang"]) for r in sorted(got, key=lambda r: (r["lang"], r["rank"]))], steps=STEPS * max(1, -(-n // STEP_LABELS)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        pred, score = zip(*labels(model, b.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(list(pred)), pa.array(list(score))], ["doc_id", "lang_pred", "score"])

    got = arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, lang_pred string, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: every document's language."""
    docs = table(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


def keep_known(docs: DataFrame, model: Model | None, wanted: frozenset[str] | None = None, least: float = 0.0) -> DataFrame:
    """docs, all columns, whose predicted language is known, wanted (None: any) and has a score of `least` or more. Nothing is shuffled.

    A text without a letter is "und", which is not known unless it is a training label; without a model every row is.
    """
    names = docs.columns
    at = names.index("text")

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        found = labels(model, b.column(at).to_pylist())
        return b.filter(pa.array([bool(model and k != UNKNOWN and (wanted is None or k in wanted) and p >= least) for k, p in found], type=pa.bool_()))

    return arrow_map(docs, run, docs.schema)
