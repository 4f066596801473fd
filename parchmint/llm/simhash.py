"""Operator 4, near-duplicates by SimHash with a byte-position inverted index and count filtering.

Fingerprints that differ in at most two bits agree in at least six of their eight bytes, so they also agree in two of
the four byte pairs. The index therefore has six postings a fingerprint, each a combination of four positional bytes.
Within a posting the shared positional bytes of each pair are tallied, pairs with fewer than six are dropped and the
rest verified by their differing bits. Only a spanning forest of a posting's verified pairs leaves the task. A posting
of more than SPLIT_ROWS fingerprints is indexed again by two of its other four bytes: those share six bytes, so that at
most 65536 distinct ones exist whatever the input's size. Equal fingerprints are merged before the index.

Defined results: a null or empty text has fingerprint zero, linked like any other; a null doc_id is kept as a row, and
component_id is the smallest doc_id that is not null; repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.common import arrow_map, joined_to_unique, materialize, table
from parchmint.llm.components import connected_components

BITS, BYTES, MAX_DIFFERENT, SEED = 64, 8, 2, 42
SPLIT_ROWS, DENSE_ROWS, ROWS_PER_PARTITION = 4096, 6, 500_000
HALVES = list(combinations(range(4), 2))  # pairs of the four byte pairs of a fingerprint


def shingle_hashes(text: str, words: int, seed: int = SEED) -> np.ndarray:
    """XXH64 of each shingle of the text, A-Z lower-cased, in order and with repeats."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    h = xxhash.xxh64_intdigest
    if not w:
        return np.empty(0, dtype="<u8")
    joined = b" ".join(w)
    if len(w) <= words:
        return np.array([h(joined, seed)], dtype="<u8")
    ends = np.cumsum([len(x) + 1 for x in w]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.array([h(joined[a:b], seed) for a, b in zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist())], dtype="<u8")


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The uint64 whose bits are set in over half the hashes."""
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # bounds memory for very long texts
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(shingle_hashes(t or "", words)) for t in b.column(1).to_pylist()], dtype="<u8")
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view("<i8"))], ["doc_id", "fp"])

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), run, "doc_id long, fp long")


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components, given links i-j."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if np.array_equal(new, label):
            return label
        label = new


def verified(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Which pairs share enough positional bytes and, verified, differ in at most `most` bits."""
    x = a ^ b
    ok = np.zeros(x.shape, dtype=bool)
    shared = (x[..., None].view(np.uint8) == 0).sum(axis=-1) >= BYTES - most
    ok[shared] = np.bitwise_count(x[shared]) <= most
    return ok


def forest(fps: np.ndarray, most: int = MAX_DIFFERENT) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, smallest fp of its component) among distinct fingerprints, by brute force in strips."""
    i, j, rows = [], [], max(1, (1 << 20) // len(fps))
    for s in range(0, len(fps), rows):
        strip = fps[s : s + rows]
        x, y = np.nonzero(np.triu(verified(strip[:, None], fps[None, s:], most), 1))
        i.append(x + s)
        j.append(y + s)
    label = _labels(len(fps), np.concatenate(i), np.concatenate(j))
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def posting_links(fps: np.ndarray, most: int = MAX_DIFFERENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links within one posting; a large one is split by two more of the byte pairs and then by two more bytes."""
    if len(fps) <= SPLIT_ROWS:
        yield forest(fps, most)
        return
    parts = fps[:, None].view("<u2")
    same = [p for p in range(4) if (parts[:, p] == parts[0, p]).all()]
    single = fps[:, None].view(np.uint8)
    loose = [p for p in range(BYTES) if p // 2 not in same]
    for keep in combinations(loose, max(0, len(loose) - most)):
        key = np.zeros(len(fps), dtype=np.uint64)
        for p in keep:
            key = key << np.uint64(8) | single[:, p]
        order = np.argsort(key, kind="stable")
        for run in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(run) > 1:
                yield forest(fps[run], most)


def links(fps: DataFrame, most: int = MAX_DIFFERENT) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct fingerprints (fp) at `most` bits or fewer."""
    if most > 2:
        raise ValueError("the index guarantees at most two differing bits")
    parts = [F.shiftrightunsigned("fp", 16 * p).bitwiseAND(F.lit(0xFFFF)) for p in range(4)]
    keys = [F.struct((F.lit(n).cast("long") * (1 << 32) + parts[x] * (1 << 16) + parts[y]).alias("key"), "fp") for n, (x, y) in enumerate(HALVES)]
    postings = fps.select(F.explode(F.array(*keys)).alias("k")).select("k.key", "k.fp")
    postings = postings.repartition(max(12, -(-fps.count() * 6 // ROWS_PER_PARTITION)), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        key, fp = (np.concatenate(x) for x in zip(*got))
        fp = fp.view("<u8")
        order = np.lexsort((fp, key))
        key, fp = key[order], fp[order]
        bounds = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        sizes = np.diff(bounds)
        out = []
        run_of = np.repeat(sizes, sizes)
        for d in range(1, DENSE_ROWS):  # short postings, all at once
            i = np.flatnonzero((key[:-d] == key[d:]) & (run_of[:-d] <= DENSE_ROWS))
            hit = i[verified(fp[i], fp[i + d], most)]
            out.append((fp[hit + d], fp[hit]))
        for s, n in zip(bounds[:-1][sizes > DENSE_ROWS], sizes[sizes > DENSE_ROWS]):
            out += posting_links(fp[s : s + n], most)
        for a, b in out:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view("<i8")), pa.array(b.view("<i8"))], ["a", "b"])

    return postings.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, most: int = MAX_DIFFERENT) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable over links of at most `most` differing bits."""
    fps = materialize(fingerprints(docs, words), "fingerprints")
    first = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("_n")), "distinct")
    labels = connected_components(links(first.select("fp"), most))
    rooted = first.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "_n", "first_id", F.coalesce("label", "fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = materialize(rooted.join(smallest, "root").select("fp", "_n", "component_id"), "classes")
    return joined_to_unique(fps, classes, "fp", fps.count(), ["doc_id"]).select("doc_id", "fp", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all documents, three-word shingles, links at two bits or fewer."""
    got = near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
