"""Operator 4 at a similarity: near-duplicates by a wide SimHash, the same positional bytes, index, tally and verification.

Documents whose five-word shingles are similar to 0.8 (Jaccard) differ in 15 % of SimHash bits, up to 16 of 64, so that
no positional byte of eight is sure to agree and a short fingerprint can't separate them from others. Here the fingerprint
has BYTES positional bytes (512 bits) over the set of shingles; the index has KEYS combinations of three of them, of which
a pair at 0.8 shares one with a probability of 96 % and a pair at 0.85 with 99.5 %. Within a posting the shared positional
bytes of each pair are tallied; pairs with fewer than a combination has (met by a collision of posting numbers alone) are
dropped, the rest verified by their differing bits. Pairs of a posting that differ in at
most MAX_DIFFERENT bits (0.8 means 78, with a standard deviation of 8) are near. Only a spanning forest of a posting's near
pairs leaves the task, however large the posting is; the nearest come first. Each of these pairs is compared shingle by
shingle, and only similar ones are links. Where a refused pair leaves two parts unconnected, all near pairs between such
parts are compared in a second pass, so that the groups are those of all near pairs that are similar. Documents with the
same set of shingles are one node. A family of documents that are near and not similar costs the square of its size there.

Defined results: documents without a word are equal to each other; a null doc_id has no say over others and is kept only if
no other document of its group has an id; extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import arrow_map, joined_to_unique, materialize, sliced, unused
from parchmint.llm.components import connected_components
from parchmint.llm.simhash import _labels, shingle_hashes

SHINGLE_WORDS = 5
BYTES, KEYS, KEY_BYTES = 64, 240, 3
SIMILARITY = 0.8
MAX_DIFFERENT, SURE_DIFFERENT = 92, 70  # of 512 bits
POSTINGS_PER_BUCKET = 1_000_000
STRIP = 1 << 19


def _positions(n: int, seed: int) -> np.ndarray:
    """n combinations of KEY_BYTES positions in which each position occurs equally often."""
    rng = np.random.default_rng(seed)
    rounds = -(-n * KEY_BYTES // BYTES) + 1
    flat = np.concatenate([rng.permutation(BYTES)[: BYTES - BYTES % KEY_BYTES] for _ in range(rounds)])
    return flat[: n * KEY_BYTES].reshape(n, KEY_BYTES)


INDEX = _positions(KEYS, 1)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """BYTES bytes: the majority of each bit over numbers derived from the hashes."""
    ones = np.zeros(BYTES * 8, dtype=np.int64)
    salts = np.arange(1, BYTES // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(0, len(hashes), 4096):
        x = hashes[i : i + 4096, None] ^ salts
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        ones += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
    return np.packbits(ones * 2 > len(hashes), bitorder="little")


def shingle_set(text: str | None, words: int) -> np.ndarray:
    return np.unique(shingle_hashes(text or "", words))


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id, fp (BYTES bytes) and node, a hash, both of the set of shingles, and th, a hash of the text."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, words) for t in b.column(1).to_pylist()]
        fps = pa.array([wide_fingerprint(x).tobytes() for x in sets], type=pa.binary())
        nodes = np.array([xxhash.xxh64_intdigest(x.tobytes()) for x in sets], dtype="<u8").view("<i8")
        return pa.RecordBatch.from_arrays([b.column(0), fps, b.column(2), pa.array(nodes)], ["doc_id", "fp", "th", "node"])

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text", "xxhash64(text) th"), run, "doc_id long, fp binary, th long, node long")


def keys_of(fps: np.ndarray, positions: np.ndarray) -> np.ndarray:
    """(rows, combinations) numbers of the combinations' bytes, each combination's apart."""
    out = np.broadcast_to(np.arange(len(positions), dtype=np.int64), (len(fps), len(positions))).copy()
    for j in range(positions.shape[1]):
        out = out << 8 | fps[:, positions[:, j]]
    return out


def posting_keys(fps: np.ndarray, buckets: int, positions: np.ndarray = INDEX) -> np.ndarray:
    """(rows, combinations) postings of the index: 32 bits of a hash of the combination, over 24 bits of its bucket."""
    mixed = keys_of(fps, positions).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(33)) % np.uint64(buckets)
    return ((mixed & np.uint64(0xFFFFFFFF)) << np.uint64(24) | bucket).view(np.int64)


def owned(key: np.ndarray, x: np.ndarray, y: np.ndarray, buckets: int, positions: np.ndarray = INDEX) -> np.ndarray:
    """Which pairs of fingerprints x, y, found in the postings key, share no posting of a smaller key."""
    out = np.empty(len(key), dtype=bool)
    for s in range(0, len(key), 1024):
        a, b = (posting_keys(fps[s : s + 1024], buckets, positions) for fps in (x, y))
        out[s : s + 1024] = np.where(a == b, a, np.iinfo(np.int64).max).min(axis=1) >= key[s : s + 1024]
    return out


def shared_bytes(differ: np.ndarray) -> np.ndarray:
    """How many of the positional bytes are equal, of exclusive ors (..., words) of fingerprints."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return np.bitwise_count(~(((differ & low) + low) | differ | low)).sum(axis=-1, dtype=np.uint16)


def verified(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of fingerprints (as words) share enough positional bytes and, verified, differ in at most `most` bits; in how many.

    The tally is made of all pairs that a cheaper count of bits leaves, which are the same ones in either order.
    """
    differ = x ^ y
    bits = np.bitwise_count(differ).sum(axis=-1, dtype=np.uint16)
    ok = bits <= most
    ok[ok] = shared_bytes(differ[ok]) >= KEY_BYTES
    return ok, bits


def near_pairs(fps: np.ndarray, part: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All places i, j of different parts whose fps share KEY_BYTES positional bytes and differ in at most `most` bits, each pair once, and in how many; a strip at a time.

    What part says may change from strip to strip. Rows of one part are compared with the other parts alone.
    """
    order, wide = np.argsort(part, kind="stable"), fps.view(np.uint64)
    rank = np.argsort(order)
    rows = max(1, STRIP // len(fps) // 8)
    for s in range(0, len(fps), rows):
        own, other = order[s : s + rows], order[s + 1 :]
        if (part[own] == part[own[0]]).all():
            other = other[part[other] != part[own[0]]]
        for at in range(0, len(other), STRIP):
            to = other[at : at + STRIP]
            near, differ = verified(wide[own, None], wide[None, to], most)
            x, y = np.nonzero(near & (part[own, None] != part[None, to]) & (rank[own, None] < rank[None, to]))
            if len(x):
                yield own[x], to[y], differ[x, y]


def forest(fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of places, all within MAX_DIFFERENT bits, that connect what all such pairs of fps connect; nearer ones first."""
    label = np.arange(len(fps))
    for most in (SURE_DIFFERENT, MAX_DIFFERENT):
        for i, j, differ in near_pairs(fps, label, most):
            order = np.argsort(differ, kind="stable")
            i, j = i[order], j[order]
            while len(i):
                a, b, best = label[i], label[j], np.full(len(fps), len(i))
                for side in (a, b):
                    np.minimum.at(best, side, np.arange(len(i)))
                pick = np.unique(best[best < len(i)])  # the nearest pair of each part: no circle, as no two rank alike
                yield i[pick], j[pick]
                label[:] = _labels(len(fps), a[pick], b[pick])[label]
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]


def posting_pairs(nodes: np.ndarray, fps: np.ndarray, parts: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of nodes of one posting, however large: a forest, or all that are near and in different parts."""
    found = forest(fps) if parts is None else ((i, j) for i, j, _ in near_pairs(fps, parts, MAX_DIFFERENT))
    yield from ((nodes[i], nodes[j]) for i, j in found)


def similar_pairs(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b), and whether their texts (node, text) have a Jaccard similarity of the sets of shingles of SIMILARITY or more."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        similar, sets = [], {}
        for m, n, x, y in zip(*(c.to_pylist() for c in b.columns)):
            p, q = (sets[k] if k in sets else sets.setdefault(k, shingle_set(t, words)) for k, t in ((m, x), (n, y)))
            both = len(np.intersect1d(p, q, assume_unique=True))
            similar.append(both >= SIMILARITY * (len(p) + len(q) - both))
        return pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(similar, type=pa.bool_())], ["a", "b", "similar"])

    full = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
    return arrow_map(full.select("a", "b", "x", "y"), run, "a long, b long, similar boolean")


def near(classes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b), a < b, of nodes of classes (node long, fp binary) that share a posting and are near.

    They connect what all such pairs connect. With a column part (long): all such pairs of different parts. A pair leaves
    the posting of the smallest key alone: in others it is found again there, or what connects its ends there connects them.
    """
    n = classes.count()
    buckets = max(12, -(-n * KEYS // POSTINGS_PER_BUCKET))

    def matrix(column: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(column), dtype=np.uint8).reshape(-1, BYTES)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, 4096):
            if b.num_rows:
                mixed = posting_keys(matrix(b.column(1).to_pylist()), buckets, INDEX).ravel()
                nodes, keys, to = np.repeat(b.column(0).to_numpy(), KEYS), (mixed >> 24).astype("<u4"), mixed & 0xFFFFFF
                order = np.argsort(to, kind="stable")
                cut = np.flatnonzero(np.diff(to[order])) + 1
                rows = [(int(to[r[0]]), keys[r].tobytes(), nodes[r].tobytes()) for r in np.split(order, cut)]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["bucket", "keys", "nodes"])

    def shared(rows: pa.Table) -> pa.Table:
        keys, nodes = (np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=t) for c, t in (("keys", "<u4"), ("nodes", "<i8")))
        keys = keys.astype(np.int64) << 24 | rows.column("bucket")[0].as_py()  # 32 bits tell a bucket's postings apart well enough
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        again = np.r_[False, k[1:] == k[:-1]] if len(k) else np.zeros(0, dtype=bool)
        several = order[again | np.r_[again[1:], False]] if len(k) else order
        return pa.table([pa.array(keys[several]), pa.array(nodes[several])], names=["key", "node"])

    known = "part" in classes.columns

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2).to_pylist()), b.column(3).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        key, node, fps, part = (np.concatenate(x) for x in zip(*got))
        order = np.argsort(key, kind="stable")
        bounds = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0, True])
        size = np.diff(bounds)
        x, y = (order[bounds[:-1][size == 2] + k] for k in (0, 1))  # postings of two, all at once
        ok = verified(fps.view(np.uint64)[x], fps.view(np.uint64)[y], MAX_DIFFERENT)[0]
        ok &= (node[x] != node[y]) & (part[x] != part[y])
        x, y = x[ok], y[ok]
        ok = owned(key[x], fps[x], fps[y], buckets, INDEX)
        found = [(node[x[ok]], node[y[ok]])]
        for k in np.flatnonzero(size > 2):
            run = order[bounds[k] : bounds[k + 1]]
            for x, y in posting_pairs(run, fps[run], part[run] if known else None):
                ok = owned(key[x], fps[x], fps[y], buckets, INDEX)
                found.append((node[x[ok]], node[y[ok]]))
                if sum(len(p[0]) for p in found[-64:]) > STRIP or len(found) > 4096:
                    yield edges(found)
                    found = []
        if found:
            yield edges(found)

    def edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a, b = (np.concatenate(x) for x in zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    postings = classes.select("node", "fp").mapInArrow(index, "bucket int, keys binary, nodes binary")
    several = postings.groupBy("bucket").applyInArrow(shared, "key long, node long")
    full = several.join(classes, "node").select("key", "node", "fp", F.col("part" if known else "node")).repartition(buckets, "key")
    return full.mapInArrow(verify, "a long, b long").filter("a != b").distinct()


def components(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and component_id, the smallest doc_id reachable over similar documents, for each row of docs."""
    fps = materialize(fingerprints(docs, words), "wide")
    one = fps.groupBy("node").agg(F.min("fp").alias("fp"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "th")).alias("o"), F.count("*").alias("_n"))
    classes = materialize(one, "classes")
    of = docs.select(F.col("doc_id").cast("long").alias("_d"), "text")
    its = of["_d"].eqNullSafe(F.col("o.doc_id")) & (F.xxhash64("text") == F.col("o.th"))

    def judged(pairs: DataFrame) -> DataFrame:
        asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(classes, "node").select("node", "o")
        texts = materialize(of.join(asked, its).select("node", "text").dropDuplicates(["node"]), "texts")
        return materialize(similar_pairs(pairs, texts, words), "judged")

    first = judged(materialize(near(classes.select("node", "fp")), "near"))
    edges = first.filter("similar").select("a", "b")
    labels = connected_components(edges)
    part = classes.join(labels, "node", "left").select("node", "fp", F.coalesce("label", "node").alias("part"))
    of_a, of_b = (part.select(F.col("node").alias(x), F.col("part").alias(f"part_{x}")) for x in "ab")
    refused = first.filter("NOT similar").join(of_a, "a").join(of_b, "b").filter("part_a != part_b")
    torn = materialize(refused.select(F.col("part_a").alias("part")).union(refused.select("part_b")).distinct(), "torn")
    if torn.limit(1).count():  # a forest has one way between its parts, and these had no other
        rest = near(materialize(part.join(torn, "part").select("node", "fp", "part"), "rest"))
        second = judged(materialize(rest.join(first.select("a", "b"), ["a", "b"], "left_anti"), "near"))
        edges = edges.unionByName(second.filter("similar").select("a", "b"))
        labels = connected_components(edges)
    rooted = classes.select("node", "_n", "first_id").join(labels, "node", "left").select("node", "_n", "first_id", F.coalesce("label", "node").alias("root"))
    rooted = materialize(rooted, "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_node = rooted.join(smallest, "root").select("node", "_n", "component_id")
    return joined_to_unique(fps.select("doc_id", "node", "th"), of_node, "node", fps.count(), ["doc_id", "th"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """docs without all but one document of each group of similar ones, the smallest doc_id."""
    names = docs.columns
    own, kept_id, again_id = unused("ord", names), unused("kept", names), unused("again", names)
    docs = docs.withColumn(own, F.xxhash64("doc_id", "text"))
    groups = materialize(components(docs, words), "groups")
    kept = groups.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).distinct().select(F.col("doc_id").alias(kept_id))
    out = docs.join(kept, docs["doc_id"].eqNullSafe(F.col(kept_id)), "left_semi")
    again = groups.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(again_id))
    if again.limit(1).count():  # repeated rows of a document that stays
        repeated = docs["doc_id"].eqNullSafe(F.col(again_id))
        out = out.join(again, repeated, "left_anti").unionByName(out.join(again, repeated, "left_semi").dropDuplicates(["doc_id", own]))
    return out.select(names)
