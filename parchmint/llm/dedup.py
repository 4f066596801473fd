"""Operator 1, exact substring dedup by merging shard Burrows-Wheeler transforms.

A byte goes when it is covered by a LENGTH-byte string that also starts in a document with a smaller doc_id.

A suffix array of the whole corpus fits no task, so the strings are first dealt to independent buckets: the anchor of
a string is the smallest hash among its GRAM-byte grams, and equal strings have equal anchors. Consecutive strings with
one anchor form a segment. Anchors of one document alone are told apart by a first exchange that carries 32 bits an
anchor. An anchor with more than HOT_PLACES places, such as the edge of a passage in a third of all documents, would
gather the different surroundings of all its places in one bucket; a second exchange tells its strings apart one by one,
over all buckets. (A chunk counts as one place, or as HOT_PLACES if it has as many.) Only strings that two documents can share go on, each distinct segment of a chunk once, with its
smallest doc_id, so that a passage in a third of all documents is a few entries a chunk.

In a bucket the distinct segments are cut into shards. Each shard's transform is built alone (rotations sorted to LENGTH
bytes). The merge keeps one shard number for each place: a round reads the transforms in the present interleave and
stably reorders it by what was read, which sorts it by one more symbol (two bytes). Neighbours begin alike in one symbol more
than before if they were read as the same symbol, and came from neighbours that began alike: so the rounds give the common
prefixes too. After LENGTH / 2 rounds the interleave is that of all suffixes, none of which was compared, and places that
still begin alike form the repeated intervals, whose smallest doc_id is the answer for all strings in them. An anchor with
one distinct segment is such an interval already.

Defined results: null and empty texts lose nothing; rows with equal doc_id do not remove each other's bytes; a null doc_id
is larger than any other; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.chunks import Chunk, buckets_for, chunked, per_chunk, total_bytes
from parchmint.llm.common import materialize, table

LENGTH, GRAM = 50, 24  # GRAM: a multiple of 8
SLAB = 1 << 20
BUCKET_BYTES = 8 << 20
SHARD_BYTES, MAX_SHARDS = 32_768, 250
HOT_PLACES = 64
LAST = np.iinfo(np.int64).max  # stands for a null doc_id
SEPARATOR = 0xFF  # UTF-8 never has it
KEYS = "kind int, bucket int, chunk long, keys binary"
ANCHOR, STRING = 0, 1
SEGMENTS = "kind int, bucket int, chunk long, first long, keys binary, sizes binary, data binary, docs binary"
PLACES, ITEMS, REPLIES = 0, 1, 2
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def packed(x: np.ndarray, kind: str) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.astype(kind).tobytes())


def unpacked(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype=kind)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hashes of all GRAM-byte grams."""
    words = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, 8)).view("<u8").ravel()
    n = len(data) - GRAM + 1
    h = np.zeros(n, dtype=np.uint64)
    for j in range(0, GRAM, 8):
        x = words[j : j + n]
        h += (x ^ (x >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15 + 2 * j * 0x1000193)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9FB21C651E98DF25)
    h ^= h >> np.uint64(29)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def segments(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, place in the chunk, number of strings, row) of the segments of all texts, in order."""
    data, out = np.frombuffer(chunk.data, dtype=np.uint8), []
    row = np.repeat(np.arange(len(chunk.sizes), dtype=np.int32), chunk.sizes)
    for a in range(0, len(data) - LENGTH + 1, SLAB):
        part = data[a : a + SLAB + LENGTH - 1]
        anchor = sliding_min(gram_hashes(part), LENGTH - GRAM + 1)
        first, last = row[a : a + len(anchor)], row[a + LENGTH - 1 : a + LENGTH - 1 + len(anchor)]
        inside = first == last
        begin = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1]) | (inside[1:] != inside[:-1])])
        size = np.diff(np.r_[begin, len(anchor)])
        begin, size = begin[inside[begin]], size[inside[begin]]
        out.append((anchor[begin], begin + a, size, first[begin]))
    if not out:
        return (np.empty(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int32))
    return tuple(np.concatenate(x) for x in zip(*out))


def ids_of(chunk: Chunk) -> np.ndarray:
    return np.array([LAST if d is None else d for d in chunk.doc_ids], dtype=np.int64)


def distinct_keys(keys: np.ndarray, rows: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys ordered by bucket and value, bucket of each, whether several rows have it, whether it has many places)."""
    order = np.lexsort((rows, keys))
    k, r = keys[order], rows[order]
    new = np.r_[True, k[1:] != k[:-1]] if len(k) else np.zeros(0, dtype=bool)
    several, many = np.zeros(new.sum(), dtype=bool), np.diff(np.r_[np.flatnonzero(new), len(k)]) >= HOT_PLACES
    if len(k):
        several[(np.cumsum(new) - 1)[1:][(~new[1:]) & (r[1:] != r[:-1])]] = True
    bucket = (k[new] >> np.uint64(32)) % np.uint64(buckets)
    o = np.argsort(bucket, kind="stable")
    return k[new][o], bucket[o], several[o], many[o]


def _cuts(bucket: np.ndarray) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of an ordered bucket column."""
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if len(bucket) else np.zeros(1, dtype=int)
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:])]


def _send(kind: int, chunk: Chunk, keys: np.ndarray, rows: np.ndarray, buckets: int) -> Iterator[tuple]:
    """30 bits of each distinct key, which tell a bucket's keys apart well enough, whether it has many places and several rows."""
    distinct, bucket, several, many = distinct_keys(keys, rows, buckets)
    key = (distinct.astype(np.uint32) & np.uint32(0xFFFFFFFC)) | many.astype(np.uint32) << np.uint32(1) | several.astype(np.uint32)
    for b, x, y in _cuts(bucket):
        yield kind, b, chunk.id, key[x:y].tobytes()


def _told(kind: int, keys: np.ndarray, rows: np.ndarray, buckets: int, replies: dict) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether two rows of the corpus have it, and whether it is hot."""
    distinct, bucket, _, _ = distinct_keys(keys, rows, buckets)
    bits = np.zeros((2, len(distinct)), dtype=bool)
    for b, x, y in _cuts(bucket):
        half = np.frombuffer(replies[kind, b], dtype=np.uint8).reshape(2, -1)
        bits[:, x:y] = np.unpackbits(half, axis=1, count=y - x)
    o = np.argsort(distinct)
    at = o[np.searchsorted(distinct[o], keys)]
    return bits[0][at], bits[1][at]


def send_anchors(chunk: Chunk, buckets: int) -> Iterator[tuple]:
    anchor, _, _, row = segments(chunk)
    yield from _send(ANCHOR, chunk, anchor, row, buckets)


def shared_keys(rows: pa.Table) -> pa.Table:
    """For each chunk's keys in a bucket a bit each for shared, and then a bit each for hot."""
    keys = [np.frombuffer(x, dtype="<u4") for x in rows.column("keys").to_pylist()]
    every = np.concatenate(keys)
    _, place, n = np.unique(every >> 2, return_inverse=True, return_counts=True)
    several = n > 1
    several[place[every & 1 == 1]] = True
    hot = n + np.bincount(place[every & 2 == 2], minlength=len(n)) * HOT_PLACES > HOT_PLACES
    ends = np.cumsum([len(k) for k in keys])[:-1]
    bits = [np.packbits(x).tobytes() + np.packbits(y).tobytes() for x, y in zip(np.split(several[place], ends), np.split(hot[place], ends))]
    return pa.table([rows.column("kind"), rows.column("bucket"), rows.column("chunk"), pa.array(bits, type=pa.binary())], names=["kind", "bucket", "chunk", "keys"])


def string_hashes(data: bytes, at: np.ndarray) -> np.ndarray:
    """64-bit hashes of the LENGTH-byte strings at these places."""
    words = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, dtype=np.uint8), 8)
    h = np.zeros(len(at), dtype=np.uint64)
    for j in (*range(0, LENGTH - 8, 8), LENGTH - 8):
        x = np.ascontiguousarray(words[at + j]).view("<u8").ravel()
        h = (h ^ x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h


def _strings(place: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all strings of segments."""
    return np.repeat(place - (np.cumsum(size) - size), size) + np.arange(size.sum())


def send_strings(chunk: Chunk, buckets: int, replies: dict) -> Iterator[tuple]:
    """The strings of hot anchors."""
    if not any(any(bits[len(bits) // 2 :]) for bits in replies.values()):
        return
    anchor, place, size, row = segments(chunk)
    _, hot = _told(ANCHOR, anchor, row, buckets, replies)
    at = _strings(place[hot], size[hot])
    yield from _send(STRING, chunk, string_hashes(chunk.data, at), np.repeat(row[hot], size[hot]), buckets)


def send_segments(chunk: Chunk, buckets: int, replies: dict) -> Iterator[tuple]:
    """The places of segments that are shared, for the chunk itself, and the distinct ones for their buckets."""
    anchor, place, size, row = segments(chunk)
    if not len(anchor):
        return
    shared, hot = _told(ANCHOR, anchor, row, buckets, replies)
    parts = [[x[shared & ~hot] for x in (anchor, place, size, row)]]
    if hot.any():  # what is left of a hot segment: its runs of shared strings
        at, owner = _strings(place[hot], size[hot]), np.repeat(np.flatnonzero(hot), size[hot])
        keep, _ = _told(STRING, string_hashes(chunk.data, at), row[owner], buckets, replies)
        at, owner = at[keep], owner[keep]
        if len(at):
            begin = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1)])
            parts.append([anchor[owner[begin]], at[begin], np.diff(np.r_[begin, len(at)]), row[owner[begin]]])
    anchor, place, size, row = (np.concatenate(x) for x in zip(*parts))
    if not len(anchor):
        return
    o = np.argsort((anchor >> np.uint64(32)) % np.uint64(buckets), kind="stable")
    anchor, place, size, row = anchor[o], place[o], size[o], row[o]
    item_of: dict[bytes, int] = {}
    data = chunk.data
    item = np.array([item_of.setdefault(data[a:b], len(item_of)) for a, b in zip(place.tolist(), (place + size + LENGTH - 1).tolist())], dtype=np.int64)
    texts = list(item_of)
    docs = np.full(len(texts), LAST)
    np.minimum.at(docs, item, ids_of(chunk)[row])
    _, at = np.unique(item, return_index=True)
    keys, lengths = anchor[at], np.array([len(t) for t in texts])
    o = np.argsort(place)
    yield PLACES, -1, chunk.id, 0, packed(np.diff(place[o], prepend=0), "<i8"), packed(item[o], "<i4"), None, None
    for b, x, y in _cuts((keys >> np.uint64(32)) % np.uint64(buckets)):
        blob = zstandard.ZstdCompressor(level=3).compress(b"".join(texts[x:y]))
        yield ITEMS, b, chunk.id, x, packed(keys[x:y], "<u4"), packed(lengths[x:y], "<i4"), blob, packed(docs[x:y], "<i8")


def sorted_rotations(text: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of a shard's rotations sorted to LENGTH bytes, the two bytes before each): its transform over byte pairs."""
    two = before[before]
    pair = text[two].astype(np.uint16) << 8 | text[before]
    at = np.arange(len(text), dtype=np.int32)
    for _ in range(LENGTH // 2):
        at = two[at[np.argsort(pair[at], kind="stable")]]
    return at, pair[at]


def merged(transforms: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The interleave of shards' transforms, as the place in their concatenation of each merged suffix, and where intervals begin.

    An interval is of suffixes that begin with the same LENGTH bytes.
    """
    symbols = np.concatenate(transforms)
    shard = np.repeat(np.arange(len(transforms), dtype=np.uint8), [len(t) for t in transforms])
    read, interval = np.empty_like(symbols), np.zeros(len(symbols), dtype=np.int32)
    for _ in range(LENGTH // 2):
        read[np.argsort(shard, kind="stable")] = symbols  # each shard's transform in its own order
        order = np.argsort(read, kind="stable")
        of, was = read[order], interval[order]
        shard = shard[order]
        begins = np.r_[True, (of[1:] != of[:-1]) | (was[1:] != was[:-1])]
        interval = np.cumsum(begins, dtype=np.int32)
    out = np.empty(len(symbols), dtype=np.int64)
    out[np.argsort(shard, kind="stable")] = np.arange(len(symbols))
    return out, begins


def least_docs(texts: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each of the distinct segments the smallest doc_id of each of its strings, over all segments."""
    sizes = np.array([len(t) for t in texts]) + 1
    starts = np.cumsum(sizes) - sizes
    text = np.frombuffer(bytes([SEPARATOR]).join(texts) + bytes([SEPARATOR]) + bytes(LENGTH), dtype=np.uint8)
    n = len(text) - LENGTH
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[starts] = starts + sizes - 1
    per_shard = max(SHARD_BYTES, -(-n // (MAX_SHARDS - 1)))
    first = np.flatnonzero(np.r_[True, np.diff(starts // per_shard) > 0])
    bounds = np.r_[starts[first], n]
    places, transforms = [], []
    for a, b in zip(bounds[:-1], bounds[1:]):
        at, pair = sorted_rotations(text[a:b], before[a:b] - np.int32(a))
        places.append(at + a)
        transforms.append(pair)
    order, begins = merged(transforms)
    order = np.concatenate(places)[order]
    owner = np.repeat(np.arange(len(texts)), sizes)
    strings = (np.arange(n) - starts[owner]) <= sizes[owner] - 1 - LENGTH
    interval = np.cumsum(begins)[strings[order]]  # suffixes that end before LENGTH bytes are in none
    order = order[strings[order]]
    begin = np.flatnonzero(np.diff(interval, prepend=-1))
    least = np.empty(n, dtype=np.int64)
    least[order] = np.repeat(np.minimum.reduceat(docs[owner[order]], begin), np.diff(np.r_[begin, len(order)]))
    return [least[a : a + s - LENGTH] for a, s in zip(starts.tolist(), sizes.tolist())]


def answer_bucket(rows: pa.Table) -> pa.Table:
    """For each chunk's segments of a bucket the smallest doc_ids of their strings, as runs."""
    item_of: dict[bytes, int] = {}
    of_chunk, docs, anchors = [], [], []
    for keys, sizes, blob, d in zip(*(rows.column(c).to_pylist() for c in ("keys", "sizes", "data", "docs"))):
        data, ends = zstandard.ZstdDecompressor().decompress(blob), np.cumsum(unpacked(sizes, "<i4"))
        of_chunk.append([item_of.setdefault(data[a:b], len(item_of)) for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())])
        docs.append(unpacked(d, "<i8"))
        anchors.append(unpacked(keys, "<u4"))
    item = np.concatenate([np.array(x, dtype=np.int64) for x in of_chunk])
    texts = list(item_of)
    least = np.full(len(texts), LAST)
    np.minimum.at(least, item, np.concatenate(docs))
    anchor = np.empty(len(texts), dtype=np.uint32)
    anchor[item] = np.concatenate(anchors)
    _, place, n = np.unique(anchor, return_inverse=True, return_counts=True)
    hard = np.flatnonzero(n[place] > 1)
    run_n, run_docs = [[len(t) - LENGTH + 1] for t in texts], [[x] for x in least.tolist()]
    if len(hard):
        for k, each in zip(hard.tolist(), least_docs([texts[k] for k in hard.tolist()], least[hard])):
            if (each != each[0]).any():
                at = np.flatnonzero(np.r_[True, each[1:] != each[:-1]])
                run_n[k], run_docs[k] = np.diff(np.r_[at, len(each)]).tolist(), each[at].tolist()
            else:
                run_docs[k] = [int(each[0])]
    out = [[], [], []]
    for own in of_chunk:
        for column, values, kind in zip(out, ([len(run_n[k]) for k in own], [x for k in own for x in run_n[k]], [x for k in own for x in run_docs[k]]), ("<u4", "<u4", "<i8")):
            column.append(packed(np.array(values, dtype=kind), kind))
    m = rows.num_rows
    cols = [pa.array([REPLIES] * m, type=pa.int32()), rows.column("bucket"), rows.column("chunk"), rows.column("first"), pa.array(out[0], type=pa.binary()), pa.array(out[1], type=pa.binary()), pa.array(out[2], type=pa.binary()), pa.array([None] * m, type=pa.binary())]
    return pa.table(cols, names=[x.split()[0] for x in SEGMENTS.split(", ")])


def removed(chunk: Chunk, rows: list[dict]) -> np.ndarray:
    """Which bytes of a chunk go, given its places and the replies."""
    step = np.zeros(len(chunk.data) + 1, dtype=np.int32)
    places = [r for r in rows if r["kind"] == PLACES]
    if places:
        place, item = np.cumsum(unpacked(places[0]["keys"], "<i8")), unpacked(places[0]["sizes"], "<i4")
        replies = sorted((r for r in rows if r["kind"] == REPLIES), key=lambda r: r["first"])
        n_runs, n, doc = (np.concatenate([unpacked(r[c], t) for r in replies]).astype(np.int64) for c, t in (("keys", "<u4"), ("sizes", "<u4"), ("data", "<i8")))
        first_run = np.cumsum(n_runs) - n_runs
        total = np.cumsum(n) - n
        offset = total - np.repeat(total[first_run], n_runs)  # of each run in its segment
        many = n_runs[item]
        run = np.repeat(first_run[item], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = np.repeat(place, many) + offset[run]
        row = np.searchsorted(chunk.starts + chunk.sizes, at, side="right")
        gone = doc[run] < ids_of(chunk)[row]
        np.add.at(step, at[gone], 1)
        np.add.at(step, at[gone] + n[run][gone] + LENGTH - 1, -1)
    return np.cumsum(step[:-1]) > 0


def kept(chunk: Chunk, rows: list[dict]) -> Iterator[tuple]:
    """Rows of RESULT of a chunk's documents."""
    gone = removed(chunk, rows)
    begins = gone & ~np.r_[False, gone[:-1]]
    inner = chunk.starts[chunk.sizes > 0]
    begins[inner] = gone[inner]  # a run ends with its document
    count = lambda x: np.diff(np.r_[0, np.cumsum(x)][np.r_[chunk.starts, len(x)]])
    n_removed, n_spans = count(gone), count(begins)
    rest = np.frombuffer(chunk.data, dtype=np.uint8)[~gone].tobytes() if gone.any() else chunk.data
    at = 0
    for d, n, r, s in zip(chunk.doc_ids, chunk.sizes.tolist(), n_removed.tolist(), n_spans.tolist()):
        yield d, n, r, s, hashlib.sha256(rest[at : at + n - r]).hexdigest()
        at += n - r


def _columns(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table([pa.array(list(c), type=kinds[k]) for c, (_, k) in zip(zip(*rows) if rows else [[]] * len(fields), fields)], names=[n for n, _ in fields])


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """Columns RESULT, one row for each row of docs (doc_id, text)."""
    chunks = chunked(docs)
    buckets = buckets_for(total_bytes(chunks), BUCKET_BYTES)
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]

    def exchanged(sent: DataFrame, name: str) -> DataFrame:
        return materialize(sent.groupBy("kind", "bucket").applyInArrow(shared_keys, KEYS), name)

    def answered(fn, schema: str):
        """fn(Chunk, buckets, {(kind, bucket): bits}) of each chunk and the replies to it."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            replies = {(k, b): x for k, b, x in zip(*(right.column(c).to_pylist() for c in ("kind", "bucket", "keys")))}
            return _columns([x for row in left.to_pylist() for x in fn(Chunk(row), buckets, replies)], schema)

        return run

    anchors = exchanged(chunks.mapInArrow(per_chunk(lambda c: send_anchors(c, buckets), ["kind", "bucket", "chunk", "keys"], kinds), KEYS), "anchors")
    by_chunk = chunks.groupBy("chunk")
    strings = exchanged(by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(answered(send_strings, KEYS), KEYS), "strings")
    told = anchors.unionByName(strings).groupBy("chunk")
    parts = materialize(by_chunk.cogroup(told).applyInArrow(answered(send_segments, SEGMENTS), SEGMENTS), "segments", "uncompressed")
    replies = parts.filter(F.col("kind") == ITEMS).groupBy("bucket").applyInArrow(answer_bucket, SEGMENTS)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = right.select(["kind", "first", "keys", "sizes", "data"]).to_pylist()
        return _columns([x for row in left.to_pylist() for x in kept(Chunk(row), rows)], RESULT)

    answers = parts.filter(F.col("kind") == PLACES).unionByName(replies)
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every whole document's bytes."""
    return dedup_substrings(table(spark, sf_dir, "documents"))
