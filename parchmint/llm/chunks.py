"""Documents packed into compressed chunks, so that exchanges carry arrays of a chunk and not rows of a word or byte.

The table of chunks is bucketed by their ids, which are drawn so that a task's chunks lie in as few buckets as keep all
buckets filled: it writes one file or, where there are fewer tasks than buckets, its share of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmint.llm.common import materialize_by, sliced

CHUNK_BYTES = 4 << 20
SCHEMA = "chunk long, doc_ids array<long>, sizes array<long>, n_bytes long, data binary"


def bucket_numbers(ids: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark puts each long into: its 32-bit Murmur3 hash, seed 42, modulo buckets."""
    turned = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    u, h = ids.astype(np.uint64), np.full(len(ids), 42, dtype=np.uint32)
    for half in ((u & np.uint64(0xFFFFFFFF)).astype(np.uint32), (u >> np.uint64(32)).astype(np.uint32)):
        h ^= turned(half * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = turned(h, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ (h >> np.uint32(shift))) * np.uint32(by)
    return (h ^ (h >> np.uint32(16))).astype(np.int32).astype(np.int64) % buckets


def new_id(bucket: int, buckets: int) -> int:
    """A random long that Spark puts into this bucket."""
    while True:
        first = uuid.uuid4().int >> 66
        fits = np.flatnonzero(bucket_numbers(first + np.arange(4 * buckets), buckets) == bucket)
        if len(fits):
            return first + int(fits[0])


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A stable table of chunks of at least chunk_bytes, or what a task has; null texts are empty. docs: doc_id, text."""
    buckets, tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(1, docs.rdd.getNumPartitions())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, made = [], [], 0, 0
        task = TaskContext.get().partitionId()

        def chunk() -> pa.RecordBatch:
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(texts))
            own = new_id((task + tasks * (made % -(-buckets // tasks))) % buckets, buckets)
            cols = ([own], [ids], [[len(t) for t in texts]], [size], [data])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], ["chunk", "doc_ids", "sizes", "n_bytes", "data"])

        for b in sliced(batches):
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(d)
                texts.append((t or "").encode())
                size += len(texts[-1])
                if size >= chunk_bytes:
                    yield chunk()
                    ids, texts, size, made = [], [], 0, made + 1
        if ids:
            yield chunk()

    return materialize_by(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA), "chunks", "chunk")


def total_bytes(chunks: DataFrame) -> int:
    return chunks.agg(F.sum("n_bytes")).first()[0] or 0


def buckets_for(n_bytes: int, per_bucket: int = 16 << 20) -> int:
    """Number of hash buckets, in proportion to the text."""
    return max(12, -(-n_bytes // per_bucket))


class Chunk:
    """One chunk row, unpacked."""

    def __init__(self, row: dict):
        self.id, self.doc_ids, self.sizes = row["chunk"], row["doc_ids"], np.array(row["sizes"], dtype=np.int64)
        self.data = zstandard.ZstdDecompressor().decompress(row["data"]) if row["n_bytes"] else b""
        self.starts = np.cumsum(self.sizes) - self.sizes

    def texts(self) -> Iterator[bytes]:
        for a, n in zip(self.starts.tolist(), self.sizes.tolist()):
            yield self.data[a : a + n]


def per_chunk(fn, names: list[str], kinds: list[pa.DataType]):
    """For mapInArrow over chunk rows: fn(Chunk) yields rows, written as one batch a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                rows = list(fn(Chunk(b.slice(k, 1).to_pylist()[0])))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(zip(*rows), kinds)], names)

    return run
