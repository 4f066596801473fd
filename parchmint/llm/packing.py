"""Operator 3, best-fit packing by minimum bin slack.

Documents become token pieces of at most `capacity`; the histogram of piece lengths, at most `capacity`
entries whatever the input's size, is all that the driver sees. It fills one bin at a time: the longest
piece left opens it, and a bitset subset-sum over the lengths left finds the fullest combination for the rest.
The combination is taken out as often as the histogram allows, so the plan has a few thousand rows at most
for any number of documents. Pieces are numbered within their length by salted counts and look up their bin.

Defined results: a null or empty text is the one token 0; repeated rows are packed like others; a null doc_id is kept.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm.bpe import default_tokenizer, encoder
from parchmint.llm.common import arrow_map, materialize, table

CAPACITY = 2048
ROWS_PER_SALT = 100_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first can be shorter than capacity."""
    r = n % capacity
    starts = ([0] if r else []) + list(range(r, n, capacity))
    return [(s, (r if r and s == 0 else capacity)) for s in starts]


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 0) -> DataFrame:
    """Pieces of each document's ids followed by end_id."""
    path = tokenizer or default_tokenizer()

    def pieces(b: pa.RecordBatch) -> pa.RecordBatch:
        rows, cols = [], [[], [], [], []]
        enc = encoder(path)
        for k, text in enumerate(b.column(1).to_pylist()):
            ids = np.append(enc.ids(text or ""), np.uint32(end_id)).astype("<u4")
            for i, (s, n) in enumerate(cut(len(ids), capacity)):
                rows.append(k)
                for c, x in zip(cols, (i, s, n, zlib.crc32(ids[s : s + n].tobytes()))):
                    c.append(x)
        out = [b.column(0).take(pa.array(rows)), *(pa.array(c, type=t) for c, t in zip(cols, (pa.int32(), *[pa.int64()] * 3)))]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), pieces, PIECES)


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """The lengths, each at most counts[l] times, whose sum is the largest that is at most room."""
    reach, layers, full = 1, [], (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left:  # binary splitting of the multiplicity
            take = min(step, left)
            layers.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, step = left - take, step * 2
        if reach >> room & 1:
            break
    at, chosen = reach.bit_length() - 1, []
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            chosen += [length] * take
            at -= length * take
    return chosen


def bin_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(lengths of a bin with their multiplicity, how many such bins), minimum slack first."""
    left, out = {k: v for k, v in histogram.items() if v}, []
    while left:
        top = max(left)
        left[top] -= 1
        pattern = Counter([top, *fullest({k: v for k, v in left.items() if v}, capacity - top)])
        left[top] += 1
        times = min(left[k] // m for k, m in pattern.items())
        for k, m in pattern.items():
            left[k] -= m * times
            if not left[k]:
                del left[k]
        out.append((dict(pattern), times))
    return out


def placements(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """Ranks of each length from which a bin pattern holds; sorted by (length, rank)."""
    rows, used, bins = [], Counter(), 0
    for pattern, times in patterns:
        offset = 0
        for length, m in sorted(pattern.items(), reverse=True):
            rows.append((length, used[length], m, bins, offset))
            used[length] += m * times
            offset += m * length
        bins += times
    rows.sort()
    return dict(zip(("length", "rank", "m", "bin", "offset"), np.array(rows, dtype=np.int64).reshape(-1, 5).T))


def numbered(pieces: DataFrame) -> DataFrame:
    """Adds rank: 0, 1, ... within each length. A hot length is spread over salts, whose counts give offsets."""
    n = pieces.count()
    salts = max(1, -(-n // ROWS_PER_SALT) * 8)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    per = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select("length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.withColumn("_rn", F.row_number().over(within)).join(per, ["length", "_salt"]).withColumn("rank", F.col("_before") + F.col("_rn") - 1)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (PIECES columns), which must be a stable table, as materialize gives."""
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    plan = placements(bin_patterns(histogram, capacity))
    key, names = plan["length"] << 44 | plan["rank"], pieces.columns

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (b.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank"))
        at = np.searchsorted(key, length << 44 | rank, side="right") - 1
        k = rank - plan["rank"][at]
        m = plan["m"][at]
        out = [b.column(i) for i in range(5)] + [pa.array(plan["bin"][at] + k // m), pa.array(plan["offset"][at] + k % m * length)]
        return pa.RecordBatch.from_arrays(out, [*names, "sequence_id", "offset"])

    ranked = numbered(pieces).select(*names, "rank")
    return ranked.mapInArrow(lambda bs: (place(b) for b in bs if b.num_rows), PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    return pack(materialize(token_pieces(docs, capacity, tokenizer), "pieces"), capacity)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: all documents in as few 2048-token sequences as the method finds."""
    return pack_documents(table(spark, sf_dir, "documents"))
