"""Operator 8, exact top-k inner products by block-at-a-time pruning.

Terms are vector components. Candidates are cut into ranges (blocks) with the largest and smallest value of each
term; per query the sum of q * max (or q * min where q < 0) bounds every score in a block. Blocks are visited in order of
their bounds and scored from their forward index, the block's own vectors, until no bound reaches the kth score.
The grid of (candidate cell, query block) bounds what one task holds, and the best k of each cell meet in a
window per query.

Defined results: vectors that are null or hold null or non-finite components take no part; shorter vectors count as padded
with zeros; repeated rows are separate candidates, and a query never meets a row with its own vec_id. Scores must
fit 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmint.llm.common import table

CELL_ROWS, QUERY_ROWS, BLOCK_ROWS = 16_384, 4_096, 256
K, SCALE, EVERY = 5, 256, 50


def quantized(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the floors of the scaled components, of the rows that take part."""
    x = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"))
    fine = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return x.filter("vec_id IS NOT NULL AND e IS NOT NULL").filter(fine).select("vec_id", F.transform("e", lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lists), width), dtype=np.int64)
    at = np.repeat(np.arange(len(lists)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def best_of_cell(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, block: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query index, candidate id, score) of each query's best k candidates, and how many (query, block) were scored."""
    order = np.argsort(c_ids, kind="stable")
    c_ids, c = c_ids[order], c[order]
    most = max(1, int(np.abs(q).max(initial=0))) * max(1, int(np.abs(c).max(initial=0))) * max(1, q.shape[1])
    kind = np.float64 if most < 1 << 53 else np.int64  # exact either way
    qf, cf = q.astype(kind), c.astype(kind)
    starts = np.arange(0, len(c), block)
    bound = np.maximum(qf, 0) @ np.maximum.reduceat(cf, starts).T + np.minimum(qf, 0) @ np.minimum.reduceat(cf, starts).T
    visit = np.argsort(-bound, axis=1, kind="stable")
    low = -np.inf if kind is np.float64 else np.iinfo(np.int64).min
    kth, full = np.full(len(q), low, dtype=kind), np.zeros(len(q), dtype=bool)
    best, scored, rows = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=kind)), 0, np.arange(len(q))
    for r in range(len(starts)):
        b = visit[:, r]
        active = np.flatnonzero(~full | (bound[rows, b] >= kth))
        if not len(active):
            break
        found = [best]
        by_block = active[np.argsort(b[active], kind="stable")]
        for group in np.split(by_block, np.flatnonzero(np.diff(b[by_block])) + 1):
            at = starts[b[group[0]]]
            score = qf[group] @ cf[at : at + block].T
            scored += len(group)
            keep = (~full[group, None] | (score >= kth[group, None])) & (c_ids[at : at + block] != q_ids[group, None])
            i, j = np.nonzero(keep)
            found.append((group[i], c_ids[at + j], score[i, j]))
        qi, ids, s = (np.concatenate(x) for x in zip(*found))
        o = np.lexsort((ids, -s, qi))
        qi, ids, s = qi[o], ids[o], s[o]
        first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]]) if len(qi) else np.empty(0, dtype=int)
        rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
        best = tuple(x[rank < k] for x in (qi, ids, s))
        last = rank == k - 1
        kth[qi[last]], full[qi[last]] = s[last], True
    return best[0], best[1], best[2].astype(np.int64), scored


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K, cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Best k candidates of each query (both as quantized() gives): query_id, rank, vec_id, score."""
    cells, blocks = (max(1, -(-df.count() // n)) for df, n in ((candidates, cell_rows), (queries, query_rows)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    c = candidates.select(F.pmod(F.xxhash64("vec_id"), F.lit(cells)).cast("int").alias("cell"), "vec_id", "v").select("*", spread(blocks).alias("block"))
    q = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v").select("*", spread(cells).alias("cell"))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], type=pa.int64())] * 3, names=names)
        width = max(max(t.column("v").combine_chunks().value_lengths().to_numpy().max() for t in (left, right)), 1)
        ids = [t.column("vec_id").to_numpy() for t in (left, right)]
        qi, cand, score, _ = best_of_cell(ids[0], matrix(left.column("v"), width), ids[1], matrix(right.column("v"), width), k)
        return pa.table([pa.array(ids[0][qi]), pa.array(cand), pa.array(score)], names=names)

    best = q.groupBy("cell", "block").cogroup(c.groupBy("cell", "block")).applyInArrow(cell, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: the queries are the rows whose vec_id is divisible by 50, the candidates all rows."""
    rows = quantized(table(spark, sf_dir, "embeddings"))
    return top_k(rows.filter(F.col("vec_id") % EVERY == 0), rows)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
