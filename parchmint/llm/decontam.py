"""Operator 9, benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Benchmark items are cut into word n-grams; those that a document shares are seeds. A seed is rare when no more documents
have it than RARE_FACTOR times the item's median seed (and no fewer than RARE_FLOOR): the measure is relative to the
item, so an item that leaked into a third of the corpus keeps its seeds while n-grams of everyday words go. The passages
around an item's seeds, an item's length on both sides, are aligned with it word by word unless they have too few of its
words for MIN_SCORE of its perfect score; a pair is reported when the best local alignment reaches that. Rarity decides
only where it is the sole evidence: without a rare seed more words must match than one n-gram has. (An item of which the
same part stands in many documents has many seeds that are found nowhere, so that none of those that are found is rare.)

Documents are read once; only seeds and passages leave that scan. The benchmark goes to every executor, so its size is
checked: up to ITEM_WORDS words at a time, in as many scans as it takes.

An alignment keeps one row of cells, so that its memory is the passage's, however long the item is.

Defined results: null texts and items with no word never match; items shorter than an n-gram are one shorter seed; repeated
rows and repeated items give one row each; documents with a null doc_id count as one document, which is reported; a null
item_id is kept; without documents or items there are no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.llm.common import materialize, session_of, sliced, table

SEED_WORDS, RARE_FACTOR, RARE_FLOOR = 3, 4, 8
MATCH, MISMATCH, GAP = 2, -1, -1
ONE_POINT = 1 << 30  # of a score, above the number of matching words
MIN_SCORE = 0.5
ITEM_WORDS = 500_000
PASSAGES = "doc_id long, item int, seeds array<int>, passage array<int>"
HITS = "doc_id long, item_id long, score double, n_aligned int, n_seeds int"


def words_of(text: str) -> list[str]:
    """Lower-cased words without the punctuation around them."""
    return [w for w in (x.strip(".,;:!?\"'()[]{}|*#%$&-") for x in text.lower().split()) if w]


class Items:
    """Word ids and seeds of the benchmark, as every worker holds them."""

    def __init__(self, texts: list[str], n: int = SEED_WORDS):
        self.n, self.vocabulary, self.words = n, {}, []
        for t in texts:
            self.words.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(t)], dtype=np.int64))
        owner, keys = [], []
        for i, w in enumerate(self.words):
            k = np.unique(self.keys(w))
            owner.append(np.full(len(k), i, dtype=np.int64))
            keys.append(k)
        owner, keys = (np.concatenate(x) if x else np.empty(0, dtype=np.int64) for x in (owner, keys))
        order = np.argsort(keys, kind="stable")
        self.seed_key, self.seed_item = keys[order], owner[order]  # seed s: the n-gram and one item that has it

    def keys(self, ids: np.ndarray) -> np.ndarray:
        """A number for each n-gram (the whole sequence, if shorter) of known words; 0 where a word is unknown."""
        n = min(self.n, len(ids))
        if not n:
            return np.empty(0, dtype=np.int64)
        grams = np.lib.stride_tricks.sliding_window_view(ids, n)
        out, radix = np.zeros(len(grams), dtype=np.int64), np.int64(len(self.vocabulary) + 1)
        for j in range(n):  # beyond 63 bits this wraps: n-grams may meet under one number, which costs an alignment
            out = out * radix + grams[:, j]
        return np.where((grams > 0).all(axis=1), np.where(out == 0, 1, out), 0)


def score(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Smith-Waterman: the best local alignment's score, and the most words that an alignment of that score matches.

    A cell holds both in one number, the score above, so that one row of cells is all the memory it takes.
    """
    if not len(item) or not len(passage):
        return 0, 0
    match, mismatch, gap = MATCH * ONE_POINT + 1, MISMATCH * ONE_POINT, GAP * ONE_POINT
    along = gap * np.arange(1, len(passage) + 1)
    row, best = np.zeros(len(passage) + 1, dtype=np.int64), 0
    for word in item:
        cells = np.maximum(row[:-1] + np.where(passage == word, match, mismatch), row[1:] + gap)
        cells = np.maximum.accumulate(np.maximum(cells, 0) - along) + along  # gaps along the passage
        cells[cells < ONE_POINT] = 0
        row[1:] = cells
        best = max(best, int(cells.max()))
    return best // ONE_POINT, best % ONE_POINT


def words_shared(item: np.ndarray, passage: np.ndarray) -> int:
    """The most words of the item that an alignment with the passage can match."""
    own, many = np.unique(item, return_counts=True)
    at = np.searchsorted(own, passage)
    at = at[own[np.minimum(at, len(own) - 1)] == passage]
    return int(np.minimum(np.bincount(at, minlength=len(own)), many).sum())


def passages(docs: DataFrame, items: Items) -> DataFrame:
    """For each document and item the passages around shared seeds, merged where they touch."""
    def of(text: str) -> Iterator[tuple[int, list[int], list[int]]]:
        get = items.vocabulary.get
        ids = np.array([get(w, 0) for w in words_of(text)], dtype=np.int64)
        starts, keys = [], []
        for n in sorted({min(items.n, len(w)) for w in items.words} - {0}):
            k = items.keys(ids) if n == items.n else Items.keys(_Shorter(items, n), ids)
            hit = np.flatnonzero(k)
            starts.append(hit)
            keys.append(k[hit])
        if not starts:
            return
        starts, keys = np.concatenate(starts), np.concatenate(keys)
        lo, hi = (np.searchsorted(items.seed_key, keys, side=s) for s in ("left", "right"))
        many = hi - lo
        seed = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at, owner = np.repeat(starts, many), items.seed_item[seed]
        order = np.lexsort((at, owner))
        seed, at, owner = seed[order], at[order], owner[order]
        for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(owner)) + 1) if len(at) else []:
            item = int(owner[run[0]])
            reach = len(items.words[item])
            for group in np.split(run, np.flatnonzero(np.diff(at[run]) > 2 * reach) + 1):
                a, b = max(0, at[group[0]] - reach), at[group[-1]] + reach + items.n
                yield item, np.unique(seed[group]).tolist(), ids[a:b].tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [(d, *p) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if t for p in of(t)]
            if rows:
                cols = list(zip(*rows))
                kinds = (pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(cols, kinds)], ["doc_id", "item", "seeds", "passage"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, PASSAGES)


class _Shorter:
    """The items' numbering for n-grams of another length."""

    def __init__(self, items: Items, n: int):
        self.n, self.vocabulary = n, items.vocabulary


def rare_seeds(items: Items, df: dict[int, int]) -> np.ndarray:
    """Which seeds are rare, given in how many documents each was found."""
    found, rare = np.zeros(len(items.seed_item), dtype=np.int64), np.zeros(len(items.seed_item), dtype=bool)
    for s, n in df.items():
        found[s] = n
    order = np.argsort(items.seed_item, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(items.seed_item[order])) + 1):
        if len(own):
            rare[own] = found[own] <= max(RARE_FLOOR, RARE_FACTOR * np.median(found[own]))
    return rare


def contaminated(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, n: int = SEED_WORDS) -> DataFrame:
    """(doc_id, item_id, score, n_aligned, n_seeds) of each document and item whose best alignment reaches min_score.

    score is the alignment's share of the item's perfect score, n_seeds counts the passage's rare seeds. docs: doc_id, text; benchmark: item_id, text.
    """
    spark = session_of(docs)
    rows = benchmark.selectExpr("cast(item_id as long) item_id", "text", "size(split(text, '\\\\s+')) n_words").filter("text IS NOT NULL")
    parts = max(1, -(-(rows.agg(F.sum("n_words")).first()[0] or 0) // ITEM_WORDS))
    out = None
    for part in range(parts):
        own = rows.filter(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).distinct().orderBy("item_id", "text").select("item_id", "text").collect()
        got = _one_part(docs, [r[0] for r in own], Items([r[1] for r in own], n), min_score)
        out = got if out is None else out.unionByName(got)
    return out if out is not None else spark.createDataFrame([], HITS)


def _one_part(docs: DataFrame, item_ids: list[int | None], items: Items, min_score: float) -> DataFrame:
    found = materialize(passages(docs, items), "passages")
    df = found.select("doc_id", F.explode("seeds").alias("s")).distinct().groupBy("s").agg(F.count("*").alias("n"))
    rare = rare_seeds(items, {r[0]: r[1] for r in df.collect()})  # one row a seed at most
    words, gram = items.words, items.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = []
            for d, i, seeds, p in zip(*(c.to_pylist() for c in b.columns)):
                p = np.array(p)
                if words_shared(words[i], p) / len(words[i]) < min_score:
                    continue
                n = int(rare[seeds].sum())
                best, matched = score(words[i], p)
                share = best / (MATCH * len(words[i]))
                if share >= min_score and (n or matched > gram):
                    rows.append((d, item_ids[i], share, matched, n))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), type=k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "score", "n_aligned", "n_seeds"])

    hits = found.repartition("doc_id", "item").mapInArrow(run, HITS)
    best = F.max(F.struct("score", "n_aligned", "n_seeds")).alias("b")
    return hits.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.score", "b.n_aligned", "b.n_seeds")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: all documents against the whole benchmark."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
