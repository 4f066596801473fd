"""Recognised words of a batch of lines at once: noise, flags, joined text and runs as numpy and Arrow kernels.

They take array<word> as it is and return what they find out about its words: text, marks, places and whole runs, never the
words themselves, so that fields they don't know stay with them. Words are told apart once a distinct text. All are marked as not
deterministic, which they are, so that the optimizer neither repeats them in a filter nor moves them into lambdas.
"""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.functions import arrow_text as A
from parchmint.functions import patterns as P

LOW_CONFIDENCE, NOISE_CONFIDENCE, SPECK_CONFIDENCE = 82, 32, 55
COMPACT, BASELINE, BESIDE = 0.68, 0.8, 0.2
BOX = pa.struct([(side, pa.float64()) for side in ("x0", "y0", "x1", "y1")])
PART = 1 << 20  # words that a kernel looks at at once


def _in_parts(kernel: Callable[[pa.Array], pa.Array]) -> Callable[[pa.Array], pa.Array]:
    """The kernel over one part of a batch after the other, whole lines each: a batch of long lines has many times the words of others."""

    @functools.wraps(kernel)
    def run(lists: pa.Array) -> pa.Array:
        ends = [*(np.flatnonzero(np.diff(np.cumsum(A.list_sizes(lists)) // PART)) + 1).tolist(), len(lists)]
        return kernel(lists) if len(ends) == 1 else pa.concat_arrays([kernel(lists.slice(a, b - a)) for a, b in zip([0, *ends], ends)])

    return run


def _field(items: pa.StructArray, name: str) -> pa.Array | None:
    """A field with the nulls of its structs; None where there is no such field."""
    at = items.type.get_field_index(name)
    return items.flatten()[at] if at >= 0 else None


def _doubles(values: pa.Array | None, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, whether they are there)."""
    if values is None:
        return np.zeros(n), np.zeros(n, dtype=bool)
    there = values.is_valid().to_numpy(zero_copy_only=False)
    return pc.fill_null(values.cast(pa.float64()), 0.0).to_numpy(zero_copy_only=False), there


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a < b, where NaN is above all numbers."""
    return (a < b) | (np.isnan(b) & ~np.isnan(a))


@dataclass
class Words:
    """Words with text, line by line. flagged is meaningless where known is false: a word without confidence may be null."""

    sizes: np.ndarray  # words of each line
    at: np.ndarray  # place in the line's own array
    row: np.ndarray  # place in the batch
    text: pa.Array
    confidence: np.ndarray
    sure: np.ndarray  # has a confidence
    removed: np.ndarray
    flagged: np.ndarray
    known: np.ndarray
    closer: np.ndarray
    opener: np.ndarray
    ends_open: np.ndarray  # the last character is an opening mark

    def kept(self) -> Words:
        own = ~self.removed
        line = np.repeat(np.arange(len(self.sizes)), self.sizes)[own]
        rest = [x[own] for x in (self.confidence, self.sure, self.removed, self.flagged, self.known, self.closer, self.opener, self.ends_open)]
        return Words(np.bincount(line, minlength=len(self.sizes)), self.at[own], self.row[own], self.text.filter(pa.array(own)), *rest)


def _typical(line: np.ndarray, tall: np.ndarray, several: np.ndarray, n: int) -> np.ndarray:
    """Each line's upper median of heights, those of words of several characters twice."""
    found = pa.array(tall).dictionary_encode()
    heights, rank = np.unique(found.dictionary.to_numpy(), return_inverse=True)
    code = rank[found.indices.to_numpy()] if len(tall) else np.zeros(0, dtype=np.int64)
    weight, cell = 1 + several.astype(np.int64), line * len(heights) + code
    if n * len(heights) <= 4 * len(tall):  # few heights: a cell for each of them in each line
        count = np.bincount(cell, weights=weight, minlength=n * len(heights)).astype(np.int64)
        cells = np.flatnonzero(count)
        count = count[cells]
    else:
        cells, cell = np.unique(cell, return_inverse=True)
        count = np.bincount(cell, weights=weight).astype(np.int64)
    of = cells // max(1, len(heights))
    total = np.bincount(of, weights=count, minlength=n).astype(np.int64)
    before = np.cumsum(count) - (np.cumsum(total) - total)[of]  # of the line, up to and with the cell
    hit = np.flatnonzero((before > total[of] // 2) & (before - count <= total[of] // 2))
    out = np.ones(n)
    out[of[hit]] = heights[cells[hit] % max(1, len(heights))]
    return out


def words_of(lists: pa.Array) -> Words:
    flat, sizes = lists.flatten(), A.list_sizes(lists)
    line = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(line)) - (np.cumsum(sizes) - sizes)[line]
    found = _field(flat, "text").dictionary_encode()
    fresh = A.normalize_tokens(found.dictionary)
    code = pc.fill_null(found.indices, -1).to_numpy(zero_copy_only=False)
    full = np.r_[pc.not_equal(fresh, "").to_numpy(zero_copy_only=False), False].astype(bool)
    own = np.flatnonzero(full[code])  # the last entry, false, is of null
    line, at, code = line[own], at[own], code[own]
    flat = flat.take(pa.array(own)) if len(own) < len(flat) else flat
    n, each = len(own), lambda flags: flags[code]
    confidence, sure = _doubles(_field(flat, "confidence"), n)
    box, base = _field(flat, "bbox"), _field(flat, "baseline")
    (x0, has_x0), (y0, has_y0), (x1, has_x1), (y1, has_y1) = (_doubles(_field(box, name), n) for name in ("x0", "y0", "x1", "y1"))
    low, has_low = _doubles(_field(base, "y1") if base is not None and pa.types.is_struct(base.type) else None, n)
    bottom = np.where(has_low, low, np.where(has_y1, y1, 0.0))
    with np.errstate(invalid="ignore"):
        tall = np.where(has_y0 & has_y1, np.maximum(1.0, y1 - y0), 1.0)
    length = pc.utf8_length(fresh).to_numpy(zero_copy_only=False)
    removed = np.zeros(n, dtype=bool)
    single, marked = length == 1, ~A.plain_tokens(fresh)
    glyph = A.matches_of(fresh, single, P.ONE_ALNUM) & ~A.matches_of(fresh, single, P.ONE_LETTER_WORD)
    with np.errstate(invalid="ignore"):
        typical = _typical(line, tall, each(length > 1), len(sizes))
        k = np.flatnonzero(each(glyph) & sure)
        k = k[(k > 0) & (k < n - 1)]
        k = k[(line[k - 1] == line[k]) & (line[k + 1] == line[k])]
        b, a, t = k - 1, k + 1, typical[line[k]]
        faint = (_less(confidence[k], SPECK_CONFIDENCE) & _less(tall[k], t * COMPACT)) | _less(confidence[k], NOISE_CONFIDENCE)
        inline = ~_less(t * BASELINE, np.abs(bottom[k] - bottom[b])) & ~_less(t * BASELINE, np.abs(bottom[k] - bottom[a]))
        beside = ~_less(x0[k], x1[b] - t * BESIDE) & ~_less(x0[a] + t * BESIDE, x1[k]) & has_x0[k] & has_x1[b] & has_x1[k] & has_x0[a]
        removed[k[faint & inline & beside]] = True
        doubtful = _less(confidence, np.float64(LOW_CONFIDENCE))
    plain = each(A.matches_of(fresh, marked, P.PUNCTUATION_ONLY)) | removed
    last = pc.utf8_slice_codeunits(fresh, -1)
    return Words(
        np.bincount(line, minlength=len(sizes)), at, own, fresh.take(pa.array(code)), confidence, sure, removed, sure & doubtful & ~plain, sure | plain,
        each(A.matches_of(fresh, marked, P.CLOSERS)), each(A.matches_of(fresh, marked, P.OPENERS)), each(A.matches_of(last, marked, P.OPENERS)),
    )


def _lists(sizes: np.ndarray, fields: dict[str, pa.Array]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(A.offsets(sizes)), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def _boxes(lists: pa.Array, rows: np.ndarray) -> pa.Array:
    """BOX of the batch's words in these places."""
    box = _field(lists.flatten(), "bbox")
    if box is None or not pa.types.is_struct(box.type):
        return pa.nulls(len(rows), BOX)
    box = box.take(pa.array(rows))
    sides = [pa.nulls(len(rows), f.type) if (x := _field(box, f.name)) is None else x.cast(f.type) for f in BOX]
    return pa.StructArray.from_arrays(sides, fields=list(BOX), mask=box.is_null())


def _firsts(sizes: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    return out


@_in_parts
def _marks(lists: pa.Array) -> pa.Array:
    w = words_of(lists)
    flagged = pa.array(w.flagged, mask=~w.known)
    return _lists(w.sizes, {"at": pa.array(w.at.astype(np.int32)), "text": w.text, "removed": pa.array(w.removed), "flagged": flagged})


@_in_parts
def _texts(lists: pa.Array) -> pa.Array:
    w = words_of(lists)
    k = w.kept()
    glued = _firsts(k.sizes, len(k.at)) | k.closer | np.r_[False, k.ends_open[:-1]][: len(k.at)]
    text = A.normalize_text(A.joined(A.spaced(k.text, glued), k.sizes), composed=True)
    return pa.StructArray.from_arrays([pa.array(w.sizes.astype(np.int32)), text], ["n_words", "text"])


@_in_parts
def _runs(lists: pa.Array) -> pa.Array:
    k = words_of(lists).kept()
    n, first = len(k.at), _firsts(k.sizes, len(k.at))
    start = (np.cumsum(k.sizes) - k.sizes)[np.repeat(np.arange(len(k.sizes)), k.sizes)]
    others = np.cumsum(~k.opener)  # words of the batch up to here that are more than opening marks
    before = np.r_[0, others[:-1]][:n]
    glued = first | k.closer | (before == before[start])
    begins = first | ((k.flagged != np.r_[False, k.flagged[:-1]][:n]) & k.known & np.r_[False, k.known[:-1]][:n])
    s = np.flatnonzero(begins)
    size = np.diff(np.r_[s, n])
    line = np.repeat(np.arange(len(k.sizes)), k.sizes)
    least, sure = (np.fmin.reduceat(np.where(k.sure, k.confidence, np.nan), s), np.logical_or.reduceat(k.sure, s)) if n else (np.zeros(0), np.zeros(0, dtype=bool))
    fields = {
        "text": A.joined(A.spaced(k.text, glued), size), "confidence": pa.array(least, mask=~sure, from_pandas=False),
        "flagged": pa.array(k.flagged[s], mask=~k.known[s]), "bbox": _boxes(lists, k.row[s]),
    }
    return _lists(np.bincount(line[s], minlength=len(k.sizes)), fields)


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: Of array<word> array<struct<at, text, removed, flagged>>: the words that have text once normalised.
marks = F.arrow_udf(_marks, T.ArrayType(_struct(at=T.IntegerType(), text=T.StringType(), removed=T.BooleanType(), flagged=T.BooleanType()))).asNondeterministic()
#: Of array<word> struct<n_words, text>: how many words have text, and the line's text without noise.
texts = F.arrow_udf(_texts, _struct(n_words=T.IntegerType(), text=T.StringType())).asNondeterministic()
#: Of array<word> array<RUN>: neighbours without noise that are alike flagged; a run's confidence is its lowest, its box that of its first word.
_BOX = _struct(**{side.name: T.DoubleType() for side in BOX})
runs = F.arrow_udf(_runs, T.ArrayType(_struct(text=T.StringType(), confidence=T.DoubleType(), flagged=T.BooleanType(), bbox=_BOX))).asNondeterministic()
