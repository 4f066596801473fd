"""Helpers for folds and lookups over array columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row: inside lambdas a plain expression would be computed for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def last(items: Column) -> Column:
    return F.get(items, F.size(items) - 1)


def runs_between(starts: Column, n: Column) -> Column:
    """array<struct<at, n>> of runs that begin at starts; the last one ends at n."""
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))
    return F.when(F.size(starts) > 0, F.zip_with(starts, ends, lambda at, end: F.struct(at.alias("at"), (end - at).alias("n")))).otherwise(empty("struct<at:int,n:int>"))


def runs_of(items: Column, runs: Column, body: Callable[[Column], Column]) -> Column:
    """body(items of the run) for each of runs, array<struct<at, n>> with places from 0."""
    return F.transform(runs, lambda r: body(F.slice(items, r["at"] + 1, r["n"])))


def sorted_by(items: Column, *keys: Callable[[Column], Column]) -> Column:
    """Stable sort by ascending keys: each key and at last the old place."""
    tagged = F.transform(items, lambda x, i: F.struct(*[k(x).alias(f"k{n}") for n, k in enumerate(keys)], i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda t: t["x"])


def box_union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def bounds(boxes: Column) -> Column:
    side = lambda name, pick: pick(F.transform(boxes, lambda b: b[name])).alias(name)
    return F.struct(side("x0", F.array_min), side("y0", F.array_min), side("x1", F.array_max), side("y1", F.array_max))


def normalized(values: pa.Array, form: str) -> pa.Array:
    """Unicode normalisation. Strings of ASCII, and those that are normal already, are passed on."""
    odd = pc.fill_null(pc.invert(pc.string_is_ascii(values)), False)
    found = values.filter(odd).to_pylist()
    fresh = [t if unicodedata.is_normalized(form, t) else unicodedata.normalize(form, t) for t in found]
    return values if fresh == found else pc.replace_with_mask(values, odd, pa.array(fresh, type=values.type))


@F.arrow_udf(T.ArrayType(T.StringType()))
def nfc_all(lists: pa.Array) -> pa.Array:
    """Canonical composition of the strings of a list column."""
    values = normalized(lists.flatten(), "NFC")
    return pa.ListArray.from_arrays(_offsets(lists), values, mask=lists.is_null()) if lists.null_count else pa.ListArray.from_arrays(_offsets(lists), values)


def _offsets(lists: pa.Array) -> pa.Array:
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_pylist()
    out = [0]
    for n in sizes:
        out.append(out[-1] + n)
    return pa.array(out, type=pa.int32())
