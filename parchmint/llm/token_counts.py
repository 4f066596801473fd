"""Operator 2, token counts by offset-mapped attribution.

Each document is encoded once, whole; its tokens' character spans are interval-joined to sections, which
tile the text; a token that crosses a boundary goes to one section by an explicit rule.

Rules: "first" (the section of its first character), "last" (of its last character), "most" (the section
with most of its characters, the earlier one on a tie).
Defined results: a null or empty text has one empty section with no token; repeated rows give repeated results;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from parchmint.llm.bpe import default_tokenizer, encoder
from parchmint.llm.common import arrow_map, table

RULES = ("first", "last", "most")
SCHEMA = "doc_id long, section int, section_start long, section_end long, n_tokens long, n_crossing long"


def line_bounds(text: str) -> np.ndarray:
    """Starts of a text's lines (a line break belongs to the line it ends) and, last, its length."""
    out, at = [0], text.find("\n")
    while at >= 0:
        if at + 1 < len(text):
            out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array([*out, len(text)], dtype=np.int64)


def attribute(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and boundary-crossing tokens of each section [bounds[i], bounds[i+1])."""
    n = len(bounds) - 1
    first = np.clip(np.searchsorted(bounds, start, side="right") - 1, 0, n - 1)
    last = np.clip(np.searchsorted(bounds, np.maximum(end - 1, start), side="right") - 1, 0, n - 1)
    to = last if rule == "last" else first.copy()
    crossing = np.flatnonzero(first != last)
    if rule == "most":
        for t in crossing:
            inner = np.arange(first[t], last[t] + 1)
            shared = np.minimum(end[t], bounds[inner + 1]) - np.maximum(start[t], bounds[inner])
            to[t] = inner[np.argmax(shared)]
    return np.bincount(to, minlength=n), np.bincount(to[crossing], minlength=n)


def section_token_counts(docs: DataFrame, rule: str = "first", tokenizer: str | None = None) -> DataFrame:
    """Tokens of each line of each document: one row per (row of docs, section)."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = tokenizer or default_tokenizer()

    def count(b: pa.RecordBatch) -> pa.RecordBatch:
        enc, cols = encoder(path), [[] for _ in range(5)]
        rows = []
        for k, text in enumerate(b.column(1).to_pylist()):
            bounds = line_bounds(text or "")
            tokens, crossing = attribute(*enc.spans(text or ""), bounds, rule)
            for c, x in zip(cols, (np.arange(len(tokens)), bounds[:-1], bounds[1:], tokens, crossing)):
                c.append(x)
            rows.append(np.full(len(tokens), k))
        at = np.concatenate(rows)
        kinds = (pa.int32(), *[pa.int64()] * 4)
        out = [b.column(0).take(pa.array(at)), *(pa.array(np.concatenate(c), type=t) for c, t in zip(cols, kinds))]
        return pa.RecordBatch.from_arrays(out, ["doc_id", "section", "section_start", "section_end", "n_tokens", "n_crossing"])

    return arrow_map(docs.selectExpr("cast(doc_id as long) doc_id", "text"), count, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: every line of every whole document, byte-level BPE, rule "first"."""
    return section_token_counts(table(spark, sf_dir, "documents"))
