"""Text functions over Arrow arrays: the patterns of `patterns` in RE2, for kernels that see a batch of strings at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from parchmint.functions import patterns as P
from parchmint.functions.arrays import normalized


def matches(values: pa.Array, pattern: str) -> np.ndarray:
    """Whether each string matches; null is false."""
    return pc.fill_null(pc.match_substring_regex(values, P.re2(pattern)), False).to_numpy(zero_copy_only=False)


def matches_of(values: pa.Array, where: np.ndarray, pattern: str) -> np.ndarray:
    """matches for the strings at `where`, false elsewhere."""
    out = np.zeros(len(values), dtype=bool)
    out[where] = matches(values.filter(pa.array(where)), pattern)
    return out


def replaced(values: pa.Array, pattern: str, by: str) -> pa.Array:
    return pc.replace_substring_regex(values, P.re2(pattern), by.replace("$", "\\"))


def normalize_token(values: pa.Array, composed: bool = False) -> pa.Array:
    """text.normalize_token of each string."""
    out = values if composed else normalized(values, "NFC")
    out = replaced(replaced(out, P.ZERO_WIDTH, ""), P.DASHES, "-")
    return pc.utf8_trim(replaced(out, r"\s+", " "), characters=" ")


def plain_tokens(values: pa.Array) -> np.ndarray:
    """Whether each string is of ASCII letters and digits alone, which neither normalisation changes nor a mark is in."""
    return pc.fill_null(pc.ascii_is_alnum(values), False).to_numpy(zero_copy_only=False)


def normalize_tokens(values: pa.Array) -> pa.Array:
    """normalize_token of strings of which most are plain."""
    odd = pa.array(~plain_tokens(values))
    return pc.replace_with_mask(values, odd, normalize_token(values.filter(odd)))


def normalize_text(values: pa.Array, composed: bool = False) -> pa.Array:
    """text.normalize_text of each string."""
    out = normalize_token(values, composed)
    for pattern, by in P.REPAIRS:
        out = replaced(out, pattern, by)
    return out


def list_sizes(lists: pa.Array) -> np.ndarray:
    """The length of each list, 0 for null."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)


def joined(pieces: pa.Array, sizes: np.ndarray) -> pa.Array:
    """The strings of runs of these sizes, put together."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets(sizes)), pieces), "")


def spaced(tokens: pa.Array, glued: np.ndarray) -> pa.Array:
    """Tokens with a space before those that are not glued to the one before."""
    return pc.binary_join_element_wise(pc.if_else(pa.array(glued), "", " "), tokens, "")


def _coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(codes, distinct values)."""
    found = values.dictionary_encode()
    return pc.fill_null(found.indices, 0).to_numpy(zero_copy_only=False), found.dictionary


def counts(texts: pa.Array) -> pa.Array:
    """Of normalised texts struct<tokens, noisy, joined, malformed>: what text.candidate_score counts."""
    none = texts.is_null().to_numpy(zero_copy_only=False)
    lists = pc.split_pattern(texts, " ")
    sizes, tokens = list_sizes(lists), lists.flatten()
    code, distinct = _coded(tokens)
    real = pc.not_equal(distinct, "").to_numpy(zero_copy_only=False)
    noisy = matches(distinct, P.BARS_ONLY) | matches(distinct, P.BROKEN_LETTERS) | (matches(distinct, P.ONE_ALNUM) & ~matches(distinct, P.ONE_LETTER_WORD))
    at = offsets(sizes)

    def total(flags: np.ndarray) -> pa.Array:
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(flags[code])])[at]).astype(np.int32), mask=none)

    found = [total(real), total(noisy), *[pc.cast(pc.count_substring_regex(texts, P.re2(p)), pa.int32()) for p in (P.JOINED_SENTENCE, P.MALFORMED)]]
    return pa.StructArray.from_arrays(found, ["tokens", "noisy", "joined", "malformed"])
