"""Text functions, Column to Column. All are native but Unicode normalisation, one Arrow function."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmint.functions import arrow_text
from parchmint.functions import patterns as P
from parchmint.functions.arrays import let, normalized
from parchmint.functions.patterns import java

NAME_CHARS, TEXT_CHARS = 160, 2_000_000
NO_NAME = "Tài liệu không tên"  # fixed value: shown for a name with nothing visible


@F.arrow_udf(T.StringType())
def nfc(text: pa.Array) -> pa.Array:
    """Canonical composition."""
    return normalized(text, "NFC")


@F.arrow_udf(T.StringType())
def nfd(text: pa.Array) -> pa.Array:
    """Canonical decomposition."""
    return normalized(text, "NFD")


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))


def replaced(text: Column, pattern: str, by: str) -> Column:
    return F.regexp_replace(text, F.lit(java(pattern)), F.lit(by))


def trim(text: Column) -> Column:
    return replaced(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Runs of spaces as one U+0020, none at the ends."""
    return F.trim(F.regexp_replace(text, F.lit(P.UNEVEN), F.lit(" ")))


def normalize_token(text: Column, composed: bool = False) -> Column:
    """Composed, without zero-width characters, one kind of dash, single spaces. composed: the text is NFC already."""
    text = text if composed else nfc(text)
    return collapse(replaced(replaced(text, P.ZERO_WIDTH, ""), P.DASHES, "-"))


def normalize_text(text: Column, composed: bool = False) -> Column:
    """normalize_token and the table of repairs in its order."""
    out = normalize_token(text, composed)
    for pattern, by in P.REPAIRS:
        out = F.regexp_replace(out, F.lit(java(pattern, collapsed=True)), F.lit(by))
    return out


def _measured(text: pa.Array, composed: pa.Array) -> pa.Array:
    fresh = arrow_text.normalize_text(text, composed[0].as_py() if len(composed) else True)
    return pa.StructArray.from_arrays([fresh, *arrow_text.counts(fresh).flatten()], ["text", "tokens", "noisy", "joined", "malformed"])


_COUNTS = ("tokens", "noisy", "joined", "malformed")
_measured_text = F.arrow_udf(_measured, T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.IntegerType()) for n in _COUNTS]])).asNondeterministic()


def measured_text(text: Column, composed: bool = False) -> Column:
    """struct<text, tokens, noisy, joined, malformed>: normalize_text and what score_of counts, for a batch of texts at once."""
    return _measured_text(text, F.lit(composed))


def score_of(measured: Column, confidence: Column) -> Column:
    """candidate_score of a measured_text."""
    m = measured
    return confidence + F.least(F.lit(8.0), m["tokens"] / 60) - m["noisy"] * 5 - m["joined"] * 3 - m["malformed"] * 6


def normalize_quality(text: Column) -> Column:
    """Composed with single spaces: what error rates are measured on."""
    return collapse(nfc(text))


def words(text: Column) -> Column:
    """The words of normalised text; none for an empty one."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " ", -1))


def strip_marks(text: Column) -> Column:
    """Without combining marks; đ and Đ become d and D."""
    return nfc(F.translate(replaced(nfd(text), r"[\x{300}-\x{36F}]", ""), "đĐ", "dD"))


def is_prose_line(line: Column) -> Column:
    """At least two letters or digits, and not the known noise of a line's end."""
    return (F.regexp_count(line, F.lit(r"[\p{L}\p{N}]")) >= 2) & ~matches(line, P.LATER_NOISE)


def text_lines(text: Column) -> Column:
    """The lines of recognised text (composed), normalised, without those that are no prose."""
    lines = F.transform(F.split(text, "\r?\n", -1), lambda t: normalize_text(t, composed=True))
    return F.filter(lines, is_prose_line)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length of normalised lower-case texts; empty ones are like empty ones only."""
    a, b = F.lower(normalize_text(a)), F.lower(normalize_text(b))
    empty = (a == "") | (b == "")
    return F.when(empty, (a == b).cast("double")).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1)))


def choose_language(first: Column, first_confidence: Column, second: Column, second_confidence: Column) -> Column:
    """Whether the second (accented) reading wins: by 8 points, or, where only marks differ, if at most 4 behind."""
    same = similarity(first, strip_marks(second)) >= 0.86
    return second_confidence >= first_confidence + F.when(same, -4).otherwise(8)


def candidate_score(text: Column, confidence: Column, normalized: bool = False) -> Column:
    """Confidence with a bonus for length and penalties for noisy tokens, joined sentences and malformed words."""
    text = text if normalized else normalize_text(text)
    tokens = F.filter(F.split(text, " ", -1), lambda t: t != "")  # normalised text has no other space
    noisy = F.filter(tokens, lambda t: matches(t, P.BARS_ONLY) | matches(t, P.BROKEN_LETTERS) | (matches(t, P.ONE_ALNUM) & ~matches(t, P.ONE_LETTER_WORD)))
    count = lambda p: F.regexp_count(text, F.lit(java(p)))
    return confidence + F.least(F.lit(8.0), F.size(tokens) / 60) - F.size(noisy) * 5 - count(P.JOINED_SENTENCE) * 3 - count(P.MALFORMED) * 6


def is_suspicious(text: Column, confidence: Column) -> Column:
    """A line worth another look."""
    text = normalize_text(text)
    return (confidence < 84) | (candidate_score(text, confidence, True) < 80) | matches(text, P.LONE_MARK) | matches(text, P.BROKEN_LETTERS) | matches(text, P.MALFORMED)


def joined(tokens: Column, closers: str = P.CLOSERS, openers: str | None = P.OPENERS) -> Column:
    """Words in one string: no space before a closing token, none after an opening last character."""

    def whole(words: Column) -> Column:
        def piece(token: Column, i: Column) -> Column:
            before = F.get(words, i - 1)
            glued = (i == 0) | matches(token, closers)
            return F.concat(F.when(glued | (matches(F.right(before, F.lit(1)), openers) if openers else F.lit(False)), "").otherwise(" "), token)

        return F.array_join(F.transform(words, piece), "")

    return let(tokens, whole)


def joined_line(tokens: Column) -> Column:
    """The text of a recognised line's normalised words."""
    return normalize_text(joined(tokens), composed=True)


def joined_layout(tokens: Column) -> Column:
    """The text of a positioned line's tokens."""
    return replaced(joined(tokens, P.LAYOUT_CLOSERS, None), r"\s+([,.;:!?%…])", "$1")


def safe_display_name(name: Column) -> Column:
    """A name without control or formatting characters, never empty, at most NAME_CHARS characters."""
    clean = trim(replaced(replaced(nfc(name), P.CONTROLS, ""), P.NAME_FORMATTING, ""))
    return F.substring(F.coalesce(F.nullif(clean, F.lit("")), F.lit(NO_NAME)), 1, NAME_CHARS)


def sanitize_document_text(text: Column) -> Column:
    """Without control characters but TAB, LF and CR, at most TEXT_CHARS characters. Spark strings hold no surrogates."""
    return F.substring(replaced(F.make_valid_utf8(text), P.CONTROLS, ""), 1, TEXT_CHARS)


def embedded_text(items: Column) -> Column:
    """The text of array<struct(str, hasEOL)>: each item and a line break or a space, sanitised and trimmed."""
    pieces = F.transform(items, lambda i: F.concat(i["str"], F.when(i["hasEOL"], "\n").otherwise(" ")))
    return trim(sanitize_document_text(F.array_join(pieces, "")))
