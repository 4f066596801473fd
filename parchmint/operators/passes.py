"""Escalation: which pages and lines are read again, and which reading stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint.functions.text import candidate_score, nfc, normalize_text
from parchmint.operators.lines import clean_page_lines, suspicious_lines

# Below these a page is read again.
SEARCHABLE_CONFIDENCE, SEARCHABLE_SCORE = 96, 92
WORD_CONFIDENCE, WORD_LAYOUT_CONFIDENCE = 94, 86


def needs_enhanced_pass(text: Column, confidence: Column) -> Column:
    """Whether a page of a searchable document deserves the enhanced passes."""
    return (confidence < SEARCHABLE_CONFIDENCE) | (candidate_score(text, confidence) < SEARCHABLE_SCORE)


def needs_word_pass(confidence: Column, layout: bool = False) -> Column:
    """Whether a page of a Word document is read from the enhanced image, or with another layout."""
    return confidence < (WORD_LAYOUT_CONFIDENCE if layout else WORD_CONFIDENCE)


def best_pass(passes: DataFrame, keys: list[str], by: str = "score") -> DataFrame:
    """The best reading of each page by score or by confidence; the earliest of equals. passes: keys, pass_ix, text, confidence."""
    rank = candidate_score(F.col("text"), F.col("confidence")) if by == "score" else F.col("confidence")
    w = Window.partitionBy(*keys).orderBy(F.desc("_by"), "pass_ix")
    return passes.withColumn("_by", rank).withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_by", "_rank")


def lines_to_retry(lines: DataFrame, keys: list[str], order: str, most: int = 10) -> DataFrame:
    """The first suspicious lines of each page."""
    return suspicious_lines(lines, keys, order, most)


def improved_lines(lines: DataFrame, retries: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Lines with another reading's text and confidence where its score is better; such lines lose their words.

    retries: keys, order, retry_text (its lines parted by line breaks) and retry_confidence.
    """
    parts = F.transform(F.split(F.col("_nfc"), "\r?\n", -1), lambda t: normalize_text(t, composed=True))
    again = retries.withColumn("_nfc", nfc(F.col("retry_text"))).select(*keys, order, F.array_join(clean_page_lines(parts), " ").alias("_text"), F.col("retry_confidence").alias("_confidence"))
    scored = lines.join(again, [*keys, order], "left").withColumn("_now", candidate_score(F.col("text"), F.col("confidence")))
    better = (F.col("_text") != "") & (candidate_score(F.col("_text"), F.col("_confidence"), normalized=True) > F.col("_now"))
    better = F.coalesce(better, F.lit(False))
    out = scored.withColumn("_better", better)
    changed = {"text": F.when(F.col("_better"), F.col("_text")).otherwise(F.col("text")), "confidence": F.when(F.col("_better"), F.col("_confidence")).otherwise(F.col("confidence"))}
    if "words" in lines.columns:
        changed["words"] = F.when(F.col("_better"), F.array().cast(lines.schema["words"].dataType)).otherwise(F.col("words"))
    return out.withColumns(changed).select(lines.columns)
