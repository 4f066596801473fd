"""Recognised words of a line: split-word repair, noise filter, flags, runs, metrics and regions for another look.

What needs a word's text or its neighbours is found out by kernels over a batch of lines (`line_kernels`); the words, their
metrics and regions are put together by expressions over ARRAY<word> columns. No line needs an exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmint.functions.arrays import bounds, runs_of, sorted_by
from parchmint.operators import line_kernels
from parchmint.operators.folds import joined_words
from parchmint.operators.line_kernels import LOW_CONFIDENCE

PAD = 12


def reason(mark: Column) -> Column:
    return F.when(mark["removed"], "isolated-noise").when(mark["flagged"], "low-confidence")


def processed_words(words: Column, marks: Column) -> Column:
    """PROCESSED_WORD for each normalised word: removed as noise between two words, or flagged as doubtful. Other fields stay."""

    def one(m: Column) -> Column:
        return F.get(words, m["at"]).withField("text", m["text"]).withField("removed", m["removed"]).withField("flagged", m["flagged"]).withField("reason", reason(m))

    return F.transform(marks, one)


def line_metrics(processed: Column) -> Column:
    kept = F.filter(processed, lambda w: ~w["removed"])
    total = F.aggregate(kept, F.lit(0.0), lambda a, w: a + w["confidence"])
    count = lambda items, test: F.size(F.filter(items, test))
    return F.struct(
        F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(0.0).alias("averageConfidence"),
        count(kept, lambda w: w["confidence"] < LOW_CONFIDENCE).alias("lowConfidenceWordCount"),
        count(processed, lambda w: w["removed"]).alias("filteredNoiseCount"),
        F.size(kept).alias("retainedWordCount"),
        count(processed, lambda w: w["flagged"] | w["removed"]).alias("suspiciousWordCount"),
    )


def retry_regions(processed: Column) -> Column:
    """Padded boxes of words that were removed or flagged."""

    def region(w: Column) -> Column:
        b = w["bbox"]
        box = F.struct(F.greatest(F.lit(0.0), b["x0"] - PAD).alias("x0"), F.greatest(F.lit(0.0), b["y0"] - PAD).alias("y0"), (b["x1"] + PAD).alias("x1"), (b["y1"] + PAD).alias("y1"))
        return F.struct(box.alias("bbox"), F.lit(1).alias("wordCount"), w["confidence"].alias("averageConfidence"), F.when(w["removed"], "noise").otherwise("low-confidence").alias("reason"))

    return F.transform(F.filter(processed, lambda w: (w["flagged"] | w["removed"]) & w["bbox"].isNotNull()), region)


def repaired_words(lines: DataFrame, words: str = "words", into: str = "words") -> DataFrame:
    """Adds to lines their words in reading order, single characters joined to the neighbour that they almost touch.

    Other fields of a joined word are those of its first part.
    """
    ordered = sorted_by(F.coalesce(F.col(words), F.array().cast(lines.schema[words].dataType)), lambda w: w["bbox"]["x0"])
    rows = lines.withColumn("_ordered", ordered)
    rows = rows.withColumn("_runs", joined_words(F.transform("_ordered", lambda w: F.struct(w["text"].alias("text"), w["bbox"].alias("bbox")))))

    def whole(own: Column) -> Column:
        first, each = F.get(own, F.lit(0)), lambda n: F.transform(own, lambda w: w[n])
        joined = first.withField("text", F.array_join(each("text"), "")).withField("confidence", F.array_min(each("confidence"))).withField("bbox", bounds(each("bbox")))
        return F.when(F.size(own) > 1, joined).otherwise(first)

    return rows.withColumn(into, runs_of(F.col("_ordered"), F.col("_runs"), whole)).drop("_ordered", "_runs")


def process_lines(lines: DataFrame, words: str = "words", repair: bool = False) -> DataFrame:
    """Adds text, n_words, processed, marks, runs, metrics and retry_regions to lines that have an ARRAY<word> column.

    marks, array<struct<at, text, removed, flagged>>, is what processed has of its own: who needs no more leaves the words in the
    kernels. These take null as no words.
    """
    out = repaired_words(lines, words, "_source") if repair else lines.withColumn("_source", F.col(words))
    out = out.withColumns({"marks": line_kernels.marks("_source"), "_texts": line_kernels.texts("_source"), "runs": line_kernels.runs("_source")})
    out = out.withColumns({"processed": processed_words(F.col("_source"), F.col("marks")), "text": F.col("_texts.text"), "n_words": F.col("_texts.n_words")})
    return out.withColumns({"metrics": line_metrics(F.col("processed")), "retry_regions": retry_regions(F.col("processed"))}).drop("_source", "_texts")
