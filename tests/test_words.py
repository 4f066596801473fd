import pytest
from pyspark.sql import functions as F

from parchmint import schemas
from parchmint.operators import words as W


def word(text, x, confidence, h=20):
    return (text, float(confidence), (float(x), 100.0, float(x + max(8, 10 * len(text))), 100.0 + h), None)


def processed(spark, line, repair=False):
    df = spark.createDataFrame([(line,)], f"words array<{schemas.WORD}>")
    return W.process_lines(df, repair=repair).select("text", "processed", "runs", "metrics", "retry_regions").first()


def test_small_faint_glyph_between_words_goes(spark):
    r = processed(spark, [word("night", 0, 91), word("x", 60, 28, 7), word("falls", 75, 90), word("early", 140, 88)])
    assert r.text == "night falls early"
    assert r.metrics.filteredNoiseCount == 1 and r.metrics.retainedWordCount == 3
    assert r.retry_regions[0].reason == "noise" and r.retry_regions[0].bbox.x0 == 48.0


@pytest.mark.parametrize(
    "line, text",
    [
        ([word("at", 0, 90), word("7", 30, 18), word("noon", 50, 90)], "at noon"),  # full height, very faint
        ([word("at", 0, 90), word("a", 30, 18), word("time", 50, 90)], "at a time"),  # a word by itself
        ([word("11", 0, 40), word("p.m.", 30, 90), word(",", 75, 40, 6), word("then", 90, 90)], "11 p.m., then"),
        ([word("7", 0, 43, 8), word("days", 20, 90), word("on", 70, 90)], "7 days on"),  # no neighbour before it
    ],
)
def test_kept_and_removed(spark, line, text):
    assert processed(spark, line).text == text


def test_doubtful_word_is_flagged_and_kept(spark):
    r = processed(spark, [word("one", 0, 90), word("maybe", 40, 42), word("two", 100, 90)])
    assert [w.flagged for w in r.processed] == [False, True, False]
    assert len(r.retry_regions) == 1 and r.metrics.suspiciousWordCount == 1
    assert [x.flagged for x in r.runs] == [False, True, False]


def test_split_word_is_joined_once(spark):
    r = processed(spark, [word("s", 0, 91), word("tone", 12, 90), word("wall", 75, 90)], repair=True)
    assert r.text == "stone wall"


def test_missing_boxes_and_empty_lines(spark):
    rows = [([("a b", 50.0, None, None), ("", 1.0, None, None)],), ([],), (None,)]
    df = spark.createDataFrame(rows, f"words array<{schemas.WORD}>")
    got = W.process_lines(df).select("text", F.size("processed").alias("n")).collect()
    assert [(r.text, r.n) for r in got] == [("a b", 1), ("", 0), ("", 0)]
