from pyspark.sql import functions as F

from parchmint.operators import passes as R
from parchmint.operators import session


def test_best_pass(spark):
    rows = [(1, 0, "x | y | z", 95.0), (1, 1, "good words here", 93.0), (1, 2, "good words here", 93.0), (2, 0, "a", 50.0)]
    df = spark.createDataFrame(rows, "page long, pass_ix int, text string, confidence double")
    pick = lambda by: {r.page: r.pass_ix for r in R.best_pass(df, ["page"], by).collect()}
    assert pick("score") == {1: 1, 2: 0} and pick("confidence") == {1: 0, 2: 0}
    flags = df.select(R.needs_enhanced_pass(F.col("text"), F.col("confidence")).alias("a"), R.needs_word_pass(F.col("confidence")).alias("b"), R.needs_word_pass(F.col("confidence"), True).alias("c"))
    assert [tuple(r) for r in flags.collect()] == [(True, False, False), (True, True, False), (True, True, False), (True, True, True)]


def test_retries_replace_only_worse_lines(spark):
    lines = spark.createDataFrame([(1, 0, "th!s | bad", 70.0, ["w"]), (1, 1, "fine line", 95.0, ["w"]), (1, 2, "k", 60.0, ["w"])], "page long, ord long, text string, confidence double, words array<string>")
    assert [r.ord for r in R.lines_to_retry(lines, ["page"], "ord").orderBy("ord").collect()] == [0, 2]
    retries = spark.createDataFrame([(1, 0, "this is\nbetter", 90.0), (1, 1, "fine", 60.0), (1, 2, "", 99.0)], "page long, ord long, retry_text string, retry_confidence double")
    got = [(r.text, r.confidence, r.words) for r in R.improved_lines(lines, retries, ["page"], "ord").orderBy("ord").collect()]
    assert got == [("this is better", 90.0, []), ("fine line", 95.0, ["w"]), ("k", 60.0, ["w"])]


def test_readable_errors(spark):
    df = spark.createDataFrame([("no disk ", False), (None, False), ("x", True)], "d string, c boolean")
    got = [r.m for r in df.select(session.readable_error(F.col("d"), F.col("c")).alias("m")).collect()]
    assert got[0] == "Không thể tạo file: no disk" and got[1].endswith("tạo lại.") and got[2].startswith("Đã hủy")
