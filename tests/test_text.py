import unicodedata

import pytest
from pyspark.sql import functions as F

from parchmint.functions import quality, stats
from parchmint.functions import text as T
from parchmint.sources.files import sniff_kind


def values(spark, fn, rows, kind="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], f"i int, x {kind}")
    return [r.y for r in df.select("i", fn(F.col("x")).alias("y")).orderBy("i").collect()]


def test_repairs(spark):
    rows = ["the  ocial , media ( now )", "ButIn wor’ phon1e", "cortiso! and i. Soon  your", "an ocialist đocial", "a–b ‑ c", "étude"]
    want = ["the social, media (now )", "But In work phone", "cortisol! and Soon your", "an ocialist đsocial", "a-b - c", "étude"]
    assert values(spark, T.normalize_text, rows) == want


def test_token_normalisation_is_idempotent(spark):
    rows = [" a​b \t c ", "", "x", "﻿"]
    once = values(spark, T.normalize_token, rows)
    assert once == ["ab c", "", "x", ""] and values(spark, T.normalize_token, once) == once


def test_language_choice(spark):
    rows = [("one thing", 91.0, "một việc khác", 93.0), ("tieng Viet", 94.0, "tiếng Việt", 91.0), ("tieng Viet", 94.0, "tiếng Việt", 72.0), ("tieng Viet", 91.0, "tiếng Việt", 93.0)]
    df = spark.createDataFrame(rows, "a string, x double, b string, y double").withColumn("i", F.monotonically_increasing_id())
    got = [r.w for r in df.select("i", T.choose_language(F.col("a"), F.col("x"), F.col("b"), F.col("y")).alias("w")).orderBy("i").collect()]
    assert got == [False, True, False, True]


def test_marks(spark):
    assert values(spark, T.strip_marks, ["Đường đi Việt Nam", "", "abc"]) == ["Duong di Viet Nam", "", "abc"]


def test_names_and_text(spark):
    names = ["photo‮gpj.exe", "\u0007 ", "", "x" * 254, "bản vẽ.pdf"]
    assert values(spark, T.safe_display_name, names) == ["photogpj.exe", T.NO_NAME, T.NO_NAME, "x" * 160, "bản vẽ.pdf"]
    assert values(spark, T.sanitize_document_text, ["a\x00b\tc\nd\x7f", "Việt"]) == ["ab\tc\nd", "Việt"]
    assert len(values(spark, T.sanitize_document_text, ["y" * 2_000_100])[0]) == 2_000_000


@pytest.mark.parametrize(
    "content, kind",
    [
        (b"\xff\xd8\xff\xe0rest", "jpeg"), (b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + bytes(8), "png"), (b"\x89PNG\r\n\x1a\n" + bytes(30), None),
        (b"RIFF\x24\x00\x00\x00WEBPVP8 ", "webp"), (b"RIFF\x03\x00\x00\x00WEBPVP8 ", None), (b"RIFF\x24\x00\x00\x80WEBPVP8 ", None),
        (b"%PDF-1.7", "pdf"), (b"xyz%PDF-1.4", "pdf"), (b"%PDF-2.0", None), (b"%PDF-1", None), (b" " * 1020 + b"%PDF-1.4", None), (b"<html>", None), (b"", None),
    ],
)
def test_kinds(spark, content, kind):
    assert spark.createDataFrame([(content,)], "c binary").select(sniff_kind(F.col("c")).alias("k")).first().k == kind


def test_percentiles(spark):
    rows = [[10.0, 20.0, 30.0, 40.0, 50.0], [50.0, 10.0, 30.0, 20.0, 40.0], []]
    for ratio, want in ((0.0, [10, 10, 0]), (0.5, [30, 30, 0]), (0.99, [50, 50, 0])):
        assert values(spark, lambda c, r=ratio: stats.percentile(c, r), rows, "array<double>") == want
    assert values(spark, stats.median_high, [[1.0, 2.0], []], "array<double>") == [2.0, 1.0]
    assert values(spark, stats.median_low, [[1.0, 2.0], []], "array<double>") == [1.0, 10.0]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_error_rates(spark):
    rows = [("scan a page", "span a page"), ("one two", "one x two"), ("", ""), ("", "x"), ("Việt Nam", "Viet Nam"), ("a " * 400, "b a " * 300)]
    got = quality.measured(spark.createDataFrame(rows, "expected string, actual string")).collect()
    for r, (e, a) in zip(got, rows):
        e, a = (" ".join(unicodedata.normalize("NFC", x).split()) for x in (e, a))
        assert r.character_errors == distance(e, a) and r.word_errors == distance(e.split(), a.split())
        assert r.cer == (distance(e, a) / len(e) if e else float(bool(a)))
    same = spark.createDataFrame([("x", 0.0, 0.0)], "case string, cer double, wer double")
    worse = spark.createDataFrame([("x", 0.0, 0.5)], "case string, cer double, wer double")
    assert quality.regressions(same, worse, "case").count() == 1 and quality.regressions(worse, same, "case").count() == 0
