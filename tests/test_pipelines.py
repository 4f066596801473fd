import io
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

import parchmint
from parchmint import schemas
from parchmint.operators import image as I
from parchmint.operators import session
from parchmint.plans import pipelines

LINES = f"doc_id long, page_no int, pass_ix int, ord long, text string, confidence double, bbox {schemas.BOX}, words array<{schemas.WORD}>"


def line(ord_, text, y, confidence=97.0, x=10.0, page=1, pass_ix=0, box=True):
    return (1, page, pass_ix, ord_, text, confidence, (x, float(y), x + 8.0 * len(text), y + 20.0) if box else None, [])


def test_lines_are_read_from_top_to_bottom_whatever_the_recogniser_does(spark):
    rows = [line(0, "The last line of it", 200), line(1, "A first line here", 20), line(2, "right half", 60, x=400.0), line(3, "left half", 60), line(4, "a first LINE here", 28), line(5, "", 90), line(6, "no place", 0, box=False)]
    got = pipelines.read_lines(spark.createDataFrame(rows, LINES)).orderBy("ord").collect()
    assert [r.text for r in got] == ["A first line here", "left half", "right half", "The last line of it"]


def test_doubtful_lines_get_a_second_look(spark):
    asked = []

    def retry(weak):
        asked.extend(sorted(r.ord for r in weak.collect()))
        return weak.select("doc_id", "page_no", "ord", F.lit("a better\nreading").alias("retry_text"), F.lit(95.0).alias("retry_confidence"))

    rows = [line(0, "fine words", 20), line(1, "th!s | bad", 60, 40.0)]
    got = pipelines.read_lines(spark.createDataFrame(rows, LINES), retry=retry).orderBy("ord").collect()
    assert asked == [1] and [r.text for r in got] == ["fine words", "a better reading"]


def pages(spark, n):
    blank = I.image_of(np.full((60, 50, 3), 230, dtype=np.uint8))
    df = spark.createDataFrame([(1, k + 1, blank) for k in range(n)], f"doc_id long, page_no int, image {schemas.IMAGE}")
    more = {"corners": F.lit(None).cast(schemas.CORNERS), "settings": session.preset(F.lit("original")), "rotation": F.lit(0), "fine_rotation": F.lit(0.0), "dewarp": F.lit(False)}
    return df.withColumns(more | {"items": F.array().cast(f"array<{schemas.PDF_ITEM}>"), "height": F.lit(800.0), "embedded_text": F.when(F.col("page_no") == 2, "From the layer \n\n second")})


def recogniser(spark, seen, rows):
    """rows: page, call (how often it was asked for that page) to lines."""
    def read(asked):
        own = [(r.page_no, r.segmentation) for r in asked.select("page_no", "segmentation").collect()]
        out = []
        for page, segmentation in own:
            seen.append((page, segmentation))
            out += rows[page][min(sum(p == page for p, _ in seen), len(rows[page])) - 1]
        return spark.createDataFrame(out, LINES)

    return read


def test_only_doubtful_pages_are_read_again_and_pages_without_places_fall_back(spark):
    seen = []
    rows = {1: [[line(0, "sure and good words", 10, 99.0)]], 2: [[line(0, "dou|bt", 10, 60.0, page=2)], [line(0, "doubt no more", 10, 97.0, page=2)], []], 3: [[line(0, "placeless words", 0, 99.0, page=3, box=False)]]}
    content = bytes(pipelines.scan_from_pdf_images(pages(spark, 3), recogniser(spark, seen, rows)).first().content)
    assert sorted(seen) == [(1, "4"), (2, "4"), (2, "4"), (2, "6"), (3, "4")]
    import re
    import zlib

    drawn = b"".join(zlib.decompress(s.split(b"\nendstream")[0]) for s in re.split(rb">>\nstream\n", content)[1:] if s.startswith(b"x\x9c"))
    assert all(t.encode("utf-16-be").hex().upper().encode() in drawn for t in ("sure and good words", "doubt no more", "placeless words"))


def test_word_export_of_scans_and_layers(spark):
    seen = []
    scan = [line(0, "the second line", 90, 70.0), line(1, "A title", 10, 70.0)]
    rows = {1: [scan, [line(0, "worse", 10, 50.0)], [line(0, "the best line", 10, 80.0)]], 2: [], 3: [[line(0, "end of it", 50, 99.0, page=3), line(1, "Top of it", 5, 99.0, page=3)]]}
    content = bytes(pipelines.to_word(pages(spark, 3), recogniser(spark, seen, rows)).first().content)
    body = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode()
    places = [body.index(t) for t in ("the best line", "From the layer", "second", "Top of it", "end of it")]
    assert places == sorted(places) and "worse" not in body and sorted(seen) == [(1, "4"), (1, "4"), (1, "6"), (3, "4")]


def test_extra_fields_of_words_survive(spark):
    word = "named_struct('text', '{}', 'confidence', 90D, 'bbox', named_struct('x0', {}D, 'y0', 0D, 'x1', {}D, 'y1', 20D), 'baseline', cast(null as struct<x0:double,y0:double,x1:double,y1:double>), 'language', '{}')"
    df = spark.range(1).select(F.expr(f"array({word.format('s', 0, 10, 'en')}, {word.format('tone', 12, 52, 'fr')})").alias("words"))
    got = parchmint.words.process_lines(df, repair=True).select("processed").first().processed
    assert [(w.text, w.language) for w in got] == [("stone", "en")]


def test_page_patch_and_public_names(spark):
    df = session.with_page(spark.createDataFrame([(1, 0, "a"), (2, 1, "b")], "page_id long, page_no int, name string"), 2, name="c", page_no=5)
    assert sorted(map(tuple, df.collect())) == [(1, 0, "a"), (2, 5, "c")]
    assert all(getattr(parchmint, name).__name__.endswith(name) for name in parchmint.__all__)


def test_jobs_end_after_their_time(spark):
    def slow(batches):
        for b in batches:
            time.sleep(20)
            yield b

    started = time.time()
    with pytest.raises(Exception, match="(?i)cancel"), session.cancellable(spark, "slow", 1.0):
        spark.range(2).mapInArrow(slow, "id long").collect()
    assert time.time() - started < 15 and spark.range(3).count() == 3
