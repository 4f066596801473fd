"""Inputs derived from the driver's tables by one formula for both engines: Spark expressions beside DuckDB SQL.

The tables hold prose without the damage that recognition leaves, so that it is put in, keyed by document and line.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint import schemas
from parchmint.functions import arrow_text as A
from parchmint.functions import patterns as P
from parchmint.functions.patterns import re2

# The same text is valid in both dialects.
DIRT = (
    "CASE (doc_id * 7 + line_ix) % 13 WHEN 0 THEN concat('1. ', t) WHEN 1 THEN concat('Request 3 (20%): ', t) WHEN 2 THEN replace(t, ' ', '  ') "
    "WHEN 3 THEN replace(t, ' the ', ' \u2013 ') WHEN 4 THEN replace(t, ',', ' ,') WHEN 5 THEN concat(t, '\u200b x!y ocial media') "
    "WHEN 6 THEN concat(t, ' end.Next casy') WHEN 7 THEN '' WHEN 8 THEN concat('ButIn wor’ | © phon1e ( a ) ', t) "
    "WHEN 9 THEN replace(t, 'é', 'e\u0301') WHEN 10 THEN concat('7 ', t, ' ,') ELSE t END"
)
CONFIDENCE = "(31 * doc_id + 17 * line_ix) % 101"
WORD_CONFIDENCE = "(31 * doc_id + 17 * line_ix + 7 * word_ix) % 101"
LETTER = r"[\p{L}\p{N}]"
# What a curved page does to lines; the same text in both dialects.
CURVED = (
    "CASE line_ix % 11 WHEN 3 THEN concat(t, '. So') WHEN 4 THEN ': © er or later,' WHEN 5 THEN 'Soon' WHEN 6 THEN 'soon' WHEN 7 THEN concat(t, ' so') "
    "WHEN 8 THEN 'social media or working until midnight. But In modern life, it’s very easy to keep scrolling on s' WHEN 9 THEN 'Soon' ELSE t END"
)


def sql_text(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_matches(expr: str, pattern: str) -> str:
    return f"regexp_matches({expr}, {sql_text(re2(pattern))})"


def sql_replace(expr: str, pattern: str, by: str) -> str:
    return f"regexp_replace({expr}, {sql_text(re2(pattern))}, {sql_text(by.replace('$', chr(92)))}, 'g')"


def sql_count(expr: str, pattern: str) -> str:
    return f"len(regexp_extract_all({expr}, {sql_text(re2(pattern))}))"


def sql_trim(expr: str) -> str:
    return sql_replace(expr, r"^\s+|\s+$", "")


def sql_token(expr: str) -> str:
    out = sql_replace(sql_replace(f"nfc_normalize({expr})", P.ZERO_WIDTH, ""), P.DASHES, "-")
    return sql_trim(sql_replace(out, r"\s+", " "))


def sql_normal(expr: str) -> str:
    out = sql_token(expr)
    for pattern, by in P.REPAIRS:
        out = sql_replace(out, pattern, by)
    return out


def sql_score(text: str, confidence: str) -> str:
    """Of normalised text."""
    tokens = f"list_filter(string_split_regex({text}, {sql_text(re2(chr(92) + 's+'))}), lambda t: t <> '')"
    noisy = f"list_filter({tokens}, lambda t: {sql_matches('t', P.BARS_ONLY)} OR {sql_matches('t', P.BROKEN_LETTERS)} OR ({sql_matches('t', P.ONE_ALNUM)} AND NOT {sql_matches('t', P.ONE_LETTER_WORD)}))"
    return f"({confidence} + least(8.0::DOUBLE, len({tokens}) / 60::DOUBLE) - len({noisy}) * 5 - {sql_count(text, P.JOINED_SENTENCE)} * 3 - {sql_count(text, P.MALFORMED)} * 6)"


def spread(df: DataFrame) -> DataFrame:
    """df over all cores: a small table is one file and one task, a large one has partitions enough and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def lines(spark: SparkSession, sf_dir: str, dirty: bool = True) -> DataFrame:
    """doc_id, line_ix, t."""
    rows = documents(spark, sf_dir).selectExpr("doc_id", "posexplode(split(text, '\\n', -1)) AS (line_ix, t)").withColumn("line_ix", F.col("line_ix").cast("long"))
    return rows.withColumn("t", F.expr(DIRT)) if dirty else rows


SQL_RAW_LINES = "SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_ix, unnest(ls) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
SQL_LINES = f"SELECT doc_id, line_ix, {DIRT} AS t FROM ({SQL_RAW_LINES})"


def copied_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, ord, t, c: every fifth line twice."""
    rows = lines(spark, sf_dir).selectExpr("*", "explode(sequence(0L, 1L)) AS c").filter("c = 0 OR (doc_id + line_ix) % 5 = 0")
    return rows.selectExpr("doc_id", "line_ix", "c", "line_ix * 2 + c AS ord", "t")


SQL_COPIED = f"SELECT doc_id, line_ix, c, line_ix * 2 + c AS ord, t FROM ({SQL_LINES}), (SELECT unnest([0, 1])::BIGINT AS c) WHERE c = 0 OR (doc_id + line_ix) % 5 = 0"


def _words(doc_id: pa.Array, line_ix: pa.Array, confidence: pa.Array, t: pa.Array) -> pa.Array:
    """ARRAY<WORD> of each line, for a batch of lines. confidence: what word_ix * 7 is added to; null, as doc_id may be, leaves words without one."""
    tokens = pc.split_pattern(t, " ")
    sizes, text = A.list_sizes(tokens), tokens.flatten()
    line = np.repeat(np.arange(len(sizes)), sizes)
    word_ix = np.arange(len(line)) - (np.cumsum(sizes) - sizes)[line]
    known = doc_id.is_valid().to_numpy(zero_copy_only=False)[line]
    doc, ix, sure, n = (pc.fill_null(x, 0).to_numpy(zero_copy_only=False) for x in (doc_id, line_ix, confidence, pc.utf8_length(text)))
    sure = np.fmod(sure[line] + word_ix * 7, 101).astype(np.float64)
    bottom, tall = (ix * 24.0 + 20)[line], np.where(known & (n == 1) & ((doc[line] + word_ix) % 3 == 0), 7.0, 20.0)
    x0 = word_ix * 300.0
    box = pa.StructArray.from_arrays([pa.array(x) for x in (x0, bottom - tall, x0 + n * 10, bottom)], ["x0", "y0", "x1", "y1"])
    none = pa.StructArray.from_arrays([pa.array(np.zeros(len(line)))] * 4, fields=list(box.type), mask=pa.array(np.ones(len(line), dtype=bool)))
    fields = {"text": text, "confidence": pa.array(sure, mask=~known), "bbox": box, "baseline": none}
    return pa.ListArray.from_arrays(pa.array(A.offsets(sizes)), pa.StructArray.from_arrays(list(fields.values()), list(fields)))


def word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_ix, words ARRAY<WORD>: a line's tokens, 300 apart, small ones low.

    One kernel over a batch of lines, deterministic, so that a kernel over the words alone follows it without a way through the JVM.
    """
    dirty = F.expr(f"transform(split(text, '\\n', -1), (t, line_ix) -> {DIRT})")
    rows = documents(spark, sf_dir).select("doc_id", F.posexplode(dirty).alias("line_ix", "t")).withColumn("line_ix", F.col("line_ix").cast("long"))
    words = F.arrow_udf(_words, f"array<{schemas.WORD}>")
    return rows.select("doc_id", "line_ix", words("doc_id", "line_ix", F.expr("31 * doc_id + 17 * line_ix"), "t").alias("words"))


SQL_WORDS = f"""
  SELECT doc_id, line_ix, word_ix, text, confidence, x0, y1 - h AS y0, x1, y1, h, row_number() OVER (PARTITION BY doc_id, line_ix ORDER BY word_ix) - 1 AS pos FROM (
    SELECT doc_id, line_ix, word_ix, {sql_token("w")} AS text, ({WORD_CONFIDENCE})::DOUBLE AS confidence, (word_ix * 300)::DOUBLE AS x0, (word_ix * 300 + length(w) * 10)::DOUBLE AS x1,
           (line_ix * 24 + 20)::DOUBLE AS y1, CASE WHEN length(w) = 1 AND (doc_id + word_ix) % 3 = 0 THEN 7.0 ELSE 20.0 END::DOUBLE AS h
    FROM (SELECT doc_id, line_ix, generate_subscripts(ws, 1) - 1 AS word_ix, unnest(ws) AS w FROM (SELECT doc_id, line_ix, string_split(t, ' ') AS ws FROM ({SQL_LINES})))
  ) WHERE text <> ''"""

def sql_flags(words: str) -> str:
    """f: words with removed and flagged."""
    return f"""
WITH w AS ({words}),
m AS (SELECT doc_id, line_ix, list_concat(coalesce(list(h) FILTER (length(text) > 1), []), list(h)) AS hs FROM w GROUP BY ALL),
t AS (SELECT doc_id, line_ix, list_sort(hs)[CAST(floor(len(hs) / 2) AS INTEGER) + 1] AS t FROM m),
n AS (
  SELECT w.*, t.t, lag(x1) OVER o AS px1, lag(y1) OVER o AS py1, lead(x0) OVER o AS nx0, lead(y1) OVER o AS ny1
  FROM w JOIN t USING (doc_id, line_ix) WINDOW o AS (PARTITION BY doc_id, line_ix ORDER BY pos)
),
r AS (
  SELECT *, coalesce({sql_matches("text", P.ONE_ALNUM)} AND NOT {sql_matches("text", P.ONE_LETTER_WORD)} AND abs(y1 - py1) <= t * 0.8 AND abs(y1 - ny1) <= t * 0.8
    AND x0 >= px1 - t * 0.2 AND x1 <= nx0 + t * 0.2 AND ((confidence < 55 AND greatest(1.0, h) < t * 0.68) OR confidence < 32), false) AS removed FROM n
),
f AS (SELECT *, NOT removed AND confidence < 82 AND NOT {sql_matches("text", P.PUNCTUATION_ONLY)} AS flagged FROM r)
"""


SQL_FLAGS = sql_flags(SQL_WORDS)


def sql_joined(flags: str) -> str:
    """doc_id, line_ix, text: what is kept of each line."""
    return f"""{flags},
k AS (SELECT *, lag(text) OVER (PARTITION BY doc_id, line_ix ORDER BY pos) AS before FROM f WHERE NOT removed)
SELECT doc_id, line_ix, {sql_normal(f"string_agg(CASE WHEN before IS NULL OR {sql_matches('text', P.CLOSERS)} OR {sql_matches('right(before, 1)', P.OPENERS)} THEN text ELSE ' ' || text END, '' ORDER BY pos)")} AS text
FROM k GROUP BY doc_id, line_ix"""


def split_word_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line_ix, words ARRAY<WORD>: tokens 1000 apart, the first letter of some cut off and 2 pixels away."""

    def word(text, x0, confidence, tall):
        bottom = (F.col("line_ix") * 24 + 20).cast("double")
        box = F.struct(x0.alias("x0"), (bottom - tall).alias("y0"), (x0 + F.length(text) * 10).alias("x1"), bottom.alias("y1"))
        return F.struct(text.alias("text"), confidence.cast("double").alias("confidence"), box.alias("bbox"), F.lit(None).cast(schemas.BOX).alias("baseline"))

    def token(t, i):
        confidence = (F.col("doc_id") * 31 + F.col("line_ix") * 17 + i.cast("long") * 7) % 101
        x0, n = (i * 1000).cast("double"), F.length(t)
        tall = F.when((n == 1) & ((F.col("doc_id") + i) % 3 == 0), 7.0).otherwise(20.0)
        cut = (n >= 3) & ((F.col("doc_id") + i) % 4 == 0)
        parts = F.array(word(F.substring(t, 1, 1), x0, confidence, F.lit(20.0)), word(t.substr(F.lit(2), n), x0 + 12, (confidence + 3) % 101, F.lit(20.0)))
        return F.when(cut, parts).otherwise(F.array(word(t, x0, confidence, tall)))

    return lines(spark, sf_dir).select("doc_id", "line_ix", F.flatten(F.transform(F.split("t", " ", -1), token)).alias("words"))


_SPLIT = f"""
  SELECT doc_id, line_ix, word_ix, w, length(w) AS n, ({WORD_CONFIDENCE})::DOUBLE AS c, (({WORD_CONFIDENCE}) + 3) % 101::DOUBLE AS d, length(w) >= 3 AND (doc_id + word_ix) % 4 = 0 AS cut,
         {sql_matches("left(w, 1)", LETTER)} AND {sql_matches("substr(w, 2)", "^" + LETTER)} AS joins
  FROM (SELECT doc_id, line_ix, generate_subscripts(ws, 1) - 1 AS word_ix, unnest(ws) AS w FROM (SELECT doc_id, line_ix, string_split(t, ' ') AS ws FROM ({SQL_LINES})))"""
SQL_REPAIRED_WORDS = f"""
  SELECT doc_id, line_ix, row_number() OVER (PARTITION BY doc_id, line_ix ORDER BY x0) - 1 AS pos, text, confidence, x0, y1 - h AS y0, x1, y1, h FROM (
    SELECT doc_id, line_ix, {sql_token("w")} AS text, confidence, x0, x1, (line_ix * 24 + 20)::DOUBLE AS y1, h FROM (
      SELECT doc_id, line_ix, w, CASE WHEN cut THEN least(c, d) ELSE c END AS confidence, (word_ix * 1000)::DOUBLE AS x0, (word_ix * 1000 + n * 10 + CASE WHEN cut THEN 2 ELSE 0 END)::DOUBLE AS x1,
             CASE WHEN n = 1 AND (doc_id + word_ix) % 3 = 0 THEN 7.0 ELSE 20.0 END::DOUBLE AS h FROM ({_SPLIT}) WHERE NOT cut OR joins
      UNION ALL SELECT doc_id, line_ix, left(w, 1), c, (word_ix * 1000)::DOUBLE, (word_ix * 1000 + 10)::DOUBLE, 20.0 FROM ({_SPLIT}) WHERE cut AND NOT joins
      UNION ALL SELECT doc_id, line_ix, substr(w, 2), d, (word_ix * 1000 + 12)::DOUBLE, (word_ix * 1000 + 2 + n * 10)::DOUBLE, 20.0 FROM ({_SPLIT}) WHERE cut AND NOT joins
    )) WHERE text <> ''"""


def positioned_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pass_ix, ord, text, confidence, bbox: three readings of each line; the first is missing in every third document."""
    rows = lines(spark, sf_dir).selectExpr("*", "explode(sequence(0, 2)) AS pass_ix").filter("pass_ix > 0 OR doc_id % 3 <> 0")
    y0 = F.expr("cast(line_ix * 24 + pass_ix * 3 as double)")
    tall = F.expr("cast(12 + (doc_id + line_ix + pass_ix) % 3 * 4 as double)")
    box = F.struct(F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(500.0).alias("x1"), (y0 + tall).alias("y1"))
    text = F.expr("CASE pass_ix WHEN 0 THEN t WHEN 1 THEN replace(t, 'e', '|') ELSE concat(t, ' end') END")
    return rows.select("doc_id", "pass_ix", F.col("line_ix").alias("ord"), text.alias("text"), F.expr(f"cast(({CONFIDENCE} + pass_ix * 9) % 101 as double)").alias("confidence"), box.alias("bbox"))


SQL_PASSES = f"""
  SELECT doc_id, pass_ix, line_ix AS ord, CASE pass_ix WHEN 0 THEN t WHEN 1 THEN replace(t, 'e', '|') ELSE concat(t, ' end') END AS text,
         (({CONFIDENCE} + pass_ix * 9) % 101)::DOUBLE AS confidence, (line_ix * 24 + pass_ix * 3)::DOUBLE AS y0,
         (line_ix * 24 + pass_ix * 3 + 12 + (doc_id + line_ix + pass_ix) % 3 * 4)::DOUBLE AS y1
  FROM ({SQL_LINES}), (SELECT unnest([0, 1, 2]) AS pass_ix) WHERE pass_ix > 0 OR doc_id % 3 <> 0"""


def pdf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, height, items ARRAY<PDF_ITEM>: a document's page 1, a line's words as items; every seventh has an empty page 2."""

    def item(word, i):
        x, y = 20.0 + i * 60, 3000.0 - F.col("line_ix") * 16 - F.when(F.col("line_ix") % 5 == 0, 12).otherwise(0)
        size = F.when(F.col("line_ix") == 0, 20.0).otherwise(12.0)
        zero = F.lit(0.0)
        return F.struct(word.alias("str"), F.array(F.lit(1.0), zero, zero, size, x.cast("double"), y.cast("double")).alias("transform"), (F.length(word) * 6.0).alias("width"), size.alias("height"), F.lit("f").alias("fontName"), F.lit(False).alias("hasEOL"))

    own = lines(spark, sf_dir, dirty=False).select("doc_id", "line_ix", F.transform(F.split("t", " ", -1), item).alias("i"))
    items = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", "i"))), lambda s: s["i"]))
    pages = own.groupBy("doc_id").agg(items.alias("items"))
    none = F.array().cast(f"array<{schemas.PDF_ITEM}>")
    page = F.struct(F.lit(1).alias("page_no"), F.col("items"))
    both = F.when(F.col("doc_id") % 7 == 0, F.array(page, F.struct(F.lit(2).alias("page_no"), none.alias("items")))).otherwise(F.array(page))
    return pages.select("doc_id", F.explode(both).alias("p")).select("doc_id", "p.page_no", F.lit(3000.0).alias("height"), "p.items")


SQL_ITEMS = f"SELECT doc_id, line_ix, generate_subscripts(ws, 1) - 1 AS i, unnest(ws) AS w FROM (SELECT doc_id, line_ix, string_split(t, ' ') AS ws FROM ({SQL_RAW_LINES}))"

# A line that follows one with a wide gap above it lies 4 points below that one: both are a row, whose number is the first's.
SQL_LAYOUT = f"""
WITH RECURSIVE tok AS (
  SELECT doc_id, line_ix - (line_ix % 5 = 1)::INT AS g, line_ix, i, {sql_trim('nfc_normalize(w)')} AS text, CASE WHEN line_ix = 0 THEN 20.0 ELSE 12.0 END::DOUBLE AS fs,
         (20 + i * 60)::DOUBLE AS x0, (20 + i * 60 + greatest(1, length(w) * 6))::DOUBLE AS x1, (3000 - line_ix * 16 - CASE WHEN line_ix % 5 = 0 THEN 12 ELSE 0 END)::DOUBLE AS y1 FROM ({SQL_ITEMS})
),
tb AS (SELECT *, lag(text) OVER o AS before, x0 - lag(x1) OVER o AS gap FROM tok WHERE text <> '' WINDOW o AS (PARTITION BY doc_id, g ORDER BY x0, line_ix)),
ln AS (
  SELECT doc_id, g, {sql_replace(f"string_agg(CASE WHEN before IS NULL OR {sql_matches('text', P.LAYOUT_CLOSERS)} THEN text ELSE ' ' || text END, '' ORDER BY x0, line_ix)", r"\s+([,.;:!?%…])", "$1")} AS text,
         list_sort(list(fs))[(count(*) - 1) // 2 + 1] AS fs, count(*) AS n, max(gap) AS gap, list(x0 ORDER BY x0, line_ix) AS starts, first(text ORDER BY x0, line_ix) AS head,
         min(x0) AS x0, min(y1 - fs) AS y0, max(y1) AS y1 FROM tb GROUP BY doc_id, g
),
lc AS (
  SELECT *, n >= 2 AND coalesce(gap > fs * 3, false) AS candidate, count(*) OVER (PARTITION BY doc_id) AS n_lines, list_sort(list(fs) OVER (PARTITION BY doc_id))[(count(*) OVER (PARTITION BY doc_id) - 1) // 2 + 1] AS body FROM ln
),
lt AS (SELECT *, candidate AND count(*) FILTER (candidate) OVER (PARTITION BY doc_id, starts) >= 2 AS in_table, fs >= body * 1.22 OR (n_lines = 1 AND fs >= 16) AS heading FROM lc),
bl AS (
  SELECT doc_id, CASE WHEN {sql_matches('head', P.LIST_MARKER)} THEN 'list-item' WHEN heading THEN 'heading' ELSE 'paragraph' END AS kind, text, CASE WHEN heading THEN CASE WHEN fs >= body * 1.5 THEN 1 ELSE 2 END END AS level,
         NULL::INTEGER AS n_rows, x0, y0, y1, fs FROM lt WHERE NOT in_table
  UNION ALL SELECT doc_id, 'table', NULL, NULL, count(*)::INTEGER, min(x0), min(y0), max(y1), NULL FROM lt WHERE in_table GROUP BY doc_id
),
block AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY y1 DESC, x0) - 1)::INTEGER AS ord FROM bl)
"""

# Each step has one more block of every document: joined to the last, or opening the next one.
SQL_REFLOWED = f"""{SQL_LAYOUT},
flow AS (
  SELECT doc_id, ord, 0 AS out, kind, text, x0, y0, fs, CASE WHEN n_rows IS NULL THEN 1 END AS n_lines FROM block WHERE ord = 0
  UNION ALL
  SELECT doc_id, ord, out + (NOT same)::INT, kind, CASE WHEN same THEN {sql_trim(sql_replace("ptext || ' ' || text", r"\s+", " "))} ELSE text END, CASE WHEN same THEN least(px0, x0) ELSE x0 END, CASE WHEN same THEN least(py0, y0) ELSE y0 END,
         fs, CASE WHEN same THEN pn + 1 WHEN n_rows IS NULL THEN 1 END FROM (
    SELECT b.*, p.out, p.text AS ptext, p.x0 AS px0, p.y0 AS py0, p.n_lines AS pn, b.kind = 'paragraph' AND p.kind = 'paragraph' AND greatest(0, p.y0 - b.y1) <= greatest(p.fs, b.fs) * 0.72
           AND abs(p.x0 - b.x0) <= greatest(p.fs, b.fs) * 1.25 AS same FROM flow p JOIN block b ON b.doc_id = p.doc_id AND b.ord = p.ord + 1)
),
reflowed AS (SELECT doc_id, out, arg_max(kind, ord) AS kind, arg_max(text, ord) AS text, max(n_lines) AS n_lines FROM flow GROUP BY doc_id, out)
"""


def synthetic_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and image: a sheet on a dark ground with lines of ink, all by formula from page_id."""
    import numpy as np

    def draw(page_id: int) -> np.ndarray:
        h, w = 240 + page_id % 5 * 12, 180 + page_id % 7 * 10
        rgb = np.full((h, w, 3), 50 + page_id % 30, dtype=np.uint8)
        m = 14 + page_id % 9
        rgb[m : h - m, m + 4 : w - m - 4] = 225 + page_id % 25
        for y in range(m + 20, h - m - 20, 12 + page_id % 4):
            rgb[y : y + 3, m + 24 : w - m - 24] = 20 + page_id % 60
        return rgb

    return _drawn(spark, sf_dir, draw)


def ruled_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id and image: white sheets, two of three with a ruled table."""
    import numpy as np

    def draw(page_id: int) -> np.ndarray:
        rgb = np.full((300, 280, 3), 250, dtype=np.uint8)
        if page_id % 3:
            xs, ys = (40, 130 + page_id % 20, 240), (30, 110 + page_id % 15, 200, 270)
            for x in xs:
                rgb[ys[0] : ys[-1] + 1, x] = 10
            for y in ys:
                rgb[y, xs[0] : xs[-1] + 1] = 10
        return rgb

    return _drawn(spark, sf_dir, draw)


def _drawn(spark: SparkSession, sf_dir: str, draw) -> DataFrame:
    """page_id and draw(page_id) as image."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    from parchmint.operators.image import image_of

    ids = spread(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id"))
    kind = to_arrow_type(spark.createDataFrame([], f"image {schemas.IMAGE}").schema["image"].dataType)

    def run(batches):
        for b in batches:
            for i in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([i], type=pa.int64()), pa.array([image_of(draw(i), str(i))], type=kind)], ["page_id", "image"])

    return ids.mapInArrow(run, f"page_id long, image {schemas.IMAGE}")
