"""Named queries over the driver's tables and, where SQL can express them, their oracles.

Every query reads whole tables. Queries without an oracle are image kernels; tests hold them against definitions written out
on small inputs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions import geometry as G
from parchmint.functions import patterns as P
from parchmint.functions import quality, stats, text
from parchmint.operators import image, layout, lines, session, words
from parchmint.plans import derived as D
from parchmint.plans import pipelines
from parchmint.sinks import docx, encode, pdf
from parchmint.sources import files, pdf_items

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def rounded(name: str, c) -> object:
    return F.round(c, 6).alias(name)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Lines of text

_NORMAL_LINES = f"SELECT doc_id, ord, line_ix, c, {D.sql_normal('t')} AS text FROM ({D.SQL_COPIED})"


@query(f"SELECT doc_id, ord, text FROM ({_NORMAL_LINES}) WHERE length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 2 AND NOT {D.sql_matches('text', P.LATER_NOISE)}")
def text_lines_normalized(spark, sf_dir):
    rows = D.copied_lines(spark, sf_dir).select("doc_id", "ord", text.normalize_text(F.col("t")).alias("text"))
    return rows.filter(text.is_prose_line(F.col("text")))


_DEDUPED = f"""SELECT doc_id, ord, text FROM (
  SELECT *, lag(lower(text)) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM ({_NORMAL_LINES}) WHERE text <> ''
) WHERE before IS NULL OR before <> lower(text)"""


@query(_DEDUPED)
def dedup_consecutive_lines(spark, sf_dir):
    return lines.without_consecutive(D.copied_lines(spark, sf_dir).select("doc_id", "ord", F.col("t").alias("text")), ["doc_id"], "ord")


@query(f"""
WITH k AS (
  SELECT *, CASE WHEN {D.sql_matches('text', P.REQUEST)} THEN 'heading' WHEN {D.sql_matches('text', P.NUMBERED)} THEN 'list-item'
    WHEN row_number() OVER (PARTITION BY doc_id ORDER BY ord) = 1 AND length(text) <= 180 THEN 'title' ELSE 'paragraph' END AS kind FROM ({_DEDUPED})
), g AS (SELECT *, CASE WHEN kind = 'paragraph' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY ord) = 'paragraph' THEN 0 ELSE 1 END AS opens FROM k),
b AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ord)::BIGINT AS block FROM g)
SELECT doc_id, block, kind, {D.sql_normal("string_agg(text, ' ' ORDER BY ord)")} AS text FROM b GROUP BY doc_id, block, kind""")
def structured_paragraphs(spark, sf_dir):
    return lines.structured(D.copied_lines(spark, sf_dir).select("doc_id", "ord", F.col("t").alias("text")), ["doc_id"], "ord")


@query(f"SELECT conv_id, turn, round({D.sql_score('n', '(31 * conv_id + 7 * turn) % 101')}, 6) AS score FROM (SELECT conv_id, turn, {D.sql_normal('text')} AS n FROM conversations)")
def candidate_score(spark, sf_dir):
    confidence = (F.col("conv_id") * 31 + F.col("turn") * 7) % 101
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", rounded("score", text.candidate_score(F.col("text"), confidence)))


@query(f"""
WITH n AS (SELECT doc_id, line_ix, ({D.CONFIDENCE})::DOUBLE AS confidence, {D.sql_normal('t')} AS x, t FROM ({D.SQL_LINES})),
s AS (
  SELECT doc_id, line_ix, t AS text, confidence FROM n
  WHERE confidence < 84 OR {D.sql_score('x', 'confidence')} < 80 OR {D.sql_matches('x', P.LONE_MARK)} OR {D.sql_matches('x', P.BROKEN_LETTERS)} OR {D.sql_matches('x', P.MALFORMED)}
)
SELECT doc_id, line_ix, rank, text FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_ix) AS INTEGER) AS rank FROM s) WHERE rank <= 10""")
def suspicious_top10(spark, sf_dir):
    rows = D.lines(spark, sf_dir).select("doc_id", "line_ix", F.col("t").alias("text"), F.expr(f"cast({D.CONFIDENCE} as double)").alias("confidence"))
    return lines.suspicious_lines(rows, ["doc_id"], "line_ix").select("doc_id", "line_ix", "rank", "text")


_CURVED_LINES = f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_ix) AS i, x FROM (SELECT doc_id, line_ix, {D.sql_normal('t')} AS x FROM (SELECT doc_id, line_ix, {D.CURVED} AS t FROM ({D.SQL_LINES}))) WHERE x <> ''"
_CLEANED_LINES = f"""
WITH l AS ({_CURVED_LINES}),
r AS (
  SELECT doc_id, i, {D.sql_replace('x', P.ROTATED, 'In $2 $1 But')} AS x, bool_or({D.sql_matches('x', P.LATER_SUFFIX)}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM l
),
m AS (SELECT doc_id, i, CASE WHEN near AND {D.sql_matches('x', P.ENDS_WITH_SO)} THEN regexp_replace(x, '(?i)So$', 'Sooner or later,') ELSE x END AS x FROM r),
k AS (SELECT *, regexp_matches(x, '(?i)^Soon$') AS soon, x LIKE '%Sooner or later,' AS ends FROM m WHERE NOT {D.sql_matches('x', P.LATER_FRAGMENT)}),
o AS (SELECT *, soon AND coalesce(last_value(CASE WHEN NOT soon THEN ends END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS orphan FROM k),
c AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1)::INTEGER AS ord, x AS text FROM o WHERE NOT orphan)
"""


def _curved_lines(spark, sf_dir):
    return D.lines(spark, sf_dir).withColumn("t", F.expr(D.CURVED))


@query(f"{_CLEANED_LINES} SELECT doc_id, ord, text FROM c")
def cleaned_page_lines(spark, sf_dir):
    page = _curved_lines(spark, sf_dir).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", text.nfc(F.col("t")).alias("t")))), lambda s: s["t"]).alias("l"))
    return page.select("doc_id", F.posexplode(lines.clean_page_lines(F.transform("l", lambda x: text.normalize_text(x, composed=True)))).alias("ord", "text"))


# Recognised words

_KEYS = ("doc_id", "line_ix")


def _processed(spark, sf_dir, **kw):
    return words.process_lines(D.word_lines(spark, sf_dir), **kw)


@query(f"{D.SQL_FLAGS} SELECT doc_id, line_ix, pos, text, removed, flagged, CASE WHEN removed THEN 'isolated-noise' WHEN flagged THEN 'low-confidence' END AS reason FROM f")
def ocr_noise_flags(spark, sf_dir):
    rows = _processed(spark, sf_dir).select(*_KEYS, F.posexplode("marks").alias("pos", "w"))
    return rows.select(*_KEYS, F.col("pos").cast("long").alias("pos"), "w.text", "w.removed", "w.flagged", words.reason(F.col("w")).alias("reason"))


@query(f"""{D.SQL_FLAGS}
SELECT doc_id, line_ix, round(coalesce(avg(confidence) FILTER (NOT removed), 0), 6) AS average_confidence, count(*) FILTER (NOT removed AND confidence < 82) AS low_confidence,
       count(*) FILTER (removed) AS filtered_noise, count(*) FILTER (NOT removed) AS retained, count(*) FILTER (removed OR flagged) AS suspicious FROM f GROUP BY doc_id, line_ix""")
def ocr_line_metrics(spark, sf_dir):
    m = F.col("metrics")
    counts = {"low_confidence": "lowConfidenceWordCount", "filtered_noise": "filteredNoiseCount", "retained": "retainedWordCount", "suspicious": "suspiciousWordCount"}
    rows = _processed(spark, sf_dir).filter(F.size("processed") > 0)
    return rows.select(*_KEYS, rounded("average_confidence", m["averageConfidence"]), *[m[f].cast("long").alias(n) for n, f in counts.items()])


@query(D.sql_joined(D.SQL_FLAGS))
def joined_line_text(spark, sf_dir):
    return _processed(spark, sf_dir).filter("n_words > 0").select(*_KEYS, "text")


@query(f"""{D.SQL_FLAGS}
SELECT doc_id, line_ix, greatest(0, x0 - 12) AS x0, greatest(0, y0 - 12) AS y0, x1 + 12 AS x1, y1 + 12 AS y1, confidence, CASE WHEN removed THEN 'noise' ELSE 'low-confidence' END AS reason
FROM f WHERE removed OR flagged""")
def retry_regions(spark, sf_dir):
    rows = _processed(spark, sf_dir).select(*_KEYS, F.explode("retry_regions").alias("r"))
    return rows.select(*_KEYS, "r.bbox.x0", "r.bbox.y0", "r.bbox.x1", "r.bbox.y1", F.col("r.averageConfidence").alias("confidence"), "r.reason")


@query(f"""{D.SQL_FLAGS},
k AS (
  SELECT *, row_number() OVER o AS n, lag(flagged) OVER o AS pf, bool_and({D.sql_matches('text', P.OPENERS)}) OVER (PARTITION BY doc_id, line_ix ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened
  FROM f WHERE NOT removed WINDOW o AS (PARTITION BY doc_id, line_ix ORDER BY pos)
),
q AS (SELECT *, CASE WHEN n = 1 OR opened OR {D.sql_matches('text', P.CLOSERS)} THEN text ELSE ' ' || text END AS piece, sum(CASE WHEN pf = flagged THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, line_ix ORDER BY pos) AS run FROM k)
SELECT doc_id, line_ix, (run - 1)::INTEGER AS run, string_agg(piece, '' ORDER BY pos) AS text, min(confidence) AS confidence, flagged FROM q GROUP BY doc_id, line_ix, run, flagged""")
def text_runs(spark, sf_dir):
    return _processed(spark, sf_dir).select(*_KEYS, F.posexplode("runs").alias("run", "r")).select(*_KEYS, "run", "r.text", "r.confidence", "r.flagged")


@query(f"""SELECT doc_id, line_ix, text, n_words FROM ({D.sql_joined(D.sql_flags(D.SQL_REPAIRED_WORDS))}) JOIN (SELECT doc_id, line_ix, count(*)::INTEGER AS n_words FROM ({D.SQL_REPAIRED_WORDS}) GROUP BY ALL) USING (doc_id, line_ix)""")
def repaired_words(spark, sf_dir):
    return words.process_lines(D.split_word_lines(spark, sf_dir), repair=True).filter("n_words > 0").select(*_KEYS, "text", "n_words")


# Choice among passes


@query(f"""
WITH p AS (SELECT doc_id, pass_ix, ord, text, confidence, (y0 + y1) / 2 AS c, greatest(1, y1 - y0) AS h, {D.sql_normal('text')} AS n FROM ({D.SQL_PASSES})),
q AS (SELECT *, {D.sql_score('n', 'confidence')} AS score, min(pass_ix) OVER (PARTITION BY doc_id) AS first FROM p),
j AS (
  SELECT a.doc_id, a.ord AS anchor_ord, b.pass_ix, b.ord, b.text, row_number() OVER (
    PARTITION BY a.doc_id, a.ord ORDER BY b.score DESC, (b.pass_ix = a.pass_ix AND b.ord = a.ord) DESC, b.pass_ix, b.ord) AS rank
  FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.pass_ix = a.first AND abs(a.c - b.c) <= greatest(a.h, b.h) * 1.15
)
SELECT doc_id, anchor_ord, pass_ix, ord, text FROM j WHERE rank = 1""")
def best_line_band_join(spark, sf_dir):
    return lines.best_lines(D.positioned_passes(spark, sf_dir), ["doc_id"]).select("doc_id", "anchor_ord", "pass_ix", "ord", "text")


@query(f"""
WITH l AS (SELECT doc_id, ord, lower(text) AS s, (line_ix * 24 + c * 5 + 10)::DOUBLE AS m FROM ({_NORMAL_LINES}))
SELECT doc_id, ord FROM l WHERE NOT EXISTS (SELECT 1 FROM l p WHERE p.doc_id = l.doc_id AND p.s = l.s AND p.ord < l.ord AND abs(p.m - l.m) <= 20 * 0.8)""")
def duplicate_line_antijoin(spark, sf_dir):
    y0 = F.expr("cast(line_ix * 24 + c * 5 as double)")
    box = F.struct(F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(1.0).alias("x1"), (y0 + 20).alias("y1"))
    rows = D.copied_lines(spark, sf_dir).select("doc_id", "ord", F.col("t").alias("text"), box.alias("bbox"))
    return lines.without_repeats(rows, ["doc_id"], "ord").select("doc_id", "ord")


@query(f"""
WITH p AS (SELECT doc_id, pass_ix, ord * 7919 % 10007 AS ord, confidence, y0, (y0 + y1) / 2 AS c, greatest(1, y1 - y0) AS h, {D.sql_normal('text')} AS n FROM ({D.SQL_PASSES}) WHERE {D.sql_trim('text')} <> ''),
q AS (SELECT *, {D.sql_score('n', 'confidence')} AS score, min(pass_ix) OVER (PARTITION BY doc_id) AS first FROM p),
j AS (
  SELECT a.doc_id, a.ord AS anchor, a.y0 AS top, b.n, b.y0, b.c, b.h, row_number() OVER (
    PARTITION BY a.doc_id, a.ord ORDER BY b.score DESC, (b.pass_ix = a.pass_ix AND b.ord = a.ord) DESC, b.pass_ix, b.ord) AS rank
  FROM q a JOIN q b ON a.doc_id = b.doc_id AND a.pass_ix = a.first AND abs(a.c - b.c) <= greatest(a.h, b.h) * 1.15
),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY top, anchor) AS place FROM j WHERE rank = 1),
k AS (SELECT * FROM s WHERE NOT EXISTS (SELECT 1 FROM s e WHERE e.doc_id = s.doc_id AND lower(e.n) = lower(s.n) AND e.place < s.place AND abs(e.c - s.c) <= greatest(e.h, s.h) * 0.8)),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY y0, place) - 1 AS ord, n AS text FROM k)
SELECT doc_id, ord, text FROM (SELECT *, lag(lower(text)) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM o WHERE text <> '') WHERE before IS NULL OR before <> lower(text)""")
def searchable_lines(spark, sf_dir):
    read = D.positioned_passes(spark, sf_dir).filter(text.trim(F.col("text")) != "").withColumn("ord", F.col("ord") * 7919 % 10007)  # read out of order
    found = lines.selected_lines(read, ["doc_id"], normal="normal")
    return lines.without_consecutive(found, ["doc_id"], "ord", normal="normal").select("doc_id", "ord", "text")


@query("""
WITH v AS (SELECT conv_id, turn, regexp_replace(text, '[^ -~]', '?', 'g') AS a, (31 * conv_id + 7 * turn) % 101 AS x, (17 * conv_id + 13 * turn) % 101 AS y FROM conversations),
w AS (SELECT *, CASE turn % 3 WHEN 0 THEN a WHEN 1 THEN replace(replace(a, 'a', 'á'), 'o', 'ợ') ELSE reverse(a) END AS b FROM v),
s AS (SELECT *, """ + f"lower({D.sql_normal('a')}) AS p, lower({D.sql_normal('strip_accents(b)')}) AS q" + """ FROM w)
SELECT conv_id, turn, y >= x + CASE WHEN (CASE WHEN p = '' OR q = '' THEN (p = q)::INT ELSE 1 - levenshtein(p, q) / greatest(length(p), length(q)) END) >= 0.86 THEN -4 ELSE 8 END AS second_wins FROM s""")
def language_choice(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").withColumn("a", F.regexp_replace("text", "[^ -~]", "?"))
    b = F.when(F.col("turn") % 3 == 0, F.col("a")).when(F.col("turn") % 3 == 1, F.regexp_replace(F.regexp_replace("a", "a", "á"), "o", "ợ")).otherwise(F.reverse("a"))
    rows = rows.withColumn("b", b)
    x, y = (F.col("conv_id") * 31 + F.col("turn") * 7) % 101, (F.col("conv_id") * 17 + F.col("turn") * 13) % 101
    return rows.select("conv_id", "turn", text.choose_language(F.col("a"), x, F.col("b"), y).alias("second_wins"))


@query(f"""
WITH w AS (SELECT doc_id, line_ix, generate_subscripts(ws, 1) - 1 AS word_ix, unnest(ws) AS w FROM (SELECT doc_id, line_ix, string_split(t, ' ') AS ws FROM ({D.SQL_LINES}))),
m AS (
  SELECT doc_id, line_ix // 2 AS ord, count(DISTINCT line_ix) AS n_lines, string_agg(w, ' ' ORDER BY word_ix, line_ix) AS whole, avg(({D.WORD_CONFIDENCE})::DOUBLE) AS mean, count(*)::INTEGER AS n_words FROM w GROUP BY doc_id, line_ix // 2
),
j AS ({D.sql_joined(D.SQL_FLAGS)})
SELECT m.doc_id, ord::INTEGER AS ord, CASE WHEN n_lines = 2 THEN whole ELSE coalesce(j.text, '') END AS text, CASE WHEN n_lines = 2 THEN mean ELSE 50 END AS confidence, n_words
FROM m LEFT JOIN j ON j.doc_id = m.doc_id AND j.line_ix = m.ord * 2""")
def merged_fragments(spark, sf_dir):
    rows = _processed(spark, sf_dir)
    x0 = F.col("line_ix") % 2 * 4000.0
    box = F.struct(x0.alias("x0"), (F.floor(F.col("line_ix") / 2) * 24.0).alias("y0"), (x0 + 3000).alias("x1"), (F.floor(F.col("line_ix") / 2) * 24.0 + 20).alias("y1"))
    line = F.struct("text", F.lit(50.0).alias("confidence"), box.alias("bbox"), "words")
    pages = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_ix", line.alias("l")))), lambda s: s["l"]).alias("ls"))
    return pages.select("doc_id", F.posexplode(lines.merged_fragments(F.col("ls"))).alias("ord", "l")).select("doc_id", "ord", "l.text", "l.confidence", F.size("l.words").alias("n_words"))


@query("""
WITH l AS (SELECT doc_id, line_ix, (60 * line_ix + (doc_id * line_ix) % 4 * 12)::DOUBLE AS y0, (60 * line_ix + (doc_id * line_ix) % 4 * 12 + 20 + line_ix % 3)::DOUBLE AS y1 FROM (""" + D.SQL_RAW_LINES + """)),
g AS (SELECT *, y0 - lag(y1) OVER w AS gap, greatest(8, y1 - y0) AS h, greatest(8, lag(y1 - y0) OVER w) AS ph FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line_ix)),
u AS (SELECT doc_id, list_sort(list(greatest(0, gap)))[CAST(floor(count(*) / 2) AS INTEGER) + 1] AS usual FROM g WHERE gap IS NOT NULL GROUP BY doc_id)
SELECT doc_id, line_ix, sum(CASE WHEN gap > greatest(greatest(h, ph) * 1.45, coalesce(usual, 0) * 1.65) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_ix)::BIGINT AS paragraph
FROM g LEFT JOIN u USING (doc_id)""")
def paragraph_gap_islands(spark, sf_dir):
    y0 = F.expr("cast(60 * line_ix + (doc_id * line_ix) % 4 * 12 as double)")
    box = F.struct(F.lit(0.0).alias("x0"), y0.alias("y0"), F.lit(1.0).alias("x1"), (y0 + 20 + F.col("line_ix") % 3).alias("y1"))
    rows = D.lines(spark, sf_dir, dirty=False).select("doc_id", "line_ix", box.alias("bbox"))
    return lines.paragraph_groups(rows, ["doc_id"], "line_ix").select("doc_id", "line_ix", "paragraph")


# Layout


@query("""
WITH r AS (SELECT doc_id, line_ix, 2 + line_ix % 3 AS n, list_transform(range(2 + line_ix % 3), lambda i: (100 * i + (doc_id + line_ix * (i + 1)) % 7 * 8)::DOUBLE) AS s FROM (""" + D.SQL_RAW_LINES + """))
SELECT doc_id, line_ix FROM r a WHERE EXISTS (
  SELECT 1 FROM r b WHERE b.doc_id = a.doc_id AND b.n = a.n AND b.line_ix <> a.line_ix AND len(list_filter(list_zip(a.s, b.s), lambda z: abs(z[1] - z[2]) >= 18)) = 0)""")
def aligned_rows_semijoin(spark, sf_dir):
    starts = F.expr("transform(sequence(0L, 1 + line_ix % 3), i -> cast(100 * i + (doc_id + line_ix * (i + 1)) % 7 * 8 as double))")
    rows = D.lines(spark, sf_dir, dirty=False).select("doc_id", "line_ix", starts.alias("starts"))
    return layout.aligned_rows(rows, ["doc_id"], "line_ix", "starts").select("doc_id", "line_ix")


_ITEMS = D.SQL_ITEMS


@query(f"""SELECT doc_id, w AS text, CASE WHEN line_ix = 0 THEN 20.0 ELSE 12.0 END::DOUBLE AS font_size, (20 + i * 60)::DOUBLE AS x0,
  (20 + i * 60 + greatest(1, length(w) * 6))::DOUBLE AS x1, (3000 - line_ix * 16 - CASE WHEN line_ix % 5 = 0 THEN 12 ELSE 0 END)::DOUBLE AS y1, {D.sql_matches('w', P.LIST_MARKER)} AS is_marker
FROM (SELECT doc_id, line_ix, i, {D.sql_trim('nfc_normalize(w)')} AS w FROM ({_ITEMS})) WHERE w <> ''""")
def tokens_from_items(spark, sf_dir):
    rows = D.pdf_pages(spark, sf_dir).select("doc_id", F.explode(layout.tokens_from_items(F.col("items"), F.col("page_no"))).alias("t"))
    return rows.select("doc_id", "t.text", F.col("t.fontSize").alias("font_size"), "t.bbox.x0", "t.bbox.x1", "t.bbox.y1", text.matches(F.col("t.text"), P.LIST_MARKER).alias("is_marker"))


_PAGES = "SELECT doc_id, unnest(CASE WHEN doc_id % 7 = 0 THEN [1, 2] ELSE [1] END)::INTEGER AS page_no FROM documents"
_LAYER = f"SELECT doc_id, 1 AS page_no, count(*) FILTER (text <> '') AS n, length(string_agg({D.sql_replace('text', chr(92) + 's', '')}, '')) AS letters FROM (SELECT doc_id, {D.sql_trim('nfc_normalize(w)')} AS text FROM ({_ITEMS})) GROUP BY doc_id"


@query(f"SELECT doc_id, page_no, coalesce(letters, 0) < 12 AS needs_ocr FROM ({_PAGES}) LEFT JOIN ({_LAYER}) USING (doc_id, page_no)")
def pages_that_need_ocr(spark, sf_dir):
    return D.pdf_pages(spark, sf_dir).select("doc_id", "page_no", layout.needs_ocr(layout.tokens_from_items(F.col("items"), F.col("page_no"))).alias("needs_ocr"))


@query(f"""
WITH i AS (SELECT doc_id, length({D.sql_trim('w')}) AS n, length(w) * 6.0 * 12 AS area FROM ({_ITEMS}) WHERE length({D.sql_trim('w')}) > 0),
g AS (SELECT doc_id, count(*) AS n_items, avg(n) AS mean_length, avg(CASE WHEN n <= 1 THEN 1.0 ELSE 0.0 END) AS single_share, sum(area) AS area FROM i GROUP BY doc_id),
s AS (SELECT g.*, length(d.text) >= 12 AS has, CASE WHEN length(d.text) >= 12 THEN 0.35 ELSE 0 END + least(0.3, mean_length / 20) + least(0.25, area / 1400000 * 4) - least(0.5, single_share * 0.9) AS score
      FROM g JOIN documents d USING (doc_id))
SELECT doc_id, n_items, round(mean_length, 6) AS mean_length, round(single_share, 6) AS single_share, round(score, 6) AS score, CASE WHEN has AND score >= 0.48 THEN 'document' ELSE 'scan' END AS kind FROM s""")
def pdf_page_classifier(spark, sf_dir):
    pages = D.pdf_pages(spark, sf_dir).join(D.documents(spark, sf_dir).select("doc_id", F.length("text").alias("text_length")), "doc_id")
    items = pages.select("doc_id", "text_length", F.lit(1_400_000).alias("raster_pixels"), F.explode("items").alias("i")).select("*", F.col("i.str").alias("text"), "i.width", "i.height")
    items = items.withColumn("height", F.lit(12.0))
    return layout.page_scores(items, ["doc_id"]).select("doc_id", "n_items", *[rounded(c, F.col(c)) for c in ("mean_length", "single_share", "score")], "kind")


@query(f"{D.SQL_LAYOUT} SELECT doc_id, ord, kind, text, level, n_rows FROM block")
def page_layout_blocks(spark, sf_dir):
    pages = D.pdf_pages(spark, sf_dir).withColumn("tokens", layout.tokens_from_items(F.col("items"), F.col("page_no")))
    blocks = layout.layout(pages).select("doc_id", F.posexplode("blocks").alias("ord", "b"))
    return blocks.select("doc_id", "ord", "b.kind", "b.text", "b.level", F.size("b.rows").alias("n_rows"))


@query(f"{D.SQL_REFLOWED} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY out) - 1)::INTEGER AS ord, kind, text, n_lines::INTEGER AS n_lines FROM reflowed")
def reflowed_paragraphs(spark, sf_dir):
    pages = D.pdf_pages(spark, sf_dir).withColumn("tokens", layout.tokens_from_items(F.col("items"), F.col("page_no")))
    blocks = layout.layout(pages).select("doc_id", F.posexplode(layout.reflowed(F.col("blocks"))).alias("ord", "b"))
    return blocks.select("doc_id", "ord", "b.kind", "b.text", F.size("b.lines").alias("n_lines"))


@query(f"""
WITH i AS (
  SELECT doc_id, line_ix - (line_ix % 5 = 1)::INT AS g, line_ix, i, {D.sql_token(D.sql_replace('w', P.CONTROLS, ''))} AS text, CASE WHEN line_ix = 0 THEN 20.0 ELSE 12.0 END::DOUBLE AS h, (20 + i * 60)::DOUBLE AS x, (length(w) * 6)::DOUBLE AS width
  FROM ({_ITEMS}) WHERE {D.sql_trim('w')} <> ''
),
b AS (SELECT *, list_sort(list(h) OVER (PARTITION BY doc_id))[count(*) OVER (PARTITION BY doc_id) // 2 + 1] AS body, x - lag(x + width) OVER (PARTITION BY doc_id, g ORDER BY x, line_ix) AS gap FROM i WHERE text <> ''),
l AS (
  SELECT doc_id, g, any_value(body) AS body, list_sort(list(h))[count(*) // 2 + 1] AS tall, {D.sql_normal("string_agg(CASE WHEN gap > greatest(1.5, body * 0.12) THEN ' ' ELSE '' END || text, '' ORDER BY x, line_ix)")} AS text FROM b GROUP BY doc_id, g
)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1)::INTEGER AS ord, text, tall AS "fontSize", tall >= body * 1.22 AS heading FROM l WHERE text <> ''""")
def grouped_text_items(spark, sf_dir):
    pages = D.pdf_pages(spark, sf_dir).select("doc_id", F.posexplode(layout.grouped_text_items(pdf_items.text_items(F.col("items")))).alias("ord", "l"))
    return pages.select("doc_id", "ord", "l.text", "l.fontSize", "l.heading")


@query(f"""SELECT doc_id, page_no, CASE WHEN coalesce(letters, 0) < 12 THEN 'ocr' ELSE 'text-layer' END AS source, CASE WHEN coalesce(letters, 0) < 12 THEN 0 ELSE n END::INTEGER AS n_tokens,
  CASE WHEN coalesce(letters, 0) < 12 THEN 0 ELSE 100 END::DOUBLE AS confidence FROM ({_PAGES}) LEFT JOIN ({_LAYER}) USING (doc_id, page_no)""")
def extracted_documents(spark, sf_dir):
    empty = F.array().cast("array<struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>")
    pages = pdf_items.page_tokens(D.pdf_pages(spark, sf_dir), lambda p: p.select("doc_id", "page_no", empty.alias("words")))
    return pages.select("doc_id", "page_no", "source", F.size("tokens").alias("n_tokens"), "confidence")


@query("""SELECT doc_id, trim(regexp_replace(list_reduce(list_transform(range(1, len(ls) + 1), lambda i: ls[i] || CASE WHEN i % 3 = 0 THEN chr(10) ELSE ' ' END), lambda a, b: a || b), '[\\x{0}-\\x{8}\\x{B}\\x{C}\\x{E}-\\x{1F}\\x{7F}-\\x{9F}]', '', 'g'), ' ' || chr(10)) AS text
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)""")
def embedded_text(spark, sf_dir):
    items = F.transform(F.split("text", "\n", -1), lambda t, i: F.struct(t.alias("str"), ((i + 1) % 3 == 0).alias("hasEOL")))
    return D.documents(spark, sf_dir).select("doc_id", text.embedded_text(items).alias("text"))


# Statistics


@query("SELECT l_returnflag, list_sort(list(l_extendedprice))[greatest(0, least(count(*) - 1, floor(count(*) * 0.88)::BIGINT)) + 1] AS p88 FROM lineitem GROUP BY l_returnflag")
def percentile_floor(spark, sf_dir):
    return stats.ranked_value(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", 0.88, "p88")


@query("SELECT o_orderpriority, list_sort(list(o_totalprice))[((count(*) - 1) // 2) + 1] AS low, list_sort(list(o_totalprice))[(count(*) // 2) + 1] AS high FROM orders GROUP BY o_orderpriority")
def medians(spark, sf_dir):
    orders = read(spark, sf_dir, "orders")
    low = stats.ranked_value(orders, ["o_orderpriority"], "o_totalprice", 0.5, "low", low=True)
    return low.join(stats.ranked_value(orders, ["o_orderpriority"], "o_totalprice", 0.5, "high"), "o_orderpriority")


@query("""
WITH h AS (SELECT l_returnflag AS k, (CAST(l_quantity AS BIGINT) * 5 + l_linenumber) % 256 AS b, count(*) AS n FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(n) OVER u AS w, sum(n * b) OVER u AS s, sum(n) OVER (PARTITION BY k) AS a, sum(n * b) OVER (PARTITION BY k) AS t FROM h WINDOW u AS (PARTITION BY k ORDER BY b)),
s AS (SELECT k, b, CASE WHEN a > w THEN w::DOUBLE * (a - w)::DOUBLE * pow(s::DOUBLE / w::DOUBLE - (t - s)::DOUBLE / (a - w)::DOUBLE, 2) END AS score FROM c)
SELECT k AS l_returnflag, CAST(b AS INTEGER) AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC NULLS LAST, b) AS r FROM s) WHERE r = 1""")
def otsu_threshold(spark, sf_dir):
    bins = read(spark, sf_dir, "lineitem").withColumn("bin", F.expr("(cast(l_quantity as bigint) * 5 + l_linenumber) % 256"))
    return stats.otsu(bins, ["l_returnflag"], "bin")


@query("""
WITH p AS (SELECT event_type, extract(hour FROM ts) / 11.5 - 1 AS t, value AS y FROM events),
m AS (SELECT event_type, count(*) AS n, sum(t*t*t*t) AS s4, sum(t*t) AS s2, sum(t*t*y) AS t2, sum(t*y) AS t1, sum(y) AS t0 FROM p GROUP BY event_type),
f AS (SELECT event_type, (t2 * n - t0 * s2) / (s4 * n - s2 * s2) AS a, t1 / greatest(1e-5, s2) AS b, (s4 * t0 - s2 * t2) / (s4 * n - s2 * s2) AS c, t0 / n AS mean FROM m),
r AS (SELECT event_type, any_value(a) AS a, any_value(b) AS b, any_value(c) AS c, 1 - sum(pow(y - (a*t*t + b*t + c), 2)) / sum(pow(y - mean, 2)) AS r2 FROM p JOIN f USING (event_type) GROUP BY event_type)
SELECT event_type, round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(r2, 6) AS r_squared, r2 >= 0.55 AND abs(a) >= 1.8 AS is_curve FROM r""")
def quadratic_fit(spark, sf_dir):
    points = read(spark, sf_dir, "events").select("event_type", (F.hour("ts") / 11.5 - 1).alias("t"), F.col("value").alias("y"))
    return stats.quadratic_fit(points, ["event_type"], "t", "y").select("event_type", *[rounded(c, F.col(c)) for c in ("a", "b", "c", "r_squared")], "is_curve")


_WEEKLY = "SELECT l_returnflag, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 7 AS week, count(*) AS n FROM lineitem GROUP BY ALL"


def _weekly(spark, sf_dir):
    at = F.floor(F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")) / 7)
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", at.alias("week")).agg(F.count("*").alias("n"))


@query(f"""
WITH d AS ({_WEEKLY})
SELECT l_returnflag, week, coalesce(n - lag(n) OVER w, 0) AS step,
       round(coalesce((lag(n, 2) OVER w + 2 * lag(n) OVER w + 3 * n + 2 * lead(n) OVER w + lead(n, 2) OVER w) / 9.0, 0), 6) AS smooth FROM d WINDOW w AS (PARTITION BY l_returnflag ORDER BY week)""")
def smoothed_profile(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_returnflag").orderBy("week")
    n = F.col("n")
    return _weekly(spark, sf_dir).select("l_returnflag", "week", F.coalesce(n - F.lag(n).over(w), F.lit(0)).alias("step"), rounded("smooth", stats.smoothed(n, w)))


@query(f"""
WITH d AS (SELECT *, avg(n) OVER (PARTITION BY l_returnflag) AS m FROM ({_WEEKLY})),
i AS (SELECT *, sum(CASE WHEN n >= m THEN 0 ELSE 1 END) OVER (PARTITION BY l_returnflag ORDER BY week) AS island FROM d)
SELECT l_returnflag, peak FROM (SELECT l_returnflag, island, arg_max(week, row(n, -week)) AS peak FROM i WHERE n >= m GROUP BY ALL)""")
def profile_peaks(spark, sf_dir):
    d = _weekly(spark, sf_dir)
    mean = d.groupBy("l_returnflag").agg(F.avg("n").alias("m"))
    return stats.peaks(d.join(mean, "l_returnflag"), ["l_returnflag"], "week", "n", F.col("m")).select("l_returnflag", "peak")


# Quality

_ASCII = "regexp_replace(t, '[^ -~]', '?')"


def _pairs(spark, sf_dir):
    rows = D.lines(spark, sf_dir, dirty=False).withColumn("expected", F.expr(_ASCII))
    return rows.withColumn("actual", F.expr("CASE line_ix % 4 WHEN 0 THEN expected WHEN 1 THEN replace(expected, 'th', 'ht') WHEN 2 THEN concat(expected, '  x') ELSE '' END"))


@query(f"""
WITH p AS (SELECT doc_id, line_ix, regexp_replace(t, '[^ -~]', '?', 'g') AS e FROM ({D.SQL_RAW_LINES})),
q AS (SELECT doc_id, line_ix, {D.sql_trim(D.sql_replace('e', chr(92) + 's+', ' '))} AS e, {D.sql_trim(D.sql_replace("CASE line_ix % 4 WHEN 0 THEN e WHEN 1 THEN replace(e, 'th', 'ht') WHEN 2 THEN concat(e, '  x') ELSE '' END", chr(92) + 's+', ' '))} AS a FROM p),
r AS (SELECT *, levenshtein(e, a) AS errors FROM q)
SELECT doc_id, line_ix, CAST(errors AS INTEGER) AS character_errors, CAST(length(e) AS INTEGER) AS reference_characters,
       round(CASE WHEN e = '' THEN (a <> '')::INT ELSE errors / length(e) END, 6) AS cer FROM r""")
def character_error_rate(spark, sf_dir):
    return quality.character_errors(_pairs(spark, sf_dir)).select("doc_id", "line_ix", "character_errors", "reference_characters", rounded("cer", F.col("cer")))


_SWAPPED = f"CASE line_ix % 4 WHEN 0 THEN e WHEN 1 THEN replace(e, 'th', 'ht') WHEN 2 THEN concat(e, '  x') ELSE '' END"
_MEASURED = f"""
WITH p AS (SELECT doc_id, line_ix, regexp_replace(t, '[^ -~]', '?', 'g') AS e FROM ({D.SQL_RAW_LINES})),
q AS (SELECT doc_id, line_ix, {D.sql_trim(D.sql_replace('e', chr(92) + 's+', ' '))} AS e, {D.sql_trim(D.sql_replace(_SWAPPED, chr(92) + 's+', ' '))} AS a FROM p),
s AS (SELECT *, CASE WHEN e = '' THEN [] ELSE string_split(e, ' ') END AS ew, CASE WHEN a = '' THEN [] ELSE string_split(a, ' ') END AS aw FROM q),
-- words are replaced, added at the end or all gone: none moves, so that the differing places are the fewest errors
r AS (SELECT *, levenshtein(e, a) AS errors, abs(len(ew) - len(aw)) + len(list_filter(list_zip(ew[1:least(len(ew), len(aw))], aw[1:least(len(ew), len(aw))]), lambda z: z[1] <> z[2])) AS word_errors FROM s),
m AS (SELECT *, CASE WHEN e = '' THEN (a <> '')::INT::DOUBLE ELSE errors / length(e) END AS cer, CASE WHEN len(ew) = 0 THEN (len(aw) > 0)::INT::DOUBLE ELSE word_errors / len(ew) END AS wer FROM r)
"""


@query(f"{_MEASURED} SELECT doc_id, line_ix, word_errors::INTEGER AS word_errors, len(ew)::INTEGER AS reference_words, round(wer, 6) AS wer, cer <= 0.02 AND wer <= 0.02 AS meets_threshold FROM m")
def word_error_rate(spark, sf_dir):
    got = quality.measured(_pairs(spark, sf_dir))
    ok = quality.meets_threshold(F.col("cer"), F.col("wer"), F.lit(0.02), F.lit(0.02))
    return got.select("doc_id", "line_ix", "word_errors", "reference_words", rounded("wer", F.col("wer")), ok.alias("meets_threshold"))


@query(f"{_MEASURED} SELECT doc_id || '-' || line_ix AS case, 0.01::DOUBLE AS baseline_cer, 0.01::DOUBLE AS baseline_wer, round(cer, 6) AS cer, round(wer, 6) AS wer FROM m WHERE cer > 0.01 OR wer > 0.01")
def quality_regressions(spark, sf_dir):
    got = quality.measured(_pairs(spark, sf_dir)).withColumn("case", F.concat_ws("-", "doc_id", "line_ix"))
    gate = D.lines(spark, sf_dir, dirty=False).select(F.concat_ws("-", "doc_id", "line_ix").alias("case"), F.lit(0.01).alias("cer"), F.lit(0.01).alias("wer"))
    return quality.regressions(gate, got, "case").select("case", "baseline_cer", "baseline_wer", rounded("cer", F.col("cer")), rounded("wer", F.col("wer")))


# Names, content, files


@query(f"""SELECT page_id, substr(coalesce(nullif({D.sql_trim(D.sql_replace(D.sql_replace("nfc_normalize(concat(CASE page_id % 3 WHEN 0 THEN chr(7) ELSE '' END, url, CASE page_id % 2 WHEN 0 THEN chr(8238) || 'e' || chr(769) ELSE ' ' END))", P.CONTROLS, ''), P.NAME_FORMATTING, ''))}, ''), '{text.NO_NAME}'), 1, 160) AS name FROM pages""")
def safe_names(spark, sf_dir):
    odd = F.expr("concat(CASE page_id % 3 WHEN 0 THEN '\u0007' ELSE '' END, url, CASE page_id % 2 WHEN 0 THEN '‮é' ELSE ' ' END)")
    return read(spark, sf_dir, "pages").select("page_id", text.safe_display_name(odd).alias("name"))


@query(f"SELECT page_id, md5({D.sql_replace('concat(html, chr(11), chr(133), chr(9))', P.CONTROLS, '')}) AS digest FROM pages")
def sanitized_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.sanitize_document_text(F.concat("html", F.lit("\x0b\x85\t")))).alias("digest"))


_CONTENT = "CASE page_id % 4 WHEN 0 THEN concat('%PDF-1.4', h) WHEN 1 THEN concat('xx%PDF-2.0', h) WHEN 2 THEN concat(substr(h, 1, 1010), '%PDF-1.7') ELSE h END"


@query(f"""SELECT page_id, CASE WHEN regexp_matches(substr({_CONTENT}, 1, 1024), '%PDF-1\\.[0-9]') THEN 'pdf' END AS kind FROM (SELECT page_id, regexp_replace(html, '[^ -~]', '?', 'g') AS h FROM pages)""")
def sniffed_kinds(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").withColumn("h", F.regexp_replace("html", "[^ -~]", "?"))
    return rows.select("page_id", files.sniff_kind(F.expr(_CONTENT).cast("binary")).alias("kind"))


@query("SELECT o_orderkey, 'scan-' || strftime(o_orderdate, '%Y-%m-%d') || '.pdf' AS name, 'data:text/plain;base64,' || to_base64(encode(o_orderpriority)) AS url FROM orders")
def output_names(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", encode.output_name("scan", F.col("o_orderdate"), "pdf").alias("name"), encode.data_url(F.col("o_orderpriority").cast("binary"), "text/plain").alias("url"))


@query("""
WITH RECURSIVE f AS (
  SELECT doc_id // 24 AS session, doc_id AS ord, row_number() OVER (PARTITION BY doc_id // 24 ORDER BY doc_id) AS n, CASE WHEN doc_id % 11 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN 'pdf' ELSE 'png' END AS kind,
         CASE WHEN doc_id % 11 <> 0 AND doc_id % 3 = 0 THEN list_transform(range(1, doc_id % 5 + 2), lambda i: n_chars * 1000 * i) ELSE [n_chars * 5000] END AS px FROM documents
),
s AS (
  SELECT session, 0::BIGINT AS n, 0::BIGINT AS pages, 0::BIGINT AS pixels, NULL::BIGINT AS ord, 0::BIGINT AS taken, NULL::VARCHAR AS error FROM f GROUP BY session
  UNION ALL
  SELECT session, n, pages + CASE WHEN error IS NULL THEN k ELSE 0 END, pixels + CASE WHEN error IS NULL THEN more ELSE 0 END, ord, CASE WHEN error IS NULL THEN k ELSE 0 END, error FROM (
    SELECT *, CASE WHEN n > 20 THEN 'page limit' WHEN kind IS NULL THEN 'unknown format' WHEN pixels + more > 160000000 THEN 'pixel budget' END AS error FROM (
      SELECT f.session, f.n, s.pages, s.pixels, f.ord, f.kind, len(f.px[1:CASE WHEN f.kind = 'pdf' THEN greatest(0, 20 - s.pages) ELSE 1 END])::BIGINT AS k,
             coalesce(list_sum(f.px[1:CASE WHEN f.kind = 'pdf' THEN greatest(0, 20 - s.pages) ELSE 1 END]), 0)::BIGINT AS more FROM s JOIN f ON f.session = s.session AND f.n = s.n + 1
    ))
)
SELECT session, ord, taken::INTEGER AS taken, error FROM s WHERE n > 0""")
def session_budget(spark, sf_dir):
    docs = D.documents(spark, sf_dir)
    kind = F.when(F.col("doc_id") % 11 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 0, "pdf").otherwise("png")
    pixels = F.when(kind == "pdf", F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 5 + 1).cast("int")), lambda i: F.col("n_chars") * 1000 * i)).otherwise(F.array(F.col("n_chars") * 5000))
    rows = docs.select(F.floor(F.col("doc_id") / 24).alias("session"), F.col("doc_id").alias("ord"), kind.alias("kind"), pixels.alias("page_pixels"))
    return session.imported(rows, ["session"])


@query("""SELECT source, bool_or(doc_id % 5 = 0 OR doc_id % 3 = 0) AS needs_ocr FROM documents GROUP BY source""")
def export_needs_ocr(spark, sf_dir):
    rows = D.documents(spark, sf_dir).select(F.col("source").alias("session_id"), F.when(F.col("doc_id") % 5 == 0, "scan").otherwise("document").alias("kind"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"))
    return session.export_needs_ocr(rows).withColumnRenamed("session_id", "source")


# Settings and geometry: numbers of lineitem as inputs


def _numbers(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("l_discount").alias("d"), F.col("l_tax").alias("t"), (F.col("l_extendedprice") % 256).alias("e"))


_N = "SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount AS d, l_tax AS t, l_extendedprice % 256 AS e FROM lineitem"
_ID = ("l_orderkey", "l_linenumber")


@query(f"""
WITH n AS ({_N}), s AS (SELECT *, CASE CAST(q AS BIGINT) % 4 WHEN 0 THEN 'original' WHEN 1 THEN 'enhanced' WHEN 2 THEN 'grayscale' ELSE 'bw' END AS f FROM n)
SELECT l_orderkey, l_linenumber, f AS filter, CASE WHEN f = 'original' THEN 0.0 ELSE 22.0 END::DOUBLE AS contrast, greatest(42.0, CASE WHEN f = 'original' THEN 0 ELSE 28 END)::DOUBLE AS remove_shadow,
       least(22.0, CASE WHEN f = 'original' THEN 0 ELSE 18 END)::DOUBLE AS sharpen, (CAST(q AS BIGINT) * 90 - 90 + 360) % 360 AS rotation,
       CASE WHEN f = 'original' THEN 'grayscale(0) contrast(100%) brightness(100%)' ELSE 'none' END AS css FROM s""")
def settings_presets(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("original", "enhanced", "grayscale", "bw"))), (F.col("q").cast("long") % 4 + 1).cast("int"))
    rows = _numbers(spark, sf_dir).withColumn("s", session.preset(name)).withColumn("v", session.ocr_variant(F.col("s"), "grayscale"))
    return rows.select(*_ID, "s.filter", "s.contrast", F.col("v.removeShadow").alias("remove_shadow"), "v.sharpen", session.rotated(F.col("q").cast("long") * 90, -90).alias("rotation"), G.css_filter(F.col("s")).alias("css"))


@query("""SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'O' THEN 1800 WHEN 'F' THEN 4800 ELSE 3200 END AS INTEGER) AS max_edge, CASE o_orderstatus WHEN 'O' THEN 0.82 WHEN 'F' THEN 0.98 ELSE 0.93 END::DOUBLE AS jpeg_quality,
  CAST(CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 200000 THEN 15 ELSE 8 END AS INTEGER) AS margin_mm, '4' AS segmentation FROM orders""")
def export_numbers(spark, sf_dir):
    quality_ = F.when(F.col("o_orderstatus") == "O", "compact").when(F.col("o_orderstatus") == "F", "high").otherwise("balanced")
    margin = F.when(F.col("o_totalprice") < 100000, "none").when(F.col("o_totalprice") < 200000, "large").otherwise("small")
    return read(spark, sf_dir, "orders").select("o_orderkey", session.export_numbers(quality_, margin, F.lit("auto")).alias("n")).select("o_orderkey", "n.*")


def _corners():
    q, d, t = F.col("q"), F.col("d"), F.col("t")
    return F.array(G.point(d, t), G.point(1 - t, d / 1.9), G.point(0.9 + d, 0.8 + t + q / 997.0), G.point(t / 1.9, 0.9 - d))


_C = "d AS x0, t AS y0, 1 - t AS x1, d / 1.9 AS y1, 0.9 + d AS x2, 0.8 + t + q / 997.0 AS y2, t / 1.9 AS x3, 0.9 - d AS y3"


@query(f"""
WITH c AS (SELECT l_orderkey, l_linenumber, e / 256 AS u, q / 50 AS v, {_C} FROM ({_N})),
k AS (SELECT *, x1 - x2 AS ax, x3 - x2 AS bx, x0 - x1 + x2 - x3 AS sx, y1 - y2 AS ay, y3 - y2 AS by_, y0 - y1 + y2 - y3 AS sy FROM c),
h AS (SELECT *, (sx * by_ - bx * sy) / (ax * by_ - bx * ay) AS g, (ax * sy - sx * ay) / (ax * by_ - bx * ay) AS h FROM k)
SELECT l_orderkey, l_linenumber, round((x0 + (x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v) / (1 + g * u + h * v), 6) AS x,
       round((y0 + (y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v) / (1 + g * u + h * v), 6) AS y,
       round(abs((((x0*y1 - x1*y0) + (x1*y2 - x2*y1)) + (x2*y3 - x3*y2)) + (x3*y0 - x0*y3)) / 2, 6) AS area, round(sqrt(pow((x0 - x2) * 1000, 2) + pow((y0 - y2) * 800, 2)), 6) AS diagonal,
       round(greatest(0.005, least(0.995, x2)), 6) AS clamped FROM h""")
def homography_points(spark, sf_dir):
    rows = _numbers(spark, sf_dir).withColumn("c", _corners()).withColumn("p", G.project_unit(F.col("c"), F.col("e") / 256, F.col("q") / 50))
    at = lambda k: F.get("c", F.lit(k))
    return rows.select(
        *_ID, rounded("x", F.col("p.x")), rounded("y", F.col("p.y")), rounded("area", G.polygon_area(F.col("c"))),
        rounded("diagonal", G.scaled_distance(at(0), at(2), F.lit(1000.0), F.lit(800.0))), rounded("clamped", F.get(G.clamp_corners(F.col("c")), F.lit(2))["x"]),
    )


@query(f"""
WITH n AS (SELECT *, cos(q / 10) AS a1, sin(q / 10) AS b1, e AS c1, cos(d * 10) AS a2, sin(d * 10) AS b2, q AS c2 FROM ({_N})), m AS (SELECT *, a1 * b2 - a2 * b1 AS det FROM n)
SELECT l_orderkey, l_linenumber, CASE WHEN abs(det) >= 0.08 THEN round((c1 * b2 - c2 * b1) / det, 6) END AS x, CASE WHEN abs(det) >= 0.08 THEN round((a1 * c2 - a2 * c1) / det, 6) END AS y,
  round(e * (0.4 + 0.6 * least(1, greatest(0, least(d * 10, 1 - d * 10)) / 0.1)) * (0.82 + greatest(-0.15, least(0.65, (e - q) / 45))), 6) AS score FROM m""")
def line_intersections(spark, sf_dir):
    line = lambda a, c: F.struct(F.cos(a).alias("a"), F.sin(a).alias("b"), c.alias("c"))
    rows = _numbers(spark, sf_dir)
    p = G.intersection(line(F.col("q") / 10, F.col("e")), line(F.col("d") * 10, F.col("q")))
    score = G.boundary_score(F.col("e"), F.col("d") * 10, F.col("e"), F.col("q"))
    return rows.select(*_ID, rounded("x", p["x"]), rounded("y", p["y"]), rounded("score", score))


@query(f"""
WITH n AS (SELECT *, e AS r, (e * 3 + q) % 256 AS g, (e * 7 + q * 2) % 256 AS b, greatest(18, q * 5) AS paper FROM ({_N})),
m AS (SELECT *, r * 0.299 + g * 0.587 + b * 0.114 AS tone, greatest(r, g, b) - least(r, g, b) AS chroma, greatest(0, least(1, (225 - paper) / 110)) AS deep FROM n)
SELECT l_orderkey, l_linenumber, round(tone, 6) AS tone, chroma >= 28 AND chroma / greatest(1, r, g, b) >= 0.18 AS keeps_color, chroma <= 22 AS neutral,
  round(r * (1 - d * 10) + (r * 242 / paper * (1 - deep) + (r + 242 - paper) * deep) * d * 10, 6) AS unshadowed, round(0.9 * (1 - greatest(0, least(0.92, (g - r - 12) / 42))), 6) AS held,
  round(least(r, r * 0.8 + b * 0.2), 6) AS sharp, round(r * least(190, tone * 1.08 + q * 0.12) / greatest(1, tone), 6) AS restored,
  NOT (chroma >= 30 AND tone >= 42) AND tone <= 172 AND (g >= 220 OR g - tone >= greatest(14, 22 - q * 0.12)) AS ink,
  chroma >= 24 AND q <= 155 AND tone - q >= 14 AS dark_ink FROM m""")
def tone_functions(spark, sf_dir):
    rows = _numbers(spark, sf_dir).select("*", F.col("e").alias("r"), ((F.col("e") * 3 + F.col("q")) % 256).alias("g"), ((F.col("e") * 7 + F.col("q") * 2) % 256).alias("b"))
    r, g, b, q, d = (F.col(c) for c in ("r", "g", "b", "q", "d"))
    tone = G.luminance(r, g, b)
    gray = (q, q, q)
    return rows.select(
        *_ID, rounded("tone", tone), G.keeps_color(r, g, b).alias("keeps_color"), G.is_neutral(r, g, b).alias("neutral"),
        rounded("unshadowed", G.shadow_channel(r, q * 5, d * 10)), rounded("held", G.ink_protected(F.lit(0.9), r, g)),
        rounded("sharp", G.sharpened(r, b, F.lit(0.2), F.lit(True))), rounded("restored", G.restored_surface(r, tone, q)),
        G.black_white_ink(tone, G.chroma(r, g, b), g, F.lit(172), q).alias("ink"), G.dark_ink_on_color(gray, (r, g, b)).alias("dark_ink"),
    )


@query(f"""
WITH n AS (SELECT *, 500 + e * 4 AS w, 300 + q * 30 AS h, CASE CAST(q AS BIGINT) % 3 WHEN 0 THEN 'fit' WHEN 1 THEN 'letter' ELSE 'a4' END AS size FROM ({_N})),
s AS (SELECT *, CASE size WHEN 'fit' THEN w * 297 / greatest(w, h) WHEN 'letter' THEN 215.9 ELSE 210 END AS sw, CASE size WHEN 'fit' THEN h * 297 / greatest(w, h) WHEN 'letter' THEN 279.4 ELSE 297 END AS sh FROM n),
r AS (SELECT *, least((sw - 16) / w, (sh - 16) / h) AS k, greatest(8, floor((10 + q) * 0.45 + 0.5)) AS pad FROM s)
SELECT l_orderkey, l_linenumber, round(sw, 6) AS sheet_w, round(sh, 6) AS sheet_h, round((sw - w * k) / 2, 6) AS x, round((sh - h * k) / 2, 6) AS y, round(w * k, 6) AS w, round(h * k, 6) AS h,
  CAST(greatest(0, floor(e - pad)) AS BIGINT) AS rect_left, CAST(least(200, ceil(100 + pad * 2)) AS BIGINT) AS rect_width FROM r""")
def page_geometry(spark, sf_dir):
    rows = _numbers(spark, sf_dir).select("*", (500 + F.col("e") * 4).alias("w"), (300 + F.col("q") * 30).alias("h"))
    size = F.element_at(F.array(F.lit("fit"), F.lit("letter"), F.lit("a4")), (F.col("q").cast("long") % 3 + 1).cast("int"))
    box = F.struct(F.col("e").alias("x0"), F.lit(50.0).alias("y0"), (F.col("e") + 100).alias("x1"), (60 + F.col("q")).alias("y1"))
    fit, rect = G.page_fit(F.col("w"), F.col("h"), size, F.lit(8)), G.retry_rectangle(box, F.lit(200), F.lit(200))
    rows = rows.select(*_ID, fit.alias("f"), rect.alias("r"))
    return rows.select(*_ID, *[rounded(n, F.col(f"f.{n}")) for n in ("sheet_w", "sheet_h", "x", "y", "w", "h")], F.col("r.left").cast("long").alias("rect_left"), F.col("r.width").cast("long").alias("rect_width"))


@query("""
WITH t AS (SELECT o_orderpriority AS p, list_sort(list(o_totalprice % 256)) AS v, count(*) AS n FROM orders GROUP BY 1), q AS (SELECT p, n, v[floor(n * 0.08)::INT + 1] AS dark, v[floor(n * 0.62)::INT + 1] AS usual FROM t)
SELECT p AS o_orderpriority, CASE WHEN n < 16 THEN 0 ELSE round(least(1, greatest(0, (188 - dark) / 105, (usual - dark - 38) / 105)), 6) END AS severity FROM q""")
def shadow_severity(spark, sf_dir):
    tones = read(spark, sf_dir, "orders").select("o_orderpriority", (F.col("o_totalprice") % 256).alias("v"))
    dark, usual = (stats.ranked_value(tones, ["o_orderpriority"], "v", ratio, name) for ratio, name in ((0.08, "dark"), (0.62, "usual")))
    n = tones.groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    severity = G.severity_of(F.col("dark"), F.col("usual"), F.col("n"))
    return dark.join(usual, "o_orderpriority").join(n, "o_orderpriority").select("o_orderpriority", rounded("severity", severity))


@query("""SELECT page_id, CASE WHEN c >= 0.58 THEN 'found' ELSE 'current' END AS corners, CASE WHEN c >= 0.58 THEN w WHEN w IS NULL THEN 'Kiểm tra 4 góc' WHEN contains(w, 'Kiểm tra 4 góc') THEN w ELSE w || ' · Kiểm tra 4 góc' END AS warning
FROM (SELECT page_id, page_id % 10 / 10 AS c, CASE page_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE 'Kiểm tra 4 góc' END AS w FROM pages)""")
def accepted_corners(spark, sf_dir):
    warning = F.when(F.col("page_id") % 3 == 0, F.lit(None).cast("string")).when(F.col("page_id") % 3 == 1, "x").otherwise("Kiểm tra 4 góc")
    got = session.accepted_corners(F.lit("found"), F.col("page_id") % 10 / 10, F.lit("current"), warning)
    return read(spark, sf_dir, "pages").select("page_id", got["corners"].alias("corners"), got["warning"].alias("warning"))


# Images and files


@query()
def image_quality(spark, sf_dir):
    return image.qualities(D.synthetic_images(spark, sf_dir), ("page_id",))


@query()
def image_corners(spark, sf_dir):
    return image.detected_corners(D.synthetic_images(spark, sf_dir), ("page_id",))


@query("SELECT page_id, CASE WHEN page_id % 3 > 0 THEN [40, 130 + page_id % 20, 240]::INTEGER[] END AS x_lines, CASE WHEN page_id % 3 > 0 THEN [30, 110 + page_id % 15, 200, 270]::INTEGER[] END AS y_lines FROM pages")
def image_table_grid(spark, sf_dir):
    return image.table_grids(D.ruled_images(spark, sf_dir), ("page_id",))


def _rendered(spark, sf_dir):
    found = D.synthetic_images(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, ("original", "enhanced", "grayscale", "bw"))), (F.col("page_id") % 4 + 1).cast("int"))
    corners = F.expr("array(named_struct('x', 0.1D, 'y', 0.08D), named_struct('x', 0.9D, 'y', 0.1D), named_struct('x', 0.92D, 'y', 0.9D), named_struct('x', 0.08D, 'y', 0.92D))")
    return found.withColumns({"corners": corners, "settings": session.preset(name), "rotation": (F.col("page_id") % 4 * 90).cast("int"), "fine_rotation": F.lit(0.0), "dewarp": F.lit(True)})


@query()
def rendered_pages(spark, sf_dir):
    done = image.rendered_pages(_rendered(spark, sf_dir), ("page_id",), session.MAX_EDGE["balanced"])
    return done.select("page_id", "page.width", "page.height", F.md5("page.data").alias("digest"))


@query("SELECT page_id // 5 AS doc_id, 'pdf' AS kind, count(*)::INTEGER AS n_pages FROM pages GROUP BY page_id // 5")
def scan_documents(spark, sf_dir):
    pages = _rendered(spark, sf_dir).withColumns({"doc_id": F.floor(F.col("page_id") / 5), "page_no": (F.col("page_id") % 5).cast("int")})
    content = F.col("content")
    return pipelines.scan_from_image(pages).select("doc_id", files.sniff_kind(content).alias("kind"), pdf.page_count(content).alias("n_pages"))


@query(f"""{D.SQL_REFLOWED}
SELECT doc_id, count(*) FILTER (kind <> 'table')::INTEGER AS n_paragraphs, count(*) FILTER (kind = 'table')::INTEGER AS n_tables, sum(length({D.sql_replace('text', P.CONTROLS, '')})) FILTER (kind <> 'table')::BIGINT AS n_characters FROM reflowed GROUP BY doc_id""")
def word_documents(spark, sf_dir):
    return pipelines.pdf_to_word(D.pdf_pages(spark, sf_dir)).select("doc_id", docx.package_counts(F.col("content")).alias("c")).select("doc_id", "c.n_paragraphs", "c.n_tables", F.nullif("c.n_characters", F.lit(0)).alias("n_characters"))


@query(f"""{_CLEANED_LINES},
d AS (SELECT *, lag(lower(text)) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM (SELECT doc_id, ord, {D.sql_normal('text')} AS text FROM c) WHERE text <> ''),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS n FROM d WHERE before IS NULL OR before <> lower(text)),
e AS (SELECT *, CASE WHEN {D.sql_matches('text', P.REQUEST)} THEN 'heading' WHEN {D.sql_matches('text', P.NUMBERED)} THEN 'list-item' WHEN n = 1 AND length(text) <= 180 THEN 'title' ELSE 'paragraph' END AS kind FROM t),
g AS (SELECT *, CASE WHEN kind = 'paragraph' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY ord) = 'paragraph' THEN 0 ELSE 1 END AS opens FROM e),
b AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY ord) AS block FROM g),
w AS (SELECT doc_id, block, {D.sql_normal("string_agg(text, ' ' ORDER BY ord)")} AS text FROM b GROUP BY doc_id, block)
SELECT doc_id, count(*)::INTEGER AS n_paragraphs, sum(length(text))::BIGINT AS n_characters FROM w GROUP BY doc_id""")
def prose_documents(spark, sf_dir):
    rows = _curved_lines(spark, sf_dir).select("doc_id", F.col("line_ix").alias("ord"), F.col("t").alias("text"))
    return pipelines.prose_to_word(rows).select("doc_id", docx.package_counts(F.col("content")).alias("c")).select("doc_id", "c.n_paragraphs", "c.n_characters")


@query("""
WITH l AS (SELECT doc_id, line_ix AS ord, t AS text, 842.0 / 2000 AS k FROM (""" + D.SQL_RAW_LINES + """))
SELECT doc_id, ord, round(50 * k, 6) AS x, round((2000 - line_ix_y1) * k, 6) AS y, round(greatest(1, least(20 * 0.82, 900 / greatest(1, length(text) * 0.5))) * k, 6) AS size
FROM (SELECT *, ord * 24 + 20 AS line_ix_y1 FROM l)""")
def text_placements(spark, sf_dir):
    y0 = F.col("line_ix") * 24.0
    box = F.struct(F.lit(50.0).alias("x0"), y0.alias("y0"), F.lit(950.0).alias("x1"), (y0 + 20).alias("y1"))
    rows = D.lines(spark, sf_dir, dirty=False).select("doc_id", F.col("line_ix").alias("ord"), F.col("t").alias("text"), box.alias("bbox"), F.lit(1400).alias("page_width"), F.lit(2000).alias("page_height"))
    return pdf.text_placements(rows, ["doc_id"]).select("doc_id", "ord", *[rounded(c, F.col(c)) for c in ("x", "y", "size")])


@query("SELECT source, count(*) > 0 AS image_needs_ocr, bool_or(doc_id % 5 = 0) AS pdf_images_need_ocr, bool_or(doc_id % 5 = 0 OR doc_id % 3 = 0) AS word_needs_ocr FROM documents GROUP BY source")
def workflow_contracts(spark, sf_dir):
    rows = D.documents(spark, sf_dir).select(F.col("source").alias("session_id"), F.when(F.col("doc_id") % 5 == 0, "scan").otherwise("document").alias("kind"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("text"))
    return pipelines.contracts(rows).withColumnRenamed("session_id", "source")


@query("SELECT doc_id, CAST(CASE WHEN size < 18 THEN 18 WHEN size > 42 THEN 42 ELSE size END AS INTEGER) AS half_points FROM (SELECT doc_id, floor((5 + doc_id % 20) * 2 + 0.5) AS size FROM documents)")
def word_font_sizes(spark, sf_dir):
    return D.documents(spark, sf_dir).select("doc_id", docx.half_points((5 + F.col("doc_id") % 20).cast("double")).alias("half_points"))
