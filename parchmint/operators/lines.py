"""Recognised lines of a page: choice among passes, duplicates, reading order, paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmint import schemas
from parchmint.functions import patterns as P
from parchmint.functions.arrays import box_union, empty, last, let, sorted_by
from parchmint.functions.stats import ranked_value
from parchmint.functions.text import is_suspicious, matches, measured_text, normalize_text, replaced, score_of

BAND, SAME_ROW, FRAGMENT = 1.15, 0.8, 0.72


def _center(box: Column) -> Column:
    return (box["y0"] + box["y1"]) / 2


def _height(box: Column) -> Column:
    return F.greatest(F.lit(1.0), box["y1"] - box["y0"])


def best_lines(lines: DataFrame, keys: list[str], composed: bool = False, normal: str | None = None) -> DataFrame:
    """For each line of a page's first pass with lines, the best-scored line of any pass at its height; the line itself wins ties.

    lines: keys, pass_ix, ord, text (composed: in NFC already), confidence, bbox and more. Result: keys, anchor_ord, anchor_bbox and
    all columns of the chosen line, with its normalised text as the column `normal`, if that is named.
    The band join gets an equality key: bands of the page's largest reach, each anchor looking at its own and both neighbours.
    """
    rows = lines.withColumns({"_c": _center(F.col("bbox")), "_h": _height(F.col("bbox")), "_measured": measured_text(F.col("text"), composed)})
    rows = rows.withColumn("_score", score_of(F.col("_measured"), F.col("confidence")))
    rows = (rows.withColumn(normal, F.col("_measured.text")) if normal else rows).drop("_measured")
    page = rows.groupBy(*keys).agg(F.max("_h").alias("_top"), F.min("pass_ix").alias("_first"))
    rows = rows.join(page, keys).withColumn("_band", F.floor(F.col("_c") / (F.col("_top") * BAND)))
    anchors = rows.filter(F.col("pass_ix") == F.col("_first")).select(*keys, F.col("ord").alias("anchor_ord"), F.col("bbox").alias("anchor_bbox"), F.col("_c").alias("_ac"), F.col("_h").alias("_ah"), F.col("_first").alias("_pass"), F.explode(F.sequence(F.col("_band") - 1, F.col("_band") + 1)).alias("_band"))
    near = anchors.join(rows, [*keys, "_band"]).filter(F.abs(F.col("_c") - F.col("_ac")) <= F.greatest("_h", "_ah") * BAND)
    own = (F.col("pass_ix") == F.col("_pass")) & (F.col("ord") == F.col("anchor_ord"))
    best = Window.partitionBy(*keys, "anchor_ord").orderBy(F.desc("_score"), F.desc(own), "pass_ix", "ord")
    return near.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").select(*keys, "anchor_ord", "anchor_bbox", *[c for c in lines.columns if c not in keys], *[normal] * bool(normal))


def without_repeats(lines: DataFrame, keys: list[str], order: str, composed: bool = False, normal: str | None = None) -> DataFrame:
    """Lines (composed: in NFC already; normal: a column with their normalised text) for which no earlier line of the page has the same normalised text at the same height."""
    rows = lines.withColumn("_same", F.lower(F.col(normal) if normal else normalize_text(F.col("text"), composed)))
    before = rows.select(*keys, "_same", F.col(order).alias("_before"), F.col("bbox").alias("_box"))
    height = F.greatest(_height(F.col("bbox")), _height(F.col("_box")))
    earlier = (F.col("_before") < F.col(order)) & (F.abs(_center(F.col("bbox")) - _center(F.col("_box"))) <= height * SAME_ROW)
    on = [rows[k] == before[k] for k in (*keys, "_same")]
    condition = on[0]
    for c in (*on[1:], earlier):
        condition = condition & c
    return rows.join(before, condition, "left_anti").drop("_same")


def selected_lines(passes: DataFrame, keys: list[str], composed: bool = False, normal: str | None = None) -> DataFrame:
    """The best lines of a page's passes without repeats, numbered (ord) from top to bottom and left to right.

    Repeats are looked for in the order of the lines that they were chosen for, the reading order of the first pass. With `normal`
    their normalised text is a column of that name.
    """
    fresh = normal or "_normal"
    best = best_lines(passes, keys, composed, fresh).withColumn("_at", F.row_number().over(in_reading_order(keys, "anchor_bbox", "anchor_ord")))
    kept = without_repeats(best, keys, "_at", normal=fresh)
    return kept.withColumn("ord", (F.row_number().over(in_reading_order(keys, "bbox", "_at")) - 1).cast("long")).drop("_at", "anchor_ord", "anchor_bbox", *["_normal"] * (not normal))


def in_reading_order(keys: list[str], box: str = "bbox", ordinal: str = "ord"):
    """Window of a page's lines from top to bottom and left to right."""
    return Window.partitionBy(*keys).orderBy(F.col(box)["y0"], F.col(box)["x0"], ordinal)


def without_consecutive(lines: DataFrame, keys: list[str], order: str, text: str = "text", composed: bool = False, normal: str | None = None) -> DataFrame:
    """Normalised lines (normal: the column that has them normalised already) that are not empty and differ, but for case, from the one before."""
    rows = lines.withColumn(text, F.col(normal) if normal else normalize_text(F.col(text), composed)).filter(F.col(text) != "")
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(F.lower(text)).over(w)
    return rows.withColumn("_again", F.coalesce(before == F.lower(text), F.lit(False))).filter(~F.col("_again")).drop("_again")


def structured(lines: DataFrame, keys: list[str], order: str, text: str = "text") -> DataFrame:
    """Title, headings, list items and paragraphs (neighbouring lines joined): keys, block, kind, text."""
    rows = without_consecutive(lines, keys, order, text)
    w = Window.partitionBy(*keys).orderBy(order)
    first = F.row_number().over(w) == 1
    kind = F.when(matches(F.col(text), P.REQUEST), "heading").when(matches(F.col(text), P.NUMBERED), "list-item")
    rows = rows.withColumn("kind", kind.when(first & (F.length(text) <= 180), "title").otherwise("paragraph"))
    goes_on = (F.col("kind") == "paragraph") & (F.lag("kind").over(w) == "paragraph")
    rows = rows.withColumn("block", F.sum(F.when(goes_on, 0).otherwise(1)).over(w))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda s: s[text]), " ")
    return rows.groupBy(*keys, "block", "kind").agg(normalize_text(whole).alias("text")).select(*keys, "block", "kind", "text")


def paragraph_groups(lines: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Adds paragraph: a new one begins where the gap above a line is wide for its height and for the page."""
    w = Window.partitionBy(*keys).orderBy(order)
    gap = F.col("bbox")["y0"] - F.lag(F.col("bbox")["y1"]).over(w)
    tall = F.greatest(F.lit(8.0), F.col("bbox")["y1"] - F.col("bbox")["y0"])
    rows = lines.withColumns({"_gap": gap, "_tall": tall}).withColumn("_pair", F.greatest("_tall", F.lag("_tall").over(w)))
    usual = ranked_value(rows.filter("_gap IS NOT NULL").withColumn("_gap", F.greatest(F.lit(0.0), "_gap")), keys, "_gap", 0.5, "_usual")
    rows = rows.join(usual, keys, "left")
    breaks = F.col("_gap") > F.greatest(F.col("_pair") * 1.45, F.coalesce("_usual", F.lit(0.0)) * 1.65)
    return rows.withColumn("paragraph", F.sum(F.when(breaks, 1).otherwise(0)).over(w)).drop("_gap", "_tall", "_pair", "_usual")


def suspicious_lines(lines: DataFrame, keys: list[str], order: str, most: int = 10) -> DataFrame:
    """The first `most` lines of each page that deserve another look."""
    found = lines.filter(is_suspicious(F.col("text"), F.col("confidence")))
    return found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("rank") <= most)


def clean_page_lines(lines: Column, kind: str = "string", field: str | None = None) -> Column:
    """A page's lines (array of normalised strings) with the reading order of a known curved-page damage repaired.

    field: the lines are structs of type `kind`, whose other fields stay with the text in this one.
    """
    text = lambda x: x[field] if field else x

    def of(lines: Column) -> Column:
        def repaired(x: Column, i: Column) -> Column:
            line = text(x)
            turned = F.concat(F.lit("In "), F.regexp_extract(line, P.java(P.ROTATED), 2), F.lit(" "), F.regexp_extract(line, P.java(P.ROTATED), 1), F.lit(" But"))
            line = F.when(matches(line, P.ROTATED), turned).otherwise(line)
            start = F.greatest(i - 2, F.lit(0))
            found = F.exists(F.slice(lines, start + 1, i + 3 - start), lambda t: matches(text(t), P.LATER_SUFFIX))
            line = F.when(matches(line, P.ENDS_WITH_SO) & found, replaced(line, r"(?i)So$", "Sooner or later,")).otherwise(line)
            return x.withField(field, line) if field else line

        return F.transform(lines, repaired)

    def step(out: Column, x: Column) -> Column:
        orphan = matches(text(x), r"(?i)^Soon$") & F.coalesce(F.endswith(text(last(out)), F.lit("Sooner or later,")), F.lit(False))
        return F.when(matches(text(x), P.LATER_FRAGMENT) | orphan, out).otherwise(F.concat(out, F.array(x)))

    return F.aggregate(let(F.filter(lines, lambda x: text(x) != ""), of), empty(kind), step)


MERGED = f"struct<text:string,confidence:double,bbox:{schemas.BOX},words:array<{schemas.WORD}>,center:double,height:double,members:int>"


def merged_fragments(lines: Column) -> Column:
    """A page's OCR_LINEs with fragments of one row merged: each joins the last row whose running mean height is near."""

    def step(rows: Column, line: Column) -> Column:
        tall, center = _height(line["bbox"]), _center(line["bbox"])
        near = F.transform(rows, lambda r: F.abs(center - r["center"]) <= F.greatest(tall, r["height"]) * FRAGMENT)
        at = F.size(rows) + 1 - F.array_position(F.reverse(near), F.lit(True)).cast("int")  # 1-based, of the last; size + 1 for none

        def joined(r: Column) -> Column:
            words = sorted_by(F.concat(r["words"], line["words"]), lambda w: w["bbox"]["x0"])
            n = r["members"]
            mean = F.aggregate(words, F.lit(0.0), lambda a, w: a + w["confidence"]) / F.greatest(F.lit(1), F.size(words))
            return F.struct(
                F.array_join(F.transform(words, lambda w: w["text"]), " ").alias("text"), mean.alias("confidence"), box_union(r["bbox"], line["bbox"]).alias("bbox"), words.alias("words"),
                ((r["center"] * n + center) / (n + 1)).alias("center"), ((r["height"] * n + tall) / (n + 1)).alias("height"), (n + 1).alias("members"),
            )

        new = F.struct(*[line[n].alias(n) for n in ("text", "confidence", "bbox", "words")], center.alias("center"), tall.alias("height"), F.lit(1).alias("members"))
        put = F.transform(rows, lambda r, i: F.when(i + 1 == at, joined(r)).otherwise(r))
        return F.when(at <= F.size(rows), put).otherwise(F.concat(rows, F.array(new)))

    by_place = (lambda x: x["bbox"]["y0"], lambda x: x["bbox"]["x0"])
    rows = F.aggregate(sorted_by(lines, *by_place), empty(MERGED), step)
    whole = F.transform(rows, lambda r: F.struct(*[r[n].alias(n) for n in ("text", "confidence", "bbox", "words")]))
    return sorted_by(whole, *by_place)


