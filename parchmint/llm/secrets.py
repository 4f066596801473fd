"""Operator 5, secret scans over an incremental blob ledger. DataFrame functions only.

Every version of every document is content-addressed by SHA-256. Only pairs of blob and rule version that the ledger
lacks are scanned, once each, and the findings are joined back to all paths (doc_ids) of the blob. A match's place is the
sum of what lies before it: split() gives the text between matches and regexp_extract_all() the matches.

Defined results: null and empty texts have no spans; repeated rows give repeated rows; a null doc_id is kept; extra columns
are ignored. Places are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmint.functions.arrays import let
from parchmint.llm.common import HOT_SHARE, joined_to_unique, materialize, table, unused

RULE_VERSION = "1"
BLOCK = 1024  # matches of a text that are folded or cut out at once


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str  # means the same in Java and RE2
    group: int  # whose length counts
    least: int  # shorter matches are dropped, after matching
    base: bool = True


# The kinds in the order in which they are listed. A run of hexadecimal digits or of an access key is one
# match whole, so its least length stands in the pattern and short runs, which prose is full of, are never listed.
RULES = (
    Rule("assign", r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}", 0, 40, base=False),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, base=False),
)


def running(values: Column, start: int, more) -> Column:
    """more() of start and all values up to each, for an array of ints. In blocks, so that a long array is not copied at each step."""

    def folded(block: Column, at: Column) -> Column:
        step = lambda acc, x: F.struct(more(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(more(acc["at"], x))).alias("out"))
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def in_blocks(v: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))

    def whole(blocks: Column) -> Column:
        ends = folded(F.transform(blocks, lambda b: F.aggregate(b, F.lit(start), more)), F.lit(start))
        return let(F.concat(F.array(F.lit(start)), ends), lambda at: F.flatten(F.transform(blocks, lambda b, k: folded(b, F.get(at, k)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(in_blocks(v), whole)).otherwise(v))


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array of struct(start, kind_order, kind, end, counted) of one rule's matches in a text."""
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)), F.length)
    counted = whole if rule.group == 0 else F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)), F.length)
    each = F.arrays_zip(F.slice(between, 1, F.size(whole)).alias("gap"), whole.alias("n"), counted.alias("c"))

    def span(x: Column, end: Column) -> Column:
        return F.struct((end - x["n"]).alias("start"), F.lit(order).alias("kind_order"), F.lit(rule.kind).alias("kind"), end.alias("end"), x["c"].alias("counted"))

    def placed(e: Column) -> Column:
        ends = running(F.transform(e, lambda x: x["gap"] + x["n"]), 0, lambda a, x: a + x)
        return F.filter(F.zip_with(e, ends, span), lambda s: s["counted"] >= rule.least)

    none = F.array().cast("array<struct<start:int,kind_order:int,kind:string,end:int,counted:int>>")
    return F.when(text.rlike(rule.pattern), let(each, placed)).otherwise(none)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The sorted spans of all rules in place of the text of blobs (sha, text)."""
    each = F.concat(*[spans_of(F.col("text"), r, i) for i, r in enumerate(rules)])
    return blobs.select(*[c for c in blobs.columns if c != "text"], F.array_sort(each).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(new ledger rows (sha, rule_version, spans), paths with their spans). docs: doc_id, text, one row per version."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("sha", F.sha2("text", 256))
    paths = rows.select("doc_id", "sha")
    unseen = paths.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("_n"))
    if ledger is not None:
        unseen = unseen.join(ledger.filter(F.col("rule_version") == version).select("sha"), "sha", "left_anti")
    first = (F.col("r.sha") == F.col("u.sha")) & F.col("r.doc_id").eqNullSafe(F.col("u.first_id"))
    one = rows.alias("r").join(unseen.alias("u"), first).select("r.sha", "r.text", "u._n")
    found = scan_blobs(one, rules).groupBy("sha").agg(F.first("spans").alias("spans"), F.first("_n").alias("_n"))
    counted = materialize(found.select("sha", F.lit(version).alias("rule_version"), "spans", "_n"), "ledger")
    new = counted.drop("_n")
    known = counted if ledger is None else counted.unionByName(ledger.filter(F.col("rule_version") == version).select(*new.columns, F.lit(0).cast("long").alias("_n")))
    total = counted.agg(F.sum("_n")).first()[0] or 0
    hits = known.filter((F.size("spans") > 0) | (F.col("_n") * HOT_SHARE > total)).select("sha", "spans", "_n")
    none = F.array().cast(new.schema["spans"].dataType)
    return new, joined_to_unique(paths, hits, "sha", total, ["doc_id"]).select("doc_id", "sha", F.coalesce("spans", none).alias("spans"))


def without(text: Column, spans: Column, mark: str) -> Column:
    """text with mark in place of each of the sorted spans, overlapping ones as one. Blocks of spans are cut out of one piece of text."""

    def piece(part: Column, base: Column, x: Column) -> Column:
        kept = F.concat(F.substring(part, x["from"] - base + 1, x["start"] - x["from"]), F.lit(mark))
        return F.when(x["start"] >= x["from"], kept).otherwise("")

    def block(xs: Column) -> Column:
        base = F.get(xs, F.lit(0))["from"]
        part = F.substring(text, base + 1, F.greatest(F.element_at(xs, -1)["start"] - base, F.lit(0)))
        return let(F.struct(base.alias("base"), part.alias("part"), xs.alias("xs")), lambda b: F.array_join(F.transform(b["xs"], lambda x: piece(b["part"], b["base"], x)), ""))

    def cut(s: Column) -> Column:
        ends, starts = s["ends"], F.transform(s["spans"], lambda x: x["start"])
        pairs = F.zip_with(F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1)), starts, lambda a, b: F.struct(a.alias("from"), b.alias("start")))
        blocks = let(pairs, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda k: block(F.slice(p, k * BLOCK + 1, BLOCK))))
        return F.concat(F.array_join(blocks, ""), F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))

    ends = running(F.transform(spans, lambda x: x["end"]), 0, lambda a, x: F.greatest(a, x))
    return let(F.struct(spans.alias("spans"), ends.alias("ends")), cut)


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns, with every span in text replaced by mark (overlapping spans by one)."""
    sha, spans = unused("sha", docs.columns), unused("spans", docs.columns)
    rows = docs.withColumn(sha, F.sha2(F.coalesce("text", F.lit("")), 256))
    found, _ = scan(docs, rules=rules)
    hits = found.filter(F.size("spans") > 0).select(F.col("sha").alias(sha), F.col("spans").alias(spans))

    return rows.join(hits, sha, "left").withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(without(F.col("text"), F.col(spans), mark))).select(docs.columns)


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts, base digest and joined spans of each row of scan()'s paths."""
    base = [i for i, r in enumerate(rules) if r.base]
    count = lambda i: F.size(F.filter("spans", lambda s: s["kind_order"] == i)).cast("long")
    return found.select(
        "doc_id",
        *[count(i).alias(f"n_{rules[i].kind}") for i in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind_order"].isin(base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents, every blob unseen before."""
    _, paths = scan(table(spark, sf_dir, "documents"))
    return digest(paths)


def _sql_kind(rule: Rule, order: int) -> str:
    p = rule.pattern.replace("'", "''")
    return f"""
  SELECT doc_id, start, {order} AS kind_order, '{rule.kind}' AS kind, start + n AS stop FROM (
    SELECT doc_id, n, c, CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + list_sum(list_transform(hits[1:i], lambda h: length(h))) - n AS BIGINT) AS start FROM (
      SELECT doc_id, gaps, hits, i, length(hits[i]) AS n, length(counted[i]) AS c FROM (
        SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS hits, regexp_extract_all(text, '{p}', {rule.group}) AS counted
        FROM documents WHERE regexp_matches(text, '{p}')
      ), LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i)
    )
  ) WHERE c >= {rule.least}"""


ORACLE = f"""
WITH s AS ({" UNION ALL ".join(_sql_kind(r, i) for i, r in enumerate(RULES))}
), a AS (
  SELECT doc_id, count(*) FILTER (kind_order = 0) AS n_assign, count(*) FILTER (kind_order = 1) AS n_access, count(*) FILTER (kind_order = 2) AS n_hex,
         coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order) FILTER (kind_order < 3), '') AS base,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_order) AS spans
  FROM s GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a USING (doc_id)
"""
