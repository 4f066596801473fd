"""Editable Word documents: one OOXML package a document."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
CONTENT_TYPES = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Default Extension="png" ContentType="image/png"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.styles+xml"/><Override PartName="/word/numbering.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.numbering+xml"/></Types>"""
RELATIONS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>"""
DOCUMENT_RELATIONS = """<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/styles" Target="styles.xml"/><Relationship Id="rId2" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/numbering" Target="numbering.xml"/></Relationships>"""
STYLES = f"""<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<w:styles xmlns:w="{W}"><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Arial" w:hAnsi="Arial" w:cs="Arial"/><w:sz w:val="22"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:after="120" w:line="276" w:lineRule="auto"/></w:pPr></w:pPrDefault></w:docDefaults><w:style w:type="paragraph" w:styleId="Heading1"><w:name w:val="heading 1"/></w:style><w:style w:type="paragraph" w:styleId="Heading2"><w:name w:val="heading 2"/></w:style></w:styles>"""
NUMBERING = f"""<?xml version="1.0" encoding="UTF-8" standalone="yes"?>
<w:numbering xmlns:w="{W}"><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="bullet"/><w:lvlText w:val="•"/><w:pPr><w:ind w:left="720" w:hanging="360"/></w:pPr></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>"""

WORD_BLOCK = "struct<ord:bigint,kind:string,style:string,text:string,rows:array<array<string>>,half_points:int,bold:boolean,indent:int,page_break:boolean>"


def half_points(font_size: Column) -> Column:
    """Font size in half points, within 18..42."""
    return F.greatest(F.lit(18), F.least(F.lit(42), F.floor(F.coalesce(font_size, F.lit(11.0)) * 2 + 0.5))).cast("int")


def layout_block(block: Column, ord_: Column, keep_layout: bool = False) -> Column:
    """WORD_BLOCK of a layout BLOCK; keep_layout indents by its left edge."""
    heading = block["kind"] == "heading"
    indent = F.greatest(F.lit(0), F.floor(block["bbox"]["x0"] * 20 + 0.5)).cast("int") if keep_layout else F.lit(None).cast("int")
    fields = {
        "ord": ord_.cast("bigint"), "kind": block["kind"], "style": F.when(heading, F.when(block["level"] == 1, "Heading1").otherwise("Heading2")),
        "text": block["text"], "rows": block["rows"], "half_points": half_points(F.get(block["lines"], F.lit(0))["fontSize"]), "bold": heading, "indent": indent, "page_break": F.lit(False),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def prose_block(kind: Column, text: Column, ord_: Column) -> Column:
    """WORD_BLOCK of a structured paragraph of recognised text."""
    title, heading = kind == "title", kind == "heading"
    fields = {
        "ord": ord_.cast("bigint"), "kind": kind, "style": F.when(title, "Heading1").when(heading, "Heading2"), "text": text, "rows": F.lit(None).cast("array<array<string>>"),
        "half_points": F.when(title, 28).when(heading, 22).otherwise(20), "bold": title | heading, "indent": F.when(kind == "list-item", 360), "page_break": F.lit(False),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _paragraph(b: dict) -> str:
    bullet = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="1"/></w:numPr>' if b["kind"] == "list-item" and b["indent"] is None else ""
    style = f'<w:pStyle w:val="{b["style"]}"/>' if b["style"] else ""
    indent = f'<w:ind w:left="{b["indent"]}"/>' if b["indent"] is not None else ""
    align = f'<w:jc w:val="{"both" if b["kind"] == "paragraph" else "left"}"/>'
    bold = "<w:b/>" if b["bold"] else ""
    br = '<w:r><w:br w:type="page"/></w:r>' if b["page_break"] else ""
    text = escape(b["text"] or "")
    return f'<w:p><w:pPr>{style}{bullet}{indent}{align}</w:pPr>{br}<w:r><w:rPr>{bold}<w:sz w:val="{b["half_points"] or 22}"/></w:rPr><w:t xml:space="preserve">{text}</w:t></w:r></w:p>'


def _table(rows: list[list[str]]) -> str:
    cell = lambda t: f'<w:tc><w:p><w:r><w:t xml:space="preserve">{escape(t or "")}</w:t></w:r></w:p></w:tc>'
    body = "".join(f"<w:tr>{''.join(map(cell, r))}</w:tr>" for r in rows)
    return f'<w:tbl><w:tblPr><w:tblW w:w="5000" w:type="pct"/></w:tblPr>{body}</w:tbl>'


def docx_bytes(blocks: list[dict]) -> bytes:
    """An OOXML package of WORD_BLOCKs in their order; equal blocks give equal bytes."""
    body = "".join(_table(b["rows"]) if b["rows"] else _paragraph(b) for b in sorted(blocks, key=lambda b: b["ord"]))
    document = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<w:document xmlns:w="{W}"><w:body>{body}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", CONTENT_TYPES), ("_rels/.rels", RELATIONS), ("word/document.xml", document), ("word/styles.xml", STYLES), ("word/numbering.xml", NUMBERING), ("word/_rels/document.xml.rels", DOCUMENT_RELATIONS)):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text.encode(), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def word_documents(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and content of one package for each document of blocks (key, block WORD_BLOCK)."""

    def package(rows: pa.Table) -> pa.Table:
        return pa.table({key: rows.column(key).slice(0, 1), "content": pa.array([docx_bytes(rows.column("block").to_pylist())], type=pa.binary())})

    kind = blocks.schema[key].dataType.simpleString()
    return blocks.select(key, "block").groupBy(key).applyInArrow(package, f"{key} {kind}, content binary")


@F.arrow_udf(T.StructType([T.StructField("n_paragraphs", T.IntegerType()), T.StructField("n_tables", T.IntegerType()), T.StructField("n_characters", T.LongType())]))
def package_counts(content: pa.Array) -> pa.Array:
    """What a package holds, read back: paragraphs outside tables, tables, and characters of those paragraphs."""
    out, w = [], f"{{{W}}}"
    for package in content:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(package.as_py())).read("word/document.xml"))[0]
        texts = ["".join(t.text or "" for t in p.iter(f"{w}t")) for p in body.findall(f"{w}p")]
        out.append({"n_paragraphs": len(texts), "n_tables": len(body.findall(f"{w}tbl")), "n_characters": sum(map(len, texts))})
    return pa.array(out, type=pa.struct([("n_paragraphs", pa.int32()), ("n_tables", pa.int32()), ("n_characters", pa.int64())]))
