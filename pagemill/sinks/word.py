"""Word documents out of rows, with the standard library only."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections import Counter
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.reporting import SECTIONS, covered, report_rows

_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TYPES = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'

# The page (A4, landscape) in twips, the colours of a table's head, of every second row and of borders.
PAGE, HEAD_FILL, ROW_FILL, BORDER = (16838, 11906), "1F4E78", "F3F6FA", "D9D9D9"
COLUMNS = (("id", 1400), ("rule", 1000), ("place", 2800), ("problem", 2700), ("found", 2200), ("expected", 2200), ("severity", 1200), ("comment", 1400))
FONTS = '<w:rFonts w:ascii="Times New Roman" w:hAnsi="Times New Roman" w:cs="Times New Roman" w:eastAsia="宋体"/>'


_UNFIT = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def fit(text: str) -> str:
    """``text`` as XML content; characters that XML has no place for are left out."""
    return escape(_UNFIT.sub("", text))


def run(text: str, properties: str = "") -> str:
    lines = "<w:br/>".join(f'<w:t xml:space="preserve">{fit(x)}</w:t>' for x in text.split("\n"))
    return f"<w:r><w:rPr>{properties}</w:rPr>{lines}</w:r>"


def paragraph(text: str, style: str = "", properties: str = "") -> str:
    ppr = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
    return f"<w:p>{ppr}{run(text, properties)}</w:p>"


def table(head: tuple[tuple[str, int], ...], rows: list[list[str]]) -> str:
    """A table of fixed widths whose head repeats on every page."""
    edges = "".join(f'<w:{e} w:val="single" w:sz="4" w:space="0" w:color="{BORDER}"/>' for e in ("top", "left", "bottom", "right", "insideH", "insideV"))
    out = f'<w:tbl><w:tblPr><w:jc w:val="center"/><w:tblBorders>{edges}</w:tblBorders><w:tblLayout w:type="fixed"/></w:tblPr><w:tblGrid>'
    out += "".join(f'<w:gridCol w:w="{w}"/>' for _, w in head) + "</w:tblGrid>"
    for i, values in enumerate([[n for n, _ in head], *rows]):
        fill = HEAD_FILL if not i else ROW_FILL if i % 2 == 0 else None
        shade = f'<w:shd w:val="clear" w:fill="{fill}"/>' if fill else ""
        look = "<w:b/><w:color w:val=\"FFFFFF\"/>" if not i else ""
        cells = "".join(f'<w:tc><w:tcPr><w:tcW w:w="{w}" w:type="dxa"/>{shade}<w:vAlign w:val="center"/></w:tcPr>{paragraph(str(v), "Cell", look)}</w:tc>' for v, (_, w) in zip(values, head, strict=True))
        out += f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if not i else ''}{cells}</w:tr>"
    return out + "</w:tbl>" + paragraph("")


def _style(name: str, size: float, east: str, bold: bool = False, ppr: str = "", default: bool = False, title: str | None = None) -> str:
    fonts = FONTS.replace("宋体", east)
    return f'<w:style w:type="paragraph"{" w:default=\"1\"" * default} w:styleId="{name}"><w:name w:val="{title or name}"/><w:pPr>{ppr}</w:pPr><w:rPr>{fonts}{"<w:b/>" * bold}<w:sz w:val="{round(2 * size)}"/></w:rPr></w:style>'


def package(body: str, title: str) -> bytes:
    """A document of ``body``, with numbered pages."""
    styles = f'{_HEAD}<w:styles xmlns:w="{_W}">' + "".join((
        _style("Normal", 10.5, "宋体", ppr='<w:spacing w:after="80" w:line="300" w:lineRule="auto"/>', default=True), _style("Cell", 8.5, "宋体", ppr='<w:spacing w:before="0" w:after="0" w:line="252" w:lineRule="auto"/>'),
        _style("Title", 20, "黑体", True, '<w:spacing w:before="160" w:after="280"/><w:jc w:val="center"/>'), _style("Heading1", 15, "黑体", True, '<w:keepNext/><w:spacing w:before="200" w:after="120"/><w:outlineLvl w:val="0"/>', title="heading 1"),
    )) + "</w:styles>"
    number = f'<w:p><w:pPr><w:jc w:val="center"/></w:pPr>{run("page ")}<w:fldSimple w:instr=" PAGE ">{run("1")}</w:fldSimple></w:p>'
    section = f'<w:sectPr><w:footerReference w:type="default" r:id="rId2"/><w:pgSz w:w="{PAGE[0]}" w:h="{PAGE[1]}" w:orient="landscape"/><w:pgMar w:top="900" w:right="850" w:bottom="850" w:left="850" w:header="450" w:footer="450" w:gutter="0"/></w:sectPr>'
    relation = lambda rows: f'{_HEAD}<Relationships xmlns="{_PACKAGE}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{kind}" Target="{to}"/>' for i, (kind, to) in enumerate(rows, 1)) + "</Relationships>"
    parts = {"/word/document.xml": f"{_TYPES}.document.main+xml", "/word/styles.xml": f"{_TYPES}.styles+xml", "/word/footer1.xml": f"{_TYPES}.footer+xml", "/docProps/core.xml": "application/vnd.openxmlformats-package.core-properties+xml"}
    kinds = "".join(f'<Override PartName="{p}" ContentType="{t}"/>' for p, t in parts.items())
    files = {
        "[Content_Types].xml": f'{_HEAD}<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{kinds}</Types>',
        "_rels/.rels": relation([(f"{_OFFICE}/officeDocument", "word/document.xml"), (f"{_PACKAGE}/relationships/metadata/core-properties", "docProps/core.xml")]),
        "word/document.xml": f'{_HEAD}<w:document xmlns:w="{_W}" xmlns:r="{_OFFICE}"><w:body>{body}{section}</w:body></w:document>',
        "word/_rels/document.xml.rels": relation([(f"{_OFFICE}/styles", "styles.xml"), (f"{_OFFICE}/footer", "footer1.xml")]),
        "word/styles.xml": styles, "word/footer1.xml": f'{_HEAD}<w:ftr xmlns:w="{_W}">{number}</w:ftr>',
        "docProps/core.xml": f'{_HEAD}<cp:coreProperties xmlns:cp="{_PACKAGE}/metadata/core-properties" xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>{fit(title)}</dc:title></cp:coreProperties>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _numbers(rows: list[dict]) -> str:
    """The tables of the last section: severities, categories, comments."""
    severities, categories, done = Counter(r.get("severity") for r in rows), Counter(r.get("category") or "none" for r in rows), sum(bool(r["commented"]) for r in rows)
    share = f"{100 * done / len(rows):.1f} %" if rows else "0.0 %"
    out = table((("severity", 3000), ("number", 2000)), [[s, severities[s]] for s in ("ERROR", "WARNING", "MANUAL_REVIEW")] + [["all", len(rows)]])
    out += table((("category", 5000), ("number", 2000)), [[c, n] for c, n in sorted(categories.items(), key=lambda x: (-x[1], x[0]))] or [["none", 0]])
    return out + table((("comments", 3000), ("number or share", 2000)), [["commented", done], ["not commented", len(rows) - done], ["coverage", share]])


def report_document(name: str, rows: list[dict], known: list[bool], facts: dict[str, str], title: str, limits: tuple[str, ...]) -> bytes:
    """The report on one document: fifteen numbered sections. ``facts``: further lines of the overview."""
    severities = Counter(r.get("severity") for r in rows)
    body = paragraph(title, "Title")
    told = [["document", name], *map(list, facts.items()), ["findings", len(rows)], *([s, severities[s]] for s in ("ERROR", "WARNING", "MANUAL_REVIEW")), ["page numbers", "Word XML doesn't tell final ones"]]
    for i, (heading, _, _) in enumerate(SECTIONS):
        body += paragraph(f"{i + 1} {heading}", "Heading1")
        listed = [r for r in rows if i in r["sections"]]
        if heading == "overview":
            body += table((("item", 3400), ("value", 11000)), told)
        elif heading == "statistics":
            body += _numbers(rows)
        elif listed:
            keys = ("finding_id", "rule_id", "place", "problem", "actual", "expected", "severity", "comment")
            body += table(COLUMNS, [[r.get(k) or "" for k in keys] for r in listed])
        else:
            body += paragraph("The rules of this section found nothing." if known[i] else "No rule of this section is in use; this doesn't mean that the document complies.")
    return package(body + "".join(paragraph(x) for x in limits), title)


LIMITS = ("Final page numbers, automatic page breaks and overlaps can't be told from a package.", "A rule that passes with nothing evaluated had nothing to look at.")


def reports(docs: DataFrame, findings: DataFrame, comments: DataFrame, rules: DataFrame | None = None, title: str = "Format review", template: str = "built-in rules", created: str = "") -> DataFrame:
    """(doc_id, path, content): a report as a Word document for each row of ``docs`` (doc_id, path), with or without findings.

    ``comments``: as in ``reporting.report``. ``rules``: the catalogue in use, for the sections that no rule covers."""
    known = covered(rules)
    facts = {"reviewed": created, "template": template} | ({"rules": str(rules.count())} if rules is not None else {})

    def rendered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                name = (r.path or r.doc_id or "").rsplit("/", 1)[-1]
                made = report_document(name, json.loads(r.rows) if r.rows else [], known, facts, title, LIMITS)
                yield pd.DataFrame([(r.doc_id, r.path, made)], columns=["doc_id", "path", "content"])

    rows = report_rows(docs.select("doc_id", "path"), findings, comments)
    return rows.select("doc_id", "path", F.to_json("rows").alias("rows")).mapInPandas(rendered, "doc_id string, path string, content binary")
