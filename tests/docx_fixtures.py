"""Word packages for tests, built from a table of styles. What the rules ask for is taken from their own table of expected values."""

from __future__ import annotations

import io
import zipfile
from itertools import count

from pagemill.plans.rules import EXPECTED

OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
DRAWING = "http://schemas.openxmlformats.org/drawingml/2006"
PREFIXES = {
    "w": "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "r": OFFICE, "m": "http://schemas.openxmlformats.org/officeDocument/2006/math",
    "v": "urn:schemas-microsoft-com:vml", "wp": f"{DRAWING}/wordprocessingDrawing",
}
NS = " ".join(f'xmlns:{k}="{v}"' for k, v in PREFIXES.items())

#: id: (kind, name, based on, outline level, East Asian font, size in points, colour attributes, alignment); headings are bold.
STYLES = {
    "Grund": ("paragraph", "Grundtext", None, None, None, None, "", None),
    "Titel": ("paragraph", "Titel aller Stufen", "Grund", None, EXPECTED["heading_font"], None, "", None),
    "Stufe1": ("paragraph", "heading 1", "Titel", 0, None, EXPECTED["headings"][1], "", "center"),
    "Stufe2": ("paragraph", "heading 2", "Titel", 1, None, EXPECTED["headings"][2], "", None),
    "Stufe3": ("paragraph", "heading 3", "Titel", 2, None, EXPECTED["headings"][3], "", None),
    "Kreis": ("paragraph", "Kreis", "Rund", None, None, None, "", None),
    "Rund": ("paragraph", "Rund", "Kreis", None, None, 21, "", None),
    "Akzent": ("character", "Akzent", None, None, None, 13, 'w:themeColor="accent2" w:themeTint="99"', None),
}
COLOURS = {"dk1": "101820", "lt1": "FAF8F2", "accent2": "8040C0"}
FACES = {"major": ("Lato", "黑体"), "minor": ("Gelasio", "仿宋")}


def val(tag: str, value: object) -> str:
    return "" if value is None else f'<w:{tag} w:val="{value}"/>'


def fonts(east: str | None = None, latin: str | None = None) -> str:
    own = [f'w:ascii="{latin}" w:hAnsi="{latin}"'] * bool(latin) + [f'w:eastAsia="{east}"'] * bool(east)
    return f"<w:rFonts {' '.join(own)}/>" if own else ""


def points(size: float | None) -> str:
    return val("sz", None if size is None else round(2 * size))


def style_part(styles: dict = STYLES) -> str:
    line = round(240 * EXPECTED["paragraph"]["line_multiple"])
    out = f'<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr>{fonts(EXPECTED["body"]["east"], EXPECTED["body"]["latin"])}{points(EXPECTED["body"]["size_pt"])}</w:rPr></w:rPrDefault>'
    out += f'<w:pPrDefault><w:pPr><w:spacing w:line="{line}" w:lineRule="auto"/>{val("jc", "both")}</w:pPr></w:pPrDefault></w:docDefaults>'
    for i, (style_id, (kind, name, base, level, east, size, colour, align)) in enumerate(styles.items()):
        default = ' w:default="1"' if not i else ""
        ppr = f"<w:pPr>{val('jc', align)}{val('outlineLvl', level)}</w:pPr>" if kind == "paragraph" else ""
        rpr = f"<w:rPr>{fonts(east)}{'<w:b/>' if east == EXPECTED['heading_font'] else ''}{f'<w:color {colour}/>' if colour else ''}{points(size)}</w:rPr>"
        out += f'<w:style w:type="{kind}"{default} w:styleId="{style_id}">{val("name", name)}{val("basedOn", base)}{ppr}{rpr}</w:style>'
    return out + "</w:styles>"


def theme_part() -> str:
    colours = "".join(f'<a:{k}><a:srgbClr val="{v}"/></a:{k}>' for k, v in COLOURS.items())
    faces = "".join(f'<a:{k}Font><a:latin typeface="{latin}"/><a:ea typeface="{east}"/></a:{k}Font>' for k, (latin, east) in FACES.items())
    return f'<a:theme xmlns:a="{DRAWING}/main"><a:themeElements><a:clrScheme name="t">{colours}</a:clrScheme><a:fontScheme name="t">{faces}</a:fontScheme></a:themeElements></a:theme>'


def p(text: str = "", style: str | None = None, ppr: str = "", rpr: str = "", extra: str = "") -> str:
    run = f'<w:r><w:rPr>{rpr}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>' if text else ""
    return f"<w:p><w:pPr>{val('pStyle', style)}{ppr}</w:pPr>{run}{extra}</w:p>"


def twips(inches: float) -> int:
    return round(1440 * inches)


def section(refs: str = "", number: str = "", **other: int) -> str:
    """A section as the rules want it; ``other``: attributes of the page's size and margins, in twips."""
    page, margins, distances = EXPECTED["page"], EXPECTED["margins"], EXPECTED["distances"]
    size = {"w": twips(page["width_inches"]), "h": twips(page["height_inches"])}
    margin = {k: twips(margins[k]) for k in ("top", "bottom", "left", "right")} | {k: round(20 * distances[k]) for k in ("header", "footer")} | {"gutter": 0}
    show = lambda own: " ".join(f'w:{k}="{other.get(k, v)}"' for k, v in own.items())
    return f"<w:sectPr>{refs}<w:pgSz {show(size)}/><w:pgMar {show(margin)}/>{number}</w:sectPr>"


#: The parts that the main part relates to, in the order of their ids.
RELATED = {"header": "kopf.xml", "footer": "fuss.xml", "styles": "formate.xml", "theme": "farben.xml"}
IDS = dict(zip(RELATED, (f"rel{i}" for i in count(11)), strict=False))
REFS = "".join(f'<w:{k}Reference w:type="default" r:id="{IDS[k]}"/>' for k in ("header", "footer"))
PAGE_NUMBER = f'<w:p><w:pPr>{val("jc", "center")}</w:pPr><w:fldSimple w:instr="PAGE"/></w:p>'


def relations(rows: dict[str, tuple[str, str]]) -> str:
    return f'<Relationships xmlns="{PACKAGE}/relationships">' + "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{kind}" Target="{target}"/>' for i, (kind, target) in rows.items()) + "</Relationships>"


def docx(body: str, styles: str | None = None, header: str | None = None, **parts: str) -> bytes:
    """A package whose main part has ``body``; ``parts``: further files by name, with "/" as "__"."""
    notes = {f"word/{k}s.xml": f'<w:{k}s {NS}><w:{k} w:id="3">{p(f"one {k}")}</w:{k}></w:{k}s>' for k in ("footnote", "endnote")}
    files = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"/>', "_rels/.rels": relations({"top": ("officeDocument", "word/document.xml")}),
        "word/_rels/document.xml.rels": relations({IDS[k]: (k, target) for k, target in RELATED.items()}), "word/document.xml": f"<w:document {NS}><w:body>{body}</w:body></w:document>",
        "word/kopf.xml": header or f"<w:hdr {NS}>{p('a running head')}</w:hdr>", "word/fuss.xml": f"<w:ftr {NS}>{PAGE_NUMBER}</w:ftr>",
        "word/formate.xml": style_part() if styles is None else styles, "word/farben.xml": theme_part(),
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in (files | notes | {k.replace("__", "/") + ".xml": v for k, v in parts.items()}).items():
            z.writestr(name, text)
    return out.getvalue()
