"""The relational scan gives what the element trees of the same packages say, read one by one."""

import io
import random
import re
import zipfile

import pytest

from pagemill.sources import scan, xml
from pagemill.sources.parts import SCHEMA, parts_of, read_parts
from pagemill.plans import formats
from pagemill.sources.scan import Nodes, documents, paragraph_rows, paragraphs, scan_parts
from pagemill.storage import discard, dealt_already, scratch

from . import test_audit as A
from . import trees
from .docx_fixtures import NS, REFS, docx, fonts, p, points, section, val

MARK = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
CODE = lambda text: f"<w:r><w:instrText>{text}</w:instrText></w:r>"
DRAWING = 'xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'

RICH = (
    p("a &lt;b&gt; &#x4e2d;&#128512; &amp;amp;", "Stufe1", ppr='<w:numPr><w:ilvl w:val="1"/><w:numId w:val="7"/></w:numPr><w:tabs><w:tab w:val="left" w:pos="720"/><w:tab w:val="right" w:pos="9000" w:leader="dot"/></w:tabs><w:spacing w:before="120" w:line="300" w:lineRule="exact"/><w:ind w:firstLine="480"/><w:keepNext/><w:widowControl w:val="off"/>')
    + "<w:p/>" + "<w:p><w:pPr/></w:p>"
    + p("run", rpr=val("rStyle", "Akzent") + '<w:rFonts w:ascii="Arial" w:eastAsiaTheme="minorEastAsia"/><w:b w:val="0"/><w:i/><w:u/><w:vanish/><w:color w:val="auto" w:themeColor="accent2" w:themeTint="80"/>' + points(9))
    + "<w:p><w:r><w:t>one</w:t><w:tab/><w:t xml:space='preserve'> two  three</w:t><w:br/><w:br w:type='page'/><w:br w:type=\"column\"/><w:delText>gone</w:delText></w:r><w:ins><w:r><w:t>new</w:t></w:r></w:ins><w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
    + "<w:ins>" + p("revised") + "</w:ins><w:sdt><w:sdtContent>" + p("held") + "</w:sdtContent></w:sdt>"
    + "<w:p>" + MARK("begin") + CODE(" IF a ") + MARK("begin") + CODE("toc \\o ") + CODE("x") + MARK("separate") + MARK("end") + CODE("b") + MARK("end") + MARK("end") + MARK("begin") + CODE("never") + "</w:p><w:p><w:fldSimple w:instr=\"seq y\"><w:r><w:t>7</w:t></w:r></w:fldSimple></w:p>"
    + "<w:p><w:r><w:t>outer</w:t><w:pict><v:shape strokecolor=' #FF0000'><w:txbxContent>" + p("inner one") + p("inner two", "Stufe2") + "</w:txbxContent></v:shape></w:pict></w:r><w:r><w:t>after</w:t></w:r></w:p>"
    + f"<w:p><w:r><w:drawing {DRAWING}><wp:anchor/><wp:inline/></w:drawing></w:r></w:p><w:p><m:oMathPara><m:oMath/></m:oMathPara></w:p>"
    + p("表 1-1") + f"<w:tbl><w:tblPr>{val('tblStyle', 'Raster')}<w:tblBorders>{val('top', 'single')}{val('left', 'nil')}</w:tblBorders></w:tblPr><w:tr><w:trPr><w:tblHeader/></w:trPr><w:tc><w:tcPr><w:tcBorders>{val('bottom', 'single')}{val('left', 'double')}</w:tcBorders></w:tcPr>{p(' head ')}</w:tc><w:tc>{p('two')}<w:tbl><w:tblPr/><w:tr><w:tc>{p('deep')}</w:tc></w:tr></w:tbl>{p('below')}</w:tc></w:tr><w:tr><w:tc>{p('3')}</w:tc></w:tr></w:tbl>" + p("注：x")
    + "<w:tbl><w:tr><w:tc/></w:tr></w:tbl><w:tbl/>" + p("end of one", ppr=f"<w:sectPr>{REFS}<w:pgSz w:w=\"10000\" w:h=\"x\" w:orient=\"landscape\"/><w:titlePg/><w:pgNumType w:fmt=\"upperRoman\" w:start=\"3\"/><w:type w:val=\"continuous\"/></w:sectPr>")
    + "<w:bookmarkStart w:id='1' w:name='here'/><w:bookmarkEnd w:id='1'/><w:moveFrom/><w:commentRangeStart w:id='4'/>" + p("two　spaces  and nbsp") + section()
)
STYLES = f"""<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr>{fonts("宋体", "Arial")}{points(12)}</w:rPr></w:rPrDefault><w:pPrDefault/></w:docDefaults>
<w:style w:type="paragraph" w:default="1" w:styleId="N">{val("name", "Normal")}<w:pPr>{val("jc", "both")}</w:pPr></w:style>
<w:style w:type="table" w:styleId="Raster">{val("name", "Grid")}{val("basedOn", "T")}<w:tblStylePr w:type="firstRow"><w:rPr><w:b/></w:rPr></w:tblStylePr><w:tblStylePr w:type="wholeTable"><w:pPr>{val("jc", "center")}</w:pPr><w:rPr><w:i/></w:rPr></w:tblStylePr></w:style>
<w:style w:type="paragraph"/><w:style w:type="paragraph" w:styleId="N2">{val("name", "first")}</w:style><w:style w:type="paragraph" w:styleId="N2">{val("name", "second")}<w:rPr><w:caps/></w:rPr></w:style></w:styles>"""
SETTINGS = f"<w:settings {NS}><w:evenAndOddHeaders/>{val('updateFields', 'true')}{val('defaultTabStop', 420)}<w:footnotePr>{val('numRestart', 'eachPage')}</w:footnotePr><w:compat><w:compatSetting w:name='compatibilityMode' w:val='12'/><w:compatSetting w:name='compatibilityMode' w:val='15'/></w:compat></w:settings>"
NUMBERING = f"<w:numbering {NS}><w:abstractNum w:abstractNumId='3'><w:lvl w:ilvl='0'>{val('start', 1)}{val('numFmt', 'decimal')}{val('lvlText', '%1.')}</w:lvl><w:lvl w:ilvl='1'/></w:abstractNum><w:num w:numId='7'/><w:num w:numId='8'/></w:numbering>"
COMMENTS = f"<w:comments {NS}><w:comment w:id='0'>{p('said')}</w:comment></w:comments>"
THEME = """<x:theme xmlns:x="http://schemas.openxmlformats.org/drawingml/2006/main"><x:themeElements><x:clrScheme><x:dk1><x:sysClr val="windowText" lastClr="00000a"/></x:dk1><x:lt1><x:sysClr val="window"/></x:lt1>
<x:accent2><x:srgbClr val="8040c0"><x:tint/></x:srgbClr></x:accent2><x:hlink/></x:clrScheme><x:fontScheme><x:majorFont><x:latin typeface="Lato"/><x:ea typeface=""/><x:cs typeface=""/><x:font script="Jpan" typeface="J"/><x:font script="Hans" typeface="黑体"/></x:majorFont><x:minorFont><x:ea typeface="宋体"/></x:minorFont></x:fontScheme></x:themeElements></x:theme>"""


def plain(value):
    """Rows, tuples and dicts as lists; nulls stay."""
    if isinstance(value, dict):
        return {k: plain(v) for k, v in sorted(value.items())}
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


def packed(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def unpacked(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: z.read(n) for n in z.namelist()}


def foreign(content):
    """The same package with other prefixes, single quotes and a default namespace."""
    parts = unpacked(content)
    main = parts["word/document.xml"].decode().replace("<w:", "<q:").replace("</w:", "</q:").replace("xmlns:w=", "xmlns:q=").replace(" w:", " q:")
    return packed(parts | {"word/document.xml": main})


def packages():
    rich = docx(RICH, styles=STYLES, word__settings=SETTINGS, word__numbering=NUMBERING, word__comments=COMMENTS, word__farben=THEME)
    out = {"rich": rich, "foreign": foreign(rich), "good": docx(A.GOOD, header=A.HEADER), "bad": docx(A.BAD), "empty": docx("")}
    out |= {f"defect-{i}": docx(body if "sectPr" in body else A.CHAPTER + body + section(refs=REFS)) for i, (_, _, body) in enumerate(A.DEFECTS)}
    rng = random.Random(4)
    blocks = ["<w:p/>", p("x y"), p("h", "Stufe1"), "<w:p>" + MARK("begin") + CODE("ref z") + "</w:p>", "<w:p>" + MARK("end") + "</w:p>", "<w:tbl><w:tr><w:tc>" + p("c") + "</w:tc></w:tr></w:tbl>", "<w:sdt>" + p("s") + "</w:sdt>", "<w:del>" + p("d") + "</w:del>", p("s", ppr=section())]
    out |= {f"mixed-{i}": docx("".join(rng.choice(blocks) for _ in range(rng.randint(1, 12))) + section()) for i in range(8)}
    parts = unpacked(out["good"])
    out |= {"no zip": b"not a package", "cut": out["good"][:-40], "no main": packed({k: v for k, v in parts.items() if k != "word/document.xml"}), "no types": packed({k: v for k, v in parts.items() if k != "[Content_Types].xml"})}
    out |= {"entity": docx(A.GOOD, word__farben="<!DOCTYPE x><x/>"), "torn": docx("<w:p><w:r></w:p>"), "torn elsewhere": packed(parts | {"word/fontTable.xml": "<a>"}), "no styles": packed({k: v for k, v in parts.items() if "formate" not in k})}
    return out


PACKAGES = packages()


@pytest.fixture(scope="module")
def scanned(spark):
    files = spark.createDataFrame([(k, bytearray(v)) for k, v in PACKAGES.items()], "path string, content binary").repartition(3)
    return {r.path: r for r in scan_parts(parts_of(files)).collect()}


@pytest.mark.parametrize("name", list(PACKAGES))
def test_scan_equals_the_trees(scanned, name):
    got, want = scanned[name], trees.read_package(PACKAGES[name])
    assert (got.doc_id, got.size) == (want["doc_id"], want["size"])
    assert (got.error is None) == (want["error"] is None), (got.error, want["error"])
    unordered = {"parts", "rels", "styles", "numbering"}
    for field in set(want) - {"doc_id", "size", "error", "path"}:
        g, w = plain(got[field]), plain(want[field])
        if field in unordered and w is not None:
            g, w = sorted(g, key=repr), sorted(w, key=repr)
        assert g == w, field


def test_an_archive_is_read_member_by_member(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    good, rich = PACKAGES["good"], PACKAGES["rich"]
    (tmp_path / "a.docx").write_bytes(good)
    (tmp_path / "deep" / "b.DOCX").write_bytes(rich)
    (tmp_path / "c.docx").write_bytes(b"nothing")
    (tmp_path / "d.txt").write_bytes(good)
    rows = read_parts(spark, str(tmp_path), bytesPerTask="10")
    assert rows.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    assert rows.rdd.getNumPartitions() == 3
    got = {(r.path.rsplit("/", 1)[1], r.part_name): r for r in rows.collect()}
    assert got["c.docx", None].error and got["c.docx", None].sha256 is None
    assert {n for f, n in got if f == "a.docx"} == set(unpacked(good))
    assert bytes(got["b.DOCX", "word/document.xml"].content) == unpacked(rich)["word/document.xml"]
    docs = {r.path.rsplit("/", 1)[1]: r for r in scan_parts(read_parts(spark, str(tmp_path))).collect()}
    assert set(docs) == {"a.docx", "b.DOCX", "c.docx"} and docs["c.docx"].error
    assert plain(docs["b.DOCX"].paragraphs) == plain(trees.read_package(rich)["paragraphs"])


def test_what_isnt_xml_comes_without_content(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(packed({"word/media/image1.png": b"\x89PNG", "word/document.xml": "<a/>"}))
    for option, want in (("xml", None), ("all", b"\x89PNG")):
        rows = {r.part_name: r for r in read_parts(spark, str(tmp_path), content=option).collect()}
        assert rows["word/media/image1.png"].content == want and rows["word/media/image1.png"].part_size == 4


def test_no_packages(spark, tmp_path):
    assert scan_parts(read_parts(spark, str(tmp_path))).count() == 0


def test_paragraphs_are_made_where_their_nodes_lie(spark):
    """The parts are dealt by document once; of what follows only the list of stories is shuffled."""
    most = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # the least, so that small inputs are as many parts as shuffles
    try:
        files = spark.createDataFrame([(k, bytearray(PACKAGES[k])) for k in ("rich", "good")], "path string, content binary")
        named = {t.name for t in spark.catalog.listTables()}
        n = Nodes(parts_of(files), scratch(spark), contents=False)
        with dealt_already(spark):
            plan = paragraphs(n)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 1, plan
        assert "content" not in n.files.columns and n.files.filter("part_name is not null").count() == n.parts.count()
        discard(spark, n.folder)
        assert {t.name for t in spark.catalog.listTables()} <= named
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", most)


def test_faults_and_parents_in_one_pass(spark):
    """Comments, loose ends, text outside and several roots; parents of first children, of later ones and behind texts."""
    cases = {"ok": "<!--x--><a>t<b><c/>u</b><b/>v<d>w</d></a>", "none": "", "comment": "<!--x-->", "loose": "<a/></a>", "text": "<a/>x", "roots": "<a/><b/>", "open": "<a><b></a>", "crossed": "<a><b></a></b>", "bad": "<a>&x;</a>", "type": "<!DOCTYPE a><a/>"}
    rows = xml.pieces(spark.createDataFrame(list(cases.items()), "k string, x string"), ["k"], "x", {})
    assert {r.k: r.error for r in xml.errors(rows, ["k"]).collect()} == {k: "it has a document type" if k == "type" else "not well formed" for k in cases if k != "ok"}
    got = [(r.pos, r.end, r.level, r.parent, r.name) for r in xml.nodes(rows).filter("k = 'ok'").sort("pos").collect()]
    assert got == [(1, 12, 1, None, "a"), (2, 2, 2, 1, "#text"), (3, 6, 2, 1, "b"), (4, 4, 3, 3, "c"), (5, 5, 3, 3, "#text"), (7, 7, 2, 1, "b"), (8, 8, 2, 1, "#text"), (9, 11, 2, 1, "d"), (10, 10, 3, 9, "#text")]


def test_formats_broadcast_no_styles(spark):
    """Equal styles are small as files, however many documents have them; no join may take that for their size in memory."""
    files = spark.createDataFrame([("good", bytearray(PACKAGES["good"]))], "path string, content binary")
    n = Nodes(parts_of(files), scratch(spark), contents=False)
    runs, rows = paragraph_rows(n)
    docs = documents(n, only=("styles", "default_ppr", "default_rpr", "theme"))
    for out in (formats.run_formats(docs, runs, rows), formats.paragraph_formats(docs, rows)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") >= 2, plan  # with the styles, and with what they come to
        assert out.count() == (runs if "p_idx" in out.columns else rows).count()
    discard(spark, n.folder)


def test_pieces_take_two_windows(spark):
    """Every window holds all that is said of a piece: one for depths and last tags, one for what lies beside."""
    rows = xml.pieces(spark.createDataFrame([("k", "<a/>")], "k string, x string"), ["k"], "x", {})
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bWindow \[", plan)) == 2, plan


def test_attributes_and_references(spark):
    text = """<a b = 'x"&#10;&amp;lt;'\tc="1\t2\n3"   d\n='='/>"""
    rows = xml.pieces(spark.createDataFrame([("k", text), ("doc", "<!doctype a><a/>")], "k string, x string"), ["k"], "x", {})
    assert [r.attrs for r in xml.nodes(rows).filter("k = 'k'").collect()] == [{"b": 'x"\n&lt;', "c": "1 2 3", "d": "="}]
    assert [tuple(r) for r in xml.errors(rows, ["k"]).collect()] == [("doc", "it has a document type")]


def test_held_reads_the_nodes_once(spark):
    """Paragraphs, runs and tables, and what lies in them, come of one scan and two windows."""
    nodes = "doc_id string, part_name string, pos int, end int, level int, parent int, parent_name string, name string, attrs map<string,string>, text string, first boolean"
    plan = scan.held(spark.createDataFrame([], nodes))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ") == 1 and len(re.findall(r"\bWindow \[", plan)) == 2, plan


def test_rows_of_runs_equal_the_lists(spark):
    """``run_rows`` has the runs of ``paragraph_rows``, those in nested paragraphs and tables among them."""
    files = spark.createDataFrame([("rich", bytearray(PACKAGES["rich"]))], "path string, content binary")
    got = []
    for rows in (scan.run_rows, paragraph_rows):
        n = Nodes(parts_of(files), scratch(spark), contents=False)
        runs, told = rows(n)
        got.append((sorted(map(repr, runs.collect())), sorted(map(repr, told.drop("runs").select(*sorted(set(told.columns) - {"runs"})).collect()))))
        discard(spark, n.folder)
    assert got[0] == got[1] and got[0][0]
