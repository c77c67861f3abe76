import pytest
from pyspark.sql import functions as F

from pagemill.plans import formats
from pagemill.plans.audit import audit, inspection
from pagemill.plans.reporting import report, statistics
from pagemill.plans.rules import EXPECTED
from pagemill.operators.relational import comment_plan
from pagemill.sources import docx as source

from . import trees
from .docx_fixtures import NS, REFS, docx, fonts, p, points, section, val

H = EXPECTED["header"]
HEADER = f'<w:hdr {NS}>{p(H["text"], rpr=fonts(H["font"]) + val("color", "FF0000") + points(H["size_pt"]))}<w:p><w:r><w:pict>{"<v:line strokecolor='red'/>" * H["rules"]}</w:pict></w:r></w:p></w:hdr>'
CHAPTER = p("1 绪论", "Stufe1")
SOUND = CHAPTER + p("这里是一段话 with words") + p("1.1 问题", "Stufe2") + p("1.1.1 来由", "Stufe3") + p("2 实验", "Stufe1") + p("参考文献")
GOOD = SOUND + section(refs=REFS)
PICTURE, VERTICAL = "<w:p><w:r><w:drawing/></w:r></w:p>", f"<w:tblBorders>{val('right', 'double')}</w:tblBorders>"
table = lambda cells, borders="": f"<w:tbl><w:tblPr>{borders}</w:tblPr><w:tr>{''.join(f'<w:tc>{p(c)}</w:tc>' for c in cells)}</w:tr></w:tbl>"
equation = lambda number: f"<w:p><m:oMath/><w:r><w:t>{number}</w:t></w:r></w:p>"

#: Rule, status, and a small document with one defect: what stands between a chapter's heading and the end, or a whole body.
DEFECTS = [
    ("PAGE-001", "ERROR", SOUND + section(w=10000)), ("PAGE-002", "ERROR", SOUND + section(top=900)), ("PAGE-003", "WARNING", SOUND + section(header=200)),
    ("PAGE-004", "WARNING", SOUND + section(number='<w:pgNumType w:fmt="lowerLetter" w:start="9"/>')), ("HF-001", "ERROR", SOUND + section(refs=REFS)), ("HF-002", "WARNING", SOUND + section(refs=REFS)),
    ("FONT-001", "ERROR", p("字号太小", rpr=points(8))), ("FONT-002", "WARNING", p("蓝色的话", rpr=val("color", "0044CC"))), ("PARA-001", "ERROR", p("靠右的话", ppr=val("jc", "right"))), ("PARA-002", "WARNING", p("前") + p() * 3 + p("后")),
    ("HEAD-004", "WARNING", p("1.1.1 跳级", "Stufe3")), ("HEAD-005", "WARNING", p("1.1 概述", "Stufe2")), ("HEAD-005", "WARNING", p("1.1 小结", "Stufe2")),
    ("FIG-002", "ERROR", PICTURE + p("图 3-7 流程！")), ("FIG-003", "MANUAL_REVIEW", PICTURE + p("图 3-7 流程")), ("TAB-001", "ERROR", p("表 2-5 参数") + table(["甲", "乙"], VERTICAL)), ("TAB-002", "ERROR", p("没有题名") + table(["甲"])),
    ("TAB-003", "ERROR", p("表 2-5 参数") + table(["温度。"])), ("EQ-002", "WARNING", equation("y=kx 4-2")), ("REF-001", "ERROR", p("如 [5] 所述") + p("参考文献") + p("[1] Q. R. 2011.")),
    ("REF-003", "ERROR", p("参考文献") + p("[1] Q. R. 2011.") + p("[4] S. T. 2012.")), ("REF-004", "ERROR", p("参考文献") + p("[1] Q. R. 2011.")), ("REF-010", "ERROR", p("参考文献") + p("[1] K L Weber, title")),
    ("REF-002", "ERROR", p("参考文献") + p("[1] Aa, Bb, Cc, Dd, Ee, Ff, Gg. Title")), ("REF-005", "ERROR", p("参考文献") + p("[1] Q. Title, 2011, 5 pp: 12")), ("REF-006", "ERROR", p("参考文献") + p("[1] Q. 某会议 2011")),
    ("REF-007", "ERROR", p("参考文献") + p("[1] Q. 专利")), ("REF-008", "ERROR", p("参考文献") + p("[1] Q. [博士] x")), ("REF-009", "WARNING", p("参考文献") + p("[1] Q. R. 2011.")),
    ("LANG-003", "WARNING", p("长 25kPa 的值")), ("LANG-002", "WARNING", p("用 QRST 方法")), ("STRUCT-001", "WARNING", p("两个  空格")), ("NOTE-001", "ERROR", p("x")), ("NOTE-002", "WARNING", p("x")), ("TOC-001", "ERROR", p("x")),
    ("FRONT-001", "ERROR", p("x")), ("RENDER-001", "MANUAL_REVIEW", p("x")), ("PKG-001", "PASS", p("x")),
]
BAD = "".join(body for _, _, body in DEFECTS if "sectPr" not in body) + section(refs=REFS)


@pytest.fixture(scope="module")
def defects(spark):
    """Statuses of each defect's own document."""
    bodies = [body if "sectPr" in body else CHAPTER + body + section(refs=REFS) for _, _, body in DEFECTS]
    frame = spark.createDataFrame([(f"{i}.docx", bytearray(docx(b))) for i, b in enumerate(bodies)], "path string, content binary")
    docs = trees.scan(frame).persist()
    results = audit(spark, docs).rule_results.join(docs.select("doc_id", "path"), "doc_id").collect()
    return {(int(r.path.split(".")[0]), r.rule_id): r.status for r in results}


@pytest.mark.parametrize("i", range(len(DEFECTS)), ids=[f"{r}-{i}" for i, (r, _, _) in enumerate(DEFECTS)])
def test_each_defect_is_found_in_its_own_document(defects, i):
    same = next(k for k, d in enumerate(DEFECTS) if d[2] == DEFECTS[i][2])  # equal packages are one document
    assert defects.get((i, DEFECTS[i][0]), defects.get((same, DEFECTS[i][0]))) == DEFECTS[i][1]


@pytest.fixture(scope="module")
def audited(spark):
    files = [("good.docx", docx(GOOD, header=HEADER)), ("bad.docx", docx(BAD)), ("broken.docx", b"not a package"), ("entity.docx", docx(GOOD, word__farben="<!DOCTYPE x><x/>"))]
    frame = spark.createDataFrame([(n, bytearray(c)) for n, c in files], "path string, content binary")
    docs = trees.scan(frame).persist()
    out = audit(spark, docs)
    names = {r.doc_id: r.path for r in docs.select("doc_id", "path").collect()}
    results = {(names[r.doc_id], r.rule_id): r for r in out.rule_results.collect()}
    return docs, out, results, names


def test_all_rules_have_a_result_for_every_readable_document(audited):
    _, out, results, _ = audited
    assert len(results) == 2 * 76
    assert {r.path for r in out.quarantine.collect()} == {"broken.docx", "entity.docx"}


@pytest.mark.parametrize("rule", ["PAGE-001", "PAGE-002", "PAGE-003", "HF-001", "HF-002", "HF-003", "HF-004", "FONT-001", "FONT-002", "FONT-003", "PARA-001", "PARA-002", "PARA-003", "HEAD-001", "HEAD-002", "HEAD-003", "HEAD-004", "HEAD-005"])
def test_a_good_document_passes_with_something_evaluated(audited, rule):
    r = audited[2]["good.docx", rule]
    assert r.status == "PASS", r
    assert r.evaluated_count > 0 or rule in ("FONT-003",)


def test_finding_ids_are_unique_and_ordered(audited):
    rows = audited[1].findings.collect()
    assert len({(r.doc_id, r.finding_id) for r in rows}) == len(rows)
    assert all(r.finding_id.startswith(r.rule_id) for r in rows)


def test_unresolved_formats_go_to_review(spark):
    body = CHAPTER + p("没有格式的话") + section()
    styles = f'<w:styles {NS}><w:style w:type="paragraph" w:styleId="Stufe1">{val("name", "heading 1")}</w:style></w:styles>'
    docs = trees.scan(spark.createDataFrame([("a.docx", bytearray(docx(body, styles=styles)))], "path string, content binary"))
    got = {r.rule_id: r.status for r in audit(spark, docs).rule_results.collect()}
    assert got["FONT-001"] == "MANUAL_REVIEW" and got["PARA-001"] == "MANUAL_REVIEW" and got["FONT-002"] == "PASS"


def test_reports(audited):
    docs, out, _, names = audited
    findings = out.findings
    plan = comment_plan(findings, out.paragraphs.select("doc_id", "part_name", F.col("idx").alias("paragraph_index"), "text"))
    sections = report(findings, plan).collect()
    assert len(sections) == 2 * 15
    stats = statistics(findings, plan).collect()
    assert len(stats) == 2 and all(0 < s.coverage < 100 for s in stats)
    again = plan.withColumn("comment_id", F.lit(-1).cast("int")).withColumn("commented", F.lit(False))  # earlier records of the same findings
    assert sorted(map(str, report(findings, plan.unionByName(again)).collect())) == sorted(map(str, sections))
    assert sorted(map(str, statistics(findings, plan.unionByName(again)).collect())) == sorted(map(str, stats))
    assert inspection(docs, out.paragraphs, most=2).count() == 2


def test_formats_of_a_style_chain_a_theme_and_a_circle(spark):
    body = p("一", "Stufe2", rpr=val("rStyle", "Akzent")) + p("二", "Kreis") + p("三") + section()
    docs = trees.scan(spark.createDataFrame([("f.docx", bytearray(docx(body)))], "path string, content binary"))
    main = {r.text: r for r in formats.run_formats(docs, source.runs(docs), source.paragraphs(docs)).filter("part_name = 'word/document.xml'").collect()}
    # By hand: the character style's 13 points over the chain's 14; accent2 8040C0, 0x99 (0.6) of the way to white, is CCB3E6.
    assert main["一"].size_pt == 13 and main["一"].colour == "CCB3E6" and main["二"].size_pt == 21 and main["三"].size_pt == 12


def test_field_codes_nest_and_break():
    mark = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
    piece = lambda text: f"<w:r><w:instrText>{text}</w:instrText></w:r>"
    body = "<w:p>" + mark("begin") + piece(" IF a ") + mark("begin") + piece("toc \\o ") + piece("x") + mark("separate") + mark("end") + piece("b") + mark("end") + mark("end") + mark("begin") + piece("never") + "</w:p>"
    row = trees.read_package(docx(body + '<w:p><w:fldSimple w:instr="seq y"/></w:p>'))
    assert sorted(c for part, c in row["fields"] if part == source.MAIN) == ["IF", "SEQ", "TOC"]
