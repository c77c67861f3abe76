"""Every rule fires on a document made for it, with the evidence that it compared; and the values that rules compare with, in numbers."""

import json

import pytest
from pyspark.sql import functions as F

from pagemill.plans.audit import audit
from pagemill.plans.config import expected_of, load
from pagemill.plans.review import read_reviews, reviews
from pagemill.plans.rules import EXPECTED, SEVERITY

from . import trees
from .docx_fixtures import IDS, NS, REFS, docx, fonts, p, points, section, val
from .test_audit import CHAPTER, DEFECTS, PICTURE, SOUND, equation, table

M, W, E = "MANUAL_REVIEW", "WARNING", "ERROR"
HEAD_ONLY = f'<w:headerReference w:type="default" r:id="{IDS["header"]}"/>'
ANCHORED = "<w:p><w:r><w:drawing><wp:anchor/></w:drawing></w:r></w:p>"
notes = lambda text: {"word__footnotes": f'<w:footnotes {NS}><w:footnote w:id="3">{p(text)}</w:footnote></w:footnotes>'}
long_table = lambda rows: f"<w:tbl>{'<w:tr><w:tc>' + p('x') + '</w:tc></w:tr>'}".replace("</w:tr>", "</w:tr>" + "".join(f"<w:tr><w:tc>{p(str(i))}</w:tc></w:tr>" for i in range(rows - 1))) + "</w:tbl>"

#: Rule, status, what stands between a chapter's heading and the end (or a whole body), further parts.
FIRES = [
    ("HF-003", E, SOUND + section(refs=HEAD_ONLY), {}), ("HF-004", W, p("前", ppr=section()) + SOUND + section(), {}), ("FONT-003", E, p("混合 abc", rpr=fonts("黑体", "Arial")), {}),
    ("PARA-003", M, p("x", extra='<w:r><w:br w:type="page"/></w:r>'), {}), ("HEAD-001", E, p("2 标题", "Stufe1", ppr=val("jc", "left")), {}), ("HEAD-002", E, p("1.1 题目", "Stufe2", rpr=points(20)), {}),
    ("HEAD-003", E, p("1.1 题目", "Stufe2") + p("1.1.1 题目", "Stufe3", rpr=fonts("楷体")), {}), ("COVER-001", E, p("汉" * 35) + SOUND + section(refs=REFS), {}), ("COVER-002", M, p("one title of four words"), {}), ("COVER-003", M, p("x"), {}),
    ("ABS-001", W, p("摘要") + p("太短"), {}), ("ABS-002", E, p("摘要") + p("太小", rpr=points(9)), {}), ("ABS-003", E, p("Abstract") + p("too small", rpr=points(9)), {}), ("ABS-004", E, p("关键词：一；二。"), {}),
    ("ABS-005", M, p("x"), {}), ("ABS-006", W, p("Abstract") + p("what we did"), {}), ("TOC-002", E, p("章 1", "TOC1", rpr=points(9)), {}), ("TOC-003", M, p("章 1", "TOC1"), {}), ("FIG-001", M, ANCHORED + p("图 3-7 流程"), {}),
    ("FIG-004", W, PICTURE + p("图 3-7 流程"), {}), ("FIG-005", M, PICTURE + p("图 3-7 流程"), {}), ("TAB-004", W, p("表 2-5 参数") + long_table(25), {}), ("TAB-005", E, p("表 2-5 参数") + table(["甲"]) + p("注：大", rpr=points(20)), {}),
    ("TAB-006", M, p("表 2-5 参数") + table(["甲"]), {}), ("EQ-001", W, equation("(1-1)").replace("<w:p>", '<w:p><w:pPr><w:jc w:val="right"/></w:pPr>'), {}), ("NOTE-003", M, p("x"), notes("pp. 12-15")), ("NOTE-004", M, p("x"), notes("www.example.org")),
    ("REF-011", M, p("参考文献") + p("[1] Q. R. 2011"), {}), ("OBJ-001", M, ANCHORED, {}), ("OBJ-002", E, '<w:p><w:fldSimple w:instr="REF nowhere"/></w:p>', {}), ("OBJ-003", W, "<w:ins>" + p("新") + "</w:ins>", {}), ("LANG-001", M, p("x"), {}),
    ("STRUCT-002", W, p("2 二", "Stufe1") + p("3 三", "Stufe1"), {}), ("APP-001", M, p("攻读硕士学位期间取得的成果"), {}), ("APP-002", M, p("攻读硕士学位期间发表的论文"), {}), ("APP-003", M, p("附录 A"), {}), ("RENDER-002", M, p("x"), {}), ("RENDER-003", M, p("x"), {}),
    ("PKG-002", M, p("x"), {}),
]


@pytest.fixture(scope="module")
def fired(spark):
    made = [docx(body if "sectPr" in body else CHAPTER + body + section(refs=REFS), **parts) for _, _, body, parts in FIRES]
    docs = trees.scan(spark.createDataFrame([(f"{i}.docx", bytearray(c)) for i, c in enumerate(made)], "path string, content binary")).persist()
    out = audit(spark, docs)
    names = {r.path: r.doc_id for r in docs.select("path", "doc_id").collect()}
    return out, {(r.doc_id, r.rule_id): r.status for r in out.rule_results.collect()}, [names[f"{i}.docx"] for i in range(len(FIRES))]


@pytest.mark.parametrize("i", range(len(FIRES)), ids=[f[0] for f in FIRES])
def test_each_rule_fires_on_its_document(fired, i):
    assert fired[1][fired[2][i], FIRES[i][0]] == FIRES[i][1]


def test_no_rule_is_left_out():
    assert {d[0] for d in DEFECTS} | {f[0] for f in FIRES} == set(SEVERITY)


def test_findings_carry_what_was_compared(fired):
    rows = fired[0].findings.select("rule_id", F.to_json("evidence").alias("e"), "actual").collect()
    assert rows and all(r.e for r in rows if r.actual is not None)
    by = {}
    for r in rows:
        by.setdefault(r.rule_id, json.loads(r.e) if r.e else None)
    mixed = by["FONT-003"]
    assert mixed["expected"]["east"] == "宋体" and mixed["provenance"][0]["sources"]["east"] == "direct-run"
    body = by["FONT-001"]
    assert body["classification"]["role"] == "body" and body["effective_formats_compared"] >= 1 and body["expected"]["size_pt"] == 12
    actual = json.loads(next(r.actual for r in rows if r.rule_id == "FONT-003"))
    assert actual[0]["mismatched_properties"] == ["east", "latin"] and list(actual[0]) == sorted(actual[0])
    head = by["HEAD-002"]
    assert head["expected"]["size_pt"] == 14 and head["level"] == 2 and head["mismatched_runs"] == [0]
    assert all(r.e == json.dumps(json.loads(r.e), ensure_ascii=False, sort_keys=True, separators=(",", ":")) for r in rows if r.e and r.e[0] == "{" and "." not in r.e)


def test_reviews_keep_the_evidence(spark, fired, tmp_path):
    rows = reviews(fired[0], "2000-01-01T00:00:00Z").select("json").limit(3).collect()
    (tmp_path / "r.jsonl").write_text("\n".join(r.json for r in rows), encoding="utf-8")
    told = [f for r in rows for f in json.loads(r.json)["findings"]]
    assert all(f["location"]["label"] for f in told) and any(isinstance(f.get("evidence"), dict) for f in told)
    back = read_reviews(spark, str(tmp_path / "r.jsonl"), lines=True)[0]
    got = {(r.doc_id, r.finding_id): r.e for r in back.select("doc_id", "finding_id", F.to_json("evidence").alias("e")).collect()}
    want = {(r.doc_id, r.finding_id): r.e for r in fired[0].findings.select("doc_id", "finding_id", F.to_json("evidence").alias("e")).collect()}
    assert got and all(json.loads(want[k] or "null") == json.loads(v or "null") for k, v in got.items())


def test_the_values_that_rules_compare_with():
    assert EXPECTED["page"] == {"width_inches": 8.27, "height_inches": 11.69, "orientation": "portrait", "twips": 20}
    assert EXPECTED["margins"] == {"top": 1.77, "bottom": 1.1, "left": 1.1, "right": 1.1, "twips": 20} and EXPECTED["distances"] == {"header": 42.55, "footer": 48.2, "twips": 20}
    assert EXPECTED["body"] == {"east": "宋体", "latin": "Times New Roman", "size_pt": 12, "allowed": 0.25} and EXPECTED["paragraph"] == {"line_multiple": 1.5, "twips": 10}
    assert EXPECTED["headings"] == {1: 16, 2: 14, 3: 12} and (EXPECTED["heading_font"], EXPECTED["heading_allowed"]) == ("黑体", 0.25)
    assert EXPECTED["header"] == {"font": "楷体", "size_pt": 18, "text": "华中科技大学硕士学位论文", "allowed": 0.25, "rules": 2}


def test_strict_rules_close_the_gaps_of_the_patterns(spark):
    body = p("摘要") + p("本文中我们做") + p("Abstract") + CHAPTER + p("用QRST方法，如图3-7所示") + PICTURE + p("图 3.7 流程") + p("参考文献") + p("[1] 张三. 书名: 北京: 出版社, 2020") + section(refs=REFS)
    docs = trees.scan(spark.createDataFrame([("a.docx", bytearray(docx(body)))], "path string, content binary")).persist()
    got = [{r.rule_id: r.status for r in audit(spark, docs, strict=strict).rule_results.collect()} for strict in (False, True)]
    told = {rule: tuple(g[rule] for g in got) for rule in ("FIG-004", "ABS-006", "LANG-002", "REF-004")}
    assert told == {"FIG-004": ("WARNING", "PASS"), "ABS-006": ("PASS", "WARNING"), "LANG-002": ("PASS", "WARNING"), "REF-004": ("ERROR", "PASS")}
    assert {r for r in got[0] if got[0][r] != got[1][r]} == set(told)


def test_rules_compare_with_the_values_of_a_rule_file(spark, tmp_path):
    stated = {
        "HEAD-002": {"expected_value": {"size_pt": 20, "east_asian_font": "黑体"}, "tolerance": {"size_pt": 0.5}},
        "PAGE-001": {"expected_value": {"width_inches": 7}, "tolerance": {"twips": "20 twips"}}, "PARA-001": {"expected_value": {"line_spacing": "2.5 lines"}, "tolerance": "as it looks"},
        "PAGE-002": {"expected_value": {"top_inches": 1.77, "more": True}, "tolerance": {"twips": None}}, "REF-001": {"expected_value": {"size_pt": 3}},
    }
    path = tmp_path / "rules.json"
    put = lambda own: path.write_text(json.dumps({"rules": [{"rule_id": r, "severity": s} | own.get(r, {}) for r, s in SEVERITY.items()]}, ensure_ascii=False), encoding="utf-8")
    put(stated)
    rules, expected = load(spark, str(path))
    assert expected["headings"] == {1: 16, 2: 20, 3: 12} and expected["heading_allowed"] == {1: 0.25, 2: 0.5, 3: 0.25}
    assert expected["page"] == EXPECTED["page"] | {"width_inches": 7, "twips": 20} and expected["paragraph"] == {"line_multiple": 2.5, "twips": 10}
    assert {k: expected[k] for k in ("margins", "distances", "header", "body")} == {k: EXPECTED[k] for k in ("margins", "distances", "header", "body")} and EXPECTED["headings"][2] == 14
    body = CHAPTER + p("1.1 题目", "Stufe2", rpr=points(20.4)) + p("正文") + section(refs=REFS)
    docs = trees.scan(spark.createDataFrame([("a.docx", bytearray(docx(body)))], "path string, content binary")).persist()
    built_in, own = [{r.rule_id: r.status for r in a.rule_results.collect()} for a in (audit(spark, docs), audit(spark, docs, rules, expected))]
    assert {r: (built_in[r], own[r]) for r in own if built_in[r] != own[r]} == {"PAGE-001": ("PASS", E), "PARA-001": ("PASS", E), "HEAD-002": (E, "PASS")}


@pytest.mark.parametrize("value", [True, -1, "wide", [1], float("inf")])
def test_values_of_the_wrong_kind_are_refused(value):
    with pytest.raises(ValueError, match="PAGE-001: expected_value.width_inches"):
        expected_of({"rules": [{"rule_id": "PAGE-001", "expected_value": {"width_inches": value}}]})
    with pytest.raises(ValueError, match="HF-001: expected_value.text"):
        expected_of({"rules": [{"rule_id": "HF-001", "expected_value": {"text": 3}}]})
