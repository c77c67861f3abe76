"""Rule files, reviews, copies, reports and the command line, on files in a folder."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pagemill.__main__ import main
from pagemill.plans import reporting, review, workflow
from pagemill.plans.audit import Audit
from pagemill.plans.config import load_rules
from pagemill.plans.rules import FOUNDATION, SEVERITY, rules_table
from pagemill.sinks.files import target, write_files
from pagemill.sinks.word import report_document

from . import trees
from .docx_fixtures import REFS, docx, p, section
from .test_audit import BAD, GOOD, HEADER

SPACED = p("1 绪论", "Stufe1") + p("有  两个 空格的一段 &amp; &lt;话&gt;") + section(refs=REFS)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    base = tmp_path_factory.mktemp("theses")
    (base / "in" / "sub").mkdir(parents=True)
    (base / "in" / "good.docx").write_bytes(docx(GOOD, header=HEADER))
    (base / "in" / "a b.docx").write_bytes(docx(BAD))
    (base / "in" / "sub" / "good.docx").write_bytes(docx(GOOD, header=HEADER))  # the same bytes under another path
    (base / "in" / "spaced.docx").write_bytes(docx(SPACED))
    (base / "in" / "broken.docx").write_bytes(b"nothing")
    return base


@pytest.fixture(scope="module")
def ran(spark, folder):
    assert main(["run", str(folder / "in"), "-o", str(folder / "out"), "--author", "Q & R"], spark) == 0
    return folder / "out"


def test_one_step_writes_a_copy_a_report_and_a_manifest_of_each_file(ran):
    names = sorted(str(x.relative_to(ran)) for x in ran.rglob("*") if x.is_file())
    assert names == sorted(f"{stem}{end}" for stem in ("good", "a b", "sub/good", "spaced") for end in ("_commented.docx", "_report.docx", "_review.json"))


def test_a_manifest_agrees_with_itself_and_its_copy(folder, ran):
    for name in ("good", "a b", "spaced"):
        m = json.loads((ran / f"{name}_review.json").read_text())
        r, records = m["review"], m["comments"]["findings"]
        assert r["source"]["sha256"] == hashlib.sha256((folder / "in" / f"{name}.docx").read_bytes()).hexdigest()
        assert m["package_verification"]["passed"] and len(r["rule_results"]) == 76
        package = next(x for x in r["rule_results"] if x["rule_id"] == "PKG-002")
        assert (package["status"], package["finding_count"], package["evaluated_count"]) == ("PASS", 0, 22)
        ids = [f["finding_id"] for f in r["findings"]]
        assert len(set(ids)) == len(ids) == r["statistics"]["total_findings"] == len(records) and not any(i.startswith("PKG-002") for i in ids)
        assert sum(x["finding_count"] for x in r["rule_results"]) == len(ids)
        assert sum(r["statistics"]["findings_by_severity"].values()) == len(ids) and sum(r["statistics"]["rules_by_status"].values()) == 76
        text = trees.Package((ran / f"{name}_commented.docx").read_bytes()).parts.get("word/comments.xml", b"").decode()
        for x in records:
            assert x["commented"] == (f'w:id="{x.get("comment_id")}"' in text and f"[{x['rule_id']}]" in text) or not x["commented"]
        assert all(f["expected"] and f["suggestion"] and f["object_type"] for f in r["findings"])


def test_places_with_repeated_spaces_are_commented(ran):
    m = json.loads((ran / "spaced_review.json").read_text())
    spaced = [x for x in m["comments"]["findings"] if x["rule_id"] == "PARA-002"]
    assert spaced and all(x["commented"] for x in spaced)


def test_a_report_has_fifteen_sections_and_a_row_a_listing(ran):
    content = (ran / "a b_report.docx").read_bytes()
    row = trees.read_package(content)
    assert row["error"] is None
    heads = [x[2] for x in row["paragraphs"] if x[3] == "Heading1"]
    assert [h.split()[0] for h in heads] == [str(i) for i in range(1, 16)]
    m = json.loads((ran / "a b_review.json").read_text())
    cells = [x[2] for x in row["paragraphs"] if x[3] == "Cell"]
    records = {x["finding_id"]: x for x in m["comments"]["findings"]}
    for f in m["review"]["findings"]:
        listed = 1 + (f["severity"] == "ERROR") + (f["severity"] == "MANUAL_REVIEW") + (not records[f["finding_id"]]["commented"])
        assert cells.count(f["finding_id"]) == listed
    assert row["sections"][0][1:4] == (16838, 11906, "landscape") and any(c == "PAGE" for _, c in row["fields"])


def test_comments_and_reports_can_be_made_from_reviews(spark, folder, ran):
    again = folder / "again"
    main(["review", str(folder / "in" / "a b.docx"), "-o", str(again)], spark)
    main(["comment", str(folder / "in" / "a b.docx"), "--findings", str(again / "a b_review.json"), "-o", str(again), "--manifest"], spark)
    main(["report", str(folder / "in" / "a b.docx"), "--review", str(ran / "a b_review.json"), "--comments", str(again / "a b_comments.json"), "-o", str(again), "--manifest"], spark)
    assert {x.name for x in again.iterdir() if not x.name.startswith(".")} == {"a b_review.json", "a b_commented.docx", "a b_comments.json", "a b_report.docx", "a b_report.json"}
    numbers, records = json.loads((again / "a b_report.json").read_text()), json.loads((again / "a b_comments.json").read_text())["comments"]
    assert numbers["section_count"] == 15 and numbers["commented_count"] == records["commented_finding_count"] > 0 and numbers["finding_count"] == numbers["commented_count"] + numbers["uncommented_count"]
    count = lambda x: len(trees.Package(x.read_bytes()).parts["word/comments.xml"].split(b"<w:comment "))
    assert count(again / "a b_commented.docx") == count(ran / "a b_commented.docx")
    cells = [[x[2] for x in trees.read_package((d / "a b_report.docx").read_bytes())["paragraphs"] if x[3] == "Cell" and x[2].startswith(("yes", "no"))] for d in (again, ran)]
    assert cells[0] == cells[1]


def test_inspection_lists_runs_and_limits_only_paragraphs(spark, folder, capsys):
    main(["inspect", str(folder / "in" / "good.docx"), "--include-runs", "--max-paragraphs", "2"], spark)
    out = json.loads(capsys.readouterr().out)
    assert len(out["paragraphs"]) == 2 < out["inventory"]["paragraphs_body"] and sum(out["role_counts"].values()) == out["inventory"]["paragraphs_body"]
    assert out["paragraphs"][0]["runs"][0]["text"] == "1 绪论" and out["styles"]["types"] == {"character": 1, "paragraph": 7}
    assert set(out["relationships"]) == {"word/document.xml"} and out["source"]["filename"] == "good.docx"


def test_nothing_takes_the_place_of_a_source_or_of_another_file(spark, tmp_path):
    frame = spark.createDataFrame([(f"file:{tmp_path}/a.docx", bytearray(b"1")), (f"{tmp_path}/b.docx", bytearray(b"2"))], "path string, content binary")
    with pytest.raises(ValueError, match="source"):
        write_files(frame.select(F.col("path").alias("target"), "content"), frame)
    with pytest.raises(ValueError, match="more than one"):
        write_files(frame.select(F.lit(f"{tmp_path}/c").alias("target"), "content"), frame)
    assert not list(tmp_path.iterdir())
    made = frame.select(target(F.col("path"), str(tmp_path), f"{tmp_path}/o", "_x").alias("target"), "content")
    assert write_files(made, frame) == 2 and (tmp_path / "o" / "a_x.docx").read_bytes() == b"1" and write_files(made.limit(0), frame) == 0


def test_a_copy_that_lost_something_is_an_error(spark):
    rows = lambda values, schema: spark.createDataFrame(values, schema)
    findings = rows([(d, r, "MANUAL_REVIEW", "later", "") for d in ("sound", "lossy", "uncopied") for r in ("PKG-002", "REF-011")], "doc_id string, rule_id string, severity string, problem string, actual string")
    results = rows([(d, "PKG-002", "MANUAL_REVIEW", 1, 1) for d in ("sound", "lossy", "uncopied")], "doc_id string, rule_id string, status string, finding_count long, evaluated_count long")
    copies = rows([("sound", [], 22), ("sound", [], 22), ("lossy", [], 22), ("lossy", ["texts differ"], 22)], "doc_id string, problems array<string>, evaluated_count long")
    after = workflow.decided(Audit(findings, findings, results, *[findings] * 5), copies)
    got = {(r.doc_id, r.rule_id): (r.severity, r.actual) for r in after.findings.collect()}
    assert got.pop(("lossy", "PKG-002")) == ("ERROR", '["texts differ"]') and set(got) == {(d, "REF-011") for d in ("sound", "lossy", "uncopied")} | {("uncopied", "PKG-002")}
    status = {r.doc_id: (r.status, r.finding_count, r.evaluated_count) for r in after.rule_results.collect()}
    assert status == {"sound": ("PASS", 0, 22), "lossy": ("ERROR", 1, 22), "uncopied": ("MANUAL_REVIEW", 1, 1)}


def test_rule_files(spark, tmp_path):
    own = [{"rule_id": r, "severity": SEVERITY[r], "expected_value_zh": f"要求 {r}"} for r in SEVERITY]
    path = tmp_path / "rules.json"
    put = lambda x: path.write_text(json.dumps(x, ensure_ascii=False), encoding="utf-8")
    put({"rules": [own[0] | {"severity": "MANUAL_REVIEW"}, *own[1:]]})
    rows = load_rules(spark, str(path)).orderBy("ordinal").collect()
    assert [r.rule_id for r in rows] == list(SEVERITY) and rows[0].severity == "MANUAL_REVIEW" and rows[3].expected.startswith("要求") and rows[0].object_type
    for bad, said in (({}, "list"), ({"rules": own + own[:1]}, "repeated"), ({"rules": [{"severity": "ERROR"}]}, "rule_id"), ({"rules": own[len(FOUNDATION) :]}, "missing"), ({"rules": [own[0] | {"severity": "x"}, *own[1:]]}, "severity")):
        put(bad)
        with pytest.raises(ValueError, match=said):
            load_rules(spark, str(path))
    (tmp_path / "rules.yaml").write_text("rules: []")
    put({"rules": own, "runtime_mirror": {"source_file": "rules.yaml", "source_sha256": "00"}})
    with pytest.raises(ValueError, match="changed"):
        load_rules(spark, str(path))


def test_sections_that_no_rule_covers_say_so(spark):
    findings = spark.createDataFrame([("d", "PAGE-001-0001", "PAGE-001", "ERROR")], "doc_id string, finding_id string, rule_id string, severity string")
    none = spark.createDataFrame([], "doc_id string, finding_id string, commented boolean, comment_id long, skip_reason string")
    rules = rules_table(spark).filter("engine = 'foundation'")
    rows = {r.section: r for r in reporting.report(findings, none, rules, spark.createDataFrame([("d",), ("e",)], "doc_id string")).filter("doc_id = 'd'").collect()}
    assert rows["figures"].text == reporting.NOT_COVERED and rows["headings"].text == reporting.CHECKED and rows["page setup"].n == rows["errors"].n == rows["not commented"].n == 1
    with pytest.raises(ValueError, match="id of their own"):
        reporting.check_findings(findings.unionByName(findings))


def test_reviews_of_others_are_read(spark, tmp_path):
    finding = {"finding_id": "A-1", "rule_id": "FONT-001", "severity": "ERROR", "problem": "x", "evidence": {"a": [1]}, "location": {"scope": "paragraph", "section_index": 0}, "anchor": {"part_name": "word/document.xml", "paragraph_index": 2}}
    (tmp_path / "m.json").write_text(json.dumps({"review": {"source": {"sha256": "AB"}, "findings": [finding, finding | {"finding_id": "A-2", "anchor": None}]}, "comments": {"findings": [{"finding_id": "A-1", "commented": True, "comment_id": 3}]}}, indent=1))
    findings, records = review.read_reviews(spark, str(tmp_path / "m.json"))
    assert [(r.doc_id, r.finding_id, r.paragraph_index) for r in findings.orderBy("ordinal").collect()] == [("ab", "A-1", 2), ("ab", "A-2", None)]
    assert records.first().comment_id == 3


def test_a_report_on_nothing_and_on_odd_characters():
    row = {"finding_id": "x\x00<&>", "rule_id": None, "sections": [1], "commented": False, "severity": None, "category": None}
    for rows in ([], [row]):
        assert trees.read_package(report_document("n\x01", rows, [True] * 15, {}, "t & t", ()))["error"] is None

