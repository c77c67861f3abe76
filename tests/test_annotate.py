"""Commented copies: what goes in, what stays, and that every loss is noticed."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from pagemill.plans.verification import PRESERVED, verified
from pagemill.sources import annotate, scan
from pagemill.sources.parts import parts_of
from pagemill.storage import scratch

from . import trees
from .docx_fixtures import NS, REFS, docx, p, section

CELL = "<w:tbl><w:tr><w:tc>" + p("cell") + "</w:tc></w:tr></w:tbl>"
BODY = p("first") + "<w:p/>" + "<w:p><w:pPr/></w:p>" + CELL + p("last", extra="<w:r><w:t>tail</w:t></w:r>") + section(refs=REFS)
OWN = f'<w:comments {NS}><w:comment w:id="6">{p("old")}</w:comment></w:comments>'


def comment(i, paragraph, mode="paragraph", a=None, b=None, lines=("one <&> \"x\" $1", "two\nlines")):
    return (i, paragraph, mode, a, b, list(lines))


def parts(content):
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return {n: z.read(n) for n in z.namelist()}


def packed(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(name, data)
    return out.getvalue()


NESTED = p("a", extra="<w:hyperlink><w:r><w:t>b</w:t></w:r></w:hyperlink><w:r><w:t>c</w:t></w:r>") + section()
PLAIN = docx(BODY)
#: name: package, comments
CASES = {
    "all places": (PLAIN, [comment(i, i) for i in range(4)] + [comment(4, 4, "run_range", 1, 1)]),
    "own comments": (docx(BODY, word__comments=OWN), [comment(0, 0)]),
    "no comments yet, but an empty part": (docx(BODY, word__comments=f"<w:comments {NS}/>"), [comment(0, 1)]),
    "runs that aren't its own": (docx(NESTED), [comment(0, 0, "run_range", 0, 1)]),
    "runs that are": (docx(NESTED.replace(">c<", ">cc<")), [comment(0, 0, "run_range", 2, 2)]),
    "two at one place": (docx(p("x") + section()), [comment(0, 0), comment(1, 0)]),
    "utf-16": (packed(parts(PLAIN) | {"word/document.xml": ('<?xml version="1.0" encoding="UTF-16"?>' + parts(PLAIN)["word/document.xml"].decode()).encode("utf-16")}), [comment(0, 0)]),
    "with a mark": (packed(parts(PLAIN) | {"word/document.xml": b"\xef\xbb\xbf" + parts(PLAIN)["word/document.xml"]}), [comment(0, 0)]),
    "nothing": (PLAIN[:], []),
}


@pytest.fixture(scope="module")
def copies(spark):
    files = spark.createDataFrame([(k, bytearray(c)) for k, (c, _) in CASES.items()], "path string, content binary")
    n = scan.Nodes(parts_of(files), scratch(spark))
    names = {r.path: r.doc_id for r in n.readable().collect()}
    bases = {r.doc_id: r.base for r in annotate.first_ids(n).collect()}
    rows = [(f"{k}", names[k], bases[names[k]] + i, *rest) for k, (_, cs) in CASES.items() for i, *rest in cs]
    schema = "path string, doc_id string, number long, paragraph_index int, anchor_mode string, run_start int, run_end int, lines array<string>"
    comments = spark.createDataFrame(rows, schema).drop("path")
    changed = {r.doc_id: {x.name: bytes(x.data) for x in r.changed} for r in annotate.changed_parts(n, comments, 'A & "B"', "AB", "2000-01-01T00:00:00Z").collect()}
    return {k: annotate.rezipped(c, changed.get(names[k], {}) if cs else {}) for k, (c, cs) in CASES.items()}, bases, names


def test_a_copy_has_the_comments_and_nothing_else_changes(copies):
    for name, (before, asked) in CASES.items():
        after = copies[0][name]
        old, new = parts(before), parts(after)
        assert {k for k in old if old[k] != new[k]} <= set(annotate.TOUCHED)
        texts = [[(x[1], x[2]) for x in trees.read_package(c)["paragraphs"] if x[0] == trees.MAIN] for c in (before, after)]
        assert texts[0] == texts[1], name
        counts = [trees.read_package(c)["counts"] for c in (before, after)]
        assert counts[1]["comments"] == counts[0]["comments"] + len(asked) and counts[1]["comment_ranges"] == len(asked), name
    assert copies[0]["nothing"] == PLAIN


def test_marks_stand_where_they_should(copies):
    main = parts(copies[0]["all places"])["word/document.xml"].decode()
    place = lambda kind, i: main.index(f'<w:comment{kind} xmlns:w="{annotate._NS}" w:id="{i}"/>')
    assert place("RangeStart", 0) < main.index(">first<") < place("RangeEnd", 0) < place("RangeStart", 1)
    assert main.index("</w:pPr>") < place("RangeStart", 0) and main.index(">last<") < place("RangeStart", 4) < main.index(">tail<")
    nested = parts(copies[0]["runs that are"])["word/document.xml"].decode()
    assert nested.index(">b<") < nested.index("commentRangeStart") < nested.index(">cc<")
    nested = parts(copies[0]["runs that aren't its own"])["word/document.xml"].decode()
    assert nested.index("commentRangeStart") < nested.index(">a<")
    two = parts(copies[0]["two at one place"])["word/document.xml"].decode()
    assert two.index('Start xmlns:w="%s" w:id="0"' % annotate._NS) < two.index('Start xmlns:w="%s" w:id="1"' % annotate._NS)


def test_ids_and_texts(copies):
    own = parts(copies[0]["own comments"])["word/comments.xml"].decode()
    assert 'w:id="7"' in own and ">old<" in own and "one &lt;&amp;&gt; &quot;x&quot; $1" in own and "two</w:t><w:br/><w:t" in own and 'w:author="A &amp; &quot;B&quot;"' in own
    added = parts(copies[0]["all places"])
    assert added["[Content_Types].xml"].count(b"comments+xml") == 1 and added["word/_rels/document.xml.rels"].count(b"rIdReview0") == 1
    assert parts(copies[0]["utf-16"])["word/document.xml"][:2] == parts(CASES["utf-16"][0])["word/document.xml"][:2]


SOUND = docx(p("one") + p("two　words") + '<w:p><w:fldSimple w:instr="PAGE"/></w:p>' + CELL + section(refs=REFS))
LOSSES = {
    "sound": (SOUND, ""),
    "text": (docx(p("one") + p("other words") + '<w:p><w:fldSimple w:instr="PAGE"/></w:p>' + CELL + section(refs=REFS)), "texts differ"),
    "table": (docx(p("one") + p("two　words") + '<w:p><w:fldSimple w:instr="PAGE"/></w:p>' + p("cell") + section(refs=REFS)), "count tables: 1 then 0"),
    "field": (docx(p("one") + p("two　words") + '<w:p><w:fldSimple w:instr="TIME"/></w:p>' + CELL + section(refs=REFS)), "count fields: "),
    "part": (packed({k: v for k, v in parts(SOUND).items() if "farben" not in k}), "untouched parts differ: word/farben.xml"),
    "bytes": (packed(parts(SOUND) | {"word/fuss.xml": parts(SOUND)["word/fuss.xml"] + b" "}), "untouched parts differ: word/fuss.xml"),
    "new part": (packed(parts(SOUND) | {"word/media/x.png": b"1"}), "untouched parts differ: word/media/x.png"),
    "comment": (docx(p("one") + p("two　words") + '<w:p><w:fldSimple w:instr="PAGE"/></w:p>' + CELL + section(refs=REFS), word__comments=OWN), "comments are missing"),
    "torn": (packed(parts(SOUND) | {"word/document.xml": parts(SOUND)["word/document.xml"][:-9]}), "not well formed"),
    "no archive": (b"nothing", "BadZipFile"),
}


def test_every_loss_is_noticed(spark):
    source = spark.createDataFrame([(k, bytearray(SOUND)) for k in LOSSES], "path string, content binary")
    copies = spark.createDataFrame([(k, bytearray(c), 0) for k, (c, _) in LOSSES.items()], "path string, content binary, comments int")
    got = {r.path: r for r in verified(trees.scan(source), copies, scratch(spark)).collect()}
    assert got["sound"].problems == [] and got["sound"].evaluated_count == len(PRESERVED) == 22
    for name, (_, said) in LOSSES.items():
        assert name == "sound" or any(said in x for x in got[name].problems), (name, got[name].problems)


def test_into_root(spark):
    rows = {"<a><b/></a>": "<a><b/>X</a>", "<a/>": "<a>X</a>", '<q:a k="/>" />\n': '<q:a k="/>">X</q:a>', "<a></a><!-- c -->\n": "<a>X</a><!-- c -->\n"}
    got = spark.createDataFrame([(k,) for k in rows], "t string").select("t", annotate.into_root(F.col("t"), F.lit("X"))).collect()
    assert {r[0]: r[1] for r in got} == rows
