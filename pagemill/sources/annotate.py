"""Copies of Word packages with review comments.

Comments go in between the pieces of a part's text, at places that the table of nodes gives; no part is serialised anew, so every byte
that isn't a comment's stays. At most four parts differ from the source: the main part, the comments, and where there were none, the
content types and the main part's relationships. What a part becomes is an expression over its text; only the archive itself is put
together outside the JVM, member by member.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import staged
from . import scan, xml
from .docx import MAIN

# Names of Word packages.
_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
_TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
COMMENTS, CONTENT_TYPES, MAIN_RELS = "word/comments.xml", "[Content_Types].xml", "word/_rels/document.xml.rels"
_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.comments+xml"
_KIND = "http://schemas.openxmlformats.org/officeDocument/2006/relationships/comments"
_DECLARATION = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
#: Parts that a copy may change.
TOUCHED = (MAIN, COMMENTS, CONTENT_TYPES, MAIN_RELS)


def now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def fit(text: Column) -> Column:
    """``text`` as XML content, in single or double quotes as well; characters that XML has no place for are left out."""
    out = F.regexp_replace(text, "[^\\t\\n\\r\\x20-\\x{d7ff}\\x{e000}-\\x{fffd}\\x{10000}-\\x{10ffff}]", "")
    for c, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(c), F.lit(name))
    return out


def body(findings: DataFrame) -> Column:
    """What a comment says of a finding, a line for each value it has."""
    told = {"problem": "problem", "actual": "found", "expected": "expected", "source": "source", "suggestion": "advice"}
    lines = [F.when(F.col(c) != "", F.concat(F.lit(f"{name}: "), c)) for c, name in told.items() if c in findings.columns]
    return F.concat_ws("\n", F.concat_ws(" ", F.concat(F.lit("["), "rule_id", F.lit("]")), "severity"), *lines)


def first_ids(n: scan.Nodes) -> DataFrame:
    """(doc_id, base): the first id that no comment of a document and no mark of one has."""
    part, name = F.col("part_name"), F.col("name")
    own = n.told.filter(((part == COMMENTS) & (name == "w:comment")) | ((part == MAIN) & name.isin("w:commentRangeStart", "w:commentRangeEnd", "w:commentReference")))
    used = own.groupBy("doc_id").agg(F.max(F.when(scan.attr("id").rlike("^-*[0-9]+$"), scan.attr("id").try_cast("long"))).alias("_max"))
    return n.names.select("doc_id").distinct().join(used, "doc_id", "left").select("doc_id", (F.greatest(F.coalesce("_max", F.lit(-1)), F.lit(-1)) + 1).alias("base"))


def _mark(name: str, number: Column) -> Column:
    return F.concat(F.lit(f'<w:{name} xmlns:w="{_NS}" w:id="'), number.cast("string"), F.lit('"/>'))


def insertions(n: scan.Nodes, comments: DataFrame) -> DataFrame:
    """(doc_id, before, instead): what stands before the pieces of the main part's text, and instead of them, by their places.

    ``comments``: doc_id, number, paragraph_index, anchor_mode, run_start, run_end. A range of runs counts only if all of them are the
    paragraph's own children; else the whole paragraph is marked."""
    main = n.told.filter(F.col("part_name") == MAIN)
    spans = scan.texts(n).filter(F.col("part_name") == MAIN).select("doc_id", F.col("idx").alias("paragraph_index"), "begin", "end")
    # The first place for content lies behind the properties, where those come first.
    kids = main.filter("name <> '#text'").select("doc_id", F.col("parent").alias("begin"), "pos", F.col("end").alias("kid_end"), "name")
    first = kids.groupBy("doc_id", "begin").agg(F.min_by(F.struct("name", "kid_end"), "pos").alias("kid"))
    spans = spans.join(first, ["doc_id", "begin"], "left").withColumn("inside", F.when(F.col("kid.name") == "w:pPr", F.col("kid.kid_end") + 1).otherwise(F.col("begin") + 1)).drop("kid")
    held = scan.inside(main, "w:p", main.filter("name = 'w:r'").select(*scan.K, F.col("pos").alias("at"), F.col("end").alias("run_stop"), F.col("parent")))
    held = held.withColumn("run", F.row_number().over(W.partitionBy("doc_id", "begin").orderBy("at")) - 1).select("doc_id", "begin", "run", "at", "run_stop", (F.col("parent") == F.col("begin")).alias("own"))
    rows = comments.join(spans, ["doc_id", "paragraph_index"])
    ranged = rows.filter("anchor_mode = 'run_range'").join(held, ["doc_id", "begin"]).filter("run between run_start and run_end")
    ranged = ranged.groupBy("doc_id", "number").agg(F.min("at").alias("from"), F.max("run_stop").alias("to"), F.bool_and("own").alias("own")).filter("own").drop("own")
    rows = rows.join(ranged, ["doc_id", "number"], "left")
    opening = _mark("commentRangeStart", F.col("number"))
    closing = F.concat(_mark("commentRangeEnd", F.col("number")), F.lit(f'<w:r xmlns:w="{_NS}">'), _mark("commentReference", F.col("number")), F.lit("</w:r>"))
    empty = F.col("begin") == F.col("end")
    marks = F.when(empty, F.array(F.struct(F.col("begin").alias("at"), F.lit(True).alias("whole"), F.concat(opening, closing).alias("mark")))).otherwise(
        F.array(F.struct(F.coalesce("from", "inside").alias("at"), F.lit(False).alias("whole"), opening.alias("mark")), F.struct(F.coalesce(F.col("to") + 1, F.col("end")).alias("at"), F.lit(False).alias("whole"), closing.alias("mark")))
    )
    # At one place a range ends before another begins; equal places are in the order of the comments' numbers.
    placed = rows.select("doc_id", "number", F.posexplode(marks).alias("step", "m")).select("doc_id", F.col("m.at").alias("at"), F.col("m.whole").alias("whole"), F.struct((-F.col("step")).alias("s"), "number", F.col("m.mark").alias("mark")).alias("m"))
    joined = placed.groupBy("doc_id", "at", "whole").agg(F.array_join(F.transform(F.array_sort(F.collect_list("m")), lambda x: x["mark"]), "").alias("mark"))
    pair = F.struct("at", "mark")
    return joined.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.when(~F.col("whole"), pair))).alias("before"), F.map_from_entries(F.collect_list(F.when(F.col("whole"), pair))).alias("instead"))


def _rewritten(text: Column) -> Column:
    """The pieces of a text with what is put ``before`` them; a piece that has an entry in ``instead`` is an empty element, which is opened for it."""
    pieces = F.regexp_extract_all(text, F.lit(xml._PIECE), F.lit(0))

    def one(piece: Column, i: Column) -> Column:
        opened, name = F.regexp_replace(piece, r"\s*/>$", ">"), F.regexp_extract(piece, r"^<([^\s/>]+)", 1)
        put = F.try_element_at("instead", i)
        return F.concat(F.coalesce(F.try_element_at("before", i), F.lit("")), F.when(put.isNotNull(), F.concat(opened, put, F.lit("</"), name, F.lit(">"))).otherwise(piece))

    return F.array_join(F.transform(pieces, one), "")


_TAIL = r"(?:\s|<!--[\s\S]*?-->)*$"
_LAST = rf"</[^<>]*>{_TAIL}"
_ALONE = rf"""<([^\s/<>!?]+)(?:[^<>"'/]|"[^"]*+"|'[^']*+'|/(?!>))*+/>{_TAIL}"""


def into_root(text: Column, piece: Column) -> Column:
    """``piece`` as the last child of a document's root; a root of one empty tag is opened."""
    closed = F.concat(F.regexp_replace(text, _LAST, ""), piece, F.regexp_extract(text, _LAST, 0))
    name, alone = F.regexp_extract(text, _ALONE, 1), F.regexp_extract(text, _ALONE, 0)
    opened = F.concat(F.regexp_replace(text, _ALONE, ""), F.regexp_replace(alone, rf"\s*/>{_TAIL}", ">"), piece, F.lit("</"), name, F.lit(">"))
    return F.when(text.rlike(_LAST), closed).otherwise(opened)


def _bytes(text: Column, source: Column) -> Column:
    """``text`` in the encoding of the bytes that it comes from."""
    mark = F.hex(F.substring(source, 1, 2))
    wide = F.when(mark == "FFFE", F.encode(text, "UTF-16LE")).when(mark == "FEFF", F.encode(text, "UTF-16BE"))
    head = F.when(mark.isin("FFFE", "FEFF"), F.substring(source, 1, 2)).when(F.hex(F.substring(source, 1, 3)) == "EFBBBF", F.substring(source, 1, 3)).otherwise(F.lit(b""))
    return F.concat(head, F.coalesce(wide, F.encode(text, "UTF-8")))


def changed_parts(n: scan.Nodes, comments: DataFrame, author: str, initials: str, date: str) -> DataFrame:
    """(doc_id, changed): the parts that ``comments`` change, name and content, for each document that gets any.

    ``comments``: see ``insertions``, and ``lines`` (array of string): the comment's paragraphs."""
    run = lambda x: F.array_join(F.transform(F.split(x, "\n"), lambda y: F.concat(F.lit('<w:t xml:space="preserve">'), fit(y), F.lit("</w:t>"))), "<w:br/>")
    said = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<w:p><w:r>"), run(x), F.lit("</w:r></w:p>"))), "")
    signed = F.concat(F.lit('" w:author="'), fit(F.lit(author)), F.lit('" w:initials="'), fit(F.lit(initials)), F.lit('" w:date="'), fit(F.lit(date)), F.lit('">'))
    one = F.concat(F.lit(f'<w:comment xmlns:w="{_NS}" w:id="'), F.col("number").cast("string"), signed, said, F.lit("</w:comment>"))
    added = comments.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", one.alias("x")))), lambda c: c["x"]), "").alias("added"))
    texts = n.parts.filter(F.col("part_name").isin(*TOUCHED)).select("doc_id", "part_name", "content")
    texts = texts.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("part_name", "content"))).alias("own"))
    taken = n.rels.filter(F.col("source_part") == MAIN).groupBy("doc_id").agg(F.collect_set("rel_id").alias("ids"))
    rows = added.join(insertions(n, comments), "doc_id").join(texts, "doc_id").join(taken, "doc_id", "left")
    source = lambda part: F.try_element_at("own", F.lit(part))
    text = lambda part: xml.utf8(source(part))
    none = F.lit(_DECLARATION + f'<w:comments xmlns:w="{_NS}">')
    made = F.when(source(COMMENTS).isNull(), F.encode(F.concat(none, F.col("added"), F.lit("</w:comments>")), "UTF-8")).otherwise(_bytes(into_root(text(COMMENTS), F.col("added")), source(COMMENTS)))
    override = F.lit(f'<Override xmlns="{_TYPES}" PartName="/{COMMENTS}" ContentType="{_TYPE}"/>')
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    free = F.get(F.filter(F.transform(F.sequence(F.lit(0), F.size(ids)), lambda i: F.concat(F.lit("rIdReview"), i.cast("string"))), lambda x: ~F.array_contains(ids, x)), F.lit(0))
    relation = F.concat(F.lit(f'<Relationship xmlns="{_RELATIONS}" Id="'), free, F.lit(f'" Type="{_KIND}" Target="comments.xml"/>'))
    bare = F.lit(f'<Relationships xmlns="{_RELATIONS}"/>')
    rels = F.when(source(MAIN_RELS).isNull(), F.encode(into_root(bare, relation), "UTF-8")).otherwise(_bytes(into_root(text(MAIN_RELS), relation), source(MAIN_RELS)))
    new = source(COMMENTS).isNull()
    parts = [(MAIN, _bytes(_rewritten(text(MAIN)), source(MAIN))), (COMMENTS, made), (CONTENT_TYPES, F.when(new, _bytes(into_root(text(CONTENT_TYPES), override), source(CONTENT_TYPES)))), (MAIN_RELS, F.when(new, rels))]
    changed = F.filter(F.array(*[F.struct(F.lit(k).alias("name"), v.alias("data")) for k, v in parts]), lambda x: x["data"].isNotNull())
    return rows.select("doc_id", changed.alias("changed"))


def rezipped(content: bytes, changed: dict[str, bytes]) -> bytes:
    """The archive with some members' content changed or added; all others keep their bytes and their places."""
    if not changed:
        return content
    changed, made = dict(changed), io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(content)) as source, zipfile.ZipFile(made, "w", zipfile.ZIP_DEFLATED) as z:
        for info in source.infolist():
            data = changed.pop(info.filename, None)
            z.writestr(info, source.read(info) if data is None else data)
        for name, data in changed.items():
            z.writestr(name, data)
    return made.getvalue()


def annotated(n: scan.Nodes, files: DataFrame, docs: DataFrame, findings: DataFrame, plan: DataFrame, author: str = "pagemill", initials: str = "PM", date: str | None = None) -> DataFrame:
    """(doc_id, path, content, comments, first_comment_id): a commented copy of each package of ``files`` (path, content), whose nodes ``n`` has.

    ``docs`` (doc_id, path) are the files that can be read. ``plan`` is the comment plan of ``findings``; findings of one comment are its
    paragraphs; the plan's ids count from ``first_comment_id``. ``date``: UTC, the present if not given."""
    own = findings.join(plan.filter("commented"), ["doc_id", "finding_id"])
    by = own.groupBy("doc_id", "comment_id", "paragraph_index").agg(F.min("anchor_mode").alias("anchor_mode"), F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"), F.array_sort(F.collect_list(body(findings))).alias("lines"))
    bases = first_ids(n)
    comments = staged(by.join(bases, "doc_id").withColumn("number", F.col("comment_id") + F.col("base")), n.folder, "comments")
    changed = changed_parts(n, comments, author, initials, date or now())
    counts = comments.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("comments"))
    rows = docs.select("doc_id", "path").join(bases, "doc_id").join(counts, "doc_id", "left").join(staged(changed, n.folder, "changed"), "doc_id", "left").join(files.select("path", "content"), "path")
    rows = rows.select("doc_id", "path", "content", F.coalesce("comments", F.lit(0)).alias("comments"), F.col("base").cast("int").alias("first_comment_id"), "changed")

    def copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                parts = {x["name"]: x["data"] for x in row.column(5)[0].as_py() or []}
                made = pa.array([rezipped(row.column(2)[0].as_py(), parts)], pa.binary())
                yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), made, row.column(3), row.column(4)], ["doc_id", "path", "content", "comments", "first_comment_id"])

    return rows.mapInArrow(copies, "doc_id string, path string, content binary, comments int, first_comment_id int")
