"""Structure, abstract, caption, table, equation, note, reference, object and language rules as relational plans.

Patterns marked as fixed are part of what the rules mean, with their known gaps: a figure number that touches a letter or digit
after it isn't a reference, first persons and acronyms beside Han text aren't seen, and two reference layouts want a comma of each width
in a row. ``STRICT`` are the same rules without these gaps.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pattern as P
from ..operators import sequence as S
from ..sources import docx
from .foundation import off
from .rules import emit

HAN = r"[\x{4e00}-\x{9fff}]"
# Fixed values.
CAPTION_TAIL = r"[。！？；;,.，：:、]"
ENTRY_TAIL = r"[。！？；;,.，：:]"
FIGURE_CAPTION, TABLE_CAPTION = r"\s*图\s*(\d+)\s*[-－.]\s*(\d+)\s*.*", r"\s*表\s*(\d+)\s*[-－.]\s*(\d+)\s*.*"
KEYWORDS = r"(?i:\s*(关键词|Key\s*words?)\s*[：:])"
FIRST_PERSON = r"(?i)\b(?:我们|本文作者|I|we|our)\b"
UNITS = r"(?<!\w)(\d+(?:\.\d+)?)(mm|cm|m|km|mg|kg|g|kPa|MPa|Pa|Hz|kHz|MHz|°C)(?!\w)"
ACRONYM = r"\b[A-Z][A-Z0-9-]{2,}\b"
LAYOUTS = {
    "REF-008": r":\s*\[(?:博士|硕士)学位论文\].*:\s*.*[,]，\s*\d{4}",
    "REF-007": r"(?i)(?:中国|CN|US|EP|WO).*(?:ZL|CN|US|EP|WO)?\s*\d+.*\d{4}",
    "REF-005": r",\s*\d{4}\s*,\s*\d+(?:\s*\(\d+\))?\s*:\s*\S+",
    "REF-004": r"[.:：]\s*[^,，]+[,]，\s*\d{4}",
}
REQUIRED_FRONT = ("独创性声明", "学位论文版权使用授权书")
FIGURE_MENTION = r"图\s*(\d+-\d+)\b"
NUMBERED_ENTRY, CITATION = r"\s*\[\d+\]", r"\[(\d+)\]"
AFTER_REFERENCES = r"\s*(致谢|附录|攻读学位期间)"
INITIALS = r"(?:\A|,\s*)[A-Z](?:\s+[A-Z])?\s+[A-Z][a-z]+"
PATENT, PART_OF, JOURNAL, PAGES = r"(?i)\bZL\s*\d+|专利|patent", r"(?i)(?:见|\bin)\s*[：:]", r",\s*\d{4}\s*,\s*\d+", r":\s*[A-Za-z]?\d+"
RESULTS = "攻读.*学位.*(成果|论文|专利)"


class Patterns(NamedTuple):
    """The patterns that can be read with their gaps or without."""

    first_person: str
    acronym: str
    mention: str
    layouts: dict[str, str]


PARITY = Patterns(FIRST_PERSON, ACRONYM, FIGURE_MENTION, LAYOUTS)
_ALONE = r"(?<![A-Za-z0-9_-]){}(?![A-Za-z0-9_-])"
STRICT = Patterns(
    "(?i)我们|本文作者|" + _ALONE.format("(?:I|we|our)"), _ALONE.format(r"[A-Z][A-Z0-9-]{2,}"), r"图\s*(\d+\s*[-－.]\s*\d+)(?!\d)",
    LAYOUTS | {"REF-008": r":\s*\[(?:博士|硕士)学位论文\].*:\s*.*[,，]\s*\d{4}", "REF-004": r"[.:：]\s*[^,，]+[,，]\s*\d{4}"},
)

Part = tuple[list[DataFrame], list[DataFrame]]


def _marks(df: DataFrame, *rules: str, n: Column | None = None) -> list[DataFrame]:
    """Evaluated counts: ``n`` (or the number of rows) of each document for each rule."""
    own = df.groupBy("doc_id").agg((F.count(F.lit(1)) if n is None else F.sum(n)).cast("long").alias("n"))
    return [own.select("doc_id", F.lit(r).alias("rule_id"), "n") for r in rules]


def _manual(df: DataFrame, rule: str, phase: int, problem: str, actual: Column | None = None, scope: str = "paragraph", k2: int = 0) -> Part:
    """A manual review of each row; it counts as an evaluation."""
    return [emit(df, rule, phase, problem, actual, "MANUAL_REVIEW", k2=k2, scope=scope)], _marks(df, rule)


def _tail(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, P.unicode(r"\s+\z"), "").rlike(P.unicode(pattern + r"\z"))


def _sizes(runs: DataFrame, want: float) -> DataFrame:
    """Per paragraph: sizes of visible runs, and the first run whose size is off."""
    own = runs.filter((P.stripped(F.col("text")) != "") & F.col("size_pt").isNotNull())
    wrong = off(F.col("size_pt"), want, 0.2)
    return own.groupBy("doc_id", "part_name", F.col("p_idx").alias("idx")).agg(
        F.array_sort(F.collect_set("size_pt")).alias("sizes"), F.min(F.when(wrong, F.struct("idx", "size_pt", F.substring("text", 1, 30).alias("t")))).alias("off")
    )


def documents(docs: DataFrame) -> Part:
    """Rules about the package and the document as a whole."""
    good = docs.filter("error is null")
    out, marks = [], _marks(good.select("doc_id", F.size("parts").alias("s")), "PKG-001", n=F.col("s"))
    for rule, phase, problem in (
        ("PKG-002", 1, "the copy can be compared only after it is written"), ("COVER-003", 2, "the order of the author's name needs a reader"), ("LANG-001", 40, "terms, symbols and units need a reader"),
        ("RENDER-001", 60, "layout needs a rendered page"), ("RENDER-002", 61, "headers and footers need a rendered page"), ("RENDER-003", 62, "legibility needs a rendered page"),
    ):
        o, m = _manual(good, rule, phase, problem, scope="document")
        out, marks = out + o, marks + m
    return out, marks


def front(main: DataFrame, docs: DataFrame) -> Part:
    early = main.filter("idx < 80 and stripped <> ''")
    n = P.count(F.col("text"), HAN)
    title = S.first_match(early.withColumn("n", n), ["doc_id"], ["idx"], F.col("n").between(8, 45))
    english = S.first_match(early, ["doc_id"], ["idx"], F.size(P.groups(F.col("text"), "[A-Za-z]+")) >= 4)
    out = [emit(title.filter("n > 30"), "COVER-001", 2, "the title has more than 30 characters", F.col("n"))]
    o, m = _manual(english, "COVER-002", 2, "capitals of the English title need a reader", F.substring("text", 1, 120), k2=1)
    have = early.groupBy("doc_id").agg(*[F.bool_or(F.col("text").contains(r)).alias(f"h{i}") for i, r in enumerate(REQUIRED_FRONT)])
    have = docs.filter("error is null").select("doc_id").join(have, "doc_id", "left")
    lack = F.array_compact(F.array(*[F.when(~F.coalesce(f"h{i}", F.lit(False)), F.lit(r)) for i, r in enumerate(REQUIRED_FRONT)]))
    have = have.withColumn("lack", lack)
    out += [*o, emit(have.filter("size(lack) > 0"), "FRONT-001", 3, "declaration pages may be missing", F.array_join("lack", "、"), scope="document")]
    return out, [*m, *_marks(early, "COVER-001", "COVER-002", "COVER-003", "FRONT-001")]


def abstracts(main: DataFrame, runs: DataFrame, docs: DataFrame, patterns: Patterns = PARITY) -> Part:
    text = F.col("stripped")
    any_of = lambda *ps: reduce(Column.__or__, [P.whole(text, f"(?i:{p})") for p in ps])
    zh_head, en_head = P.whole(text, r"摘\s*要"), P.whole(text, r"(?i:Abstract)")
    zh = S.region(main, ["doc_id"], "idx", zh_head, any_of("Abstract", r"目\s*录.*"))
    en = S.region(main, ["doc_id"], "idx", en_head, any_of("Contents?.*", r"目\s*录.*", r"第?\s*1\s*[章.．、\s].*", r"1(?:\.0)?\s+.*"))
    zh_first, en_first = (S.first_match(main, ["doc_id"], ["idx"], h) for h in (zh_head, en_head))
    han = zh.filter(~P.starts(text, r"关键词\s*[：:]")).groupBy("doc_id").agg(F.sum(P.count(F.col("text"), HAN)).alias("n"))
    long = zh_first.join(han, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n not between 500 and 600")
    out, marks = [emit(long, "ABS-001", 4, "the abstract's length is outside the range", F.col("n"))], _marks(zh, "ABS-001", "ABS-002") + _marks(en, "ABS-003")
    sizes = _sizes(runs, 12)
    for rule, region, multiple in (("ABS-002", zh, None), ("ABS-003", en, 1.5)):
        rows = region.filter("stripped <> ''").join(sizes, ["doc_id", "part_name", "idx"], "left")
        bad = F.col("off").isNotNull()
        if multiple:
            bad = bad | F.coalesce(off(F.col("line_multiple"), multiple, 0.05), F.lit(False))
        out.append(emit(rows.filter(bad), rule, 5, "format of the abstract differs from the rule", F.to_json(F.struct("sizes", "line_multiple"))))
    line = S.first_match(main, ["doc_id"], ["idx"], P.starts(F.col("text"), KEYWORDS))
    value = P.stripped(F.regexp_replace("text", P.unicode(r"\A[^：:]*[：:]"), ""))
    tokens = F.filter(F.transform(F.split(F.regexp_replace(value, P.unicode(CAPTION_TAIL + r"+\z"), ""), "[；;]"), P.stripped), lambda t: t != "")
    problems = F.array_compact(F.array(F.when(~F.size(tokens).between(3, 8), F.concat(F.lit("count "), F.size(tokens))), F.when(value.contains(";"), F.lit("half-width semicolon")), F.when(value.rlike(P.unicode(CAPTION_TAIL + r"\z")), F.lit("final punctuation"))))
    out.append(emit(line.withColumn("bad", problems).filter("size(bad) > 0"), "ABS-004", 6, "keywords differ from the rule", F.array_join(problems, ", ")))
    marks += _marks(line, "ABS-004")
    heads = en_first.unionByName(zh_first.join(en_first.select("doc_id"), "doc_id", "left_anti"))
    o, m = _manual(heads, "ABS-005", 7, "both abstracts need a reader")
    none = docs.filter("error is null").join(heads.select("doc_id"), "doc_id", "left_anti")
    o2, m2 = _manual(none, "ABS-005", 7, "both abstracts need a reader", scope="document")
    both = zh.unionByName(en)
    said = P.groups(F.col("text"), patterns.first_person)
    out += [*o, *o2, emit(both.filter((F.size(said) > 0) | F.col("has_picture") | F.col("has_omml")), "ABS-006", 8, "first person or objects in the abstract", F.array_join(said, ", "))]
    return out, [*marks, *m, *m2, *_marks(both, "ABS-006")]


def contents(main: DataFrame, runs: DataFrame, docs: DataFrame) -> Part:
    codes = main.groupBy("doc_id").agg(F.concat_ws(" ", F.flatten(F.collect_list("instructions"))).alias("codes"))
    entries = main.filter(F.upper("style_id").startswith("TOC"))
    count = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entries"))
    whole = docs.filter("error is null").select("doc_id").join(codes, "doc_id", "left").join(count, "doc_id", "left").fillna({"codes": "", "entries": 0})
    lacks = whole.filter(~P.found(F.col("codes"), r"(?i)\bTOC\b"))
    title = S.first_match(main, ["doc_id"], ["idx"], F.col("stripped") == "目录")
    first = S.first_match(entries, ["doc_id"], ["idx"], F.lit(True))
    place = first.unionByName(title.join(first.select("doc_id"), "doc_id", "left_anti"))
    out = [
        emit(place.join(lacks.select("doc_id", "entries"), "doc_id"), "TOC-001", 9, "no automatic table of contents", F.col("entries")),
        emit(lacks.join(place.select("doc_id"), "doc_id", "left_anti"), "TOC-001", 9, "no automatic table of contents", F.col("entries"), scope="document"),
    ]
    sized = entries.join(_sizes(runs, 14), ["doc_id", "part_name", "idx"], "left")
    bad = F.col("off").isNotNull() | F.coalesce(off(F.col("line_pt"), 25, 0.5), F.lit(False))
    out.append(emit(sized.filter(bad), "TOC-002", 10, "format of a contents entry differs from the rule", F.to_json(F.struct("sizes", "line_pt"))))
    o, m = _manual(first, "TOC-003", 11, "page numbers need an update of all fields")
    rest = whole.filter(F.upper("codes").contains("TOC") & (F.col("entries") == 0))
    o2, m2 = _manual(rest, "TOC-003", 11, "page numbers need an update of all fields", scope="document")
    return [*out, *o, *o2], [*_marks(whole, "TOC-001", n=F.col("entries") + 1), *_marks(entries, "TOC-002"), *m, *m2]


def figures(main: DataFrame, patterns: Patterns = PARITY) -> Part:
    near = S.neighbours(main.withColumn("_row", F.struct("idx", "part_name", "section_index", "text", "alignment")), ["doc_id"], ["idx"], "_row")
    figs = near.filter("in_bounds and not in_table and has_picture").withColumn("has_before", F.coalesce(P.starts(F.col("before.text"), FIGURE_CAPTION), F.lit(False)))
    figs = figs.withColumn("has_after", F.coalesce(P.starts(F.col("after.text"), FIGURE_CAPTION), F.lit(False)))
    at = lambda side: figs.select("doc_id", F.col("idx").alias("figure"), "has_before", "has_after", f"{side}.*")
    out = [
        emit(at("before").filter("has_before and not has_after"), "FIG-002", 12, "the caption is above its figure", F.col("text"), k1=F.col("figure")),
        emit(figs.filter("not has_before and not has_after"), "FIG-002", 12, "the figure has no caption below", k1=F.col("idx")),
    ]
    captions = at("after").filter("has_after").unionByName(at("before").filter("has_before and not has_after"))
    bad = ~F.col("alignment").eqNullSafe(F.lit("center")) | _tail(F.col("text"), CAPTION_TAIL)
    out.append(emit(captions.filter(bad), "FIG-002", 12, "the caption isn't centred or ends in punctuation", F.col("alignment"), k1=F.col("figure"), k2=1))
    number = F.concat_ws("-", *[P.group(F.col("text"), r"\A" + FIGURE_CAPTION, i) for i in (1, 2)])
    # Each paragraph's figure numbers, once; the caption itself doesn't count.
    named = main.select("doc_id", F.col("idx").alias("r_idx"), F.explode(F.array_distinct(F.transform(P.groups(F.col("text"), patterns.mention, 1), lambda x: F.regexp_replace(x, r"\s*[-－.]\s*", "-")))).alias("number"))
    own = captions.withColumn("number", number).alias("c")
    unnamed = own.join(named.alias("n"), (F.col("c.doc_id") == F.col("n.doc_id")) & (F.col("c.number") == F.col("n.number")) & (F.col("c.idx") != F.col("n.r_idx")), "left_anti")
    out.append(emit(unnamed, "FIG-004", 12, "no paragraph refers to the figure", F.col("number"), k1=F.col("figure"), k2=2))
    marks = _marks(figs, *[f"FIG-00{i}" for i in range(1, 6)])
    for rule, rows, problem, k2 in (("FIG-001", figs.filter("has_anchor"), "a floating figure needs a rendered page", 3), ("FIG-003", figs, "text in the image needs a reader", 4), ("FIG-005", figs, "legibility needs a reader", 5)):
        o, m = _manual(rows, rule, 12, problem, k2=k2)
        out, marks = out + o, marks + m
    return out, marks


def tables(main: DataFrame, runs: DataFrame, docs: DataFrame) -> Part:
    own = docs.select("doc_id", F.inline("tables")).withColumn("first", F.array_min("cells"))
    inside = main.filter("in_bounds").select("doc_id", F.col("idx").alias("first"))
    own = own.join(inside, ["doc_id", "first"])
    place = main.select("doc_id", "idx", "part_name", "section_index", "text", "alignment")
    side = lambda name, key: own.select("doc_id", "table_idx", F.col(key).alias("idx")).join(place, ["doc_id", "idx"]).select("doc_id", "table_idx", F.struct("idx", "part_name", "section_index", "text", "alignment").alias(name))
    for name, key in (("before", "before_idx"), ("after", "after_idx"), ("start", "first")):
        own = own.join(side(name, key), ["doc_id", "table_idx"], "left")
    is_caption = lambda c: F.coalesce(P.starts(F.col(f"{c}.text"), TABLE_CAPTION), F.lit(False))
    own = own.withColumn("cap", F.when(is_caption("before"), F.col("before")))
    at = lambda df, c: df.select("doc_id", "table_idx", *[x for x in df.columns if x in ("told", "sample")], f"{c}.*")
    lacks = own.filter("cap is null").withColumn("at", F.when(is_caption("after"), F.col("after")).otherwise(F.col("before")))
    k1 = F.col("table_idx")
    out = [
        emit(at(lacks.filter("at is not null"), "at"), "TAB-002", 13, "the caption is missing or below its table", F.col("text"), k1=k1),
        emit(lacks.filter("at is null"), "TAB-002", 13, "the caption is missing or below its table", k1=k1, scope="document"),
    ]
    bad = ~F.col("cap.alignment").eqNullSafe(F.lit("center")) | _tail(F.col("cap.text"), CAPTION_TAIL)
    out.append(emit(at(own.filter("cap is not null").filter(bad), "cap"), "TAB-002", 13, "the caption isn't centred or ends in punctuation", F.col("text"), k1=k1))
    drawn = lambda n: F.coalesce(F.try_element_at("borders", F.lit(n)) == "1", F.lit(False))
    vertical = F.array_compact(F.array(*[F.when(drawn(n), F.lit(n)) for n in ("insideV", "left", "right")]))
    rules = drawn("top") & drawn("bottom") & F.col("header_bottom")
    lined = own.filter((F.size(vertical) > 0) | ~rules).withColumn("told", F.to_json(F.struct(vertical.alias("vertical"), rules.alias("three_rules")))).withColumn("at", F.coalesce("cap", "start"))
    out.append(emit(at(lined, "at"), "TAB-001", 13, "the table's rules aren't the three wanted", F.col("told"), k1=k1, k2=1))
    cells = own.select("doc_id", "table_idx", F.explode("cells").alias("idx"))
    sized = cells.join(_sizes(runs.filter(F.col("part_name") == docx.MAIN), 10.5).filter("off is not null"), ["doc_id", "idx"])
    wrong = sized.groupBy("doc_id", "table_idx").agg(F.count(F.lit(1)).alias("n"), F.slice(F.array_sort(F.collect_list(F.struct("idx", "off.size_pt", "off.t"))), 1, 4).alias("s"))
    wrong = own.join(wrong, ["doc_id", "table_idx"]).withColumn("told", F.to_json(F.struct("n", "s"))).withColumn("at", F.coalesce("cap", "start"))
    out.append(emit(at(wrong, "at"), "TAB-003", 13, "text size in the table differs from the rule", F.col("told"), k1=k1, k2=2))
    header = own.filter(F.exists("header_cells", lambda t: t.rlike(P.unicode(CAPTION_TAIL + r"\z")))).withColumn("told", F.array_join("header_cells", "；"))
    out.append(emit(at(header, "start"), "TAB-003", 13, "header cells end in punctuation", F.col("told"), k1=k1, k2=3))
    long = own.filter("rows >= 25 and not repeat_header").withColumn("at", F.coalesce("cap", "start"))
    out.append(emit(at(long, "at"), "TAB-004", 13, "a long table doesn't repeat its header", k1=k1, k2=4))
    notes = own.filter(F.coalesce(P.starts(F.col("after.text"), r"(?i:\s*(注|Note)\s*[：:])"), F.lit(False)))
    notes = at(notes, "after").join(_sizes(runs, 10.5).filter("off is not null"), ["doc_id", "part_name", "idx"])
    out.append(emit(notes, "TAB-005", 13, "text size of the note differs from the rule", F.col("off.size_pt"), k1=k1, k2=5))
    out.append(emit(at(own.withColumn("at", F.coalesce("cap", "start")), "at"), "TAB-006", 13, "the table's content needs a reader", severity="MANUAL_REVIEW", k1=k1, k2=6))
    return out, [*_marks(own, *[f"TAB-00{i}" for i in range(1, 7)]), *_marks(own, "TAB-006")]


def equations(main: DataFrame) -> Part:
    own = main.filter("in_bounds and has_omml")
    out = [
        emit(own.filter("alignment is not null and alignment <> 'center' and coalesce(tabs, '') = ''"), "EQ-001", 14, "the equation is neither centred nor tabbed", F.col("alignment")),
        emit(own.filter(~P.found(F.col("stripped"), r"\((\d+)\s*[-.]\s*(\d+)\)\s*\z")), "EQ-002", 14, "the equation has no number in parentheses", F.substring("stripped", -30, 30), k2=1),
    ]
    return out, _marks(own, "EQ-001", "EQ-002")


def notes(paragraphs: DataFrame, runs: DataFrame, docs: DataFrame) -> Part:
    part = "word/footnotes.xml"
    own = paragraphs.filter((F.col("part_name") == part) & (P.stripped(F.col("text")) != ""))
    runs = runs.filter(F.col("part_name") == part)
    foreign = runs.filter(P.found(F.col("text"), HAN) & ~F.coalesce("east", F.lit("宋体")).isin("宋体", "SimSun", "")).select("doc_id", "part_name", F.col("p_idx").alias("idx"), F.lit(True).alias("foreign")).distinct()
    rows = own.join(_sizes(runs, 9), ["doc_id", "part_name", "idx"], "left").join(foreign, ["doc_id", "part_name", "idx"], "left")
    bad = F.col("off").isNotNull() | F.coalesce("foreign", F.lit(False)) | F.coalesce(off(F.col("line_multiple"), 1, 0.05), F.lit(False))
    bad = bad | (F.abs(F.coalesce("left_pt", F.lit(0.0))) > 0.1) | (F.abs(F.coalesce("first_pt", F.lit(0.0))) > 0.1)
    out = [emit(rows.filter(bad), "NOTE-001", 15, "format of the footnote differs from the rule", F.to_json(F.struct("sizes", "foreign", "line_multiple", "left_pt", "first_pt")))]
    o1, m1 = _manual(own.filter(P.found(F.col("text"), r"(?i)https?://|www\.")), "NOTE-004", 15, "a web source needs a reader", F.substring("text", 1, 120), k2=1)
    pages = P.found(F.col("text"), r"(?i)\bpp?\.?\s*\d+[-–]\d+\b") | P.found(F.col("text"), r"第\s*\d+[-–]\d+\s*页")
    o2, m2 = _manual(own.filter(pages), "NOTE-003", 15, "a page range needs a reader", F.substring("text", 1, 120), k2=2)
    have = docs.filter(F.exists("parts", lambda x: x["part_name"] == part))
    restart = F.try_element_at("settings", F.lit("footnote_restart"))
    out.append(emit(have.filter(~restart.eqNullSafe(F.lit("eachPage"))), "NOTE-002", 16, "footnotes don't restart on each page", restart, "WARNING", scope="document"))
    return [*out, *o1, *o2], [*_marks(own, "NOTE-001", "NOTE-003", "NOTE-004"), *_marks(have, "NOTE-002"), *m1, *m2]


def references(main: DataFrame, patterns: Patterns = PARITY) -> Part:
    head = P.whole(F.col("text"), r"\s*参考文献\s*")
    heading = S.first_match(main, ["doc_id"], ["idx"], head)
    entries = S.region(main, ["doc_id"], "idx", head, P.starts(F.col("text"), AFTER_REFERENCES)).filter(P.starts(F.col("text"), NUMBERED_ENTRY))
    entries = entries.withColumn("n", P.group(F.col("text"), r"\A\s*\[(\d+)\]", 1).try_cast("long"))
    listed = entries.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "n"))), lambda x: x["n"]).alias("numbers"))
    gaps = listed.filter(F.col("numbers") != F.sequence(F.lit(1).cast("long"), F.size("numbers").cast("long")))
    first = S.first_match(entries, ["doc_id"], ["idx"], F.lit(True))
    out = [emit(first.join(gaps, "doc_id"), "REF-001", 17, "reference numbers aren't 1 to n in order", F.to_json("numbers"))]
    text = main.join(heading.select("doc_id", F.col("idx").alias("h")), "doc_id", "left").filter("h is null or idx < h")
    cited = text.select("doc_id", "idx", F.explode(P.groups(F.col("text"), CITATION, 1)).alias("c")).select("doc_id", "idx", F.col("c").try_cast("long").alias("n"))
    unknown = cited.join(entries.select("doc_id", "n"), ["doc_id", "n"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_set("n")).alias("lost"), F.min("idx").alias("idx"))
    out.append(emit(main.join(unknown, ["doc_id", "idx"]), "REF-001", 17, "cited numbers have no entry", F.to_json("lost"), k2=1))
    content = F.regexp_replace("stripped", P.unicode(r"\A\s*\[\d+\]\s*"), "")
    rows = entries.withColumn("content", content).withColumn("authors", F.split(content, r"(?U)\.\s+", 2)[0])
    c, a = F.col("content"), F.col("authors")
    names = F.filter(F.transform(F.split(a, "[,，]"), P.stripped), lambda x: x != "")
    out.append(emit(rows.filter(c.rlike(P.unicode(ENTRY_TAIL + r"\z"))), "REF-003", 18, "the entry ends in punctuation", F.substring(c, -1, 1)))
    out.append(emit(rows.filter((F.size(names) > 6) & ~P.found(a, r"(?i)(?:等|et\s+al\.?)\s*\z")), "REF-002", 18, "more than six authors without et al.", a, k2=1))
    initials = P.found(a, INITIALS)
    out.append(emit(rows.filter(initials), "REF-010", 18, "initials without a period", a, k2=2))
    low = F.lower(c)
    kind = (
        F.when(c.contains("[博士") | c.contains("[硕士") | c.contains("学位论文]"), "REF-008")
        .when(P.found(c, PATENT), "REF-007")
        .when(low.contains(" in:") | c.contains(" 见") | c.contains("会议") | low.contains("conference"), "REF-006")
        .when(P.found(c, JOURNAL) & P.found(c, PAGES), "REF-005")
        .otherwise("REF-004")
    )
    fits = F.when(F.col("kind") == "REF-006", P.found(c, PART_OF) & P.found(c, r"\d{4}"))
    for rule, layout in patterns.layouts.items():
        fits = fits.when(F.col("kind") == rule, P.found(c, layout))
    rows = rows.withColumn("kind", kind)
    out.append(emit(rows.filter(~fits), F.col("kind"), 18, "the entry's fields differ from its layout", F.substring(c, 1, 180), k2=3))
    count = heading.join(entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id", "left").fillna({"n": 0})
    out.append(emit(count.filter("n < 40"), "REF-009", 19, "fewer than 40 references", F.col("n")))
    o, m = _manual(heading, "REF-011", 20, "facts of the entries need a reader")
    return [*out, *o], [*_marks(entries, *[f"REF-{i:03d}" for i in range(1, 12)]), *m]


def objects(main: DataFrame, docs: DataFrame) -> Part:
    good = docs.filter("error is null")
    n = lambda k: F.coalesce(F.try_element_at("counts", F.lit(k)), F.lit(0))
    o, m = _manual(good.filter(n("main_shapes") > 0), "OBJ-001", 30, "overlap of objects needs a rendered page", n("main_shapes"), scope="document")
    targets = main.select("doc_id", F.explode("instructions").alias("c")).select("doc_id", P.group(F.col("c"), r"(?i)\b(?:REF|PAGEREF)\s+([^\s\\]+)", 1).alias("name")).filter("name is not null")
    marks_ = good.select("doc_id", F.explode("bookmarks").alias("name"))
    broken = targets.join(marks_, ["doc_id", "name"], "left_anti").groupBy("doc_id").agg(F.array_sort(F.collect_set("name")).alias("lost"))
    out = [*o, emit(broken, "OBJ-002", 31, "a reference names no bookmark", F.array_join("lost", "、"), scope="document")]
    kept = [n(f"main_{k}") for k in ("revisions", "controls", "comment_ranges")]
    some = good.filter(sum(kept[1:], kept[0]) > 0)
    out.append(emit(some, "OBJ-003", 32, "objects that a copy must keep", F.concat_ws(", ", *[k.cast("string") for k in kept]), "WARNING", scope="document"))
    codes = main.groupBy("doc_id").agg(F.sum(F.size("instructions")).alias("codes"))
    counted = good.join(codes, "doc_id", "left").select("doc_id", (F.coalesce("codes", F.lit(0)) + F.size(F.array_distinct("bookmarks"))).alias("b"), n("main_shapes").alias("a"), sum(kept[1:], kept[0]).alias("c"))
    return out, [*m, *[x for r, k in (("OBJ-001", "a"), ("OBJ-002", "b"), ("OBJ-003", "c")) for x in _marks(counted, r, n=F.col(k))]]


def language(main: DataFrame, docs: DataFrame, patterns: Patterns = PARITY) -> Part:
    own = main.filter("in_bounds and not in_table")
    tokens = P.groups(F.col("text"), patterns.acronym)
    seen = S.first_seen(own, ["doc_id"], ["idx"], tokens)
    first = seen.filter("rank <= 30").join(own.select("doc_id", "idx", "part_name", "section_index", "text"), ["doc_id", "idx"])
    # The token is letters, digits and hyphens, so it needs no quoting inside the pattern.
    explained = F.regexp_like("text", F.concat(F.lit(P.unicode(rf"(?:[A-Za-z][A-Za-z\s-]{{3,}}|{HAN}{{2,}})[（(]")), F.col("token"), F.lit("[）)]")))
    out = [emit(first.filter(~explained), "LANG-002", 41, "an acronym isn't explained where it first appears", F.col("token"), k1=F.col("rank"))]
    units = P.groups(F.col("text"), UNITS)
    out.append(emit(own.filter(F.size(units) > 0), "LANG-003", 42, "no space between number and unit", F.array_join(F.slice(units, 1, 8), "、")))
    marks = [*_marks(seen, "LANG-002"), *_marks(own, "LANG-003")]
    chapters = main.filter("in_bounds and role = 'heading_1'")
    n = docs.filter("error is null").select("doc_id").join(chapters.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chapters")), "doc_id", "left")
    n = n.join(own.groupBy("doc_id").agg(F.sum(F.length(P.compact(F.col("text")))).alias("chars")), "doc_id", "left")
    n = n.join(main.filter(F.col("text").contains("本章小结")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("summaries")), "doc_id", "left").fillna(0)
    top = S.first_match(chapters, ["doc_id"], ["idx"], F.lit(True))
    for rule, bad, phase in (("STRUCT-001", "chapters < 5 or chars < 25000", 43), ("STRUCT-002", "summaries < greatest(0, chapters - 2)", 44)):
        rows, told = n.filter(bad), F.to_json(F.struct("chapters", "chars", "summaries"))
        out.append(emit(top.join(rows, "doc_id"), rule, phase, "fewer chapters, characters or summaries than wanted", told, "WARNING"))
        out.append(emit(rows.join(top.select("doc_id"), "doc_id", "left_anti"), rule, phase, "fewer chapters, characters or summaries than wanted", told, "WARNING", scope="document"))
    marks += _marks(n, "STRUCT-001", n=F.col("chapters")) + _marks(n, "STRUCT-002", n=F.col("chapters"))
    made = S.first_match(main, ["doc_id"], ["idx"], P.found(F.col("text"), RESULTS))
    appendix = S.first_match(main, ["doc_id"], ["idx"], P.starts(F.col("text"), r"\s*附录"))
    for rule, rows, problem in (("APP-001", made, "authorship of the results needs a reader"), ("APP-002", made, "state of publication needs a reader"), ("APP-003", appendix, "fitness of the appendix needs a reader")):
        o, m = _manual(rows, rule, 50, problem, k2=int(rule[-1]))
        out, marks = out + o, marks + m + _marks(rows, rule)
    return out, marks


def review(docs: DataFrame, main: DataFrame, paragraphs: DataFrame, runs: DataFrame, strict: bool = False) -> dict[str, Part]:
    """Findings (not yet numbered) and evaluated counts of the advanced rules, by group; ``strict``: see ``STRICT``."""
    patterns = STRICT if strict else PARITY
    return {
        "document": documents(docs), "front": front(main, docs), "abstracts": abstracts(main, runs, docs, patterns), "contents": contents(main, runs, docs), "figures": figures(main, patterns),
        "tables": tables(main, runs, docs), "equations": equations(main), "notes": notes(paragraphs, runs, docs), "references": references(main, patterns), "objects": objects(main, docs),
        "language": language(main, docs, patterns),
    }
