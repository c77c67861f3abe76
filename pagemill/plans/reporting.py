"""Reports of findings: the fifteen sections, their rows, and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import relational as R

# The sections of a report, the prefixes of the rules that each lists, and whether it counts as checked whatever the rules.
SECTIONS = (
    ("overview", (), True), ("errors", (), True), ("page setup", ("PAGE", "COVER", "FRONT", "STRUCT", "RENDER"), True), ("characters", ("FONT", "LANG"), True), ("paragraphs", ("PARA",), True),
    ("headings", ("HEAD",), True), ("figures", ("FIG",), False), ("tables", ("TABLE", "TAB"), False), ("equations", ("EQUATION", "EQ"), False), ("contents and abstracts", ("TOC", "ABS"), False),
    ("headers and footers", ("HF",), True), ("notes, references and objects", ("FOOTNOTE", "NOTE", "REF", "BIB", "APPENDIX", "APP", "OBJ", "PKG"), False), ("not commented", (), True),
    ("manual review", (), True), ("statistics", (), True),
)
ERRORS, OTHERS, UNCOMMENTED, MANUAL = (next(i for i, s in enumerate(SECTIONS) if s[0] == n) for n in ("errors", "notes, references and objects", "not commented", "manual review"))
CHECKED, NOT_COVERED = "checked, none", "not covered by these rules; this says nothing about compliance"


def prefix(rule: Column) -> Column:
    return F.upper(F.split(rule, "-")[0])


def last_records(comments: DataFrame) -> DataFrame:
    """One row a finding: of several records that with the greatest ``comment_id`` counts, where there is one, else a commented one."""
    last = F.col("comment_id") if "comment_id" in comments.columns else F.lit(None)
    own = F.max(F.struct(F.coalesce(last.cast("long"), F.lit(-1)).alias("last"), "commented", "skip_reason")).alias("r")
    rows = comments.groupBy("doc_id", "finding_id").agg(own)
    return rows.select("doc_id", "finding_id", "r.commented", "r.skip_reason", F.when(F.col("r.last") >= 0, F.col("r.last")).alias("comment_id"))


def check_findings(findings: DataFrame) -> None:
    """Each finding of a document needs an id of its own."""
    bad = findings.groupBy("doc_id", "finding_id").count().filter("count > 1 or finding_id is null or trim(finding_id) = ''").limit(5).collect()
    if bad:
        raise ValueError(f"findings without an id of their own: {[(r.doc_id, r.finding_id) for r in bad]}")


def routed(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """``findings`` with their comment's record and ``sections``: the ordinals of the sections that list them."""
    joined = findings.join(last_records(comments), ["doc_id", "finding_id"], "left").withColumn("commented", F.coalesce("commented", F.lit(False)))
    own = F.lit(OTHERS)
    for i, (_, names, _) in enumerate(SECTIONS):
        if names:
            own = F.when(prefix(F.col("rule_id")).isin(*names), i).otherwise(own)
    lists = F.array(own, F.when(F.col("severity") == "ERROR", ERRORS), F.when(~F.col("commented"), UNCOMMENTED), F.when(F.col("severity") == "MANUAL_REVIEW", MANUAL))
    reason = F.when(~F.col("commented"), F.coalesce("skip_reason", F.lit("not_in_manifest")))
    return joined.withColumn("sections", F.array_sort(F.array_compact(lists))).withColumn("skip_reason", reason)


def covered(rules: DataFrame | None) -> list[bool]:
    """For each section, whether rules (None: all built-in ones) check it. The catalogue is short."""
    if rules is None:
        return [True] * len(SECTIONS)
    have = {r.p for r in rules.select(prefix(F.col("rule_id")).alias("p")).distinct().collect()}
    return [always or bool(have & set(names)) for _, names, always in SECTIONS]


#: The values that are counted where there is none: of the kinds of ``totals``.
FIXED = {"section": tuple(s[0] for s in SECTIONS), "severity": ("ERROR", "WARNING", "MANUAL_REVIEW"), "status": ("commented",), "total": ("findings",)}


def totals(findings: DataFrame, comments: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, name, n): the findings of each document by section, severity, category and comment status, and in all.

    One pass with grouping sets: a finding comes once for each section that lists it, and counts elsewhere by the first of these rows.
    Sections, severities, comments and the total are there for each document of ``docs`` (doc_id; else of those with findings), be it with zero."""
    every = [i for i, s in enumerate(SECTIONS) if s[0] in ("overview", "statistics")]
    names = F.transform(F.concat(F.array(*map(F.lit, every)), F.col("sections")), lambda i: F.element_at(F.array(*[F.lit(s[0]) for s in SECTIONS]), i + 1))
    rows = routed(findings, comments).select("doc_id", "severity", "category", F.when(F.col("commented"), "commented").otherwise(F.col("skip_reason")).alias("status"), F.posexplode(names).alias("place", "section"))
    kinds = ("section", "severity", "category", "status")
    sets = rows.groupingSets([["doc_id", k] for k in kinds] + [["doc_id"]], "doc_id", *kinds)
    counted = sets.agg(*[F.grouping(k).alias(f"_{k}") for k in kinds], F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("place") == 0).alias("_findings"))
    kind, name = F.lit("total"), F.lit("findings")
    for k in kinds:
        kind, name = F.when(F.col(f"_{k}") == 0, k).otherwise(kind), F.when(F.col(f"_{k}") == 0, F.col(k)).otherwise(name)
    found = counted.select("doc_id", kind.alias("kind"), name.alias("name"), F.when(F.col("_section") == 0, F.col("_rows")).otherwise(F.col("_findings")).alias("n"))
    zeros = F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(v).alias("name"), F.lit(0).cast("long").alias("n")) for k, values in FIXED.items() for v in values]))
    grid = (findings.select("doc_id").distinct() if docs is None else docs.select("doc_id")).select("doc_id", zeros)
    return found.unionByName(grid).groupBy("doc_id", "kind", "name").agg(F.sum("n").alias("n"))


def report(findings: DataFrame, comments: DataFrame, rules: DataFrame | None = None, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, section, ordinal, n, text): how many findings each section of a document's report lists, and what it says of them.

    ``comments``: doc_id, finding_id, commented, skip_reason; a finding without one counts as not in the manifest. ``docs`` (doc_id):
    the documents to report on, else those with findings."""
    known = covered(rules)
    told = F.create_map(*[F.lit(x) for i, s in enumerate(SECTIONS) for x in (s[0], CHECKED if known[i] else NOT_COVERED)])
    places = F.create_map(*[F.lit(x) for i, s in enumerate(SECTIONS) for x in (s[0], i)])
    own = totals(findings if "category" in findings.columns else findings.withColumn("category", prefix(F.col("rule_id"))), comments, docs).filter("kind = 'section'")
    text = F.when(F.col("n") > 0, F.concat(F.col("n"), F.lit(" findings"))).otherwise(F.element_at(told, F.col("name")))
    return own.select("doc_id", F.col("name").alias("section"), F.element_at(places, F.col("name")).alias("ordinal"), "n", text.alias("text"))


def statistics(findings: DataFrame, comments: DataFrame) -> DataFrame:
    """Per document: counts by severity, commented findings and their share in per cent."""
    done = last_records(comments).groupBy("doc_id").agg(F.count_if("commented").alias("commented"), F.count(F.lit(1)).alias("total"))
    counts = R.severity_counts(findings, ["doc_id"]).join(done, "doc_id", "left").fillna(0)
    return counts.withColumn("coverage", R.coverage(F.col("commented"), F.col("total")))


def place(part: Column, section: Column, paragraph: Column, snippet: Column) -> Column:
    """Where a finding is, in words."""
    kind = F.when(part.contains("header"), "header paragraph ").when(part.contains("footer"), "footer paragraph ").when(part == "word/document.xml", "paragraph ").otherwise("paragraph of a note ")
    return F.concat_ws("\n", F.concat(F.lit("section "), section + 1), F.concat(kind, paragraph + 1), F.when(snippet != "", F.concat(F.lit("at: "), snippet)))


def report_rows(docs: DataFrame, findings: DataFrame, comments: DataFrame) -> DataFrame:
    """(doc_id, rows): each document's findings in order, as a report lists them; ``docs`` (doc_id, ...) keeps its columns."""
    rows = routed(findings, comments)
    status = F.when(F.col("commented"), F.concat(F.lit("yes, comment "), F.coalesce(F.col("comment_id").cast("string"), F.lit("?")))).otherwise(F.concat(F.lit("no: "), "skip_reason"))
    what = F.concat_ws("\n", F.concat_ws(": ", "object_type", "problem"), F.concat(F.lit("source: "), "source"), F.concat(F.lit("advice: "), "suggestion"))
    where = place(F.col("part_name"), F.col("section_index"), F.col("paragraph_index"), F.col("snippet"))
    order = [F.col(c) for c in ("engine", "ordinal") if c in findings.columns] or [F.col("finding_id")]
    own = F.struct(*order, F.struct("finding_id", "rule_id", where.alias("place"), what.alias("problem"), "actual", "expected", "severity", status.alias("comment"), "category", "commented", "sections").alias("row"))
    listed = rows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["row"]).alias("rows"))
    return docs.join(listed, "doc_id", "left")
