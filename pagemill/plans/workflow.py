"""From packages to reviewed copies, reports and manifests in one step."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sinks.files import target, write_files
from ..sinks.word import reports
from ..sources import docx, scan
from ..sources.annotate import annotated, now
from ..sources.parts import parts_of
from ..storage import scratch, staged
from .audit import Audit, audit
from .reporting import SECTIONS, check_findings, routed
from .review import review_structs
from .rules import EXPECTED, SEVERITIES, normal
from .verification import PRESERVED, verified


@dataclass
class Review:
    """``audit``, with PKG-002 decided; ``comments``: a record a finding; ``copies`` and ``reports``: (doc_id, path, content, ...); ``manifests``: (doc_id, path, json)."""

    audit: Audit
    comments: DataFrame
    copies: DataFrame
    reports: DataFrame
    manifests: DataFrame


def plan_comments(findings: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The comment plan of findings over scanned paragraphs (doc_id, part_name, idx, text)."""
    own = paragraphs.filter(F.col("part_name") == docx.MAIN).select("doc_id", "part_name", F.col("idx").alias("paragraph_index"), normal(F.col("text")).alias("text"))
    return R.comment_plan(findings.withColumn("snippet", normal(F.col("snippet"))), own)


def decided(a: Audit, copies: DataFrame) -> Audit:
    """``a`` with PKG-002 as the copies (doc_id, problems, evaluated_count) show it: it passes, or is an error that says what differs."""
    wrong = copies.groupBy("doc_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("problems")))).alias("_wrong"), F.max("evaluated_count").alias("_compared"))
    mine = F.col("rule_id") == "PKG-002"
    bad = F.size("_wrong") > 0
    rows = a.findings.join(wrong.drop("_compared"), "doc_id", "left").filter(~mine | F.coalesce(bad, F.lit(True)))
    told = {"severity": F.lit("ERROR"), "problem": F.lit("the copy differs from its source in more than comments"), "actual": F.to_json("_wrong")}
    if "evidence" in a.findings.columns:
        told["evidence"] = F.to_variant_object(F.struct(F.col("_wrong").alias("differences"), F.lit(list(PRESERVED)).alias("preserved_counts")))
    findings = rows.withColumns({k: F.when(mine & bad, v).otherwise(F.col(k)) for k, v in told.items()}).drop("_wrong")
    known = mine & F.col("_wrong").isNotNull()
    values: dict[str, Column] = {"status": F.when(bad, "ERROR").otherwise("PASS"), "finding_count": F.when(bad, 1).otherwise(0).cast("long"), "evaluated_count": F.col("_compared").cast("long")}
    results = a.rule_results.join(wrong, "doc_id", "left").withColumns({k: F.when(known, v).otherwise(F.col(k)) for k, v in values.items()}).drop("_wrong", "_compared")
    return replace(a, findings=findings, rule_results=results)


def review(
    spark: SparkSession, files: DataFrame, rules: DataFrame | None = None, expected: dict = EXPECTED, author: str = "pagemill", initials: str = "PM", date: str | None = None,
    title: str = "Format review", template: str = "built-in rules", folder: str | None = None, strict: bool = False,
) -> Review:
    """Review ``files`` (path, content). Nothing is written but intermediate tables in ``folder``; see ``write``."""
    folder, date = folder or scratch(spark), date or now()
    files = files.select("path", "content")
    nodes = scan.Nodes(parts_of(files), f"{folder}/scan")
    a = audit(spark, scan.documents(nodes), rules, expected, f"{folder}/audit", strict)
    plan = staged(plan_comments(a.findings, a.paragraphs), folder, "plan")
    made = staged(annotated(nodes, files, a.paths, a.findings, plan, author, initials, date), folder, "made")
    sources = a.documents.drop("path").join(a.paths.select("doc_id", "path"), "doc_id")
    checks = staged(verified(sources, made, f"{folder}/check"), folder, "checks")
    copies = made.join(checks, "path")
    a = decided(a, copies)
    a = replace(a, findings=staged(a.findings, folder, "findings"), rule_results=staged(a.rule_results, folder, "results"))
    check_findings(a.findings)
    done = staged(records(plan, copies, a.findings), folder, "records")
    documents = reports(a.paths, a.findings, done, a.rules, title, template, date)
    return Review(a, done, copies, documents, manifests(a, done, copies, date))


def records(plan: DataFrame, copies: DataFrame, findings: DataFrame) -> DataFrame:
    """The comment plan as what was written: with the numbers that the copies' comments have, and the findings' rules."""
    firsts = copies.groupBy("doc_id").agg(F.min("first_comment_id").alias("_first"))
    done = plan.join(firsts, "doc_id").withColumn("comment_id", F.col("comment_id") + F.col("_first")).drop("_first")
    return done.join(findings.select("doc_id", "finding_id", "rule_id"), ["doc_id", "finding_id"])


def _comments(records: DataFrame) -> DataFrame:
    """(doc_id, findings, done): the records of each document, and how many of them are commented."""
    own = records.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("finding_id", "rule_id", "commented", "comment_id", "anchor_mode", "skip_reason"))).alias("findings"))
    return own.withColumn("done", F.size(F.filter("findings", lambda x: x["commented"])))


def _comment_struct(number: Column, kind) -> Column:
    counts = {"comment_count": number, "commented_finding_count": F.coalesce("done", F.lit(0)), "uncommented_finding_count": F.coalesce(F.size("findings") - F.col("done"), F.lit(0))}
    return F.struct(*[c.alias(k) for k, c in counts.items()], F.coalesce("findings", F.array().cast(kind)).alias("findings"))


def comment_manifests(records: DataFrame, copies: DataFrame) -> DataFrame:
    """(path, json): what became of each finding of each copy's source."""
    own = _comments(records)
    source = F.struct("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("doc_id").alias("sha256"))
    rows = copies.select("doc_id", "path", F.col("comments").alias("n")).join(own, "doc_id", "left")
    told = _comment_struct(F.col("n"), own.schema["findings"].dataType).alias("comments")
    return rows.select("path", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), source.alias("source"), told)).alias("json"))


def report_manifests(docs: DataFrame, findings: DataFrame, records: DataFrame) -> DataFrame:
    """(path, json): the numbers of each document's report."""
    rows = routed(findings, records)
    level = lambda s: F.count_if(F.col("severity") == s).alias(s)
    own = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("finding_count"), F.struct(*[level(s) for s in SEVERITIES]).alias("findings_by_severity"), F.count_if("commented").alias("commented_count"), F.count_if(~F.col("commented")).alias("uncommented_count"), F.count_if(F.col("severity") == "MANUAL_REVIEW").alias("manual_review_count"))
    none = {"finding_count": F.lit(0), "findings_by_severity": F.struct(*[F.lit(0).cast("long").alias(s) for s in SEVERITIES]), "commented_count": F.lit(0), "uncommented_count": F.lit(0), "manual_review_count": F.lit(0)}
    told = F.struct(*[F.coalesce(c, v).alias(c) for c, v in none.items()], F.lit(len(SECTIONS)).alias("section_count"))
    return docs.select("doc_id", "path").join(own, "doc_id", "left").select("path", F.to_json(told).alias("json"))


def manifests(a: Audit, records: DataFrame, copies: DataFrame, date: str | None = None) -> DataFrame:
    """(doc_id, path, json) of each readable file: its review, what became of each finding, and whether the copy is sound."""
    own = _comments(records)
    rows = review_structs(a, date, writes=True).join(copies.select("path", "problems", "evaluated_count", F.col("comments").alias("n")), "path").join(own, "doc_id", "left")
    comments = _comment_struct(F.col("n"), own.schema["findings"].dataType)
    checked = F.struct((F.size("problems") == 0).alias("passed"), F.coalesce("evaluated_count", F.lit(0)).alias("evaluated_count"), F.col("problems").alias("differences"))
    return rows.select("doc_id", "path", F.to_json(F.struct(F.lit("1.0").alias("schema_version"), "review", comments.alias("comments"), checked.alias("package_verification"))).alias("json"))


def write(r: Review, root: str, folder: str, copy_suffix: str = "_commented", report_suffix: str = "_report") -> dict[str, int]:
    """Write copies, reports and manifests below ``folder`` as the sources lie below ``root``. Copies and reports need names of their own,
    and no file may take a source's place; both are looked at before the first file is written."""
    if copy_suffix == report_suffix:
        raise ValueError("copies and reports need different names")
    sources = r.audit.paths.select("path")
    products = {"copies": (r.copies, copy_suffix, ".docx"), "reports": (r.reports, report_suffix, ".docx"), "manifests": (r.manifests.withColumn("content", F.encode("json", "UTF-8")), "_review", ".json")}
    return {k: write_files(df.select(target(F.col("path"), root, folder, suffix, kind).alias("target"), "content"), sources) for k, (df, suffix, kind) in products.items()}
