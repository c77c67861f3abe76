"""Reviews as JSON, one object a file, and back to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.annotate import now
from .audit import Audit

VERSION = "1.0"
_LOCATION = "struct<scope:string,part_name:string,section_index:int,paragraph_index:int,label:string,snippet:string>"
_ANCHOR = "struct<part_name:string,paragraph_index:int,snippet:string,run_start:int,run_end:int>"
FINDING = f"struct<finding_id:string,rule_id:string,category:string,object_type:string,severity:string,problem:string,actual:string,expected:string,source:string,suggestion:string,location:{_LOCATION},anchor:{_ANCHOR},evidence:variant>"
RECORD = "struct<finding_id:string,rule_id:string,commented:boolean,comment_id:long,anchor_mode:string,skip_reason:string>"
_SOURCE = "struct<path:string,filename:string,size_bytes:long,sha256:string>"
_REVIEW = f"source:{_SOURCE},findings:array<{FINDING}>"
#: What is read of a review, or of a manifest that has one in it. JSON values of other kinds in text columns are kept as JSON text.
SCHEMA = f"source {_SOURCE}, findings array<{FINDING}>, review struct<{_REVIEW}>, comments struct<findings:array<{RECORD}>>"


def _severities(c: Column, names: tuple[str, ...]) -> Column:
    number = lambda name: F.size(F.filter(c, lambda x: x == name)).cast("long")
    return F.struct(*[number(n).alias(n) for n in names])


def finding_structs(findings: DataFrame) -> DataFrame:
    """(doc_id, findings): each document's findings in order, as JSON readers expect them."""
    told = {"section": F.col("section_index"), "paragraph": F.col("paragraph_index")}
    label = F.concat_ws(", ", *[F.when(c.isNotNull(), F.concat(F.lit(f"{n} "), c + 1)) for n, c in told.items()])
    label = F.when(label == "", F.lit("document")).otherwise(label).alias("label")
    location = F.struct("scope", "part_name", "section_index", "paragraph_index", label, "snippet").alias("location")
    anchor = F.when(F.col("paragraph_index").isNotNull(), F.struct("part_name", "paragraph_index", "snippet", "run_start", "run_end")).alias("anchor")
    own = F.struct("finding_id", "rule_id", "category", "object_type", "severity", "problem", "actual", "expected", "source", "suggestion", location, anchor, "evidence")
    later = lambda a, b: F.when(a["engine"] == b["engine"], a["ordinal"] - b["ordinal"]).otherwise(a["engine"] - b["engine"]).cast("int")
    rows = findings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("engine", "ordinal", own.alias("f"))), later).alias("all"))
    return rows.select("doc_id", F.transform("all", lambda x: x["f"]).alias("findings"))


def review_structs(a: Audit, created: str | None = None, writes: bool = False) -> DataFrame:
    """(doc_id, path, review) for each readable file; see the keys of ``review`` below."""
    results = a.rule_results.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "rule_id", "status", "finding_count", "evaluated_count"))).alias("rule_results"))
    one = a.rules.agg(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "rule_id"))), lambda x: x["rule_id"]).alias("implemented_rule_ids"))
    rows = a.paths.join(results, "doc_id").join(finding_structs(a.findings), "doc_id", "left").crossJoin(F.broadcast(one))  # one row: the names of the rules
    none = F.array().cast(rows.schema["findings"].dataType)
    rows = rows.withColumn("findings", F.coalesce("findings", none))
    source = F.struct("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("size").alias("size_bytes"), F.col("doc_id").alias("sha256"))
    coverage = F.struct("implemented_rule_ids", F.size("implemented_rule_ids").alias("implemented_rule_count"), F.size("implemented_rule_ids").alias("total_rule_count"))
    statistics = F.struct(
        F.size("findings").alias("total_findings"), _severities(F.col("findings.severity"), ("ERROR", "WARNING", "MANUAL_REVIEW")).alias("findings_by_severity"),
        _severities(F.col("rule_results.status"), ("PASS", *R.SEVERITIES[-3:])).alias("rules_by_status"),
    )
    limits = F.array(F.lit("Final page numbers, automatic page breaks and overlaps can't be told from a package."), F.lit("A rule that passes with nothing evaluated had nothing to look at."))
    return rows.select("doc_id", "path", F.struct(
        F.lit(VERSION).alias("schema_version"), source.alias("source"), F.lit(created or now()).alias("created_at_utc"),
        F.struct((F.lit(not writes)).alias("read_only"), F.lit(writes).alias("writes_word_comments"), F.lit(writes).alias("writes_word_report"), F.lit(False).alias("render_dependent_layout_checked")).alias("capabilities"),
        coverage.alias("coverage"), statistics.alias("statistics"), "rule_results", "findings", limits.alias("limitations"),
    ).alias("review"))


def reviews(a: Audit, created: str | None = None) -> DataFrame:
    """(doc_id, path, json): the review of each readable file."""
    return review_structs(a, created).select("doc_id", "path", F.to_json("review").alias("json"))


def read_reviews(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """Findings and comment records of review or manifest files: one object a file, or with ``lines`` one a line.

    The document's id is the hash that the review names. A finding without a place has none here; ``ordinal`` is its position."""
    raw = spark.read.schema(SCHEMA).option("multiLine", not lines).json(path)
    own = raw.select(F.lower(F.coalesce("review.source.sha256", "source.sha256")).alias("doc_id"), F.coalesce("review.findings", "findings").alias("findings"), F.col("comments.findings").alias("records"))
    rows = own.select("doc_id", F.posexplode("findings").alias("ordinal", "f"))
    kept = [F.col(f"f.{c}").alias(c) for c in ("finding_id", "rule_id", "category", "object_type", "severity", "problem", "actual", "expected", "source", "suggestion")]
    part = F.coalesce("f.anchor.part_name", "f.location.part_name")
    findings = rows.select(
        "doc_id", F.lit(0).alias("engine"), "ordinal", *kept, F.col("f.location.scope").alias("scope"), part.alias("part_name"), F.col("f.location.section_index").alias("section_index"),
        F.col("f.anchor.paragraph_index").alias("paragraph_index"), F.coalesce("f.anchor.snippet", "f.location.snippet").alias("snippet"), F.col("f.anchor.run_start").alias("run_start"), F.col("f.anchor.run_end").alias("run_end"), F.col("f.evidence").alias("evidence"),
    )
    return findings, own.select("doc_id", F.inline("records"))
