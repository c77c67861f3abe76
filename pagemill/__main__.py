"""The command line: python -m pagemill inspect|review|comment|report|run PATH ..., where PATH is a Word document or a folder of them."""

from __future__ import annotations

import argparse
import posixpath
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans import audit as A
from .plans import review as V
from .plans import workflow as X
from .plans.config import load
from .plans.reporting import check_findings
from .session import build
from .sinks.files import target, write_files
from .sinks.word import reports
from .sources import docx, scan
from .sources.annotate import annotated, now
from .sources.parts import parts_of
from .storage import scratch, staged


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _root(path: str) -> str:
    return posixpath.dirname(path) or "." if path.lower().endswith(".docx") else path


def _absolute(path: str) -> str:
    import os

    return path if "://" in path else os.path.abspath(path)


def _out(rows: DataFrame, args: argparse.Namespace, suffix: str) -> None:
    """JSON rows as files below ``--output``, or on the screen, a partition at a time."""
    if args.output:
        write_files(rows.select(target(F.col("path"), args.root, args.output, suffix, ".json").alias("target"), F.encode("json", "UTF-8").alias("content")), rows.select("path"))
    else:
        for r in rows.select("json").toLocalIterator():
            print(r.json)


def inspect(spark: SparkSession, args: argparse.Namespace) -> None:
    from .plans import formats, roles

    docs = staged(docx.scan(_files(spark, args.path)), scratch(spark), "documents")
    paragraphs = formats.paragraph_formats(docs, docx.paragraphs(docs))
    runs = formats.run_formats(docs, docx.runs(docs), docx.paragraphs(docs)) if args.include_runs else None
    main = roles.classify(paragraphs.filter(F.col("part_name") == docx.MAIN))
    told = A.inspection(docs.dropDuplicates(["doc_id"]), main, args.max_paragraphs, runs)
    _out(docs.select("doc_id", "path").join(told, "doc_id"), args, "_inspection")


def review(spark: SparkSession, args: argparse.Namespace) -> None:
    a = A.audit(spark, docx.scan(_files(spark, args.path)), **_rules(spark, args), strict=args.strict)
    _out(V.reviews(a), args, "_review")


def _rules(spark: SparkSession, args: argparse.Namespace) -> dict:
    """The arguments that a rule file sets: the rules, and the values that they compare with."""
    return dict(zip(("rules", "expected"), load(spark, args.rules), strict=True)) if args.rules else {}


def _json_files(rows: DataFrame, args: argparse.Namespace, suffix: str) -> DataFrame:
    return rows.select(target(F.col("path"), args.root, args.output or args.root, suffix, ".json").alias("target"), F.encode("json", "UTF-8").alias("content"))


def comment(spark: SparkSession, args: argparse.Namespace) -> None:
    files, folder = _files(spark, args.path), scratch(spark)
    nodes = scan.Nodes(parts_of(files), folder)
    docs = staged(nodes.readable(), folder, "readable")
    findings, _ = V.read_reviews(spark, args.findings)
    check_findings(findings)
    texts = scan.texts(nodes).select("doc_id", "part_name", "idx", "text")
    plan = staged(X.plan_comments(findings, texts), folder, "plan")
    copies = staged(annotated(nodes, files, docs, findings, plan, args.author, args.initials), folder, "copies")
    made = copies.select(target(F.col("path"), args.root, args.output or args.root, "_commented").alias("target"), "content")
    if args.manifest:
        made = made.unionByName(_json_files(X.comment_manifests(X.records(plan, copies, findings), copies), args, "_comments"))
    write_files(made, files.select("path"))


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    findings, records = V.read_reviews(spark, args.review)
    if args.comments:
        records = V.read_reviews(spark, args.comments)[1]
    check_findings(findings)
    docs = scan.Nodes(parts_of(_files(spark, args.path)), scratch(spark)).readable()
    made = reports(docs, findings, records, _rules(spark, args).get("rules"), template=args.template_name, created=now())
    made = made.select(target(F.col("path"), args.root, args.output or args.root, "_report").alias("target"), "content")
    if args.manifest:
        made = made.unionByName(_json_files(X.report_manifests(docs, findings, records), args, "_report"))
    write_files(made, docs.select("path"))


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    made = X.review(spark, _files(spark, args.path), **_rules(spark, args), author=args.author, initials=args.initials, template=args.template_name, strict=args.strict)
    print(X.write(made, args.root, args.output or args.root))
    for r in made.audit.quarantine.toLocalIterator():
        print(f"not read: {r.path}: {r.error}", file=sys.stderr)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="pagemill", description="Format reviews of Word documents.")
    commands = out.add_subparsers(dest="command", required=True)
    told = {inspect: "structure and effective formats as JSON", review: "findings of all rules as JSON", comment: "copies with comments, from a review", report: "Word reports, from a review", run: "reviewed copies, reports and manifests"}
    for f, text in told.items():
        own = commands.add_parser(f.__name__, help=text)
        own.set_defaults(call=f)
        own.add_argument("path", help="a Word document, or a folder that is searched for them")
        own.add_argument("-o", "--output", help="folder for what is made")
        if f is inspect:
            own.add_argument("--include-runs", action="store_true")
            own.add_argument("--max-paragraphs", type=int, help="list no more paragraphs of a document; counts cover all")
        if f in (review, report, run):
            own.add_argument("--rules", help="a rule file, JSON or YAML")
        if f in (review, run):
            own.add_argument("--strict", action="store_true", help="close the known gaps of the rules' patterns")
        if f in (comment, run):
            own.add_argument("--author", default="pagemill")
            own.add_argument("--initials", default="PM")
        if f in (comment, report):
            own.add_argument("--manifest", action="store_true", help="write what was done beside each file, as JSON")
        if f is comment:
            own.add_argument("--findings", required=True, help="reviews or manifests")
        if f is report:
            own.add_argument("--review", required=True, help="reviews or manifests")
            own.add_argument("--comments", help="manifests with comment records, if the reviews have none")
        if f in (report, run):
            own.add_argument("--template-name", default="built-in rules", help="the template's name in reports")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    args.path = _absolute(args.path)
    args.root = _root(args.path)
    args.output = _absolute(args.output) if args.output else None
    args.call(spark or build(), args)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
