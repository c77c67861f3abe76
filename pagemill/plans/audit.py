"""The audit of a corpus of Word documents: from packages to findings, rule results and reports."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import docx
from ..storage import scratch, staged, together
from . import advanced, foundation, formats, roles
from .rules import EXPECTED, check_rules, described, numbered, rule_results, rules_table


@dataclass
class Audit:
    """``paragraphs``: the main part, classified; ``findings``; ``rule_results``; ``quarantine``: packages that can't be read;
    ``documents``: one row a readable package; ``paths``: (doc_id, path, size) of all its files; ``rules``: the catalogue;
    ``runs``: all runs with their effective formats."""

    paragraphs: DataFrame
    findings: DataFrame
    rule_results: DataFrame
    quarantine: DataFrame
    documents: DataFrame
    paths: DataFrame
    rules: DataFrame
    runs: DataFrame


def _distinct(docs: DataFrame, folder: str) -> DataFrame:
    """One row a package, that of its least path: files of equal bytes are one document. Most corpora have none, and nothing is moved."""
    if not docs.groupBy("doc_id").count().filter("count > 1").limit(1).collect():
        return docs
    first = docs.groupBy("doc_id").agg(F.min("path").alias("path"))
    return staged(docs.join(first, ["doc_id", "path"], "left_semi").dropDuplicates(["doc_id"]), folder, "distinct")


def audit(spark: SparkSession, docs: DataFrame, rules: DataFrame | None = None, expected: dict = EXPECTED, folder: str | None = None, strict: bool = False) -> Audit:
    """Audit scanned documents (see ``sources.docx``). ``folder``: an unused folder in shared storage for intermediate tables. ``strict``: close
    the known gaps of the rules' patterns (see ``advanced``).

    A document without a path, an unreadable one, and a document without paragraphs are all allowed; the unreadable ones have no results."""
    folder = folder or scratch(spark)
    rules = rules if rules is not None else rules_table(spark)
    check_rules(rules)
    files = staged(docs, folder, "documents")
    docs = _distinct(files, folder)
    paragraphs = staged(formats.paragraph_formats(docs, docx.paragraphs(docs)).drop("runs", "ppr"), folder, "paragraphs")
    runs = staged(formats.run_formats(docs, docx.runs(docs), docx.paragraphs(docs)), folder, "runs")
    main = staged(roles.main_matter(roles.classify(paragraphs.filter(F.col("part_name") == docx.MAIN))), folder, "main")
    found: dict[str, list[tuple[str, DataFrame]]] = {"": [], "A": []}
    marks: list[tuple[str, DataFrame]] = []
    for mark, groups in (("", foundation.review(docs, main, paragraphs, runs, expected)), ("A", advanced.review(docs, main, paragraphs, runs, strict))):
        for name, (own, counts) in groups.items():
            # Each group is a query of its own: one plan of all rules would be replanned after each of its hundreds of exchanges.
            found[mark].append((f"findings-{name}", reduce(DataFrame.unionByName, own)))
            marks.append((f"evaluated-{name}", reduce(DataFrame.unionByName, [c.select("doc_id", "rule_id", F.col("n").cast("long").alias("n")) for c in counts])))
    written = together([*found[""], *found["A"], *marks], folder)
    unite = lambda rows: reduce(DataFrame.unionByName, [written[name] for name, _ in rows])
    first, second = (numbered(unite(found[m]), m).withColumn("engine", F.lit(i)) for i, m in enumerate(found))
    findings = staged(described(first.unionByName(second), rules), folder, "findings")
    results = rule_results(docs, findings, unite(marks), rules)
    bad = files.filter("error is not null").select("doc_id", "path", "error")
    return Audit(main, findings, results, bad, docs.filter("error is null"), files.filter("error is null").select("doc_id", "path", "size"), rules, runs)


def _counted(df: DataFrame, key: str, name: str) -> DataFrame:
    """(doc_id, ``name``): a map from the values of ``key`` to their numbers of rows."""
    counts = df.groupBy("doc_id", key).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(name))


def inspection(docs: DataFrame, main: DataFrame, most: int | None = None, runs: DataFrame | None = None) -> DataFrame:
    """(doc_id, json) of each document: its file, counts, roles, styles, relationships, sections and paragraphs.

    ``most`` limits the listed paragraphs, not the counts. ``runs`` (see ``formats.run_formats``): list the paragraphs' runs as well."""
    counts = docx.inventory(docs).groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("inventory"))
    kinds = _counted(docs.select("doc_id", F.explode("styles.type").alias("type")), "type", "style_types")
    main = main.drop("runs")
    shown = (main if most is None else main.filter(F.col("idx") < most)).withColumn("format", F.to_json(F.transform_values("fmt", lambda _, v: v["v"])))
    told = ["idx", "text", "style_id", "section_index", "in_table", "in_sdt", "in_revision", "role", "confidence", "alignment", "line_multiple", "format"]
    if runs is not None:
        own = runs.filter(F.col("part_name") == docx.MAIN).withColumn("format", F.to_json(F.transform_values("fmt", lambda _, v: v["v"])))
        own = own.groupBy("doc_id", F.col("p_idx").alias("idx")).agg(F.array_sort(F.collect_list(F.struct(F.col("idx"), "text", "style_id", "format"))).alias("runs"))
        shown, told = shown.join(own, ["doc_id", "idx"], "left"), [*told, "runs"]
    listed = shown.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*told))).alias("paragraphs"))
    out = docs.filter("error is null").drop("paragraphs").join(counts, "doc_id").join(kinds, "doc_id", "left").join(_counted(main, "role", "roles"), "doc_id", "left").join(listed, "doc_id", "left")
    sources = F.array_sort(F.array_distinct("rels.source_part"))
    by_source = F.map_from_arrays(sources, F.transform(sources, lambda s: F.filter("rels", lambda r: r["source_part"] == s)))
    catalogue = F.transform("styles", lambda s: F.struct(s["type"].alias("type"), s["style_id"].alias("style_id"), s["name"].alias("name"), s["based_on"].alias("based_on"), s["is_default"].alias("is_default")))
    source = F.struct("path", F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("size").alias("size_bytes"), F.col("doc_id").alias("sha256"))
    return out.select("doc_id", F.to_json(F.struct(
        source.alias("source"), "inventory", "sections", "settings", "numbering", F.struct(F.col("style_types").alias("types"), catalogue.alias("styles")).alias("styles"),
        by_source.alias("relationships"), F.col("roles").alias("role_counts"), "paragraphs",
    )).alias("json"))
