"""The rule catalogue and what all rules share: findings, ids and rollups."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import relational as R
from .texts import ADVICE, TEXTS

# The identifiers of the rules, their severities (E error, W warning, M manual review) and categories.
FOUNDATION = {
    "PAGE-001": "E", "PAGE-002": "E", "PAGE-003": "W", "PAGE-004": "M", "HF-001": "E", "HF-002": "W", "HF-003": "E", "HF-004": "W", "FONT-001": "E", "FONT-002": "W",
    "FONT-003": "E", "PARA-001": "E", "PARA-002": "W", "PARA-003": "W", "HEAD-001": "E", "HEAD-002": "E", "HEAD-003": "E", "HEAD-004": "W", "HEAD-005": "W",
}
ADVANCED = {
    "PKG-001": "E", "PKG-002": "E", "COVER-001": "E", "COVER-002": "E", "COVER-003": "W", "FRONT-001": "E", "ABS-001": "W", "ABS-002": "E", "ABS-003": "E", "ABS-004": "E",
    "ABS-005": "M", "ABS-006": "W", "TOC-001": "E", "TOC-002": "E", "TOC-003": "W", "FIG-001": "W", "FIG-002": "E", "FIG-003": "W", "FIG-004": "W", "FIG-005": "M",
    "TAB-001": "E", "TAB-002": "E", "TAB-003": "E", "TAB-004": "W", "TAB-005": "E", "TAB-006": "M", "EQ-001": "W", "EQ-002": "W", "NOTE-001": "E", "NOTE-002": "E",
    "NOTE-003": "W", "NOTE-004": "W", "REF-001": "E", "REF-002": "E", "REF-003": "E", "REF-004": "E", "REF-005": "E", "REF-006": "E", "REF-007": "E", "REF-008": "E",
    "REF-009": "W", "REF-010": "E", "REF-011": "M", "OBJ-001": "W", "OBJ-002": "E", "OBJ-003": "W", "LANG-001": "M", "LANG-002": "W", "LANG-003": "W", "STRUCT-001": "W",
    "STRUCT-002": "W", "APP-001": "E", "APP-002": "E", "APP-003": "M", "RENDER-001": "M", "RENDER-002": "M", "RENDER-003": "M",
}
_NAMES = {"E": "ERROR", "W": "WARNING", "M": "MANUAL_REVIEW"}
SEVERITIES = tuple(_NAMES.values())
SEVERITY = {r: _NAMES[s] for r, s in (FOUNDATION | ADVANCED).items()}

# Fixed values that the foundation rules compare with; a caller may pass its own.
EXPECTED = {
    "page": {"width_inches": 8.27, "height_inches": 11.69, "orientation": "portrait", "twips": 20},
    "margins": {"top": 1.77, "bottom": 1.1, "left": 1.1, "right": 1.1, "twips": 20},
    "distances": {"header": 42.55, "footer": 48.2, "twips": 20},
    "header": {"font": "楷体", "size_pt": 18, "text": "华中科技大学硕士学位论文", "allowed": 0.25, "rules": 2},
    "body": {"east": "宋体", "latin": "Times New Roman", "size_pt": 12, "allowed": 0.25},
    "paragraph": {"line_multiple": 1.5, "twips": 10},
    "headings": {1: 16, 2: 14, 3: 12}, "heading_font": "黑体", "heading_allowed": 0.25,
    "generic_titles": ["研究内容", "相关工作", "概述", "其他", "小结", "本章小结"],
}

MAIN = "word/document.xml"
COLUMNS = ("doc_id", "phase", "k1", "k2", "rule_id", "severity", "problem", "actual", "scope", "part_name", "section_index", "paragraph_index", "snippet", "run_start", "run_end", "evidence")
_SCHEMA = "doc_id string, phase int, k1 int, k2 int, rule_id string, severity string, problem string, actual string, scope string, part_name string, section_index int, paragraph_index int, snippet string, run_start int, run_end int, evidence variant"


RULE_COLUMNS = "ordinal int, rule_id string, engine string, category string, severity string, object_type string, expected string, source string, suggestion string"


def default_row(ordinal: int, rule: str) -> dict:
    """The built-in values of ``RULE_COLUMNS`` for one rule; a rule of another name has no severity and no texts."""
    prefix = rule.split("-")[0]
    about, expected = TEXTS.get(rule, (None, None))
    engine = "foundation" if rule in FOUNDATION else "advanced"
    return {"ordinal": ordinal, "rule_id": rule, "engine": engine, "category": prefix, "severity": SEVERITY.get(rule), "object_type": about, "expected": expected, "source": "built-in rules", "suggestion": ADVICE.get(prefix)}


def rules_table(spark: SparkSession) -> DataFrame:
    """All built-in rules, with ``RULE_COLUMNS``."""
    return spark.createDataFrame([tuple(default_row(i, r).values()) for i, r in enumerate(SEVERITY)], RULE_COLUMNS)


def check_rules(rules: DataFrame, needed: Iterable[str] = SEVERITY) -> None:
    """A catalogue must have every rule of ``needed``, each rule once, with a name and a known severity."""
    names = rules.groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"), F.max(~F.coalesce(F.col("severity").isin(*SEVERITIES), F.lit(False))).alias("odd"))
    wanted = rules.sparkSession.createDataFrame([(n,) for n in needed], "rule_id string").withColumn("wanted", F.lit(True))
    both = names.join(wanted, "rule_id", "full_outer")
    fault = F.when(F.coalesce(F.trim("rule_id"), F.lit("")) == "", "rules without a rule_id").when(F.col("n") > 1, "rules repeated").when(F.col("n").isNull(), "rules missing").when(F.col("odd"), "rules with an unknown severity")
    bad = both.select(fault.alias("fault"), F.coalesce("rule_id", F.lit("?")).alias("rule_id")).filter("fault is not null").groupBy("fault").agg(F.array_sort(F.collect_list("rule_id")).alias("rules")).orderBy("fault").collect()
    if bad:
        raise ValueError("; ".join(f"{r.fault}: {', '.join(r.rules)}" for r in bad))


def normal(text: Column) -> Column:
    """``text`` with white space as single spaces and none at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def snippet(text: Column) -> Column:
    """The first 40 characters of the normal text."""
    return F.substring(normal(text), 1, 40)


def variant(text: Column) -> Column:
    """``text`` as a variant: JSON objects and arrays as what they are, anything else as a string."""
    return F.coalesce(F.when(text.rlike(r"^\s*[\[{]"), F.try_parse_json(text)), text.cast("variant"))


def emit(df: DataFrame, rule: str | Column, phase: int, problem: str | Column, actual: Column | None = None, severity: str | Column | None = None, k1: Column | None = None, k2: Column | int = 0, runs: Column | None = None, scope: str = "paragraph", evidence: Column | None = None) -> DataFrame:
    """Findings from the rows of ``df``. With scope paragraph the columns part_name, section_index, idx and text name the place;
    with section, section_index; with document, nothing. Without a severity a finding has its rule's; see ``described``.

    ``evidence``: a struct of what the rule compared, of any shape; it becomes a variant, so that findings of all rules are one table. Without
    it the evidence is ``actual``, as JSON where it is that."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    rule = lit(rule)
    place, section = scope == "paragraph", scope in ("paragraph", "section")
    own = {
        "phase": F.lit(phase), "k1": k1 if k1 is not None else (F.col("idx") if place else F.col("section_index") if section else F.lit(0)), "k2": lit(k2),
        "rule_id": rule, "severity": lit(severity).cast("string"), "problem": lit(problem), "actual": lit(actual).cast("string"), "scope": F.lit(scope),
        "part_name": F.col("part_name") if place else F.lit(MAIN), "section_index": F.col("section_index") if section else F.lit(None),
        "paragraph_index": F.col("idx") if place else F.lit(None), "snippet": snippet(F.col("text")) if place else F.lit(None),
        "evidence": F.to_variant_object(evidence) if evidence is not None else variant(lit(actual).cast("string")),
        "run_start": F.array_min(runs) if runs is not None else F.lit(None), "run_end": F.array_max(runs) if runs is not None else F.lit(None),
    }
    kinds = dict(x.split() for x in _SCHEMA.split(", "))
    return df.select("doc_id", *[own[c].cast(kinds[c]).alias(c) for c in COLUMNS[1:]])


def numbered(findings: DataFrame, mark: str) -> DataFrame:
    """``findings`` with finding_id: the rule and a running number (``ordinal``) of the document in the order of phases, ``mark`` before it."""
    order = W.partitionBy("doc_id").orderBy("phase", "k1", "k2", "rule_id", "section_index", "paragraph_index", "problem")
    out = findings.withColumn("ordinal", F.row_number().over(order))
    return out.withColumn("finding_id", F.concat("rule_id", F.lit(f"-{mark}"), F.format_string("%04d", F.col("ordinal"))))


def described(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """``findings`` with their rule's category, object_type, expected, source and suggestion, and its severity where they have none."""
    own = rules.select("rule_id", F.col("severity").alias("_severity"), "category", "object_type", "expected", "source", "suggestion")
    return findings.join(own, "rule_id", "left").withColumn("severity", F.coalesce("severity", "_severity")).drop("_severity")


def rule_results(docs: DataFrame, findings: DataFrame, evaluated: DataFrame, rules: DataFrame) -> DataFrame:
    """Per document and rule: ordinal, rule_id, status, finding_count, evaluated_count. PASS with nothing evaluated means nothing applied."""
    grid = docs.filter("error is null").select("doc_id").join(rules.select("ordinal", "rule_id").hint("broadcast"))
    rolled = R.severity_rollup(grid, findings, ["doc_id", "rule_id"])
    counts = evaluated.groupBy("doc_id", "rule_id").agg(F.sum("n").alias("evaluated_count"))
    return rolled.join(counts, ["doc_id", "rule_id"], "left").withColumn("evaluated_count", F.coalesce("evaluated_count", F.lit(0)).cast("long"))
