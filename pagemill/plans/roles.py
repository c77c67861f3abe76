"""The role of every paragraph, from its text, its style, and where it stands.

A paragraph's role is found by the first test that holds. Some titles set a context for what follows; within the references every
paragraph is an entry. The contexts are windows over a document's paragraphs, all on one partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import pattern as P

#: Fixed patterns of the roles.
FIGURE = r"图\s*\d+\s*[-－—.]\s*\d+"
TABLE = r"(?:续\s*)?表\s*\d+\s*[-－—.]\s*\d+"
REFERENCE = r"\s*[\[［【]\s*\d+\s*[\]］】]"
NUMBERED = r"\s*\d+(?:\s+|[、.．])"
#: Roles that set the context of later paragraphs.
SETS = {"abstract_title_cn": "abstract_cn", "abstract_title_en": "abstract_en", "toc_title": "toc", "references_title": "references", "acknowledgements_title": "acknowledgements", "appendix_heading": "appendix"}
#: Roles of plain paragraphs by context, with confidence.
BODIES = {"abstract_cn": ("abstract_body_cn", 0.9), "abstract_en": ("abstract_body_en", 0.9), "toc": ("toc_related_text", 0.65), "acknowledgements": ("acknowledgements_body", 0.85), "appendix": ("appendix_body", 0.8)}
END_ROLES = ("references_title", "acknowledgements_title", "appendix_heading")


def classify(paragraphs: DataFrame) -> DataFrame:
    """``paragraphs`` of the main part, with formats, plus role, confidence, evidence and ``stripped``."""
    text, style = F.col("stripped"), F.lower(F.regexp_replace("style_name", " ", ""))
    df = paragraphs.withColumn("stripped", P.stripped(F.col("text"))).withColumn("_c", P.compact(F.col("text")))
    free = (
        F.when(text == "", F.lit("empty"))
        .when(F.col("_c") == "摘要", "abstract_title_cn")
        .when(F.lower("_c") == "abstract", "abstract_title_en")
        .when(P.starts(text, r"关键词\s*[:：]"), "keywords_cn")
        .when(P.starts(text, r"(?i:key\s*words?\s*[:：])"), "keywords_en")
        .when(F.col("_c") == "目录", "toc_title")
        .when(style.startswith("toc") | style.startswith("目录"), "toc_entry")
        .when(F.col("_c") == "参考文献", "references_title")
        .when(F.col("_c") == "致谢", "acknowledgements_title")
        .when(P.starts(text, "附录"), "appendix_heading")
        .when(P.starts(text, FIGURE), "figure_caption")
        .when(P.starts(text, TABLE), "table_caption")
    )
    sets = F.lit(None).cast("string")
    for role, context in SETS.items():
        sets = F.when(F.col("_free") == role, context).otherwise(sets)
    ids = F.lower(F.regexp_replace(F.coalesce("style_id", F.lit("")), " ", ""))
    named = F.coalesce(*[F.when(k.rlike("^(heading|标题)[1-9]$"), F.substring(k, -1, 1).cast("int")) for k in (style, ids)])
    level = F.coalesce(named, F.when(F.col("outline_level").between(0, 8), F.col("outline_level") + 1))
    df = df.withColumn("_free", free).withColumn("_set", sets).withColumn("_level", level)
    w = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_segment", F.count("_set").over(w)).withColumn("_base", F.coalesce(F.last("_set", ignorenulls=True).over(w), F.lit("front")))
    entry = F.col("_free").isNull() & (P.starts(text, REFERENCE) | (F.col("_base") == "references"))
    heading = F.col("_free").isNull() & ~entry & F.col("_level").isNotNull()
    opens = heading & (P.starts(text, NUMBERED) | (F.col("_base") == "toc"))
    before = W.partitionBy("doc_id", "_segment").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    df = df.withColumn("_context", F.when(F.coalesce(F.max(opens.cast("int")).over(before), F.lit(0)) == 1, "main").otherwise(F.col("_base")))
    body, sure = F.lit("body"), F.lit(0.75)
    for context, (role, confidence) in BODIES.items():
        body, sure = F.when(F.col("_context") == context, role).otherwise(body), F.when(F.col("_context") == context, confidence).otherwise(sure)
    role = F.coalesce(F.col("_free"), F.when(entry, "reference_entry"), F.when(heading, F.concat(F.lit("heading_"), F.col("_level"))), F.when(F.col("has_omml"), "equation"), body)
    confidence = (
        F.when(F.col("_free").isin("figure_caption", "table_caption"), 0.98)
        .when(F.col("_free").isin("toc_entry", "appendix_heading"), 0.99)
        .when(F.col("_free").isNotNull(), 1.0)
        .when(entry, F.when(P.starts(text, REFERENCE), 0.96).otherwise(0.72))
        .when(heading, 0.97)
        .when(F.col("has_omml"), 0.95)
        .otherwise(sure)
    )
    evidence = F.when(F.col("_free").isNotNull(), "text or style").when(entry, "reference number or region").when(heading, "heading style or outline level").when(F.col("has_omml"), "equation object").otherwise(F.concat(F.lit("context "), F.col("_context")))
    return df.select(*paragraphs.columns, "stripped", role.alias("role"), confidence.alias("confidence"), evidence.alias("evidence"))


def main_matter(classified: DataFrame) -> DataFrame:
    """``in_main`` (on at numbered first-level headings, off at end titles) and ``in_bounds`` (from the first such heading after the
    table of contents to the first end title): the two notions of main matter that the rules use."""
    starts = (F.col("role") == "heading_1") & (P.starts(F.col("text"), r"\s*\d+") | F.col("numbering_id").isNotNull())
    event = F.when(F.col("role").isin(*END_ROLES), False).when(starts, True)
    w = W.partitionBy("doc_id").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("doc_id")
    df = classified.withColumn("in_main", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(False)))
    df = df.withColumn("_toc", F.coalesce(F.max(F.when(F.col("role") == "toc_entry", F.col("idx"))).over(whole), F.lit(-1)))
    df = df.withColumn("_from", F.coalesce(F.min(F.when((F.col("role") == "heading_1") & (F.col("idx") > F.col("_toc")), F.col("idx"))).over(whole), F.lit(0)))
    df = df.withColumn("_to", F.min(F.when(F.col("role").isin(*END_ROLES) & (F.col("idx") > F.col("_from")), F.col("idx"))).over(whole))
    return df.withColumn("in_bounds", (F.col("idx") >= F.col("_from")) & (F.col("_to").isNull() | (F.col("idx") < F.col("_to")))).drop("_toc", "_from", "_to")
