"""Rollups, missing references, comparisons and plans over findings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Severities from mild to grave; a rollup takes the gravest.
SEVERITIES = ("PASS", "MANUAL_REVIEW", "WARNING", "ERROR")


def priority(severity: Column) -> Column:
    out = F.lit(None).cast("int")
    for i, name in enumerate(SEVERITIES):
        out = F.when(severity == name, i).otherwise(out)
    return out


def severity_rollup(rules: DataFrame, findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rules`` with status (the gravest severity of its findings, else PASS) and finding_count, joined on ``keys``."""
    rolled = findings.groupBy(*keys).agg(F.max_by("severity", priority(F.col("severity"))).alias("status"), F.count(F.lit(1)).alias("finding_count"))
    return rules.join(rolled, list(keys), "left").withColumns({"status": F.coalesce("status", F.lit("PASS")), "finding_count": F.coalesce("finding_count", F.lit(0)).cast("long")})


def severity_counts(findings: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """A count of each severity, zero where there is none."""
    return findings.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITIES])


def category_counts(findings: DataFrame, category: str = "category") -> DataFrame:
    return findings.groupBy(category).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), category)


def missing(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``left`` whose keys ``right`` doesn't have."""
    return left.join(right.select(*keys), list(keys), "left_anti")


#: How many names a list of required names may have.
MOST_REQUIRED = 10_000


def missing_required(keys: DataFrame, present: DataFrame, required: DataFrame, key: str, name: str) -> DataFrame:
    """(key, name) for each key and each name of ``required`` that the key lacks.

    ``required`` is a short list: over ``MOST_REQUIRED`` different names are an error, for each key is paired with every name. Nulls are no names."""
    names = [r[0] for r in required.select(name).filter(F.col(name).isNotNull()).distinct().limit(MOST_REQUIRED + 1).collect()]
    if len(names) > MOST_REQUIRED:
        raise ValueError(f"over {MOST_REQUIRED} required names")
    wanted = keys.select(key).distinct().withColumn(name, F.explode(F.array(*map(F.lit, sorted(names))).cast(f"array<{required.schema[name].dataType.simpleString()}>")))
    return wanted.join(present.select(key, name), [key, name], "left_anti")


def tolerance(actual: Column, expected: Column, allowed: Column | float) -> Column:
    """struct(wrong, unresolved): a null is unresolved and never wrong."""
    allowed = allowed if isinstance(allowed, Column) else F.lit(allowed)
    unresolved = actual.isNull() | expected.isNull()
    return F.struct(F.coalesce(F.abs(actual - expected) > allowed, F.lit(False)).alias("wrong"), unresolved.alias("unresolved"))


def graded(check: Column, severity: str) -> Column:
    """The severity of a tolerance check: ``severity`` if wrong, MANUAL_REVIEW if only unresolved, else PASS."""
    return F.when(check["wrong"], severity).when(check["unresolved"], "MANUAL_REVIEW").otherwise("PASS")


def inventory_diff(before: DataFrame, after: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose ``value`` isn't the same (null-safe) in both: keys, before, after."""
    b = before.select(*keys, F.col(value).alias("before"), F.lit(True).alias("_b"))
    a = after.select(*keys, F.col(value).alias("after"), F.lit(True).alias("_a"))
    joined = b.join(a, list(keys), "full_outer")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after")) | F.col("_a").isNull() | F.col("_b").isNull()).select(*keys, "before", "after")


def coverage(n: Column, total: Column) -> Column:
    """``n`` of ``total`` in per cent with one decimal; 0.0 of nothing."""
    return F.coalesce(F.round(F.try_divide(n * 100.0, total), 1), F.lit(0.0))


def comment_plan(findings: DataFrame, paragraphs: DataFrame, base: int = 0) -> DataFrame:
    """Where each finding's comment goes.

    ``findings``: doc_id, finding_id, severity, part_name, paragraph_index, snippet, run_start, run_end. ``paragraphs``: doc_id,
    part_name, paragraph_index, text. Findings of one paragraph share a comment; ids follow the paragraphs from ``base``. A comment
    spans runs only if its findings name one range between them and none is about the whole paragraph."""
    known = paragraphs.select("doc_id", "part_name", "paragraph_index", F.col("text").alias("_text"), F.lit(True).alias("_known"))
    df = findings.join(known, ["doc_id", "part_name", "paragraph_index"], "left")
    reason = (
        F.when(F.col("severity") == "MANUAL_REVIEW", "manual_review")
        .when(~F.coalesce(F.col("severity").isin("ERROR", "WARNING"), F.lit(False)), "unsupported_severity")
        .when(F.col("paragraph_index").isNull() | F.col("part_name").isNull(), "missing_anchor")
        .when(F.col("part_name") != "word/document.xml", "unsupported_story_part")
        .when(F.col("_known").isNull(), "paragraph_not_found")
        .when(F.coalesce(F.col("snippet"), F.lit("")) == "", None)
        .when(~F.col("_text").contains(F.col("snippet")), "snippet_mismatch")
    )
    df = df.withColumn("skip_reason", reason).withColumn("commented", F.col("skip_reason").isNull())
    place = W.partitionBy("doc_id", "commented").orderBy("paragraph_index")
    group = W.partitionBy("doc_id", "commented", "part_name", "paragraph_index")
    ranged = F.col("run_start").isNotNull() & F.col("run_end").isNotNull()
    ranges = F.size(F.collect_set(F.struct("run_start", "run_end")).over(group))
    mode = F.when((ranges == 1) & F.min(ranged).over(group), "run_range").otherwise("paragraph")
    df = df.withColumn("comment_id", F.when(F.col("commented"), (F.dense_rank().over(place) - 1 + base).cast("long")))
    df = df.withColumn("anchor_mode", F.when(F.col("commented"), mode))
    return df.select("doc_id", "finding_id", "commented", "comment_id", "anchor_mode", "skip_reason")
